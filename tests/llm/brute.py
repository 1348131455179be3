"""Brute-force versions of the corpus operators."""

import collections
import hashlib
import math
import re

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text):
    return [w for w in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode().translate(LOWER)) if w]


def sentences(text):
    raw, out, cur = (text or "").encode(), [], []
    for m in re.finditer(rb"[^\x20\x09-\x0d]+", raw):
        if cur and (cur[-1].group()[-1:] in b".!?" or b"\n" in raw[cur[-1].end() : m.start()]):
            out.append(cur)
            cur = []
        cur.append(m)
    return out + [cur] if cur else out


def substring_dedup(rows, run, min_words):
    parts = {k: sentences(t) for k, t in rows}
    seen, gone = collections.defaultdict(list), collections.defaultdict(set)
    for k, s in parts.items():
        for p in range(len(s)):
            e = p + run
            while e < len(s) and sum(map(len, s[p:e])) < min_words:
                e += 1
            if e <= len(s) or p == 0:
                w = tuple(m.group().translate(LOWER) for x in s[p:e] for m in x)
                if len(w) >= min_words:
                    seen[w].append((k, p, min(e, len(s))))
    for found in seen.values():
        for k, p, e in sorted(found)[1:]:
            gone[k] |= set(range(p, e))
    return {k: (len(s), len(gone[k])) for k, s in parts.items()}


def suffix_dedup(rows, length):
    seen = collections.Counter()
    for _, t in rows:
        raw = (t or "").encode()
        seen.update(raw[i : i + length] for i in range(len(raw) - length + 1))
    out = {}
    for k, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[k] = (sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest())
    return out


def line_dedup(rows, min_docs, min_chars=1):
    strip = " \t\n\x0b\x0c\r"
    key = lambda line: line.strip(strip).encode().translate(LOWER).decode()
    seen = collections.Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if len(k) >= min_chars)
    out = []
    for k, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if seen[key(x)] < min_docs or len(key(x)) < min_chars]
        out.append((k, len(lines), len(lines) - len(left), "\n".join(left)))
    return out


def shingles(text, size):
    w = words(text)
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def jaccard_components(rows, size, num, den):
    sets = {k: shingles(t, size) for k, t in rows}
    up = {k: k for k in sets}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {k: (len(sets[k]), find(k)) for k in ids}


def ppm(train, texts, order):
    """log10 probability of each text (bytes) by PPM with method D escapes and exclusion."""
    counts = [collections.defaultdict(collections.Counter) for _ in range(order + 1)]
    for s in train:
        p = b"\0" * order + s
        for i in range(order, len(p)):
            for k in range(order + 1):
                counts[k][p[i - k : i]][p[i]] += 1
    out = []
    for s in texts:
        p, total = b"\0" * order + s, 0.0
        for i in range(order, len(p)):
            out_of, done = set(), False
            for k in range(order, -1, -1):
                c = counts[k].get(p[i - k : i])
                if not c:
                    continue
                left = {x: n for x, n in c.items() if x not in out_of}
                if left:
                    if p[i] in left:
                        total += math.log10((left[p[i]] - 0.5) / sum(left.values()))
                        done = True
                        break
                    total += math.log10(0.5 * len(left) / sum(left.values()))
                out_of |= set(c)
            if not done:
                total -= math.log10(256 - len(out_of))
        out.append(total)
    return out
