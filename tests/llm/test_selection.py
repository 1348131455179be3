"""Source divergence, importance resampling and URL filters against brute force, edge cases included."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import pytest

from quiltra.llm import importance_resampling, queries, source_divergence, url_filters

from ..oracle import DATA, run_sql
from .test_edges import documents, tables  # noqa: F401

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def compared(found):
    return sorted(tuple(map(str, r)) for r in found)


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_importance_resampling", "op13_url_filters"])
def test_query_matches_sql(spark, name):
    ours = queries.QUERIES[name](spark, DATA)
    theirs = run_sql(queries.SQL[name]).astype(object)
    theirs = theirs.where(theirs.notna(), None)
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    whole = lambda x: int(x) if isinstance(x, float) else x
    assert compared(tuple(r) for r in ours.select(*columns).collect()) == compared(tuple(map(whole, r)) for r in theirs[columns].itertuples(index=False))


def divergence(rows, min_docs, most):
    """part rows of (lang, source, text)."""
    rows = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [(s, w) for lg, s, w in rows if lg == lang]
        docs = collections.Counter(t for _, w in own for t in set(w))
        kept = sorted(t for t, n in docs.items() if n >= min_docs)
        count = {s: collections.Counter(t for x, w in own if x == s for t in w if docs[t] >= min_docs) for s, _ in own}
        everything = sum(count.values(), collections.Counter())
        prob = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p, q = {s: prob(c) for s, c in count.items()}, prob(everything)
        for s in count:
            pairs = [(x, sum(abs(p[s][t] - p[x][t]) for t in kept)) for x in count if x != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, most)):
                found.sort(key=lambda e: (-e[1], e[0].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(found[:limit])]
    return out


@pytest.mark.parametrize("block, own, postings, most", [(512, 32, 10**6, 50), (2, 3, 20, 1), (3, 1, 7, 4)])
def test_divergence_is_brute_force(spark, block, own, postings, most):
    rng = random.Random(block)
    words = ["the", "The", "é", "Éa", "x", "zeta", "alpha", "a1b", "rare"] + [f"w{chr(97 + k)}" for k in range(20)]
    rows = [(rng.choice(["en", "de", None]), rng.choice([None, "", "s1", "s2", "s3", "s10", "é", "hot", "hot", "hot"]), " ".join(rng.choice(words[: rng.randint(3, 29)]) for _ in range(rng.randint(0, 30)))) for _ in range(300)]
    rows += [("fr", "only", "one source"), ("es", "a", "too few"), ("es", "b", None), ("en", "empty", ""), ("en", "digits", "12 34"), ("en", "hot", "The " * 20_000), ("en", "hot", "The " * 20_000)]
    docs = spark.createDataFrame([(*r, "x", "x", 1) for r in rows], "lang string, source string, text string, term string, value string, n int").repartition(3)
    got = source_divergence.source_divergence(docs, most=most, min_docs=5, block=block, own=own, postings=postings)
    want = divergence(rows, 5, most)
    assert compared(tuple(r) for r in got.collect()) == compared(want)
    assert {w[2] for w in want} == {"pair", "term"} and max(w[5] for w in want if w[2] == "term") == min(most, 26)


def test_divergence_looks_at_few_buckets_and_counts_past_64_bits(spark):
    audit = source_divergence.SourceDivergence(spark.createDataFrame([("en", f"s{k % 3}", "aa bb cc " * k) for k in range(90)], "lang string, source string, text string"))
    assert audit.buckets.count() <= 9
    # probabilities of counts whose product with the scale needs more than 64 bits
    big = 8 * 10**18
    row = spark.createDataFrame([(big - 7, big, 12345)], "c long, n long, v long")
    p = row.select(source_divergence.probability(row["c"], row["n"], row["v"], 5)).first()[0]
    assert p == 1 + 10**9 * (big - 2) // (big + 5 * 12345)


def resampled(rows, target, percent, least_words, buckets=10_000, seed=42):
    """id, n_features, weight, score of (id, text) rows and the drawn ones in order."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    grams = lambda w: [" ".join(w[i : i + m]) for m in (1, 2, 3) for i in range(len(w) - m + 1)]
    hashed = lambda t: [zlib.crc32(g.encode()) % buckets for g in grams(words(t))]
    own, aim = [hashed(t) for _, t in rows], [hashed(t) for t in target]
    s, t = collections.Counter(itertools.chain(*own)), collections.Counter(itertools.chain(*aim))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (n_s + buckets) / ((s[b] + 1.0) * (n_t + buckets))))
    out = []
    for (k, text), bs in zip(rows, own):
        h = int(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, bs))
        out.append((k, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= least_words))
    able = sorted((o for o in out if o[4]), key=lambda o: (-o[3], -1 if o[0] is None else o[0]))
    return out, able[: percent * len(able) // 100]


@pytest.mark.parametrize("slice_bytes, range_rows, percent", [(1 << 20, 10**6, 5), (300, 7, 40), (64, 1, 100)])
def test_resampling_is_brute_force(spark, slice_bytes, range_rows, percent):
    rows = documents() + [(80, "Ünï " * 400), (81, "x-1_Y" * 300), (81, "x-1_Y" * 300), (82, "w" * 5000), (83, "\0\x7f ;" * 900)]
    target = [rows[3][1], rows[9][1], None, "", "é A é a"]
    docs = spark.createDataFrame([(k, t, "x", 0, True) for k, t in rows], "doc_id long, text string, bucket string, n int, eligible boolean").repartition(3)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance_resampling.importance_resampling(docs, aim, percent=percent, slice_bytes=slice_bytes, range_rows=range_rows).collect()
    want, drawn = resampled(rows, target, percent, 20)
    assert compared((r.doc_id, r.n_features, r.weight, r.score) for r in got) == compared(w[:4] for w in want)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1)) and len(drawn) >= 2
    assert [(r.doc_id, r.score) for r in ranked] == [(d[0], d[3]) for d in drawn]


def test_resampling_without_target(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = importance_resampling.importance_resampling(docs, spark.createDataFrame([], "text string"), least_words=2, percent=100).collect()
    want, _ = resampled([(1, "a b"), (2, None)], [], 100, 2)
    assert compared((r.doc_id, r.n_features, r.weight, r.score) for r in got) == compared(w[:4] for w in want)
    assert {r.doc_id: r["rank"] for r in got} == {1: 1, 2: None}


URLS = [
    None, "", "no scheme", "://", "http://", "http://com", "http://com/", "http://COM/x", "http://xcom/", "http://a.com", "http://a.com/", "https://example.com/en/", "https://example.com/en", "https://Example.COM/en/1?x=/fr/#y",
    "https://www.example.com/en/2", "https://m.www.example.com/en/2", "https://m.example.com/EN/2", "http://a.net/es/1", "http://net/es/", "http://.net/fr/", "http://a.net/fr", "http://a.net:80/fr/", "http://a.net./fr/", "http://a.net?/fr/",
    "http://a.net#/fr/", "a://b://c.com/x", "//net/es/", "http://é.com/é/", "http://a..com//en/", "http://example.com/" + "en/" * 3000, "http://" + "a." * 3000 + "net/es/x",
]
RULES = [*url_filters.RULES, ("block", "", "/en"), ("allow", "example.com", "/en/en/e"), ("block", "example.com", ""), ("allow", "example.com", ""), ("block", "com", "/é"), ("allow", "net", "/e"), ("block", "COM", "/"), (None, "net", "/"), ("block", None, "//")]


def judged(url, rules, default):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = host.translate(LOWER)
    rules = [(v, (h or "").translate(LOWER), p or "") for v, h, p in rules if v]
    fits = [(len(h.split(".")) if h else 0, len(p), v == "block", h + p, v) for v, h, p in rules if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


@pytest.mark.parametrize("trie_bytes", [url_filters.TRIE_BYTES, 0])
@pytest.mark.parametrize("rules", [url_filters.RULES, RULES, []])
def test_urls_are_brute_force(spark, trie_bytes, rules):
    urls = URLS + ["http://a.net/es/1"] * 3
    pages = spark.createDataFrame([(k, u, "mine", "x") for k, u in enumerate(urls)], "page_id long, url string, Rule string, _found string").repartition(3)
    got = url_filters.url_filters(pages, spark.createDataFrame(list(rules), "verdict string, host string, path string"), default="block", trie_bytes=trie_bytes - (not trie_bytes and not rules))
    assert got.columns == ["page_id", "url", "_found", "host", "path", "rule", "verdict"]
    assert compared((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()) == compared((k, *judged(u, rules, "block")) for k, u in enumerate(urls))
    if not rules:
        assert {r.verdict for r in got.collect()} == {"block"}


def test_queries_on_edge_tables(spark, tables):  # noqa: F811
    got = {r.page_id: (r.host, r.path[:4], r.rule, r.verdict) for r in queries.QUERIES["op13_url_filters"](spark, tables[0]).collect()}
    a = ("a.example.com", "/en/", "example.com/en/", "block")
    assert got == {0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: a, 4: a, 5: (".net", "/es/", "net/es/", "block")}
    rows = [("en" if i % 3 else None, f"s{i % 2}", t) for i, (_, t) in enumerate(documents())]
    assert compared(tuple(r) for r in queries.QUERIES["op11_source_divergence"](spark, tables[0]).collect()) == compared(divergence(rows, 30, 50))
    items = [documents()[9][1], documents()[10][1], documents()[9][1], None, ""]
    want, _ = resampled(documents(), items, 5, 20)
    assert compared((r.doc_id, r.n_features, r.weight, r.score) for r in queries.QUERIES["op12_importance_resampling"](spark, tables[0]).collect()) == compared(w[:4] for w in want)
