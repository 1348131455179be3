"""Null and repeated ids, repeated rows, long, empty and missing texts, clashing columns: every query and stage by its name."""

import collections
import hashlib
import random
import zlib

import pytest

import corpus_pipeline
from quiltra.llm import packing, queries, substring_dedup, suffix_dedup
from quiltra.llm.packing import WordTokenizer

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, print string, _words string, row string, score string, kept string, n_lines string, key string"


def documents():
    rng = random.Random(17)
    vocabulary = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    prose = lambda n: " ".join(line(rng.randint(4, 12)).capitalize() + "." for _ in range(n))
    shared, copied = prose(12), prose(14)
    rows = [(k, prose(rng.randint(1, 20))) for k in range(12)]
    rows += [(20 + k, f"{prose(3)} {shared} {prose(2)}") for k in range(4)]
    rows += [(30 + k, "Frequent line\n" + prose(4)) for k in range(11)]
    rows += [(50, copied), (51, copied), (52, copied + " more"), (53, copied), (53, copied)]  # equal rows
    rows += [(60, prose(9)), (60, prose(9)), (60, copied)]  # texts of one id
    rows += [(None, prose(8)), (None, prose(8)), (None, copied), (None, None), (None, None)]
    rows += [(70, None), (71, ""), (72, " \t\n\n"), (73, "one"), (74, "one"), (75, "ab " * 40_000), (76, prose(1500))]
    return rows


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Folders with the tables, with as many rows and with none."""
    out = []
    for rows in (documents(), []):
        folder = str(tmp_path_factory.mktemp("tables"))
        full = [(k, t, "en" if i % 3 else None, f"s{i % 2}", len(t or ""), *["x"] * 8) for i, (k, t) in enumerate(rows)]
        spark.createDataFrame(full, SCHEMA).write.parquet(f"{folder}/documents.parquet")
        labels = [(k, i % 2, 0) for i, (k, _) in enumerate(rows)]
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        items = [(None, rows[9][1]), (None, rows[10][1]), (7, rows[9][1]), (8, None), (9, "")] if rows else []
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        pages = [(k, u, "x", "x", "x") for k, u in enumerate([None, "", "no host", "http://A.Example.com/en/1?q", "http://A.Example.com/en/1?q", "x://.net/es/" + "a/" * 9000])] if rows else []
        spark.createDataFrame(pages, "page_id long, url string, html string, Host string, verdict string").write.parquet(f"{folder}/pages.parquet")
        out.append(folder)
    return out


def collected(spark, tables, name, which=0):
    return queries.QUERIES[name](spark, tables[which]).collect()


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries_of_empty_tables(spark, tables, name):
    assert collected(spark, tables, name, 1) == []


def test_op1_on_edge_cases(spark, tables):
    rows = documents()
    got = collected(spark, tables, "op1_substring_dedup")
    assert len(got) == len(rows)
    left = collections.Counter((r.doc_id, r.text) for r in got)
    distinct = list(dict.fromkeys(rows))
    # the first document of a shared passage keeps it: null ids come first, then the least id
    for k, t in distinct:
        if t and len(t.split()) > 49 and k in (0, 1, 2, 20):
            assert left[(k, t)] == 1
    assert all(r.text == "" for r in got if r.doc_id in (71, 70))
    copies = [r for r in got if r.doc_id in (50, 51, 53)]
    assert len(copies) == 4 and all(r.n_removed == r.n_sentences > 0 for r in copies)
    assert len({r.text for r in got if r.doc_id == 53}) == 1


def test_op4_is_brute_force_at_400_bytes(spark, tables):
    rows = documents()
    seen = collections.Counter()
    for _, t in rows:
        raw = (t or "").encode()
        seen.update(hashlib.md5(raw[i : i + 400]).digest() for i in range(len(raw) - 399))
    want = []
    for k, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 399):
            if seen[hashlib.md5(raw[i : i + 400]).digest()] > 1:
                gone[i : i + 400] = b"\1" * 400
        n_spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        want.append((k is None, k or 0, len(raw), sum(gone), n_spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()))
    got = [(r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in collected(spark, tables, "op4_suffix_dedup")]
    assert sorted(got) == sorted(want)
    assert sum(w[3] > 0 for w in want) > 10


def test_op4_finds_repeats_at_the_default_length(spark):
    rng = random.Random(3)
    raw = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    rows = []
    for k in range(60):  # passages about the length, at chance places
        passage = raw(rng.choice([270, 390, 399, 400, 401, 430, 700]))
        rows += [(2 * k, raw(rng.randint(0, 300)) + passage + raw(rng.randint(0, 300))), (2 * k + 1, raw(rng.randint(0, 300)) + passage)]
    found = suffix_dedup.SuffixDedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).removals().collect()
    want = brute.suffix_dedup(rows, 400)
    got = {r.doc: (r.n_removed, r.n_spans) for r in found}
    assert {k: got.get(k, (0, 0)) for k in want} == {k: v[:2] for k, v in want.items()}
    assert {r.doc for r in found if r.n_repeated} == set(want)  # every passage of 270 bytes or more is reported


def test_op2_on_edge_cases(spark, tables):
    got = {(r.doc_id, r.item_id) for r in collected(spark, tables, "op2_decontamination")}
    assert got == {(9, None), (9, 7), (10, None)}


def test_op3_is_the_tokenizers_totals(spark, tables):
    from tokenizers import Tokenizer

    rows = [(k, t, "en" if i % 3 else None, f"s{i % 2}") for i, (k, t) in enumerate(documents())]
    least = {}
    for k, t, _, _ in rows:
        if k is not None:
            least[t or ""] = min(k, least.get(t or "", k))
    gone = {k for k, t, _, _ in rows if k is not None and least[t or ""] != k}
    want = collections.Counter()
    for version, file, end in (("word_bpe_49k", "word_bpe_49k.json", 1), ("byte_bpe_50k", "byte_bpe_50k.json", 0)):
        model = Tokenizer.from_file(packing.tokenizer_path(file))
        model.encode_special_tokens = True
        for k, t, lang, source in rows:
            if k not in gone or k is None:
                own = (source, lang, version)
                want[own, "docs"] += 1
                want[own, "tokens"] += len(model.encode(t or "", add_special_tokens=False).ids) + end
                want[own, "chars"] += len(t or "")
    got = {}
    for r in collected(spark, tables, "op3_token_counts"):
        own = (r.source, r.lang, r.tokenizer)
        got |= {(own, "docs"): r.n_docs, (own, "tokens"): r.n_tokens, (own, "chars"): r.n_chars}
    assert got == {k: v for k, v in want.items()}


def test_op5_op7_op8_op9_judge_every_row(spark, tables):
    rows = documents()
    words = [brute.words(t) for _, t in rows]
    got = collected(spark, tables, "op5_quality_rules")
    assert sorted(r.n_words for r in got) == sorted(map(len, words)) and all(r.base_failed and not r.kept for r in got if r.n_words < 50)
    got = collected(spark, tables, "op7_ppm")
    held = [zlib.crc32(b"" if k is None else str(k).encode()) % 7 == 2 for k, _ in rows]
    assert sorted((r.held_out, r.n_tokens) for r in got) == sorted((h, len(w) + 1) for h, w in zip(held, words))
    assert {r.train_tokens for r in got} == {sum(len(w) + 1 for h, w in zip(held, words) if not h)}
    streams = [b"".join(w + b" " for w in ws) + b"\0" for ws in words]
    score = brute.ppm([s for s, h in zip(streams, held) if not h], streams[:40], 5)
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r.score)
    for (k, _), s in list(zip(rows, score))[:30]:
        assert min(abs(s - x) for x in by[k]) < 1e-6 * max(1, abs(s))
    got = collected(spark, tables, "op8_quality_classifier")
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert len({r.score for r in got if r.doc_id == 53}) == 1
    got = collected(spark, tables, "op9_best_fit_packing")
    sizes = [len(x) // 4 + 1 for x in WordTokenizer.of(packing.tokenizer_path()).ids([t or "" for _, t in rows])]
    assert sum(r.length for r in got) == sum(sizes) and len(got) == sum(-(-n // 4096) for n in sizes)
    fill = collections.defaultdict(list)
    for r in got:
        fill[r.sequence_id].append((r.offset, r.length))
    for parts in fill.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 4096


def test_op6_is_brute_force(spark, tables):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_lines, r.n_dropped, r.kept_sha256) for r in collected(spark, tables, "op6_line_dedup"))
    assert got == sorted((k is None, k or 0, n, d, hashlib.sha256(t.encode()).hexdigest()) for k, n, d, t in brute.line_dedup(documents(), 10))


def test_op10_is_brute_force(spark, tables):
    rows = documents()
    groups = brute.jaccard_components([(i, t) for i, (_, t) in enumerate(rows)], 3, 90, 100)
    least = {}
    for i, (k, _) in enumerate(rows):
        root = groups[i][1]
        if k is not None:
            least[root] = min(k, least.get(root, k))
    want = sorted((str(k), groups[i][0], str(least.get(groups[i][1], k))) for i, (k, _) in enumerate(rows))
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in collected(spark, tables, "op10_jaccard_join")) == want


@pytest.mark.parametrize("number", range(5))
def test_stages_on_edge_cases(spark, tables, number):
    name, stage = corpus_pipeline.STAGES[number]
    for folder, rows in zip(tables, (documents(), [])):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        out = stage(spark, docs, folder)
        found = out.collect()
        if name == "best_fit_packing":
            assert {r.doc_id for r in found} == {k for k, _ in rows}
            continue
        assert out.columns == docs.columns
        left = collections.Counter((r.doc_id, r.text) for r in found)
        if name == "jaccard_join" and rows:
            groups = brute.jaccard_components([(i, t) for i, (_, t) in enumerate(rows)], 5, 80, 100)
            members = collections.defaultdict(set)
            for i, (k, t) in enumerate(rows):
                members[groups[i][1]].add((k, t))
            # one row, or its equals, of each group; never one without id where another has one
            for some in members.values():
                stay = [m for m in some if left[m]]
                assert len(stay) == 1 and (stay[0][0] is not None or all(k is None for k, _ in some))
        elif name == "decontamination" and rows:
            assert left == collections.Counter(r for r in rows if r[0] not in (9, 10))
        elif name == "line_dedup" and rows:
            assert left == collections.Counter((k, t) for k, _, _, t in brute.line_dedup(rows, 10))


def test_passages_of_op1_at_its_defaults(spark):
    """Passages of 50 words in two documents lose words in the later one, and nothing else does."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    text = lambda n: " ".join(word() + ("." if rng.random() < 0.1 else "") for _ in range(n))
    rows = []
    for k in range(30):
        passage = text(52)
        rows += [(k, f"{text(40)} {passage} {text(20)}"), (100 + k, f"{text(25)} {passage} {text(40)}"), (200 + k, text(120))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(docs, passage=substring_dedup.PASSAGE_WORDS).collect()}
    assert all((n > 0) == (100 <= k < 200) for k, n in got.items())
