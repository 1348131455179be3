import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quiltra.llm import components as llm_components
from quiltra.llm import jaccard_join, line_dedup, quality_rules, substring_dedup, suffix_dedup
from quiltra.llm.components import components

from ..oracle import assert_same
from . import brute

SCHEMA = "doc_id long, text string, n_lines string, kept string, doc string, key string"


def frame(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(k, t, "x", "y", "z", "w") for k, t in rows], SCHEMA)


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(40)]
    sentence = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(2, 9))).capitalize() + rng.choice(".!?")
    shared = [" ".join(sentence() for _ in range(4)) for _ in range(3)] + ["Common line", " common LINE\t"]
    rows = []
    for k in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.4 else sentence() for _ in range(rng.randint(0, 8))]
        rows.append((k, rng.choice([" ", "\n"]).join(parts)))
    base = rows[5][1] + " ".join(vocabulary)
    rows += [(n + i, base) for i in range(4)]
    for i in range(12):  # near copies
        w = base.split()
        w[rng.randrange(len(w))] = f"edit{i}"
        rows.append((n + 10 + i, " ".join(w)))
    rows += [(n + 30, None), (n + 31, ""), (n + 32, " \t\n"), (n + 33, "ab " * 3000), (n + 34, "one"), (n + 35, "one"), (n + 36, "two words")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup_is_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK", 40 if seed == 1 else 10**6)
    rows = corpus(seed)
    got = {r.doc_id: (r.n_sentences, r.n_removed) for r in substring_dedup.substring_dedup(frame(spark, rows).repartition(3), run=2, min_words=6).collect()}
    assert got == brute.substring_dedup(rows, 2, 6)


def test_substring_dedup_keeps_the_first_and_all_columns(spark):
    rows = [(1, "Aa bb cc dd. Ee ff gg hh. Own one."), (2, "Other. Aa bb cc dd. Ee ff gg hh. End here.")]
    out = substring_dedup.substring_dedup(frame(spark, rows), run=2, min_words=6)
    assert set(out.columns) == {*SCHEMA.replace(" long", "").replace(" string", "").split(", "), "n_sentences", "n_removed"}
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts == {1: rows[0][1], 2: "Other. End here."}
    assert substring_dedup.substring_dedup(frame(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("seed", [11, 12])
def test_substring_dedup_finds_every_passage_of_50_words(spark, seed, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK", 200 if seed == 11 else 10**6)
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    text = lambda n, stop: " ".join(word() + (rng.choice(".!?\n") if rng.random() < stop else "") for _ in range(n))
    rows, planted = [], {}
    for k in range(40):  # no sentence begin inside, few of them, and short sentences
        passage = text(50, [0, 0.03, 0.3][k % 3])
        planted[100 + k] = passage.split()
        rows += [(k, f"{text(rng.randint(0, 80), 0.1)} {passage} {text(30, 0.1)}"), (100 + k, f"{text(rng.randint(0, 80), 0.1)} {passage.upper()} {text(30, 0.1)}")]
    rows += [(200, text(400, 0)), (201, "ab " * 300), (202, None)]
    clean = {k for k, _ in rows} - set(planted) - {201}
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(frame(spark, rows).repartition(3), passage=50).collect()}
    for k, text_in in rows:
        left, own = (got[k].text or "").split(), (text_in or "").split()
        if k in clean:
            assert left == own and got[k].n_removed == 0
        elif k in planted:
            assert got[k].n_removed > 0 and 50 - 4 * substring_dedup.WINDOW <= len(own) - len(left) <= 50
            at = next(i for i in range(len(own)) if own[i : i + 50] == [w.upper() for w in planted[k]])
            assert left[:at] == own[:at] and left[len(left) - (len(own) - at - 50) :] == own[at + 50 :]


@pytest.mark.parametrize("seed", [3, 4])
def test_suffix_dedup_is_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "FLUSH", 50 if seed == 3 else 10**6)
    rows, length = corpus(seed), 24
    found = suffix_dedup.SuffixDedup(frame(spark, rows).repartition(3), length=length, gram=8, span=8).removals().collect()
    got = {r.doc: (r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in found if r.n_removed}
    want = brute.suffix_dedup(rows, length)
    assert {k: got.get(k, (0, 0, v[2])) for k, v in want.items()} == want
    # n_repeated: every repeated string of gram + span - 1 bytes holds a trigger, and triggers lie in repeated strings of gram bytes
    some, most = (brute.suffix_dedup(rows, n) for n in (15, 8))
    repeated = {r.doc: r.n_repeated for r in found}
    assert all(k in repeated for k, v in some.items() if v[0]) and all(0 < n <= most[k][0] for k, n in repeated.items())


def test_suffix_dedup_of_periodic_text_and_empty_table(spark):
    rows = [(1, "ab" * 50), (2, "x" * 30), (3, "short")]
    got = {r.doc: (r.n_removed, r.n_spans) if r.n_removed else None for r in suffix_dedup.SuffixDedup(frame(spark, rows), length=24, gram=8, span=8).removals().collect()}
    want = brute.suffix_dedup(rows, 24)
    assert {k: v for k, v in got.items() if v} == {k: v[:2] for k, v in want.items() if v[0]}
    assert suffix_dedup.SuffixDedup(frame(spark, []), length=24, gram=8, span=8).removals().count() == 0


@pytest.mark.parametrize("filter_bytes", [0, 1 << 20])
def test_line_dedup_is_brute_force(spark, filter_bytes):
    rows = corpus(5)
    dedup = line_dedup.LineDedup(spark, min_docs=3, filter_bytes=filter_bytes).insert(frame(spark, rows))
    got = sorted((r.doc_id, int(r.n_lines), r.n_dropped, r.text) for r in dedup.apply(frame(spark, rows)).collect())
    assert got == sorted(brute.line_dedup(rows, 3))


def test_line_dedup_deletions_reverse_insertions(spark):
    rows, more = corpus(6), [(k + 1000, t) for k, t in corpus(7)]
    counts = lambda d: {(bytes(r.key), r.n_docs) for r in d.counts.collect()}
    once = line_dedup.LineDedup(spark, min_docs=3).insert(frame(spark, rows))
    back = line_dedup.LineDedup(spark, min_docs=3).insert(frame(spark, rows)).insert(frame(spark, more)).delete(frame(spark, more))
    assert counts(once) == counts(back)
    empty = line_dedup.LineDedup(spark).insert(frame(spark, rows)).delete(frame(spark, rows))
    assert empty.counts.count() == 0
    assert line_dedup.LineDedup(spark).insert(frame(spark, [])).apply(frame(spark, [])).count() == 0


def test_cuckoo_filter_inserts_probes_and_deletes():
    keys = [hashlib.md5(str(i).encode()).digest() for i in range(3000)]
    f = line_dedup.CuckooFilter.build(keys[:2000])
    assert f.probe(keys[:2000]).all()
    assert f.probe(keys[2000:]).mean() < 0.01
    assert all(f.delete(k) for k in keys[:1000])
    assert f.probe(keys[:1000]).mean() < 0.01 and f.probe(keys[1000:2000]).all()


@pytest.mark.parametrize("size, num, den", [(3, 90, 100), (5, 80, 100), (2, 50, 100)])
def test_jaccard_join_is_brute_force(spark, size, num, den, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 300)
    rows = corpus(8)
    got = {r.doc: (r.n_shingles, r.component) for r in jaccard_join.JaccardJoin(frame(spark, rows).repartition(3), size, num, den).groups().collect()}
    assert got == brute.jaccard_components(rows, size, num, den)


@pytest.mark.parametrize("n2, k2, slack", [(2, 1, 0.0), (4, 2, 0.1), (3, 0, 0.0)])
def test_part_enum_schemes_lose_no_link(spark, n2, k2, slack):
    rows = corpus(9, 30)
    scheme = jaccard_join.PartEnum(70, 100, n2, k2, slack)
    got = {r.doc: (r.n_shingles, r.component) for r in jaccard_join.JaccardJoin(frame(spark, rows), 2, 70, 100, scheme=scheme).groups().collect()}
    assert got == brute.jaccard_components(rows, 2, 70, 100)


def test_jaccard_join_of_an_empty_table(spark):
    assert jaccard_join.JaccardJoin(frame(spark, [])).groups().count() == 0


def test_components_are_the_least_reachable_nodes(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(i, i + 1) for i in range(300, 340)]
    up = {k: k for e in edges for k in e}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for u, v in edges:
        a, b = find(u), find(v)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: find(k) for e in edges if e[0] != e[1] for k in e}


def test_components_of_many_blocks_and_few_jobs(spark, monkeypatch):
    rng = random.Random(4)
    # ends of the 64-bit range, a long path with mixed names, self loops and repeated edges
    names = [rng.randrange(-(2**63), 2**63) for _ in range(150)]
    edges = [*zip(names, names[1:]), (2**63 - 1, -(2**63)), (5, 5), (7, 8), (7, 8)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    up = {k: k for e in edges for k in e}
    for _ in up:
        for u, v in edges:
            up[u] = up[v] = min(up[u], up[v])
    want = {k: up[k] for e in edges if e[0] != e[1] for k in e}
    for most in (llm_components.EDGES_PER_TASK, 20):
        monkeypatch.setattr(llm_components, "EDGES_PER_TASK", most)
        spark.sparkContext.setJobGroup(f"components-{most}", "")
        got = components(spark.createDataFrame(edges, "u long, v long").repartition(3))
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(f"components-{most}")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        rows = [(r.node, r.root) for r in got.collect()]
        assert len(rows) == len(want) and dict(rows) == want
        assert len(jobs) <= 8 or most == 20
    assert components(spark.createDataFrame([(3, 3)], "u long, v long")).count() == 0


def test_quality_rules_match_sql(spark):
    assert_same(spark, quality_rules.op5_quality_rules, quality_rules.SQL)


def test_quality_rules_edge_cases(spark):
    good = "The word of the day is here and it is fine to read as well. " * 5
    text = " ".join(w + str(i) for i, w in enumerate(good.split()))
    rows = [(1, None), (2, ""), (3, "a a a a"), (4, "x\n x\nx\n\n"), (5, text), (5, text), (6, "word " * 100)]
    out = quality_rules.quality_rules(frame(spark, rows)).select("doc_id", "n_words", "n_repeat_words", "n_dup_lines", "base_failed", "kept")
    got = sorted(tuple(r) for r in out.collect())
    assert got[:4] == [(1, 0, 0, 0, True, False), (2, 0, 0, 0, True, False), (3, 4, 4, 0, True, False), (4, 3, 0, 1, True, False)]
    assert got[4] == got[5] and got[4][4] is False
    assert got[6] == (6, 100, 100, 0, True, False)
    plan = quality_rules.quality_rules(frame(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert quality_rules.quality_rules(frame(spark, []).where(F.lit(False))).count() == 0


def test_line_dedup_query_matches_sql(spark):
    assert_same(spark, line_dedup.op6_line_dedup, line_dedup.SQL)


def test_texts_reach_python_in_small_batches(spark):
    """Batches of 10,000 rows of text cost an executor more memory than the pipeline may use."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, spark_bytes = spark.conf.get(key), "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        spark.conf.set(key, "10000")
        docs = spark.createDataFrame([(k, f"a b c d {k}") for k in range(3000)], "doc_id long, text string").coalesce(1)
        jaccard_join.JaccardJoin(docs)
        sizes = docs.mapInArrow(lambda batches: (pa.record_batch([pa.array([b.num_rows])], ["n"]) for b in batches), "n long").collect()
        assert max(r.n for r in sizes) <= 1000 and sum(r.n for r in sizes) == 3000
        spark.conf.set(key, "7")
        jaccard_join.JaccardJoin(docs)
        assert spark.conf.get(key) == "7" and spark.conf.get(spark_bytes)
    finally:
        spark.conf.set(key, before)
