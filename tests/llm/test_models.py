import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quiltra.llm import _text, decontamination, packing, ppm, quality_classifier, token_rollup

from ..oracle import DATA, run_sql
from . import brute

SCHEMA = "doc_id long, text string, score string, source string, lang string, quality int"


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "s", f"src{k % 2}" if k is not None else None, "en", 7) for k, t in rows], SCHEMA)


def texts(seed, n=50):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6))) for _ in range(80)]
    rows = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for k in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "\t\n "), (n + 3, "Long " * 5000), (n + 4, "A\x1cb \x85 c <|ENDOFTEXT|> x"), (n + 4, "A\x1cb \x85 c <|ENDOFTEXT|> x")]


def test_words_and_shingles():
    column = pa.array(["Ab  cd\tef", None, "", "x", "ab CD ef gh"])
    w = _text.words(column)
    assert w.doc.tolist() == [0, 0, 0, 3, 4, 4, 4, 4]
    assert w.hash[:3].tolist() == w.hash[4:7].tolist() and len(set(w.hash.tolist())) == 5
    h, rows = _text.shingles(w, 3)
    assert rows.tolist() == [0, 3, 4, 4] and h[0] == h[2]


@pytest.mark.parametrize("known_words", [0, 10, 10**6])
def test_base_scores_and_ppm_are_brute_force(spark, known_words):
    rows = texts(1)
    got = ppm.score_documents(frame(spark, rows).repartition(3), order=3, known_words=known_words).collect()
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in rows}
    tokens = [(k, [*brute.words(t), None]) for k, t in rows]
    count = collections.Counter(w for k, ws in tokens if not held[k] for w in ws)
    total, distinct = sum(count.values()), len(count)
    stream = lambda ws: b"".join(w + b" " for w in ws[:-1]) + b"\0"
    code = brute.ppm([stream(ws) for k, ws in tokens if not held[k]], [stream(ws) for _, ws in tokens], 3)
    want = sorted((k, held[k], len(ws), sum(count[w] > 0 for w in ws), total, sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in ws), s) for (k, ws), s in zip(tokens, code))
    got = sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("order, trie_strings", [(3, 0), (3, 400), (5, 0), (5, 700)])
def test_ppm_scores_strings_that_tasks_do_not_hold(spark, order, trie_strings):
    rows = texts(3) + [(k, "zq xk " * k) for k in range(60, 80)]
    got = {r.doc_id: r.score for r in ppm.score_documents(frame(spark, rows).repartition(3), order=order, trie_strings=trie_strings).collect()}
    stream = lambda t: b"".join(w + b" " for w in brute.words(t)) + b"\0"
    want = brute.ppm([stream(t) for k, t in rows if zlib.crc32(str(k).encode()) % 7 != 2], [stream(t) for _, t in rows], order)
    assert np.allclose([got[k] for k, _ in rows], want, rtol=1e-9, atol=1e-9)


def test_ppm_of_empty_tables_and_no_training_rows(spark):
    assert ppm.score_documents(frame(spark, []), order=2).count() == 0
    k = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = ppm.score_documents(frame(spark, [(k, "ab")]), order=2).first()
    assert (row.n_known, row.train_tokens) == (0, 0)
    assert math.isclose(row.score, -4 * math.log10(256))


def test_pieces_are_the_tokenizers_ids(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.tokenizer_path())
    rows = texts(2) + [(900, "don't stop!!, 'tis (well) A1b2 ###x### naïve ÉTÉ 'quoted'...")]
    out = packing.best_fit_packing(frame(spark, rows).repartition(3), capacity=64, buckets=4).collect()
    by = collections.defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
    for k, t in rows:
        ids = [*model.encode(t or "", add_special_tokens=False).ids, packing.END_ID]
        own = sorted(by[k], key=lambda r: r.piece)
        copies = sum(1 for q, _ in rows if q == k)
        assert sum(r.length for r in own) == copies * len(ids)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    sequences = collections.defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64


def test_plan_places_every_piece_once_and_is_as_good_as_best_fit_decreasing():
    rng = random.Random(4)
    for _ in range(30):
        capacity = rng.choice([10, 37, 100])
        histogram = collections.Counter(rng.randint(1, capacity) for _ in range(rng.randint(1, 300)))
        rows = packing.plan(dict(histogram), capacity)
        ranks = collections.defaultdict(set)
        fill = collections.Counter()
        for length, rank, count, first, offset in rows:
            for i in range(count):
                assert rank + i not in ranks[length]
                ranks[length].add(rank + i)
                fill[first + i] += length
                assert offset + length <= capacity
        assert {k: len(v) for k, v in ranks.items()} == dict(histogram)
        assert max(fill.values()) <= capacity
        bins: list[int] = []
        for length in sorted(histogram.elements(), reverse=True):
            fits = [b for b in bins if b >= length]
            if fits:
                bins.remove(min(fits))
                bins.append(min(fits) - length)
            else:
                bins.append(capacity - length)
        assert len(fill) <= len(bins) + 1


def test_packing_of_an_empty_table(spark):
    assert packing.best_fit_packing(frame(spark, [])).count() == 0


def test_classifier_separates_held_out_rows(spark):
    docs = spark.read.parquet(f"{DATA.replace('sf0.001', 'sf0.01')}/documents.parquet")
    labels = spark.read.parquet(f"{DATA.replace('sf0.001', 'sf0.01')}/labels.parquet")
    model = quality_classifier.QualityClassifier().fit(docs, labels)
    got = model.score(docs).join(labels, "doc_id").where(quality_classifier.crc_fold(F.col("doc_id"), 4) == 2).select("score", "quality").collect()
    assert np.mean([(r.score >= 0.7) == (r.quality == 1) for r in got]) > 0.95
    # calibrated: in each third of the scores the mean score is near the share of label 1
    for part in np.array_split(sorted((r.score, r.quality) for r in got), 3):
        assert abs(part[:, 0].mean() - part[:, 1].mean()) < 0.12
    assert all(0 <= r.score <= 1 for r in got)


@pytest.mark.parametrize("sharp, low, high", [(0.3, 0.25, 0.6), (4.0, 2.0, 8.0)])
def test_temperature_sharpens_and_softens(sharp, low, high):
    """Labels drawn from known logits: the fitted temperature undoes a scale in either direction."""
    rng = np.random.default_rng(1)
    logits = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-logits))).astype(float)
    assert low <= quality_classifier.fitted_temperature(logits * sharp, y) <= high


def test_classifier_is_the_method_step_by_step(spark):
    """Scores of a small table against plain Python: context vectors, pooled means, the fitted network."""
    rows = [(k, " ".join(f"w{(k * 7 + j * j) % 23}{'#' * (j % 3)}" for j in range(5 + k % 9))) for k in range(40)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id long, quality int")
    model = quality_classifier.QualityClassifier().fit(docs, labels)
    index = quality_classifier.index_vectors(quality_classifier.BUCKETS, quality_classifier.DIM, 11)
    bucket = lambda w: int(_text.words(pa.array([w])).hash[0] >> np.uint64(40)) % quality_classifier.BUCKETS
    context = collections.defaultdict(lambda: np.zeros(quality_classifier.DIM))
    for k, t in rows:
        if zlib.crc32(str(k).encode()) % 4 != 2:
            own = [bucket(w) for w in t.split()]
            for i, b in enumerate(own):
                for j in (i - 2, i - 1, i + 1, i + 2):
                    if 0 <= j < len(own):
                        context[b] += index[own[j]]
    scores = {r.doc_id: r.score for r in model.score(docs.drop("score")).collect()}
    for k, t in rows:
        vectors = []
        for w in t.split():
            v = context[bucket(w)]
            vectors.append(v / max(np.linalg.norm(v), 1e-9) + 0.5 * index[bucket(w)])
        x = quality_classifier.pooled(pa.array([t]), model.vectors, model.shapes)[0]
        assert np.allclose(x[: quality_classifier.DIM], np.mean(vectors, axis=0), atol=1e-4)
        n = model.network
        logit = np.tanh((x - n.mean) / n.scale @ n.w1 + n.b1) @ n.w2 + n.b2
        assert math.isclose(scores[k], 1 / (1 + math.exp(-logit / n.temperature)), rel_tol=1e-6)


def test_classifier_without_labels_nulls_and_clashing_columns(spark):
    docs = frame(spark, [(1, None), (2, ""), (3, "some words")])
    model = quality_classifier.QualityClassifier().fit(docs, docs.select("doc_id", "quality"))
    out = model.score(docs)
    assert [r.score for r in out.collect()] == [0.5] * 3 and sorted(out.columns) == sorted(docs.columns)
    assert model.score(docs.limit(0)).count() == 0


def test_decontamination_finds_leaks_and_paraphrases(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(3000)] + ["the"] * 300 + ["of"] * 300
    line = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = {i: line(rng.randint(15, 60)) for i in range(30)}
    rows, truth = [], set()
    for k in range(300):
        w = line(rng.randint(0, 300))
        if k % 10 == 0:
            i = rng.randrange(30)
            own = [x if k % 20 or rng.random() > 0.15 else rng.choice(vocabulary) for x in items[i]]
            at = rng.randint(0, len(w))
            w = w[:at] + own + w[at:]
            truth.add((k, i))
        rows.append((k, " ".join(w).capitalize()))
    rows += [(1000, None), (1001, "")]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(98, None), (99, "")], "item_id long, text string")
    docs = frame(spark, rows).repartition(3)
    found = decontamination.Decontamination().fit(docs, bench).matches(docs)
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert len(got & truth) >= 0.9 * len(truth) and {p for p in truth if p[0] % 20} <= got
    assert not got - truth
    none = decontamination.Decontamination().fit(docs, bench.limit(0)).matches(docs)
    assert none.count() == 0 and none.columns == found.columns
    assert decontamination.Decontamination().fit(docs.limit(0), bench).matches(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [65, 130, 1000])
def test_decontamination_finds_a_verbatim_item_of_many_words(spark, n):
    rng = random.Random(n)
    vocabulary = [f"w{i}" for i in range(2000)]  # of which rank 2000 drops no direction
    items = {i: rng.sample(vocabulary, n) for i in range(3)} | {i: rng.sample(vocabulary, 30) for i in range(3, 300)}
    rows = [(k, " ".join(rng.choices(vocabulary, k=300))) for k in range(100)]
    rows += [(200 + i, " ".join(rng.choices(vocabulary, k=45 + i) + items[i] + rng.choices(vocabulary, k=70))) for i in range(4)]
    rows += [(300, " ".join(items[0][: n // 2]))]  # half an item isn't one
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    docs = frame(spark, rows).repartition(3)
    found = decontamination.Decontamination(rank=2000).fit(docs, bench).matches(docs).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(200 + i, i) for i in range(4)}
    assert all(r.lcs == 1 and r.answer == 1 for r in found)


def test_lcs():
    rng = random.Random(5)
    for _ in range(50):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(0, 20))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        assert decontamination.lcs(a, b) == row[-1]


def test_rollup_is_idempotent_and_reversible(spark, tmp_path):
    rows = [(1, "one two three"), (2, "one two"), (3, None), (4, "four")]
    counts = token_rollup.document_counts(frame(spark, rows)).cache()
    rollup = token_rollup.TokenRollup(spark, f"file://{tmp_path}/rollup")
    assert rollup.totals().count() == 0
    assert rollup.insert("a", counts) and not rollup.insert("a", counts)
    total = lambda: {r.source: (r.n_docs, r.n_tokens, r.n_chars) for r in rollup.totals().where("tokenizer = 'word_bpe_49k'").collect()}
    assert total() == {"src0": (2, 3, 11), "src1": (2, 3, 13)}
    assert rollup.delete("b", counts.where("doc = 2"))
    assert total() == {"src0": (1, 1, 4), "src1": (2, 3, 13)}
    new = token_rollup.document_counts(frame(spark, [(1, "one two three four")]))
    assert rollup.revise("c", counts.where("doc = 1"), new)
    assert total() == {"src0": (1, 1, 4), "src1": (2, 4, 18)}
    assert rollup.compact()
    assert total() == {"src0": (1, 1, 4), "src1": (2, 4, 18)}
    assert not rollup.insert("a", counts)
    assert rollup.delete("d", counts.where("doc <> 1 and doc <> 2").unionByName(new))
    assert total() == {"src0": (0, 0, 0)} or total() == {}


def test_rank_counter_counts_whole_texts():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.tokenizer_path("byte_bpe_50k.json"))
    model.encode_special_tokens = True
    some = [t or "" for _, t in texts(9)] + ["  two  spaces\n\nand é123's <|endoftext|>"]
    counter = token_rollup.RankCounter(packing.tokenizer_path("byte_bpe_50k.tiktoken"))
    assert counter.counts(some) == [len(e.ids) for e in model.encode_batch(some, add_special_tokens=False)]


def test_compaction_that_is_lost_half_way_changes_nothing(spark, tmp_path):
    rows = [(1, "one two three"), (2, "one two")]
    counts = token_rollup.document_counts(frame(spark, rows)).cache()
    rollup = token_rollup.TokenRollup(spark, f"file://{tmp_path}/rollup")
    rollup.insert("a", counts)
    rollup.insert("b", counts)
    total = lambda: sorted((r.source, r.tokenizer, r.n_docs, r.n_tokens) for r in rollup.totals().collect())
    want, publish = total(), rollup._publish
    rollup._publish = lambda record, content: False  # the sums are written, their record isn't
    assert not rollup.compact() and total() == want
    rollup._publish = publish
    assert rollup.compact() and total() == want
    assert not rollup.insert("b", counts) and rollup.insert("c", counts)
    assert rollup.compact() and total() == [(s, k, 3 * n // 2, 3 * m // 2) for s, k, n, m in want]
    for bad in ("", ".a", "_a", "a/b"):
        with pytest.raises(ValueError):
            rollup.insert(bad, counts)


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = run_sql("SELECT doc_id, quality FROM labels").set_index("doc_id").quality
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns
        path = f"{spark.conf.get('spark.checkpoint.dir')}/stage-{name}"
        out.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(before)
        if name == "quality_classifier":
            assert all(labels.get(k, 0) == 0 or k not in labels.index for k in set(before) - set(after) if k in labels.index)
        elif name == "line_dedup":
            want = {k: t for k, _, _, t in brute.line_dedup(list(before.items()), 10)}
            assert after == want
        elif name == "jaccard_join":
            groups = brute.jaccard_components(list(before.items()), 5, 80, 100)
            assert set(after) == {k for k, (_, least) in groups.items() if k == least}
        else:
            items = [brute.words(t) for t in run_sql("SELECT text FROM benchmark").text]
            holds = {k for k, t in before.items() for w in [brute.words(t)] if any(w[i : i + len(x)] == x for x in items for i in range(len(w) - len(x) + 1))}
            assert not holds & set(after)
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert {r.doc_id for r in packed} == set(before)


def test_word_store_gives_the_tokenizers_ids_and_keeps_frequent_words():
    import random

    from tokenizers import Tokenizer

    model, rng = Tokenizer.from_file(packing.tokenizer_path()), random.Random(5)
    signs = ["a", "b", "s", "t", "é", "E", "İ", "ß", "ñ", "中", "²", "٣", "7", "_", "'", ".", ",", "!", "…", "«", "́", "̸", "ａ", "ǆ", "<", "|", ">", " ", " ", " ", "\n", " ", "\x85"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(40))) for _ in range(1500)]
    store = packing.WordTokenizer(packing.tokenizer_path(), 50)
    got = [np.frombuffer(x, "<u4").tolist() for at in range(0, 1500, 60) for x in store.ids(texts[at : at + 60])]
    assert got == [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]
    store, learnt = packing.WordTokenizer(packing.tokenizer_path(), 50), []
    learn = store.learn
    store.learn = lambda new: (learnt.extend(new), learn(new))
    for k in range(20):  # the store is full again and again
        store.ids(["often, " + " ".join(f"w{chr(97 + k)}{chr(97 + j)}" for j in range(26)) + " often."])
    assert learnt.count("often") == 1 and "often." not in learnt and len(store.known) + len(store.before) < 160
