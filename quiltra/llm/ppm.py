"""LM scoring by prediction by partial matching, next to an add-one word model.

The text of a document is its lower-cased (A-Z) words, each followed by one
space, and a closing zero byte.  Training counts all (K+1)-byte strings; they
are the deepest level of the context trie, and every shorter context's counts
are sums of them.  A byte's probability is read at the longest known context;
an unseen byte escapes (method D: half of distinct / total) to the next
shorter context, where the bytes seen above are excluded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text
from ._spark import crc_fold, table, tasks, written

U = np.uint64
ORDER = 5
HELD_OUT = (7, 2)
#: Bound of the strings that scoring tasks hold of a level; the scores of the other strings are joined, so it changes no score.
TRIE_STRINGS = 3_000_000
#: Bound of the word counts that scoring tasks hold; the other words' counts are joined.
KNOWN_WORDS = 800_000
FLUSH = 2_000_000


# -- one slice of text ----------------------------------------------------------


def stream(column: pa.Array, found: _text.Words) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all documents in a row (words, spaces, closing zeros), and each document's begin and end in them."""
    raw, _ = _text.value_buffer(column)
    n, size = len(column), found.end - found.start
    letters = np.concatenate([[0], np.cumsum(size)])
    ends = letters[found.first[1:]] + found.first[1:] + np.arange(1, n + 1)
    out = np.full(int(ends[-1]) if n else 0, 32, np.uint8)
    if len(size):
        at = np.repeat(np.arange(len(size)) + found.doc + letters[:-1] - found.start, size)
        inside = np.flatnonzero(~_text.IS_SPACE[raw])
        out[inside + at] = _text.LOWER[raw[inside]]
    out[ends - 1] = 0
    return out, np.concatenate([[0], ends])


def strings(data: np.ndarray, bounds: np.ndarray, order: int) -> np.ndarray:
    """The byte at each place with the `order` bytes before it, as one number; zeros stand before a document."""
    code = data.astype(np.uint64)
    place = np.arange(len(data)) - np.repeat(bounds[:-1], np.diff(bounds))
    for j in range(1, order + 1):
        before = np.zeros(len(data), np.uint64)
        before[j:] = data[:-j]
        before[place < j] = 0
        code |= before << U(8 * j)
    return code


# -- counting -------------------------------------------------------------------


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    own, begin = np.unique(keys, return_index=True)
    return own, (np.add.reduceat(n, begin) if len(own) else n)


class _Counter:
    """Counts of keys, merged whenever many have been added."""

    def __init__(self):
        self.keys, self.n, self.open = [], [], 0

    def add(self, keys: np.ndarray) -> None:
        own, n = np.unique(keys, return_counts=True)
        self.keys.append(own), self.n.append(n)
        self.open += len(own)
        if self.open > FLUSH and len(self.keys) > 8:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        own, n = _summed(np.concatenate(self.keys), np.concatenate(self.n))
        self.keys, self.n, self.open = [own], [n], 0
        return own, n


_BLOCKS = "kind int, part int, keys binary, n binary"


def _blocks(kind: int, keys: np.ndarray, n: np.ndarray, parts: int) -> pa.RecordBatch:
    part = (_text.mix(keys) >> U(24)) % U(parts)
    order = np.argsort(part.astype(np.uint32), kind="stable")
    keys, n, part = keys[order], n[order], part[order]
    own, begin = np.unique(part, return_index=True)
    end = [*begin[1:], len(part)]
    return pa.record_batch(
        [pa.array(np.full(len(own), kind, np.int32)), pa.array(own.astype(np.int32)), pa.array([keys[b:e].tobytes() for b, e in zip(begin, end)], pa.binary()), pa.array([n[b:e].tobytes() for b, e in zip(begin, end)], pa.binary())],
        ["kind", "part", "keys", "n"],
    )


def counts(train: DataFrame, order: int) -> DataFrame:
    """kind (0: byte strings, 1: word hashes), key, n over the column `text` of all rows, written once."""
    parts = 2 * tasks(train.sparkSession)

    def run(batches) -> Iterator[pa.RecordBatch]:
        trie, words = _Counter(), _Counter()
        for part in _text.slices(batches):
            found = _text.words(part.column(0))
            words.add(found.hash)
            trie.add(strings(*stream(part.column(0), found), order))
            if words.open > 2 * FLUSH:  # a task of very many different words sends them on early
                yield _blocks(1, *words.merge(), parts)
                words = _Counter()
            if trie.open > 2 * FLUSH:
                yield _blocks(0, *trie.merge(), parts)
                trie = _Counter()
        for kind, counter in ((0, trie), (1, words)):
            yield _blocks(kind, *counter.merge(), parts)

    def add(group: pa.Table) -> pa.Table:
        keys, n = (np.frombuffer(b"".join(group.column(c).to_pylist()), t) for c, t in (("keys", np.uint64), ("n", np.int64)))
        keys, n = _summed(keys, n)
        return pa.table({"kind": pa.array(np.full(len(keys), group.column("kind")[0].as_py(), np.int32)), "key": _text.as_long(keys), "n": pa.array(n)})

    blocks = train.select("text").mapInArrow(run, _BLOCKS)
    return written(blocks.groupBy("kind", "part").applyInArrow(add, "kind int, key long, n long"), "model-counts")


# -- the trie -------------------------------------------------------------------


class HashTable:
    """Open addressing over 64-bit keys in two arrays; find() gives places or -1."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(8, int(np.ceil(np.log2(max(1, len(keys)) * 1.5))))
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.index = np.full(1 << self.bits, -1, np.int32)
        slot, left = self.home(keys), np.arange(len(keys))
        while len(left):
            free = self.index[slot[left]] < 0
            at = left[free]
            _, first = np.unique(slot[at], return_index=True)
            put = at[first]
            self.index[slot[put]] = put
            self.keys[slot[put]] = keys[put]
            left = left[self.index[slot[left]] != left]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self.home(keys)
        out = self.index[slot]
        left = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            out[left] = self.index[slot[left]]
            left = left[(out[left] >= 0) & (self.keys[slot[left]] != keys[left])]
        return out


class Trie:
    """Context trie of order `order`, from counts of byte strings of every length up to order + 1."""

    def __init__(self, order: int, levels: list[tuple[np.ndarray, np.ndarray]]):
        """levels[k]: the strings of k context bytes and one more, with counts."""
        self.order, self.strings, self.n, self.contexts, self.total, self.distinct, self.above = order, [], [], [], [], [], []
        for k, (keys, n) in enumerate(levels):
            by = np.argsort(keys)
            keys, n = keys[by], n[by]
            context = keys >> U(8)
            own, begin = np.unique(context, return_index=True)
            self.strings.append(keys), self.n.append(n.astype(np.float64)), self.contexts.append(own)
            self.total.append(np.add.reduceat(n, begin).astype(np.float64) if len(own) else np.zeros(0))
            self.distinct.append(np.diff(np.append(begin, len(keys))).astype(np.float64))
            if k:  # how much of the shorter context's total the symbols of this one hold
                shorter = keys & U((1 << (8 * k)) - 1)
                held = self.n[k - 1][np.minimum(np.searchsorted(self.strings[k - 1], shorter), max(0, len(self.n[k - 1]) - 1))] if len(keys) else np.zeros(0)
                self.above.append(np.add.reduceat(held, begin) if len(own) else np.zeros(0))
            else:
                self.above.append(np.zeros(len(own)))
        self.table = None

    def _at(self, keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.full(len(wanted), -1)
        i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[i] == wanted, i, -1)

    def walk(self, code: np.ndarray, seen_total: np.ndarray | None = None, seen_distinct: np.ndarray | None = None) -> np.ndarray:
        """log10 probability of the last byte of each string in the context of the bytes before it; seen: what a context longer than all of this trie has."""
        out = np.zeros(len(code))
        left = np.arange(len(code))
        seen_total, seen_distinct = (np.zeros(len(code)) if x is None else x.copy() for x in (seen_total, seen_distinct))
        for k in range(self.order, -1, -1):
            own = code[left] & U((1 << (8 * (k + 1))) - 1)
            c = self._at(self.contexts[k], own >> U(8))
            known = c >= 0
            room = np.where(known, self.total[k][c] - seen_total[left], 0) if len(self.total[k]) else np.zeros(len(left))
            fresh = np.where(known, self.distinct[k][c] - seen_distinct[left], 0) if len(self.total[k]) else np.zeros(len(left))
            s = self._at(self.strings[k], own)
            hit = known & (s >= 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                out[left] += np.where(hit, np.log10((self.n[k][s] - 0.5) / room) if len(self.n[k]) else 0, np.where(known & (fresh > 0), np.log10(0.5 * fresh / room), 0))
            seen_total[left] = np.where(known, self.above[k][c], seen_total[left]) if len(self.above[k]) else seen_total[left]
            seen_distinct[left] = np.where(known, self.distinct[k][c], seen_distinct[left]) if len(self.distinct[k]) else seen_distinct[left]
            left = left[~hit]
            if not len(left):
                return out
        out[left] -= np.log10(np.maximum(256 - seen_distinct[left], 1))
        return out

    def log10(self, code: np.ndarray) -> np.ndarray:
        """walk(), with the deepest level's strings looked up in a table."""
        if self.table is None:
            self.table, self.direct = HashTable(self.strings[-1]), self.walk(self.strings[-1])
        at = self.table.find(code)
        out = self.direct[at] if len(self.direct) else np.zeros(len(code))
        miss = np.flatnonzero(at < 0)
        if len(miss):
            own, back = np.unique(code[miss], return_inverse=True)
            out[miss] = self.walk(own)[back]
        return out


def _lower(keys: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The strings of k context bytes and one more, from longer ones."""
    return _summed(keys & U((1 << (8 * (k + 1))) - 1), n)


def _ends(column, k: int, order: int):
    """The last k + 1 bytes of strings of order + 1 bytes."""
    return column.bitwiseAND(F.lit((1 << (8 * (k + 1))) - 1)) if k < order else column


@dataclass
class Model:
    """Context trie in two parts: `trie` holds the levels that are sent whole, `large` has the longer ones as written tables.

    large: (k, strings: key, n; contexts: context, total, distinct, above), deepest first.
    With large levels, hot and hot_logs are deepest strings of high count and their log10 probabilities.
    """

    trie: Trie
    large: list[tuple[int, DataFrame, DataFrame]]
    hot: np.ndarray
    hot_logs: np.ndarray


def _arrays(rows: DataFrame, kind) -> tuple[np.ndarray, np.ndarray]:
    rows = rows.toArrow()
    return rows.column(0).to_numpy().astype(np.int64).view(np.uint64), rows.column(1).to_numpy().astype(kind)


def model_of(found: DataFrame, order: int, most: int = TRIE_STRINGS) -> Model:
    """Each level's counts are sums of the deepest level's; levels up to `most` strings are collected, larger ones stay tables.

    Contexts of one byte and of none have 65,536 strings at most and are always collected.
    """
    level, large = found.where("kind = 0").select("key", "n"), []
    k = order
    while k > 1 and level.count() > most:
        shorter = written(level.groupBy(_ends(F.col("key"), k - 1, order).alias("key")).agg(F.sum("n").alias("n")), f"model-level-{k - 1}")
        held = level.withColumn("shorter", _ends(F.col("key"), k - 1, order)).join(shorter.select(F.col("key").alias("shorter"), F.col("n").alias("held")), "shorter")
        contexts = held.groupBy(F.shiftrightunsigned("key", 8).alias("context")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct"), F.sum("held").alias("above"))
        large.append((k, level, written(contexts, f"model-contexts-{k}")))
        level, k = shorter, k - 1
    levels = [_arrays(level, np.int64)]
    for j in range(k - 1, -1, -1):
        levels.insert(0, _lower(*levels[0], j))
    hot, hot_logs = np.zeros(0, np.uint64), np.zeros(0)
    if large:
        _, deepest, contexts = large[0]
        size = F.floor(F.log2("n") * 4)
        spread = deepest.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("strings")).orderBy(F.desc("size")).collect()  # a few hundred rows
        held, least = 0, None
        for row in spread:
            if held + row["strings"] > most:
                break
            held, least = held + row["strings"], row["size"]
        if least is not None:
            scores = deepest.where(size >= least).withColumn("context", F.shiftrightunsigned("key", 8)).join(contexts, "context")
            hot, hot_logs = _arrays(scores.select("key", F.log10((F.col("n") - 0.5) / F.col("total")).alias("log")), np.float64)
    return Model(Trie(k, levels), large, hot, hot_logs)


def far_scores(wanted: DataFrame, model: Model, order: int) -> DataFrame:
    """key, score of the strings in wanted.key, each once: large levels by joins of strings and contexts, then Trie.walk()."""
    zero = F.lit(0.0)
    left = wanted.select("key").distinct().select("key", zero.alias("score"), zero.alias("seen_total"), zero.alias("seen_distinct"))
    done = []
    for k, level, contexts in model.large:
        own = left.withColumns({"own": _ends(F.col("key"), k, order), "context": F.shiftrightunsigned(_ends(F.col("key"), k, order), 8)})
        own = own.join(contexts, "context", "left").join(level.select(F.col("key").alias("own"), "n"), "own", "left")
        room, fresh = F.col("total") - F.col("seen_total"), F.col("distinct") - F.col("seen_distinct")
        state = own.select(
            "key",
            F.col("n").isNotNull().alias("hit"),
            (F.col("score") + F.when(F.col("n").isNotNull(), F.log10((F.col("n") - 0.5) / room)).when(fresh > 0, F.log10(0.5 * fresh / room)).otherwise(zero)).alias("score"),
            F.coalesce(F.col("above").cast("double"), "seen_total").alias("seen_total"),
            F.coalesce(F.col("distinct").cast("double"), "seen_distinct").alias("seen_distinct"),
        )
        state = written(state, f"far-level-{k}")
        done.append(state.where("hit").select("key", "score"))
        left = state.where("not hit").drop("hit")
    sent = wanted.sparkSession.sparkContext.broadcast(model.trie)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, score, total, distinct = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            yield pa.record_batch([pa.array(keys), pa.array(score + sent.value.walk(keys.astype(np.int64).view(np.uint64), total, distinct))], ["key", "score"])

    out = left.mapInArrow(run, "key long, score double")
    for part in done:
        out = out.unionByName(part)
    return out


class _Far:
    """Keys that a task has no value for, and the rows they stand in."""

    def __init__(self):
        self.keys, self.rows, self.n = [], [], 0

    def add(self, keys: np.ndarray, rows: np.ndarray) -> None:
        if len(keys):
            self.keys.append(keys), self.rows.append(rows)
            self.n += len(keys)

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        out = np.concatenate(self.keys), np.concatenate(self.rows)
        self.__init__()
        return out


# -- scoring --------------------------------------------------------------------


def score_documents(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", order: int = ORDER, known_words: int = KNOWN_WORDS, trie_strings: int = TRIE_STRINGS) -> DataFrame:
    """doc_col, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per row of docs.

    A null text counts as empty: only the end is scored.  Without training rows
    all counts are zero and every byte has probability 1/256.  Repeated rows
    count each.  Words are told apart by a 64-bit hash.
    """
    spark, kind = docs.sparkSession, docs.schema[doc_col].dataType.simpleString()
    rows = docs.select(F.col(doc_col).alias("doc"), (crc_fold(F.col(doc_col), HELD_OUT[0]) == HELD_OUT[1]).alias("held_out"), F.col(text_col).alias("text"))
    train = rows.where(~F.col("held_out"))
    found = counts(train, order)
    words = found.where("kind = 1").select("key", "n")
    n_docs = train.count()
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total, distinct = total + n_docs, distinct + (n_docs > 0)
    model = model_of(found, order, trie_strings)
    whole = not model.large
    spread = words.groupBy(F.floor(F.log2("n") * 8).alias("size")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("size")).collect()  # a few hundred rows
    held, least = 0, None
    for row in spread:
        if held + row["words"] > known_words:
            break
        held, least = held + row["words"], row["size"]
    size = F.floor(F.log2("n") * 8)
    common = words.where(size >= least) if least is not None else words.where("false")
    common = common.toArrow()
    sent = spark.sparkContext.broadcast((model.trie if whole else None, model.hot, model.hot_logs, common.column("key").to_numpy().astype(np.int64).view(np.uint64), common.column("n").to_numpy().astype(np.int64)))
    parts, end_log = 2 * tasks(spark), float(np.log10(n_docs + 1))

    def run(batches) -> Iterator[pa.RecordBatch]:
        trie, hot, hot_logs, keys, n = sent.value
        hot = None if whole else HashTable(hot)
        known, logs = HashTable(keys), np.log10(n + 1.0)
        base, at = TaskContext.get().partitionId() << 33, 0
        far = {0: _Far(), 1: _Far()}  # strings, words
        none = lambda m, t: pa.nulls(m, t)

        def flush(kind):
            own = _blocks(kind, *far[kind].taken(), parts)
            m = own.num_rows
            return pa.RecordBatch.from_arrays([none(m, fields[0]), none(m, pa.bool_()), none(m, pa.int64()), none(m, pa.int64()), none(m, pa.int64()), none(m, pa.float64()), none(m, pa.float64()), *own.columns], names)

        fields = None
        for part in _text.slices(batches):
            fields = fields or [part.schema.field(0).type]
            text, m = part.column(2), part.num_rows
            found = _text.words(text)
            data, bounds = stream(text, found)
            code = strings(data, bounds, order)
            if whole:
                each = trie.log10(code)
            else:
                at_hot = hot.find(code)
                each, miss = np.where(at_hot >= 0, hot_logs[at_hot], 0.0) if len(hot_logs) else np.zeros(len(code)), np.flatnonzero(at_hot < 0)
            sums = np.concatenate([[0.0], np.cumsum(each)])
            score = sums[bounds[1:]] - sums[bounds[:-1]]
            place = known.find(found.hash)
            hit = place >= 0
            base_log = np.bincount(found.doc[hit], logs[place[hit]], m)
            n_known = np.bincount(found.doc[hit], minlength=m)
            ids = base + at + np.arange(m)
            at += m
            far[1].add(found.hash[~hit], ids[found.doc[~hit]])
            if not whole:
                far[0].add(code[miss], np.repeat(ids, np.diff(bounds))[miss])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(ids), pa.array(np.diff(found.first) + 1), pa.array(n_known + (end_log > 0)), pa.array(base_log + end_log), pa.array(score), none(m, pa.int32()), none(m, pa.int32()), none(m, pa.binary()), none(m, pa.binary())], names
            )
            for kind in far:
                if far[kind].n >= FLUSH:
                    yield flush(kind)
        for kind in far:
            if far[kind].n:
                yield flush(kind)

    names = ["doc", "held_out", "row", "n_tokens", "n_known", "base_log", "score", "kind", "part", "keys", "n"]
    scored = written(rows.mapInArrow(run, f"doc {kind}, held_out boolean, row long, n_tokens long, n_known long, base_log double, score double, kind int, part int, keys binary, n binary"), "scored")

    # the rarer words and strings: each part of the hash space meets its own values
    def pack(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _blocks(1, batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64), parts)

    def unpack(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys in batch.column(0):
                yield pa.record_batch([pa.array(np.unique(np.frombuffer(keys.as_py(), np.int64)))], ["key"])

    def sides(kind: int, values: DataFrame) -> DataFrame:
        """Far keys of a kind with their rows, and the logarithm of each key."""
        return scored.where(F.col("kind") == kind).select(F.lit(0).alias("kind"), "part", "keys", "n").unionByName(values.mapInArrow(pack, _BLOCKS))

    def meet(group: pa.Table) -> pa.Table:
        side = np.array(group.column("kind").to_pylist())
        keys, n = (np.array(group.column(c).to_pylist(), object) for c in ("keys", "n"))
        join = lambda which, t, c: np.frombuffer(b"".join(c[side == which]), t)
        mine, rows = join(0, np.uint64, keys), join(0, np.int64, n)
        theirs, log = join(1, np.uint64, keys), join(1, np.float64, n)
        if not len(mine) or not len(theirs):
            return pa.table({"row": pa.array([], pa.int64()), "log": pa.array([], pa.float64()), "known": pa.array([], pa.int64())})
        by = np.argsort(theirs)
        theirs, log = theirs[by], log[by]
        at = np.minimum(np.searchsorted(theirs, mine), len(theirs) - 1)
        hit = theirs[at] == mine
        own, back, known = np.unique(rows[hit], return_inverse=True, return_counts=True)
        return pa.table({"row": pa.array(own), "log": pa.array(np.bincount(back, log[at[hit]], len(own))), "known": pa.array(known.astype(np.int64))})

    def summed(kind: int, values: DataFrame) -> DataFrame:
        return sides(kind, values).groupBy("part").applyInArrow(meet, "row long, log double, known long").groupBy("row").agg(F.sum("log").alias("log"), F.sum("known").alias("known"))

    rare = summed(1, (words.where(size < least) if least is not None else words).select("key", F.log10(F.col("n") + 1.0).alias("log")))
    base = scored.where("kind is null").drop("kind", "part", "keys", "n").join(rare, "row", "left")
    if not whole:
        wanted = scored.where("kind = 0").select("keys").mapInArrow(unpack, "key long")
        base = base.join(summed(0, far_scores(wanted, model, order)).select("row", F.col("log").alias("far_score")), "row", "left")
    unit = float(np.log10(total + distinct + 1))
    return base.select(
        F.col("doc").alias(doc_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base_log") + F.coalesce("log", F.lit(0.0)) - F.col("n_tokens") * F.lit(unit)).alias("base_score"),
        "score" if whole else (F.col("score") + F.coalesce("far_score", F.lit(0.0))).alias("score"),
    )


def op7_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
