"""Best-fit packing planned on the length histogram.

1. Documents are tokenised and cut into pieces of at most `capacity` tokens;
   the pieces (without the ids) are written to the shared folder.
2. The histogram of piece lengths has at most `capacity` rows, whatever the
   corpus; the driver runs best-fit decreasing over counts, so a step places
   all equal pieces that fit equally well at once.
3. A piece takes the planned slot with its rank within its length.  Ranks are
   counted in two steps, within (length, bucket) and over the buckets, so no
   task gets all pieces of a frequent length.
"""

from __future__ import annotations

import bisect
import os
import re
import string
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import table, written
from ._text import slices

CAPACITY = 4096
END_ID = 1
#: Deals of one length; a length that a third of all pieces share goes to so many groups.
BUCKETS = 1024
#: Words of one generation whose ids a worker keeps; it holds two.
CACHE_WORDS = 200_000
#: White space of str.split() that the tokenizer's own white-space rule may read otherwise,
#: and the mark of special tokens, which lower-casing must not make.
ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "\x85", "<|")

#: ASCII marks, which the tokenizer splits from letters before them.
MARKS = string.punctuation
#: Such marks at a word's end, after a letter; that of the Turkish capital I is a mark itself once it is lower-cased.
AT_END = re.compile(rf"[{re.escape(MARKS)}](?<=[^\W\d_İ].)[{re.escape(MARKS)}]*+(?!\S)")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    """Ids of whole texts as little-endian 32-bit bytes.

    For a tokenizer that lower-cases, drops white space and never joins across
    it, a text's ids are those of its white-space separated words one after the
    other, and marks after a word's last letter are words of their own.  A worker
    keeps the ids of words for its life, in two generations: a word that is met
    again moves to the younger one, and the older one goes when that is full, so
    frequent words are encoded once.  New words without other characters than
    letters are encoded many at a time: the word-end mark of the vocabulary says
    where each one's ids end.
    """

    kept: dict[str, "WordTokenizer"] = {}

    def __init__(self, path: str, keep: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model, self.keep, self.known, self.before = Tokenizer.from_file(path), keep, {}, {}
        vocabulary = self.model.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    @classmethod
    def of(cls, path: str) -> "WordTokenizer":
        """The worker's own one for this file."""
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def learn(self, new: set[str]) -> None:
        known, plain, other = self.known, [], []
        for w in new:
            (plain if w.isalpha() else other).append(w)
        for i in range(0, len(plain), 200):
            some = plain[i : i + 200]
            ids = np.array(self.model.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(some):  # letters that the tokenizer's own tables don't know as such
                other += some
                continue
            raw, ends = ids.tobytes(), (4 * ends).tolist()
            known.update(zip(some, [raw[b:e] for b, e in zip([0, *ends], ends)]))
        for i in range(0, len(other), 2000):
            some = other[i : i + 2000]
            known.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(some, self.model.encode_batch_fast(some, add_special_tokens=False)))

    def ids(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.keep:
            self.known, self.before = {}, self.known
        known, get, before, found, new = self.known, self.known.get, self.before, [], set()
        for t in texts:
            if any(c in t for c in ODD):
                found.append((None, np.array(self.model.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), ()))
                continue
            # A-Z are lower-cased by the tokenizer anyway; doing it here makes fewer different words
            words = AT_END.sub(r" \g<0>", t.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")).split()
            own = list(map(get, words))
            open_ = []
            for i in [i for i, x in enumerate(own) if x is None]:
                w = words[i]
                x = before.get(w)
                if x is None:
                    new.add(w)
                    open_.append(i)
                else:
                    own[i] = known[w] = x
            found.append((words, own, open_))
        self.learn(new)
        out = []
        for words, own, open_ in found:
            for i in open_:
                own[i] = known[words[i]]
            out.append(own if words is None else b"".join(own))
        return out


def pieces(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc, piece, start, length, ids_crc32: every document's ids and `end_id`, cut at multiples of `capacity`."""
    path = tokenizer or tokenizer_path()

    def run(batches) -> Iterator[pa.RecordBatch]:
        model, end = WordTokenizer.of(path), np.array([end_id], "<u4").tobytes()
        for part in slices(batches, "text"):
            at, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(model.ids([t or "" for t in part.column(1).to_pylist()])):
                ids += end
                for k, s in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[s : s + 4 * capacity]
                    at.append(i), piece.append(k), start.append(s // 4), length.append(len(own) // 4), crc.append(zlib.crc32(own))
            yield pa.record_batch([part.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[doc_col].dataType.simpleString()
    return docs.select(F.col(doc_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, f"doc {kind}, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, count, first sequence, offset) runs.

    A group is `count` sequences with equal fill, numbered in a row.  Pieces of
    one length fill the group with the least sufficient room; a group larger
    than what is left of the length splits.
    """
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens -> [(first sequence, count)]
    order: list[int] = []  # the free sizes that have groups, ascending
    out, sequences = [], 0

    def put(free: int, group: tuple[int, int]) -> None:
        if free:
            if not room[free]:
                bisect.insort(order, free)
            room[free].append(group)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            i = bisect.bisect_left(order, length)
            if i < len(order):
                free = order[i]
                first, count = room[free].pop()
                if not room[free]:
                    order.pop(i)
            else:
                # each of `count` new sequences takes as many pieces of this length as fit
                free, first, count = capacity, sequences, -(-left // (capacity // length))
                sequences += count
            took = min(left, count)
            if took < count:
                put(free, (first + took, count - took))
            out.append((length, rank, took, first, capacity - free))
            put(free - length, (first, took))
            left, rank = left - took, rank + took
    return out


def ranked(cut: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Add `rank` (from 0, gapless) within each length."""
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    own = cut.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc", "piece", "start", "ids_crc32")).cast("long") - 1)
    sizes = cut.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return own.join(base, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("base")).drop("bucket", "base")


def best_fit_packing(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, buckets: int = BUCKETS) -> DataFrame:
    """Pieces of all documents with sequence_id and offset.

    A null or empty text is one piece with `end_id` alone; an empty table gives
    an empty result; repeated rows are packed each.  Columns of `docs` beside
    the id and the text are not carried.  The order among equal pieces is by id.
    """
    cut = written(pieces(docs, doc_col, text_col, tokenizer, capacity, end_id), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    rows = sorted(plan(histogram, capacity))
    runs = np.array(rows, np.int64).reshape(-1, 5)
    lengths, begin = np.unique(runs[:, 0], return_index=True)
    bounds = {int(a): (int(b), int(e)) for a, b, e in zip(lengths, begin, [*begin[1:], len(runs)])}
    sent = docs.sparkSession.sparkContext.broadcast((runs, bounds))

    def place(batches) -> Iterator[pa.RecordBatch]:
        runs, bounds = sent.value
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            row = np.empty(len(rank), np.int64)
            for n in np.unique(length):
                lo, hi = bounds[int(n)]
                own = length == n
                row[own] = lo + np.searchsorted(runs[lo:hi, 1], rank[own], "right") - 1
            sequence = runs[row, 3] + rank - runs[row, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(runs[row, 4])], ["doc", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = docs.schema[doc_col].dataType.simpleString()
    cut = ranked(cut, buckets).select("doc", "piece", "start", "length", "ids_crc32", "rank")
    return cut.mapInArrow(place, f"doc {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("doc", doc_col)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents").select("doc_id", "text"))
