"""Substring dedup over sliding sentence spans.

Every run of `run` consecutive sentences of a document is hashed (a run of very
short sentences takes more of them, a short document gives one run), equal runs
meet across the whole corpus,
and the sentences of every run but the first (least document id, then place)
are removed.  A task first settles the equal runs among its own documents: all
but its least occurrence are non-first for certain, so a run that a third of
all documents share leaves each task once.

A passage need not hold whole sentences.  With `passage` words, each document
is also cut at content-defined words, whatever its sentences: the least word
hash of every WINDOW consecutive words begins a piece.  Inside equal passages
the cuts are equal but for those near the ends, so runs of pieces of
piece_words(passage) words at least meet for every repeated passage of
`passage` words, and such a passage always loses words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType

from . import _text
from ._spark import free_name, keyed, parts_of, row_print, table, text_bytes

U = np.uint64
RUN = 2
#: A run has so many words at least: less repeats by chance.
MIN_WORDS = 20
#: Every repeated passage of so many words loses words.
PASSAGE_WORDS = 50
#: A piece begins in every so many consecutive words.
WINDOW = 6
#: Added to the place of a run of pieces: its first word's number in the document.
PIECES = 1 << 30
BLOCK = 1_000_000
#: Bytes of text for each place where runs meet.
PART_BYTES = 256 << 20
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True


def sentences(column: pa.Array) -> tuple[_text.Words, np.ndarray]:
    """Words of a slice and the index of each sentence's first word; a sentence ends with . ! ? at a word's end, a line break or the text."""
    found = _text.words(column)
    raw, _ = _text.value_buffer(column)
    n = len(found.start)
    if n == 0:
        return found, np.zeros(0, np.int64)
    breaks = np.concatenate([[0], np.cumsum(raw == 10)])
    begins = np.ones(n, bool)
    begins[1:] = _STOP[raw[found.end[:-1] - 1]] | (breaks[found.start[1:]] > breaks[found.end[:-1]]) | (found.doc[1:] != found.doc[:-1])
    return found, np.flatnonzero(begins)


def run_ends(first: np.ndarray, doc: np.ndarray, n_words: int, rows: int, run: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the run from each sentence: the sentence after it, the sentence's place in its document, and whether the run counts."""
    per_doc = np.bincount(doc, minlength=rows)
    ends = np.cumsum(per_doc)
    place = np.arange(len(first)) - np.repeat(ends - per_doc, per_doc)
    bounds = np.append(first, n_words)
    wanted = np.maximum(np.arange(len(first)) + run, np.searchsorted(bounds, first + min_words))
    last = np.minimum(wanted, ends[doc])
    return last, place, ((wanted <= ends[doc]) | (place == 0)) & (bounds[last] - first >= min_words)


def piece_words(passage: int) -> int:
    """The most words that a run of pieces can ask for and still be inside every passage.

    The first cut lies in the first WINDOW words, the last one in the last WINDOW, and a run ends WINDOW - 1 words late at most.
    """
    return passage - 3 * WINDOW + 2


def piece_begins(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Words that have the least hash (the last one of equals) of some WINDOW consecutive words of a document."""
    m = len(h) - WINDOW + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    least, at = h[:m].copy(), np.arange(m)
    for j in range(1, WINDOW):
        lower = h[j : j + m] <= least
        least[lower] = h[j : j + m][lower]
        at[lower] = np.flatnonzero(lower) + j
    chosen = np.zeros(len(h), bool)
    chosen[at[doc[:m] == doc[WINDOW - 1 :]]] = True
    return np.flatnonzero(chosen)


def piece_runs(h: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of the run of pieces from each cut: to the first cut that is `least` words or more after it, within a document."""
    begin = piece_begins(h, doc)
    to = np.searchsorted(begin, begin + least)
    ok = to < len(begin)
    begin, end = begin[ok], begin[to[ok]]
    same = doc[begin] == doc[end]
    return begin[same], end[same]


def spans(column: pa.Array, run: int, min_words: int, passage: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, place) of every run of a slice: the first sentence within the row, or PIECES and the first word."""
    found, first = sentences(column)
    if len(first) == 0:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z
    up, down = _text.powers(len(found.hash) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_text.mix(found.hash) * up[: len(found.hash)], dtype=np.uint64)])
    doc = found.doc[first]
    last, place, keep = run_ends(first, doc, len(found.hash), len(column), run, min_words)
    begin, end = first[keep], np.append(first, len(found.hash))[last][keep]
    h = _text.mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
    if passage is None:
        return h, doc[keep], place[keep]
    begin, end = piece_runs(found.hash, found.doc, piece_words(passage))
    pieces = _text.mix(_text.mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64)) + U(PIECES))
    row = found.doc[begin]
    return np.concatenate([h, pieces]), np.concatenate([doc[keep], row]), np.concatenate([place[keep], PIECES + begin - found.first[row]])


_RUN = np.dtype([("key", "<u8"), ("doc", "<i8"), ("print", "<i8"), ("place", "<i4")])


def _settled(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs in order of key, document and place, repeated ones once; is each the first of its key?"""
    runs = runs[np.lexsort((runs["place"], runs["print"], runs["doc"], runs["key"]))]
    fresh = np.ones(len(runs), bool)
    fresh[1:] = runs[1:] != runs[:-1]
    runs = runs[fresh]
    head = np.ones(len(runs), bool)
    head[1:] = runs["key"][1:] != runs["key"][:-1]
    return runs, head


def repeats(docs: DataFrame, doc_col: str, text_col: str, run: int, min_words: int, passage: int | None = None) -> DataFrame:
    """doc, print, place: the first sentence of every non-first run, or PIECES and its first word."""
    parts = U(parts_of(docs.sparkSession, text_bytes(docs, text_col), PART_BYTES))

    def blobs(kind: int, by: np.ndarray, runs: np.ndarray) -> pa.RecordBatch:
        part = (by >> U(20)) % parts
        order = np.argsort(part.astype(np.uint32), kind="stable")
        runs = runs[order]
        own, begin = np.unique(part[order], return_index=True)
        return pa.record_batch([pa.array(np.full(len(own), kind, np.int32)), pa.array(own.astype(np.int32)), pa.array([runs[b:e].tobytes() for b, e in zip(begin, [*begin[1:], len(runs)])], pa.binary())], ["kind", "part", "runs"])

    def flush(rows) -> Iterator[pa.RecordBatch]:
        runs, head = _settled(np.concatenate(rows))
        yield blobs(0, runs["key"][head], runs[head])
        if not head.all():  # not the first for certain: nothing to meet, so dealt by its text and not by its key
            runs = runs[~head]
            yield blobs(1, _text.mix(runs["print"].view(np.uint64)), runs)

    def gather(batches) -> Iterator[pa.RecordBatch]:
        rows, n = [], 0
        for part in _text.slices(batches):
            h, row, place = spans(part.column(2), run, min_words, passage)
            own = np.zeros(len(h), _RUN)
            own["key"], own["place"] = h, place
            own["doc"], own["print"] = (part.column(c).fill_null(0).to_numpy(zero_copy_only=False)[row] for c in (0, 1))
            rows.append(own)
            n += len(h)
            if n >= BLOCK:
                yield from flush(rows)
                rows, n = [], 0
        if n:
            yield from flush(rows)

    def meet(group: pa.Table) -> pa.Table:
        kind, data = group.column("kind").to_pylist(), group.column("runs").to_pylist()
        open_, settled = (np.frombuffer(b"".join(x for x, k in zip(data, kind) if k == which), _RUN) for which in (0, 1))
        open_, head = _settled(open_)
        gone = np.concatenate([open_[~head], settled])
        return pa.table({"doc": pa.array(np.ascontiguousarray(gone["doc"])), "print": pa.array(np.ascontiguousarray(gone["print"])), "place": pa.array(np.ascontiguousarray(gone["place"]))})

    rows = keyed(docs, doc_col, text_col)
    rows = rows.withColumn("doc", rank_of(docs.schema[doc_col].dataType, F.col("doc")))
    return rows.mapInArrow(gather, "kind int, part int, runs binary").groupBy("part").applyInArrow(meet, "doc long, print long, place int")


def rank_of(kind: DataType, doc: Column) -> Column:
    """The id as a number by which documents are ordered; ids that are no integers have the order of their hash, null ids come first."""
    number = doc.cast("long") if isinstance(kind, IntegralType) else F.xxhash64(doc)
    return F.coalesce(number, F.lit(-(2**63)))


def _reduced(text: str, places, run: int, min_words: int, passage: int | None = None) -> tuple[str, int, int]:
    column = pa.array([text])
    found, first = sentences(column)
    n = len(first)
    if places is None or len(places) == 0:
        return text, n, 0
    places = np.asarray(places, np.int64)
    gone = np.zeros(len(found.hash) + 1, np.int64)  # +1 where a removed range of words begins, -1 at its end
    last, _, _ = run_ends(first, found.doc[first], len(found.hash), 1, run, min_words)
    whole = places[places < PIECES]
    np.add.at(gone, first[whole], 1)
    np.add.at(gone, np.append(first, len(found.hash))[last[whole]], -1)
    if passage is not None:
        begin, end = piece_runs(found.hash, found.doc, piece_words(passage))
        mine = np.isin(begin, places[places >= PIECES] - PIECES)
        np.add.at(gone, begin[mine], 1)
        np.add.at(gone, end[mine], -1)
    gone = np.cumsum(gone[:-1]) > 0
    raw = text.encode("utf-8", "surrogatepass")
    turns = np.flatnonzero(np.diff(gone)) + 1
    cuts = [0, *found.start[turns].tolist(), len(raw)]
    kept = [raw[b:e] for b, e, g in zip(cuts, cuts[1:], gone[np.append(0, turns)]) if not g]
    return b"".join(kept).decode("utf-8", "surrogatepass"), n, int(np.logical_or.reduceat(gone, first).sum())


def substring_dedup(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", run: int = RUN, min_words: int = MIN_WORDS, passage: int | None = None) -> DataFrame:
    """All rows and columns of docs, the text without non-first repeated runs, n_sentences and n_removed (sentences that lose words).

    With `passage`, of 20 or more, every passage of so many words that stands
    elsewhere before loses words also where it holds no whole sentences; up to
    2 * WINDOW words at each of its ends may stay.  Without, only runs of whole
    sentences are removed.

    Words are compared with A-Z lower-cased, whatever the spaces between them.
    Null texts become empty.  A document is told by id and text: two rows of
    one id with different texts are two documents, the one with the lesser
    hash of its text first, and so are rows of null ids, which come before all
    others; equal rows are one document and stay equal.  Within a document ties
    go to the lower place.  Columns named n_sentences or n_removed are
    replaced, all others kept, whatever their names; an empty table gives an
    empty result.  Runs are compared by a 64-bit hash.
    """
    mark = free_name(docs, "_places")
    gone = repeats(docs, doc_col, text_col, run, min_words, passage).groupBy(F.col("doc").alias(mark + "_doc"), F.col("print").alias(mark + "_print")).agg(F.collect_set("place").alias(mark))
    same = (rank_of(docs.schema[doc_col].dataType, docs[doc_col]) == gone[mark + "_doc"]) & (row_print(doc_col, text_col) == gone[mark + "_print"])
    joined = docs.join(gone, same, "left").drop(mark + "_doc", mark + "_print")

    @F.pandas_udf("text string, n_sentences long, n_removed long")
    def reduce(text: pd.Series, places: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_reduced(t or "", p, run, min_words, passage) for t, p in zip(text, places)], columns=["text", "n_sentences", "n_removed"])

    joined = joined.drop("n_sentences", "n_removed")
    out = joined.withColumn(mark + "_out", reduce(F.col(text_col), F.col(mark)))
    return out.withColumns({text_col: F.col(mark + "_out.text"), "n_sentences": F.col(mark + "_out.n_sentences"), "n_removed": F.col(mark + "_out.n_removed")}).drop(mark, mark + "_out")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), passage=PASSAGE_WORDS).select("doc_id", "n_sentences", "n_removed", "text")
