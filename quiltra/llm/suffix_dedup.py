"""Removal of every byte that lies in a 400-byte string found elsewhere in the corpus.

Prefix-free parsing.  Triggers are the places whose rolling hash over `gram`
bytes is least among `span` places in a row (the last one of equals), so equal
strings of `gram + span - 1` bytes hold an equal trigger at an equal place, and
the triggers cut all documents into phrases without any synchronisation.  A
phrase is the run of places that have one trigger; phrases tile a document.

* dictionary: trigger strings are counted over the corpus.  A window of
  `length` bytes can only be repeated if all phrases that lie in it have a
  trigger string that occurs elsewhere too, so documents shrink to runs of
  repeated phrases;
* parse: the windows of a phrase are one block.  Blocks with an equal block
  elsewhere are repeated as a whole; all windows of a phrase share a core
  behind the trigger, and where that core is unique none is repeated;
* the few blocks left, where a repeat begins or ends inside a phrase, are
  taken apart into their windows.

Phrases, blocks and windows meet by fingerprints instead of by their order in
a suffix array: equal neighbours are all that the removal needs.  What removes
bytes is told apart by 128 bits, what only proposes candidates by 64.  Equal
keys of one task are settled there; each task sends a key on at most once, so
a passage that a third of all documents share burdens no task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text
from ._spark import keyed, parts_of, row_print, table, text_bytes, written

U = np.uint64
LENGTH = 400
GRAM, SPAN = 192, 79
FLUSH = 1_000_000
#: Bytes of text for each place where keys meet.
PART_BYTES = 256 << 20


class Prints:
    """Fingerprints of byte ranges of a slice; `second` ones are independent of the first."""

    def __init__(self, raw: np.ndarray, second: bool = False):
        value = _text.mix(_text.BYTE_VALUE + U(0x632BE59BD9B4E019)) if second else _text.BYTE_VALUE
        self.up, self.down = _text.powers(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(value[raw] * self.up[:-1], out=self.sums[1:])

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _text.mix((self.sums[end] - self.sums[begin]) * self.down[begin] + (end - begin).astype(np.uint64))


def phrases(raw: np.ndarray, off: np.ndarray, prints: Prints, gram: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, trigger, first, last) of every phrase of texts of gram + span - 1 bytes or more, as places in the slice."""
    n = len(raw) - gram + 1
    size = np.diff(off)
    if n < span or not (size >= gram + span - 1).any():
        z = np.zeros(0, np.int64)
        return z, z, z, z
    places = np.arange(n)
    key = (prints(places, places + gram) & U(0xFFFFFFFF00000000)) | (U(0xFFFFFFFF) - places.astype(np.uint64))
    rows = -(-n // span)
    padded = np.full(rows * span, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    grid = padded.reshape(rows, span)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - span + 1
    least = np.minimum(behind[:m], ahead[span - 1 : span - 1 + m])
    trigger = (U(0xFFFFFFFF) - (least & U(0xFFFFFFFF))).astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)[:m]
    starts = np.flatnonzero(np.arange(m) + gram + span - 1 <= off[1:][row])
    cut = np.ones(len(starts), bool)
    cut[1:] = (trigger[starts[1:]] != trigger[starts[:-1]]) | (row[starts[1:]] != row[starts[:-1]])
    head = np.flatnonzero(cut)
    tail = np.append(head[1:], len(starts)) - 1
    return row[starts[head]], trigger[starts[head]], starts[head], starts[tail]


# -- equal keys across the corpus -------------------------------------------------

_SCHEMA = "kind int, part int, keys binary, data binary"
_PLACE = np.dtype([("print", "<i8"), ("a", "<i4")])
_BLOCK = np.dtype([("check", "<u8"), ("row", "<i8"), ("a", "<i4"), ("b", "<i4"), ("core", "<u8"), ("stands", "?")])
_CORE = np.dtype([("row", "<i8"), ("a", "<i4"), ("b", "<i4"), ("rep", "?"), ("stands", "?")])
_WINDOW = np.dtype([("check", "<u8"), ("row", "<i8"), ("a", "<i4"), ("stands", "?")])
_SQL = {"print": "long", "row": "long", "a": "int", "b": "int", "core": "long", "rep": "boolean"}


def _filled(kind: np.dtype, **columns) -> np.ndarray:
    out = np.zeros(len(columns["a"]), kind)
    for name, values in columns.items():
        out[name] = values
    return out


def _groups(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and rows in order of the key and its check, if rows have one, and whether each is the first of its kind."""
    order = np.argsort(keys, kind="stable")
    keys, rows = keys[order], rows[order]
    head = np.ones(len(keys), bool)
    head[1:] = keys[1:] != keys[:-1]
    if "check" in rows.dtype.names:
        check = rows["check"]
        if (check[1:] != check[:-1])[~head[1:]].any():  # equal keys of unlike strings
            order = np.lexsort((check, keys))
            keys, rows = keys[order], rows[order]
            head[1:] = (keys[1:] != keys[:-1]) | (rows["check"][1:] != rows["check"][:-1])
    return keys, rows, head


def _blobs(kind: int, by: np.ndarray, keys: np.ndarray, rows: np.ndarray, parts: int) -> pa.RecordBatch:
    """Keys and rows packed by the part that `by` deals them to."""
    part = (by >> U(20)) % U(parts)
    order = np.argsort(part.astype(np.uint32), kind="stable")
    keys, rows, part = keys[order], rows[order], part[order]
    own, begin = np.unique(part, return_index=True)
    cuts = list(zip(begin, [*begin[1:], len(part)]))
    return pa.record_batch([pa.array(np.full(len(own), kind, np.int32)), pa.array(own.astype(np.int32)), pa.array([keys[b:e].tobytes() for b, e in cuts], pa.binary()), pa.array([rows[b:e].tobytes() for b, e in cuts], pa.binary())], ["kind", "part", "keys", "data"])


class Sender:
    """Gathers (key, row) of a task.  What is shared within the task is settled at once (kind 1) and meets nothing any more; one row of it stands for the key elsewhere."""

    def __init__(self, parts: int):
        self.parts, self.keys, self.rows, self.n = parts, [], [], 0

    def add(self, keys: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.keys.append(keys), self.rows.append(rows)
        self.n += len(keys)
        if self.n >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        keys, rows, head = _groups(np.concatenate(self.keys), np.concatenate(self.rows))
        self.keys, self.rows, self.n = [], [], 0
        alone = head & np.append(head[1:], True)
        proxy = rows[head & ~alone].copy()
        if "stands" in rows.dtype.names:  # else a shared place may be found once more, which changes nothing
            proxy["stands"] = True
        open_keys, open_rows = np.concatenate([keys[alone], keys[head & ~alone]]), np.concatenate([rows[alone], proxy])
        yield _blobs(0, open_keys, open_keys, open_rows, self.parts)
        if not alone.all():
            settled = rows[~alone]
            by = _text.mix(settled["row" if "row" in settled.dtype.names else "print"].astype(np.int64).view(np.uint64))
            yield _blobs(1, by, keys[~alone], settled, self.parts)


def _meet(blobs: DataFrame, kind: np.dtype, singles: bool = False, standing: bool = False) -> DataFrame:
    """Rows whose key another row has (shared); with `singles` the others too (not shared).

    With `standing`, one more row of each shared key, not marked shared and
    with a negative a, that stands for the key's core.
    """
    names = [n for n in kind.names if n in _SQL]

    def meet(group: pa.Table) -> pa.Table:
        sort = np.array(group.column("kind").to_pylist())
        keys, data = group.column("keys").to_pylist(), group.column("data").to_pylist()
        known = np.frombuffer(b"".join(x for x, g in zip(data, sort) if g == 1), kind)
        k, r, head = _groups(np.frombuffer(b"".join(x for x, g in zip(keys, sort) if g == 0), np.uint64), np.frombuffer(b"".join(x for x, g in zip(data, sort) if g == 0), kind))
        alone = head & np.append(head[1:], True) if len(k) else head
        plain = ~r["stands"] if "stands" in kind.names else np.ones(len(r), bool)
        hit = r[~alone & plain]
        out, flag = [known, hit], [np.ones(len(known), bool), np.ones(len(hit), bool)]
        if singles:
            out.append(r[alone & plain])
            flag.append(np.zeros(len(out[-1]), bool))
        if standing:
            rep = r[head & (~alone | ~plain)].copy()
            rep["a"] = -1 - rep["a"]
            out.append(rep)
            flag.append(np.zeros(len(rep), bool))
        rows = np.concatenate(out)
        columns = {n: _text.as_long(np.ascontiguousarray(rows[n])) if n == "core" else pa.array(np.ascontiguousarray(rows[n])) for n in names}
        return pa.table({**columns, "shared": pa.array(np.concatenate(flag))})

    return blobs.groupBy("part").applyInArrow(meet, ", ".join(f"{n} {_SQL[n]}" for n in names) + ", shared boolean")


def _ranges(low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i, n[i] numbers from low[i] on: (i repeated, the numbers)."""
    each = np.repeat(np.arange(len(low)), n)
    return each, low[each] + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


class SuffixDedup:
    """Documents without the bytes of strings of `length` bytes that start elsewhere too.

    Every row is a document of its own, whatever its id: two rows of one id (or
    of a null id) with different texts are told apart by id and text, and equal
    rows repeat each other, as any two copies do.  A null text is empty.
    Matches never cross documents; overlaps count; equal strings all go, so
    there are no ties.  Texts shorter than `length` never lose a byte; an empty
    table gives an empty result; other columns of docs are not read.  A task
    holds one whole text at a time, about 100 bytes of memory a byte of text.
    """

    def __init__(self, docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, span: int = SPAN):
        if not (gram > 0 < span and gram + 2 * span - 1 <= length):
            raise ValueError("a window must hold the core of every phrase in it")
        self.length, self.gram, self.span = length, gram, span
        self.docs = keyed(docs, doc_col, text_col)
        self.parts = parts_of(docs.sparkSession, text_bytes(docs, text_col), PART_BYTES)

    def triggers(self) -> DataFrame:
        """print, at: places of the triggers of a text whose string is a trigger elsewhere too."""
        gram, span, parts = self.gram, self.span, self.parts

        def run(batches) -> Iterator[pa.RecordBatch]:
            out = Sender(parts)
            for part in _text.slices(batches):
                raw, off = _text.value_buffer(part.column(1))
                prints = Prints(raw)
                row, at, _, _ = phrases(raw, off, prints, gram, span)
                texts = part.column(0).to_numpy(zero_copy_only=False)
                yield from out.add(prints(at, at + gram), _filled(_PLACE, print=texts[row], a=at - off[row]))
            yield from out.flush()

        found = _meet(self.docs.select("print", "text").mapInArrow(run, _SCHEMA), _PLACE)
        return found.groupBy("print").agg(F.collect_set("a").alias("at"))

    def windows(self, hot: DataFrame) -> DataFrame:
        """(row, a, b): runs of repeated windows of texts (row, at, text) with shared triggers."""
        length, gram, span, parts = self.length, self.gram, self.span, self.parts
        less = length - (gram + span - 1)

        def cut(batches) -> Iterator[pa.RecordBatch]:
            out = Sender(parts)
            for part in _text.slices(batches):
                raw, off = _text.value_buffer(part.column(2))
                prints, second = Prints(raw), Prints(raw, True)
                row, at, first, last = phrases(raw, off, prints, gram, span)
                lists = part.column(1)
                owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
                mine = np.isin(at, lists.flatten().to_numpy(zero_copy_only=False) + off[owner])
                row, at, first, last = row[mine], at[mine], first[mine], last[mine]
                if not len(at):
                    continue
                # windows end `less` places before their run of shared phrases does
                ends = np.ones(len(at), bool)
                ends[:-1] = (row[1:] != row[:-1]) | (first[1:] != last[:-1] + 1)
                run_end = last[ends][np.cumsum(np.append(0, ends[:-1]))]
                last = np.minimum(last, run_end - less)
                some = last >= first
                row, at, first, last = row[some], at[some], first[some], last[some]
                distance = (at - first).astype(np.uint64)
                core = prints(at, at + length - span + 1)
                whole = _text.mix(prints(first, last + length) + _text.mix(distance))
                base, ids = off[row], part.column(0).to_numpy(zero_copy_only=False)
                yield from out.add(whole, _filled(_BLOCK, check=_text.mix(second(first, last + length) + distance), row=ids[row], a=first - base, b=last - base, core=core))
            yield from out.flush()

        pieces = written(_meet(hot.select("row", "at", "text").mapInArrow(cut, _SCHEMA), _BLOCK, singles=True, standing=True), "repeat-blocks")

        def cores(batches) -> Iterator[pa.RecordBatch]:
            out = Sender(parts)
            for batch in batches:
                row, a, b, core = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
                yield from out.add(core.astype(np.int64).view(np.uint64), _filled(_CORE, row=row, a=np.where(a < 0, -1 - a, a), b=b, rep=a < 0))
            yield from out.flush()

        # representatives of equal blocks come in with a negative a
        todo = _meet(pieces.where("not shared").select("row", "a", "b", "core").mapInArrow(cores, _SCHEMA), _CORE)
        todo = todo.groupBy("row").agg(F.collect_list(F.struct("a", "b", "rep")).alias("runs"))

        def apart(batches) -> Iterator[pa.RecordBatch]:
            out = Sender(parts)
            for part in _text.slices(batches):
                raw, off = _text.value_buffer(part.column(2))
                prints, second = Prints(raw), Prints(raw, True)
                runs = part.column(1)
                owner = np.repeat(np.arange(len(runs)), runs.value_lengths().to_numpy(zero_copy_only=False))
                flat = runs.flatten()
                a, b, rep = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                each, s = _ranges(a.astype(np.int64), (b - a + 1).astype(np.int64))
                row = owner[each]
                # a window comes once for a document's place, by itself rather than by a block that stands for others
                order = np.lexsort((rep[each], s, row))
                s, row = s[order], row[order]
                fresh = np.ones(len(s), bool)
                fresh[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
                s, row = s[fresh], row[fresh]
                begin, ids = s + off[row], part.column(0).to_numpy(zero_copy_only=False)
                yield from out.add(prints(begin, begin + length), _filled(_WINDOW, check=second(begin, begin + length), row=ids[row], a=s))
            yield from out.flush()

        texts = hot.select("row", "text").join(todo, "row").select("row", "runs", "text")
        single = _meet(texts.mapInArrow(apart, _SCHEMA), _WINDOW).select("row", "a", F.col("a").alias("b"))
        return pieces.where("shared").select("row", "a", "b").unionByName(single)

    def removals(self) -> DataFrame:
        """doc, print, n_repeated, n_removed, n_spans, kept: one row of each (id, text) that holds a repeated phrase's trigger.

        n_repeated counts the bytes of `gram`-byte trigger strings found
        elsewhere: strings of gram + span - 1 bytes or more that repeat always
        hold one.  `kept` is null where nothing is removed.
        """
        length, gram = self.length, self.gram
        found = self.docs.join(self.triggers(), "print")
        hot = written(found.select(F.monotonically_increasing_id().alias("row"), "doc", "print", "at", "text"), "repeat-texts")
        runs = self.windows(hot).groupBy("row").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))

        def reduce(batches) -> Iterator[pa.RecordBatch]:
            for part in _text.slices(batches):
                n_removed, n_spans, kept = [], [], []
                for a, b, text in zip(part.column(1), part.column(2), part.column(3).to_pylist()):
                    raw = text.encode("utf-8", "surrogatepass")
                    edge = np.zeros(len(raw) + 1, np.int64)
                    np.add.at(edge, a.values.to_numpy(zero_copy_only=False), 1)
                    np.add.at(edge, b.values.to_numpy(zero_copy_only=False) + length, -1)
                    gone = np.cumsum(edge)[:-1] > 0
                    n_removed.append(int(gone.sum()))
                    n_spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                    kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
                yield pa.record_batch([part.column(0), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())], ["row", "n_removed", "n_spans", "kept"])

        texts = hot.select("row", "text").join(runs, "row").select("row", "a", "b", "text")
        lost = texts.mapInArrow(reduce, "row long, n_removed long, n_spans long, kept binary")
        starts = F.sort_array("at")
        steps = F.zip_with(starts, F.slice(starts, 2, F.size("at")), lambda x, y: F.least(F.coalesce(y - x, F.lit(gram)), F.lit(gram)))
        counts = hot.select("row", "doc", "print", F.aggregate(steps, F.lit(0), lambda n, x: n + x).cast("long").alias("n_repeated"))
        out = counts.join(lost, "row", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_removed", "n_spans")})
        return out.drop("row").dropDuplicates(["doc", "print"])


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = SuffixDedup(docs).removals().select(F.col("doc").alias("_doc"), F.col("print").alias("_print"), "n_repeated", "n_removed", "n_spans", F.sha2("kept", 256).alias("_kept"))
    raw = F.coalesce("text", F.lit("")).cast("binary")
    all_ = docs.select("doc_id", row_print("doc_id", "text").alias("_text"), F.length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("_sha"))
    joined = all_.join(found, all_["doc_id"].eqNullSafe(found["_doc"]) & (F.col("_text") == F.col("_print")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_removed", "n_spans")]
    return joined.select("doc_id", "n_bytes", *counts, F.coalesce("_kept", "_sha").alias("kept_sha256"), F.coalesce("n_repeated", F.lit(0)).cast("long").alias("n_repeated"))
