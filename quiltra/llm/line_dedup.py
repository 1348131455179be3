"""Line dedup: sharded cuckoo filters backed by exact reference counts.

State of the operator, all in the shared folder:

* reference counts: one row per line key with the exact number of documents
  that hold it, kept as signed deltas (+1 a document inserted, -1 deleted), so
  a deletion restores what the insertion changed;
* cuckoo filters: one row per shard, over the keys at or above the threshold.
  A batch inserts the keys that it lifts to the threshold into the filters of
  their shards and deletes those that it takes below; other shards stay.

A document's lines are first probed against the filters; only hits go on to
the exact join with the counts, so a false positive never drops a line.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import free_name, table, text_bytes, written
from ._text import SPACES, slices

MIN_DOCS = 10
MIN_CHARS = 1
#: Keys of a shard's filter; the number of shards follows the number of keys.
SHARD_KEYS = 50_000
SLOTS = 4
#: Filters are sent to every task up to this size; beyond it lines go to the tasks that hold their shard.
FILTER_BYTES = 64 << 20
#: Bytes of text whose lines one shard's task takes, where lines go to the shards.
PROBE_BYTES = 256 << 20
#: Copies of each hot key in the exact join: a line in a third of all documents is dealt over so many tasks.
SALTS = 32


def line_keys(text: str, min_chars: int) -> list[bytes | None]:
    """A 16-byte key for each line: stripped at both ends, A-Z lower-cased; None if shorter than min_chars code points."""
    out = []
    for line in text.split("\n"):
        s = line.encode("utf-8", "surrogatepass").strip(SPACES).lower()
        enough = len(s) >= min_chars if min_chars <= 1 else len(s.decode("utf-8", "surrogatepass")) >= min_chars
        out.append(hashlib.md5(s).digest() if enough else None)
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


class CuckooFilter:
    """Partial-key cuckoo filter over 16-byte keys: 4 slots a bucket, 32-bit fingerprints, insert, delete, probe."""

    def __init__(self, buckets: int, data: bytes | None = None):
        self.buckets = buckets
        self.table = np.zeros((buckets, SLOTS), np.uint32) if data is None else np.frombuffer(data, np.uint32).reshape(buckets, SLOTS).copy()

    @classmethod
    def build(cls, keys: list[bytes]) -> CuckooFilter:
        buckets = 1 << max(1, int(np.ceil(np.log2(max(1, len(keys)) / (SLOTS * 0.84)))))
        while True:
            out = cls(buckets)
            if all(out.insert(k) for k in keys):
                return out
            buckets *= 2

    def places(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        halves = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
        mark = (halves[:, 1] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        one = (halves[:, 1] & np.uint64(self.buckets - 1)).astype(np.int64)
        return mark, one, self.other(one, mark)

    def other(self, bucket, mark):
        return (np.asarray(bucket, np.int64) ^ (_mix(np.asarray(mark, np.uint64)) & np.uint64(self.buckets - 1)).astype(np.int64)).astype(np.int64)

    def insert(self, key: bytes) -> bool:
        mark, one, two = (x[0] for x in self.places([key]))
        for b in (one, two):
            free = np.flatnonzero(self.table[b] == 0)
            if len(free):
                self.table[b, free[0]] = mark
                return True
        b = one
        for kick in range(500):
            slot = kick % SLOTS
            mark, self.table[b, slot] = self.table[b, slot], mark
            b = int(self.other(np.array([b]), np.array([mark]))[0])
            free = np.flatnonzero(self.table[b] == 0)
            if len(free):
                self.table[b, free[0]] = mark
                return True
        return False

    def delete(self, key: bytes) -> bool:
        mark, one, two = (x[0] for x in self.places([key]))
        for b in (one, two):
            at = np.flatnonzero(self.table[b] == mark)
            if len(at):
                self.table[b, at[0]] = 0
                return True
        return False

    def probe(self, keys: list[bytes]) -> np.ndarray:
        mark, one, two = self.places(keys)
        return ((self.table[one] == mark[:, None]) | (self.table[two] == mark[:, None])).any(axis=1)


_FILTERS = "shard int, buckets long, data binary"


def _shard_of(key: bytes, shards: int) -> int:
    return int.from_bytes(key[:8], "little") % shards


def document_keys(docs: DataFrame, text_col: str, min_chars: int) -> DataFrame:
    """One row (key) per document and distinct line key."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 4 << 20):
            keys = [k for t in part.column(0).to_pylist() for k in {*line_keys(t or "", min_chars)} if k is not None]
            yield pa.record_batch([pa.array(keys, pa.binary())], ["key"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "key binary")


class LineDedup:
    """Incremental, reversible line dedup.

    insert(docs) and delete(docs) add signed rows to the reference counts;
    apply(docs) drops every line whose key is held by `min_docs` documents or
    more.  Each row counts as one document: a repeated row counts again.  Null
    and empty texts are one empty line, which has no key and always stays.
    apply() replaces columns of docs named n_lines or n_dropped and keeps all
    others; rows of one id, or of a null id, lose the lines that are hot, each
    from its own text.  An empty table gives an empty result.
    """

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, text_col: str = "text", filter_bytes: int = FILTER_BYTES):
        self.spark, self.min_docs, self.min_chars, self.text_col, self.filter_bytes = spark, min_docs, min_chars, text_col, filter_bytes
        self._counts: DataFrame | None = None
        self._filters: DataFrame | None = None
        self._shards = 1

    def _change(self, docs: DataFrame, sign: int) -> LineDedup:
        delta = document_keys(docs, self.text_col, self.min_chars).groupBy("key").agg((F.lit(sign) * F.count(F.lit(1))).alias("n_docs"))
        if self._counts is None:
            self._counts = written(delta, "line-counts")
            return self
        delta = written(delta, "line-delta")
        merged = self._counts.unionByName(delta).groupBy("key").agg(F.sum("n_docs").alias("n_docs")).where("n_docs <> 0")
        before, self._counts = self._counts, written(merged, "line-counts")
        if self._filters is not None:
            self._filters = self._crossed(before, delta)
        return self

    def _crossed(self, before: DataFrame, delta: DataFrame) -> DataFrame:
        """The filters after a batch: keys that crossed the threshold are inserted or deleted in the filters of their shards."""
        change = delta.select("key", F.col("n_docs").alias("change")).join(before, "key", "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0)))
        was, is_ = F.col("n_docs") >= self.min_docs, F.col("n_docs") + F.col("change") >= self.min_docs
        crossed = change.where(was != is_).select(self._shard(F.col("key")).alias("shard"), "key", is_.alias("hot"))

        def touch(own: pa.Table, keys: pa.Table) -> pa.Table:
            shard = (own if own.num_rows else keys).column("shard").slice(0, 1)
            f = CuckooFilter(own.column("buckets")[0].as_py(), own.column("data")[0].as_py()) if own.num_rows else CuckooFilter.build([])
            rows = list(zip(keys.column("key").to_pylist(), keys.column("hot").to_pylist()))
            for key, hot in rows:
                if not hot:
                    f.delete(key)
            full = [key for key, hot in rows if hot and not f.insert(key)]
            # a filter without room keeps no keys to grow from: its shard is built anew from the counts
            return pa.table([shard, pa.array([-1 if full else f.buckets], pa.int64()), pa.array([b"" if full else f.table.tobytes()], pa.binary())], ["shard", "buckets", "data"])

        after = written(self._filters.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInArrow(touch, _FILTERS), "line-filters")
        full = after.where("buckets < 0").select("shard")
        if full.isEmpty():
            return after
        anew = self._built(self.hot().withColumn("shard", self._shard(F.col("key"))).join(F.broadcast(full), "shard", "left_semi"))
        return written(after.where("buckets > 0").unionByName(anew), "line-filters")

    def insert(self, docs: DataFrame) -> LineDedup:
        return self._change(docs, 1)

    def delete(self, docs: DataFrame) -> LineDedup:
        return self._change(docs, -1)

    @property
    def counts(self) -> DataFrame:
        """key binary, n_docs long: the exact reference counts."""
        if self._counts is None:
            return self.spark.createDataFrame([], "key binary, n_docs long")
        return self._counts

    def hot(self) -> DataFrame:
        return self.counts.where(F.col("n_docs") >= self.min_docs)

    def _shard(self, key: Column) -> Column:
        """As _shard_of: the first 8 bytes, the least first, as a number modulo the shards."""
        if self._shards == 1:
            return F.lit(0)
        low = F.conv(F.concat(*[F.hex(F.substring(key, k, 1)) for k in range(8, 0, -1)]), 16, 10)
        return (low.cast("decimal(20,0)") % F.lit(self._shards)).cast("int")

    def _built(self, keys: DataFrame) -> DataFrame:
        """Filters from (shard, key)."""

        def build(group: pa.Table) -> pa.Table:
            f = CuckooFilter.build(group.column("key").to_pylist())
            return pa.table([group.column("shard").slice(0, 1), pa.array([f.buckets], pa.int64()), pa.array([f.table.tobytes()], pa.binary())], ["shard", "buckets", "data"])

        return keys.select("shard", "key").groupBy("shard").applyInArrow(build, _FILTERS)

    def filters(self) -> DataFrame:
        """shard int, buckets long, data binary: one cuckoo filter per shard of the hot keys.

        The number of shards follows the first corpus; where the hot keys have grown far beyond it, they are dealt anew.
        """
        n = self.hot().count()
        if self._filters is None or n > 4 * SHARD_KEYS * self._shards:
            self._shards = max(1, -(-n // SHARD_KEYS))
            self._filters = written(self._built(self.hot().withColumn("shard", self._shard(F.col("key")))), "line-filters")
        return self._filters

    def _lines(self, docs: DataFrame, doc_col: str, known=None) -> DataFrame:
        """(doc, key) of each row's distinct line keys, with `known` filters only of those that the filters can't exclude."""
        min_chars, shards = self.min_chars, self._shards

        def run(batches) -> Iterator[pa.RecordBatch]:
            tables = None if known is None else {s: CuckooFilter(b, d) for s, (b, d) in known.value.items()}
            for part in slices(batches, "text", 4 << 20):
                ids, keys = [], []
                for i, t in enumerate(part.column(1).to_pylist()):
                    own = [k for k in {*line_keys(t or "", min_chars)} if k is not None]
                    ids += [i] * len(own)
                    keys += own
                if tables is not None and keys:
                    home = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)[:, 0] % np.uint64(shards)
                    hit = np.zeros(len(keys), bool)
                    for s in np.unique(home):
                        if int(s) in tables:
                            at = np.flatnonzero(home == s)
                            hit[at] = tables[int(s)].probe([keys[j] for j in at])
                    at = np.flatnonzero(hit)
                    ids, keys = [ids[j] for j in at], [keys[j] for j in at]
                yield pa.record_batch([part.column(0).take(pa.array(ids, pa.int64())), pa.array(keys, pa.binary())], ["doc", "key"])

        kind = docs.schema[doc_col].dataType.simpleString()
        return docs.select(F.col(doc_col).alias("doc"), F.col(self.text_col).alias("text")).mapInArrow(run, f"doc {kind}, key binary")

    def _hits(self, docs: DataFrame, doc_col: str) -> DataFrame:
        """(doc, key) of lines that the filters can't exclude, each pair once a row."""
        filters = self.filters()
        size = filters.agg(F.sum(F.length("data"))).first()[0] or 0
        if size <= self.filter_bytes:
            known = self.spark.sparkContext.broadcast({r["shard"]: (r["buckets"], bytes(r["data"])) for r in filters.collect()})
            return self._lines(docs, doc_col, known)
        # each shard's filter goes to as many tasks as its lines need
        deals = max(1, -(-text_bytes(docs, self.text_col) // (PROBE_BYTES * self._shards)))
        lines = self._lines(docs, doc_col).withColumns({"shard": self._shard(F.col("key")), "deal": F.pmod(F.xxhash64("doc", "key"), F.lit(deals)).cast("int")})
        dealt = filters.select("*", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("deal"))

        def probe(lines: pa.Table, own: pa.Table) -> pa.Table:
            keys = [k.as_py() for k in lines.column("key")] if own.num_rows else []
            hit = CuckooFilter(own.column("buckets")[0].as_py(), own.column("data")[0].as_py()).probe(keys) if keys else np.zeros(lines.num_rows, bool)
            return lines.select(["doc", "key"]).filter(pa.array(hit))

        kind = docs.schema[doc_col].dataType.simpleString()
        return lines.groupBy("shard", "deal").cogroup(dealt.groupBy("shard", "deal")).applyInArrow(probe, f"doc {kind}, key binary")

    def dropped(self, docs: DataFrame, doc_col: str) -> DataFrame:
        """doc, keys: the hot keys of each document, by exact join."""
        salt = F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")
        hits = self._hits(docs, doc_col).withColumn("salt", salt)
        hot = self.hot().select("key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        return hits.join(hot, ["key", "salt"]).groupBy("doc").agg(F.collect_set("key").alias("keys"))

    def apply(self, docs: DataFrame, doc_col: str = "doc_id", into: str | None = None) -> DataFrame:
        """Every row of docs with its text reduced (in column `into`, the text column by default), n_lines and n_dropped."""
        into = into or self.text_col
        mark = free_name(docs, "_dropped_keys")
        gone = self.dropped(docs, doc_col).select(F.col("doc").alias(mark + "_doc"), F.col("keys").alias(mark))
        joined = docs.join(gone, docs[doc_col].eqNullSafe(gone[mark + "_doc"]), "left").drop(mark + "_doc").drop("n_lines", "n_dropped")
        min_chars = self.min_chars

        @F.arrow_udf("text string, n_lines long, n_dropped long")
        def reduce(text: pa.Array, keys: pa.Array) -> pa.Array:
            out, n_lines, n_dropped = [], [], []
            for t, gone in zip(text.to_pylist(), keys.to_pylist()):
                t, gone = t or "", set(gone or ())
                lines = t.split("\n")
                left = [line for line, k in zip(lines, line_keys(t, min_chars)) if k not in gone] if gone else lines
                out.append("\n".join(left))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(left))
            return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], ["text", "n_lines", "n_dropped"])

        out = joined.withColumn(mark + "_out", reduce(F.col(self.text_col), F.col(mark)))
        fields = {into: F.col(mark + "_out.text"), "n_lines": F.col(mark + "_out.n_lines"), "n_dropped": F.col(mark + "_out.n_dropped")}
        return out.withColumns(fields).drop(mark, mark + "_out")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = LineDedup(spark).insert(docs).apply(docs, into="kept")
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
hot AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, hot.key IS NOT NULL AS gone FROM k LEFT JOIN hot ON k.key = hot.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
