"""Target-distribution importance resampling by hashed n-gram buckets.

DuckDB runs inside each task: SQL unnests the words of a slice, windows make
their runs of 1 to 3 words, a registered function gives zlib's CRC of each, and
bucket counts of each document are returned to Spark, which spills them to
Parquet in the shared folder.  The texts are read once; Spark then merges the
counts of the spilled table into bucket totals (BUCKETS rows), turns them into
gains, scores every document and ranks the draw over range partitions.
"""

from __future__ import annotations

import contextlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import checkpointed, table, written
from ._text import SLICE_BYTES, value_buffer

BUCKETS, GRAMS, SEED, LEAST_WORDS, PERCENT = 10_000, 3, 42, 20, 5
#: Rows that one range of the ranking holds, and rows of bucket counts that Python scores at once.
RANKED_ROWS, SCORED_ROWS = 500_000, 500

IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[65:91] = IN_WORD[97:123] = IN_WORD[128:] = True
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

FEATURES = f"""
WITH t AS (SELECT row, piece, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS own,
                  regexp_extract_all(translate(next, '{UPPER}', '{LOWER}'), '{WORD}') AS after FROM slice),
w AS (SELECT row, piece, len(own) AS n, unnest(own || after) AS a, generate_subscripts(own || after, 1) AS i FROM t),
r AS (SELECT row, i <= n AS own, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY row, piece ORDER BY i)),
g AS (SELECT row, a AS gram FROM r WHERE own
      UNION ALL SELECT row, a || ' ' || b FROM r WHERE own AND b IS NOT NULL
      UNION ALL SELECT row, a || ' ' || b || ' ' || c FROM r WHERE own AND c IS NOT NULL)
SELECT row * {{buckets}} + crc(gram) % {{buckets}} AS key, count(*) AS n FROM g GROUP BY ALL
"""


def _crc(grams):
    """zlib's CRC of the UTF-8 bytes of each string, for DuckDB."""
    raw, off = value_buffer(grams.combine_chunks() if isinstance(grams, pa.ChunkedArray) else grams)
    data, cuts, crc = raw.tobytes(), off.tolist(), zlib.crc32
    return pa.array([crc(data[a:b]) for a, b in zip(cuts, cuts[1:])], pa.uint32())


def _pieces(raw: np.ndarray, off: np.ndarray, most: int):
    """(row, piece, text, the two words after it): whole texts, longer ones in pieces of about `most` bytes cut at a word's begin."""
    for row, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
        if b - a <= most:
            yield row, 0, raw[a:b].tobytes(), b""
            continue
        inside = IN_WORD[raw[a:b]]
        starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1  # the first word needs no cut before it
        cuts = np.unique(np.searchsorted(starts, np.arange(most, b - a, most)))
        cuts = cuts[cuts < len(starts)]
        places = [0, *starts[cuts].tolist(), b - a]
        ends = [*(starts[k + GRAMS - 1] if k + GRAMS - 1 < len(starts) else b - a for k in cuts.tolist()), b - a]
        for k, (x, y) in enumerate(zip(places, places[1:])):
            yield row, k, raw[a + x : a + y].tobytes(), raw[a + y : a + ends[k]].tobytes()


def spilled(texts: DataFrame, buckets: int, name: str, most: int = SLICE_BYTES) -> DataFrame:
    """id, print, n_features, bucket, n of texts (id, text): the last two are arrays, of the document's buckets.

    A document has `buckets` entries at most, however long it is.  What
    DuckDB sees at once holds about `most` bytes of text; it runs on one thread and
    without a folder of its own.
    """

    def run(batches):
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})
        con.create_function("crc", _crc, ["VARCHAR"], "UINTEGER", type="arrow")
        sql = FEATURES.format(buckets=buckets)

        def counted(parts):
            slice = pa.table([pa.array(c, t) for c, t in zip(zip(*parts), (pa.int64(), pa.int64(), pa.string(), pa.string()))], ["row", "piece", "text", "next"])  # noqa: F841
            con.register("slice", slice)
            found = con.sql(sql).to_arrow_table()
            con.unregister("slice")
            return [found.column(c).to_numpy().astype(np.int64) for c in ("key", "n")]

        for batch in batches:
            raw, off = value_buffer(batch.column("text"))
            begin = 0
            while begin < batch.num_rows:
                end = max(begin + 1, int(np.searchsorted(off, off[begin] + most, "right")) - 1)
                got, parts, size = [], [], 0
                for part in _pieces(raw, off[begin : end + 1], most):
                    parts.append(part)
                    size += len(part[2])
                    if size >= most:
                        got.append(counted(parts))
                        parts, size = [], 0
                if parts:
                    got.append(counted(parts))
                key, n = (np.concatenate(c) for c in zip(*got))
                if len(got) > 1:  # pieces of one text
                    key, at = np.unique(key, return_inverse=True)
                    n = np.bincount(at, n, len(key)).astype(np.int64)
                else:
                    order = np.argsort(key)
                    key, n = key[order], n[order]
                first = np.searchsorted(key, np.arange(end - begin + 1) * buckets).astype(np.int32)
                sums = np.concatenate([[0], np.cumsum(n)])[first]
                lists = [pa.ListArray.from_arrays(pa.array(first), pa.array(x)) for x in ((key % buckets).astype(np.int32), n.astype(np.int32))]
                yield pa.record_batch([*(batch.column(c).slice(begin, end - begin) for c in ("id", "print")), pa.array(np.diff(sums)), *lists], ["id", "print", "n_features", "bucket", "n"])
                begin = end

    kind = texts.schema["id"].dataType.simpleString()
    rows = texts.select("id", F.xxhash64("text").alias("print"), "text").mapInArrow(run, f"id {kind}, print long, n_features long, bucket array<int>, n array<int>")
    return written(rows, name)


def bucket_totals(counts: DataFrame) -> DataFrame:
    """bucket, n: sums over a spilled table."""
    return counts.select(F.inline(F.arrays_zip("bucket", "n"))).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """Gain of each bucket, `buckets` numbers: floor(1000 * ln) of the smoothed ratio of target to source."""
    counts = source.withColumn("target", F.lit(False)).unionByName(target.withColumn("target", F.lit(True))).groupBy("bucket")
    counts = counts.agg(F.sum(F.when(~F.col("target"), F.col("n")).otherwise(0)).alias("s"), F.sum(F.when(F.col("target"), F.col("n")).otherwise(0)).alias("t"))
    counts = checkpointed(counts)
    all_s, all_t = (float(x or 0) for x in counts.agg(F.sum("s"), F.sum("t")).first())
    real = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    ratio = (real(F.col("t")) + 1) * F.lit(all_s + buckets) / ((real(F.col("s")) + 1) * F.lit(all_t + buckets))
    every = counts.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    rows = every.select("bucket", F.floor(1000 * F.ln(ratio)).alias("gain")).collect()
    return [r["gain"] for r in sorted(rows)]


def _weight(by_bucket: list[int]):
    value = np.array(by_bucket, np.int64)

    @F.arrow_udf("long")
    def weight(bucket: pa.Array, n: pa.Array) -> pa.Array:
        at = bucket.flatten().to_numpy(zero_copy_only=False)
        sums = np.concatenate([[0], np.cumsum(value[at] * n.flatten().to_numpy(zero_copy_only=False))])
        cuts = np.concatenate([[0], np.cumsum(bucket.value_lengths().to_numpy(zero_copy_only=False))])
        return pa.array(np.diff(sums[cuts]))

    return weight


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Record batches of `rows` rows for plans that are run inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def noise(doc: Column, seed: int) -> Column:
    """floor(-1000 * ln(-ln(u))): u from the first 32 bits of sha256(seed:doc); a null id is an empty one."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, drawn: int, rows: int, range_rows: int = RANKED_ROWS) -> DataFrame:
    """Add `rank` (1, 2, ... up to `drawn`, else null) by score descending, id and text; `eligible` rows only.

    Rows are dealt into ranges of the order, whose sizes give each range its first
    rank; only ranges that hold drawn rows are sorted, each in a task.
    """
    order = [F.col("score").desc(), F.col("id").asc_nulls_first(), F.col("print")]
    rest = scored.where("not eligible").withColumn("rank", F.lit(None).cast("long"))
    dealt = written(scored.where("eligible").repartitionByRange(1 + rows // range_rows, *order).withColumn("range", F.spark_partition_id()), "resampled-ranges")
    sizes = {r["range"]: r["count"] for r in dealt.groupBy("range").count().collect()}
    first, ahead = {}, 0
    for k in sorted(sizes):
        if ahead < drawn:
            first[k] = ahead
        ahead += sizes[k]
    in_drawn = F.col("range").isin(*first) if first else F.lit(False)
    begins = F.element_at(F.create_map(*[F.lit(x) for kv in first.items() for x in kv]), F.col("range")) if first else F.lit(0)
    place = begins + F.row_number().over(Window.partitionBy("range").orderBy(*order))
    top = dealt.where(in_drawn).withColumn("rank", place.cast("long")).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    below = dealt.where(~in_drawn).withColumn("rank", F.lit(None).cast("long"))
    return top.drop("range").unionByName(below.drop("range")).unionByName(rest)


def importance_resampling(
    docs: DataFrame, target: DataFrame, doc_col="doc_id", text_col="text", buckets=BUCKETS, least_words=LEAST_WORDS, percent=PERCENT, seed=SEED, slice_bytes=SLICE_BYTES, range_rows=RANKED_ROWS
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs, drawn towards the texts of target (`text_col`).

    Null and empty texts have no features and weight 0.  Rows of one id have one
    noise and are ranked by their texts' hashes where they tie; equal rows get
    ranks in a row; null ids come before others.  An empty table of documents
    gives an empty result; an empty target draws what is rare in the documents.
    Other columns are not read.  Long texts are counted in pieces.
    """
    of = lambda df, c: df.select(c.alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = spilled(of(docs, F.col(doc_col)), buckets, "bucket-counts", slice_bytes)
    aim = spilled(of(target, F.lit(None).cast("long")), buckets, "bucket-counts-of-target", slice_bytes)
    weight = _weight(gains(bucket_totals(own), bucket_totals(aim), buckets))
    scored = own.select("id", "print", "n_features", weight("bucket", "n").alias("weight"))
    # n words have n + (n - 1) + (n - 2) runs: least_words of them are found by the count of features
    features = sum(max(0, least_words - k) for k in range(GRAMS))
    # a row may hold `buckets` entries, so few rows are sent to Python at once
    with arrow_rows(docs.sparkSession, SCORED_ROWS):
        scored = written(scored.select("*", (F.col("weight") + noise(F.col("id"), seed)).alias("score"), (F.col("n_features") >= features).alias("eligible")), "resampling-scores")
    n = scored.where("eligible").count()
    return ranked(scored, percent * n // 100, n, range_rows).select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: CRC-32 is linear: a byte's part depends on the byte and its distance from the end, and a length has a part of its own.
SQL = f"""
WITH RECURSIVE tab AS (SELECT b, xor(0::UBIGINT, list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)::UBIGINT) AS t FROM range(256) r(b)),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
k AS (SELECT regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark),
lists AS (SELECT row, doc_id, w FROM d UNION ALL SELECT -1, NULL, w FROM k),
runs AS (SELECT row, array_to_string(w[i : i + m - 1], ' ') AS gram FROM (SELECT row, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM lists, range(1, 4) r(m))),
f AS (SELECT row, gram, count(*) AS n FROM runs GROUP BY ALL),
u AS (SELECT gram, strlen(gram) AS len, hex(encode(gram)) AS h FROM (SELECT DISTINCT gram FROM f)),
parts(d, b, p) AS (SELECT 0, b, t FROM tab UNION ALL SELECT d + 1, parts.b, xor(p >> 8, t) FROM parts JOIN tab ON tab.b = p & 255 WHERE d < (SELECT max(len) FROM u)),
ends(n, z) AS (SELECT 0, 4294967295::UBIGINT UNION ALL SELECT n + 1, xor(z >> 8, t) FROM ends JOIN tab ON tab.b = z & 255 WHERE n < (SELECT max(len) FROM u)),
x AS (SELECT gram, len, len - 1 - i AS d, (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 1 AS b FROM (SELECT *, unnest(range(len)) AS i FROM u)),
c AS (SELECT gram, xor(xor(any_value(z), 4294967295), bit_xor(p)) % {BUCKETS} AS bucket FROM x JOIN parts USING (d, b) JOIN ends ON n = len GROUP BY gram),
e AS (SELECT row, bucket, n FROM f JOIN c USING (gram)),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (row <> -1), 0) AS s, coalesce(sum(n) FILTER (row = -1), 0) AS t FROM e GROUP BY bucket),
total AS (SELECT CAST(sum(s) AS DOUBLE) AS all_s, CAST(sum(t) AS DOUBLE) AS all_t FROM sums),
g AS (SELECT bucket, CAST(floor(1000 * ln((t::DOUBLE + 1) * (all_s + {BUCKETS}) / ((s::DOUBLE + 1) * (all_t + {BUCKETS})))) AS BIGINT) AS gain FROM sums, total),
o AS (SELECT row, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM e JOIN g USING (bucket) GROUP BY row),
q AS (SELECT doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + CAST(floor(-1000.0 * ln(-ln((('0x' || sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
      FROM d LEFT JOIN o USING (row)),
z AS (SELECT *, row_number() OVER (PARTITION BY words >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS r FROM q)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= {LEAST_WORDS} AND r <= {PERCENT} * (SELECT count(*) FROM q WHERE words >= {LEAST_WORDS}) // 100 THEN r END AS rank FROM z
"""
