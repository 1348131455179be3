"""Session helpers of the corpus operators: shared folder, written tables, table lookup."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where none is named, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quiltra-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def ensure_checkpoints(spark: SparkSession) -> None:
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a small table in the shared folder."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows and bytes that a Python worker gets at once: Spark's own 10,000 rows are some 30 MB of text, held on both sides by every task.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on the session sends Python workers texts in batches of some MB; a smaller setting stays."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key)
        now = int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now)) if key.endswith("BytesPerBatch") else int(now)
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts: one pass over the column, nothing but a sum moves."""
    return docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0


def parts_of(spark: SparkSession, size: int, each: int) -> int:
    """Places where keys meet: twice the shuffle partitions, more where a place would take over `each` of `size` bytes."""
    return max(2 * tasks(spark), -(-size // each))


def row_print(doc_col: str, text_col: str) -> Column:
    """64 bits of a row's id and text: rows of one id with different texts differ."""
    return F.xxhash64(F.col(doc_col), F.col(text_col))


def keyed(docs: DataFrame, doc_col: str, text_col: str) -> DataFrame:
    """doc, print, text: what tells rows apart when ids are null or repeated."""
    return docs.select(F.col(doc_col).alias("doc"), row_print(doc_col, text_col).alias("print"), F.col(text_col).alias("text"))


#: Ids that a join may send to every task: 16 bytes each.
SENT_IDS = 200_000


def without(docs: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """Rows of docs whose key is not in gone's only column; keys are counted, and sent to all tasks only if they are few."""
    name = free_name(docs, "_gone")
    gone = checkpointed(gone.toDF(name).distinct())
    return docs.join(F.broadcast(gone) if gone.count() <= SENT_IDS else gone, key == gone[name], "left_anti")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that clashes with none of df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def crc_fold(column, modulus: int):
    """crc32(id as text) modulo `modulus`."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def summed_over_tasks(rows: DataFrame, total, length: int, chunks: int = 64):
    """Sum of the float32 arrays of `length` that total(batches) returns in each task, added up chunk by chunk.

    The result has a size that does not depend on the data; the driver gets `chunks` rows.
    """
    import numpy as np
    import pyarrow as pa

    cuts = [length * i // chunks for i in range(chunks + 1)]

    def run(batches):
        own = total(batches).astype(np.float32)
        yield pa.record_batch([pa.array(np.arange(chunks, dtype=np.int32)), pa.array([own[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())], ["chunk", "data"])

    def add(group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.float32) for x in group.column("data").to_pylist()]
        return pa.table({"chunk": group.column("chunk").slice(0, 1).cast(pa.int32()), "data": pa.array([np.sum(parts, axis=0, dtype=np.float64).tobytes()], pa.binary())})

    out = np.zeros(length)
    for row in rows.mapInArrow(run, "chunk int, data binary").groupBy("chunk").applyInArrow(add, "chunk int, data binary").collect():
        out[cuts[row["chunk"]] : cuts[row["chunk"] + 1]] = np.frombuffer(bytes(row["data"]), np.float64)
    return out
