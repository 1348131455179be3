"""Runs a streaming plan over what its source has now and gives the result back as a table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only in local mode without one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="quiltra-")


#: The state store that typed state needs; it keeps state on disk.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def numbered_batches(df: DataFrame, number: Column, batches: int) -> DataFrame:
    """A stream that gives df in `batches` micro-batches by their number from 0; rows of other numbers go.

    One file is written for each batch, in order, and one is read at a time.
    """
    spark, folder = df.sparkSession, f"{shared_folder(df.sparkSession)}/batches-{uuid.uuid4().hex}"
    for k in range(batches):  # the order of writing is the order of the batches
        df.where(number == k).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def micro_batches(df: DataFrame, time: str, batches: int) -> DataFrame:
    """A stream that gives df in `batches` micro-batches, cut at times that leave about as many rows in each.

    Rows of one time stay together; fewer batches where times are few; rows with a
    null time come with the first one.
    """
    micros = F.unix_micros(time)
    cuts = df.agg(F.percentile_approx(micros, [k / batches for k in range(1, batches)], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    number = sum((F.coalesce((micros > x).cast("int"), F.lit(0)) for x in cuts), F.lit(0))
    return numbered_batches(df, number, len(cuts) + 1)


def replayed(stream: DataFrame, mode: str = "append", settings: dict[str, str] | None = None) -> DataFrame:
    """Every row that the stream has produced once its source is read up; with mode complete the last batch's rows.

    Settings hold for this stream alone.
    """
    spark = stream.sparkSession
    top = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{top}/rows/{'all' if mode == 'complete' else f'batch={number}'}")

    before = {key: spark.conf.get(key, None) for key in settings or {}}
    try:
        for key, value in (settings or {}).items():
            spark.conf.set(key, value)
        query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{top}/rows/all" if mode == "complete" else f"{top}/rows/*")
