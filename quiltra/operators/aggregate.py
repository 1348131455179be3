"""Aggregations of planes: sums, moments, histograms and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import COMPARE, idiv


def total(v: Column) -> Column:
    return F.coalesce(F.sum(v), F.lit(0)).cast("long")


def where_sum(v: Column, condition: Column) -> Column:
    """Sum of v where the condition holds; one pass for any number of conditions."""
    return total(F.when(condition, v).otherwise(F.lit(0)))


def moments(x: Column, y: Column, condition: Column) -> dict[str, Column]:
    parts = {"area": F.lit(1), "sx": x, "sy": y, "sxx": x * x, "sxy": x * y, "syy": y * y}
    return {k: where_sum(v, condition) for k, v in parts.items()}


def object_moments(v: Column, x: Column, y: Column, condition: Column) -> dict[str, Column]:
    parts = {"n": F.lit(1), "s": v, "sx": v * x, "sy": v * y, "sxx": v * x * x, "sxy": v * x * y, "syy": v * y * y}
    return {k: where_sum(p, condition) for k, p in parts.items()}


def statistic(v: Column) -> dict[str, Column]:
    """min, max and rounded mean."""
    return {"lo": F.min(v).cast("long"), "hi": F.max(v).cast("long"), "mean": idiv(total(v) + idiv(F.count(v), 2), F.count(v))}


def bins(spark: SparkSession, n: int = 256) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "bin")


def histogram(df: DataFrame, value: Column, keys: list[str], condition: Column | None = None) -> DataFrame:
    """(keys, bin, n) of all 256 bins in one scan: partial counts in each task, one shuffle of at most 256 rows a key and task, a map of each key's bins."""
    hits = F.count(F.lit(1)) if condition is None else F.count_if(condition)
    counts = df.groupBy(*keys, value.cast("long").alias("bin")).agg(hits.alias("n"))
    held = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("held"))
    bins_ = held.select(*keys, "held", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(255).cast("long"))).alias("bin"))
    return bins_.select(*keys, "bin", F.coalesce(F.element_at("held", F.col("bin")), F.lit(0)).alias("n"))


def equalisation(hist: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, v, new): histogram equalisation table; 0 up to the first colour."""
    w = Window.partitionBy(*keys).orderBy("bin")
    all_ = Window.partitionBy(*keys)
    cdf = hist.withColumn("cdf", F.sum("n").over(w)).withColumn("low", F.min(F.when(F.col("n") > 0, F.struct("bin", "n"))).over(all_)["n"]).withColumn("total", F.sum("n").over(all_))
    norm = F.col("total") - F.col("low")
    new = F.when((F.col("cdf") <= F.col("low")) | (norm <= 0), F.lit(0)).otherwise(idiv(255 * (F.col("cdf") - F.col("low")) + idiv(norm, 2), F.greatest(norm, F.lit(1))))
    return cdf.select(*keys, F.col("bin").alias("v"), new.alias("new"))


def otsu(hist: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, threshold): the first bin of the largest between-class variance."""
    w = Window.partitionBy(*keys).orderBy("bin")
    all_ = Window.partitionBy(*keys)
    s = hist.select("*", F.sum("n").over(w).alias("wb"), F.sum(F.col("bin") * F.col("n")).over(w).alias("sb"), F.sum("n").over(all_).alias("t"), F.sum(F.col("bin") * F.col("n")).over(all_).alias("st"))
    wf = F.col("t") - F.col("wb")
    gap = F.col("sb") / F.col("wb") - (F.col("st") - F.col("sb")) / wf
    sigma = F.when((F.col("wb") > 0) & (wf > 0), F.col("wb").cast("double") * wf * gap * gap).otherwise(F.lit(0.0))
    return s.select(*keys, "bin", F.round(sigma, 3).alias("sigma")).groupBy(*keys).agg(F.max(F.struct("sigma", (-F.col("bin")).alias("k"))).alias("top")).select(*keys, (-F.col("top.k")).alias("threshold"))


def conditional(df: DataFrame, value: str, mask: str, threshold: int) -> list[Column]:
    """Counts, sums and sums of squares for all six compare types in one pass."""
    out = []
    for name, test in COMPARE.items():
        hit = test(F.col(mask), F.lit(threshold))
        out += [where_sum(F.lit(1), hit).alias(f"count_{name}"), where_sum(F.col(value), hit).alias(f"sum_{name}"), where_sum(F.col(value) * F.col(value), hit).alias(f"sqsum_{name}")]
    return out
