"""Relations that stand for images, vectors and tensors, and conversions between long and packed form.

A plane in long form has one row per pixel: img, y, x and value columns.  In
packed form it has one row per image with the samples as binary.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WIDTH, HEIGHT = 50, 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str, width: int = WIDTH, height: int = HEIGHT) -> DataFrame:
    """Planes a, b, c, mask m and alpha al of the images that the orders table spells: one row per order, ids dense from 0."""
    size, o = width * height, table(spark, sf_dir, "orders")
    return o.select(
        F.expr(f"o_orderkey div {size}").alias("img"),
        F.expr(f"(o_orderkey % {size}) div {width}").alias("y"),
        F.expr(f"o_orderkey % {width}").alias("x"),
        (F.floor(F.col("o_totalprice") * 100) % 256).alias("a"),
        ((F.col("o_custkey") * 7919 + F.col("o_orderkey") * 104729) % 256).alias("b"),
        ((F.col("o_orderkey") * 31 + F.col("o_custkey") * 17) % 256).alias("c"),
        (F.col("o_custkey") % 4).alias("m"),
        ((F.col("o_custkey") * 13) % 256).alias("al"),
    )


#: The same relation for DuckDB.
PIXELS_SQL = f"""p AS (SELECT o_orderkey // {WIDTH * HEIGHT} AS img, (o_orderkey % {WIDTH * HEIGHT}) // {WIDTH} AS y, o_orderkey % {WIDTH} AS x,
 CAST(floor(o_totalprice * 100) AS BIGINT) % 256 AS a, (o_custkey * 7919 + o_orderkey * 104729) % 256 AS b,
 (o_orderkey * 31 + o_custkey * 17) % 256 AS c, o_custkey % 4 AS m, (o_custkey * 13) % 256 AS al FROM orders)"""


def pack(df: DataFrame, value: str, dtype: str = "uint8") -> DataFrame:
    """img, w, h, data: one row per image from a long plane (rows of an image meet once, on img)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        h, w = int(group["y"].max()) + 1, int(group["x"].max()) + 1
        plane = np.zeros((h, w), dtype)
        plane[group["y"], group["x"]] = group[value].to_numpy()
        return pd.DataFrame({"img": [group["img"].iloc[0]], "w": [w], "h": [h], "data": [plane.tobytes()]})

    return df.select("img", "y", "x", value).groupBy("img").applyInPandas(run, "img long, w int, h int, data binary")


def unpack(df: DataFrame, dtype: str = "uint8") -> DataFrame:
    """img, y, x, v: the long form of packed planes, without a shuffle."""

    def run(batches):
        for batch in batches:
            for r in batch.itertuples(index=False):
                v = np.frombuffer(r.data, dtype)
                at = np.arange(len(v))
                yield pd.DataFrame({"img": r.img, "y": at // r.w, "x": at % r.w, "v": v.astype(np.int64)})

    return df.select("img", "w", "h", "data").mapInPandas(run, "img long, y long, x long, v long")


def neighbourhood(df: DataFrame, value: str, radius: int = 1, prefix: str = "n") -> DataFrame:
    """Add the (2r+1)^2 edge-clamped neighbours of `value` as columns n<dy><dx>, counted from 0.

    One shuffle on img serves both windows: a row's partition key (img, y) and
    a column's (img, x) are already together.
    """
    row = Window.partitionBy("img", "y").orderBy("x")
    column = Window.partitionBy("img", "x").orderBy("y")
    size = 2 * radius + 1

    def shifted(name: str, d: int, w) -> Column:
        move = F.lag if d < 0 else F.lead
        return F.coalesce(*[move(name, k).over(w) for k in range(abs(d), 0, -1)], F.col(name))

    out = df.repartition("img")
    out = out.select("*", *[shifted(value, j - radius, row).alias(f"_h{j}") for j in range(size)])
    out = out.select("*", *[shifted(f"_h{j}", i - radius, column).alias(f"{prefix}{i}{j}") for i in range(size) for j in range(size)])
    return out.drop(*[f"_h{j}" for j in range(size)])


def neighbourhood_sql(value: str, radius: int = 1) -> str:
    """CTE n with the same columns over p."""
    size = 2 * radius + 1

    def shifted(name: str, d: int, over: str) -> str:
        move = "lag" if d < 0 else "lead"
        parts = [f"{move}({name}, {k}) OVER {over}" for k in range(abs(d), 0, -1)]
        return f"coalesce({', '.join([*parts, name])})" if parts else name

    h = ", ".join(f"{shifted(value, j - radius, 'r')} AS h{j}" for j in range(size))
    v = ", ".join(f"{shifted(f'h{j}', i - radius, 'k')} AS n{i}{j}" for i in range(size) for j in range(size))
    return f"h AS (SELECT *, {h} FROM p WINDOW r AS (PARTITION BY img, y ORDER BY x)), n AS (SELECT *, {v} FROM h WINDOW k AS (PARTITION BY img, x ORDER BY y))"


def around(radius: int = 1, prefix: str = "n") -> list[Column]:
    return [F.col(f"{prefix}{i}{j}") for i in range(2 * radius + 1) for j in range(2 * radius + 1)]
