"""Rotations, pyramids and resampling: a destination pixel's sources are computed, not searched."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import idiv, shr

#: Transform -> (y, x) of a source pixel in the destination, from y, x and the last row and column h, w.
TRANSFORMS = {
    "rotate_0": lambda y, x, h, w: (y, x),
    "rotate_90": lambda y, x, h, w: (w - x, y),
    "rotate_180": lambda y, x, h, w: (h - y, w - x),
    "rotate_270": lambda y, x, h, w: (x, h - y),
    "transpose_rotate_0": lambda y, x, h, w: (x, y),
    "transpose_rotate_90": lambda y, x, h, w: (y, w - x),
    "transpose_rotate_180": lambda y, x, h, w: (w - x, h - y),
    "transpose_rotate_270": lambda y, x, h, w: (h - y, x),
}


def transform(df: DataFrame, name: str, width: int, height: int) -> DataFrame:
    y, x = TRANSFORMS[name](F.col("y"), F.col("x"), F.lit(height - 1), F.lit(width - 1))
    return df.withColumns({"y": y, "x": x})


def reduce2x2(df: DataFrame, value: str) -> DataFrame:
    """Rounded 2x2 means; an odd edge takes the mean of the pair that is there, as if repeated."""
    cells = df.groupBy("img", F.expr("y div 2").alias("y"), F.expr("x div 2").alias("x"))
    return cells.agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n")).select("img", "y", "x", idiv(F.col("s") * (4 / F.col("n")).cast("long") + 2, 4).alias("v"))


def decimated(df: DataFrame, value: Column) -> DataFrame:
    """Every second pixel of every second row."""
    return df.where("y % 2 = 0 and x % 2 = 0").select("img", F.expr("y div 2").alias("y"), F.expr("x div 2").alias("x"), value.alias("v"))


def stretch2x2(df: DataFrame, value: str) -> DataFrame:
    step = F.array(F.lit(0), F.lit(1))
    rows = df.select("img", "y", "x", F.col(value).alias("v"), F.explode(step).alias("dy")).select("*", F.explode(step).alias("dx"))
    return rows.select("img", (F.col("y") * 2 + F.col("dy")).alias("y"), (F.col("x") * 2 + F.col("dx")).alias("x"), "v")


def nearest(df: DataFrame, value: str, size: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    """Nearest-neighbour resampling: each source explodes to the destinations that pick it (no join)."""
    (w, h), (dw, dh) = size, to

    def picks(at: Column, n: int, dn: int) -> Column:
        """Destinations i with floor((i + 0.5) * n / dn) = at."""
        low = F.ceil(at.cast("double") * dn / n - 0.5)
        high = F.ceil((at.cast("double") + 1) * dn / n - 0.5) - 1
        return F.when(low <= high, F.sequence(F.greatest(low, F.lit(0)), F.least(high, F.lit(dn - 1))))

    rows = df.select("img", F.col(value).alias("v"), F.explode(picks(F.col("y"), h, dh)).alias("y"), F.col("x").alias("sx"))
    return rows.select("img", "y", F.explode(picks(F.col("sx"), w, dw)).alias("x"), "v")


def bilinear(df: DataFrame, value: str, size: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    """Bilinear resampling: each source sends its weighted share to the destinations it touches, one shuffle adds them up."""
    (w, h), (dw, dh) = size, to

    def shares(at: str, n: int, dn: int) -> Column:
        """Destinations that a source may touch, a superset by one on either side."""
        scale = dn / n
        low = F.floor((F.col(at) - 1).cast("double") * scale - 1)
        high = F.ceil((F.col(at) + 2).cast("double") * scale)
        return F.sequence(F.greatest(low, F.lit(0)), F.least(high, F.lit(dn - 1)))

    def weight(dst: str, src: str, n: int, dn: int) -> Column:
        pos = (F.col(dst) + F.lit(0.5)) * (n / dn) - 0.5
        pos = F.least(F.greatest(pos, F.lit(0.0)), F.lit(float(n - 1)))
        return F.greatest(1 - F.abs(pos - F.col(src)), F.lit(0.0))

    rows = df.select("img", F.col("y").alias("sy"), F.col("x").alias("sx"), F.col(value).alias("v"), F.explode(shares("y", h, dh)).alias("y"))
    rows = rows.withColumn("wy", weight("y", "sy", h, dh)).where("wy > 0")
    rows = rows.select("*", F.explode(shares("sx", w, dw)).alias("x")).withColumn("wx", weight("x", "sx", w, dw)).where("wx > 0")
    return rows.groupBy("img", "y", "x").agg(F.sum(F.col("v") * F.col("wy") * F.col("wx")).alias("v"))


REDUCE = {
    3: ([1, 2, 1], 8, 4),
    5: ([1, 4, 6, 4, 1], 128, 8),
}


def reduced_value(size: int) -> Column:
    """Value of a decimating [1 2 1] or [1 4 6 4 1] filter at a pixel with its neighbourhood columns."""
    taps, half, bits = REDUCE[size]
    out = F.lit(half)
    for i, a in enumerate(taps):
        for j, b in enumerate(taps):
            out = out + a * b * F.col(f"n{i}{j}")
    return shr(out, bits)


def area_taps(n: int, dn: int) -> list[tuple[int, int, float]]:
    """A destination is the mean of the sources it covers, the outer ones in part."""
    out = []
    for d in range(dn):
        low, high = d * n / dn, (d + 1) * n / dn
        for s in range(int(low), min(n, math.ceil(high))):
            share = min(high, s + 1) - max(low, s)
            if share > 1e-12:
                out.append((d, s, share * dn / n))
    return out


def resampled(df: DataFrame, values: list[str], taps_y: list, taps_x: list) -> DataFrame:
    """img, y, x and the weighted sums of `values`: a source goes to the destinations that its taps name, partial sums meet once."""
    spark = df.sparkSession
    table = lambda taps, k: F.broadcast(spark.createDataFrame([(d, s, float(w)) for d, s, w in taps], f"to_{k} long, {k} long, w_{k} double"))
    sent = df.select("img", "y", "x", *values).join(table(taps_y, "y"), "y").join(table(taps_x, "x"), "x")
    return sent.groupBy("img", F.col("to_y").alias("y"), F.col("to_x").alias("x")).agg(*[F.sum(F.col(v) * F.col("w_y") * F.col("w_x")).alias(v) for v in values])


def inverse_affine(m: list[Column]) -> list[Column]:
    """Columns of the inverse of the map x' = a x + b y + c, y' = d x + e y + f; null where it has none."""
    a, b, c, d, e, f = m
    det = F.nullif(a * e - b * d, F.lit(0.0))
    return [e / det, -b / det, (b * f - c * e) / det, -d / det, a / det, (c * d - a * f) / det]
