"""Neighbourhood operators over columns n<dy><dx> made by model.neighbourhood()."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clamp, idiv, shr
from ..model import around


def weighted(weights: list[list[int]], prefix: str = "n") -> Column:
    out = F.lit(0)
    for i, row in enumerate(weights):
        for j, w in enumerate(row):
            if w:
                out = out + w * F.col(f"{prefix}{i}{j}")
    return out


SOBEL_DX = [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]
SOBEL_DY = [[-1, -2, -1], [0, 0, 0], [1, 2, 1]]
LAPLACE = [[-1, -1, -1], [-1, 8, -1], [-1, -1, -1]]
GAUSS3 = [[1, 2, 1], [2, 4, 2], [1, 2, 1]]


def sobel_dx() -> Column:
    return weighted(SOBEL_DX)


def sobel_dy() -> Column:
    return weighted(SOBEL_DY)


def laplace() -> Column:
    return weighted(LAPLACE)


def gauss3() -> Column:
    return shr(weighted(GAUSS3) + 8, 4)


def mean3() -> Column:
    return shr((weighted([[1] * 3] * 3) + 5) * 7281, 16)


def contour_metric() -> Column:
    """Twice the sum of absolute gradients, with the steeper direction in the last bit."""
    dx, dy = F.abs(sobel_dx()), F.abs(sobel_dy())
    return (dx + dy) * 2 + F.when(dx >= dy, F.lit(0)).otherwise(F.lit(1))


def median(columns: list[Column]) -> Column:
    return F.get(F.array_sort(F.array(*columns)), F.lit(len(columns) // 2))


def rhomb(radius: int) -> list[Column]:
    return [F.col(f"n{i}{j}") for i in range(2 * radius + 1) for j in range(2 * radius + 1) if abs(i - radius) + abs(j - radius) <= radius]


def midpoint(radius: int) -> Column:
    n = around(radius)
    return idiv(F.greatest(*n) + F.least(*n) + 1, 2)


def voted(radius: int, threshold: int, top: bool) -> Column:
    """The extreme of the square where `threshold` samples have it, else the centre."""
    n = around(radius)
    best = F.greatest(*n) if top else F.least(*n)
    votes = sum((F.when(c == best, F.lit(1)).otherwise(F.lit(0)) for c in n), F.lit(0))
    return F.when(votes >= threshold, best).otherwise(F.col(f"n{radius}{radius}"))


def inner(width: int, height: int) -> Column:
    return (F.col("x") > 0) & (F.col("y") > 0) & (F.col("x") < width - 1) & (F.col("y") < height - 1)


def lbp(width: int, height: int) -> Column:
    """Local binary pattern, clockwise from the upper left; 0 on the border."""
    order = ["n00", "n01", "n02", "n12", "n22", "n21", "n20", "n10"]
    bits = sum((F.when(F.col(c) >= F.col("n11"), F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(order)), F.lit(0))
    return F.when(inner(width, height), bits).otherwise(F.lit(0))


def gradient_sum(width: int, height: int) -> Column:
    """min(255, |dx| + |dy|) of central differences; 0 on the border."""
    return F.when(inner(width, height), F.least(F.abs(F.col("n12") - F.col("n10")) + F.abs(F.col("n21") - F.col("n01")), F.lit(255))).otherwise(F.lit(0))


def boosted_gradient(saturation: int, boost: int, width: int, height: int) -> dict[str, Column]:
    g = lambda hi, lo: F.when(inner(width, height), (saturation + clamp(F.col(hi) - F.col(lo), -saturation, saturation)) * boost).otherwise(F.lit(0))
    return {"dx": g("n12", "n10"), "dy": g("n21", "n01")}


def integral(df: DataFrame, value: str, out: str = "s") -> DataFrame:
    """Inclusive summed-area table by two cumulative windows after one shuffle on img."""
    row = Window.partitionBy("img", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    column = Window.partitionBy("img", "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    return df.repartition("img").withColumn("_row", F.sum(value).over(row)).withColumn(out, F.sum("_row").over(column)).drop("_row")


def box(df: DataFrame, value: str, half: int, total: str, area: str) -> DataFrame:
    """Sums and pixel counts of (2 half + 1) squares clipped at the edges."""
    row = Window.partitionBy("img", "y").orderBy("x").rowsBetween(-half, half)
    column = Window.partitionBy("img", "x").orderBy("y").rowsBetween(-half, half)
    out = df.repartition("img").withColumn("_s", F.sum(value).over(row)).withColumn("_n", F.count(F.lit(1)).over(row))
    return out.withColumn(total, F.sum("_s").over(column)).withColumn(area, F.sum("_n").over(column)).drop("_s", "_n")
