"""Element-wise operators on one or two aligned planes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import COMPARE, average, clamp, shr


def binarize(v: Column, compare: str, value: int, positive: int = 255, negative: int = 0) -> Column:
    return F.when(COMPARE[compare](v, F.lit(value)), F.lit(positive)).otherwise(F.lit(negative))


def conditional_fill(src: Column, dst: Column, compare: str, threshold: int, value: int) -> Column:
    return F.when(COMPARE[compare](src, F.lit(threshold)), F.lit(value)).otherwise(dst)


def wrap16(v: Column) -> Column:
    """Two's complement of 16 bits."""
    return F.pmod(v + 32768, F.lit(65536)) - 32768


#: name -> operation of two u8 planes.
BINARY8 = {
    "average": average,
    "and": lambda a, b: a.bitwiseAND(b),
    "or": lambda a, b: a.bitwiseOR(b),
    "maximum": lambda a, b: F.greatest(a, b),
    "minimum": lambda a, b: F.least(a, b),
    "saturated_subtraction": lambda a, b: F.greatest(a - b, F.lit(0)),
    "saturated_addition": lambda a, b: F.least(a + b, F.lit(255)),
}
BINARY16 = {"addition": lambda a, b: wrap16(a + b), "subtraction": lambda a, b: wrap16(a - b)}


def feature_difference(v: Column, lo: Column, hi: Column, weight: int) -> Column:
    """min(255, excess over [lo, hi] squared, times weight, in 16 bits)."""
    over = F.greatest(v - hi, lo - v, F.lit(0))
    return F.least(shr(over * over * weight, 16), F.lit(255))


def compensate(v: Column, shift: int) -> Column:
    return clamp(v + shift)


def change_colors(df: DataFrame, value: str, lut: DataFrame) -> DataFrame:
    """value -> lut row (v, new) of a table of at most 256 rows, which is checked before it is sent to every task."""
    if lut.limit(257).count() > 256:
        raise ValueError("a table of colours has 256 rows at most")
    return df.join(F.broadcast(lut.select(F.col("v").alias(value), F.col("new"))), value).withColumn(value, F.col("new")).drop("new")


def aligned(a: DataFrame, b: DataFrame, keys=("img", "y", "x")) -> DataFrame:
    """Two planes, pixel by pixel."""
    return a.join(b, list(keys))


# -- background range updates: one expression for each state column -----------------


def grow_slow(v: Column, lo: Column, hi: Column) -> dict[str, Column]:
    return {"lo": lo - (v < lo).cast("int"), "hi": hi + (v > hi).cast("int")}


def grow_fast(v: Column, lo: Column, hi: Column) -> dict[str, Column]:
    return {"lo": F.least(lo, v), "hi": F.greatest(hi, v)}


def increment_count(v: Column, lo: Column, hi: Column, lo_count: Column, hi_count: Column) -> dict[str, Column]:
    return {"lo_count": F.least(lo_count + (v < lo).cast("int"), F.lit(255)), "hi_count": F.least(hi_count + (v > hi).cast("int"), F.lit(255))}


def adjust_range(lo: Column, hi: Column, lo_count: Column, hi_count: Column, threshold: int) -> dict[str, Column]:
    """One step towards the count's side; both counts start anew."""

    def moved(end: Column, count: Column, out: int) -> Column:
        return clamp(end + F.when(count > threshold, F.lit(out)).when(count < threshold, F.lit(-out)).otherwise(F.lit(0)))

    return {"lo": moved(lo, lo_count, -1), "hi": moved(hi, hi_count, 1), "lo_count": F.lit(0), "hi_count": F.lit(0)}


def shift_range(v: Column, lo: Column, hi: Column) -> dict[str, Column]:
    """Slide [lo, hi] so that it holds v."""
    add = F.when(v > hi, v - hi).when(v < lo, v - lo).otherwise(F.lit(0))
    return {"lo": clamp(lo + add), "hi": clamp(hi + add)}
