"""Integer and float rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shr(v: Column, n: int) -> Column:
    """Arithmetic shift right."""
    return F.shiftright(v, n)


def idiv(a: Column, b: Column | int) -> Column:
    """Integer division truncating towards zero."""
    b = F.lit(b) if isinstance(b, int) else b
    q = F.floor(F.abs(a) / F.abs(b)).cast("long")
    return F.when((a < 0) != (b < 0), -q).otherwise(q)


def clamp(v: Column, low=0, high=255) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def average(a: Column, b: Column) -> Column:
    return shr(a + b + 1, 1)


def average4(a: Column, b: Column, c: Column, d: Column) -> Column:
    return shr(a + b + c + d + 2, 2)


def div255(v: Column) -> Column:
    """v / 255 for v in 0..65025."""
    return shr(v + 1 + shr(v, 8), 8)


def blend(src: Column, dst: Column, alpha: Column) -> Column:
    return div255(src * alpha + dst * (255 - alpha))


#: name -> predicate of the six compare types.
COMPARE = {
    "eq": lambda a, b: a == b,
    "ne": lambda a, b: a != b,
    "gt": lambda a, b: a > b,
    "ge": lambda a, b: a >= b,
    "lt": lambda a, b: a < b,
    "le": lambda a, b: a <= b,
}
COMPARE_SQL = {"eq": "=", "ne": "<>", "gt": ">", "ge": ">=", "lt": "<", "le": "<="}
