"""Half and bfloat16 storage as column expressions, and CRC-32C, for which Spark has none."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

_POLYNOMIAL = 0x82F63B78


def _exponent(x: Column) -> Column:
    """floor(log2(x)) of x > 0, mended where the logarithm rounds."""
    e = F.floor(F.log2(x))
    return (e + F.when(F.pow(F.lit(2.0), e + 1) <= x, 1).when(F.pow(F.lit(2.0), e) > x, -1).otherwise(0)).cast("long")


def _signed(v: Column, magnitude: Column) -> Column:
    return magnitude + F.when(v < 0, F.lit(0x8000)).otherwise(F.lit(0))


def float16_bits(v: Column) -> Column:
    """IEEE half bits of a float, rounded to the nearest and ties to even; beyond the largest half infinity."""
    v = v.cast("float").cast("double")
    x = F.abs(v)
    e = F.greatest(_exponent(F.greatest(x, F.lit(2.0**-30))), F.lit(-14))
    # a mantissa that rounds up to 2048 carries into the exponent by itself
    bits = (e + 14) * 1024 + F.rint(x * F.pow(F.lit(2.0), 10 - e)).cast("long")
    return _signed(v, F.least(bits, F.lit(0x7C00)))


def float16(bits: Column) -> Column:
    """The value of finite half bits."""
    e, m = F.shiftright(bits % 32768, 10), (bits % 1024).cast("double")
    x = F.when(e == 0, m * 2.0**-24).otherwise((m + 1024) * F.pow(F.lit(2.0), e - 25))
    return F.when(bits >= 32768, -x).otherwise(x)


def bfloat16_bits(v: Column) -> Column:
    """Upper half of a normal float's bits, rounded to the nearest and ties to even."""
    v = v.cast("float").cast("double")
    x = F.abs(v)
    e = _exponent(F.greatest(x, F.lit(2.0**-126)))
    return F.when(x == 0, F.lit(0)).otherwise(_signed(v, (e + 126) * 128 + F.rint(x * F.pow(F.lit(2.0), 7 - e)).cast("long")))


def bfloat16(bits: Column) -> Column:
    """The value of the bits of a normal bfloat16 or of zero."""
    e, m = F.shiftright(bits % 32768, 7), (bits % 128).cast("double")
    x = F.when(e == 0, F.lit(0.0)).otherwise((m + 128) * F.pow(F.lit(2.0), e - 134))
    return F.when(bits >= 32768, -x).otherwise(x)


def _crc_table() -> list[int]:
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (_POLYNOMIAL if n & 1 else 0)
        table.append(n)
    return table


_CRC = np.array(_crc_table(), np.uint32)


def crc32c_of(strings: list[bytes]) -> np.ndarray:
    """CRC-32C of many byte strings at once: byte i of all of them in one step."""
    size = np.array([len(s) for s in strings], np.int64)
    order = np.argsort(-size, kind="stable")
    raw = np.frombuffer(b"".join(strings), np.uint8)
    begin = (np.cumsum(size) - size)[order]
    crc = np.full(len(strings), 0xFFFFFFFF, np.uint32)
    longest_first = size[order]
    for i in range(int(size.max(initial=0))):
        n = int(np.searchsorted(-longest_first, -i, "left"))  # strings longer than i
        crc[:n] = _CRC[(crc[:n] ^ raw[begin[:n] + i]) & 255] ^ (crc[:n] >> np.uint32(8))
    out = np.empty_like(crc)
    out[order] = ~crc
    return out


@F.pandas_udf(LongType())
def crc32c(v: pd.Series) -> pd.Series:
    return pd.Series(crc32c_of([bytes(b) if b is not None else b"" for b in v]).astype(np.int64))
