"""Streaming background model: each camera's value range as state of a structured stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "lo long, hi long, n long"
OUT = "key long, seq long, lo long, hi long, moved boolean"


def _grow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    frames = pd.concat(list(batches)).sort_values("seq", kind="stable")
    lo, hi, n = state.get if state.exists else (None, None, 0)
    rows = []
    for seq, v in zip(frames["seq"], frames["v"]):
        moved = n > 0 and not lo <= v <= hi
        lo, hi, n = (v, v, 1) if n == 0 else (min(lo, v), max(hi, v), n + 1)
        rows.append((key[0], seq, lo, hi, moved))
    state.update((int(lo), int(hi), int(n)))
    yield pd.DataFrame(rows, columns=["key", "seq", "lo", "hi", "moved"])


def background_range(frames: DataFrame) -> DataFrame:
    """(key, seq, lo, hi, moved) for a stream of (key, seq, v): the fast-growing range after each frame.

    Frames of a key are taken in order of seq within a micro-batch and must not
    come after later ones; the state of a key is three numbers.
    """
    return frames.groupBy("key").applyInPandasWithState(_grow, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def windowed_statistic(frames: DataFrame, time: str, value: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Counts and sums by tumbling window; rows later than `late` behind the newest are dropped with their window's state."""
    from pyspark.sql import functions as F

    return frames.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"))
