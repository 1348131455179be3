"""Frames of pixel formats, and routes from any format to any other over direct conversions.

A frame is a relation of full-size samples, one column a channel, and, where
chroma has half the size, a second one.  Conversions between formats of one size
are projections; chroma is spread by a join and averaged by one aggregate.  A
route is the shortest chain of direct conversions.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color as C
from ..functions.numeric import clamp, shr

KEY = ["img", "y", "x"]
#: Format -> channels of full size, whether chroma u, v has half the size.
FORMATS: dict[str, tuple[tuple[str, ...], bool]] = {
    "gray": (("gray",), False),
    "bgr": (("b", "g", "r"), False),
    "rgb": (("r", "g", "b"), False),
    "bgra": (("b", "g", "r", "a"), False),
    "rgba": (("r", "g", "b", "a"), False),
    "yuv444p": (("luma", "u", "v"), False),
    "yuv420p": (("luma",), True),
    "nv12": (("luma",), True),
}


@dataclass
class Frame:
    """full: img, y, x and the format's channels; half: img, y, x, u, v or None; standard names the luma weights and ranges."""

    format: str
    full: DataFrame
    half: DataFrame | None = None
    standard: str = "bt601"

    def planes(self) -> DataFrame:
        """img, plane, y, x, v: as the format lays its samples out; plane `uv` of nv12 holds both in turn along a row."""
        channels, half = FORMATS[self.format]
        rows = lambda df, names, x: df.select("img", "y", "x", F.explode(F.array(*[F.struct(F.lit(n).alias("plane"), F.lit(k).alias("k"), F.col(n).cast("long").alias("v")) for k, n in enumerate(names)])).alias("s")).select("img", F.col("s.plane").alias("plane"), "y", x.alias("x"), F.col("s.v").alias("v"))
        out = rows(self.full, channels, F.col("x"))
        if not half:
            return out
        if self.format == "nv12":
            return out.unionByName(rows(self.half, ("u", "v"), F.col("x") * 2 + F.col("s.k")).withColumn("plane", F.lit("uv")))
        return out.unionByName(rows(self.half, ("u", "v"), F.col("x")))

    @staticmethod
    def of(format: str, planes: DataFrame, standard: str = "bt601") -> Frame:
        """A frame from the planes (img, plane, y, x, v) of its format."""
        channels, half = FORMATS[format]
        pick = lambda df, names: df.groupBy(*KEY).agg(*[F.max(F.when(F.col("plane") == n, F.col("v"))).alias(n) for n in names])
        full = pick(planes.where(F.col("plane").isin(*channels)), channels)
        if not half:
            return Frame(format, full, None, standard)
        chroma = planes.where("plane in ('u', 'v', 'uv')")
        if format == "nv12":
            chroma = chroma.select("img", F.when(F.col("x") % 2 == 0, "u").otherwise("v").alias("plane"), "y", F.expr("x div 2").alias("x"), "v")
        return Frame(format, full, pick(chroma, ("u", "v")), standard)


def _project(to: str, columns: Callable[[str], dict[str, Column]]) -> Callable[[Frame], Frame]:
    return lambda f: Frame(to, f.full.select(*KEY, *[v.alias(k) for k, v in columns(f.standard).items()]), None, f.standard)


def _same(to: str, *extra: str) -> Callable[[Frame], Frame]:
    """The channels of `to` in its order; alpha is opaque where the source has none."""
    return _project(to, lambda _: {k: F.lit(255) if k in extra else F.col(k) for k in FORMATS[to][0]})


def _stretched(f: Frame) -> Frame:
    cell = f.half.select("img", F.col("y").alias("cy"), F.col("x").alias("cx"), "u", "v")
    own = f.full.withColumns({"cy": F.expr("y div 2"), "cx": F.expr("x div 2")})
    return Frame("yuv444p", own.join(cell, ["img", "cy", "cx"]).select(*KEY, "luma", "u", "v"), None, f.standard)


def _cells(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Rounded means over 2 x 2 pixels, of those that are there at an odd edge."""
    mean = lambda k: F.expr(f"(2 * sum({k}) + count(*)) div (2 * count(*))").alias(k)
    return df.groupBy("img", F.expr("y div 2").alias("y"), F.expr("x div 2").alias("x")).agg(*[mean(k) for k in names])


def _halved_colour(f: Frame) -> Frame:
    yuv = lambda: C.bgr_to_yuv(F.col("b"), F.col("g"), F.col("r"), f.standard)
    return Frame("yuv420p", f.full.select(*KEY, yuv()["y"].alias("luma")), _cells(f.full, ("b", "g", "r")).select(*KEY, yuv()["u"].alias("u"), yuv()["v"].alias("v")), f.standard)


def _gray_luma(standard: str) -> Column:
    return F.col("gray") if standard == "trect871" else clamp(shr(219 * F.col("gray") + 128, 8) + 16, 16, 235)


def _luma_gray(standard: str) -> dict[str, Column]:
    return {"gray": F.col("luma") if standard == "trect871" else clamp(shr(298 * (clamp(F.col("luma"), 16, 235) - 16) + 128, 8))}


def _gray_halved(f: Frame) -> Frame:
    half = f.full.where("y % 2 = 0 and x % 2 = 0").select("img", F.expr("y div 2").alias("y"), F.expr("x div 2").alias("x"), F.lit(128).alias("u"), F.lit(128).alias("v"))
    return Frame("yuv420p", f.full.select(*KEY, _gray_luma(f.standard).alias("luma")), half, f.standard)


def _colour(standard: str) -> dict[str, Column]:
    return C.yuv_to_bgr(F.col("luma"), F.col("u"), F.col("v"), standard)


def _yuv(standard: str) -> dict[str, Column]:
    found = C.bgr_to_yuv(F.col("b"), F.col("g"), F.col("r"), standard)
    return {"luma": found["y"], "u": found["u"], "v": found["v"]}


#: (from, to) -> conversion.
DIRECT: dict[tuple[str, str], Callable[[Frame], Frame]] = {
    ("nv12", "yuv420p"): lambda f: Frame("yuv420p", f.full, f.half, f.standard),
    ("yuv420p", "nv12"): lambda f: Frame("nv12", f.full, f.half, f.standard),
    ("yuv420p", "yuv444p"): _stretched,
    ("yuv444p", "yuv420p"): lambda f: Frame("yuv420p", f.full.select(*KEY, "luma"), _cells(f.full, ("u", "v")), f.standard),
    ("yuv420p", "gray"): _project("gray", _luma_gray),
    ("yuv444p", "gray"): _project("gray", _luma_gray),
    ("yuv444p", "bgr"): _project("bgr", _colour),
    ("bgr", "yuv444p"): _project("yuv444p", _yuv),
    ("bgr", "yuv420p"): _halved_colour,
    ("bgr", "gray"): _project("gray", lambda _: {"gray": C.gray(F.col("b"), F.col("g"), F.col("r"))}),
    ("gray", "bgr"): _project("bgr", lambda _: dict.fromkeys("bgr", F.col("gray"))),
    ("gray", "yuv444p"): _project("yuv444p", lambda s: {"luma": _gray_luma(s), "u": F.lit(128), "v": F.lit(128)}),
    ("gray", "yuv420p"): _gray_halved,
    ("bgr", "rgb"): _same("rgb"),
    ("rgb", "bgr"): _same("bgr"),
    ("bgr", "bgra"): _same("bgra", "a"),
    ("bgr", "rgba"): _same("rgba", "a"),
    ("bgra", "bgr"): _same("bgr"),
    ("rgba", "bgr"): _same("bgr"),
    ("bgra", "rgba"): _same("rgba"),
    ("rgba", "bgra"): _same("bgra"),
}


def route(source: str, to: str) -> list[str]:
    """Formats of the shortest chain of direct conversions, both ends included."""
    if source not in FORMATS or to not in FORMATS:
        raise ValueError(f"no route from {source} to {to}")
    before, todo = {source: None}, deque([source])
    while todo:
        at = todo.popleft()
        for a, b in DIRECT:
            if a == at and b not in before:
                before[b] = a
                todo.append(b)
    chain = [to]
    while before[chain[-1]] is not None:
        chain.append(before[chain[-1]])
    return chain[::-1]


def convert(frame: Frame, to: str) -> Frame:
    """The frame in another format."""
    steps = route(frame.format, to)
    for a, b in zip(steps, steps[1:]):
        frame = DIRECT[a, b](frame)
    return frame
