"""Queries of routes between frame formats, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import PIXELS_SQL as P
from ..model import pixels
from ..operators.frames import FORMATS, Frame, convert
from .images import _backward_sql, _forward_sql, clamp_sql

QUERIES: dict = {}
SQL: dict = {}
c = F.col
#: Where the channels of a full-size format come from; chroma of half the size is that of its cell's first pixel.
SOURCE = {"gray": "a", "b": "a", "g": "b", "r": "c", "a": "al", "luma": "a", "u": "b", "v": "c"}


def frame(spark, sf_dir, format: str) -> Frame:
    """The pixel planes taken as a frame of a format, by way of its planes."""
    p = pixels(spark, sf_dir)
    channels, half = FORMATS[format]
    long = lambda df, names: df.select("img", "y", "x", F.explode(F.array(*[F.struct(F.lit(n).alias("plane"), c(SOURCE[n]).alias("v")) for n in names])).alias("s")).select("img", "s.plane", "y", "x", "s.v")
    planes = long(p, channels)
    if half:
        chroma = p.where("y % 2 = 0 and x % 2 = 0").select("img", F.expr("y div 2").alias("y"), F.expr("x div 2").alias("x"), "b", "c")
        chroma = long(chroma, ("u", "v"))
        if format == "nv12":
            chroma = chroma.select("img", F.lit("uv").alias("plane"), "y", (2 * c("x") + (c("plane") == "v").cast("int")).alias("x"), "v")
        planes = planes.unionByName(chroma)
    return Frame.of(format, planes)


_HALF = "h AS (SELECT img, y // 2 AS y, x // 2 AS x, b, c FROM p WHERE y % 2 = 0 AND x % 2 = 0), w AS (SELECT p.img, p.y, p.x, p.a, h.b, h.c FROM p JOIN h ON h.img = p.img AND h.y = p.y // 2 AND h.x = p.x // 2)"
_MEAN = "m AS (SELECT img, y // 2 AS y, x // 2 AS x, " + ", ".join(f"(2 * CAST(sum({k}) AS BIGINT) + count(*)) // (2 * count(*)) AS {k}" for k in "abc") + " FROM p GROUP BY 1, 2, 3)"


def _union(parts: list[tuple[str, str, str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT img, '{plane}' AS plane, y, {x} AS x, CAST({v} AS BIGINT) AS v FROM {source}" for plane, x, v, source in parts)


_B, _F = _backward_sql("bt601"), _forward_sql("bt601")
_TO_Y = clamp_sql("((219 * a + 128) >> 8) + 16", 16, 235)
_TO_GRAY = clamp_sql(f"(298 * ({clamp_sql('a', 16, 235)} - 16) + 128) >> 8")
_ROUTES = {
    ("nv12", "rgba"): [*((k, "x", _B[k], "w") for k in "rgb"), ("a", "x", "255", "w")],
    ("nv12", "yuv444p"): [("luma", "x", "a", "w"), ("u", "x", "b", "w"), ("v", "x", "c", "w")],
    ("nv12", "gray"): [("gray", "x", _TO_GRAY, "p")],
    ("yuv420p", "bgr"): [(k, "x", _B[k], "w") for k in "bgr"],
    ("rgb", "nv12"): [("luma", "x", _F["y"], "p"), ("uv", "2 * x", _F["u"], "m"), ("uv", "2 * x + 1", _F["v"], "m")],
    ("bgra", "yuv444p"): [("luma", "x", _F["y"], "p"), ("u", "x", _F["u"], "p"), ("v", "x", _F["v"], "p")],
    ("gray", "nv12"): [("luma", "x", _TO_Y, "p"), ("uv", "2 * x", "128", "h"), ("uv", "2 * x + 1", "128", "h")],
    ("yuv444p", "nv12"): [("luma", "x", "a", "p"), ("uv", "2 * x", "b", "m"), ("uv", "2 * x + 1", "c", "m")],
    ("rgba", "bgra"): [("b", "x", "a", "p"), ("g", "x", "b", "p"), ("r", "x", "c", "p"), ("a", "x", "al", "p")],
}
for (_from, _to), _parts in _ROUTES.items():
    QUERIES[f"frame_route_{_from}_to_{_to}"] = lambda s, d, a=_from, b=_to: convert(frame(s, d, a), b).planes()
    SQL[f"frame_route_{_from}_to_{_to}"] = f"WITH {P}, {_HALF}, {_MEAN} {_union(_parts)}"
