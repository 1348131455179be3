"""Queries of resampling, warping, gradients and filters, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clamp, shr
from ..model import HEIGHT as H
from ..model import PIXELS_SQL as P
from ..model import WIDTH as W
from ..model import neighbourhood, neighbourhood_sql, pack, pixels, table, unpack
from ..operators import packed
from ..operators import stencil as S
from ..operators.cascade import integral_corners
from ..operators.geometry import area_taps, inverse_affine, resampled

QUERIES: dict = {}
SQL: dict = {}
c = F.col
KEY = ["img", "y", "x"]
_N1 = ", " + neighbourhood_sql("a", 1)


def add(name: str, sql: str | None, tail: str = ""):
    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(pixels(spark, sf_dir))
        if sql is not None:
            SQL[name] = f"WITH {P}{tail} {sql}"
        return f

    return put


# -- separable resampling ----------------------------------------------------------------------------
# The weights of an axis are a table of (destination, source, weight), as long as the axis: small by its nature.


#: Bits of a cubic weight.
CUBIC_BITS = 7


def cubic_taps(n: int, dn: int) -> list[tuple[int, int, int]]:
    """Four sources of a cubic through them, with integer weights; beyond the border the nearest source."""
    out = []
    for d in range(dn):
        place = (d + 0.5) * n / dn - 0.5
        at = min(max(math.floor(place), 0), n - 2)
        t = min(max(place - at, 0.0), 1.0)
        weights = ((t - 2) * (1 - t) * t / 6, (2 - t) * (t + 1) * (1 - t) / 2, (2 - t) * (t + 1) * t / 2, -(1 + t) * (1 - t) * t / 6)
        for k, w in enumerate(weights):
            out.append((d, min(max(at - 1 + k, 0), n - 1), round(w * (1 << CUBIC_BITS))))
    return out


_AREA_AXIS = "(SELECT d, s, (least((d + 1) * {n} / {dn}::DOUBLE, s + 1) - greatest(d * {n} / {dn}::DOUBLE, s)) * {dn} / {n} AS w FROM (SELECT unnest(range({dn})) AS d), (SELECT unnest(range({n})) AS s) WHERE least((d + 1) * {n} / {dn}::DOUBLE, s + 1) - greatest(d * {n} / {dn}::DOUBLE, s) > 1e-12)"
for _name, (_dw, _dh) in {"33x17": (33, 17), "25x15": (25, 15), "16x10": (16, 10)}.items():
    _from = f"FROM p JOIN {_AREA_AXIS.format(n=H, dn=_dh)} j ON j.s = p.y JOIN {_AREA_AXIS.format(n=W, dn=_dw)} i ON i.s = p.x GROUP BY 1, 2, 3"
    add(f"resize_area_{_name}", "SELECT p.img, j.d AS y, i.d AS x, " + ", ".join(f"round(sum({v} * j.w * i.w), 4) AS {v}" for v in "abc") + " " + _from)(
        lambda p, dw=_dw, dh=_dh: resampled(p, list("abc"), area_taps(H, dh), area_taps(W, dw)).select(*KEY, *[F.round(v, 4).alias(v) for v in "abc"])
    )
_POS = "(SELECT d, least(greatest(floor((d + 0.5::DOUBLE) * {n} / {dn} - 0.5::DOUBLE), 0), {n} - 2) AS base, (d + 0.5::DOUBLE) * {n} / {dn} - 0.5::DOUBLE AS pos FROM (SELECT unnest(range({dn})) AS d))"
_CUBIC = "(SELECT d, CAST(least(greatest(base - 1 + k, 0), {n} - 1) AS BIGINT) AS s, CAST(round_even(128 * CASE k WHEN 0 THEN (t - 2) * (1 - t) * t / 6 WHEN 1 THEN (2 - t) * (t + 1) * (1 - t) / 2 WHEN 2 THEN (2 - t) * (t + 1) * t / 2 ELSE -(1 + t) * (1 - t) * t / 6 END, 0) AS BIGINT) AS w FROM (SELECT d, base, least(greatest(pos - base, 0::DOUBLE), 1::DOUBLE) AS t FROM {pos}), (SELECT unnest(range(4)) AS k))"
for _name, (_dw, _dh) in {"33x17": (33, 17), "80x44": (80, 44)}.items():
    _j, _i = (_CUBIC.format(n=n, pos=_POS.format(n=n, dn=dn)) for n, dn in ((H, _dh), (W, _dw)))
    add(f"resize_bicubic_{_name}", f"SELECT p.img, j.d AS y, i.d AS x, " + ", ".join(f"least(greatest((CAST(sum({v} * j.w * i.w) AS BIGINT) + 8192) >> 14, 0), 255) AS {v}" for v in "abc") + f" FROM p JOIN {_j} j ON j.s = p.y JOIN {_i} i ON i.s = p.x GROUP BY 1, 2, 3")(
        lambda p, dw=_dw, dh=_dh: resampled(p, list("abc"), cubic_taps(H, dh), cubic_taps(W, dw)).select(*KEY, *[clamp(shr(c(v).cast("long") + 8192, 14)).alias(v) for v in "abc"])
    )
add("reduce_color_2x2", "SELECT img, y // 2 AS y, x // 2 AS x, " + ", ".join(f"(CAST(sum({v}) AS BIGINT) + 2) >> 2 AS {v}" for v in "abc") + " FROM p GROUP BY 1, 2, 3")(
    lambda p: p.groupBy("img", F.expr("y div 2").alias("y"), F.expr("x div 2").alias("x")).agg(*[shr(F.sum(v) + 2, 2).alias(v) for v in "abc"])
)

# -- warping with four taps ---------------------------------------------------------------------------

_WARP = (0.75, -0.25, 3.0, 0.25, 0.75, -2.0)
BORDER = 11


def warp_bilinear(df: DataFrame, value: str, inverse: tuple[float, ...], border: int) -> DataFrame:
    """Affine warp: a destination's four source taps meet them by an equi-join; taps outside have the border value."""
    a, b, e, d, f, g = inverse
    sx, sy = c("x") * a + c("y") * b + F.lit(e), c("x") * d + c("y") * f + F.lit(g)
    at = df.select(*KEY, F.floor(sy).alias("iy"), F.floor(sx).alias("ix"), (sy - F.floor(sy)).alias("fy"), (sx - F.floor(sx)).alias("fx"))
    taps = F.array(*[F.struct((c("iy") + i).alias("sy"), (c("ix") + j).alias("sx"), ((c("fy") if i else 1 - c("fy")) * (c("fx") if j else 1 - c("fx"))).alias("w")) for i in (0, 1) for j in (0, 1)])
    sent = at.select(*KEY, F.explode(taps).alias("t")).select(*KEY, "t.*")
    source = df.select("img", c("y").alias("sy"), c("x").alias("sx"), c(value).alias("v"))
    return sent.join(source, ["img", "sy", "sx"], "left").groupBy(*KEY).agg(F.round(F.sum(F.coalesce("v", F.lit(border)) * c("w")), 4).alias("v"))


_SX, _SY = "(x * 0.75::DOUBLE + y * -0.25::DOUBLE + 3.0::DOUBLE)", "(x * 0.25::DOUBLE + y * 0.75::DOUBLE + -2.0::DOUBLE)"
add(
    "warp_affine_bilinear",
    f"SELECT t.img, t.y, t.x, round(sum(coalesce(q.a, {BORDER}) * CASE i WHEN 0 THEN 1 - fy ELSE fy END * CASE j WHEN 0 THEN 1 - fx ELSE fx END), 4) AS v FROM t LEFT JOIN p AS q ON q.img = t.img AND q.y = t.iy + i AND q.x = t.ix + j GROUP BY 1, 2, 3",
    f", t AS (SELECT img, y, x, CAST(floor({_SY}) AS BIGINT) AS iy, CAST(floor({_SX}) AS BIGINT) AS ix, {_SY} - floor({_SY}) AS fy, {_SX} - floor({_SX}) AS fx, i, j FROM p, (VALUES (0), (1)) AS r(i), (VALUES (0), (1)) AS k(j))",
)(lambda p: warp_bilinear(p, "a", _WARP, BORDER))


def _inverse(spark, sf_dir) -> DataFrame:
    """The inverse of each matrix of 2 x 3 that the first six numbers of an embedding give; null where there is none."""
    m = [F.get("embedding", F.lit(k)).cast("double") for k in range(6)]
    return table(spark, sf_dir, "embeddings").select("vec_id", *[F.round(v, 4).alias(f"m{k}") for k, v in enumerate(inverse_affine(m))])


QUERIES["invert_affine_transform"] = _inverse
_M6 = "(SELECT vec_id, " + ", ".join(f"embedding[{k + 1}]::DOUBLE AS {v}" for k, v in enumerate("abcdef")) + " FROM embeddings)"
SQL["invert_affine_transform"] = f"SELECT vec_id, round(e / d0, 4) AS m0, round(-b / d0, 4) AS m1, round((b * f - c * e) / d0, 4) AS m2, round(-d / d0, 4) AS m3, round(a / d0, 4) AS m4, round((c * d - a * f) / d0, 4) AS m5 FROM (SELECT *, nullif(a * e - b * d, 0) AS d0 FROM {_M6})"


# -- shifts by a fraction of a pixel --------------------------------------------------------------------

#: Sixteenths of a pixel.
_IDX, _FDX, _IDY, _FDY = 2, 5, -3, 11


def shift_bilinear(df: DataFrame, value: str, background: str) -> DataFrame:
    """A frame moved by (IDX + FDX / 16, IDY + FDY / 16): a source goes to the four destinations it has a share in; what no source reaches is background."""
    taps = F.array(*[F.struct((c("y") - _IDY - i).alias("y"), (c("x") - _IDX - j).alias("x"), F.lit((_FDY if i else 16 - _FDY) * (_FDX if j else 16 - _FDX)).cast("long").alias("w")) for i in (0, 1) for j in (0, 1)])
    sent = df.select("img", c(value).alias("v"), F.explode(taps).alias("t")).select("img", "t.y", "t.x", (c("v") * c("t.w")).alias("s"), "t.w")
    own = df.select(*KEY, c(background).alias("bkg"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("w"))
    met = own.unionByName(sent.where(f"y between 0 and {H - 1} and x between 0 and {W - 1}").select(*KEY, F.lit(None).cast("long").alias("bkg"), "s", "w"))
    met = met.groupBy(*KEY).agg(F.max("bkg").alias("bkg"), F.sum("s").alias("s"), F.sum("w").alias("w"))
    return met.select(*KEY, shr(c("s") + (256 - c("w")) * c("bkg") + 128, 8).alias("v"))


add(
    "shift_bilinear",
    f"SELECT p.img, p.y, p.x, (CAST(coalesce(sum(q.a * w), 0) + (256 - coalesce(sum(CASE WHEN q.a IS NULL THEN 0 ELSE w END), 0)) * any_value(p.b) AS BIGINT) + 128) >> 8 AS v FROM p CROSS JOIN k LEFT JOIN p AS q ON q.img = p.img AND q.y = p.y + {_IDY} + k.i AND q.x = p.x + {_IDX} + k.j GROUP BY 1, 2, 3",
    f", k AS (SELECT i, j, CASE i WHEN 0 THEN {16 - _FDY} ELSE {_FDY} END * CASE j WHEN 0 THEN {16 - _FDX} ELSE {_FDX} END AS w FROM (VALUES (0), (1)) AS r(i), (VALUES (0), (1)) AS s(j))",
)(lambda p: shift_bilinear(p, "a", "b"))

# -- tilted and squared sums ------------------------------------------------------------------------------


def integrals(p: DataFrame) -> DataFrame:
    """img, y, x, s, sq, tilted: sums above and left of a corner, of values, squares, and of the triangle that opens upwards from it."""
    found = integral_corners(p.select(*KEY, "a"), "a").where("y > 0 and x > 0")
    return found.select(*KEY, "s", "sq", c("t").alias("tilted"))


add(
    "integral_tilted",
    f"SELECT g.img, g.y, g.x, g.s, g.sq, CAST(sum(q.a) AS BIGINT) AS tilted FROM g JOIN p AS q ON q.img = g.img AND q.y < g.y AND abs(q.x + 1 - g.x) < g.y - q.y WHERE g.img IN (SELECT img FROM p) GROUP BY 1, 2, 3, 4, 5",
    ", g1 AS (SELECT *, sum(a) OVER r AS ra, sum(a * a) OVER r AS rb FROM p WINDOW r AS (PARTITION BY img, y ORDER BY x)), g AS (SELECT img, y + 1 AS y, x + 1 AS x, CAST(sum(ra) OVER k AS BIGINT) AS s, CAST(sum(rb) OVER k AS BIGINT) AS sq FROM g1 WINDOW k AS (PARTITION BY img, x ORDER BY y))",
)(integrals)

# -- contour anchors --------------------------------------------------------------------------------------

_STEP, _THRESHOLD = 2, 3


def anchors(p: DataFrame) -> DataFrame:
    """255 where a contour metric tops its neighbours across the steeper direction by the threshold, on every STEP-th row; else 0."""
    metric = neighbourhood(p.select(*KEY, "a"), "a", 1).select(*KEY, S.contour_metric().alias("s"))
    n = neighbourhood(metric, "s", 1)
    half = lambda k: shr(c(k), 1)
    across = c("s") % 2 == 1
    one, two = F.when(across, half("n12")).otherwise(half("n21")), F.when(across, half("n10")).otherwise(half("n01"))
    top = (half("s") > 0) & (half("s") - one >= _THRESHOLD) & (half("s") - two >= _THRESHOLD)
    return n.select(*KEY, F.when(S.inner(W, H) & ((c("y") - 1) % _STEP == 0) & top, 255).otherwise(0).cast("long").alias("v"))


_GX, _GY = "abs(n02 + 2 * n12 + n22 - n00 - 2 * n10 - n20)", "abs(n20 + 2 * n21 + n22 - n00 - 2 * n01 - n02)"
add(
    "contour_anchors",
    f"SELECT m.img, m.y, m.x, CAST(CASE WHEN m.x BETWEEN 1 AND {W - 2} AND m.y BETWEEN 1 AND {H - 2} AND (m.y - 1) % {_STEP} = 0 AND m.s // 2 > 0 AND m.s // 2 - f.s // 2 >= {_THRESHOLD} AND m.s // 2 - b.s // 2 >= {_THRESHOLD} THEN 255 ELSE 0 END AS BIGINT) AS v FROM m LEFT JOIN m AS f ON f.img = m.img AND f.y = m.y + 1 - m.s % 2 AND f.x = m.x + m.s % 2 LEFT JOIN m AS b ON b.img = m.img AND b.y = m.y - 1 + m.s % 2 AND b.x = m.x - m.s % 2",
    _N1 + f", m AS (SELECT img, y, x, ({_GX} + {_GY}) * 2 + CASE WHEN {_GX} >= {_GY} THEN 0 ELSE 1 END AS s FROM n)",
)(anchors)

# -- histograms of oriented gradients ------------------------------------------------------------------------

CELL, BINS = 10, 8


def directions(p: DataFrame) -> DataFrame:
    """img, cy, cx, bin, v: gradient lengths by direction, shared among the four nearest cells; a pixel is a projection and its shares meet in one shuffle."""
    n = neighbourhood(p.select(*KEY, "a"), "a", 1).where(S.inner(W, H))
    dx, dy, half = c("n12") - c("n10"), c("n21") - c("n01"), BINS // 2
    dots = [F.round(F.lit(math.cos(k * math.pi / half)) * dx + F.lit(math.sin(k * math.pi / half)) * dy, 6) for k in range(half)]
    best = F.array_max(F.array(*[F.struct(F.greatest(d, -d).alias("dot"), F.lit(-k).alias("first"), F.when(d >= 0, k).otherwise(k + half).alias("bin")) for k, d in enumerate(dots)]))
    n = n.select(*KEY, F.when((dx == 0) & (dy == 0), 0).otherwise(best["bin"]).alias("bin"), F.sqrt((dx * dx + dy * dy).cast("double")).alias("v"))
    py, px = (c("y") + 0.5) / CELL - 0.5, (c("x") + 0.5) / CELL - 0.5
    n = n.withColumns({"iy": F.floor(py), "ix": F.floor(px), "fy": py - F.floor(py), "fx": px - F.floor(px)})
    cells = F.array(*[F.struct((c("iy") + i).alias("cy"), (c("ix") + j).alias("cx"), ((c("fy") if i else 1 - c("fy")) * (c("fx") if j else 1 - c("fx"))).alias("w")) for i in (0, 1) for j in (0, 1)])
    sent = n.select("img", "bin", "v", F.explode(cells).alias("t")).where(f"t.cy between 0 and {H // CELL - 1} and t.cx between 0 and {W // CELL - 1}")
    return sent.groupBy("img", "t.cy", "t.cx", "bin").agg(F.sum(c("v") * c("t.w")).alias("v"))


_dot = lambda k: f"round({math.cos(k * math.pi / 4)!r}::DOUBLE * dx + {math.sin(k * math.pi / 4)!r}::DOUBLE * dy, 6)"
_HOG = (
    _N1
    + f", e AS (SELECT img, y, x, n12 - n10 AS dx, n21 - n01 AS dy FROM n WHERE x BETWEEN 1 AND {W - 2} AND y BETWEEN 1 AND {H - 2}), dd AS (SELECT *, unnest([{', '.join(_dot(k) for k in range(4))}]) AS dot, unnest([0, 1, 2, 3]) AS k FROM e)"
    + ", bb AS (SELECT img, y, x, any_value(sqrt(dx * dx + dy * dy)) AS v, CASE WHEN max(abs(dot)) = 0 THEN 0 ELSE arg_max(CASE WHEN dot >= 0 THEN k ELSE k + 4 END, abs(dot) * 100 - k * 1e-7) END AS bin FROM dd GROUP BY 1, 2, 3)"
    + f", hh AS (SELECT bb.img, cy, cx, bin, sum(v * (1 - abs((y + 0.5::DOUBLE) / {CELL} - 0.5::DOUBLE - cy)) * (1 - abs((x + 0.5::DOUBLE) / {CELL} - 0.5::DOUBLE - cx))) AS v FROM bb, (SELECT unnest(range({H // CELL})) AS cy), (SELECT unnest(range({W // CELL})) AS cx) WHERE abs((y + 0.5::DOUBLE) / {CELL} - 0.5::DOUBLE - cy) < 1 AND abs((x + 0.5::DOUBLE) / {CELL} - 0.5::DOUBLE - cx) < 1 GROUP BY 1, 2, 3, 4)"
)
add("hog_direction_histograms", "SELECT img, cy, cx, CAST(bin AS BIGINT) AS bin, round(v, 3) AS v FROM hh", _HOG)(lambda p: directions(p).select("img", c("cy").cast("long").alias("cy"), c("cx").cast("long").alias("cx"), c("bin").cast("long").alias("bin"), F.round("v", 3).alias("v")))
add("hog_deinterleave", f"SELECT img, k, y, x // 5 AS x, CAST(max(CASE WHEN x % 5 = k THEN a END) AS BIGINT) AS v FROM p, (SELECT unnest(range(5)) AS k) GROUP BY 1, 2, 3, 4")(lambda p: p.select("img", (c("x") % 5).alias("k"), "y", F.expr("x div 5").alias("x"), c("a").alias("v")))
_ROWF, _COLF = [1, -2, 3, 1], [2, 0, -1]


def separable(p: DataFrame) -> DataFrame:
    """Valid separable filter: two runs of window functions after one shuffle on the image."""
    row, column = Window.partitionBy("img", "y").orderBy("x"), Window.partitionBy("img", "x").orderBy("y")
    out = p.select(*KEY, "a").repartition("img")
    out = out.withColumn("r", sum((w * F.lead("a", k).over(row) for k, w in enumerate(_ROWF)), F.lit(0)))
    out = out.withColumn("v", sum((w * F.lead("r", k).over(column) for k, w in enumerate(_COLF)), F.lit(0)))
    return out.where("v is not null").select(*KEY, "v")


add("hog_filter_separable", "SELECT p.img, p.y, p.x, CAST(sum(q.a * r.w * s.w) AS BIGINT) AS v FROM p, r, s, p AS q WHERE q.img = p.img AND q.y = p.y + s.k AND q.x = p.x + r.k " + f"AND p.x <= {W - len(_ROWF)} AND p.y <= {H - len(_COLF)} GROUP BY 1, 2, 3", f", r(k, w) AS (VALUES {', '.join(f'({k}, {w})' for k, w in enumerate(_ROWF))}), s(k, w) AS (VALUES {', '.join(f'({k}, {w})' for k, w in enumerate(_COLF))})")(separable)

# -- training: gradients that flow back, weights' gradients ------------------------------------------------------

for _k in (2, 3, 4, 5):
    _w = [[(i * _k + j) % 5 - 2 for j in range(_k)] for i in range(_k)]
    add(
        f"convolution_{_k}x{_k}_backward",
        f"SELECT img, y + i AS y, x + j AS x, CAST(sum(a * w) AS BIGINT) AS v FROM p, w GROUP BY 1, 2, 3",
        f", w(i, j, w) AS (VALUES {', '.join(f'({i}, {j}, {x})' for i, r in enumerate(_w) for j, x in enumerate(r))})",
    )(
        lambda p, w=_w: p.select(*KEY, "a", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(x).alias("w")) for i, r in enumerate(w) for j, x in enumerate(r)])).alias("t"))
        .groupBy("img", (c("y") + c("t.i")).alias("y"), (c("x") + c("t.j")).alias("x"))
        .agg(F.sum(c("a") * c("t.w")).cast("long").alias("v"))
    )
add("neural_pooling_2x2_max_3x3", f"SELECT p.img, d.y, e.x, max(a) AS v FROM p JOIN (SELECT unnest(range({(H + 1) // 2})) AS y) d ON p.y BETWEEN d.y * 2 AND d.y * 2 + 2 JOIN (SELECT unnest(range({(W + 1) // 2})) AS x) e ON p.x BETWEEN e.x * 2 AND e.x * 2 + 2 GROUP BY 1, 2, 3")(
    lambda p: p.select("img", "a", F.explode(F.array_distinct(F.array(F.expr("y div 2"), F.expr("(y - 1) div 2")))).alias("y"), "x").select("img", "a", "y", F.explode(F.array_distinct(F.array(F.expr("x div 2"), F.expr("(x - 1) div 2")))).alias("x")).groupBy(*KEY).agg(F.max("a").alias("v"))
)

# -- filters on packed planes ---------------------------------------------------------------------------------------


def on_planes(p: DataFrame, f) -> DataFrame:
    return unpack(packed.on_planes(pack(p, "a"), f)).select(*KEY, "v")


_TAPS = packed.gaussian_kernel(0.8)
_HALF = len(_TAPS) // 2
_K = ", k(o, w) AS (VALUES " + ", ".join(f"({i - _HALF}, {float(t)!r}::DOUBLE)" for i, t in enumerate(_TAPS)) + ")"
add(
    "gaussian_blur_sigma",
    "SELECT h.img, h.y, h.x, CAST(floor(sum(q.v * k.w) + 0.5) AS BIGINT) AS v FROM h, k, h AS q WHERE q.img = h.img AND q.x = h.x AND " + f"q.y = least(greatest(h.y + k.o, 0), {H - 1}) GROUP BY 1, 2, 3",
    _K + f", h AS (SELECT p.img, p.y, p.x, sum(q.a * k.w) AS v FROM p, k, p AS q WHERE q.img = p.img AND q.y = p.y AND q.x = least(greatest(p.x + k.o, 0), {W - 1}) GROUP BY 1, 2, 3)",
)(lambda p: on_planes(p, lambda v: packed.gaussian_blur(v, 0.8)))
add("draw_line", f"SELECT p.img, p.y, p.x, CASE WHEN l.y IS NULL THEN p.a ELSE 200 END AS v FROM p LEFT JOIN (SELECT DISTINCT CAST(floor(4 + t * 20 / 40.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) + o AS y, 3 + t AS x FROM (SELECT unnest(range(41)) AS t), (SELECT unnest([-1, 0, 1]) AS o)) l ON l.y = p.y AND l.x = p.x")(
    lambda p: on_planes(p, lambda v: packed.draw_line(v, 3, 4, 43, 24, 200, 3))
)
_SPATIAL, _RANGE = 0.012, 0.08
_KEEP = math.exp(-math.sqrt(2.0) / (_SPATIAL * 255))


def _pass(name: str, source: str, k: str, ahead: bool) -> str:
    """A recursion along k from one end: weight f and colour g of every pixel of source (img, y, x, s, v)."""
    o, last = ("y", W - 1) if k == "x" else ("x", H - 1)
    share = f"{_KEEP!r}::DOUBLE * exp(-abs(q.s - r.s)::DOUBLE / {_RANGE * 255!r}::DOUBLE)"
    return f"""{name} AS (SELECT img, y, x, s, 1::DOUBLE AS f, v::DOUBLE AS g FROM {source} WHERE {k} = {0 if ahead else last}
UNION ALL SELECT q.img, q.y, q.x, q.s, {1 - _KEEP!r}::DOUBLE + {share} * r.f, {1 - _KEEP!r}::DOUBLE * q.v + {share} * r.g FROM {name} r JOIN {source} q ON q.img = r.img AND q.{o} = r.{o} AND q.{k} = r.{k} {'+' if ahead else '-'} 1)"""


_MET = "SELECT a.img, a.y, a.x, a.s, CAST(floor((a.g + b.g) / (a.f + b.f) + 1e-4::DOUBLE) AS BIGINT) AS v FROM {0} a JOIN {1} b USING (img, y, x)"
add("recursive_bilateral_filter", None)(lambda p: on_planes(p, lambda v: packed.recursive_bilateral(v, _SPATIAL, _RANGE)))
SQL["recursive_bilateral_filter"] = f"WITH RECURSIVE {P}, s0 AS (SELECT img, y, x, a AS s, a AS v FROM p), {_pass('r1', 's0', 'x', True)}, {_pass('r2', 's0', 'x', False)}, s1 AS ({_MET.format('r1', 'r2')}), {_pass('c1', 's1', 'y', True)}, {_pass('c2', 's1', 'y', False)} SELECT img, y, x, v FROM ({_MET.format('c1', 'c2')})"
