"""Queries over the pixel relation and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import color as C
from ..functions.numeric import COMPARE, COMPARE_SQL, blend, div255, idiv, shr
from ..model import HEIGHT as H
from ..model import PIXELS_SQL as P
from ..model import WIDTH as W
from ..model import neighbourhood, neighbourhood_sql, pack, pixels, unpack
from ..operators import aggregate as A
from ..operators import geometry as G
from ..operators import packed
from ..operators import pointwise as E
from ..operators import stencil as S

QUERIES: dict = {}
SQL: dict = {}
c = F.col
KEY = ["img", "y", "x"]


def add(name: str, sql: str | None, tail: str = ""):
    """Register a query on the pixel relation; sql follows the relation's common table expression."""

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(pixels(spark, sf_dir))
        if sql is not None:
            SQL[name] = f"WITH {P}{tail} {sql}"
        return f

    return put


def project(name: str, columns, sql: dict) -> None:
    """A projection of pixels: no shuffle.  columns() is called in the query: a column needs a session."""
    add(name, "SELECT img, y, x, " + ", ".join(f"CAST({v} AS BIGINT) AS {k}" for k, v in sql.items()) + " FROM p")(lambda p: p.select(*KEY, *[v.cast("long").alias(k) for k, v in columns().items()]))


def clamp_sql(v: str, low=0, high=255) -> str:
    return f"least(greatest({v}, {low}), {high})"


def div255_sql(v: str) -> str:
    return f"(({v}) + 1 + (({v}) >> 8)) >> 8"


# -- colour ----------------------------------------------------------------------

project("bgr_to_gray", lambda: {"gray": C.gray(c("a"), c("b"), c("c"))}, {"gray": "(1868 * a + 9617 * b + 4899 * c + 8192) >> 14"})
project("rgb_to_gray", lambda: {"gray": C.gray(c("c"), c("b"), c("a"))}, {"gray": "(1868 * c + 9617 * b + 4899 * a + 8192) >> 14"})
project("bgra_to_gray", lambda: {"gray": C.gray(c("a"), c("b"), c("c")), "alpha": c("al")}, {"gray": "(1868 * a + 9617 * b + 4899 * c + 8192) >> 14", "alpha": "al"})
project("int16_to_gray", lambda: {"v": C.int16_to_gray(c("a") * 3 - c("b"))}, {"v": clamp_sql("a * 3 - b")})
project("bgr_to_rgb", lambda: {"v0": c("c"), "v1": c("b"), "v2": c("a")}, {"v0": "c", "v1": "b", "v2": "a"})
project("bgr_to_bgra", lambda: {"v0": c("a"), "v1": c("b"), "v2": c("c"), "v3": F.lit(255)}, {"v0": "a", "v1": "b", "v2": "c", "v3": "255"})
project("gray_to_bgr", lambda: {"v0": c("a"), "v1": c("a"), "v2": c("a")}, {"v0": "a", "v1": "a", "v2": "a"})
project("bgr48p_to_bgra32", lambda: {"v0": (c("a") * 257) % 256, "v1": (c("b") * 129) % 256, "v2": (c("c") * 77) % 256, "v3": F.lit(255)}, {"v0": "(a * 257) % 256", "v1": "(b * 129) % 256", "v2": "(c * 77) % 256", "v3": "255"})
project("alpha_premultiply", lambda: {"v": C.premultiply(c("a"), c("al"))}, {"v": div255_sql("a * al")})
project("alpha_unpremultiply", lambda: {"v": C.unpremultiply(c("a"), c("al"))}, {"v": "CASE WHEN al = 0 THEN 0 ELSE least(floor(a * CAST(255.00001 AS DOUBLE) / greatest(al, 1)), 255) END"})
project("texture_boosted_uv", lambda: {"v": C.boosted_uv(c("a"), 4)}, {"v": f"({clamp_sql('a', 96, 159)} - 96) * 4"})
project("texture_compensation", lambda: {"v": E.compensate(c("a"), -37)}, {"v": clamp_sql("a - 37")})
project("uint8_to_float32", lambda: {"v": F.rint(C.uint8_to_float(c("a"), -1.0, 1.0) * 1000)}, {"v": "round_even((a * CAST(2.0 / 255.0 AS DOUBLE) + CAST(-1.0 AS DOUBLE)) * 1000, 0)"})
project("float32_to_uint8", lambda: {"v": C.float_to_uint8(c("a") / 64.0, 0.5, 3.0)}, {"v": "floor((least(greatest(a / CAST(64.0 AS DOUBLE), 0.5::DOUBLE), 3.0::DOUBLE) - 0.5::DOUBLE) * (255.0::DOUBLE / 2.5::DOUBLE))"})
project("neural_convert", lambda: {"v": F.rint((255 - c("a")) / F.lit(255.0) * 100000)}, {"v": "round_even((255 - a) / 255.0::DOUBLE * 100000, 0)"})
project("reorder_16bit", lambda: {"v": (c("a") * 256 + c("b")) % 256 * 256 + shr(c("a") * 256 + c("b"), 8)}, {"v": "b * 256 + a"})
project("reorder_32bit", lambda: {"v": c("al") * 16777216 + c("c") * 65536 + c("b") * 256 + c("a")}, {"v": "al * 16777216 + c * 65536 + b * 256 + a"})

_HUE = "CASE WHEN greatest(a, b, c) = least(a, b, c) THEN 0 ELSE ((CASE WHEN c = greatest(a, b, c) THEN b - a + 6 * (greatest(a, b, c) - least(a, b, c)) WHEN b = greatest(a, b, c) THEN a - c + 2 * (greatest(a, b, c) - least(a, b, c)) ELSE c - b + 4 * (greatest(a, b, c) - least(a, b, c)) END) * 85 // (2 * (greatest(a, b, c) - least(a, b, c)))) % 256 END"
_TOP, _LOW = "greatest(a, b, c)", "least(a, b, c)"
project("bgr_to_hsv", lambda: {f"o_{k}": v for k, v in C.bgr_to_hsv(c("a"), c("b"), c("c")).items()}, {"o_h": _HUE, "o_s": f"CASE WHEN {_TOP} = 0 THEN 0 ELSE 255 * ({_TOP} - {_LOW}) // {_TOP} END", "o_v": _TOP})
project("bgr_to_hsl", lambda: {f"o_{k}": v for k, v in C.bgr_to_hsl(c("a"), c("b"), c("c")).items()}, {"o_h": _HUE, "o_s": f"CASE WHEN {_TOP} + {_LOW} IN (0, 510) THEN 0 WHEN {_TOP} + {_LOW} <= 255 THEN 255 * ({_TOP} - {_LOW}) // ({_TOP} + {_LOW}) ELSE 255 * ({_TOP} - {_LOW}) // (510 - {_TOP} - {_LOW}) END", "o_l": f"({_TOP} + {_LOW}) // 2"})

#: Fixed values: (y, u, v) rows of (blue, green, red) weights, 14 bits, and (y, u to blue, u to green, v to green, v to red) with their bits.
_YUV = {
    "bt601": (((1604, 8260, 4207), (7196, -4768, -2428), (-1170, -6026, 7196)), (9539, 16525, -3209, -6660, 13075), 16, 13),
    "bt709": (((1016, 10064, 2991), (7196, -5547, -1649), (-660, -6536, 7196)), (9539, 17305, -1747, -4366, 14686), 16, 13),
    "bt2020": (((834, 9540, 3696), (7196, -5187, -2010), (-579, -6617, 7196)), (9539, 17545, -1535, -5690, 13752), 16, 13),
    "trect871": (((1868, 9617, 4899), (8192, -5427, -2765), (-1332, -6860, 8192)), (16384, 29032, -5638, -11700, 22970), 0, 14),
}


def _forward_sql(standard: str, b: str = "a", g: str = "b", r: str = "c") -> dict[str, str]:
    rows, _, low, _ = _YUV[standard]
    return {n: clamp_sql(f"((({w[0]}) * {b} + ({w[1]}) * {g} + ({w[2]}) * {r} + 8192) >> 14) + {low if n == 'y' else 128}") for n, w in zip("yuv", rows)}


def _backward_sql(standard: str, y: str = "a", u: str = "b", v: str = "c") -> dict[str, str]:
    _, (ky, ub, ug, vg, vr), low, n = _YUV[standard]
    half = 1 << (n - 1)
    return {
        "b": clamp_sql(f"({ky} * ({y} - {low}) + {ub} * ({u} - 128) + {half}) >> {n}"),
        "g": clamp_sql(f"({ky} * ({y} - {low}) + ({ug}) * ({u} - 128) + ({vg}) * ({v} - 128) + {half}) >> {n}"),
        "r": clamp_sql(f"({ky} * ({y} - {low}) + {vr} * ({v} - 128) + {half}) >> {n}"),
    }


def _chroma(p, standard: str, dy: int, dx: int):
    """Full-size luma beside chroma of cells of dy x dx pixels, each from the cell's rounded mean colour."""
    n = dy * dx
    cell = p.groupBy("img", F.expr(f"y div {dy}").alias("cy"), F.expr(f"x div {dx}").alias("cx"))
    mean = cell.agg(*[idiv(F.sum(k) + n // 2, n).alias(k) for k in "abc"])
    yuv = C.bgr_to_yuv(c("a"), c("b"), c("c"), standard)
    return mean.select("img", c("cy").alias("y"), c("cx").alias("x"), yuv["u"].cast("long").alias("u"), yuv["v"].cast("long").alias("v"))


for _s in C.STANDARDS:
    project(f"bgr_to_yuv444p_{_s}", lambda _s=_s: {f"o_{k}": v for k, v in C.bgr_to_yuv(c("a"), c("b"), c("c"), _s).items()}, {f"o_{k}": v for k, v in _forward_sql(_s).items()})
    project(f"yuv444p_to_bgr_{_s}", lambda _s=_s: {f"o_{k}": v for k, v in C.yuv_to_bgr(c("a"), c("b"), c("c"), _s).items()}, {f"o_{k}": v for k, v in _backward_sql(_s).items()})
    for _name, _dy, _dx in (("420p", 2, 2), ("422p", 1, 2)):
        _f, _n = _forward_sql(_s), _dy * _dx
        add(
            f"bgr_to_yuv{_name}_chroma_{_s}",
            f"SELECT img, y, x, CAST({_f['u']} AS BIGINT) AS u, CAST({_f['v']} AS BIGINT) AS v FROM m",
            f", m AS (SELECT img, y // {_dy} AS y, x // {_dx} AS x, " + ", ".join(f"(CAST(sum({k}) AS BIGINT) + {_n // 2}) // {_n} AS {k}" for k in "abc") + " FROM p GROUP BY 1, 2, 3)",
        )(lambda p, s=_s, dy=_dy, dx=_dx: _chroma(p, s, dy, dx))
        # chroma planes of the cells' first pixels, joined to every pixel of the cell
        add(
            f"yuv{_name}_to_bgr_{_s}",
            "SELECT p.img, p.y, p.x, " + ", ".join(f"CAST({v} AS BIGINT) AS o_{k}" for k, v in _backward_sql(_s, "p.a", "q.b", "q.c").items()) + f" FROM p JOIN p AS q ON p.img = q.img AND q.y = p.y // {_dy} * {_dy} AND q.x = p.x // {_dx} * {_dx}",
        )(
            lambda p, s=_s, dy=_dy, dx=_dx: p.withColumns({"cy": F.expr(f"y div {dy}"), "cx": F.expr(f"x div {dx}")})
            .select("img", "y", "x", "a", "cy", "cx")
            .join(p.where(f"y % {dy} = 0 and x % {dx} = 0").select("img", F.expr(f"y div {dy}").alias("cy"), F.expr(f"x div {dx}").alias("cx"), c("b").alias("u"), c("c").alias("v")), ["img", "cy", "cx"])
            .select(*KEY, *[v.cast("long").alias(f"o_{k}") for k, v in C.yuv_to_bgr(c("a"), c("u"), c("v"), s).items()])
        )
for _m, ((_tl, _tr), (_bl, _br)) in C.BAYER.items():
    _pick = {"b": "a", "g": "b", "r": "c"}
    project(
        f"bgr_to_bayer_{_m}",
        lambda _m=_m: {"v": C.bayer(c("a"), c("b"), c("c"), c("y"), c("x"), _m)},
        {"v": f"CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN {_pick[_tl]} WHEN y % 2 = 0 THEN {_pick[_tr]} WHEN x % 2 = 0 THEN {_pick[_bl]} ELSE {_pick[_br]} END"},
    )
add("deinterleave_bgr", "SELECT img, y, x, 0 AS ch, a AS v FROM p UNION ALL SELECT img, y, x, 1, b FROM p UNION ALL SELECT img, y, x, 2, c FROM p")(
    lambda p: p.select(*KEY, F.posexplode(F.array("a", "b", "c"))).select(*KEY, c("pos").alias("ch"), c("col").alias("v"))
)
add("interleave_uv", "SELECT img, y, x, a * 256 + b AS uv FROM p")(lambda p: p.select(*KEY, (c("a") * 256 + c("b")).alias("uv")))
add("change_colors", "SELECT p.img, p.y, p.x, (p.a * 7 + 64) % 192 AS v FROM p")(
    lambda p: E.change_colors(p.select(*KEY, c("a").alias("v")), "v", p.sparkSession.range(256).select(c("id").alias("v"), ((c("id") * 7 + 64) % 192).alias("new"))).select(*KEY, "v")
)
add("copy_region", "SELECT img, y - 5 AS y, x - 7 AS x, a AS v FROM p WHERE y BETWEEN 5 AND 19 AND x BETWEEN 7 AND 39")(lambda p: p.where("y between 5 and 19 and x between 7 and 39").select("img", (c("y") - 5).alias("y"), (c("x") - 7).alias("x"), c("a").alias("v")))
add("fill_frame", "SELECT img, y, x, CASE WHEN y BETWEEN 3 AND 26 AND x BETWEEN 4 AND 44 THEN a ELSE 77 END AS v FROM p")(lambda p: p.select(*KEY, F.when(c("y").between(3, 26) & c("x").between(4, 44), c("a")).otherwise(F.lit(77)).alias("v")))
add("copy_frame", "SELECT img, y, x, CASE WHEN y BETWEEN 3 AND 26 AND x BETWEEN 4 AND 44 THEN b ELSE a END AS v FROM p")(lambda p: p.select(*KEY, F.when(c("y").between(3, 26) & c("x").between(4, 44), c("b")).otherwise(c("a")).alias("v")))

# -- predicates and binary operations ------------------------------------------------

for _n, _o in COMPARE_SQL.items():
    project(f"binarization_{_n}", lambda _n=_n, _o=_o: {"v": E.binarize(c("a"), _n, 128, 255, 7)}, {"v": f"CASE WHEN a {_o} 128 THEN 255 ELSE 7 END"})
    project(f"conditional_fill_{_n}", lambda _n=_n, _o=_o: {"v": E.conditional_fill(c("a"), c("b"), _n, 100, 9)}, {"v": f"CASE WHEN a {_o} 100 THEN 9 ELSE b END"})
_BIN = {"average": "(a + b + 1) >> 1", "and": "a & b", "or": "a | b", "maximum": "greatest(a, b)", "minimum": "least(a, b)", "saturated_subtraction": "greatest(a - b, 0)", "saturated_addition": "least(a + b, 255)"}
for _n, _o in _BIN.items():
    project(f"operation_8u_{_n}", lambda _n=_n, _o=_o: {"v": E.BINARY8[_n](c("a"), c("b"))}, {"v": _o})
for _n, _o in {"addition": "a * 200 + b * 211", "subtraction": "a * 200 - b * 211"}.items():
    project(f"operation_16i_{_n}", lambda _n=_n, _o=_o: {"v": E.BINARY16[_n](c("a") * 200, c("b") * 211)}, {"v": f"((({_o}) + 32768) % 65536 + 65536) % 65536 - 32768"})
project("abs_difference", lambda: {"v": F.abs(c("a") - c("b"))}, {"v": "abs(a - b)"})
project("alpha_blending", lambda: {"v": blend(c("a"), c("b"), c("al"))}, {"v": div255_sql("a * al + b * (255 - al)")})
project("alpha_blending_uniform", lambda: {"v": blend(c("a"), c("b"), F.lit(90))}, {"v": div255_sql("a * 90 + b * 165")})
project("alpha_blending_2x", lambda: {"v": blend(c("c"), blend(c("a"), c("b"), c("al")), F.lit(40))}, {"v": div255_sql(f"c * 40 + ({div255_sql('a * al + b * (255 - al)')}) * 215")})
project("alpha_filling", lambda: {"v": blend(F.lit(200), c("b"), c("al"))}, {"v": div255_sql("200 * al + b * (255 - al)")})
project("add_feature_difference", lambda: {"v": F.least(c("c") + E.feature_difference(c("a"), F.least(c("b"), c("c")), F.greatest(c("b"), c("c")), 4096), F.lit(255))}, {"v": "least(c + least((greatest(a - greatest(b, c), least(b, c) - a, 0) * greatest(a - greatest(b, c), least(b, c) - a, 0) * 4096) >> 16, 255), 255)"})
project("background_init_mask", lambda: {"v": F.when(c("m") == 2, F.lit(255)).otherwise(c("b"))}, {"v": "CASE WHEN m = 2 THEN 255 ELSE b END"})
project("segmentation_change_index", lambda: {"v": F.when(c("m") == 1, F.lit(9)).otherwise(c("m"))}, {"v": "CASE WHEN m = 1 THEN 9 ELSE m END"})

# -- background state updates ---------------------------------------------------------

def _range():
    """Lower and upper end of the background range."""
    return F.least(c("b"), c("c")), F.greatest(c("b"), c("c"))


def _masked(new: dict) -> dict:
    """The new range where the mask is set."""
    old = dict(zip(("lo", "hi"), _range()))
    return {k: F.when(c("m") != 0, v).otherwise(old[k]) if k in old else v for k, v in new.items()}


def _adjusted() -> dict:
    return E.adjust_range(*_range(), c("al"), c("a"), 100)


def _slid() -> dict:
    return E.shift_range(c("a"), *_range())


_lo, _hi = "least(b, c)", "greatest(b, c)"
project("background_grow_range_slow", lambda: E.grow_slow(c("a"), *_range()), {"lo": f"{_lo} - CASE WHEN a < {_lo} THEN 1 ELSE 0 END", "hi": f"{_hi} + CASE WHEN a > {_hi} THEN 1 ELSE 0 END"})
project("background_grow_range_fast", lambda: E.grow_fast(c("a"), *_range()), {"lo": "least(a, b, c)", "hi": "greatest(a, b, c)"})
project("background_increment_count", lambda: E.increment_count(c("a"), *_range(), c("al"), c("m")), {"lo_count": f"least(al + CASE WHEN a < {_lo} THEN 1 ELSE 0 END, 255)", "hi_count": f"least(m + CASE WHEN a > {_hi} THEN 1 ELSE 0 END, 255)"})
_ADJ = {"lo": clamp_sql(f"{_lo} + CASE WHEN al > 100 THEN -1 WHEN al < 100 THEN 1 ELSE 0 END"), "hi": clamp_sql(f"{_hi} + CASE WHEN a > 100 THEN 1 WHEN a < 100 THEN -1 ELSE 0 END"), "lo_count": "0", "hi_count": "0"}
project("background_adjust_range", _adjusted, _ADJ)
project("background_adjust_range_masked", lambda: _masked(_adjusted()), {k: (f"CASE WHEN m <> 0 THEN {v} ELSE {dict(lo=_lo, hi=_hi)[k]} END" if k in ("lo", "hi") else v) for k, v in _ADJ.items()})
_MOVE = f"(CASE WHEN a > {_hi} THEN a - {_hi} WHEN a < {_lo} THEN a - {_lo} ELSE 0 END)"
_SHIFT = {"lo": clamp_sql(f"{_lo} + {_MOVE}"), "hi": clamp_sql(f"{_hi} + {_MOVE}")}
project("background_shift_range", _slid, _SHIFT)
project("background_shift_range_masked", lambda: _masked(_slid()), {k: f"CASE WHEN m <> 0 THEN {v} ELSE {dict(lo=_lo, hi=_hi)[k]} END" for k, v in _SHIFT.items()})


# -- aggregates -------------------------------------------------------------------------


def summary(name: str, columns, sql: dict, keys: tuple = ("img",)) -> None:
    """Partial sums in each task, one small shuffle on the keys."""
    add(name, f"SELECT {', '.join(keys)}, " + ", ".join(f"CAST({v} AS BIGINT) AS {k}" for k, v in sql.items()) + f" FROM p GROUP BY {', '.join(keys)}")(lambda p: p.groupBy(*keys).agg(*[v.cast("long").alias(k) for k, v in columns().items()]))


def _d():
    return c("a") - c("b")


summary("abs_difference_sum", lambda: {"s": A.total(F.abs(_d()))}, {"s": "sum(abs(a - b))"})
summary("abs_difference_sum_masked", lambda: {"s": A.where_sum(F.abs(_d()), c("m") == 1)}, {"s": "sum(CASE WHEN m = 1 THEN abs(a - b) ELSE 0 END)"})
summary("squared_difference_sum", lambda: {"s": A.total(_d() * _d())}, {"s": "sum((a - b) * (a - b))"})
summary("squared_difference_sum_masked", lambda: {"s": A.where_sum(_d() * _d(), c("m") == 1)}, {"s": "sum(CASE WHEN m = 1 THEN (a - b) * (a - b) ELSE 0 END)"})
summary("correlation_sum", lambda: {"s": A.total(c("a") * c("b"))}, {"s": "sum(a * b)"})
summary("value_sum", lambda: {"s": A.total(c("a"))}, {"s": "sum(a)"})
summary("square_sum", lambda: {"s": A.total(c("a") * c("a"))}, {"s": "sum(a * a)"})
summary("value_square_sum", lambda: {"s": A.total(c("a")), "q": A.total(c("a") * c("a"))}, {"s": "sum(a)", "q": "sum(a * a)"})
summary("value_square_sums", lambda: {f"{k}_{n}": A.total(v) for k in "abc" for n, v in (("s", c(k)), ("q", c(k) * c(k)))}, {f"{k}_{n}": f"sum({v})" for k in "abc" for n, v in (("s", k), ("q", f"{k} * {k}"))})
summary("get_statistic", lambda: A.statistic(c("a")), {"lo": "min(a)", "hi": "max(a)", "mean": "(CAST(sum(a) AS BIGINT) + count(a) // 2) // count(a)"})
summary("get_moments", lambda: A.moments(c("x"), c("y"), c("m") == 2), {k: f"sum(CASE WHEN m = 2 THEN {v} ELSE 0 END)" for k, v in {"area": "1", "sx": "x", "sy": "y", "sxx": "x * x", "sxy": "x * y", "syy": "y * y"}.items()})
summary("get_object_moments", lambda: A.object_moments(c("a"), c("x"), c("y"), c("m") == 2), {k: f"sum(CASE WHEN m = 2 THEN {v} ELSE 0 END)" for k, v in {"n": "1", "s": "a", "sx": "a * x", "sy": "a * y", "sxx": "a * x * x", "sxy": "a * x * y", "syy": "a * y * y"}.items()})
summary("get_row_sums", lambda: {"s": A.total(c("a"))}, {"s": "sum(a)"}, ("img", "y"))
summary("get_col_sums", lambda: {"s": A.total(c("a"))}, {"s": "sum(a)"}, ("img", "x"))
summary("texture_difference_sum", lambda: {"s": A.total(c("a") - shr(c("b") + c("c") + 1, 1))}, {"s": "sum(a - ((b + c + 1) >> 1))"})
summary("segmentation_shrink_region", lambda: {k: F.coalesce(f(F.when(c("m") == 3, c(v))), F.lit(0)) for k, f, v in (("l", F.min, "x"), ("t", F.min, "y"), ("r", F.max, "x"), ("bt", F.max, "y"))}, {"l": "coalesce(min(x) FILTER (WHERE m = 3), 0)", "t": "coalesce(min(y) FILTER (WHERE m = 3), 0)", "r": "coalesce(max(x) FILTER (WHERE m = 3), 0)", "bt": "coalesce(max(y) FILTER (WHERE m = 3), 0)"})
add("conditional_sums", "SELECT img, " + ", ".join(f"CAST(sum(CASE WHEN b {o} 120 THEN {v} ELSE 0 END) AS BIGINT) AS {k}_{n}" for n, o in COMPARE_SQL.items() for k, v in (("count", "1"), ("sum", "a"), ("sqsum", "a * a"))) + " FROM p GROUP BY img")(lambda p: p.groupBy("img").agg(*A.conditional(p, "a", "b", 120)))

_GRID = "SELECT i.img, r.bin, coalesce(h.n, 0) AS n FROM (SELECT DISTINCT img FROM p) i CROSS JOIN (SELECT unnest(range(256)) AS bin) r LEFT JOIN (SELECT img, a AS bin, count(*) AS n FROM p WHERE {w} GROUP BY 1, 2) h ON h.img = i.img AND h.bin = r.bin"
for _n, _cond, _w in (("histogram", None, "TRUE"), ("histogram_masked", "m = 1", "m = 1"), ("histogram_conditional", "b > 99", "b > 99")):
    add(_n, _GRID.format(w=_w))(lambda p, cond=_cond: A.histogram(p, c("a"), ["img"], cond and F.expr(cond)))
_HG = f", g AS ({_GRID.format(w='TRUE')})"
_EQ = ", q AS (SELECT *, sum(n) OVER (PARTITION BY img ORDER BY bin) AS cdf, first_value(n) OVER (PARTITION BY img ORDER BY CASE WHEN n > 0 THEN bin ELSE 999 END) AS low, sum(n) OVER (PARTITION BY img) AS total FROM g), e AS (SELECT img, bin AS v, CASE WHEN cdf <= low OR total <= low THEN 0 ELSE CAST((255 * (cdf - low) + (total - low) // 2) // greatest(total - low, 1) AS BIGINT) END AS new FROM q)"
add("normalized_colors", "SELECT img, v, CAST(new AS BIGINT) AS new FROM e", _HG + _EQ)(lambda p: A.equalisation(A.histogram(p, c("a"), ["img"]), ["img"]))
add("normalize_histogram", "SELECT p.img, p.y, p.x, CAST(e.new AS BIGINT) AS v FROM p JOIN e ON e.img = p.img AND e.v = p.a", _HG + _EQ)(lambda p: p.withColumnRenamed("a", "v").join(A.equalisation(A.histogram(p, c("a"), ["img"]), ["img"]), ["img", "v"]).select("img", "y", "x", c("new").alias("v")))
add("histogram_mean", "SELECT img, CAST(sum(bin * n) // sum(n) AS BIGINT) AS mean FROM g GROUP BY img", _HG)(lambda p: A.histogram(p, c("a"), ["img"]).groupBy("img").agg(idiv(F.sum(c("bin") * c("n")), F.sum("n")).alias("mean")))
add(
    "otsu_threshold",
    "SELECT img, CAST(arg_min(bin, (-sigma, bin)) AS BIGINT) AS threshold FROM s GROUP BY img",
    _HG + ", k AS (SELECT *, sum(n) OVER w AS wb, sum(bin * n) OVER w AS sb, sum(n) OVER (PARTITION BY img) AS t, sum(bin * n) OVER (PARTITION BY img) AS st FROM g WINDOW w AS (PARTITION BY img ORDER BY bin)), s AS (SELECT img, bin, CASE WHEN wb > 0 AND t > wb THEN round(wb::DOUBLE * (t - wb)::DOUBLE * (sb::DOUBLE / wb::DOUBLE - (st - sb)::DOUBLE / (t - wb)::DOUBLE) * (sb::DOUBLE / wb::DOUBLE - (st - sb)::DOUBLE / (t - wb)::DOUBLE), 3) ELSE 0 END AS sigma FROM k)",
)(lambda p: A.otsu(A.histogram(p, c("a"), ["img"]), ["img"]))

# -- stencils -----------------------------------------------------------------------------

_N1, _N2 = ", " + neighbourhood_sql("a", 1), ", " + neighbourhood_sql("a", 2)


def stencil(name: str, columns, sql: dict, radius: int = 1) -> None:
    add(name, "SELECT img, y, x, " + ", ".join(f"CAST({v} AS BIGINT) AS {k}" for k, v in sql.items()) + " FROM n", _N1 if radius == 1 else _N2)(lambda p: neighbourhood(p.select(*KEY, "a", "m"), "a", radius).select(*KEY, *[v.cast("long").alias(k) for k, v in columns().items()]))


def weights_sql(w) -> str:
    return " + ".join(f"({k}) * n{i}{j}" for i, row in enumerate(w) for j, k in enumerate(row) if k)


_DX, _DY, _LP = (weights_sql(w) for w in (S.SOBEL_DX, S.SOBEL_DY, S.LAPLACE))
_ALL1 = [f"n{i}{j}" for i in range(3) for j in range(3)]
_ALL2 = [f"n{i}{j}" for i in range(5) for j in range(5)]
_IN = f"x > 0 AND y > 0 AND x < {W - 1} AND y < {H - 1}"
stencil("sobel_dx", lambda: {"v": S.sobel_dx(), "va": F.abs(S.sobel_dx())}, {"v": _DX, "va": f"abs({_DX})"})
stencil("sobel_dy", lambda: {"v": S.sobel_dy(), "va": F.abs(S.sobel_dy())}, {"v": _DY, "va": f"abs({_DY})"})
stencil("laplace", lambda: {"v": S.laplace(), "va": F.abs(S.laplace())}, {"v": _LP, "va": f"abs({_LP})"})
stencil("contour_metrics", lambda: {"v": S.contour_metric()}, {"v": f"(abs({_DX}) + abs({_DY})) * 2 + CASE WHEN abs({_DX}) >= abs({_DY}) THEN 0 ELSE 1 END"})
stencil("contour_metrics_masked", lambda: {"v": F.when(c("m") < 2, F.lit(0)).otherwise(S.contour_metric())}, {"v": f"CASE WHEN m < 2 THEN 0 ELSE (abs({_DX}) + abs({_DY})) * 2 + CASE WHEN abs({_DX}) >= abs({_DY}) THEN 0 ELSE 1 END END"})
stencil("gaussian_blur_3x3", lambda: {"v": S.gauss3()}, {"v": f"({weights_sql(S.GAUSS3)} + 8) >> 4"})
stencil("mean_filter_3x3", lambda: {"v": S.mean3()}, {"v": f"(({' + '.join(_ALL1)} + 5) * 7281) >> 16"})
stencil("abs_gradient_saturated_sum", lambda: {"v": S.gradient_sum(W, H)}, {"v": f"CASE WHEN {_IN} THEN least(abs(n12 - n10) + abs(n21 - n01), 255) ELSE 0 END"})
stencil("texture_boosted_gradient", lambda: S.boosted_gradient(16, 4, W, H), {"dx": f"CASE WHEN {_IN} THEN (16 + {clamp_sql('n12 - n10', -16, 16)}) * 4 ELSE 0 END", "dy": f"CASE WHEN {_IN} THEN (16 + {clamp_sql('n21 - n01', -16, 16)}) * 4 ELSE 0 END"})
stencil("lbp_estimate", lambda: {"v": S.lbp(W, H)}, {"v": f"CASE WHEN {_IN} THEN " + " + ".join(f"CASE WHEN {n} >= n11 THEN {1 << k} ELSE 0 END" for k, n in enumerate(["n00", "n01", "n02", "n12", "n22", "n21", "n20", "n10"])) + " ELSE 0 END"})
for _r, _all in ((1, _ALL1), (2, _ALL2)):
    _sz = 2 * _r + 1
    _rh = [f"n{i}{j}" for i in range(_sz) for j in range(_sz) if abs(i - _r) + abs(j - _r) <= _r]
    stencil(f"median_filter_square_{_sz}x{_sz}", lambda _r=_r, _all=_all: {"v": S.median([c(k) for k in _all])}, {"v": f"list_sort([{', '.join(_all)}])[{len(_all) // 2 + 1}]"}, _r)
    stencil(f"median_filter_rhomb_{_sz}x{_sz}", lambda _r=_r, _all=_all: {"v": S.median(S.rhomb(_r))}, {"v": f"list_sort([{', '.join(_rh)}])[{len(_rh) // 2 + 1}]"}, _r)
    stencil(f"midpoint_filter_square_{_sz}x{_sz}", lambda _r=_r, _all=_all: {"v": S.midpoint(_r)}, {"v": f"(greatest({', '.join(_all)}) + least({', '.join(_all)}) + 1) // 2"}, _r)
    for _nm, _top, _fn in (("max", True, "greatest"), ("min", False, "least")):
        _best = f"{_fn}({', '.join(_all)})"
        stencil(f"{_nm}_filter_square_{_sz}x{_sz}", lambda _r=_r, _all=_all, _nm=_nm, _top=_top, _fn=_fn: {"v": S.voted(_r, 2, _top)}, {"v": f"CASE WHEN len(list_filter([{', '.join(_all)}], lambda q: q = {_best})) >= 2 THEN {_best} ELSE n{_r}{_r} END"}, _r)
# a sort of 25 neighbours per pixel is NumPy's work on packed planes
for _n, _rhomb in (("median_filter_square_5x5", False), ("median_filter_rhomb_5x5", True)):
    QUERIES[_n] = lambda s, d, rhomb=_rhomb: unpack(packed.on_planes(pack(pixels(s, d), "a"), lambda v: packed.median_filter(v, 2, rhomb))).select(*KEY, "v")


def stencil_sum(name: str, value, sql: str) -> None:
    add(name, f"SELECT img, CAST(sum({sql}) AS BIGINT) AS s FROM n GROUP BY img", _N1)(lambda p: neighbourhood(p.select(*KEY, "a", "b", "m"), "a", 1).groupBy("img").agg(A.total(value()).alias("s")))


stencil_sum("sobel_dx_abs_sum", lambda: F.abs(S.sobel_dx()), f"abs({_DX})")
stencil_sum("sobel_dy_abs_sum", lambda: F.abs(S.sobel_dy()), f"abs({_DY})")
stencil_sum("laplace_abs_sum", lambda: F.abs(S.laplace()), f"abs({_LP})")
def _g2():
    return (c("n12") - c("n10")) * (c("n12") - c("n10")) + (c("n21") - c("n01")) * (c("n21") - c("n01"))


_G2_SQL = "(n12 - n10) * (n12 - n10) + (n21 - n01) * (n21 - n01)"
add("conditional_square_gradient_sum", "SELECT img, " + ", ".join(f"CAST(coalesce(sum({_G2_SQL}) FILTER (WHERE {_IN} AND m {_o} 2), 0) AS BIGINT) AS s_{_n}" for _n, _o in COMPARE_SQL.items()) + " FROM n GROUP BY img", _N1)(
    lambda p: neighbourhood(p.select(*KEY, "a", "m"), "a", 1).groupBy("img").agg(*[A.where_sum(_g2(), S.inner(W, H) & COMPARE[n](c("m"), F.lit(2))).alias(f"s_{n}") for n in COMPARE])
)
add("conditional_count_16i", "SELECT img, " + ", ".join(f"count(*) FILTER (WHERE a * 3 - b {_o} 77) AS n_{_n}" for _n, _o in COMPARE_SQL.items()) + " FROM p GROUP BY img")(
    lambda p: p.groupBy("img").agg(*[F.count_if(COMPARE[n](c("a") * 3 - c("b"), F.lit(77))).alias(f"n_{n}") for n in COMPARE])
)
for _n, _cond, _w in (("abs_difference_sums_3x3", "true", "TRUE"), ("abs_difference_sums_3x3_masked", "m = 1", "m = 1")):
    add(_n, "SELECT img, " + ", ".join(f"CAST(sum(abs(b - {k})) FILTER (WHERE {_IN} AND {_w}) AS BIGINT) AS s_{k}" for k in _ALL1) + " FROM n GROUP BY img", _N1)(
        lambda p, cond=_cond: (lambda n: n.where(S.inner(W, H) & F.expr(cond)).groupBy("img").agg(*[A.total(F.abs(c("b") - c(k))).alias(f"s_{k}") for k in _ALL1]))(neighbourhood(p.select(*KEY, "a", "b", "m"), "a", 1))
    )
add("abs_dx_col_sums", "SELECT img, x, CAST(sum(abs(n12 - n11)) AS BIGINT) AS s FROM n GROUP BY img, x", _N1)(lambda p: neighbourhood(p.select(*KEY, "a"), "a", 1).groupBy("img", "x").agg(A.total(F.abs(c("n12") - c("n11"))).alias("s")))
add("abs_dy_row_sums", "SELECT img, y, CAST(sum(abs(n21 - n11)) AS BIGINT) AS s FROM n GROUP BY img, y", _N1)(lambda p: neighbourhood(p.select(*KEY, "a"), "a", 1).groupBy("img", "y").agg(A.total(F.abs(c("n21") - c("n11"))).alias("s")))
add("segmentation_fill_single_holes", "SELECT img, y, x, CASE WHEN x > 0 AND y > 0 AND " + f"x < {W - 1} AND y < {H - 1} AND n01 = 2 AND n10 = 2 AND n12 = 2 AND n21 = 2 THEN 2 ELSE m END AS v FROM n", ", " + neighbourhood_sql("m", 1))(
    lambda p: neighbourhood(p.select(*KEY, "m"), "m", 1).select(*KEY, F.when(S.inner(W, H) & (c("n01") == 2) & (c("n10") == 2) & (c("n12") == 2) & (c("n21") == 2), F.lit(2)).otherwise(c("m")).alias("v"))
)
_INT = ", i1 AS (SELECT *, sum({v}) OVER (PARTITION BY img, y ORDER BY x) AS r FROM p), i2 AS (SELECT *, sum(r) OVER (PARTITION BY img, x ORDER BY y) AS s FROM i1)"
add("integral", "SELECT img, y, x, CAST(s AS BIGINT) AS s FROM i2", _INT.format(v="a"))(lambda p: S.integral(p.select(*KEY, "a"), "a").select(*KEY, c("s").cast("long").alias("s")))
add("integral_square", "SELECT img, y, x, CAST(s AS BIGINT) AS s FROM i2", _INT.format(v="a * a"))(lambda p: S.integral(p.select(*KEY, (c("a") * c("a")).alias("q")), "q").select(*KEY, c("s").cast("long").alias("s")))
_BOX = ", b1 AS (SELECT *, sum({v}) OVER r AS rs, count(*) OVER r AS rn FROM p WINDOW r AS (PARTITION BY img, y ORDER BY x ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)), b2 AS (SELECT *, sum(rs) OVER k AS bs, sum(rn) OVER k AS bn FROM b1 WINDOW k AS (PARTITION BY img, x ORDER BY y ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))"
add("averaging_binarization", "SELECT img, y, x, CASE WHEN 255 * bs > 128 * bn THEN 255 ELSE 0 END AS v FROM b2", _BOX.format(v="CASE WHEN a > 120 THEN 1 ELSE 0 END"))(
    lambda p: S.box(p.select(*KEY, (c("a") > 120).cast("int").alias("hit")), "hit", 3, "bs", "bn").select(*KEY, F.when(255 * c("bs") > 128 * c("bn"), F.lit(255)).otherwise(F.lit(0)).alias("v"))
)
add("averaging_binarization_v2", "SELECT img, y, x, CASE WHEN (a + 10) * bn > bs THEN 255 ELSE 0 END AS v FROM b2", _BOX.format(v="a"))(lambda p: S.box(p.select(*KEY, "a"), "a", 3, "bs", "bn").select(*KEY, F.when((c("a") + 10) * c("bn") > c("bs"), F.lit(255)).otherwise(F.lit(0)).alias("v")))

# -- geometry -------------------------------------------------------------------------------

_TRANSFORM_SQL = {
    "rotate_0": ("y", "x"),
    "rotate_90": (f"{W - 1} - x", "y"),
    "rotate_180": (f"{H - 1} - y", f"{W - 1} - x"),
    "rotate_270": ("x", f"{H - 1} - y"),
    "transpose_rotate_0": ("x", "y"),
    "transpose_rotate_90": ("y", f"{W - 1} - x"),
    "transpose_rotate_180": (f"{W - 1} - x", f"{H - 1} - y"),
    "transpose_rotate_270": (f"{H - 1} - y", "x"),
}
for _n, (_y, _x) in _TRANSFORM_SQL.items():
    add(f"transform_{_n}", f"SELECT img, CAST({_y} AS BIGINT) AS y, CAST({_x} AS BIGINT) AS x, a AS v FROM p")(lambda p, n=_n: (lambda t: t.select("img", c("y").cast("long").alias("y"), c("x").cast("long").alias("x"), c("a").alias("v")))(G.transform(p.select(*KEY, "a"), n, W, H)))
add("reduce_gray_2x2", "SELECT img, y // 2 AS y, x // 2 AS x, (CAST(sum(a) AS BIGINT) * (4 // count(*)) + 2) // 4 AS v FROM p GROUP BY 1, 2, 3")(lambda p: G.reduce2x2(p, "a"))
add("reduce_gray_3x3", f"SELECT img, y // 2 AS y, x // 2 AS x, ({weights_sql(S.GAUSS3)} + 8) >> 4 AS v FROM n WHERE y % 2 = 0 AND x % 2 = 0", _N1)(lambda p: G.decimated(neighbourhood(p.select(*KEY, "a"), "a", 1), G.reduced_value(3)))
_B5 = [1, 4, 6, 4, 1]
add("reduce_gray_5x5", f"SELECT img, y // 2 AS y, x // 2 AS x, ({weights_sql([[a * b for b in _B5] for a in _B5])} + 128) >> 8 AS v FROM n WHERE y % 2 = 0 AND x % 2 = 0", _N2)(lambda p: G.decimated(neighbourhood(p.select(*KEY, "a"), "a", 2), G.reduced_value(5)))
add("stretch_gray_2x2", "SELECT img, y * 2 + dy AS y, x * 2 + dx AS x, a AS v FROM p, (VALUES (0), (1)) AS i(dy), (VALUES (0), (1)) AS j(dx)")(lambda p: G.stretch2x2(p, "a").select("img", c("y").cast("long").alias("y"), c("x").cast("long").alias("x"), "v"))
add("resize_nearest", f"SELECT p.img, d.y, e.x, p.a AS v FROM p JOIN (SELECT y, CAST(floor((y + 0.5) * {H} / 17) AS BIGINT) AS sy FROM (SELECT unnest(range(17)) AS y)) d ON d.sy = p.y JOIN (SELECT x, CAST(floor((x + 0.5) * {W} / 33) AS BIGINT) AS sx FROM (SELECT unnest(range(33)) AS x)) e ON e.sx = p.x")(
    lambda p: G.nearest(p, "a", (W, H), (33, 17)).select("img", c("y").cast("long").alias("y"), c("x").cast("long").alias("x"), "v")
)
_AX = "(SELECT {d}, least(greatest(({d} + 0.5::DOUBLE) * ({n}::DOUBLE / {dn}::DOUBLE) - 0.5::DOUBLE, 0::DOUBLE), {n} - 1.0::DOUBLE) AS pos FROM (SELECT unnest(range({dn})) AS {d}))"
add(
    "resize_bilinear",
    f"SELECT p.img, d.y, e.x, CAST(round_even(sum(p.a * greatest(1 - abs(d.pos - p.y), 0) * greatest(1 - abs(e.pos - p.x), 0)) * 1000, 0) AS BIGINT) AS v FROM p JOIN {_AX.format(d='y', n=H, dn=17)} d ON abs(d.pos - p.y) < 1 JOIN {_AX.format(d='x', n=W, dn=33)} e ON abs(e.pos - p.x) < 1 GROUP BY 1, 2, 3",
)(lambda p: G.bilinear(p, "a", (W, H), (33, 17)).select("img", c("y").cast("long").alias("y"), c("x").cast("long").alias("x"), F.rint(c("v") * 1000).cast("long").alias("v")))

# -- pyramids --------------------------------------------------------------------------------


def pyramid(p, levels: int = 3):
    """img, lvl, y, x, v: all levels; a level is made from the one before."""
    level = p.select("img", "y", "x", c("a").alias("v"))
    out = level.withColumn("lvl", F.lit(0))
    for k in range(1, levels + 1):
        level = G.reduce2x2(level, "v")
        out = out.unionByName(level.withColumn("lvl", F.lit(k)))
    return out


_PYR = ", l0 AS (SELECT img, y, x, a AS v FROM p)" + "".join(f", l{k} AS (SELECT img, y // 2 AS y, x // 2 AS x, (CAST(sum(v) AS BIGINT) * (4 // count(*)) + 2) // 4 AS v FROM l{k - 1} GROUP BY 1, 2, 3)" for k in (1, 2, 3))
add("build_pyramid", " UNION ALL ".join(f"SELECT img, y, x, v, {k} AS lvl FROM l{k}" for k in range(4)), _PYR)(pyramid)
