"""Queries on pixel formats: channel orders, planar and packed YUV, Bayer mosaics, CIELAB, fills, half floats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color as C
from ..functions.bits import bfloat16, bfloat16_bits, float16, float16_bits
from ..functions.numeric import average, blend, div255
from ..model import HEIGHT as H
from ..model import PIXELS_SQL as P
from ..model import WIDTH as W
from ..model import neighbourhood, neighbourhood_sql, pixels
from .images import _HUE, _backward_sql, _forward_sql, clamp_sql, div255_sql

QUERIES: dict = {}
SQL: dict = {}
c = F.col
KEY = ["img", "y", "x"]


def add(name: str, sql: str, tail: str = ""):
    """Register a query on the pixel relation; sql follows the relation's common table expression."""

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(pixels(spark, sf_dir))
        SQL[name] = f"WITH {P}{tail} {sql}"
        return f

    return put


def longs(columns: dict) -> list[Column]:
    return [v.cast("long").alias(k) for k, v in columns.items()]


def project(name: str, columns, sql: dict, source: str = "p", tail: str = "", prepare=lambda p: p) -> None:
    """A projection of pixels, of `prepare`d ones where a cell's pixels have to meet first."""
    add(name, "SELECT img, y, x, " + ", ".join(f"CAST({v} AS BIGINT) AS {k}" for k, v in sql.items()) + f" FROM {source}", tail)(lambda p: prepare(p).select(*KEY, *longs(columns())))


def channels(*values) -> dict:
    return {f"v{i}": v for i, v in enumerate(values)}


# -- channel orders: a, b, c, al are blue, green, red and alpha ---------------------------

ALPHA = 200
for _name, _order in {
    "bgra_to_bgr": "a b c",
    "bgra_to_rgb": "c b a",
    "bgra_to_rgba": "c b a al",
    "rgb_to_bgra": f"c b a {ALPHA}",
    "gray_to_bgra": f"a a a {ALPHA}",
    "interleave_bgr": "a b c",
    "interleave_bgra": "a b c al",
}.items():
    _order = _order.split()
    project(_name, lambda _order=_order: channels(*[F.lit(int(k)) if k.isdigit() else c(k) for k in _order]), channels(*_order))
project("rgba_to_gray", lambda: {"gray": C.gray(c("c"), c("b"), c("a")), "alpha": c("al")}, {"gray": "(1868 * c + 9617 * b + 4899 * a + 8192) >> 14", "alpha": "al"})
project("reorder_64bit", lambda: {"v": sum((c(k) * (1 << 8 * (6 - i)) for i, k in enumerate(("a", "b", "c", "al", "m", "y", "x"))), F.lit(0))}, {"v": " + ".join(f"{k} * {1 << 8 * (6 - i)}" for i, k in enumerate(("a", "b", "c", "al", "m", "y", "x")))})
project("copy", lambda: channels(c("a"), c("b"), c("c"), c("al")), channels("a", "b", "c", "al"))
project("fill", lambda: {"v": F.lit(77)}, {"v": "77"})
project("fill_bgr", lambda: channels(*map(F.lit, (10, 20, 30))), channels("10", "20", "30"))
project("fill_bgra", lambda: channels(*map(F.lit, (10, 20, 30, 40))), channels("10", "20", "30", "40"))
project("fill_pixel", lambda: channels(*map(F.lit, (5, 250))), channels("5", "250"))
add("fill_32f", "SELECT img, y, x, 0.25::DOUBLE AS v, 0.0::DOUBLE AS zero FROM p")(lambda p: p.select(*KEY, F.lit(0.25).alias("v"), F.lit(0.0).alias("zero")))
add("deinterleave_uv", "SELECT img, y, x, 0 AS ch, uv // 256 AS v FROM q UNION ALL SELECT img, y, x, 1, uv % 256 FROM q", ", q AS (SELECT *, a * 256 + b AS uv FROM p)")(
    lambda p: p.select(*KEY, (c("a") * 256 + c("b")).alias("uv")).select(*KEY, F.posexplode(F.array(F.shiftright("uv", 8), c("uv") % 256))).select(*KEY, c("pos").alias("ch"), c("col").alias("v"))
)
add("deinterleave_bgra", " UNION ALL ".join(f"SELECT img, y, x, {i} AS ch, {k} AS v FROM p" for i, k in enumerate(("a", "b", "c", "al"))))(
    lambda p: p.select(*KEY, F.posexplode(F.array("a", "b", "c", "al"))).select(*KEY, c("pos").alias("ch"), c("col").alias("v"))
)
for _m, ((_tl, _tr), (_bl, _br)) in C.BAYER.items():
    _pick = {"b": "a", "g": "b", "r": "c"}
    project(
        f"bgra_to_bayer_{_m}",
        lambda _m=_m: {"v": C.bayer(c("a"), c("b"), c("c"), c("y"), c("x"), _m)},
        {"v": f"CASE y % 2 * 2 + x % 2 WHEN 0 THEN {_pick[_tl]} WHEN 1 THEN {_pick[_tr]} WHEN 2 THEN {_pick[_bl]} ELSE {_pick[_br]} END"},
    )


# -- planar YUV ------------------------------------------------------------------------------


def planes(df: DataFrame, dy: int, dx: int, standard: str, alpha: bool = False) -> DataFrame:
    """img, plane, y, x, v of all planes: full-size luma (and alpha), chroma from the rounded mean colour of dy x dx cells.

    Luma needs no shuffle; chroma adds up a cell's pixels in one.
    """
    luma = C.bgr_to_yuv(c("a"), c("b"), c("c"), standard)["y"]
    full = {"y": luma} | ({"a": c("al")} if alpha else {})
    out = df.select(*KEY, F.explode(F.array(*[F.struct(F.lit(k).alias("plane"), v.cast("long").alias("v")) for k, v in full.items()])).alias("s")).select("img", "s.plane", "y", "x", "s.v")
    n = dy * dx
    cells = df.groupBy("img", F.expr(f"y div {dy}").alias("y"), F.expr(f"x div {dx}").alias("x")).agg(*[F.floor((F.sum(k) + n // 2) / n).alias(k) for k in "abc"])
    yuv = C.bgr_to_yuv(c("a"), c("b"), c("c"), standard)
    chroma = cells.select("img", "y", "x", F.explode(F.array(*[F.struct(F.lit(k).alias("plane"), yuv[k].cast("long").alias("v")) for k in "uv"])).alias("s"))
    return out.unionByName(chroma.select("img", "s.plane", "y", "x", "s.v"))


def _planes_sql(dy: int, dx: int, standard: str, alpha: bool) -> tuple[str, str]:
    f, n = _forward_sql(standard), dy * dx
    cells = f", m AS (SELECT img, y // {dy} AS y, x // {dx} AS x, " + ", ".join(f"(CAST(sum({k}) AS BIGINT) + {n // 2}) // {n} AS {k}" for k in "abc") + " FROM p GROUP BY 1, 2, 3)"
    parts = [("p", "y", f["y"])] + ([("p", "a", "al")] if alpha else []) + [("m", "u", f["u"]), ("m", "v", f["v"])]
    return " UNION ALL ".join(f"SELECT img, '{k}' AS plane, y, x, CAST({v} AS BIGINT) AS v FROM {t}" for t, k, v in parts), cells


def cells_of(p: DataFrame, dy: int, dx: int) -> DataFrame:
    """Every pixel with u, v: columns b and c of its cell's first pixel; a cell's pixels meet in one shuffle."""
    cell = Window.partitionBy("img", F.expr(f"y div {dy}"), F.expr(f"x div {dx}"))
    first = (c("y") % dy == 0) & (c("x") % dx == 0)
    return p.withColumns({"u": F.max(F.when(first, c("b"))).over(cell), "v": F.max(F.when(first, c("c"))).over(cell)})


CELLS_SQL = ", q AS (SELECT p.*, f.b AS u, f.c AS v FROM p JOIN p AS f ON p.img = f.img AND f.y = p.y // {dy} * {dy} AND f.x = p.x // {dx} * {dx})"
_CELL = {"444p": (1, 1), "422p": (1, 2), "420p": (2, 2)}

for _s in C.STANDARDS:
    for _form, (_dy, _dx) in _CELL.items():
        for _from, _alpha in (("bgr", False), ("bgra", False), ("bgra", True)):
            if _alpha and _form != "420p":
                continue
            _sql, _tail = _planes_sql(_dy, _dx, _s, _alpha)
            add(f"{_from}_to_yuv{'a' * _alpha}{_form}_planes_{_s}", _sql, _tail)(lambda p, dy=_dy, dx=_dx, s=_s, alpha=_alpha: planes(p, dy, dx, s, alpha))
        _back = _backward_sql(_s, "a", "u", "v")
        for _to, _extra in (("bgra", str(ALPHA)), ("rgb", None), ("rgba", str(ALPHA)), ("bgra_alpha", "al")):
            if _to == "rgba" and _form != "444p":
                continue
            _order = "rgb" if _to.startswith("rgb") else "bgr"
            _name = f"yuva{_form}_to_bgra_{_s}" if _to == "bgra_alpha" else f"yuv{_form}_to_{_to}_{_s}"

            def _columns(s=_s, order=_order, extra=_extra):
                bgr = C.yuv_to_bgr(c("a"), c("u"), c("v"), s)
                return channels(*[bgr[k] for k in order], *([] if extra is None else [c("al") if extra == "al" else F.lit(int(extra))]))

            project(
                _name,
                _columns,
                channels(*[_back[k] for k in _order], *([] if _extra is None else [_extra])),
                "q",
                CELLS_SQL.format(dy=_dy, dx=_dx),
                lambda p, dy=_dy, dx=_dx: cells_of(p, dy, dx) if dx > 1 else p.withColumns({"u": c("b"), "v": c("c")}),
            )


def _yuv_hue() -> dict:
    bgr = C.yuv_to_bgr(c("a"), c("u"), c("v"), "bt601")
    return {"hue": C.hue(bgr["b"], bgr["g"], bgr["r"])}


_B = _backward_sql("bt601", "a", "u", "v")
project("yuv420p_to_hue", _yuv_hue, {"hue": _HUE}, "r", CELLS_SQL.format(dy=2, dx=2) + f", r AS (SELECT img, y, x, {_B['b']} AS a, {_B['g']} AS b, {_B['r']} AS c FROM q)", lambda p: cells_of(p, 2, 2))

# -- packed UYVY: a pixel has a chroma byte b (u in even columns, v in odd ones) and a luma byte a -----


def uyvy(p: DataFrame) -> DataFrame:
    """Pixels with the u and v of their pair of columns."""
    pair = Window.partitionBy("img", "y", F.expr("x div 2"))
    return p.withColumns({"u": F.max(F.when(c("x") % 2 == 0, c("b"))).over(pair), "v": F.max(F.when(c("x") % 2 == 1, c("b"))).over(pair)})


UYVY_SQL = ", q AS (SELECT p.*, e.b AS u, o.b AS v FROM p JOIN p AS e ON p.img = e.img AND p.y = e.y AND e.x = p.x // 2 * 2 JOIN p AS o ON p.img = o.img AND p.y = o.y AND o.x = p.x // 2 * 2 + 1)"
for _s in C.STANDARDS:
    _back = _backward_sql(_s, "a", "u", "v")
    project(f"uyvy422_to_bgr_{_s}", lambda s=_s: channels(*C.yuv_to_bgr(c("a"), c("u"), c("v"), s).values()), channels(_back["b"], _back["g"], _back["r"]), "q", UYVY_SQL, uyvy)


@add(
    "uyvy422_to_yuv420p",
    "SELECT img, 'y' AS plane, y, x, a AS v FROM p UNION ALL SELECT img, CASE WHEN x % 2 = 0 THEN 'u' ELSE 'v' END, y // 2, x // 2, (CAST(sum(b) AS BIGINT) + 1) // 2 FROM p GROUP BY img, x % 2, y // 2, x // 2",
)
def _uyvy_planes(p: DataFrame) -> DataFrame:
    """Luma as it is; chroma bytes of two rows are averaged."""
    chroma = p.groupBy("img", F.when(c("x") % 2 == 0, "u").otherwise("v").alias("plane"), F.expr("y div 2").alias("y"), F.expr("x div 2").alias("x"))
    return p.select("img", F.lit("y").alias("plane"), "y", "x", c("a").alias("v")).unionByName(chroma.agg(F.shiftright(F.sum("b") + 1, 1).alias("v")))


project("yuv420p_to_uyvy422", lambda: {"chroma": F.when(c("x") % 2 == 0, c("u")).otherwise(c("v")), "luma": c("a")}, {"chroma": "CASE WHEN x % 2 = 0 THEN u ELSE v END", "luma": "a"}, "q", CELLS_SQL.format(dy=2, dx=2), lambda p: cells_of(p, 2, 2))


# -- demosaicing -----------------------------------------------------------------------------


def _bayer(site: str, y_first, at, mean, pick, green) -> tuple:
    """blue, green, red of a site; `at` reads a neighbour, `mean` averages, `green` is edge-directed."""
    diagonal = mean(at(-1, -1), at(-1, 1), at(1, -1), at(1, 1))
    if site == "b":
        return at(0, 0), green, diagonal
    if site == "r":
        return diagonal, green, at(0, 0)
    beside, above = mean(at(0, -1), at(0, 1)), mean(at(-1, 0), at(1, 0))
    return (beside, at(0, 0), above) if y_first == "b" else (above, at(0, 0), beside)


def demosaic(p: DataFrame, mosaic: str, value: str = "a") -> DataFrame:
    """Pixels with v0, v1, v2 (blue, green, red) from a mosaic: green along the smoother direction, the others by means.

    A border repeats the mosaic's nearest cell of two by two.
    """

    def at(dy: int, dx: int) -> Column:
        def inside(d: int, k: str, n: int):
            return (c(k) + d >= 0) & (c(k) + d < n)

        def column(i: int, j: int) -> Column:
            return c(f"n{i + 2}{j + 2}")

        back = lambda d: -d if abs(d) == 1 else 0
        out = F.when(inside(dx, "x", W), column(dy, dx)).otherwise(column(dy, back(dx))) if dx else column(dy, 0)
        if dy:
            other = F.when(inside(dx, "x", W), column(back(dy), dx)).otherwise(column(back(dy), back(dx))) if dx else column(back(dy), 0)
            out = F.when(inside(dy, "y", H), out).otherwise(other)
        return out

    def mean(*v: Column) -> Column:
        return average(*v) if len(v) == 2 else F.shiftright(v[0] + v[1] + v[2] + v[3] + 2, 2)

    up, side = F.abs(at(-2, 0) - at(2, 0)), F.abs(at(0, -2) - at(0, 2))
    green = F.when(up < side, mean(at(-1, 0), at(1, 0))).when(up > side, mean(at(0, -1), at(0, 1))).otherwise(mean(at(0, -1), at(-1, 0), at(0, 1), at(1, 0)))
    pattern, out = C.BAYER[mosaic], []
    for channel in range(3):
        value_ = F.lit(0)
        for i in (0, 1):
            for j in (0, 1):
                own = _bayer(pattern[i][j], pattern[i][1 - j], at, mean, None, green)[channel]
                value_ = F.when((c("y") % 2 == i) & (c("x") % 2 == j), own).otherwise(value_)
        out.append(value_.cast("long").alias(f"v{channel}"))
    return neighbourhood(p, value, 2).select(*KEY, *out)


def _demosaic_sql(mosaic: str) -> str:
    def at(dy: int, dx: int) -> str:
        def row(k: str, d: int, n: int) -> str:
            return f"CASE WHEN {k} + ({d}) BETWEEN 0 AND {n - 1} THEN {d} ELSE {-d if abs(d) == 1 else 0} END"

        return f"list_extract(w, ({row('y', dy, H)} + 2) * 5 + {row('x', dx, W)} + 3)"

    def mean(*v: str) -> str:
        return f"(({' + '.join(v)} + {len(v) // 2}) // {len(v)})"

    up, side = f"abs({at(-2, 0)} - {at(2, 0)})", f"abs({at(0, -2)} - {at(0, 2)})"
    green = f"CASE WHEN {up} < {side} THEN {mean(at(-1, 0), at(1, 0))} WHEN {up} > {side} THEN {mean(at(0, -1), at(0, 1))} ELSE {mean(at(0, -1), at(-1, 0), at(0, 1), at(1, 0))} END"
    pattern = C.BAYER[mosaic]
    cases = lambda ch: "CASE y % 2 * 2 + x % 2 " + " ".join(f"WHEN {2 * i + j} THEN {_bayer(pattern[i][j], pattern[i][1 - j], at, mean, None, green)[ch]}" for i in (0, 1) for j in (0, 1)) + " END"
    return "SELECT img, y, x, " + ", ".join(f"CAST({cases(k)} AS BIGINT) AS v{k}" for k in range(3))


_WINDOW = ", " + neighbourhood_sql("a", 2) + ", g AS (SELECT img, y, x, [" + ", ".join(f"n{i}{j}" for i in range(5) for j in range(5)) + "] AS w FROM n)"
for _m in C.BAYER:
    add(f"bayer_to_bgr_{_m}", _demosaic_sql(_m) + " FROM g", _WINDOW)(lambda p, m=_m: demosaic(p, m))
    add(f"bayer_to_bgra_{_m}", _demosaic_sql(_m) + f", {ALPHA} AS v3 FROM g", _WINDOW)(lambda p, m=_m: demosaic(p, m).withColumn("v3", F.lit(ALPHA)))


# -- CIELAB --------------------------------------------------------------------------------------

#: sRGB to XYZ under D65, rows of red, green and blue, and the white point.
XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
WHITE = (0.950456, 1.0, 1.088754)
#: Linear light has 3 bits below a grey level, weights have 12, cube roots 15.
_GAMMA, _MATRIX, _ROOT = 3, 12, 15


def _lab() -> dict:
    linear = lambda v: F.rint(255 * (1 << _GAMMA) * F.when(v / F.lit(255.0) <= 0.04045, v / F.lit(255.0 * 12.92)).otherwise(F.pow((v / F.lit(255.0) + 0.055) / 1.055, F.lit(2.4))))
    r, g, b = (linear(c(k)).cast("long") for k in "cba")

    def root(row: int) -> Column:
        weights = [round((1 << _MATRIX) * w / WHITE[row]) for w in XYZ[row]]
        level = F.shiftright(weights[0] * r + weights[1] * g + weights[2] * b + (1 << _MATRIX - 1), _MATRIX)
        t = level / F.lit(255.0 * (1 << _GAMMA))
        value = F.rint((1 << _ROOT) * F.when(t < 216 / 24389, t * (841 / 108) + 16 / 116).otherwise(F.cbrt(t))).cast("long")
        return F.when((level == 324) & (value == 17746), 17745).when((level == 49) & (value == 9455), 9454).otherwise(value)  # fixed values: two exceptions

    x, y, z = root(0), root(1), root(2)
    half = 1 << _ROOT - 1
    bounded = lambda v: F.least(F.greatest(F.shiftright(v, _ROOT), F.lit(0)), F.lit(255))
    return {"l": bounded(296 * y - (16 * 255 * (1 << _ROOT) + 50) // 100 + half), "a_": bounded(500 * (x - y) + (128 << _ROOT) + half), "b_": bounded(200 * (y - z) + (128 << _ROOT) + half)}


def _lab_sql() -> tuple[dict, str]:
    linear = lambda k: f"CAST(round_even({255 << _GAMMA} * CASE WHEN {k} / 255.0::DOUBLE <= 0.04045::DOUBLE THEN {k} / (255.0::DOUBLE * 12.92::DOUBLE) ELSE pow(({k} / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END, 0) AS BIGINT)"
    tail = f", li AS (SELECT img, y, x, {linear('c')} AS r, {linear('b')} AS g, {linear('a')} AS bl FROM p)"
    levels = [f"({' + '.join(f'{round((1 << _MATRIX) * w / WHITE[i])} * {k}' for w, k in zip(XYZ[i], ('r', 'g', 'bl')))} + {1 << _MATRIX - 1}) >> {_MATRIX}" for i in range(3)]
    tail += ", le AS (SELECT img, y, x, " + ", ".join(f"{v} AS t{i}" for i, v in enumerate(levels)) + " FROM li)"
    t = lambda i: f"(t{i} / {float(255 << _GAMMA)}::DOUBLE)"
    root = lambda i: f"CASE WHEN t{i} = 324 THEN 17745 WHEN t{i} = 49 THEN 9454 ELSE CAST(round_even({1 << _ROOT} * CASE WHEN {t(i)} < 216::DOUBLE / 24389 THEN {t(i)} * (841::DOUBLE / 108) + 16::DOUBLE / 116 ELSE cbrt({t(i)}) END, 0) AS BIGINT) END"
    tail += ", f AS (SELECT img, y, x, " + ", ".join(f"{root(i)} AS f{i}" for i in range(3)) + " FROM le)"
    half = 1 << _ROOT - 1
    bounded = lambda v: clamp_sql(f"({v}) >> {_ROOT}")
    return {"l": bounded(f"296 * f1 - {(16 * 255 * (1 << _ROOT) + 50) // 100} + {half}"), "a_": bounded(f"500 * (f0 - f1) + {128 << _ROOT} + {half}"), "b_": bounded(f"200 * (f1 - f2) + {128 << _ROOT} + {half}")}, tail


_values, _tail = _lab_sql()
project("bgr_to_lab", _lab, _values, "f", _tail)

# -- half and bfloat16 storage -------------------------------------------------------------------

_X = "((a - 128) * 37.5::DOUBLE + b / 7.0::DOUBLE) / (1 + c * c * 3)"


def _real() -> Column:
    return ((c("a") - 128) * F.lit(37.5) + c("b") / F.lit(7.0)) / (1 + c("c") * c("c") * 3)


def half_sql(x: str) -> str:
    """Bits of the half float nearest to x, for 0 or normal and subnormal magnitudes below the largest half."""
    e = f"greatest(CAST(floor(log2(greatest(abs({x}), 1e-9::DOUBLE))) AS BIGINT), -14)"
    q = f"CAST(round_even(abs({x}) * pow(2.0::DOUBLE, 10 - {e}), 0) AS BIGINT)"
    return f"(CASE WHEN {x} < 0 THEN 32768 ELSE 0 END + ({e} + 14) * 1024 + {q})"


def bfloat_sql(x: str) -> str:
    e = f"CAST(floor(log2(abs({x}))) AS BIGINT)"
    return f"CASE WHEN {x} = 0 THEN 0 ELSE CASE WHEN {x} < 0 THEN 32768 ELSE 0 END + ({e} + 126) * 128 + CAST(round_even(abs({x}) * pow(2.0::DOUBLE, 7 - {e}), 0) AS BIGINT) END"


project("float32_to_float16", lambda: {"bits": float16_bits(_real())}, {"bits": half_sql("r")}, "z", f", z AS (SELECT img, y, x, CAST(CAST({_X} AS FLOAT) AS DOUBLE) AS r FROM p)")
project("float32_to_bfloat16", lambda: {"bits": bfloat16_bits(_real())}, {"bits": bfloat_sql("r")}, "z", f", z AS (SELECT img, y, x, CAST(CAST({_X} AS FLOAT) AS DOUBLE) AS r FROM p)")
_BITS = ", z AS (SELECT img, y, x, (a % 2) * 32768 + (b % 30) * 1024 + (c * 4 + al % 4) AS h, (a % 2) * 32768 + (100 + b % 50) * 128 + c % 128 AS bf FROM p)"
add("float16_to_float32", "SELECT img, y, x, CASE WHEN h >= 32768 THEN -1 ELSE 1 END * CASE WHEN h % 32768 < 1024 THEN (h % 1024) * pow(2.0::DOUBLE, -24) ELSE (1024 + h % 1024) * pow(2.0::DOUBLE, h % 32768 // 1024 - 25) END AS v FROM z", _BITS)(
    lambda p: p.select(*KEY, float16(c("a") % 2 * 32768 + c("b") % 30 * 1024 + c("c") * 4 + c("al") % 4).alias("v"))
)
add("bfloat16_to_float32", "SELECT img, y, x, CASE WHEN bf >= 32768 THEN -1 ELSE 1 END * (128 + bf % 128) * pow(2.0::DOUBLE, bf % 32768 // 128 - 134) AS v FROM z", _BITS)(
    lambda p: p.select(*KEY, bfloat16(c("a") % 2 * 32768 + (100 + c("b") % 50) * 128 + c("c") % 128).alias("v"))
)

# -- blending into planar YUV ------------------------------------------------------------------

_f = _forward_sql("bt601")
_blend = lambda s, d, a: div255_sql(f"({s}) * {a} + ({d}) * (255 - {a})")


@add(
    "alpha_blending_bgra_to_yuv420p",
    f"SELECT img, 'y' AS plane, y, x, CAST({_blend(_f['y'], 'm * 60', 'al')} AS BIGINT) AS v FROM p UNION ALL SELECT img, 'u', y, x, CAST({_blend(_f['u'], '90', 'al')} AS BIGINT) FROM m UNION ALL SELECT img, 'v', y, x, CAST({_blend(_f['v'], '160', 'al')} AS BIGINT) FROM m",
    ", m AS (SELECT img, y // 2 AS y, x // 2 AS x, " + ", ".join(f"(CAST(sum({k}) AS BIGINT) + 2) // 4 AS {k}" for k in ("a", "b", "c", "al")) + " FROM p GROUP BY 1, 2, 3)",
)
def _blended(p: DataFrame) -> DataFrame:
    """BGRA over a frame of luma 60 m and constant chroma: luma by its own alpha, chroma by the cell's mean colour and alpha."""
    luma = blend(C.bgr_to_yuv(c("a"), c("b"), c("c"))["y"], c("m") * 60, c("al"))
    cell = p.groupBy("img", F.expr("y div 2").alias("y"), F.expr("x div 2").alias("x")).agg(*[F.shiftright(F.sum(k) + 2, 2).alias(k) for k in ("a", "b", "c", "al")])
    yuv = C.bgr_to_yuv(c("a"), c("b"), c("c"))
    chroma = F.array(*[F.struct(F.lit(k).alias("plane"), blend(yuv[k], F.lit(d), c("al")).cast("long").alias("v")) for k, d in (("u", 90), ("v", 160))])
    return p.select("img", F.lit("y").alias("plane"), "y", "x", luma.cast("long").alias("v")).unionByName(cell.select("img", "y", "x", F.explode(chroma).alias("s")).select("img", "s.plane", "y", "x", "s.v"))


# -- outer product of a column and a row ------------------------------------------------------------


@add("vector_product", f"SELECT p.img, p.y, p.x, CAST({div255_sql('l.a * t.b')} AS BIGINT) AS v FROM p JOIN p AS l ON l.img = p.img AND l.y = p.y AND l.x = 0 JOIN p AS t ON t.img = p.img AND t.x = p.x AND t.y = 0")
def _outer(p: DataFrame) -> DataFrame:
    """Each image's first column of a times its first row of b; two small sides meet on the image."""
    vertical, horizontal = p.where("x = 0").select("img", "y", "a"), p.where("y = 0").select("img", "x", "b")
    return vertical.join(horizontal, "img").select("img", "y", "x", div255(c("a") * c("b")).cast("long").alias("v"))
