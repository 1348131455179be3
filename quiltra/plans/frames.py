"""Queries on matching, warping, drawing, quantised layers and relational operations over pixels, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import color as C
from ..functions.numeric import clamp, shr
from ..model import HEIGHT as H
from ..model import PIXELS_SQL as P
from ..model import WIDTH as W
from ..model import neighbourhood, neighbourhood_sql, pixels, table
from ..operators import geometry as G
from ..operators import matching as M
from ..operators import tensor as T
from .images import _backward_sql

QUERIES: dict = {}
SQL: dict = {}
c = F.col
KEY = ["img", "y", "x"]
V = "v AS (SELECT vec_id AS t, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"


def add(name: str, sql: str | None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def project(name: str, columns, sql: dict) -> None:
    add(name, f"WITH {P} SELECT img, y, x, " + ", ".join(f"CAST({v} AS BIGINT) AS {k}" for k, v in sql.items()) + " FROM p")(lambda s, d: pixels(s, d).select(*KEY, *[v.cast("long").alias(k) for k, v in columns().items()]))


def bounded(v: str, low=0, high=255) -> str:
    return f"least(greatest({v}, {low}), {high})"


# -- luma range, chained conversions ---------------------------------------------------

project("gray_to_y", lambda: {"v": clamp(shr(219 * c("a") + 128, 8) + 16, 16, 235)}, {"v": bounded("((219 * a + 128) >> 8) + 16", 16, 235)})
project("y_to_gray", lambda: {"v": clamp(shr(298 * (clamp(c("a"), 16, 235) - 16) + 128, 8))}, {"v": bounded(f"(298 * ({bounded('a', 16, 235)} - 16) + 128) >> 8")})


def _chained(to):
    bgr = C.yuv_to_bgr(c("a"), c("b"), c("c"), "bt601")
    return {f"o_{k}": v for k, v in to(bgr["b"], bgr["g"], bgr["r"]).items()}


_BGR = _backward_sql("bt601")
_Q = f"q AS (SELECT img, y, x, CAST({_BGR['b']} AS BIGINT) AS b, CAST({_BGR['g']} AS BIGINT) AS g, CAST({_BGR['r']} AS BIGINT) AS r FROM p), e AS (SELECT *, greatest(b, g, r) AS hi, least(b, g, r) AS lo FROM q)"
_HUE = "CASE WHEN hi = lo THEN 0 ELSE ((CASE WHEN r = hi THEN g - b + 6 * (hi - lo) WHEN g = hi THEN b - r + 2 * (hi - lo) ELSE r - g + 4 * (hi - lo) END) * 85 // (2 * (hi - lo))) % 256 END"
_S = "CASE WHEN hi = 0 THEN 0 ELSE 255 * (hi - lo) // hi END"
_L = "CASE WHEN hi + lo IN (0, 510) THEN 0 WHEN hi + lo <= 255 THEN 255 * (hi - lo) // (hi + lo) ELSE 255 * (hi - lo) // (510 - hi - lo) END"
for _n, _to, _cols in (
    ("yuv444p_to_hsv", C.bgr_to_hsv, {"o_h": _HUE, "o_s": _S, "o_v": "hi"}),
    ("yuv444p_to_hsl", C.bgr_to_hsl, {"o_h": _HUE, "o_s": _L, "o_l": "(hi + lo) // 2"}),
    ("yuv444p_to_hue", lambda b, g, r: {"h": C.hue(b, g, r)}, {"o_h": _HUE}),
):
    add(_n, f"WITH {P}, {_Q} SELECT img, y, x, " + ", ".join(f"CAST({v} AS BIGINT) AS {k}" for k, v in _cols.items()) + " FROM e")(lambda s, d, to=_to: pixels(s, d).select(*KEY, *[v.cast("long").alias(k) for k, v in _chained(to).items()]))
add("yuv422p_to_uyvy422", f"WITH {P} SELECT img, y, x * 2 AS x, CASE WHEN x % 2 = 0 THEN b ELSE c END AS v FROM p UNION ALL SELECT img, y, x * 2 + 1, a FROM p")(
    lambda s, d: pixels(s, d).select("img", "y", "x", F.posexplode(F.array(F.when(c("x") % 2 == 0, c("b")).otherwise(c("c")), c("a")))).select("img", "y", (c("x") * 2 + c("pos")).alias("x"), c("col").alias("v"))
)

# -- stencils with a reach of their own ----------------------------------------------------

_N1, _N2 = neighbourhood_sql("a", 1), neighbourhood_sql("a", 2)
_T4 = [1, 3, 3, 1]
_R4 = " + ".join(f"{_T4[i] * _T4[j]} * n{i + 1}{j + 1}" for i in range(4) for j in range(4))
add("reduce_gray_4x4", f"WITH {P}, {_N2} SELECT img, y // 2 AS y, x // 2 AS x, ({_R4} + 32) >> 6 AS v FROM n WHERE y % 2 = 0 AND x % 2 = 0")(
    lambda s, d: G.decimated(neighbourhood(pixels(s, d).select(*KEY, "a"), "a", 2), shr(sum((_T4[i] * _T4[j] * c(f"n{i + 1}{j + 1}") for i in range(4) for j in range(4)), F.lit(32)), 6))
)
_SD = "greatest(abs(n11 - ((n10 + n12 + 1) >> 1)), abs(n11 - ((n01 + n21 + 1) >> 1)))"
_IN = f"x > 0 AND y > 0 AND x < {W - 1} AND y < {H - 1}"
add("abs_second_derivative_histogram", f"WITH {P}, {_N1} SELECT img, CAST({_SD} AS BIGINT) AS bin, count(*) AS n FROM n WHERE {_IN} GROUP BY 1, 2")(
    lambda s, d: neighbourhood(pixels(s, d).select(*KEY, "a"), "a", 1)
    .where(_IN)
    .groupBy("img", F.greatest(F.abs(c("n11") - shr(c("n10") + c("n12") + 1, 1)), F.abs(c("n11") - shr(c("n01") + c("n21") + 1, 1))).alias("bin"))
    .agg(F.count(F.lit(1)).alias("n"))
)
_SMALL = f"d AS (SELECT img, y // 2 AS y, x // 2 AS x, (CAST(sum(c) AS BIGINT) + 2) // 4 % 4 AS v FROM p GROUP BY 1, 2, 3)"
_PAR = f"""g AS (SELECT p.*, (p.y - 1) // 2 AS py, (p.x - 1) // 2 AS px FROM p WHERE p.y BETWEEN 1 AND {H - 2} AND p.x BETWEEN 1 AND {W - 2}),
f AS (SELECT g.img, g.y, g.x, count(*) FILTER (WHERE d.v = 1) AS n FROM g JOIN d ON d.img = g.img AND d.y - g.py IN (0, 1) AND d.x - g.px IN (0, 1) GROUP BY 1, 2, 3)
SELECT p.img, p.y, p.x, CASE WHEN f.n IS NULL OR p.al >= 200 THEN p.al WHEN f.n = 4 OR f.n > 0 AND p.a > 100 THEN 1 ELSE 0 END AS v FROM p LEFT JOIN f ON f.img = p.img AND f.y = p.y AND f.x = p.x"""


def propagate(spark, sf_dir):
    """A coarse mask's index goes into the fine mask al, where four coarse pixels around hold it, or one of them and the difference a is over 100.

    The outer frame and pixels at or above the invalid index 200 stay; a coarse
    pixel sends itself to the four by four fine pixels that it is a corner of.
    """
    p = pixels(spark, sf_dir)
    coarse = p.groupBy("img", F.expr("y div 2").alias("py"), F.expr("x div 2").alias("px")).agg((shr(F.sum("c") + 2, 2) % 4).alias("v"))
    reach = lambda k: F.explode(F.sequence(2 * c(k) - 1, 2 * c(k) + 2))
    sent = coarse.select("img", "px", "v", reach("py").alias("y")).select("img", "y", "v", reach("px").alias("x"))
    inner = f"y between 1 and {H - 2} and x between 1 and {W - 2}"
    own = p.select(*KEY, "a", "al", F.lit(None).cast("long").alias("v"))
    met = own.unionByName(sent.where(inner).select(*KEY, F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("al"), "v"))
    met = met.groupBy(*KEY).agg(F.max("a").alias("a"), F.max("al").alias("al"), F.count("v").alias("around"), F.count_if(c("v") == 1).alias("n"))
    return met.select(*KEY, F.when((c("around") == 0) | (c("al") >= 200), c("al")).when((c("n") == 4) | ((c("n") > 0) & (c("a") > 100)), 1).otherwise(0).alias("v"))


add("segmentation_propagate_2x2", f"WITH {P}, {_SMALL}, {_PAR}")(propagate)

# -- matching ---------------------------------------------------------------------------------

_SIG = f"{P}, k AS (SELECT img, y // 10 AS cy, x // 10 AS cx, CAST(floor(avg(a)) AS BIGINT) AS v FROM p GROUP BY 1, 2, 3), g AS (SELECT img, list(v ORDER BY cy, cx) AS sig, CAST(floor(avg(v)) AS BIGINT) AS mean FROM k GROUP BY img)"
add("image_matcher", f"WITH {_SIG}, d AS (SELECT p.img AS a, q.img AS b, CAST(list_sum(list_transform(list_zip(p.sig, q.sig), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM g p, g q WHERE p.img < q.img AND abs(p.mean - q.mean) <= 2) SELECT a, b, d FROM d WHERE d <= 15 * 100.0")(
    lambda s, d: M.near_images(M.signatures(pixels(s, d), "a", 10, (W // 10, H // 10)), 2, 10.0, (W // 10, H // 10))
)
_OFF = "o AS (SELECT dy, dx FROM (SELECT unnest(range(-2, 3)) AS dy), (SELECT unnest(range(-2, 3)) AS dx))"
add("shift_detector", f"WITH {P}, {_OFF}, t AS (SELECT p.img, dy, dx, CAST(sum(abs(p.a - q.b)) AS BIGINT) AS s, count(*) AS n FROM p, o, p AS q WHERE q.img = p.img AND q.y = p.y + dy AND q.x = p.x + dx GROUP BY 1, 2, 3) SELECT img, dy, dx, s, n FROM t QUALIFY row_number() OVER (PARTITION BY img ORDER BY s / n, dy, dx) = 1")(
    lambda s, d: M.best_shift(pixels(s, d), "a", "b", 2)
)
_WARP = (0.75, -0.25, 3.0, 0.25, 0.75, -2.0)
add("warp_affine_nearest", f"WITH {P} SELECT p.img, p.y, p.x, coalesce(q.a, 11) AS v FROM p LEFT JOIN p AS q ON q.img = p.img AND q.x = CAST(floor(p.x * 0.75::DOUBLE + p.y * -0.25::DOUBLE + 3.5::DOUBLE) AS BIGINT) AND q.y = CAST(floor(p.x * 0.25::DOUBLE + p.y * 0.75::DOUBLE - 1.5::DOUBLE) AS BIGINT)")(
    lambda s, d: M.warp_nearest(pixels(s, d), "a", _WARP, (W, H), 11)
)
add("draw_rectangle", f"WITH {P} SELECT img, y, x, CASE WHEN y BETWEEN 4 AND 25 AND x BETWEEN 6 AND 43 AND (y IN (4, 25) OR x IN (6, 43)) THEN 255 ELSE a END AS v FROM p")(
    lambda s, d: pixels(s, d).select(*KEY, F.when(c("y").between(4, 25) & c("x").between(6, 43) & (c("y").isin(4, 25) | c("x").isin(6, 43)), F.lit(255)).otherwise(c("a")).alias("v"))
)

# -- layers --------------------------------------------------------------------------------------


def rows(spark, sf_dir):
    return T.exploded(table(spark, sf_dir, "embeddings"))


add("synet_normalize_v4", f"WITH {V}, k AS (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY t, i // 8)) AS n FROM v), m AS (SELECT *, avg(n) OVER (PARTITION BY t) AS a FROM k) SELECT t, CAST(i AS BIGINT) AS i, round(v * (1 + 0.5::DOUBLE * n / (a + 1e-6::DOUBLE)) + 0.1::DOUBLE, 6) + 1 AS v FROM m")(
    lambda s, d: rows(s, d)
    .withColumn("ch", F.floor(c("i") / 8))
    .withColumn("n", F.sqrt(F.sum(c("v") * c("v")).over(Window.partitionBy("t", "ch"))))
    .withColumn("a", F.avg("n").over(Window.partitionBy("t")))
    .select("t", "i", (F.round(c("v") * (1 + F.lit(0.5) * c("n") / (c("a") + F.lit(1e-6))) + F.lit(0.1), 6) + 1).alias("v"))
)
add("synet_channel_sum", f"WITH {V} SELECT t, CAST(i // 8 AS BIGINT) AS ch, round(sum(v), 6) AS s FROM v GROUP BY 1, 2")(lambda s, d: rows(s, d).groupBy("t", F.floor(c("i") / 8).alias("ch")).agg(F.round(F.sum("v"), 6).alias("s")))
_Q8 = "least(greatest(round_even(v / 0.005::DOUBLE, 0) + 128, 0), 255)"
add("synet_inner_product_8i", f"WITH {V}, q AS (SELECT t, i, CAST({_Q8} AS BIGINT) * ((i * 5) % 255 - 127) AS z FROM v), h AS (SELECT t, i // 2 AS k, least(greatest(sum(z), -32768), 32767) AS z FROM q GROUP BY 1, 2) SELECT t, CAST(sum(z) AS BIGINT) AS v FROM h GROUP BY t")(
    lambda s, d: rows(s, d)
    .select("t", F.floor(c("i") / 2).alias("k"), (T.quantize(c("v"), 0.005, 128) * ((c("i") * 5) % 255 - 127)).alias("z"))
    .groupBy("t", "k")
    .agg(F.least(F.greatest(F.sum("z"), F.lit(-32768)), F.lit(32767)).alias("z"))
    .groupBy("t")
    .agg(F.sum("z").cast("long").alias("v"))
)
add("synet_quantized_concat", f"WITH {V}, q AS (SELECT t, i, (CAST({_Q8} AS BIGINT) - 128) * 0.005::DOUBLE AS z FROM v) SELECT t, CAST(i AS BIGINT) AS i, CAST(least(greatest(round_even(z / 0.01::DOUBLE, 0) + 100, 0), 255) AS BIGINT) AS q FROM q UNION ALL SELECT t, CAST(i + 64 AS BIGINT), CAST(least(greatest(round_even(-z / 0.01::DOUBLE, 0) + 100, 0), 255) AS BIGINT) FROM q")(
    lambda s, d: (lambda q: q.select("t", "i", T.quantize(c("z"), 0.01, 100).alias("q")).unionByName(q.select("t", (c("i") + 64).alias("i"), T.quantize(-c("z"), 0.01, 100).alias("q"))))(rows(s, d).select("t", "i", T.dequantize(T.quantize(c("v"), 0.005, 128), 0.005, 128).alias("z")))
)
add("synet_deconvolution_2x2_stride2", f"WITH {P}, w(i, j, w) AS (VALUES (0, 0, 1), (0, 1, -2), (1, 0, 3), (1, 1, 4)) SELECT img, y * 2 + i AS y, x * 2 + j AS x, CAST(sum(a * w) AS BIGINT) AS v FROM p, w GROUP BY 1, 2, 3")(
    lambda s, d: pixels(s, d)
    .select("img", "y", "x", "a", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(w).alias("w")) for i, j, w in ((0, 0, 1), (0, 1, -2), (1, 0, 3), (1, 1, 4))])).alias("k"))
    .groupBy("img", (c("y") * 2 + c("k.i")).alias("y"), (c("x") * 2 + c("k.j")).alias("x"))
    .agg(F.sum(c("a") * c("k.w")).cast("long").alias("v"))
)
add("neural_pooling_1x1_max_3x3", f"WITH {P}, {_N1} SELECT img, y, x, greatest({', '.join(f'n{i}{j}' for i in range(3) for j in range(3))}) AS v FROM n")(lambda s, d: neighbourhood(pixels(s, d).select(*KEY, "a"), "a", 1).select(*KEY, F.greatest(*[c(f"n{i}{j}") for i in range(3) for j in range(3)]).alias("v")))
_WIN = "t AS (SELECT img, y // 2 AS ty, x // 2 AS tx, max(CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN a END) AS d00, max(CASE WHEN y % 2 = 0 AND x % 2 = 1 THEN a END) AS d01, max(CASE WHEN y % 2 = 1 AND x % 2 = 0 THEN a END) AS d10, max(CASE WHEN y % 2 = 1 AND x % 2 = 1 THEN a END) AS d11 FROM p GROUP BY 1, 2, 3)"
# -- relational operations over pixels -----------------------------------------------------------------

add("pixels_rollup", f"WITH {P} SELECT coalesce(img, -1) AS img, coalesce(m, -1) AS m, count(*) AS n, CAST(sum(a) AS BIGINT) AS s FROM p GROUP BY ROLLUP (p.img, p.m)")(lambda s, d: pixels(s, d).rollup("img", "m").agg(F.count(F.lit(1)).alias("n"), F.sum("a").cast("long").alias("s")).na.fill(-1, ["img", "m"]))
add("pixels_cube", f"WITH {P} SELECT coalesce(m, -1) AS m, coalesce(k, -1) AS k, count(*) AS n FROM (SELECT m, x % 5 AS k FROM p) z GROUP BY CUBE (z.m, z.k)")(lambda s, d: pixels(s, d).select("m", (c("x") % 5).alias("k")).cube("m", "k").agg(F.count(F.lit(1)).alias("n")).na.fill(-1, ["m", "k"]))
add("mask_semi_join", f"WITH {P} SELECT img, y, x, a AS v FROM p SEMI JOIN (SELECT img AS i, y AS j FROM p WHERE m = 0 AND a > 200) q ON p.img = q.i AND p.y = q.j")(lambda s, d: (lambda p: p.join(p.where("m = 0 and a > 200").select("img", "y"), ["img", "y"], "left_semi").select(*KEY, c("a").alias("v")))(pixels(s, d)))
add("mask_anti_join", f"WITH {P} SELECT img, y, x, a AS v FROM p ANTI JOIN (SELECT img AS i, y AS j FROM p WHERE m = 0 AND a > 240) q ON p.img = q.i AND p.y = q.j")(lambda s, d: (lambda p: p.join(p.where("m = 0 and a > 240").select("img", "y"), ["img", "y"], "left_anti").select(*KEY, c("a").alias("v")))(pixels(s, d)))
add("mask_intersect", f"WITH {P} SELECT img, y, x FROM p WHERE a > 100 INTERSECT SELECT img, y, x FROM p WHERE b > 100")(lambda s, d: (lambda p: p.where("a > 100").select(*KEY).intersect(p.where("b > 100").select(*KEY)))(pixels(s, d)))
add("mask_except", f"WITH {P} SELECT img, y, x FROM p WHERE a > 100 EXCEPT SELECT img, y, x FROM p WHERE b > 100")(lambda s, d: (lambda p: p.where("a > 100").select(*KEY).exceptAll(p.where("b > 100").select(*KEY)))(pixels(s, d)))
add("brightest_pixels_of_each_image", f"WITH {P} SELECT img, y, x, a AS v FROM p QUALIFY row_number() OVER (PARTITION BY img ORDER BY a DESC, y, x) <= 5")(
    lambda s, d: pixels(s, d).withColumn("r", F.row_number().over(Window.partitionBy("img").orderBy(F.desc("a"), "y", "x"))).where("r <= 5").select(*KEY, c("a").alias("v"))
)
