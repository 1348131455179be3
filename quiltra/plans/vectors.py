"""Queries over embeddings, tensors, event streams and byte strings, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..model import HEIGHT as H
from ..model import PIXELS_SQL as P
from ..model import WIDTH as W
from ..model import pixels, table
from ..operators import tensor as T

QUERIES: dict = {}
SQL: dict = {}
c = F.col
R = 6


def add(name: str, sql: str | None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


V = "v AS (SELECT vec_id AS t, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"


def rows(spark, sf_dir):
    return T.exploded(table(spark, sf_dir, "embeddings"))


def rounded(df, *keys):
    return df.select(*keys, F.round("v", R).alias("v"))


def elementwise(name: str, f, sql: str) -> None:
    """A projection of (t, i, v); both zeros count as one."""
    sql = f"WITH {V}, r AS (SELECT t, CAST(i AS BIGINT) AS i, round(CAST({sql} AS DOUBLE), {R}) AS v FROM v) SELECT t, i, CASE WHEN v = 0 THEN 0::DOUBLE ELSE v END AS v FROM r"
    add(name, sql)(lambda s, d: rows(s, d).select("t", "i", F.round(f(c("v")).cast("double"), R).alias("v")).withColumn("v", F.when(c("v") == 0, F.lit(0.0)).otherwise(c("v"))))


_ACT_SQL = {
    "elu": "CASE WHEN v >= 0 THEN v ELSE exp(v) - 1 END",
    "hard_sigmoid": "greatest(0::DOUBLE, least(v * 0.2::DOUBLE + 0.5::DOUBLE, 1::DOUBLE))",
    "hswish": "greatest(least(v, 3::DOUBLE) + 3::DOUBLE, 0::DOUBLE) * (1::DOUBLE / 6::DOUBLE) * v",
    "mish": "CASE WHEN v > 20 THEN v ELSE v * (1 - 2 / ((exp(v) + 1) * (exp(v) + 1) + 1)) END",
    "relu": "greatest(0::DOUBLE, v) + 0.1::DOUBLE * least(0::DOUBLE, v)",
    "restrict_range": "least(greatest(v, -0.1::DOUBLE), 0.1::DOUBLE)",
    "sigmoid": "1 / (1 + exp(-v))",
    "softplus": "CASE WHEN v > 20 THEN v ELSE ln(1 + exp(v)) END",
    "swish": "v / (1 + exp(-v))",
    "tanh": "tanh(v)",
}
for _n, _q in _ACT_SQL.items():
    elementwise(f"synet_{_n}_32f", T.ACTIVATIONS[_n], _q)
_UN_SQL = {"abs": "abs(v)", "ceil": "ceil(v)", "cos": "cos(v)", "exp": "exp(v)", "floor": "floor(v)", "neg": "-v", "rcp": "1 / v", "round": "round(v)", "sign": "sign(v)", "sin": "sin(v)", "sqrt": "sqrt(abs(v))", "zero": "0"}
for _n, _q in _UN_SQL.items():
    elementwise(f"synet_unary_{_n}", T.UNARY[_n], _q)
elementwise("neural_add_vector_multiplied_by_value", lambda v: v + (c("i") - 31) * F.lit(0.01), "v + (i - 31) * 0.01::DOUBLE")
elementwise("neural_add_value", lambda v: v + F.lit(0.25), "v + 0.25::DOUBLE")
elementwise("neural_derivative_sigmoid", lambda v: F.lit(3.0) * (1 - v) * v, "3::DOUBLE * (1 - v) * v")
elementwise("neural_derivative_tanh", lambda v: F.lit(3.0) * (1 - v * v), "3::DOUBLE * (1 - v * v)")
elementwise("neural_derivative_relu", lambda v: F.when(v > 0, F.lit(1.0)).otherwise(F.lit(0.01)), "CASE WHEN v > 0 THEN 1 ELSE 0.01 END")
elementwise("neural_pow", lambda v: F.pow(F.abs(v), F.lit(0.75)), "pow(abs(v), 0.75::DOUBLE)")
elementwise("neural_update_weights", lambda v: v + (F.lit(0.9) * 0.05 + F.lit(0.1) * v), "v + (0.9::DOUBLE * 0.05::DOUBLE + 0.1::DOUBLE * v)")
elementwise("neural_adaptive_gradient_update", lambda v: v - F.lit(0.01) * (v / 8) / F.sqrt(F.lit(0.5) + (v / 8) * (v / 8) + F.lit(1e-6)), "v - 0.01::DOUBLE * (v / 8) / sqrt(0.5::DOUBLE + (v / 8) * (v / 8) + 1e-6::DOUBLE)")
elementwise("synet_quantize_linear", lambda v: T.quantize(v, 0.005, 128), "least(greatest(round_even(v / 0.005::DOUBLE, 0) + 128, 0), 255)")
elementwise("synet_dequantize_linear", lambda v: T.dequantize(T.quantize(v, 0.005, 128), 0.005, 128), "(least(greatest(round_even(v / 0.005::DOUBLE, 0) + 128, 0), 255) - 128) * 0.005::DOUBLE")
elementwise("synet_convert_32f_to_8u", lambda v: F.least(F.greatest(F.rint(v * (c("i") % 4 + 1) * 100 + 128), F.lit(0)), F.lit(255)), "least(greatest(round_even(v * (i % 4 + 1) * 100 + 128, 0), 0), 255)")
elementwise("synet_scale_layer", lambda v: v * (c("i") % 8 + 1) * F.lit(0.5) + (c("i") % 8) * F.lit(0.25), "v * (i % 8 + 1) * 0.5::DOUBLE + (i % 8) * 0.25::DOUBLE")
elementwise("synet_add_bias", lambda v: v + (c("i") % 8) * F.lit(0.25), "v + (i % 8) * 0.25::DOUBLE")
elementwise("synet_prelu", lambda v: F.greatest(v, F.lit(0.0)) + (c("i") % 8) * F.lit(0.1) * F.least(v, F.lit(0.0)), "greatest(v, 0::DOUBLE) + (i % 8) * 0.1::DOUBLE * least(v, 0::DOUBLE)")
elementwise("synet_tiled_scale_2d", lambda v: v * (c("i") % 8 + 1) * (F.floor(c("i") / 8) + 2), "v * (i % 8 + 1) * (i // 8 + 2)")
elementwise("synet_quantized_add", lambda v: T.quantize(T.dequantize(T.quantize(v, 0.005, 128), 0.005, 128) + F.lit(0.1), 0.01, 100), "least(greatest(round_even(((least(greatest(round_even(v / 0.005::DOUBLE, 0) + 128, 0), 255) - 128) * 0.005::DOUBLE + 0.1::DOUBLE) / 0.01::DOUBLE, 0) + 100, 0), 255)")
add("synet_softmax_32f", f"WITH {V}, e AS (SELECT t, i, exp(v - max(v) OVER (PARTITION BY t)) AS e FROM v) SELECT t, CAST(i AS BIGINT) AS i, round(e / sum(e) OVER (PARTITION BY t), {R}) AS v FROM e")(lambda s, d: rounded(T.softmax(rows(s, d), ["t"]), "t", "i"))
add("synet_normalize", f"WITH {V} SELECT t, CAST(i AS BIGINT) AS i, round(v / sqrt(sum(v * v) OVER (PARTITION BY t) + 1e-10::DOUBLE), {R}) AS v FROM v")(lambda s, d: rounded(T.l2_normalize(rows(s, d), ["t"]), "t", "i"))
_LN = "WITH {V}, m AS (SELECT *, v - avg(v) OVER (PARTITION BY {k}) AS d FROM v) SELECT t, CAST(i AS BIGINT) AS i, round(d / sqrt(avg(d * d) OVER (PARTITION BY {k}) + 1e-5::DOUBLE), {R}) AS v FROM m"
add("synet_normalize_v2", _LN.format(V=V, k="t", R=R))(lambda s, d: rounded(T.layer_norm(rows(s, d), ["t"]), "t", "i"))
add("synet_normalize_v3", _LN.format(V=V, k="t, i // 8", R=R))(lambda s, d: rounded(T.layer_norm(rows(s, d).withColumn("ch", F.floor(c("i") / 8)), ["t", "ch"]), "t", "i"))
add("synet_lrn_cross_channels", f"WITH {V} SELECT t, CAST(i AS BIGINT) AS i, round(v * pow(1 + 0.5::DOUBLE * sum(v * v) OVER (PARTITION BY t ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), -0.75::DOUBLE), {R}) AS v FROM v")(
    lambda s, d: rows(s, d).withColumn("v", c("v") * F.pow(1 + F.lit(0.5) * F.sum(c("v") * c("v")).over(Window.partitionBy("t").orderBy("i").rowsBetween(-2, 2)), F.lit(-0.75))).select("t", "i", F.round("v", R).alias("v"))
)
add("synet_permute", f"WITH {V} SELECT t, CAST(i % 8 * 8 + i // 8 AS BIGINT) AS i, v FROM v")(lambda s, d: rows(s, d).select("t", (c("i") % 8 * 8 + F.floor(c("i") / 8)).cast("long").alias("i"), "v"))
add("synet_shuffle", f"WITH {V} SELECT t, CAST(i % 2 * 32 + i // 2 AS BIGINT) AS i, v FROM v")(lambda s, d: rows(s, d).select("t", (c("i") % 2 * 32 + F.floor(c("i") / 2)).cast("long").alias("i"), "v"))
add("synet_gather_elements", f"WITH {V} SELECT t, CAST(i AS BIGINT) AS i, embedding[(i * 7 + 3) % 64 + 1]::DOUBLE AS v FROM (SELECT vec_id AS t, embedding, unnest(range(64)) AS i FROM embeddings)")(
    lambda s, d: table(s, d, "embeddings").select(c("vec_id").alias("t"), "embedding", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))).alias("i")).select("t", "i", F.get("embedding", ((c("i") * 7 + 3) % 64).cast("int")).cast("double").alias("v"))
)
add("synet_eltwise", "SELECT vec_id AS t, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS prod, round(list_max(list_transform(embedding, lambda x: greatest(x::DOUBLE, -x::DOUBLE))), 6) AS mx FROM embeddings")(
    lambda s, d: table(s, d, "embeddings").select(c("vec_id").alias("t"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 6).alias("prod"), F.round(F.array_max(F.transform("embedding", lambda x: F.greatest(x.cast("double"), -x.cast("double")))), 6).alias("mx"))
)
add("vector_norm", "SELECT vec_id AS t, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS v FROM embeddings")(
    lambda s, d: table(s, d, "embeddings").select(c("vec_id").alias("t"), F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), 6).alias("v"))
)
_PAIRS = "SELECT q.vec_id AS q, r.vec_id AS r, round({e}, 5) AS d FROM embeddings q, embeddings r WHERE q.vec_id % 100 = 0"
add("cosine_distances_mxn", _PAIRS.format(e="1 - list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[])"))(lambda s, d: (lambda e: T.query_distances(e, e.where("vec_id % 100 = 0")).select("q", "r", F.round("d", 5).alias("d")))(table(s, d, "embeddings").select("vec_id", "embedding")))
_ADJ = "WITH o AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings) SELECT a.vec_id AS t, round({e}, 5) AS v FROM o a JOIN o b ON b.vec_id = a.vec_id + 1"


def adjacent(spark, sf_dir, f):
    """f() of neighbouring ids' vectors e and g."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", c("embedding").cast("array<double>").alias("e"))
    return e.join(e.select((c("vec_id") - 1).alias("vec_id"), c("e").alias("g")), "vec_id").select(c("vec_id").alias("t"), F.round(f(), 5).alias("v"))


_dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda a, v: a + v)
add("cosine_distance_32f", _ADJ.format(e="1 - list_cosine_similarity(a.e, b.e)"))(lambda s, d: adjacent(s, d, lambda: 1 - _dot("e", "g") / F.sqrt(_dot("e", "e") * _dot("g", "g"))))
add("squared_difference_sum_32f", _ADJ.format(e="pow(list_distance(a.e, b.e), 2)"))(lambda s, d: adjacent(s, d, lambda: F.aggregate(F.zip_with("e", "g", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda a, v: a + v)))
add("neural_product_sum", _ADJ.format(e="list_inner_product(a.e, b.e)"))(lambda s, d: adjacent(s, d, lambda: _dot("e", "g")))
_GRAM = f"WITH {V} SELECT CAST(a.i AS BIGINT) AS i, CAST(b.i AS BIGINT) AS j, round(sum(a.v * b.v), 4) AS v FROM v a JOIN v b ON a.t = b.t GROUP BY 1, 2"
for _n in ("gemm_32f", "gemm_full_32f"):  # C = A'A of all dimensions, under both names that it has had
    add(_n, _GRAM)(lambda s, d: T.gram(table(s, d, "embeddings")).select("i", "j", F.round("v", 4).alias("v")))
_IP = f"WITH {V}, w AS (SELECT unnest(range(4)) AS o) SELECT t, o, round(sum(v.v * (((i * 7 + o * 3) % 11) - 5) * 0.1::DOUBLE) + o * 0.5::DOUBLE, 5) AS v FROM v, w GROUP BY t, o"
add("synet_inner_product_32f", _IP)(
    lambda s, d: rows(s, d).select("t", "i", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("o")).groupBy("t", "o").agg(F.sum(c("v") * ((c("i") * 7 + c("o") * 3) % 11 - 5) * F.lit(0.1)).alias("v")).select("t", "o", F.round(c("v") + c("o") * 0.5, 5).alias("v"))
)
for _k, _st, _how in ((2, 2, "max"), (3, 2, "max"), (3, 1, "max"), (2, 2, "avg"), (3, 3, "avg")):
    _ow, _oh = (W - _k) // _st + 1, (H - _k) // _st + 1
    add(
        f"pooling_{_how}_{_k}x{_k}_stride{_st}",
        f"WITH {P}, o AS (SELECT y, x FROM (SELECT unnest(range({_oh})) AS y), (SELECT unnest(range({_ow})) AS x)) SELECT p.img, o.y, o.x, {'CAST(max(a) AS DOUBLE)' if _how == 'max' else 'round(avg(a), 6)'} AS v FROM o JOIN p ON p.y BETWEEN o.y * {_st} AND o.y * {_st} + {_k - 1} AND p.x BETWEEN o.x * {_st} AND o.x * {_st} + {_k - 1} GROUP BY 1, 2, 3",
    )(lambda s, d, k=_k, st=_st, how=_how: T.pool(pixels(s, d), "a", k, st, how, W, H).select("img", c("y").cast("long").alias("y"), c("x").cast("long").alias("x"), F.round(c("v").cast("double"), 6).alias("v")))
for _k in (2, 3, 4, 5):
    _w = [[(i * _k + j) % 5 - 2 for j in range(_k)] for i in range(_k)]
    add(
        f"convolution_{_k}x{_k}_forward",
        f"WITH {P}, w(i, j, w) AS (VALUES {', '.join(f'({i}, {j}, {x})' for i, r in enumerate(_w) for j, x in enumerate(r))}) SELECT p.img, p.y - i AS y, p.x - j AS x, CAST(sum(a * w) AS BIGINT) AS v FROM p, w WHERE p.y - i BETWEEN 0 AND {H - _k} AND p.x - j BETWEEN 0 AND {W - _k} GROUP BY 1, 2, 3",
    )(
        lambda s, d, k=_k, w=_w: pixels(s, d)
        .select("img", "y", "x", "a", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(x).alias("w")) for i, r in enumerate(w) for j, x in enumerate(r)])).alias("t"))
        .select("img", (c("y") - c("t.i")).alias("y"), (c("x") - c("t.j")).alias("x"), (c("a") * c("t.w")).alias("v"))
        .where(f"y between 0 and {H - k} and x between 0 and {W - k}")
        .groupBy("img", "y", "x")
        .agg(F.sum("v").cast("long").alias("v"))
    )
    add(
        f"convolution_{_k}x{_k}_sum",
        f"WITH {P}, t AS (SELECT unnest(range({_k})) AS i), u AS (SELECT unnest(range({_k})) AS j) SELECT i, j, CAST(sum(p.a * q.b) AS BIGINT) AS v FROM p, t, u, p AS q WHERE q.img = p.img AND q.y = p.y - i AND q.x = p.x - j AND q.y <= {H - _k} AND q.x <= {W - _k} GROUP BY 1, 2",
    )(
        lambda s, d, k=_k: T.tap_sums(pixels(s, d), "a", "b", k, W, H)
    )

# -- byte strings -----------------------------------------------------------------------------

add("base64_encode", "SELECT page_id, base64(encode(html)) AS v FROM pages")(lambda s, d: table(s, d, "pages").select("page_id", F.regexp_replace(F.base64(F.encode("html", "UTF-8")), "\r\n", "").alias("v")))
add("base64_decode", "SELECT page_id, decode(from_base64(base64(encode(url)))) AS v FROM pages")(lambda s, d: table(s, d, "pages").select("page_id", F.decode(F.unbase64(F.base64(F.encode("url", "UTF-8"))), "UTF-8").alias("v")))

# -- a stream of readings per sensor, replayed in order -----------------------------------------

_EV = "e AS (SELECT user_id, event_id, CAST(floor(value * 10) AS BIGINT) % 256 AS v FROM events)"


def readings(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_id", (F.floor(c("value") * 10) % 256).alias("v"))


add("stream_background_range", f"WITH {_EV} SELECT user_id, event_id, min(v) OVER w AS lo, max(v) OVER w AS hi FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")(
    lambda s, d: (lambda w: readings(s, d).select("user_id", "event_id", F.min("v").over(w).alias("lo"), F.max("v").over(w).alias("hi")))(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))
)
add("stream_frame_difference", f"WITH {_EV} SELECT user_id, event_id, abs(v - lag(v, 1, v) OVER (PARTITION BY user_id ORDER BY event_id)) AS d FROM e")(
    lambda s, d: readings(s, d).select("user_id", "event_id", F.abs(c("v") - F.coalesce(F.lag("v").over(Window.partitionBy("user_id").orderBy("event_id")), c("v"))).alias("d"))
)
add("stream_tumbling_statistic", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(floor(value * 10) AS BIGINT)) AS BIGINT) AS s FROM events GROUP BY 1, 2")(
    lambda s, d: table(s, d, "events").groupBy(F.window("ts", "1 hour").start.alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(c("value") * 10)).alias("s")).select("start", "event_type", "n", "s")
)
