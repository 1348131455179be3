"""Queries of layers on packed tensors - embeddings as 4 x 4 x 4 - and their SQL in long form."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.bits import bfloat16, bfloat16_bits
from ..model import table
from ..operators import layers as L
from ..operators import tensor as T

QUERIES: dict = {}
SQL: dict = {}
c = F.col
SHAPE = (4, 4, 4)
V = "v AS (SELECT vec_id AS t, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"
X = V + ", x AS (SELECT t, i // 16 AS c, i // 4 % 4 AS y, i % 4 AS x, v FROM v)"


def add(name: str, f, sql: str) -> None:
    QUERIES[name], SQL[name] = f, sql


def layer(name: str, f, sql: str, tail: str, shape=SHAPE) -> None:
    """f over tensors of `shape`; sql gives t, i, v from the CTEs of x and tail."""
    sql = f"WITH {X}{tail}, o AS ({sql}) SELECT t, CAST(i AS BIGINT) AS i, CASE WHEN round(v, 4) = 0 THEN 0::DOUBLE ELSE round(v, 4) END AS v FROM o"
    add(name, lambda s, d: L.exploded(L.on_tensors(table(s, d, "embeddings"), shape, f)), sql)


def weights(out: int, own: int, k: int, unit: float = 0.1) -> np.ndarray:
    o, ch, i, j = np.ogrid[:out, :own, :k, :k]
    return ((o * 31 + ch * 17 + i * 7 + j * 3) % 11 - 5) * unit


def bf_sql(v: str) -> str:
    """v rounded to bfloat16."""
    e = f"floor(log2(greatest(abs({v}), 1e-30::DOUBLE)))"
    return f"(sign({v}) * round_even(abs({v}) * pow(2.0::DOUBLE, 7 - {e}), 0) * pow(2.0::DOUBLE, {e} - 7))"


ACT_SQL = {
    "identity": "{v}",
    "relu": "greatest({v}, 0::DOUBLE)",
    "leaky_relu": "greatest({v}, 0::DOUBLE) + 0.1::DOUBLE * least({v}, 0::DOUBLE)",
    "restrict_range": "least(greatest({v}, 0::DOUBLE), 6::DOUBLE)",
    "elu": "CASE WHEN {v} >= 0 THEN {v} ELSE exp({v}) - 1 END",
    "hswish": "least(greatest({v} + 3, 0::DOUBLE), 6::DOUBLE) / 6 * {v}",
    "hard_sigmoid": "least(greatest({v} * 0.2::DOUBLE + 0.5::DOUBLE, 0::DOUBLE), 1::DOUBLE)",
    "swish": "{v} / (1 + exp(-({v})))",
    "mish": "{v} * tanh(ln(1 + exp({v})))",
}


def conv_sql(name: str, source: str, size: tuple[int, int, int], out: int, k: int, s=1, d=1, p=0, g=1, bias=False, act="identity", unit="0.1::DOUBLE", value="x.v", weight="{w}") -> tuple[str, tuple[int, int, int]]:
    """A CTE (t, c, y, x, v) of a convolution of `source`, and its size."""
    channels, h, w = size
    own, oh, ow = channels // g, (h + 2 * p - (k - 1) * d - 1) // s + 1, (w + 2 * p - (k - 1) * d - 1) // s + 1
    wt = weight.format(w=f"((((o.o * 31 + x.c % {own} * 17 + i.i * 7 + j.j * 3) % 11) - 5) * {unit})")
    total = f"sum({value} * {wt})" + (" + any_value(o.o) * 0.25::DOUBLE" if bias else "")
    inner = f"""SELECT x.t, o.o AS c, (x.y + {p} - i.i * {d}) // {s} AS y, (x.x + {p} - j.j * {d}) // {s} AS x, {total} AS v
FROM {source} AS x, (SELECT unnest(range({out})) AS o) o, (SELECT unnest(range({k})) AS i) i, (SELECT unnest(range({k})) AS j) j
WHERE o.o // {out // g} = x.c // {own} AND x.y + {p} - i.i * {d} BETWEEN 0 AND {(oh - 1) * s} AND (x.y + {p} - i.i * {d}) % {s} = 0
AND x.x + {p} - j.j * {d} BETWEEN 0 AND {(ow - 1) * s} AND (x.x + {p} - j.j * {d}) % {s} = 0 GROUP BY 1, 2, 3, 4"""
    return f", {name}_ AS ({inner}), {name} AS (SELECT t, c, y, x, {ACT_SQL[act].format(v='v')} AS v FROM {name}_)", (out, oh, ow)


def flat(source: str, size: tuple[int, int, int]) -> str:
    return f"SELECT t, c * {size[1] * size[2]} + y * {size[2]} + x AS i, v FROM {source}"


def bias(n: int) -> np.ndarray:
    return np.arange(n) * 0.25


# -- convolution: kernel, stride, dilation, pad, groups, activation --------------------------------

for _name, (_out, _k, _s, _d, _p, _g, _act) in {
    "k3_p1_relu": (6, 3, 1, 1, 1, 1, "relu"),
    "k3_s2_p1": (5, 3, 2, 1, 1, 1, "identity"),
    "k3_d2_p2_hswish": (4, 3, 1, 2, 2, 1, "hswish"),
    "k1_leaky_relu": (8, 1, 1, 1, 0, 1, "leaky_relu"),
    "depthwise_k3_p1_restrict": (4, 3, 1, 1, 1, 4, "restrict_range"),
    "groups2_k2_elu": (6, 2, 1, 1, 0, 2, "elu"),
    "k4_swish": (3, 4, 1, 1, 0, 1, "swish"),
    "k2_mish": (3, 2, 2, 1, 0, 1, "mish"),
    "k3_hard_sigmoid": (3, 3, 1, 1, 0, 1, "hard_sigmoid"),
}.items():
    _layer = L.Convolution(weights(_out, 4 // _g, _k), bias(_out), _s, _d, (_p,) * 4, _g, _act)
    _tail, _size = conv_sql("y1", "x", SHAPE, _out, _k, _s, _d, _p, _g, True, _act)
    layer(f"synet_convolution_32f_{_name}", _layer, flat("y1", _size), _tail)
    _tail, _size = conv_sql("y1", "x", SHAPE, _out, _k, _s, _d, _p, _g, True, _act, value=bf_sql("x.v"), weight=bf_sql("{w}"))
    layer(f"synet_convolution_16b_{_name}", lambda x, f=_layer.rounded(): f(L.bfloat16(x)), flat("y1", _size), _tail)

_layer = L.Convolution(weights(5, 4, 3), None, 2, 1, (1, 1, 1, 1))
_tail, _size = conv_sql("y1", "x", SHAPE, 5, 3, 2, 1, 1)
layer("neural_convolution_forward", lambda x, f=_layer: f(x), flat("y1", _size), _tail)

# -- fused sequences: pointwise, depthwise, pointwise -------------------------------------------------

_chain = [L.Convolution(weights(8, 4, 1), bias(8), activation="relu"), L.Convolution(weights(8, 1, 3), bias(8), pads=(1, 1, 1, 1), groups=8, activation="hswish"), L.Convolution(weights(4, 8, 1), bias(4))]


def _chain_sql(value="x.v", weight="{w}") -> tuple[str, tuple[int, int, int]]:
    one, size = conv_sql("y1", "x", SHAPE, 8, 1, bias=True, act="relu", value=value, weight=weight)
    two, size = conv_sql("y2", "y1", size, 8, 3, p=1, g=8, bias=True, act="hswish", value=value, weight=weight)
    three, size = conv_sql("y3", "y2", size, 4, 1, bias=True, value=value, weight=weight)
    return one + two + three, size


_tail, _size = _chain_sql()
layer("synet_merged_convolution_32f", lambda x: _chain[2](_chain[1](_chain[0](x))), flat("y3", _size), _tail)


def _rounded_chain(x: np.ndarray) -> np.ndarray:
    for f in _chain:
        x = f.rounded()(L.bfloat16(x))
    return x


_tail, _size = _chain_sql(bf_sql("x.v"), bf_sql("{w}"))
layer("synet_merged_convolution_16b", lambda x: np.rint(_rounded_chain(x) * 4), f"SELECT t, i, round_even(v * 4, 0) AS v FROM ({flat('y3', _size)})", _tail)

# -- deconvolution -----------------------------------------------------------------------------------


def deconv_sql(out: int, k: int, s: int, p: int, g: int, value="x.v", weight="{w}") -> tuple[str, tuple[int, int, int]]:
    own, n = out // g, (4 - 1) * s + k - 2 * p
    wt = weight.format(w=f"((((x.c * 31 + o.o % {own} * 17 + i.i * 7 + j.j * 3) % 11) - 5) * 0.1::DOUBLE)")
    return (
        f""", y1 AS (SELECT x.t, o.o AS c, x.y * {s} + i.i - {p} AS y, x.x * {s} + j.j - {p} AS x, sum({value} * {wt}) + any_value(o.o) * 0.25::DOUBLE AS v
FROM x, (SELECT unnest(range({out})) AS o) o, (SELECT unnest(range({k})) AS i) i, (SELECT unnest(range({k})) AS j) j
WHERE o.o // {own} = x.c // {4 // g} AND x.y * {s} + i.i - {p} BETWEEN 0 AND {n - 1} AND x.x * {s} + j.j - {p} BETWEEN 0 AND {n - 1} GROUP BY 1, 2, 3, 4)""",
        (out, n, n),
    )


for _name, (_out, _k, _s, _p, _g) in {"k2_s2": (3, 2, 2, 0, 1), "k3_s2_p1": (4, 3, 2, 1, 1), "k4_s2_p1_groups2": (4, 4, 2, 1, 2)}.items():
    _layer = L.Convolution(weights(4, _out // _g, _k), bias(_out), _s, 1, (_p,) * 4, _g if 4 % _g == 0 else 1)
    _tail, _size = deconv_sql(_out, _k, _s, _p, _g)
    layer(f"synet_deconvolution_32f_{_name}", lambda x, f=_layer: f.transposed(x), flat("y1", _size), _tail)
    _tail, _size = deconv_sql(_out, _k, _s, _p, _g, bf_sql("x.v"), bf_sql("{w}"))
    layer(f"synet_deconvolution_16b_{_name}", lambda x, f=_layer.rounded(): f.transposed(L.bfloat16(x)), flat("y1", _size), _tail)

# -- 8-bit and quantised convolutions ---------------------------------------------------------------

_SRC, _DST = (0.005, 128), (0.02, 100)


def q_sql(v: str, scale: float, zero: int) -> str:
    return f"least(greatest(round_even({v} / {scale}::DOUBLE, 0) + {zero}, 0), 255)"


def _codes(x: np.ndarray) -> np.ndarray:
    return L.quantized(x, *_SRC)


_int = lambda out, own, k: weights(out, own, k, 1.0)
_Q = f", q AS (SELECT t, c, y, x, {q_sql('v', *_SRC)} AS v FROM x)"
_scales = (_SRC[0], 0.01, _DST[0])


def _qconv(name: str, source: str, size, out, k, p, g, act, src_zero, dst) -> tuple[str, tuple]:
    cte, size_ = conv_sql(name + "s", source, size, out, k, 1, 1, p, g, unit="1", value=f"(x.v - {src_zero})")
    value = ACT_SQL[act].format(v=f"((v + c * 40) * ({_SRC[0]}::DOUBLE * 0.01::DOUBLE))")
    return cte + f", {name} AS (SELECT t, c, y, x, {q_sql('(' + value + ')', *dst)} AS v FROM {name}s)", size_


for _name, (_out, _k, _p, _g, _act) in {"k3_p1_relu": (5, 3, 1, 1, "relu"), "k1": (6, 1, 0, 1, "identity"), "depthwise_k3_p1": (4, 3, 1, 4, "leaky_relu")}.items():
    _layer = L.Convolution(_int(_out, 4 // _g, _k), np.arange(_out) * 40.0, pads=(_p,) * 4, groups=_g, activation=_act)
    _tail, _size = _qconv("y1", "q", SHAPE, _out, _k, _p, _g, _act, 128, _DST)
    layer(f"synet_quantized_convolution_{_name}", lambda x, f=_layer: L.quantized_convolution(f, _codes(x), _scales, (128, 100)), flat("y1", _size), _Q + _tail)
    # the older 8-bit layer: quantises its input itself and gives floats
    _tail, _size = conv_sql("ys", "q", SHAPE, _out, _k, 1, 1, _p, _g, unit="1", value="(x.v - 128)")
    _value = ACT_SQL[_act].format(v=f"(v * ({_SRC[0]}::DOUBLE * 0.02::DOUBLE) + c * 0.25::DOUBLE)")
    layer(
        f"synet_convolution_8i_{_name}",
        lambda x, f=L.Convolution(_int(_out, 4 // _g, _k), pads=(_p,) * 4, groups=_g), a=_act, n=_out: L.ACTIVATE[a](f.summed(_codes(x) - 128) * (_SRC[0] * 0.02) + bias(n)[:, None, None]),
        flat("y1", _size),
        _Q + _tail + f", y1 AS (SELECT t, c, y, x, {_value} AS v FROM ys)",
    )

_q1, _q2, _q3 = (L.Convolution(_int(8, 4, 1), np.arange(8) * 40.0, activation="relu"), L.Convolution(_int(8, 1, 3), np.arange(8) * 40.0, pads=(1, 1, 1, 1), groups=8, activation="relu"), L.Convolution(_int(4, 8, 1), np.arange(4) * 40.0))


def _quantized_chain(x: np.ndarray) -> np.ndarray:
    one = L.quantized_convolution(_q1, _codes(x), _scales, (128, 100))
    two = L.quantized_convolution(_q2, one, _scales, (100, 100))
    return L.quantized_convolution(_q3, two, _scales, (100, 100))


_one, _size = _qconv("y1", "q", SHAPE, 8, 1, 0, 1, "relu", 128, _DST)
_two, _size = _qconv("y2", "y1", _size, 8, 3, 1, 8, "relu", 100, _DST)
_three, _size = _qconv("y3", "y2", _size, 4, 1, 0, 1, "identity", 100, _DST)
layer("synet_quantized_merged_convolution", _quantized_chain, flat("y3", _size), _Q + _one + _two + _three)
layer("synet_merged_convolution_8i", lambda x: (_quantized_chain(x) - 100) * 0.02, f"SELECT t, i, (v - 100) * 0.02::DOUBLE AS v FROM ({flat('y3', _size)})", _Q + _one + _two + _three)

# -- inner products ----------------------------------------------------------------------------------

_B = np.array([[((i * 7 + o * 3) % 11 - 5) * 0.1 for i in range(64)] for o in range(6)])
_IP = "SELECT v.t, o.o AS i, sum({v} * {w}) + any_value(o.o) * 0.5::DOUBLE AS v FROM v, (SELECT unnest(range(6)) AS o) o GROUP BY 1, 2"
_W = "((((v.i * 7 + o.o * 3) % 11) - 5) * 0.1::DOUBLE)"
layer("synet_inner_product_layer", lambda x: x @ _B.T + np.arange(6) * 0.5, _IP.format(v="v.v", w=_W), "", (64,))
layer("synet_inner_product_16b", lambda x: L.bfloat16(x) @ L.bfloat16(_B).T + np.arange(6) * 0.5, _IP.format(v=bf_sql("v.v"), w=bf_sql(_W)), "", (64,))
layer(
    "synet_quantized_inner_product",
    lambda x: L.quantized(((_codes(x) - 128) @ np.rint(_B.T * 10) + np.arange(6) * 40) * (_SRC[0] * 0.01), *_DST),
    f"SELECT t, i, {q_sql(f'(v * ({_SRC[0]}::DOUBLE * 0.01::DOUBLE))', *_DST)} AS v FROM (SELECT v.t, o.o AS i, sum(({q_sql('v.v', *_SRC)} - 128) * (((v.i * 7 + o.o * 3) % 11) - 5)) + any_value(o.o) * 40 AS v FROM v, (SELECT unnest(range(6)) AS o) o GROUP BY 1, 2)",
    "",
    (64,),
)

# -- pooling with pads -------------------------------------------------------------------------------

for _name, (_how, _k, _s, _p, _ceil, _exclude) in {"max_k3_s1_p1": ("max", 3, 1, 1, False, True), "max_k2_s2": ("max", 2, 2, 0, False, True), "max_k3_s2_ceil": ("max", 3, 2, 0, True, True), "avg_k3_s1_p1": ("avg", 3, 1, 1, False, True), "avg_k3_s2_p1_with_pads": ("avg", 3, 2, 1, False, False)}.items():
    _n = (-(-(4 + 2 * _p - _k) // _s) if _ceil else (4 + 2 * _p - _k) // _s) + 1
    _agg = {("max", True): "max({v})", ("avg", True): "avg({v})", ("avg", False): f"sum({{v}}) / {_k * _k}"}[_how, _exclude]
    _pool = f"SELECT x.t, x.c * {_n * _n} + oy.o * {_n} + ox.o AS i, {_agg} AS v FROM x, (SELECT unnest(range({_n})) AS o) oy, (SELECT unnest(range({_n})) AS o) ox WHERE x.y BETWEEN oy.o * {_s} - {_p} AND oy.o * {_s} - {_p} + {_k - 1} AND x.x BETWEEN ox.o * {_s} - {_p} AND ox.o * {_s} - {_p} + {_k - 1} GROUP BY 1, 2"
    layer(f"synet_pooling_{_name}", lambda x, a=(_k, _s, (_p,) * 4, _how, _ceil, _exclude): L.pooled(x, *a), _pool.format(v="x.v"), "")
    if _how == "max":
        layer(f"synet_pooling_16b_{_name}", lambda x, a=(_k, _s, (_p,) * 4, _how, _ceil, _exclude): L.pooled(L.bfloat16(x), *a), _pool.format(v=bf_sql("x.v")), "")
        layer(f"synet_pooling_8u_{_name}", lambda x, a=(_k, _s, (_p,) * 4, _how, _ceil, _exclude): L.pooled(_codes(x), *a), _pool.format(v=q_sql("x.v", *_SRC)), "")

# -- sampling on a grid ------------------------------------------------------------------------------

_g = np.arange(10)
_GY, _GX = (_g * 7 % 10) / 4.0 - 1.2, (_g * 3 % 10) / 4.0 - 1.1
for _method in ("bilinear", "nearest"):
    for _pad in ("zeros", "border"):
        for _align in (False, True):
            _place = lambda v: f"(({v} + 1) / 2 * 3)" if _align else f"((({v} + 1) * 4 - 1) / 2)"
            _py, _px = _place("((g.g * 7 % 10) / 4.0::DOUBLE - 1.2::DOUBLE)"), _place("((g.g * 3 % 10) / 4.0::DOUBLE - 1.1::DOUBLE)")
            if _pad == "border":
                _py, _px = (f"least(greatest({p}, 0::DOUBLE), 3::DOUBLE)" for p in (_py, _px))
            _near = "greatest(1 - abs({p} - x.{k}), 0::DOUBLE)" if _method == "bilinear" else "CASE WHEN round_even({p}, 0) = x.{k} THEN 1 ELSE 0 END"
            layer(
                f"synet_grid_sample_2d_{_method}_{_pad}{'_aligned' * _align}",
                lambda x, a=(_method, _pad, _align): L.grid_sample(x, _GY, _GX, *a),
                f"SELECT x.t, x.c * 10 + g.g AS i, sum(x.v * {_near.format(p=_py, k='y')} * {_near.format(p=_px, k='x')}) AS v FROM x, (SELECT unnest(range(10)) AS g) g GROUP BY 1, 2",
                "",
            )

# -- permutations, shuffles, element-wise layers -----------------------------------------------------

for _name, (_shape, _order) in {"2d": ((8, 8), (1, 0)), "3d_021": ((2, 8, 4), (0, 2, 1)), "3d_102": ((2, 8, 4), (1, 0, 2)), "4d_0312": ((2, 4, 4, 2), (0, 3, 1, 2)), "5d_01324": ((2, 2, 4, 2, 2), (0, 1, 3, 2, 4)), "4d_3210": ((2, 4, 4, 2), (3, 2, 1, 0))}.items():
    _steps = [int(np.prod(_shape[k + 1 :])) for k in range(len(_shape))]
    _to = [_shape[k] for k in _order]
    _out = " + ".join(f"i // {_steps[k]} % {_shape[k]} * {int(np.prod(_to[n + 1 :]))}" for n, k in enumerate(_order))
    layer(f"synet_permute_{_name}", lambda x, order=_order: x.transpose(0, *[k + 1 for k in order]), f"SELECT t, {_out} AS i, v FROM v", "", _shape)


def _eltwise(name: str, f, agg: str) -> None:
    """Three inputs of 16 values each: the vector's first three quarters."""
    layer(f"synet_eltwise_{name}", lambda x: f(x[:, :3]), f"SELECT t, i % 16 AS i, {agg} AS v FROM v WHERE i < 48 GROUP BY 1, 2", "", (4, 16))


_eltwise("product", lambda x: x.prod(axis=1) * 1000, "product(v) * 1000")
_eltwise("sum", lambda x: x[:, 0] * 0.5 - x[:, 1] * 1.5 + x[:, 2] * 2, "sum(v * CASE i // 16 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN -1.5::DOUBLE ELSE 2::DOUBLE END)")
_eltwise("max", lambda x: x.max(axis=1), "max(v)")
_eltwise("min", lambda x: x.min(axis=1), "min(v)")
#: Two inputs of 4 channels of 8; type 0 parts even and odd channels, type 1 interleaves both inputs' halves.
layer("synet_shuffle_0", lambda x: x.reshape(-1, 4, 2, 8).transpose(0, 2, 1, 3), "SELECT t, (i // 8 % 2 * 4 + i // 16) * 8 + i % 8 AS i, v FROM v", "", (8, 8))
layer("synet_shuffle_1", lambda x: x.reshape(-1, 2, 4, 8).transpose(0, 2, 1, 3), "SELECT t, (i // 8 % 4 * 2 + i // 32) * 8 + i % 8 AS i, v FROM v", "", (8, 8))
layer("synet_quantized_shuffle", lambda x: L.quantized((_codes(x) - 128) * _SRC[0], *_DST).reshape(-1, 4, 2, 8).transpose(0, 2, 1, 3), f"SELECT t, (i // 8 % 2 * 4 + i // 16) * 8 + i % 8 AS i, {q_sql(f'(({q_sql("v", *_SRC)} - 128) * {_SRC[0]}::DOUBLE)', *_DST)} AS v FROM v", "", (8, 8))


def elementwise(name: str, f, sql: str) -> None:
    """A projection of (t, i, v)."""
    sql = f"WITH {V}, o AS (SELECT t, CAST(i AS BIGINT) AS i, round(CAST({sql} AS DOUBLE), 5) AS v FROM v) SELECT t, i, CASE WHEN v = 0 THEN 0::DOUBLE ELSE v END AS v FROM o"
    add(name, lambda s, d: T.exploded(table(s, d, "embeddings")).select("t", "i", F.round(f(c("v")).cast("double"), 5).alias("v")).withColumn("v", F.when(c("v") == 0, F.lit(0.0)).otherwise(c("v"))), sql)


_bf = lambda v: bfloat16(bfloat16_bits(v))
_ch = lambda: c("i") % 8


def sixteen(name: str, inputs, f, sql: str) -> None:
    """An element-wise layer on bfloat16 inputs whose result is rounded to bfloat16 again; each rounding is a projection of its own."""
    elementwise(name, None, sql)
    add(name, lambda s, d: _rounded_sum(T.exploded(table(s, d, "embeddings")), inputs, f), SQL[name])


def _rounded_sum(rows, inputs, f):
    held = rows.select("t", "i", *[_bf(v).alias(f"p{k}") for k, v in enumerate(inputs())])
    out = held.select("t", "i", f().alias("z")).select("t", "i", F.round(_bf(c("z")), 5).alias("v"))
    return out.withColumn("v", F.when(c("v") == 0, F.lit(0.0)).otherwise(c("v")))


sixteen("synet_add_16b", lambda: [c("v"), c("v") * 3], lambda: c("p0") + c("p1"), bf_sql(f"({bf_sql('v')} + {bf_sql('(v * 3)')})"))
sixteen("synet_scale_16b", lambda: [c("v")], lambda: c("p0") * (_ch() + 1) * 0.5 + _ch() * 0.25, bf_sql(f"({bf_sql('v')} * (i % 8 + 1) * 0.5::DOUBLE + (i % 8) * 0.25::DOUBLE)"))
elementwise("synet_relu_16b", lambda v: F.greatest(_bf(v), F.lit(0.0)) + F.lit(0.125) * F.least(_bf(v), F.lit(0.0)), f"greatest({bf_sql('v')}, 0::DOUBLE) + 0.125::DOUBLE * least({bf_sql('v')}, 0::DOUBLE)")
_code = lambda v: T.quantize(v, *_SRC)
_CODE = q_sql("v", *_SRC)
elementwise("synet_scale_8i", lambda v: F.least(F.greatest(F.rint(_code(v) * ((_ch() + 1) * F.lit(0.125)) + _ch() * 3), F.lit(0)), F.lit(255)), f"least(greatest(round_even({_CODE} * ((i % 8 + 1) * 0.125::DOUBLE) + (i % 8) * 3, 0), 0), 255)")
elementwise("synet_add_8i", lambda v: F.least(F.greatest(F.rint((_code(v) * 0.5 - 1 + (_code(-v) * 0.25 + 2)) * ((_ch() + 1) * F.lit(0.125)) + 7), F.lit(0)), F.lit(255)), f"least(greatest(round_even(({_CODE} * 0.5::DOUBLE - 1 + ({q_sql('(-v)', *_SRC)} * 0.25::DOUBLE + 2)) * ((i % 8 + 1) * 0.125::DOUBLE) + 7, 0), 0), 255)")
elementwise("synet_convert_8u_to_32f", lambda v: _code(v) * ((_ch() + 1) * F.lit(0.125)) + _ch() * 3, f"{_CODE} * ((i % 8 + 1) * 0.125::DOUBLE) + (i % 8) * 3")
_real = lambda v: (_code(v) - 128) * F.lit(_SRC[0])
_REAL = f"(({_CODE} - 128) * {_SRC[0]}::DOUBLE)"
elementwise("synet_quantized_prelu", lambda v: T.quantize(F.greatest(_real(v), F.lit(0.0)) + _ch() * F.lit(0.125) * F.least(_real(v), F.lit(0.0)), *_DST), q_sql(f"(greatest({_REAL}, 0::DOUBLE) + (i % 8) * 0.125::DOUBLE * least({_REAL}, 0::DOUBLE))", *_DST))
elementwise("synet_quantized_scale", lambda v: T.quantize(_real(v) * (_ch() + 1) + _ch() * F.lit(0.25), *_DST), q_sql(f"({_REAL} * (i % 8 + 1) + (i % 8) * 0.25::DOUBLE)", *_DST))
elementwise("neural_add_vector", lambda v: v + F.lit(0.5) * v * v, "v + 0.5::DOUBLE * v * v")
for _name, (_f, _sql) in {
    "log": (lambda v: F.log(F.abs(v) + 1), "ln(abs(v) + 1)"),
    "rsqrt": (lambda v: 1 / F.sqrt(F.abs(v) + 1), "1 / sqrt(abs(v) + 1)"),
    "tanh": (F.tanh, "tanh(v)"),
    "not": (lambda v: F.when(v == F.floor(v * 0 + 1), 0).otherwise(F.bitwise_not(F.floor(v * 1000).cast("long"))), "CASE WHEN v = 1 THEN 0 ELSE -CAST(floor(v * 1000) AS BIGINT) - 1 END"),
    "erf": (T.erf, T.ERF_SQL.format(x="v")),
}.items():
    elementwise(f"synet_unary_{_name}", _f, _sql)
elementwise("synet_gelu_32f", lambda v: v * (1 + T.erf(v / F.sqrt(F.lit(2.0)))) / 2, f"v * (1 + {T.ERF_SQL.format(x='(v / sqrt(2.0::DOUBLE))')}) / 2")
_BF = V + f", b AS (SELECT t, i, {bf_sql('v')} AS v FROM v)"
add(
    "synet_softmax_16b",
    lambda s, d: T.softmax(T.exploded(table(s, d, "embeddings")).withColumn("v", _bf(c("v"))), ["t"]).select("t", "i", F.round("v", 6).alias("v")),
    f"WITH {_BF}, e AS (SELECT t, i, exp(v - max(v) OVER (PARTITION BY t)) AS e FROM b) SELECT t, CAST(i AS BIGINT) AS i, round(e / sum(e) OVER (PARTITION BY t), 6) AS v FROM e",
)
add(
    "synet_normalize_16b_v2",
    lambda s, d: T.layer_norm(T.exploded(table(s, d, "embeddings")).withColumn("v", _bf(c("v"))), ["t"]).select("t", "i", F.round("v", 5).alias("v")),
    f"WITH {_BF}, m AS (SELECT *, v - avg(v) OVER (PARTITION BY t) AS d FROM b) SELECT t, CAST(i AS BIGINT) AS i, round(d / sqrt(avg(d * d) OVER (PARTITION BY t) + 1e-5::DOUBLE), 5) AS v FROM m",
)
add(
    "synet_channel_sum_16b",
    lambda s, d: T.exploded(table(s, d, "embeddings")).groupBy("t", F.floor(c("i") / 8).alias("ch")).agg(F.round(F.sum(_bf(c("v"))), 6).alias("s")),
    f"WITH {_BF} SELECT t, CAST(i // 8 AS BIGINT) AS ch, round(sum(v), 6) AS s FROM b GROUP BY 1, 2",
)
