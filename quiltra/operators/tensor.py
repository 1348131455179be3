"""Vectors and tensors: activations, norms, pooling, products, quantisation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exploded(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, i, v) of an array column."""
    return vectors.select(F.col(id_col).alias("t"), F.posexplode(F.col(column))).select("t", F.col("pos").cast("long").alias("i"), F.col("col").cast("double").alias("v"))


#: name -> activation of x with usual parameters.
ACTIVATIONS = {
    "elu": lambda x, a=1.0: F.when(x >= 0, x).otherwise(a * (F.exp(x) - 1)),
    "hard_sigmoid": lambda x, k=0.2, s=0.5: F.greatest(F.lit(0.0), F.least(x * k + s, F.lit(1.0))),
    "hswish": lambda x, s=3.0, k=1.0 / 6.0: F.greatest(F.least(x, F.lit(s)) + s, F.lit(0.0)) * k * x,
    "mish": lambda x, t=20.0: F.when(x > t, x).otherwise(x * (1 - 2 / ((F.exp(x) + 1) * (F.exp(x) + 1) + 1))),
    "relu": lambda x, s=0.1: F.greatest(F.lit(0.0), x) + s * F.least(F.lit(0.0), x),
    "restrict_range": lambda x, a=-0.1, b=0.1: F.least(F.greatest(x, F.lit(a)), F.lit(b)),
    "sigmoid": lambda x, s=1.0: 1 / (1 + F.exp(-x * s)),
    "softplus": lambda x, b=1.0, t=20.0: F.when(x > t, x).otherwise(F.log(1 + F.exp(x * b)) / b),
    "swish": lambda x, s=1.0: x / (1 + F.exp(-x * s)),
    "tanh": lambda x, s=1.0: F.tanh(x * s),
}
UNARY = {
    "abs": F.abs,
    "ceil": F.ceil,
    "cos": F.cos,
    "exp": F.exp,
    "floor": F.floor,
    "neg": lambda x: -x,
    "rcp": lambda x: 1 / x,
    "round": lambda x: F.round(x, 0),
    "sign": F.signum,
    "sin": F.sin,
    "sqrt": lambda x: F.sqrt(F.abs(x)),
    "zero": lambda x: F.lit(0.0),
}


#: The rational approximation of erf in Abramowitz and Stegun, 7.1.26; its error is under 1.5e-7.
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_STEP = 0.3275911


def erf(x: Column) -> Column:
    """erf as an expression; Spark has none."""
    t = 1 / (1 + F.lit(ERF_STEP) * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(ERF):
        poly = (poly + F.lit(a)) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


_T = f"(1 / (1 + {ERF_STEP}::DOUBLE * abs({{x}})))"
_POLY = "0::DOUBLE"
for _a in reversed(ERF):
    _POLY = f"(({_POLY} + {_a}::DOUBLE) * {_T})"
ERF_SQL = f"(sign({{x}}) * (1 - {_POLY} * exp(-({{x}}) * ({{x}}))))"


def gelu(x: Column) -> Column:
    return x * (1 + erf(x / F.sqrt(F.lit(2.0)))) / 2


def softmax(rows: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    w = Window.partitionBy(*keys)
    out = rows.withColumn("_e", F.exp(F.col(value) - F.max(value).over(w)))
    return out.withColumn(value, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def l2_normalize(rows: DataFrame, keys: list[str], eps: float = 1e-10) -> DataFrame:
    w = Window.partitionBy(*keys)
    return rows.withColumn("v", F.col("v") / F.sqrt(F.sum(F.col("v") * F.col("v")).over(w) + eps))


def layer_norm(rows: DataFrame, keys: list[str], eps: float = 1e-5) -> DataFrame:
    w = Window.partitionBy(*keys)
    mean = F.avg("v").over(w)
    out = rows.withColumn("_d", F.col("v") - mean)
    return out.withColumn("v", F.col("_d") / F.sqrt(F.avg(F.col("_d") * F.col("_d")).over(w) + eps)).drop("_d")


def pool(df: DataFrame, value: str, kernel: int, stride: int, how: str, width: int, height: int) -> DataFrame:
    """Valid pooling: every pixel goes to the windows it lies in; windows meet by (img, oy, ox) with partial aggregates."""
    ow, oh = (width - kernel) // stride + 1, (height - kernel) // stride + 1
    outs = lambda c, n: F.sequence(F.greatest(F.ceil((F.col(c) - kernel + 1) / F.lit(stride)), F.lit(0)), F.least(F.floor(F.col(c) / F.lit(stride)), F.lit(n - 1)))
    rows = df.select("img", "y", "x", F.col(value).alias("v"))
    rows = rows.where((F.col("y") <= (oh - 1) * stride + kernel - 1) & (F.col("x") <= (ow - 1) * stride + kernel - 1))
    rows = rows.where(F.size(outs("y", oh)) > 0) if stride > kernel else rows
    rows = rows.select("img", "x", "v", F.explode(outs("y", oh)).alias("oy")).select("img", "v", "oy", F.explode(outs("x", ow)).alias("ox"))
    agg = F.max("v") if how == "max" else F.avg("v")
    return rows.groupBy("img", F.col("oy").alias("y"), F.col("ox").alias("x")).agg(agg.alias("v"))


def quantize(v: Column, scale: float, zero: int) -> Column:
    return F.least(F.greatest(F.rint(v / scale).cast("long") + zero, F.lit(0)), F.lit(255))


def dequantize(q: Column, scale: float, zero: int) -> Column:
    return (q - zero) * F.lit(scale)


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """C(i, j) = sum over k of A(i, k) B(k, j), as a join on k with partial sums."""
    return a.join(b, "k").groupBy("i", "j").agg(F.sum(F.col("av") * F.col("bv")).alias("v"))


def gram(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """i, j, v of C = A'A over the rows of an array column; each task adds up its own products before the shuffle.

    Rows may differ in length; an element that is missing or null adds nothing.
    """

    def run(batches):
        total, met = np.zeros((0, 0)), np.zeros((0, 0), bool)
        for batch in batches:
            lists = batch.column(0)
            size = np.diff(lists.offsets.to_numpy()) * np.asarray(lists.is_valid())
            width = int(size.max(initial=0))
            if width > len(total):
                grow = ((0, width - len(total)),) * 2
                total, met = np.pad(total, grow), np.pad(met, grow)
            for begin in range(0, len(size), 4096):
                own = size[begin : begin + 4096]
                a, there = np.zeros((len(own), len(total))), np.arange(len(total)) < own[:, None]
                values = lists.slice(begin, 4096).flatten()
                a[there] = values.fill_null(0.0).to_numpy(zero_copy_only=False)
                there[there] = np.asarray(values.is_valid())
                total += a.T @ a
                met |= (there.T.astype(np.float32) @ there) > 0
        i, j = np.nonzero(met)
        yield pa.record_batch([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "v"])

    return vectors.select(F.col(column).cast("array<double>")).mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def tap_sums(df: DataFrame, source: str, gradient: str, k: int, width: int, height: int) -> DataFrame:
    """(i, j, v): for each tap of a k x k kernel, the sum of source(y + i, x + j) * gradient(y, x) over the valid outputs.

    The image's rows are together after one shuffle; windows shift them, and every task adds up all taps at once.
    """
    row, column = Window.partitionBy("img", "y").orderBy("x"), Window.partitionBy("img", "x").orderBy("y")
    out = df.select("img", "y", "x", source, gradient).repartition("img")
    out = out.select("*", *[F.lead(source, j).over(row).alias(f"_h{j}") for j in range(k)])
    out = out.select("y", "x", gradient, *[F.lead(f"_h{j}", i).over(column).alias(f"_t{i}{j}") for i in range(k) for j in range(k)])
    sums = out.where((F.col("y") <= height - k) & (F.col("x") <= width - k)).agg(*[F.sum(F.col(f"_t{i}{j}") * F.col(gradient)).alias(f"_t{i}{j}") for i in range(k) for j in range(k)])
    taps = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j"), F.col(f"_t{i}{j}").cast("long").alias("v")) for i in range(k) for j in range(k)]))
    return sums.select(taps.alias("t")).select("t.*")


#: Vectors of a block, and places that the rows' blocks are dealt to for each block of queries.
BLOCK, DEALS = 2048, 32


def blocks_of(vectors: DataFrame, id_col: str, column: str, block: int) -> DataFrame:
    """ids binary, data binary: `block` vectors of a task in a row, scaled to unit length."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                v = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                v = v / np.sqrt((v * v).sum(1))[:, None]
                yield pa.record_batch([pa.array([part.column(0).to_numpy(zero_copy_only=False).tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], ["ids", "data"])

    return vectors.select(F.col(id_col).cast("long"), F.col(column).cast("array<double>")).mapInArrow(run, "ids binary, data binary")


def query_distances(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", column: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(q, r, d): cosine distances of a stated query set to every row.

    Blocks of queries meet blocks of rows by an equi-join on a deal: a block of
    queries goes to every deal, a block of rows to its own.  Nothing passes the
    driver, and one pass over the rows serves any number of queries.
    """
    deal = F.pmod(F.xxhash64("ids"), F.lit(DEALS)).cast("int")
    rows = blocks_of(vectors, id_col, column, block).select("ids", "data", deal.alias("deal"))
    asked = blocks_of(queries, id_col, column, block).select(F.col("ids").alias("asked"), F.col("data").alias("m"), F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))).alias("deal"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, data, own, m = (batch.column(i)[k].as_py() for i in range(4))
                ids, own = np.frombuffer(ids, np.int64), np.frombuffer(own, np.int64)
                d = 1 - np.frombuffer(m, np.float64).reshape(len(own), -1) @ np.frombuffer(data, np.float64).reshape(len(ids), -1).T
                for i in range(0, len(own), 64):
                    some = own[i : i + 64]
                    yield pa.record_batch([pa.array(np.repeat(some, len(ids))), pa.array(np.tile(ids, len(some))), pa.array(d[i : i + 64].ravel())], ["q", "r", "d"])

    return rows.join(asked, "deal").select("ids", "data", "asked", "m").mapInArrow(run, "q long, r long, d double")
