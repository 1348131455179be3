"""Networks of convolution, pooling, dense and dropout layers, trained by mini-batches over partitions.

A step reads the rows of one mini-batch: tasks add up gradients, pieces of these
are summed by key, the driver holds and moves the weights.  Mini-batches are
folders of one table that is written once, dealt by a hash of the row.  Sums are
taken in the order of the tasks and dropout is a hash of row, step and unit, so
a step that is run again, or resumed from saved weights, gives the same numbers.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.run import shared_folder

#: Numbers of one piece of a gradient, and parameters that a network may have (each task holds them).
PIECE, MOST_PARAMETERS = 1 << 16, 50_000_000


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


#: name -> (value, derivative from the value).
FUNCTIONS: dict[str, tuple[Callable, Callable]] = {
    "identity": (lambda z: z, np.ones_like),
    "tanh": (np.tanh, lambda y: 1 - y * y),
    "sigmoid": (lambda z: 1 / (1 + np.exp(-z)), lambda y: y * (1 - y)),
    "relu": (lambda z: np.maximum(z, 0), lambda y: (y > 0).astype(float)),
    "leaky_relu": (lambda z: np.where(z > 0, z, 0.01 * z), lambda y: np.where(y > 0, 1.0, 0.01)),
    "softmax": (_softmax, np.ones_like),
}


def uniform(key: np.ndarray, units: int, step: int) -> np.ndarray:
    """Numbers in [0, 1) for each key and unit, a hash of both and of the step."""
    h = key.astype(np.int64).view(np.uint64)[:, None] ^ (np.arange(units, dtype=np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(step * 0x632BE59BD9B4E019 % 2**64)
    for _ in range(3):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(11)).astype(np.float64) / 2.0**53


@dataclass
class Layer:
    """A function of (rows, depth, height, width); `shape` is what goes in, weights are set by the network."""

    function: str = "identity"
    shape: tuple[int, int, int] = (0, 0, 0)
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def out(self) -> tuple[int, int, int]:
        return self.shape

    def sizes(self) -> tuple[tuple[int, ...], int]:
        """Shape of the weights and number of biases."""
        return (0,), 0

    def fans(self) -> int:
        return 2

    def linear(self, x: np.ndarray, draw) -> tuple[np.ndarray, object]:
        """The value before the function, and what the way back needs."""
        raise NotImplementedError

    def back(self, delta: np.ndarray, x: np.ndarray, kept) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gradients of the input, the weights and the biases."""
        raise NotImplementedError


@dataclass
class Dense(Layer):
    units: int = 1
    biased: bool = True

    def out(self):
        return self.units, 1, 1

    def sizes(self):
        return (math.prod(self.shape), self.units), self.units * self.biased

    def fans(self):
        return math.prod(self.shape) + self.units

    def linear(self, x, draw):
        z = x.reshape(len(x), -1) @ self.weight
        return (z + self.bias if self.biased else z).reshape(len(x), self.units, 1, 1), None

    def back(self, delta, x, kept):
        d = delta.reshape(len(x), -1)
        return (d @ self.weight.T).reshape(x.shape), x.reshape(len(x), -1).T @ d, d.sum(0) if self.biased else self.bias


@dataclass
class Convolution(Layer):
    """`depth` filters of core x core; valid leaves the border out, otherwise it is padded with zeros."""

    depth: int = 1
    core: int = 3
    valid: bool = True
    biased: bool = True

    def out(self):
        cut = self.core - 1 if self.valid else 0
        return self.depth, self.shape[1] - cut, self.shape[2] - cut

    def sizes(self):
        return (self.depth, self.shape[0], self.core, self.core), self.depth * self.biased

    def fans(self):
        return (self.shape[0] + self.depth) * self.core * self.core

    def _padded(self, x):
        if self.valid:
            return x
        low = self.core // 2
        return np.pad(x, [(0, 0), (0, 0), (low, self.core - 1 - low), (low, self.core - 1 - low)])

    def linear(self, x, draw):
        p = self._padded(x)
        patches = np.lib.stride_tricks.sliding_window_view(p, (self.core, self.core), (2, 3))
        z = np.einsum("nchwij,ocij->nohw", patches, self.weight, optimize=True)
        return z + self.bias[None, :, None, None] if self.biased else z, None

    def back(self, delta, x, kept):
        p, (h, w) = self._padded(x), delta.shape[2:]
        grad, dp = np.zeros_like(self.weight), np.zeros_like(p)
        for i in range(self.core):
            for j in range(self.core):
                part = p[:, :, i : i + h, j : j + w]
                grad[:, :, i, j] = np.einsum("nohw,nchw->oc", delta, part, optimize=True)
                dp[:, :, i : i + h, j : j + w] += np.einsum("nohw,oc->nchw", delta, self.weight[:, :, i, j], optimize=True)
        if not self.valid:
            low = self.core // 2
            dp = dp[:, :, low : low + x.shape[2], low : low + x.shape[3]]
        return dp, grad, delta.sum((0, 2, 3)) if self.biased else self.bias


@dataclass
class Pooling(Layer):
    """Largest or mean value of size x size cells, `stride` apart; cells at the right and lower edge may be cut."""

    size: int = 2
    stride: int = 2
    mean: bool = False

    def out(self):
        return self.shape[0], *(-(-(n - self.size) // self.stride) + 1 if n > self.size else 1 for n in self.shape[1:])

    def _cells(self, x, fill):
        _, h, w = self.out()
        p = np.pad(x, [(0, 0), (0, 0), *((0, max(0, (n - 1) * self.stride + self.size - m)) for n, m in zip((h, w), x.shape[2:]))], constant_values=fill)
        return p, np.stack([p[:, :, i : i + (h - 1) * self.stride + 1 : self.stride, j : j + (w - 1) * self.stride + 1 : self.stride] for i in range(self.size) for j in range(self.size)])

    def linear(self, x, draw):
        if self.mean:
            return self._cells(x, 0.0)[1].sum(0) / (self.size * self.size), None
        cells = self._cells(x, -np.inf)[1]
        return cells.max(0), cells.argmax(0)

    def back(self, delta, x, kept):
        p = np.zeros_like(self._cells(x, 0.0)[0])
        h, w = delta.shape[2:]
        for k in range(self.size * self.size):
            i, j = divmod(k, self.size)
            share = delta / (self.size * self.size) if self.mean else delta * (kept == k)
            p[:, :, i : i + (h - 1) * self.stride + 1 : self.stride, j : j + (w - 1) * self.stride + 1 : self.stride] += share
        return p[:, :, : x.shape[2], : x.shape[3]], self.weight, self.bias


@dataclass
class Dropout(Layer):
    """Keeps a unit with probability `rate` while training and scales it by 1 / rate; does nothing else."""

    rate: float = 0.5

    def linear(self, x, draw):
        if draw is None:
            return x, None
        keep = (draw(math.prod(self.shape)) < self.rate).reshape(x.shape) / self.rate
        return x * keep, keep

    def back(self, delta, x, kept):
        return delta if kept is None else delta * kept, self.weight, self.bias


LOSSES = ("mse", "cross_entropy", "cross_entropy_multiclass")


@dataclass
class Trainer:
    """Layers, a loss, and steps by adaptive gradients: squares of mean gradients add up, a weight moves by rate * g / sqrt(squares + epsilon)."""

    shape: tuple[int, int, int]
    layers: list[Layer]
    loss: str = "mse"
    rate: float = 0.01
    epsilon: float = 1e-4
    seed: int = 1
    step: int = 0

    def __post_init__(self):
        if self.loss not in LOSSES:
            raise ValueError(f"loss {self.loss!r} is none of {LOSSES}")
        rng, shape = np.random.default_rng(self.seed), self.shape
        for layer in self.layers:
            layer.shape = shape
            size, biases = layer.sizes()
            half = math.sqrt(6 / layer.fans())
            layer.weight, layer.bias = rng.uniform(-half, half, size), rng.uniform(-half, half, biases)
            shape = layer.out()
            if min(shape) < 1:
                raise ValueError(f"{layer} is too large for {layer.shape}")
        self.squares = np.zeros(self.size)
        if self.size > MOST_PARAMETERS:
            raise ValueError(f"{self.size} parameters, more than {MOST_PARAMETERS}")

    @property
    def size(self) -> int:
        return sum(x.weight.size + x.bias.size for x in self.layers)

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for x in self.layers for p in (x.weight, x.bias)])

    def put(self, values: np.ndarray) -> None:
        at = 0
        for x in self.layers:
            for name in ("weight", "bias"):
                part = getattr(x, name)
                setattr(x, name, values[at : at + part.size].reshape(part.shape).copy())
                at += part.size

    def forward(self, x: np.ndarray, keys: np.ndarray | None = None):
        """Inputs of all layers with what they kept, and the output as (rows, units); keys of the rows draw dropout."""
        x, steps = x.reshape(len(x), *self.shape), []
        for k, layer in enumerate(self.layers):
            draw = None if keys is None else lambda n, k=k: uniform(keys, n, self.step * 64 + k)
            z, kept = layer.linear(x, draw)
            y = _softmax(z.reshape(len(z), -1)).reshape(z.shape) if layer.function == "softmax" else FUNCTIONS[layer.function][0](z)
            steps.append((x, kept, y))
            x = y
        return steps, x.reshape(len(x), -1)

    def losses(self, y: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """One number a row."""
        if self.loss == "mse":
            return ((y - wanted) ** 2).sum(1) / 2
        small = 1e-300
        if self.loss == "cross_entropy":
            return -(wanted * np.log(np.maximum(y, small)) + (1 - wanted) * np.log(np.maximum(1 - y, small))).sum(1)
        return -(wanted * np.log(np.maximum(y, small))).sum(1)

    def gradients(self, x: np.ndarray, wanted: np.ndarray, keys: np.ndarray | None) -> np.ndarray:
        """Summed gradients of all parameters, then the loss and the number of rows."""
        steps, y = self.forward(x, keys)
        last = self.layers[-1].function
        if (self.loss, last) in (("mse", "identity"), ("cross_entropy", "sigmoid"), ("cross_entropy_multiclass", "softmax")):
            delta = y - wanted
        else:
            delta = {"mse": lambda: y - wanted, "cross_entropy": lambda: (y - wanted) / (y * (1 - y)), "cross_entropy_multiclass": lambda: -wanted / y}[self.loss]()
            delta = y * (delta - (delta * y).sum(1, keepdims=True)) if last == "softmax" else delta * FUNCTIONS[last][1](y)
        delta, parts = delta.reshape(steps[-1][2].shape), []
        for k in range(len(self.layers) - 1, -1, -1):
            x, kept, _ = steps[k]
            delta, weight, bias = self.layers[k].back(delta, x, kept)
            if not self.layers[k].weight.size:
                weight = self.layers[k].weight
            parts = [weight.ravel(), bias.ravel(), *parts]
            if k:
                delta = delta * FUNCTIONS[self.layers[k - 1].function][1](steps[k - 1][2])
        return np.concatenate([*parts, [self.losses(y, wanted).sum(), len(y)]])

    def move(self, total: np.ndarray) -> float:
        """One step from summed gradients; the mean loss before it."""
        n = max(total[-1], 1.0)
        g = total[:-2] / n
        self.squares += g * g
        self.put(self.flat() - self.rate * g / np.sqrt(self.squares + self.epsilon))
        self.step += 1
        return float(total[-2] / n)

    # -- over tables -----------------------------------------------------------------------------------

    def summed(self, rows: DataFrame) -> np.ndarray:
        """Gradients of all rows (key long, x array<double>, wanted array<double>): each task adds its own, pieces meet by number."""
        size = self.size + 2
        pieces, net = -(-size // PIECE), self
        binary = pa.list_(pa.float64())

        def run(batches) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            total, seen = np.zeros(size), False
            for batch in batches:
                if batch.num_rows:
                    x, wanted = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in ("x", "wanted"))
                    total += net.gradients(x, wanted, batch.column("key").to_numpy())
                    seen = True
            if seen:
                part = TaskContext.get().partitionId()
                yield pa.record_batch([pa.array([part] * pieces), pa.array(range(pieces)), pa.array([total[k * PIECE : (k + 1) * PIECE] for k in range(pieces)], binary)], ["part", "piece", "data"])

        def add(group: pa.Table) -> pa.Table:
            order = np.argsort(group.column("part").to_numpy())
            data = group.column("data").combine_chunks()
            total = np.zeros(len(data[0]))
            for k in order.tolist():
                total += data[k].values.to_numpy()
            return pa.table([group.column("piece").slice(0, 1), pa.array([total], binary)], ["piece", "data"])

        found = rows.select("key", "x", "wanted").mapInArrow(run, "part long, piece long, data array<double>").groupBy("piece").applyInArrow(add, "piece long, data array<double>").collect()  # one gradient
        return np.concatenate([np.array(r["data"]) for r in sorted(found)]) if found else np.zeros(size)

    def train(self, rows: DataFrame, features: str, wanted: str, batches: int, steps: int, save: str | None = None) -> list[float]:
        """`steps` steps from the present one, each over one of `batches` mini-batches in turn; the mean loss before each.

        wanted is an array of the output's size.  Rows without features or wanted
        values go; an empty mini-batch is a step that moves nothing.  With `save`,
        weights are written there after every step.
        """
        spark = rows.sparkSession
        x, w = F.col(features).cast("array<double>"), F.col(wanted).cast("array<double>")
        key = F.xxhash64(x, w)
        held = rows.where(F.col(features).isNotNull() & F.col(wanted).isNotNull()).select(key.alias("key"), x.alias("x"), w.alias("wanted"), F.pmod(F.shiftright(key, 7), F.lit(batches)).cast("int").alias("batch"))
        path = f"{shared_folder(spark)}/mini-batches-{uuid.uuid4().hex}"
        held.repartition("batch", F.pmod("key", F.lit(8))).sortWithinPartitions("batch", "key").write.partitionBy("batch").parquet(path)
        held, losses = spark.read.schema(held.schema).parquet(path), []
        for _ in range(steps):
            losses.append(self.move(self.summed(held.where(F.col("batch") == self.step % batches))))
            if save:
                self.save(spark, save)
        return losses

    def save(self, spark: SparkSession, path: str) -> None:
        """Weights and squares of the present step as rows (step, at, weight, square)."""
        flat = self.flat()
        rows = [(self.step, k, flat[k : k + PIECE].tolist(), self.squares[k : k + PIECE].tolist()) for k in range(0, max(len(flat), 1), PIECE)]
        spark.createDataFrame(rows, "step long, at long, weight array<double>, square array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/step={self.step}")

    def load(self, spark: SparkSession, path: str, step: int | None = None) -> Trainer:
        """Weights of a step that was saved, the last one by default."""
        saved = spark.read.parquet(path)
        step = saved.agg(F.max("step")).first()[0] if step is None else step
        rows = sorted(saved.where(F.col("step") == step).select("at", "weight", "square").collect())
        flat, squares = (np.concatenate([np.array(r[k]) for r in rows]) if rows else np.zeros(0) for k in ("weight", "square"))
        if len(flat) != self.size:
            raise ValueError(f"step {step} has {len(flat)} parameters, the network {self.size}")
        self.put(flat)
        self.squares, self.step = squares, int(step)
        return self

    def predict(self, rows: DataFrame, id_col: str, features: str) -> DataFrame:
        """(t, data): the output for every row, without dropout and without a shuffle; null features give null."""
        net = self

        def run(batches) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                some = np.flatnonzero(batch.column("x").is_valid().to_numpy(zero_copy_only=False))
                out = [None] * batch.num_rows
                if len(some):
                    x = batch.column("x").take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).reshape(len(some), -1)
                    for k, y in zip(some.tolist(), net.forward(x)[1]):
                        out[k] = y
                yield pa.record_batch([batch.column("t"), pa.array(out, pa.list_(pa.float64()))], ["t", "data"])

        held = rows.select(F.col(id_col).alias("t"), F.col(features).cast("array<double>").alias("x"))
        return held.mapInArrow(run, f"t {held.schema['t'].dataType.simpleString()}, data array<double>")
