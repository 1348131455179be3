"""Fully connected networks trained by sums over partitions: tasks add up gradients, the driver holds the weights.

A step is one job over the rows: each task gives one row of gradients of the
model's size, these are added chunk by chunk, and the driver gets the sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNKS = 32


@dataclass
class Network:
    """Layers of tanh units and a softmax, adaptive-gradient steps on the mean cross entropy."""

    sizes: tuple[int, ...]
    rate: float = 0.5
    seed: int = 1
    weights: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self):
        if not self.weights:
            rng = np.random.default_rng(self.seed)
            self.weights = [rng.uniform(-1, 1, (n + 1, m)) * np.sqrt(3 / n) for n, m in zip(self.sizes, self.sizes[1:])]
        self.squares = [np.zeros_like(w) for w in self.weights]

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        """The input and every layer's output; a layer's last row of weights is its bias."""
        out = [x]
        for k, w in enumerate(self.weights):
            z = out[-1] @ w[:-1] + w[-1]
            if k + 1 < len(self.weights):
                out.append(np.tanh(z))
            else:
                e = np.exp(z - z.max(axis=1, keepdims=True))
                out.append(e / e.sum(axis=1, keepdims=True))
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Summed gradients of all weights in a row, then the loss and the number of rows."""
        out = self.forward(x)
        delta = out[-1].copy()
        delta[np.arange(len(y)), y] -= 1
        parts = []
        for k in range(len(self.weights) - 1, -1, -1):
            parts.insert(0, np.vstack([out[k].T @ delta, delta.sum(axis=0)]).ravel())
            if k:
                delta = (delta @ self.weights[k][:-1].T) * (1 - out[k] ** 2)
        loss = -np.log(np.maximum(out[-1][np.arange(len(y)), y], 1e-300)).sum()
        return np.concatenate([*parts, [loss, len(y)]])

    def step(self, total: np.ndarray) -> float:
        """One adaptive step from summed gradients; the mean loss before it."""
        n, at = max(total[-1], 1), 0
        for w, squares in zip(self.weights, self.squares):
            g = total[at : at + w.size].reshape(w.shape) / n
            squares += g * g
            w -= self.rate * g / np.sqrt(squares + 1e-8)
            at += w.size
        return float(total[-2] / n)

    def train(self, rows: DataFrame, features: str, label: str, steps: int) -> list[float]:
        """`steps` steps over all rows of (features array, label int); the mean loss before each."""
        held = rows.select(F.col(features).cast("array<double>"), F.col(label).cast("int"))
        size = sum(w.size for w in self.weights) + 2
        cuts = [size * k // CHUNKS for k in range(CHUNKS + 1)]
        losses = []
        for _ in range(steps):
            network = self

            def run(batches) -> Iterator[pa.RecordBatch]:
                total = np.zeros(size)
                for batch in batches:
                    if batch.num_rows:
                        x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                        total += network.gradients(x, batch.column(1).to_numpy(zero_copy_only=False))
                yield pa.record_batch([pa.array(np.arange(CHUNKS, dtype=np.int32)), pa.array([total[a:b].tolist() for a, b in zip(cuts, cuts[1:])], pa.list_(pa.float64()))], ["chunk", "data"])

            def add(group: pa.Table) -> pa.Table:
                data = np.array(group.column("data").to_pylist())
                return pa.table({"chunk": group.column("chunk").slice(0, 1), "data": pa.array([data.sum(axis=0).tolist()], pa.list_(pa.float64()))})

            sums = held.mapInArrow(run, "chunk int, data array<double>").groupBy("chunk").applyInArrow(add, "chunk int, data array<double>").collect()  # CHUNKS rows
            total = np.concatenate([np.array(r["data"]) for r in sorted(sums, key=lambda r: r["chunk"])])
            losses.append(self.step(total))
        return losses

    def predict(self, rows: DataFrame, id_col: str, features: str) -> DataFrame:
        """(t, data): the class probabilities of every row."""
        from .layers import on_tensors

        return on_tensors(rows, (self.sizes[0],), lambda x: self.forward(x)[-1], id_col, features)
