"""Layers on packed tensors: an array column per row, NumPy over a batch of rows inside a task, no shuffle.

Weights travel with the function, so they have to be a model's size and not
the data's; rows are independent of each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of parameters that a layer may carry into tasks.
MOST_PARAMETERS = 256 << 20
ROWS = 1024


def on_tensors(rows: DataFrame, shape: tuple[int, ...], f: Callable[[np.ndarray], np.ndarray], id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(t, data): f over the tensors of `shape` in an array column, a batch of rows at a time; f keeps the first axis."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, *shape)
                out = np.ascontiguousarray(f(x), np.float64).reshape(part.num_rows, -1)
                offsets = np.arange(part.num_rows + 1, dtype=np.int32) * out.shape[1]
                yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()))], ["t", "data"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col), F.col(column).cast("array<double>")).mapInArrow(run, f"t {kind}, data array<double>")


def exploded(tensors: DataFrame, digits: int = 4) -> DataFrame:
    """(t, i, v) of (t, data), values rounded and without negative zeros."""
    out = tensors.select("t", F.posexplode("data")).select("t", F.col("pos").cast("long").alias("i"), F.round("col", digits).alias("v"))
    return out.withColumn("v", F.when(F.col("v") == 0, F.lit(0.0)).otherwise(F.col("v")))


def bfloat16(x: np.ndarray) -> np.ndarray:
    """Nearest bfloat16 values, ties to even."""
    u = np.asarray(x, np.float32).view(np.uint32)
    return ((u + np.uint32(0x7FFF) + ((u >> np.uint32(16)) & np.uint32(1))) & np.uint32(0xFFFF0000)).view(np.float32).astype(np.float64)


def quantized(x: np.ndarray, scale: float, zero: int, low: int = 0, high: int = 255) -> np.ndarray:
    return np.clip(np.rint(x / scale) + zero, low, high)


ACTIVATE: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "identity": lambda x: x,
    "relu": lambda x: np.maximum(x, 0),
    "leaky_relu": lambda x: np.maximum(x, 0) + 0.1 * np.minimum(x, 0),
    "restrict_range": lambda x: np.clip(x, 0, 6),
    "elu": lambda x: np.where(x >= 0, x, np.expm1(np.minimum(x, 0))),
    "hswish": lambda x: np.clip(x + 3, 0, 6) / 6 * x,
    "hard_sigmoid": lambda x: np.clip(x * 0.2 + 0.5, 0, 1),
    "swish": lambda x: x / (1 + np.exp(-x)),
    "mish": lambda x: x * np.tanh(np.logaddexp(0, x)),
}


@dataclass(frozen=True)
class Convolution:
    """Weights (out channels, in channels of a group, height, width), with stride, dilation, pads (top, left, bottom, right), groups and activation."""

    weights: np.ndarray
    bias: np.ndarray | None = None
    stride: int = 1
    dilation: int = 1
    pads: tuple[int, int, int, int] = (0, 0, 0, 0)
    groups: int = 1
    activation: str = "identity"

    def __post_init__(self):
        if self.weights.nbytes > MOST_PARAMETERS:
            raise ValueError("these weights are too large to be sent to every task")
        if self.weights.shape[0] % self.groups:
            raise ValueError("groups must divide the output channels")

    def summed(self, x: np.ndarray, outside: float = 0.0) -> np.ndarray:
        """Products summed over the taps, for a batch (n, c, h, w); `outside` stands in the pads."""
        top, left, bottom, right = self.pads
        x = np.pad(x, ((0, 0), (0, 0), (top, bottom), (left, right)), constant_values=outside)
        n, channels, h, w = x.shape
        out, own, kh, kw = self.weights.shape
        s, d, g = self.stride, self.dilation, self.groups
        oh, ow = (h - (kh - 1) * d - 1) // s + 1, (w - (kw - 1) * d - 1) // s + 1
        x, weights = x.reshape(n, g, own, h, w), self.weights.reshape(g, out // g, own, kh, kw)
        total = np.zeros((n, g, out // g, oh, ow))
        for i in range(kh):
            for j in range(kw):
                patch = x[:, :, :, i * d : i * d + (oh - 1) * s + 1 : s, j * d : j * d + (ow - 1) * s + 1 : s]
                total += np.einsum("ngchw,goc->ngohw", patch, weights[..., i, j], optimize=True)
        return total.reshape(n, out, oh, ow)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = self.summed(x)
        if self.bias is not None:
            out = out + self.bias[:, None, None]
        return ACTIVATE[self.activation](out)

    def rounded(self) -> Convolution:
        """The same layer with bfloat16 weights."""
        return Convolution(bfloat16(self.weights), self.bias, self.stride, self.dilation, self.pads, self.groups, self.activation)

    def transposed(self, x: np.ndarray) -> np.ndarray:
        """Deconvolution: a source sends its value to the outputs it touches; weights are (in, out of a group, height, width)."""
        top, left, bottom, right = self.pads
        n, channels, h, w = x.shape
        _, own, kh, kw = self.weights.shape
        s, d, g = self.stride, self.dilation, self.groups
        full = np.zeros((n, g, own, (h - 1) * s + (kh - 1) * d + 1, (w - 1) * s + (kw - 1) * d + 1))
        x, weights = x.reshape(n, g, channels // g, h, w), self.weights.reshape(g, channels // g, own, kh, kw)
        for i in range(kh):
            for j in range(kw):
                full[:, :, :, i * d : i * d + (h - 1) * s + 1 : s, j * d : j * d + (w - 1) * s + 1 : s] += np.einsum("ngchw,gco->ngohw", x, weights[..., i, j], optimize=True)
        full = full.reshape(n, g * own, *full.shape[3:])
        out = full[:, :, top : full.shape[2] - bottom, left : full.shape[3] - right]
        if self.bias is not None:
            out = out + self.bias[:, None, None]
        return ACTIVATE[self.activation](out)


def quantized_convolution(layer: Convolution, x: np.ndarray, scale: tuple[float, float, float], zero: tuple[int, int]) -> np.ndarray:
    """Convolution of u8 codes by i8 weights: 32-bit sums of differences from the zero point, requantised; scale: source, weights, destination."""
    total = layer.summed(x - zero[0])
    if layer.bias is not None:
        total = total + layer.bias[:, None, None]
    return quantized(ACTIVATE[layer.activation](total * (scale[0] * scale[1])), scale[2], zero[1])


def grid_sample(x: np.ndarray, gy: np.ndarray, gx: np.ndarray, method: str = "bilinear", padding: str = "zeros", align: bool = False) -> np.ndarray:
    """Samples of (n, c, h, w) at normalised coordinates in -1..1, the same for all channels."""
    h, w = x.shape[2:]

    def place(v: np.ndarray, n: int) -> np.ndarray:
        p = (v + 1) / 2 * (n - 1) if align else ((v + 1) * n - 1) / 2
        if padding == "border":
            p = np.clip(p, 0, n - 1)
        elif padding == "reflect":
            low, span = (0.0, float(n - 1)) if align else (-0.5, float(n))
            p = np.abs(p - low) % (2 * span)
            p = np.clip(np.where(p > span, 2 * span - p, p) + low, 0, n - 1)
        return p

    def tap(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        inside = (i >= 0) & (i < h) & (j >= 0) & (j < w)
        return np.where(inside, x[:, :, np.clip(i, 0, h - 1), np.clip(j, 0, w - 1)], 0)

    py, px = place(gy, h), place(gx, w)
    if method == "nearest":
        return tap(np.rint(py).astype(int), np.rint(px).astype(int))
    y, xx = np.floor(py).astype(int), np.floor(px).astype(int)
    fy, fx = py - y, px - xx
    return tap(y, xx) * (1 - fy) * (1 - fx) + tap(y, xx + 1) * (1 - fy) * fx + tap(y + 1, xx) * fy * (1 - fx) + tap(y + 1, xx + 1) * fy * fx


def pooled(x: np.ndarray, kernel: int, stride: int, pads: tuple[int, int, int, int], how: str = "max", ceil: bool = False, exclude: bool = True) -> np.ndarray:
    """Pooling of (n, c, h, w) with pads; an average leaves the pads out unless `exclude` is off."""
    top, left, bottom, right = pads
    h, w = x.shape[2:]
    count = lambda size: -(-(size - kernel) // stride) + 1 if ceil else (size - kernel) // stride + 1
    oh, ow = count(h + top + bottom), count(w + left + right)
    fill = -np.inf if how == "max" else 0.0
    need_h, need_w = (oh - 1) * stride + kernel, (ow - 1) * stride + kernel
    grow = ((0, 0), (0, 0), (top, max(bottom, need_h - h - top)), (left, max(right, need_w - w - left)))
    padded, inside = np.pad(x, grow, constant_values=fill), np.pad(np.ones((1, 1, h, w)), grow)
    out, met = None, 0
    for i in range(kernel):
        for j in range(kernel):
            at = np.s_[:, :, i : i + (oh - 1) * stride + 1 : stride, j : j + (ow - 1) * stride + 1 : stride]
            out = padded[at] if out is None else (np.maximum(out, padded[at]) if how == "max" else out + padded[at])
            met = met + inside[at]
    return out if how == "max" else out / (np.maximum(met, 1) if exclude else kernel * kernel)
