"""Operators on packed planes: one row per image, NumPy inside a task.

For filters that no relational plan expresses well, such as recursive ones.
Images are independent, so tasks hold a batch of them and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def on_planes(images: DataFrame, f: Callable[[np.ndarray], np.ndarray], dtype: str = "uint8") -> DataFrame:
    """Apply f to the (h, w) array of every row (img, w, h, data); the result may have another size."""

    def run(batches) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                plane = np.ascontiguousarray(f(np.frombuffer(r.data, dtype).reshape(r.h, r.w)).astype(dtype))
                rows.append((r.img, plane.shape[1], plane.shape[0], plane.tobytes()))
            yield pd.DataFrame(rows, columns=["img", "w", "h", "data"])

    return images.select("img", "w", "h", "data").mapInPandas(run, "img long, w int, h int, data binary")


def median_filter(plane: np.ndarray, radius: int, rhomb: bool = False) -> np.ndarray:
    """Median of the square or rhomb around each pixel, borders clamped."""
    h, w = plane.shape
    p = np.pad(plane, radius, mode="edge")
    size = 2 * radius + 1
    shifts = [p[i : i + h, j : j + w] for i in range(size) for j in range(size) if not rhomb or abs(i - radius) + abs(j - radius) <= radius]
    return np.partition(np.stack(shifts), len(shifts) // 2, axis=0)[len(shifts) // 2]


def gaussian_kernel(sigma: float, epsilon: float = 0.001) -> np.ndarray:
    """Normalised taps down to epsilon of the centre."""
    half = max(1, int(np.floor(sigma * np.sqrt(-2 * np.log(epsilon)))))
    taps = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    return taps / taps.sum()


def gaussian_blur(plane: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian with clamped borders."""
    taps = gaussian_kernel(sigma)
    half = len(taps) // 2
    v = plane.astype(np.float64)
    for axis in (1, 0):
        pad = [(half, half) if a == axis else (0, 0) for a in (0, 1)]
        p = np.pad(v, pad, mode="edge")
        n = v.shape[axis]
        v = sum(t * (p[:, i : i + n] if axis else p[i : i + n]) for i, t in enumerate(taps))
    return np.floor(v + 0.5)


def recursive_bilateral(plane: np.ndarray, spatial: float, range_: float) -> np.ndarray:
    """Edge-preserving first-order recursion along rows from both ends, then along columns; (h, w) or (h, w, channels up to 4).

    A step takes a share of what came before, the less the more the source
    changes there (rounded means of the first three channels); both directions' sums are divided by
    both directions' weights.  Results are cut down to whole numbers, but for a
    ten-thousandth, so that an even plane stays as it is.  Columns weigh by the
    source and filter what the rows gave.
    """
    keep = np.exp(-np.sqrt(2.0) / (spatial * 255))
    source = plane.astype(np.int64).reshape(*plane.shape[:2], -1)
    n = source.shape[2]
    out = source.astype(np.float64)
    for axis in (1, 0):
        apart = np.abs(np.diff(source, axis=axis))
        change = apart[..., 0]
        if n > 1:  # a fourth channel does not count
            change = (change + apart[..., min(n, 3) - 1] + 1) >> 1
        if n > 2:
            change = (apart[..., 1] + change + 1) >> 1
        share = keep * np.exp(-change / (range_ * 255))[..., None]
        x, share = (np.moveaxis(v, axis, 0) for v in (out, share))
        total, norm = np.zeros_like(x), np.zeros((*x.shape[:2], 1))
        for ahead in (True, False):
            order = range(len(x)) if ahead else range(len(x) - 1, -1, -1)
            colour, weight = x[order[0]].copy(), np.ones((x.shape[1], 1))
            for k, i in enumerate(order):
                if k:
                    s = share[min(i, order[k - 1])]
                    colour, weight = (1 - keep) * x[i] + s * colour, (1 - keep) + s * weight
                total[i] += colour
                norm[i] += weight
        out = np.moveaxis(np.floor(total / norm + 1e-4), 0, axis)
    return out.reshape(plane.shape)


def affine_inverse(m: tuple[float, ...]) -> tuple[float, ...]:
    """Inverse of the 2x3 map (a, b, c, d, e, f): x' = a x + b y + c, y' = d x + e y + f."""
    a, b, c, d, e, f = m
    det = a * e - b * d
    if det == 0:
        raise ValueError("the map has no inverse")
    return (e / det, -b / det, (b * f - c * e) / det, -d / det, a / det, (c * d - a * f) / det)


def draw_line(plane: np.ndarray, x1: int, y1: int, x2: int, y2: int, value: int, width: int = 1) -> np.ndarray:
    """A straight line of `width` pixels along the minor axis, cut at the borders."""
    out = plane.copy()
    n = max(abs(x2 - x1), abs(y2 - y1), 1)
    t = np.arange(n + 1) / n
    x, y = np.floor(x1 + t * (x2 - x1) + 0.5).astype(int), np.floor(y1 + t * (y2 - y1) + 0.5).astype(int)
    steep = abs(y2 - y1) > abs(x2 - x1)
    for k in range(width):
        off = k - (width - 1) // 2
        xs, ys = (x + off, y) if steep else (x, y + off)
        ok = (xs >= 0) & (ys >= 0) & (xs < plane.shape[1]) & (ys < plane.shape[0])
        out[ys[ok], xs[ok]] = value
    return out
