"""Shift of a picture against its background, from a coarse level to the finest, with a fraction and how sure it is.

A pair of planes is one row; a task searches pair after pair.  At each level the
search starts from twice the coarser level's shift and goes to the best of the
nine shifts around it until the middle one is the best, so the cost of a level
is a few differences of its own size, whatever the largest shift is.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..streaming.motion import halved

OUT = "found boolean, dx long, dy long, fine_dx double, fine_dy double, stability double, correlation double"


@dataclass(frozen=True)
class ShiftOptions:
    """Largest shift and the least area of the picture at a level; penalty for the share of the picture that a shift hides."""

    levels: int = 4
    max_x: int = 50
    max_y: int = 50
    penalty: float = 0.0
    area_min: int = 25
    gradients: bool = False
    squared: bool = False


def gradient(plane: np.ndarray) -> np.ndarray:
    """Sum of both absolute central differences, at most 255; 0 on the frame."""
    v, out = plane.astype(np.int32), np.zeros(plane.shape, np.uint8)
    out[1:-1, 1:-1] = np.minimum(np.abs(v[1:-1, 2:] - v[1:-1, :-2]) + np.abs(v[2:, 1:-1] - v[:-2, 1:-1]), 255)
    return out


def pyramid(plane: np.ndarray, levels: int) -> list[np.ndarray]:
    out = [plane]
    while len(out) < levels:
        out.append(halved(out[-1]))
    return out


class Level:
    """Differences at one level, each computed once."""

    def __init__(self, background: np.ndarray, picture: np.ndarray, region: tuple[int, int, int, int], most: tuple[int, int], reach: tuple[int, int], o: ShiftOptions):
        self.background, self.picture, self.region, self.most, self.reach, self.o = background.astype(np.int32), picture.astype(np.int32), region, most, reach, o
        self.area = (region[2] - region[0]) * (region[3] - region[1])
        self.table: dict[tuple[int, int], float] = {}

    def difference(self, dx: int, dy: int) -> float | None:
        """Mean difference over what the shift leaves of the region; None where that is less than half of it."""
        l, t, r, b = self.region
        h, w = self.background.shape
        l, t, r, b = max(l, -dx), max(t, -dy), min(r, w - dx), min(b, h - dy)
        area = max(r - l, 0) * max(b - t, 0)
        if 2 * area < self.area:
            return None
        apart = self.background[t + dy : b + dy, l + dx : r + dx] - self.picture[t:b, l:r]
        total = int((apart * apart).sum()) if self.o.squared else int(np.abs(apart).sum())
        return total / area * (1.0 + (self.area - area) * self.o.penalty / self.area)

    def search(self, dx: int, dy: int) -> tuple[int, int] | None:
        self.origin, best, least = (dx, dy), (dx, dy), math.inf
        for _ in range(max(self.reach)):
            middle = best
            for y in range(middle[1] - 1, middle[1] + 2):
                for x in range(middle[0] - 1, middle[0] + 2):
                    if abs(x) > self.most[0] or abs(y) > self.most[1]:
                        return None
                    if (x, y) not in self.table:
                        d = self.difference(x, y)
                        if d is None:
                            return None
                        self.table[x, y] = d
                    if self.table[x, y] < least:
                        best, least = (x, y), self.table[x, y]
            if best == middle:
                return best
        return None

    def around(self) -> np.ndarray | None:
        """The nine differences around the least one, None where one was not looked at or lies beyond the reach."""
        x, y = min(self.table, key=lambda p: (self.table[p], p[1], p[0]))
        if abs(x - self.origin[0]) >= self.reach[0] or abs(y - self.origin[1]) >= self.reach[1]:
            return None
        z = [[self.table.get((x + i, y + j)) for i in (-1, 0, 1)] for j in (-1, 0, 1)]
        return None if any(v is None for row in z for v in row) else np.array(z)


def refined(z: np.ndarray | None) -> tuple[float, float]:
    """Where parabolas through the means of columns and of rows are least; (-1, -1) without neighbours."""
    if z is None:
        return -1.0, -1.0

    def least(a: float, m: float, b: float) -> float:
        return (a - b) / 2 / (a + b - 2 * m) if a + b != 2 * m else math.nan

    return least(*z.mean(0)), least(*z.mean(1))


def stability(z: np.ndarray | None) -> float:
    """How far the least difference lies below the five neighbours that face away from it; 0 where it is no proper minimum."""
    if z is None:
        return 0.0
    fx, fy = refined(z)
    if not (abs(fx) <= 0.75 and abs(fy) <= 0.75):
        return 0.0
    z = z if fx >= 0 else z[:, ::-1]  # turned so that the minimum lies to the right of and below the middle
    z = z if fy >= 0 else z[::-1]
    fx, fy = abs(fx), abs(fy)
    away = (z[0].sum() + z[1:, 0].sum()) / 5
    value = (1 - fx) * (1 - fy) * z[1, 1] + fx * fy * z[2, 2] + (1 - fx) * fy * z[2, 1] + fx * (1 - fy) * z[1, 2]
    return float((away - value) / away) if away else 0.0


def estimate(background: np.ndarray, picture: np.ndarray, x0: int, y0: int, o: ShiftOptions) -> tuple | None:
    """dx, dy, fine dx, fine dy, stability, correlation of a picture that lies at (x0, y0) of its background, or None.

    None where the search leaves the largest shift, hides over half of the picture
    or does not come to rest.  Around the picture its plane holds zeros.
    """
    h, w = background.shape
    ph, pw = picture.shape
    if x0 < 0 or y0 < 0 or x0 + pw > w or y0 + ph > h or pw * ph < o.area_min:
        return None
    regions = [tuple(v >> k for v in (x0, y0, x0 + pw, y0 + ph)) for k in range(o.levels)]
    n = max(k + 1 for k, (l, t, r, b) in enumerate(regions) if (r - l) * (b - t) >= o.area_min)
    own = np.zeros((h, w), np.uint8)
    own[y0 : y0 + ph, x0 : x0 + pw] = gradient(picture) if o.gradients else picture
    planes = zip(pyramid(gradient(background) if o.gradients else background, n), pyramid(own, n))
    x = y = 0
    for k, (back, front) in reversed(list(enumerate(planes))):
        most = max((o.max_x >> k) + 1, 2), max((o.max_y >> k) + 1, 2)
        level = Level(back, front, regions[k], most, most if k == n - 1 else (3, 3), o)
        found = level.search(2 * x, 2 * y)
        if found is None:
            return None
        x, y = found
    z = level.around()
    fx, fy = refined(z)
    d = level.table[x, y]
    return x, y, x + fx, y + fy, stability(z), 1.0 - (math.sqrt(d) if o.squared else d) / 255


def shifts(pairs: DataFrame, options: ShiftOptions | None = None) -> DataFrame:
    """Add found, dx, dy, fine_dx, fine_dy, stability, correlation to pairs of gray planes.

    pairs: w, h, background, pw, ph, picture, x0, y0 and an id column `img`; no
    shuffle.  Rows with a null plane, and pictures that do not fit, are not found
    and have nulls, as have those whose search fails.
    """
    o = options or ShiftOptions()

    def run(batches):
        for batch in batches:
            rows = []
            for w, h, back, pw, ph, front, x0, y0 in zip(*(batch.column(c).to_pylist() for c in ("w", "h", "background", "pw", "ph", "picture", "x0", "y0"))):
                found = None
                if back is not None and front is not None:
                    found = estimate(np.frombuffer(back, np.uint8).reshape(h, w), np.frombuffer(front, np.uint8).reshape(ph, pw), x0, y0, o)
                rows.append((found is not None, *(found or [None] * 6)))
            kinds = [pa.bool_(), pa.int64(), pa.int64(), *[pa.float64()] * 4]
            columns = [pa.array(v, k) for v, k in zip(zip(*rows) if rows else [()] * 7, kinds)]
            yield pa.record_batch([batch.column("img"), *columns], ["img", *(f.split()[0] for f in OUT.split(", "))])

    return pairs.mapInArrow(run, f"img {pairs.schema['img'].dataType.simpleString()}, {OUT}")
