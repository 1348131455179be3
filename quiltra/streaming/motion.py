"""Motion detection and tracking: each camera's background, objects and expiry timer as state of a stream.

A frame's way: scaled down where it is read (no shuffle), or made of a row after
the shuffle; then to its camera's state, where its pyramid and gradients are
compared with the ranges that the background has at each level; regions of
strong difference are found at the coarsest level and followed down to the
finest; regions are linked to objects, objects that have moved long and far
enough get a number, and the background takes the frame in.

State of a camera: one compressed value (its clocks, objects of `trajectory`
places each at most, and the background planes, whose size is that of the
frame's pyramid) and one event-time timer.  Where frames are made, up to 32
neighbouring cameras are under one key: they are read, looked at and written
together.  A camera that sends nothing for `remove_time` loses its objects when
the watermark passes that time, or with its next frame if that comes first; both
give the same row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .run import ROCKSDB

OUT = "cam long, ts timestamp, kind string, id long, l long, t long, r long, b long, x long, y long, n_places long"
INIT, GROW, UPDATE = range(3)


@dataclass(frozen=True)
class MotionOptions:
    """Sizes are shares of the screen, times seconds; `roi` is a polygon of (x, y) shares, empty for the whole screen."""

    object_width: float = 0.05
    object_height: float = 0.05
    roi: tuple[tuple[float, float], ...] = ()
    scale_levels: int = 3
    weights: tuple[int, int, int] = (18, 18, 18)  # of gray, horizontal and vertical gradient
    forward: bool = True
    grow_time: float = 1.0
    stat_time: float = 0.04
    update_time: float = 1.0
    sabotage_frames: int = 3
    create: float = 0.5
    expand: float = 0.75
    stable_area: float = 0.5
    trajectory: int = 1024
    remove_time: float = 1.0
    linking: float = 0.0
    averaged: int = 12
    shift_min: float = 0.075
    time_min: float = 1.0
    # fixed values
    levels_min: int = 3
    top_size: int = 32
    area_min: int = 16
    saturation: int = 16
    boost: int = 4

    def __post_init__(self):
        object.__setattr__(self, "roi", tuple(map(tuple, self.roi)))


@dataclass(frozen=True)
class Layout:
    """Levels of a frame size: how far frames are scaled down, the sizes of the pyramid, the least region."""

    scaled: int
    sizes: tuple[tuple[int, int], ...]  # height, width
    area: int

    @staticmethod
    def of(width: int, height: int, o: MotionOptions) -> Layout:
        area = int(math.floor(o.object_width * width + 0.5)) * int(math.floor(o.object_height * height + 0.5))
        w, h, levels = width, height, 1
        while min(w, h) >= o.top_size and area > o.area_min:
            w, h, levels, area = (w + 1) >> 1, (h + 1) >> 1, levels + 1, area // 4
        scaled = min(max(levels - o.levels_min, 0), o.scale_levels)
        w, h = width, height
        for _ in range(scaled):
            w, h = (w + 1) >> 1, (h + 1) >> 1
        sizes = [(h, w)]
        for _ in range(levels - scaled - 1):
            sizes.append(((sizes[-1][0] + 1) >> 1, (sizes[-1][1] + 1) >> 1))
        return Layout(scaled, tuple(sizes), max(area, o.area_min // 4 + 1))


def halved(plane: np.ndarray) -> np.ndarray:
    """Rounded means of 2x2 pixels."""
    p = np.pad(plane.astype(np.int32), [(0, plane.shape[0] % 2), (0, plane.shape[1] % 2)], "edge")
    return ((p[::2, ::2] + p[::2, 1::2] + p[1::2, ::2] + p[1::2, 1::2] + 2) >> 2).astype(np.uint8)


def smoothed(plane: np.ndarray) -> np.ndarray:
    """Half the size by taps 1 3 3 1 in both directions, rounded, edges repeated; of one plane or of many in front of each other."""
    h, w = plane.shape[-2:]
    if h % 2 or w % 2:
        plane = np.pad(plane, [(0, 0)] * (plane.ndim - 2) + [(0, h % 2), (0, w % 2)], "edge")
    pairs = np.ascontiguousarray(plane).view("<u2")  # two neighbours of a row; 64 * 255 + 32 at most
    rows = folded(pairs & 255, pairs >> 8, 1, np.s_[..., :1], np.s_[..., -1:])
    even, odd = np.ascontiguousarray(rows[..., ::2, :]), np.ascontiguousarray(rows[..., 1::2, :])
    out = folded(even, odd, rows.shape[-1], np.s_[..., :1, :], np.s_[..., -1:, :])
    out += 32
    out >>= 6
    return out.astype(np.uint8)


def folded(even: np.ndarray, odd: np.ndarray, step: int, first: tuple, last: tuple) -> np.ndarray:
    """Taps 1 3 3 1 on the odd one before (a step away), the even, the odd and the even one after; edges repeated."""
    out, beside = even + odd, np.empty_like(odd)
    out *= 3
    flat = beside.reshape(-1)
    flat[step:] = odd.reshape(-1)[:-step]
    beside[first] = even[first]
    out += beside
    flat[:-step] = even.reshape(-1)[step:]
    beside[last] = odd[last]
    out += beside
    return out


def gradients(planes: np.ndarray, saturation: int, boost: int) -> tuple[np.ndarray, np.ndarray]:
    """Saturated central differences in x and y, lifted to positive numbers; 0 on the frame.  Of planes that lie one after another."""
    v = planes.reshape(-1)
    out = np.zeros((2, *planes.shape), np.uint8)
    for k, step in enumerate((1, planes.shape[-1])):
        before, after = v[: -2 * step], v[2 * step :]
        if len(after):
            top, limit = np.maximum(before, after), np.full(len(after), saturation, np.uint8)  # the least of two arrays is found faster than that of an array and a number
            apart = np.minimum(top - before, limit)
            apart += saturation
            apart -= np.minimum(top - after, limit)
            apart *= boost
            out[k].reshape(-1)[step : len(v) - step] = apart
    out[..., :1, :], out[..., -1:, :], out[..., :1], out[..., -1:] = 0, 0, 0, 0
    return out[0], out[1]


def inside(points: Iterable[tuple[float, float]], shape: tuple[int, int]) -> np.ndarray:
    """255 at pixels whose centre lies inside the polygon (even-odd), all of them without one."""
    points = list(points)
    if len(points) < 3:
        return np.full(shape, 255, np.uint8)
    y, x = (np.arange(shape[0])[:, None] + 0.5) / shape[0], (np.arange(shape[1])[None] + 0.5) / shape[1]
    odd = np.zeros(shape, bool)
    for (x0, y0), (x1, y1) in zip(points, points[1:] + points[:1]):
        if y0 != y1:
            odd ^= ((y0 <= y) != (y1 <= y)) & (x < x0 + (y - y0) * (x1 - x0) / (y1 - y0))
    return np.where(odd, 255, 0).astype(np.uint8)


@dataclass
class Background:
    """Ranges lo..hi and how often values fell below and above, for each feature and level, one after another."""

    planes: np.ndarray  # 4 x samples: lo, hi, count below, count above
    state: int = INIT
    grow_end: float = 0.0
    stat: float = 0.0
    update: float = 0.0
    updates: int = 0
    sabotaged: int = 0
    unstable: bool = False
    last: float = 0.0

    def restart(self, values: np.ndarray, now: float, o: MotionOptions) -> None:
        self.planes = np.stack([values, values, np.zeros_like(values), np.zeros_like(values)])
        self.grow_end, self.state, self.updates, self.stat, self.update = now + o.grow_time, GROW, 0, 0.0, 0.0

    def apart(self, values: np.ndarray, away: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How far values lie below and above their ranges, the larger of both in `away`."""
        lo, hi = self.planes[:2]
        below, above = np.maximum(values, lo), np.minimum(values, hi)
        below -= values
        np.subtract(values, above, out=above)
        np.maximum(below, above, out=away)
        return below, above

    def follow(self, values: np.ndarray, times: Sequence[float], o: MotionOptions, away: np.ndarray) -> list[int]:
        """The background takes frames in, none of which changes `unstable`; how far each was away, and the state before it."""
        states = []
        for v, now, a in zip(values, times, away):
            states.append(self.state)
            if self.state == INIT:
                a[:], apart = 0, None
            else:
                apart = self.apart(v, a)
            self.take(v, now, o, apart)
        return states

    def take(self, values: np.ndarray, now: float, o: MotionOptions, apart: tuple[np.ndarray, np.ndarray] | None) -> None:
        """The background takes a frame in, which lies `apart` from its ranges."""
        lo, hi, below, above = self.planes
        updating = self.state == UPDATE
        if self.state == INIT or self.state == GROW and self.unstable:
            self.restart(values, now, o)
        elif self.state == GROW:
            np.minimum(lo, values, out=lo)
            np.maximum(hi, values, out=hi)
            if self.grow_end < now:
                self.state, self.updates = UPDATE, 0
        elif self.unstable:
            self.sabotaged += 1
            if self.sabotaged > o.sabotage_frames:
                self.restart(values, now, o)
        else:
            self.stat += now - self.last
            self.update += now - self.last
            if self.stat > o.stat_time:
                below += (apart[0] > 0).view(np.uint8)  # 127 at most
                above += (apart[1] > 0).view(np.uint8)
                self.stat, self.updates = 0.0, self.updates + 1
                if self.updates >= 127 or self.update > o.update_time and self.updates >= 8:
                    for bound, count, out in ((lo, below, -1), (hi, above, 1)):
                        less, more = (count > 1, count < 1) if out < 0 else (count < 1, count > 1)
                        bound -= less & (bound > 0)
                        bound += more & (bound < 255)
                        count[:] = 0
                    self.update, self.updates = 0.0, 0
        if updating and not self.unstable:
            self.sabotaged = 0
        self.last = now


@dataclass
class Tracked:
    """An object; places are rows of time, centre x, y and left, top, right, bottom."""

    x: int
    y: int
    rect: tuple[int, int, int, int]
    start_x: int
    start_y: int
    start: float
    number: int = -1  # -1 until it has moved
    places: list[tuple] = field(default_factory=list)


def centre(rect) -> tuple[int, int]:
    return (rect[0] + rect[2] + 1) // 2, (rect[1] + rect[3] + 1) // 2


def holds(rect, x: int, y: int) -> bool:
    return rect[0] <= x < rect[2] and rect[1] <= y < rect[3]


def clipped(rect, shape, border: int):
    return max(rect[0], border), max(rect[1], border), min(rect[2], shape[1] - border), min(rect[3], shape[0] - border)


def grown(seeds: np.ndarray, free: np.ndarray) -> Iterator[tuple[int, list[int]]]:
    """Frame and cells of each seed, in order, with all free cells that it reaches; cells are taken once.  A seed need not be free."""
    wide = free.shape[2]
    for f in np.flatnonzero(seeds.any((1, 2))).tolist():
        open_, taken = free[f].ravel().tolist(), [False] * free[f].size
        for seed in np.flatnonzero(seeds[f]).tolist():
            if taken[seed]:
                continue
            stack, cells = [seed], []
            taken[seed] = True
            while stack:
                at = stack.pop()
                cells.append(at)
                for a in (at - 1, at - wide, at + 1, at + wide):
                    if open_[a] and not taken[a]:
                        taken[a] = True
                        stack.append(a)
            yield f, cells


def pools(seeds: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label of each cell (0: none), frame and box (l, t, r, b) of each label: connected free cells with a seed, in the order of first seeds.

    Cells of the planes' borders are neither seeds nor free.  Rows are cut into runs, and runs that touch are joined.
    """
    shape, wide = free.shape, free.shape[2]
    labels = np.zeros(free.size, np.int32)
    if (seeds & ~free).any():
        where = [(f, np.array(cells)) for f, cells in grown(seeds, free)]
        boxes = np.array([(c.min(), r.min(), c.max() + 1, r.max() + 1) for _, cells in where for r, c in [np.divmod(cells, wide)]])
        for k, (f, cells) in enumerate(where, 1):
            labels[f * shape[1] * wide + cells] = k
        return labels.reshape(shape), np.array([f for f, _ in where]), boxes
    v = free.ravel()
    edge = np.flatnonzero(v[1:] != v[:-1]) + 1
    begin, end = edge[::2], edge[1::2]
    run = np.repeat(np.arange(len(begin), dtype=np.int32), end - begin)
    cells = np.flatnonzero(v)
    labels[cells] = run
    below = v[wide:] & v[:-wide]
    first = np.flatnonzero(below[1:] & ~below[:-1]) + 1
    root = list(range(len(begin)))
    for a, b in zip(labels[first].tolist(), labels[first + wide].tolist()):
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        root[max(a, b)] = min(a, b)
    for k, r in enumerate(root):  # a root is the least of its runs
        root[k] = root[r]
    root = np.array(root, np.int32)
    own, at = np.unique(root[labels[np.flatnonzero(seeds)]], return_index=True)
    own = own[np.argsort(at)]
    number = np.zeros(len(root), np.int32)
    number[own] = np.arange(1, len(own) + 1)
    number = number[root]
    labels[cells] = number[run]
    rows, columns = np.divmod(begin, wide)
    boxes = np.tile(np.array([wide, shape[1], 0, 0]), (len(own) + 1, 1))
    for k, values in enumerate((columns, rows % shape[1], columns + end - begin, rows % shape[1] + 1)):
        (np.minimum if k < 2 else np.maximum).at(boxes[:, k], number, values)
    return labels.reshape(shape), begin[own] // (shape[1] * wide), boxes[1:]


def between(first: np.ndarray, end: np.ndarray, begin: int, stop: int) -> np.ndarray:
    """For each frame, which of begin..stop lie in first..end."""
    at = np.arange(begin, stop)
    return (at >= first[:, None]) & (at < end[:, None])


def parts(boxes: np.ndarray, pixels: int) -> list[slice]:
    """All boxes together, or each for itself where a window that holds them all has 100,000 pixels more than they have; a cell of a box is so many pixels."""
    (l, t), (r, b) = boxes[:, :2].min(0).tolist(), boxes[:, 2:].max(0).tolist()
    more = (r - l) * (b - t) - np.mean((boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1]))
    return [slice(0, len(boxes))] if more * pixels < 100_000 else [slice(k, k + 1) for k in range(len(boxes))]


def regions(difference: list[np.ndarray], roi: np.ndarray, area: int, o: MotionOptions) -> tuple[list[list[tuple]], list[int]]:
    """Boxes of moving regions of each frame at the finest level, and how many of its pixels they hold; levels are planes of many frames.

    The frames' first regions go down the levels together, then their second ones, and so on, unless they lie far apart.
    """
    create, expand = int(255 * o.create), int(255 * o.expand * o.create)
    top, n = len(difference) - 1, len(difference[0])
    inner = np.zeros(difference[top].shape, bool)
    inner[:, 1:-1, 1:-1] = (roi > 0)[1:-1, 1:-1]
    seeds = (difference[top] > create) & inner
    inner[:, 1:-1, 1:-1] = True
    found, covered = [[] for _ in range(n)], [0] * n
    if not seeds.any():
        return found, covered
    labels, of, boxes = pools(seeds, (difference[top] > expand) & inner)
    large = np.flatnonzero((boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1]) > area)
    per = [[] for _ in range(n)]
    for k, f in zip(large.tolist(), of[large].tolist()):
        per[f].append(k)
    order = sorted((f for f in range(n) if per[f]), key=lambda f: -len(per[f]))
    if not order:
        return found, covered
    if top == 0:
        sizes = np.bincount(labels.ravel(), minlength=len(boxes) + 1).tolist()
        for f in order:
            found[f], covered[f] = [tuple(boxes[k].tolist()) for k in per[f]], sum(sizes[k + 1] for k in per[f])
        return found, covered
    # 2: not to be taken, 3 and more: regions
    most = len(per[order[0]])
    kind = np.uint8 if most + 3 < 256 else np.int32
    labels = labels[order]
    masks = [np.zeros((len(order), *d.shape[1:]), kind) for d in difference[:top]]
    strong = [d[order] > expand for d in difference[:top]]
    turns = [[per[f][turn] for f in order if len(per[f]) > turn] for turn in range(most)]
    for part, of in ((part, np.array(of[part])) for of in turns for part in parts(boxes[of], 4**top)):
        index = np.array([len(found[f]) + 3 for f in order[part]], kind)[:, None, None]
        rect, alive, above = boxes[of], np.ones(len(of), bool), []
        for level in range(top, 0, -1):
            above.append((level, rect))
            l, t, r, b = rect.T
            # a window that holds all frames' rectangles
            (l0, t0), (r1, b1) = rect[alive, :2].min(0).tolist(), rect[alive, 2:].max(0).tolist()
            upper = (part, slice(t0, b1 + 1), slice(l0, r1 + 1))
            parent = labels[upper] == of[:, None, None] + 1 if level == top else masks[level][upper] == index
            pair, either = parent[..., :-1] & parent[..., 1:], parent[..., :-1] | parent[..., 1:]
            corners = (pair[:, :-1] & pair[:, 1:]).view(np.uint8) + (either[:, :-1] | either[:, 1:]).view(np.uint8)  # 0: none, 1: some, 2: all
            corners *= between(t, b, t0, b1)[:, :, None]
            corners *= between(l, r, l0, r1)[:, None]
            lower = (part, slice(2 * t0 + 1, 2 * b1 + 1), slice(2 * l0 + 1, 2 * r1 + 1))
            child = masks[level - 1][lower]
            m, high, wide = corners.shape
            twice = (corners.astype(np.uint16) * 257).view(np.uint8)[:, :, None]  # each beside itself
            new = (twice + strong[level - 1][lower].reshape(m, high, 2, 2 * wide) > 1).reshape(child.shape)
            new &= child == 0
            child += new * index
            h, w = shape = masks[level - 1].shape[1:]
            l, t = np.maximum(2 * l - 2, 1), np.maximum(2 * t - 2, 1)
            r, b = np.minimum(2 * r + 2, w - 1), np.minimum(2 * b + 2, h - 1)
            l0, t0, r1, b1 = clipped((2 * l0 - 2, 2 * t0 - 2, 2 * r1 + 2, 2 * b1 + 2), shape, 1)
            at = masks[level - 1][part, t0:b1, l0:r1] == index
            at &= between(t, b, t0, b1)[:, :, None]
            at &= between(l, r, l0, r1)[:, None]
            rows, columns = at.any(2), at.any(1)
            # the tight box with a border of one
            rect = np.stack([columns.argmax(1) + l0 - 1, rows.argmax(1) + t0 - 1, r1 + 1 - columns[:, ::-1].argmax(1), b1 + 1 - rows[:, ::-1].argmax(1)], 1)
            rect = np.concatenate([np.maximum(rect[:, :2], 1), np.minimum(rect[:, 2:], [w - 1, h - 1])], 1)
            for k in np.flatnonzero(alive & ~rows.any(1)).tolist():
                alive[k] = False
                for upper, boxed in above[1:]:
                    l, t, r, b = boxed[k].tolist()
                    lost = masks[upper][part.start + k, t:b, l:r]
                    lost[lost == index[k]] = 2
            rect[~alive] = 0
            if not alive.any():
                break
        for k in np.flatnonzero(alive).tolist():
            found[order[part.start + k]].append(tuple(rect[k].tolist()))
    for k, f in enumerate(order):
        covered[f] = int(np.count_nonzero(masks[0][k] >= 3))
    return found, covered


#: Frames and samples that are taken at once.
AT_ONCE = 80
SAMPLES = 8_000_000


def keep_memory() -> None:
    """Lets the process keep freed arrays of up to 16 MB: glibc holds what it has seen freed once, else every array of a batch is paged in anew."""
    np.empty(1 << 24, np.uint8)


@lru_cache(maxsize=8)
def surroundings(width: int, height: int, o: MotionOptions) -> tuple[Layout, np.ndarray, list[np.ndarray]]:
    """What cameras of one size share: the levels, where each begins, the region of interest at each."""
    layout = Layout.of(width, height, o)
    roi = [inside(o.roi, layout.sizes[0])]
    while len(roi) < len(layout.sizes):
        roi.append(smoothed(roi[-1]))
    return layout, np.cumsum([0, *(h * w for h, w in layout.sizes)]), roi


class Scene:
    """One camera between frames; everything that its state keeps."""

    def __init__(self, width: int, height: int, o: MotionOptions):
        self.o, self.width, self.height = o, width, height
        self.layout, self.cuts, self.roi = surroundings(width, height, o)
        self.back = Background(np.zeros((4, 3 * int(self.cuts[-1])), np.uint8))
        self.objects: list[Tracked] = []
        self.numbers = 0
        self.whole = all((r == 255).all() for r in self.roi)
        h, w = self.layout.sizes[0]
        self.far = int((h * h + w * w) * o.shift_min * o.shift_min)
        self.at_once = max(1, min(AT_ONCE, SAMPLES // max(3 * int(self.cuts[-1]), 1)))
        self.ahead = self.at_once

    def values(self, planes: np.ndarray) -> np.ndarray:
        """Samples of each of many planes: features, then levels, one after another."""
        pyramid = [planes]
        while len(pyramid) < len(self.layout.sizes):
            pyramid.append(smoothed(pyramid[-1]))
        if any(self.o.weights[1:]):
            grads = [gradients(p, self.o.saturation, self.o.boost) for p in pyramid]
        else:
            grads = [(np.zeros_like(p),) * 2 for p in pyramid]
        return np.concatenate([p.reshape(len(planes), -1) for p in (*pyramid, *(g[0] for g in grads), *(g[1] for g in grads))], 1)

    def difference(self, away: np.ndarray) -> list[np.ndarray]:
        """Weighted squares of how far frames are away, each level with what the finer one hands up."""
        n = int(self.cuts[-1])
        total = np.zeros((len(away), n), np.uint16 if max(self.o.weights) < 256 else np.uint32)
        for k, weight in enumerate(self.o.weights):
            if weight:
                square = np.square(away[:, k * n : (k + 1) * n], dtype=np.uint16 if weight < 256 else np.uint32)
                np.minimum(square, np.full(n, -(-255 * 256 // weight), square.dtype), out=square)  # from here on it is 255 or more
                square *= weight
                square >>= 8
                total += square
        total = np.minimum(total, np.full(n, 255, total.dtype)).astype(np.uint8)
        out = [total[:, a:b].reshape(-1, *size) for a, b, size in zip(self.cuts, self.cuts[1:], self.layout.sizes)]
        for k in range(1, len(out)) if self.o.forward else ():
            out[k] = np.maximum(out[k], smoothed(out[k - 1]))
        return out if self.whole else [d & m for d, m in zip(out, self.roi)]

    def loud(self, away: np.ndarray) -> np.ndarray:
        """Frames that may have a region: their largest values of all features together are strong enough; no level has more."""
        most = away.reshape(len(away), 3, -1).max(2, initial=0).astype(np.int64)
        return np.flatnonzero(np.minimum(most * most * self.o.weights >> 8, 255).sum(1) > int(255 * self.o.create))

    def expire(self, now: float) -> list[tuple]:
        """Objects leave at `now`."""
        gone, self.objects = [x for x in self.objects if x.number >= 0], []
        return [self.row("out", now, x) for x in gone]

    def silent(self, now: float, last: float) -> list[tuple]:
        """What a camera that has sent nothing since `last` has lost by `now`."""
        end = last + self.o.remove_time
        return self.expire(end) if self.objects and end <= now else []

    def row(self, kind: str, now: float, x: Tracked | None = None) -> tuple:
        if x is None:
            return (kind, now, *[None] * 8)
        size = 1 << self.layout.scaled
        rect = [v * size for v in x.rect]
        last = x.places[-1]
        return kind, now, x.number, *rect, last[1] * size, last[2] * size, len(x.places)

    def frames(self, values: np.ndarray, times: list[float]) -> list[tuple]:
        """Rows of frames, given by their samples."""
        return advance([self], [values], [times])[0]

    def next(self, state: int, found: list[tuple], now: float, last: float, turn: str) -> list[tuple]:
        """Rows of one frame, given by its regions: what comes and goes, then every object that moves."""
        out = self.silent(now, last) if state != INIT else []
        if turn:
            out.append(self.row(turn, now))
        if state == UPDATE:
            left = self.track(found, now)
        else:
            left, self.objects = self.objects, []
        left = [x for x in left if x.number >= 0]
        out += [self.row("out", now, x) for x in left]
        for x in self.objects:
            (_, px, py, *_), moved = x.places[-1], x.number >= 0
            if not moved and now - x.start >= self.o.time_min and (px - x.start_x) ** 2 + (py - x.start_y) ** 2 >= self.far:
                x.number, self.numbers = self.numbers, self.numbers + 1
                out.append(self.row("in", now, x))
        return out + [self.row("object", now, x) for x in (*self.objects, *left) if x.number >= 0]

    def track(self, found: list[tuple], now: float) -> list[Tracked]:
        """Link regions to objects, add new objects; returns those that are gone."""
        for x in self.objects:
            if len(x.places) > self.o.trajectory:
                del x.places[0]
        gone = [x for x in self.objects if now - x.places[-1][0] >= self.o.remove_time]
        self.objects = [x for x in self.objects if now - x.places[-1][0] < self.o.remove_time]
        centres = [centre(r) for r in found]
        apart = lambda x, k: (x.x - centres[k][0]) ** 2 + (x.y - centres[k][1]) ** 2
        nearest = [min(range(len(self.objects)), key=lambda j: apart(self.objects[j], k), default=-1) for k in range(len(found))]
        taken = set()
        for j, x in enumerate(self.objects):
            near = lambda k: holds(self.wide(found[k]), x.x, x.y) or holds(self.wide(x.rect), *centres[k])  # noqa: E731, B023
            able = [k for k in range(len(found)) if nearest[k] == j and near(k)]
            if not able:
                continue
            k = min(able, key=lambda k: apart(x, k))  # noqa: B023
            taken.add(k)
            x.places.append((now, *centres[k], *found[k]))
            recent = x.places[-self.o.averaged :]
            rect = [sum(side) // len(recent) for side in list(zip(*recent))[3:]]
            dx, dy = (a - b for a, b in zip(centres[k], centre(rect)))
            x.rect = clipped((rect[0] + dx, rect[1] + dy, rect[2] + dx, rect[3] + dy), self.layout.sizes[0], 0)
            x.x, x.y = centres[k]
        for k, r in enumerate(found):
            if k not in taken and not any(holds(x.rect, *centres[k]) for x in self.objects):
                self.objects.append(Tracked(*centres[k], r, *centres[k], now, places=[(now, *centres[k], *r)]))
        return gone

    def wide(self, rect):
        border = math.ceil((rect[2] - rect[0] + rect[3] - rect[1]) // 2 * self.o.linking)
        return rect[0] - border, rect[1] - border, rect[2] + border, rect[3] + border


def advance(scenes: Sequence[Scene], values: Sequence[np.ndarray], times: Sequence[list[float]]) -> list[list[tuple]]:
    """Rows of the frames of each camera, given by their samples; the cameras have one size.

    A background goes ahead as if no frame made the scene stable or unstable; where one does, it goes back and
    comes again up to that frame.  So differences and regions of many frames and cameras are found at once.
    """
    out, at = [[] for _ in scenes], [0] * len(scenes)
    one = scenes[0]
    h, w = one.layout.sizes[0]
    while todo := [j for j, k in enumerate(at) if k < len(times[j])]:
        ends = [min(at[j] + scenes[j].ahead, len(times[j])) for j in todo]
        cuts = np.cumsum([0, *(end - at[j] for j, end in zip(todo, ends))]).tolist()
        away, backs, states = np.empty((cuts[-1], values[0].shape[1]), np.uint8), [], []
        for j, end, cut in zip(todo, ends, cuts):
            back = scenes[j].back
            backs.append(replace(back, planes=back.planes.copy()))
            states += back.follow(values[j][at[j] : end], times[j][at[j] : end], one.o, away[cut:])
        found, covered = [[] for _ in states], [0] * len(states)
        moved = one.loud(away)
        if len(moved):
            for k, boxes, pixels in zip(moved.tolist(), *regions(one.difference(away if len(moved) == len(away) else away[moved]), one.roi[-1], one.layout.area, one.o)):
                found[k], covered[k] = boxes, pixels
        for j, end, cut, before in zip(todo, ends, cuts, backs):
            s, k, last, was = scenes[j], at[j], before.last, before.unstable
            own = slice(cut, cut + end - k)
            unstable = [pixels >= h * w * s.o.stable_area if state != INIT else was for state, pixels in zip(states[own], covered[own])]
            turn = next((i for i, u in enumerate(unstable) if u != was), None)
            if turn is None:
                s.ahead = min(2 * s.ahead, s.at_once)
            else:
                s.back, end, s.ahead = before, k + turn + 1, max(s.ahead // 4, 1)  # noqa: PLW2901
                s.back.follow(values[j][k : end - 1], times[j][k : end - 1], s.o, away)
                s.back.unstable = unstable[turn]
                s.back.follow(values[j][end - 1 : end], times[j][end - 1 : end], s.o, away)
            for state, boxes, now, u in zip(states[own], found[own], times[j][k:end], unstable):
                out[j] += s.next(state, boxes, now, last, "" if u == was else "sabotage on" if u else "sabotage off")
                last = now
            at[j] = end
    return out


def together(runs: Iterable[tuple], most: int) -> Iterator[list[tuple]]:
    """Runs (camera, times, data) in lists of `most` frames or of one run."""
    part, n = [], 0
    for run in runs:
        if part and n + len(run[1]) > most:
            yield part
            part, n = [], 0
        part.append(run)
        n += len(run[1])
    if part:
        yield part


def through(scenes: dict[int, Scene], options: MotionOptions, frames: dict[int, list[tuple]], packed: bool = True) -> dict[int, list[tuple]]:
    """Takes cameras through frames (microseconds, w, h, scaled_w, scaled_h, data, compressed if `packed`) in order of time; rows of each."""
    out, at = {cam: [] for cam in frames}, dict.fromkeys(frames, 0)
    while at := {cam: k for cam, k in at.items() if k < len(frames[cam])}:
        runs: dict[tuple, list[tuple]] = {}
        for cam, k in at.items():
            own, s = frames[cam], scenes.get(cam)
            _, w, h, *_ = size = own[k]
            if s is None or (s.width, s.height) != (w, h):
                out[cam] += s.expire(own[k][0] / 1e6) if s else []
                numbers = s.numbers if s else 0
                s = scenes[cam] = Scene(int(w), int(h), options)
                s.numbers = numbers
                last = -math.inf
            else:
                last = s.back.last
            end, times, data = k, [], []
            while end < len(own) and len(times) < s.at_once and own[end][1:5] == size[1:5]:
                now = own[end][0] / 1e6
                if now > last:  # not a frame that is not newer than the camera's last one
                    times.append(now)
                    data.append(own[end][5])
                    last = now
                end += 1
            if times:
                runs.setdefault(size[1:5], []).append((cam, times, data))
            at[cam] = end
        for (_, _, sw, sh), several in runs.items():
            for part in together(several, scenes[several[0][0]].at_once):
                cams, times, data = zip(*part)
                data = [d for some in data for d in some]
                if packed and sw * sh:
                    data = [pa.decompress(d, sw * sh, "lz4_raw", asbytes=True) for d in data]
                planes = np.frombuffer(b"".join(data) if sw * sh else b"", np.uint8).reshape(len(data), sh, sw)
                values = np.split(scenes[cams[0]].values(planes), np.cumsum([len(t) for t in times])[:-1])
                for cam, rows in zip(cams, advance([scenes[cam] for cam in cams], values, times)):
                    out[cam] += rows
    return out


STATE = "size long, kept binary"
#: Cameras of one key where frames are made: 1 << GROUPED.
GROUPED = 5
#: Settings of a stream whose cameras all send in every batch, so that each batch writes the whole state anew: what it
#: replaces goes from the state store with it, and from the checkpoint but for the batch before.
REWRITTEN = {"spark.sql.streaming.stateStore.rocksdb.compactOnCommit": "true", "spark.sql.streaming.minBatchesToRetain": "2"}


def kept(scenes: dict[int, Scene]) -> bytes:
    """Cameras in bytes that compress well: planes come last, a range's width for its end, and counts up to 2, as more tells nothing more."""
    whole, real, objects, planes = [], [], [], []
    for cam, s in scenes.items():
        b = s.back
        whole += (cam, s.width, s.height, b.state, b.updates, b.sabotaged, b.unstable, s.numbers, len(s.objects))
        real += (b.grow_end, b.stat, b.update, b.last)
        for x in s.objects:
            objects += (len(x.places), x.x, x.y, *x.rect, x.start_x, x.start_y, x.start, x.number)
            for place in x.places:
                objects += place
        lo, hi, below, above = b.planes
        planes += (lo, hi - lo, np.minimum(below, 2) + 3 * np.minimum(above, 2))
    return np.array([len(scenes), *whole], np.int64).tobytes() + np.array([*real, *objects], np.float64).tobytes() + b"".join(planes)


def restored(data: bytes, options: MotionOptions) -> dict[int, Scene]:
    """The cameras that `kept` has kept."""
    scenes, n = {}, int(np.frombuffer(data, np.int64, 1)[0])
    whole = np.frombuffer(data, np.int64, 9 * n, 8).reshape(n, 9).tolist()
    real = np.frombuffer(data, np.float64, 4 * n, at := 8 + 72 * n).reshape(n, 4).tolist()
    at += 32 * n
    for (cam, width, height, state, updates, sabotaged, unstable, numbers, objects), (grow_end, stat, update, last) in zip(whole, real):
        s = scenes[cam] = Scene(width, height, options)
        s.back, s.numbers = Background(s.back.planes, state, grow_end, stat, update, updates, sabotaged, bool(unstable), last), numbers
        for _ in range(objects):
            count, x, y, l, t, r, b, sx, sy, start, number = np.frombuffer(data, np.float64, 11, at).tolist()
            rows = np.frombuffer(data, np.float64, 7 * int(count), at + 88).reshape(-1, 7).tolist()
            at += 88 + 56 * len(rows)
            s.objects.append(Tracked(int(x), int(y), (int(l), int(t), int(r), int(b)), int(sx), int(sy), start, int(number), [(p[0], *map(int, p[1:])) for p in rows]))
    for s in scenes.values():
        size = s.back.planes.shape[1]
        lo, wide, counts = np.frombuffer(data, np.uint8, 3 * size, at).reshape(3, size)
        at += 3 * size
        planes = s.back.planes
        planes[0] = lo
        np.add(lo, wide, out=planes[1])
        np.floor_divide(counts, 3, out=planes[3])
        np.subtract(counts, 3 * planes[3], out=planes[2])
    return scenes


NAMES = [f.split()[0] for f in OUT.split(", ")]


def micros(seconds: Iterable[float]) -> np.ndarray:
    return np.rint(np.array(seconds, np.float64) * 1e6).astype(np.int64)


Made = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def complete(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows that have a camera, a time and data."""
    for c in ("cam", "ts", "data"):
        if batch.column(c).null_count:
            batch = batch.filter(batch.column(c).is_valid())
    return batch


def by_camera(cams: Iterable[int], *columns: Iterable) -> dict[int, list[tuple]]:
    out: dict[int, list[tuple]] = {}
    for cam, *frame in zip(cams, *columns):
        out.setdefault(cam, []).append(tuple(frame))
    return out


def scaled_by_camera(batch: pa.RecordBatch, options: MotionOptions) -> dict[int, list[tuple]]:
    """Frames of each camera of a batch of frames as they are: microseconds, w, h, scaled_w, scaled_h, data."""
    ts, (ws, hs, data) = batch.column("ts").cast(pa.int64()).to_pylist(), (batch.column(k).to_pylist() for k in ("w", "h", "data"))
    times = {size: Layout.of(*size, options).scaled for size in {*zip(ws, hs)}}
    frames = [(t, w, h, *scaled(w, h, d, times[w, h])) for t, w, h, d in zip(ts, ws, hs, data)]
    return by_camera(batch.column("cam").to_pylist(), *zip(*frames)) if frames else {}


class MotionProcessor(StatefulProcessor):
    """Frames of a group of cameras, one after another for each; see the module for what its state holds."""

    def __init__(self, options: MotionOptions, made: Made | None = None, schema: pa.Schema | None = None):
        self.options, self.made, self.schema = options, made, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        keep_memory()
        self.handle = handle
        self.state = handle.getValueState("scenes", STATE)

    def close(self) -> None:
        pass

    def _load(self) -> dict[int, Scene]:
        row = self.state.get()
        return restored(pa.decompress(bytes(row[1]), row[0], "zstd", asbytes=True), self.options) if row else {}

    def _save(self, scenes: dict[int, Scene]) -> None:
        data = kept(scenes)
        self.state.update((len(data), pa.compress(data, "zstd", asbytes=True)))

    def _ends(self, s: Scene) -> int:
        """Milliseconds after which the camera's objects leave."""
        return math.ceil(1000 * (s.back.last + self.options.remove_time))

    @staticmethod
    def _frame(out: dict[int, list[tuple]]) -> pd.DataFrame:
        rows = [r for own in out.values() for r in own]
        kind, ts, *numbers = zip(*rows)
        frame = {"cam": np.repeat(list(out), [len(own) for own in out.values()]), "ts": pd.DatetimeIndex(micros(ts).astype("datetime64[us]")).tz_localize("UTC"), "kind": np.array(kind, object)}
        for c, v in zip(NAMES[3:], numbers):
            none = np.array([x is None for x in v])
            frame[c] = pd.arrays.IntegerArray(np.array([x or 0 for x in v], np.int64), none)
        return pd.DataFrame(frame)

    def _frames(self, rows: pd.DataFrame) -> Iterator[dict[int, list[tuple]]]:
        """Frames of each camera, in order of time; where they are made, as many at once as are looked at."""
        cams, us = rows["cam" if self.made is None else f"c{self.schema.get_field_index('cam')}"].to_numpy(), rows["us"].to_numpy()
        order = np.lexsort((us, cams))
        if self.made is None:
            yield by_camera(*(rows[k].to_numpy()[order].tolist() for k in ("cam", "us", "w", "h", "scaled_w", "scaled_h", "data")))
            return
        first = np.flatnonzero(np.diff(cams[order], prepend=cams[order[0]] - 1))
        piece = (np.arange(len(order)) - np.repeat(first, np.diff(first, append=len(order)))) // AT_ONCE
        order, most = order[np.argsort(piece, kind="stable")], AT_ONCE << GROUPED
        columns = [pa.array(us, f.type) if f.name == "ts" else pa.Array.from_pandas(rows[f"c{k}"], type=f.type) for k, f in enumerate(self.schema)]
        whole = pa.RecordBatch.from_arrays(columns, schema=self.schema).take(pa.array(order))
        batches = (whole.slice(k, most) for k in range(0, len(order), most))
        for batch in map(complete, self.made(batches)):
            yield scaled_by_camera(batch, self.options)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        scenes, some = self._load(), False
        for frames in self._frames(pd.concat(list(rows))):
            out = {cam: own for cam, own in through(scenes, self.options, frames, self.made is None).items() if own}
            some = some or bool(frames)
            if out:
                yield self._frame(out)
        if some:
            self._save(scenes)
            old, new = set(self.handle.listTimers()), {self._ends(s) for s in scenes.values() if s.objects}
            for ms in old - new:
                self.handle.deleteTimer(ms)
            for ms in new - old:
                self.handle.registerTimer(ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        scenes, now = self._load(), expiredTimerInfo.getExpiryTimeInMs()
        left = {cam: s for cam, s in scenes.items() if s.objects and self._ends(s) <= now}
        out = {cam: own for cam, s in left.items() if (own := s.expire(s.back.last + self.options.remove_time))}
        if left:
            self._save(scenes)
        if out:
            yield self._frame(out)


def scaled(w: int, h: int, data: bytes, times: int) -> tuple[int, int, bytes]:
    """A frame at half the size so many times: width, height, pixels."""
    if times == 0:
        return w, h, data
    plane = np.frombuffer(data, np.uint8).reshape(h, w)
    for _ in range(times):
        plane = halved(plane)
    return plane.shape[1], plane.shape[0], plane.tobytes()


def scaled_frames(frames: DataFrame, options: MotionOptions) -> DataFrame:
    """cam, ts, w, h, scaled_w, scaled_h, data: frames at the size that detection starts from, compressed, so that the shuffle and its sort hold a fifth or less; no shuffle."""

    def run(batches):
        for batch in batches:
            rows = []
            for w, h, data in zip(batch.column("w").to_pylist(), batch.column("h").to_pylist(), batch.column("data").to_pylist()):
                sw, sh, data = scaled(w, h, data, Layout.of(w, h, options).scaled)  # noqa: PLW2901
                rows.append((sw, sh, pa.compress(data, "lz4_raw", asbytes=True) if data else b""))
            sw, sh, data = zip(*rows) if rows else ((), (), ())
            columns = [*(batch.column(c) for c in ("cam", "ts", "w", "h")), pa.array(sw, pa.int32()), pa.array(sh, pa.int32()), pa.array(data, pa.binary())]
            yield pa.record_batch(columns, ["cam", "ts", "w", "h", "scaled_w", "scaled_h", "data"])

    return frames.select("cam", "ts", "w", "h", "data").mapInArrow(run, "cam long, ts timestamp, w int, h int, scaled_w int, scaled_h int, data binary")


def in_order(frames: DataFrame, options: MotionOptions, made: Made | None = None) -> DataFrame:
    """Rows of frames, scaled and compressed or as they are, whose partitions hold whole cameras, each in order of time: a task reads one after another and holds the state of one."""
    packed = made is None and "scaled_w" in frames.columns

    def run(batches):
        keep_memory()
        batches = map(complete, made(batches)) if made else batches
        scenes: dict[int, Scene] = {}
        for batch in batches:
            if packed:
                frames = by_camera(*(batch.column(k).cast(pa.int64()).to_pylist() if k == "ts" else batch.column(k).to_pylist() for k in ("cam", "ts", "w", "h", "scaled_w", "scaled_h", "data")))
            else:
                frames = scaled_by_camera(batch, options)
            of, rows = [], []
            for cam, own in frames.items():
                if cam not in scenes:
                    scenes = {}
                new = through(scenes, options, {cam: own}, packed)[cam]
                of += [cam] * len(new)
                rows += new
            if rows:
                kind, ts, *numbers = zip(*rows)
                columns = [pa.array(of, pa.int64()), pa.array(micros(ts), pa.timestamp("us", "UTC")), pa.array(kind), *(pa.array(v, pa.int64()) for v in numbers)]
                yield pa.record_batch(columns, NAMES)

    return frames.mapInArrow(run, OUT)


def motion(frames: DataFrame, options: MotionOptions | None = None, late: str = "0 seconds", ordered: bool = False, made: Made | None = None) -> DataFrame:
    """Rows (cam, ts, kind, id, l, t, r, b, x, y, n_places) of a stream or table of gray frames (cam, ts, w, h, data).

    kind: `in` and `out` of a numbered object, `sabotage on` and `sabotage off` of a
    camera, `object` for each numbered object after each frame, its last frame
    included; x, y is where its region was seen last.  Frames of a camera are taken
    in order of time; those that are not newer than its last one are left out.
    Frames of another size start the camera anew.  Rows with a null camera, time or
    data go.  A table's
    cameras are read in order of time after one shuffle and sort, without either if
    the table is `ordered`: each partition holds whole cameras, sorted by cam and ts.
    Then frames may be `made` of its rows, batch by batch and in their order, where
    they are read, so that pixels never leave their task.  So may those of a stream
    whose rows have cam and ts: rows are shuffled, and a camera's rows of a
    micro-batch reach `made` in order of time (whole numbers beside nulls as pandas holds them).
    A stream's cameras have typed state, for which the state store is set to RocksDB.
    """
    options = options or MotionOptions()
    spark = frames.sparkSession
    if made is not None and not frames.isStreaming:
        if not ordered:
            raise ValueError("frames are made of the rows of an ordered table or of a stream")
        return in_order(frames, options, made)
    frames = frames.where("cam is not null and ts is not null" + (" and data is not null" if made is None else ""))
    if ordered and not frames.isStreaming:
        return in_order(frames.select("cam", "ts", "w", "h", "data"), options)
    schema = to_arrow_schema(frames.schema) if made is not None else None
    frames = frames if made is not None else scaled_frames(frames, options)
    if not frames.isStreaming:
        return in_order(frames.repartition("cam").sortWithinPartitions("cam", "ts"), options)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    assert spark.streams is not None  # starts the coordinator that state needs
    group = F.col("cam") if made is None else F.shiftright("cam", GROUPED)
    columns = ["*"] if made is None else [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(frames.columns)]  # pandas' rows rename what is no name in Python
    frames = frames.withWatermark("ts", late).select(*columns, group.alias("group"), F.unix_micros("ts").alias("us"))
    return frames.groupBy("group").transformWithStateInPandas(MotionProcessor(options, made, schema), OUT, "Append", "EventTime")
