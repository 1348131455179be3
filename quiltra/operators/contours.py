"""Contours as polylines: the edge pixels of an image meet once and are walked.

A walk goes from pixel to pixel of strong metric; the tasks that walk hold the
edge pixels of one image at a time.  Anchors start walks in the order of their
strength; pixels that a walk has taken stop later ones.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import shr
from ..model import neighbourhood
from .stencil import contour_metric

KEY = ["img", "y", "x"]
UP, DOWN, RIGHT, LEFT = range(4)


def edge_pixels(planes: DataFrame, value: str, gradient: int, anchor: int, interval: int, mask: str | None = None, index: int = 3) -> DataFrame:
    """img, y, x, m, up, down, right, left, strength of pixels inside the frame whose metric is strong.

    m is twice the sum of both gradients, plus 1 where the vertical one is the
    greater; 0 where `mask` is below `index`.  up .. left are the sideways steps of a walk in
    that direction.  strength is that of an anchor, 0 for others: a metric that tops
    both neighbours across its edge by `anchor`, on every `interval`-th row and column.
    """
    n = neighbourhood(planes.select(*KEY, value, *([mask] if mask else [])), value, 1)
    metric = contour_metric()
    if mask:
        metric = F.when(F.col(mask) >= index, metric).otherwise(0)
    size = Window.partitionBy("img")
    inner = (F.col("x") > 0) & (F.col("y") > 0) & (F.col("x") < F.max("x").over(size)) & (F.col("y") < F.max("y").over(size))
    n = neighbourhood(n.select(*KEY, metric.alias("m"), inner.alias("inner")), "m", 1)
    at = lambda dy, dx: F.col(f"n{1 + dy}{1 + dx}").bitwiseOR(F.lit(1))

    def side(first: tuple, middle: tuple, second: tuple, one: int) -> Column:
        tops = lambda a, b: (at(*a) > at(*middle)) & (at(*a) > at(*b))
        return F.when(tops(first, second), one).when(tops(second, first), -one).otherwise(0)

    steps = {"up": side((-1, -1), (-1, 0), (-1, 1), -1), "down": side((1, 1), (1, 0), (1, -1), 1), "right": side((-1, 1), (0, 1), (1, 1), -1), "left": side((-1, -1), (0, -1), (1, -1), -1)}
    half = lambda k: shr(F.col(k), 1)
    across = F.col("m") % 2 == 1
    one, two = F.when(across, half("n12")).otherwise(half("n21")), F.when(across, half("n10")).otherwise(half("n01"))
    grid = ((F.col("y") - 1) % interval == 0) & ((F.col("x") - 1) % interval == 0)
    top = grid & (half("m") > 0) & (half("m") - one >= anchor) & (half("m") - two >= anchor)
    out = n.where(F.col("inner") & (F.col("m") >= 2 * gradient))
    return out.select(*KEY, "m", *[v.cast("int").alias(k) for k, v in steps.items()], F.when(top, half("m")).otherwise(0).alias("strength"))


def walked(group: pd.DataFrame, shortest: int) -> list[tuple]:
    """Polylines (anchor's strength, y, x, number at that anchor, points) of an image's edge pixels, in order of their anchors."""
    pixels = {(y, x): (m & 1, steps) for y, x, m, *steps in zip(*(group[k].tolist() for k in ("y", "x", "m", "up", "down", "right", "left")))}
    anchors = sorted(((-s, y, x) for y, x, s in zip(group["y"].tolist(), group["x"].tolist(), group["strength"].tolist()) if s > 0))
    free, out = set(pixels), []
    for strength, ay, ax in anchors:
        line, lines, todo = [], [], [(ay, ax, None)]
        while todo:
            y, x, way = todo.pop()
            if way is not None:
                sideways = way >= RIGHT
                while (y, x) in pixels and pixels[y, x][0] == sideways:
                    if (y, x) in free:
                        free.discard((y, x))
                        if line and max(abs(line[-1][0] - y), abs(line[-1][1] - x)) > 1:
                            lines.append(line)
                            line = []
                        line.append((y, x))
                    aside, ahead = pixels[y, x][1][way], 1 if way in (DOWN, RIGHT) else -1
                    y, x = (y + aside, x + ahead) if sideways else (y + ahead, x + aside)
                    if (y, x) not in free:
                        break
            if (y, x) in free:  # the edge turns here, or a walk begins
                todo += [(y, x, LEFT), (y, x, RIGHT)] if pixels[y, x][0] else [(y, x, DOWN), (y, x, UP)]
        lines.append(line)
        out += [(-strength, ay, ax, k, points) for k, points in enumerate(p for p in lines if len(p) > shortest)]
    return out


def contours(planes: DataFrame, value: str = "v", gradient: int = 40, anchor: int = 0, interval: int = 2, shortest: int = 2, mask: str | None = None, index: int = 3) -> DataFrame:
    """img, contour, position, y, x: polylines of more than `shortest` points, numbered in an image by the strength of their anchors.

    Ties go to the upper, then to the left anchor.  Images without strong pixels
    have no rows.  Needs one row for each pixel; the edge pixels of an image are
    held by one task, as a packed plane is.
    """
    edges = edge_pixels(planes, value, gradient, anchor, interval, mask, index)

    def walk(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        lines = [points for *_, points in walked(group, shortest)]
        rows = [(key[0], n, k, y, x) for n, points in enumerate(lines) for k, (y, x) in enumerate(points)]
        return pd.DataFrame(rows, columns=["img", "contour", "position", "y", "x"])

    kind = edges.schema["img"].dataType.simpleString()
    return edges.groupBy("img").applyInPandas(walk, f"img {kind}, contour long, position long, y long, x long")
