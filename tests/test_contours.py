"""Contours against one walk over the whole image."""

import math
import random

import pytest

from quiltra.operators.contours import contours

H, W = 40, 52


def scene(kind):
    rng = random.Random(4)
    if kind == "spiral":  # one very long edge
        angle = lambda y, x: math.atan2(y - H / 2, x - W / 2)
        return [[int(128 + 120 * math.sin(math.hypot(y - H / 2, x - W / 2) - angle(y, x))) for x in range(W)] for y in range(H)]
    if kind == "boxes":
        boxes = [(rng.randrange(H - 8), rng.randrange(W - 8), rng.randint(4, 14), rng.randint(4, 14), rng.randrange(60, 255)) for _ in range(7)]
        return [[max([20] + [v for t, l, h, w, v in boxes if t <= y < t + h and l <= x < l + w]) for x in range(W)] for y in range(H)]
    return [[rng.randrange(256) if kind == "noise" else 77 for _ in range(W)] for _ in range(H)]


def plain(p, gradient, anchor, interval, shortest, mask=None, index=3):
    """Polylines in order of their anchors: recursive walk over one image, pixels taken as it goes."""
    at = lambda y, x: p[min(max(y, 0), H - 1)][min(max(x, 0), W - 1)]

    def metric(y, x):
        if mask and mask[y][x] < index:
            return 0
        dx = abs(at(y - 1, x + 1) + 2 * at(y, x + 1) + at(y + 1, x + 1) - at(y - 1, x - 1) - 2 * at(y, x - 1) - at(y + 1, x - 1))
        dy = abs(at(y + 1, x - 1) + 2 * at(y + 1, x) + at(y + 1, x + 1) - at(y - 1, x - 1) - 2 * at(y - 1, x) - at(y - 1, x + 1))
        return 2 * (dx + dy) + (0 if dx >= dy else 1)

    m = [[metric(y, x) for x in range(W)] for y in range(H)]
    taken = [[y in (0, H - 1) or x in (0, W - 1) for x in range(W)] for y in range(H)]
    out = []
    line = []
    odd = lambda c: m[c[0]][c[1]] | 1
    tops = lambda a, b, c: odd(a) > odd(b) and odd(a) > odd(c)

    def route(y, x, way):
        if way:
            while m[y][x] >= 2 * gradient and m[y][x] % 2 == (way in "LR"):
                if not taken[y][x]:
                    taken[y][x] = True
                    if line and (abs(line[-1][0] - y) > 1 or abs(line[-1][1] - x) > 1):
                        if len(line) > shortest:
                            out.append(list(line))
                        line.clear()
                    line.append((y, x))
                a, b, c = {"L": ((y - 1, x - 1), (y, x - 1), (y + 1, x - 1)), "R": ((y - 1, x + 1), (y, x + 1), (y + 1, x + 1)), "U": ((y - 1, x - 1), (y - 1, x), (y - 1, x + 1)), "D": ((y + 1, x + 1), (y + 1, x), (y + 1, x - 1))}[way]
                y, x = a if tops(a, b, c) else c if tops(c, b, a) else b
                if taken[y][x]:
                    break
        if taken[y][x] or m[y][x] < 2 * gradient:
            return
        for w in "UD" if m[y][x] % 2 == 0 else "RL":
            route(y, x, w)

    anchors = []
    for y in range(1, H - 1, interval):
        for x in range(1, W - 1, interval):
            s = m[y][x] // 2
            one, two = ((y, x + 1), (y, x - 1)) if m[y][x] % 2 else ((y + 1, x), (y - 1, x))
            if s > 0 and s - m[one[0]][one[1]] // 2 >= anchor and s - m[two[0]][two[1]] // 2 >= anchor:
                anchors.append((-s, y, x))
    for _, y, x in sorted(anchors):
        line.clear()
        route(y, x, None)
        if len(line) > shortest:
            out.append(list(line))
    return out


@pytest.mark.parametrize("gradient, anchor, interval, shortest", [(40, 0, 2, 2), (300, 5, 1, 0), (520, 0, 3, 4)])
def test_contours_are_those_of_one_walk(spark, gradient, anchor, interval, shortest):
    scenes = {k: scene(name) for k, name in enumerate(("spiral", "boxes", "noise", "flat"))}
    df = spark.createDataFrame([(k, y, x, v) for k, p in scenes.items() for y, row in enumerate(p) for x, v in enumerate(row)], "img long, y long, x long, v long")
    got = sorted((r.img, r.contour, r.position, r.y, r.x) for r in contours(df, "v", gradient, anchor, interval, shortest).collect())
    want = [(k, n, i, y, x) for k, p in scenes.items() for n, line in enumerate(plain(p, gradient, anchor, interval, shortest)) for i, (y, x) in enumerate(line)]
    assert got == sorted(want)
    assert gradient > 40 or max(w[2] for w in want if w[0] == 0) > 60


def test_masks_and_empty_tables(spark):
    p = scene("boxes")
    mask = [[4 if x > 20 else 1 for x in range(W)] for _ in range(H)]
    df = spark.createDataFrame([(5, y, x, v, mask[y][x]) for y, row in enumerate(p) for x, v in enumerate(row)], "img long, y long, x long, v long, k long")
    got = sorted((r.contour, r.position, r.y, r.x) for r in contours(df, "v", mask="k").collect())
    assert got == sorted((n, i, y, x) for n, line in enumerate(plain(p, 40, 0, 2, 2, mask)) for i, (y, x) in enumerate(line)) and got
    assert contours(df.limit(0), "v").count() == 0


def test_pixels_of_an_image_meet_without_rounds_of_labels(spark):
    df = spark.createDataFrame([(1, y, x, v) for y, row in enumerate(scene("boxes")) for x, v in enumerate(row)], "img long, y long, x long, v long")
    plan = contours(df, "v")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "ExistingRDD" not in plan.split("FlatMapGroupsInPandas")[0] and plan.count("FlatMapGroupsInPandas") == 1
