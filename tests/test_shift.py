"""Shifts against a search that is written out pixel by pixel."""

import math
import random

import pytest

from quiltra.operators.shift import ShiftOptions, refined, shifts, stability
from quiltra.plans import cameras

H, W = 48, 64


def background(seed):
    rng = random.Random(seed)
    waves = [(rng.uniform(0.1, 0.35), rng.uniform(0.1, 0.35), rng.uniform(0, 6), rng.uniform(10, 30)) for _ in range(5)]
    return [[max(0, min(255, int(128 + sum(a * math.sin(x * p + y * q + f) for p, q, f, a in waves)))) for x in range(W)] for y in range(H)]


def plain(back, front, x0, y0, o):
    ph, pw = len(front), len(front[0])

    def grad(p):
        h, w = len(p), len(p[0])
        return [[min(255, abs(p[y][x + 1] - p[y][x - 1]) + abs(p[y + 1][x] - p[y - 1][x])) if 0 < y < h - 1 and 0 < x < w - 1 else 0 for x in range(w)] for y in range(h)]

    def half(p):
        h, w = len(p), len(p[0])
        at = lambda y, x: p[min(y, h - 1)][min(x, w - 1)]
        return [[(at(2 * y, 2 * x) + at(2 * y, 2 * x + 1) + at(2 * y + 1, 2 * x) + at(2 * y + 1, 2 * x + 1) + 2) // 4 for x in range((w + 1) // 2)] for y in range((h + 1) // 2)]

    if o.gradients:
        back, front = grad(back), grad(front)
    own = [[front[y - y0][x - x0] if y0 <= y < y0 + ph and x0 <= x < x0 + pw else 0 for x in range(W)] for y in range(H)]
    levels = [(back, own)]
    regions = [(x0, y0, x0 + pw, y0 + ph)]
    for _ in range(o.levels - 1):
        levels.append(tuple(half(p) for p in levels[-1]))
        regions.append(tuple(v // 2 for v in regions[-1]))
    areas = [(r - l) * (b - t) for l, t, r, b in regions]
    n = max(k + 1 for k in range(o.levels) if areas[k] >= o.area_min)
    sx = sy = 0
    for k in range(n - 1, -1, -1):
        (bg, fg), (l, t, r, b) = levels[k], regions[k]
        h, w = len(bg), len(bg[0])
        table = {}
        most = [max(v // 2**k + 1, 2) for v in (o.max_x, o.max_y)]
        reach = most if k == n - 1 else [3, 3]
        start = best = (2 * sx, 2 * sy)
        for stage in range(max(reach)):
            middle = best
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    s = middle[0] + dx, middle[1] + dy
                    if abs(s[0]) > most[0] or abs(s[1]) > most[1]:
                        return None
                    if s not in table:
                        cells = [(y, x) for y in range(t, b) for x in range(l, r) if 0 <= y + s[1] < h and 0 <= x + s[0] < w]
                        if 2 * len(cells) < areas[k]:
                            return None
                        apart = [abs(bg[y + s[1]][x + s[0]] - fg[y][x]) for y, x in cells]
                        table[s] = sum(d * d if o.squared else d for d in apart) / len(cells) * (1 + (areas[k] - len(cells)) * o.penalty / areas[k])
                    if table[s] < table.get(best, math.inf) or best not in table:
                        best = s
            if best == middle:
                break
        else:
            return None
        sx, sy = best
    return sx, sy, 1 - (math.sqrt(table[best]) if o.squared else table[best]) / 255, table, start


OPTIONS = [ShiftOptions(levels=3, max_x=12, max_y=12), ShiftOptions(levels=3, max_x=12, max_y=12, penalty=0.7, squared=True), ShiftOptions(levels=1, max_x=9, max_y=9, penalty=0.2), ShiftOptions(levels=4, max_x=3, max_y=30, gradients=True, area_min=40)]


@pytest.mark.parametrize("o", OPTIONS)
def test_shifts_are_those_of_the_plain_search(spark, o):
    rng = random.Random(8)
    rows, want = [], {}
    for k in range(16):
        back = background(k)
        x0, y0, pw, ph = rng.choice([0, 4, 13, 20]), rng.choice([0, 4, 9, 16]), rng.randint(20, 40), rng.randint(18, 28)
        dx, dy = rng.randint(-9, 9), rng.randint(-7, 7)
        front = [[min(255, back[min(max(y0 + y + dy, 0), H - 1)][min(max(x0 + x + dx, 0), W - 1)] + rng.randrange(3)) for x in range(pw)] for y in range(ph)]
        rows.append((k, W, H, bytes(v for r in back for v in r), pw, ph, bytes(v for r in front for v in r), x0, y0))
        want[k] = plain(back, front, x0, y0, o)
    rows += [(90, W, H, None, 1, 1, b"x", 0, 0), (91, W, H, bytes(W * H), 1, 1, None, 0, 0), (92, W, H, bytes(W * H), 9, 9, bytes(81), W - 3, 0), (93, W, H, bytes(W * H), 2, 2, bytes(4), 0, 0)]
    df = spark.createDataFrame(rows, "img long, w int, h int, background binary, pw int, ph int, picture binary, x0 int, y0 int").repartition(3)
    got = {r.img: r for r in shifts(df, o).collect()}
    assert not any(got[k].found or got[k].dx is not None for k in (90, 91, 92, 93))
    found = {k for k, v in want.items() if v}
    assert {k for k in want if got[k].found} == found and len(found) >= 3
    for k in found:
        dx, dy, correlation, table, start = want[k]
        assert (got[k].dx, got[k].dy) == (dx, dy) and got[k].correlation == pytest.approx(correlation)
        z = [[table.get((dx + i, dy + j)) for i in (-1, 0, 1)] for j in (-1, 0, 1)]
        if max(abs(dx - start[0]), abs(dy - start[1])) < 3:
            a, m, b = (sum(row[i] for row in z) / 3 for i in range(3))
            assert got[k].fine_dx == pytest.approx(dx + (a - b) / 2 / (a + b - 2 * m))
            a, m, b = (sum(row) / 3 for row in z)
            assert got[k].fine_dy == pytest.approx(dy + (a - b) / 2 / (a + b - 2 * m))


def test_fractions_and_stability():
    import numpy as np

    y, x = np.mgrid[-1:2, -1:2].astype(float)
    bowl = lambda fx, fy: 3 + (x - fx) ** 2 + (y - fy) ** 2
    for fx, fy in ((0.0, 0.0), (0.3, -0.2), (-0.4, 0.1), (-0.1, -0.45)):
        assert refined(bowl(fx, fy)) == pytest.approx((fx, fy))
        assert 0 < stability(bowl(fx, fy)) < 1
        assert stability(bowl(fx, fy)) == pytest.approx(stability(bowl(-fx, fy))) == pytest.approx(stability(bowl(fx, -fy)))
    assert stability(bowl(0.9, 0.0)) == 0 == stability(None) and refined(None) == (-1, -1)
    assert stability(np.zeros((3, 3))) == 0
    # five neighbours that face away: here the upper row and the left column
    z = np.array([[9.0, 8, 7], [8, 1, 2], [7, 2, 3]])
    fx, fy = refined(z)
    least = (1 - fx) * (1 - fy) * 1 + fx * fy * 3 + (1 - fx) * fy * 2 + fx * (1 - fy) * 2
    assert fx > 0 and fy > 0 and stability(z) == pytest.approx((39 / 5 - least) / (39 / 5))


def test_the_queries_find_the_shifts(spark):
    for name in ("shift_detector_levels", "shift_detector_levels_squared", "shift_detector_levels_gradients"):
        got = cameras.QUERIES[name](spark, "/root/testdata/sf0.01").collect()
        assert len(got) == 10
        right = [r for r in got if r.found and (r.dx, r.dy) == (r.img % 7 - 3, r.img % 5 - 2)]
        assert len(right) >= 7 and all(r.correlation > 0.98 for r in right)
