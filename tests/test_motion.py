"""Motion detection against a pixel-by-pixel detector, by stream and by table."""

import glob
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiltra.plans import cameras
from quiltra.streaming.motion import Layout, MotionOptions, Scene, advance, grown, inside, kept, motion, pools, regions, restored, scaled_frames, through
from quiltra.streaming.run import micro_batches, replayed, shared_folder

ROUND = lambda v: int(v + 0.5)


def reduce4(p):
    h, w = len(p), len(p[0])
    at = lambda y, x: p[min(max(y, 0), h - 1)][min(max(x, 0), w - 1)]
    taps = (1, 3, 3, 1)
    return [[(sum(taps[i] * taps[j] * at(2 * y - 1 + i, 2 * x - 1 + j) for i in range(4) for j in range(4)) + 32) >> 6 for x in range((w + 1) // 2)] for y in range((h + 1) // 2)]


def grads(p):
    h, w = len(p), len(p[0])
    cut = lambda v: (16 + max(-16, min(16, v))) * 4
    inner = lambda y, x: 0 < y < h - 1 and 0 < x < w - 1
    return [[[cut(p[y][x + 1] - p[y][x - 1]) if inner(y, x) else 0 for x in range(w)] for y in range(h)], [[cut(p[y + 1][x] - p[y - 1][x]) if inner(y, x) else 0 for x in range(w)] for y in range(h)]]


class Plain:
    """One camera of three levels without region of interest, pixel by pixel; events and objects as tuples."""

    def __init__(self, h, w, area):
        self.h, self.w, self.area = h, w, area
        self.bg, self.state, self.unstable, self.sabotaged = {}, "init", False, 0
        self.stat = self.upd = self.n_upd = 0
        self.last, self.objects, self.next_id = None, [], 0

    def frame(self, plane, now):
        out = []
        if self.objects and self.last is not None and self.last + 1.0 <= now:
            out += [("out", self.last + 1.0, *o["row"]()) for o in self.objects if o["id"] is not None]
            self.objects = []
        levels = [plane, reduce4(plane)]
        levels.append(reduce4(levels[1]))
        feats = {(k, f): v for k, p in enumerate(levels) for f, v in enumerate([p, *grads(p)])}
        cells = [(k, f, y, x, v) for (k, f), p in feats.items() for y, row in enumerate(p) for x, v in enumerate(row)]
        diff = [[[0] * len(p[0]) for _ in p] for p in levels]
        if self.bg:
            for k, f, y, x, v in cells:
                lo, hi, _, _ = self.bg[k, f, y, x]
                d = max(0, v - hi, lo - v)
                diff[k][y][x] = min(255, diff[k][y][x] + (d * d * 18 * 256 >> 16))
        else:
            for k, f, y, x, v in cells:
                d = v  # against a background of zeros
                diff[k][y][x] = min(255, diff[k][y][x] + (d * d * 18 * 256 >> 16))
        for k in (1, 2):
            down = reduce4(diff[k - 1])
            diff[k] = [[max(a, b) for a, b in zip(r, s)] for r, s in zip(diff[k], down)]
        found, covered = self.segment(diff)
        if self.state != "init":
            bad = covered >= self.h * self.w * 0.5
            if bad != self.unstable:
                out.append(("sabotage on" if bad else "sabotage off", now))
            self.unstable = bad
        gone = self.track(found, now) if self.state == "update" else self.objects
        if self.state != "update":
            self.objects = []
        gone = [o for o in gone if o["id"] is not None]
        out += [("out", now, *o["row"]()) for o in gone]
        far = int((self.h**2 + self.w**2) * 0.075 * 0.075)
        for o in self.objects:
            x, y = o["places"][-1][1:3]
            if o["id"] is None and now - o["start"][0] >= 1.0 and (x - o["start"][1]) ** 2 + (y - o["start"][2]) ** 2 >= far:
                o["id"] = self.next_id
                self.next_id += 1
                out.append(("in", now, *o["row"]()))
        self.background(cells, now)
        return out + [("object", now, *o["row"]()) for o in [*self.objects, *gone] if o["id"] is not None]

    def segment(self, diff):
        sizes = [(len(d), len(d[0])) for d in diff]
        mask = [{} for _ in diff]
        h, w = sizes[2]
        at = lambda k, y, x: mask[k].get((y, x), 2 if k == 2 and (y in (0, h - 1) or x in (0, w - 1)) else 0)
        found, index = [], 3
        for y in range(1, h - 1):
            for x in range(1, w - 1):
                if diff[2][y][x] <= 127 or at(2, y, x) != 0:
                    continue
                todo, cells = [(y, x)], set()
                while todo:
                    c = todo.pop()
                    if c in cells:
                        continue
                    cells.add(c)
                    for n in ((c[0] - 1, c[1]), (c[0] + 1, c[1]), (c[0], c[1] - 1), (c[0], c[1] + 1)):
                        if diff[2][n[0]][n[1]] > 95 and at(2, *n) == 0:
                            todo.append(n)
                ys, xs = [c[0] for c in cells], [c[1] for c in cells]
                rect = (min(xs), min(ys), max(xs) + 1, max(ys) + 1)
                ok = (rect[2] - rect[0]) * (rect[3] - rect[1]) > self.area
                for c in cells:
                    mask[2][c] = index if ok else 2
                path = [(2, rect)]
                for k in (1, 0) if ok else ():
                    l, t, r, b = rect
                    for py in range(t, b):
                        for px in range(l, r):
                            around = [at(k + 1, py + i, px + j) == index for i in (0, 1) for j in (0, 1)]
                            for cy in (2 * py + 1, 2 * py + 2):
                                for cx in (2 * px + 1, 2 * px + 2):
                                    if at(k, cy, cx) < 2:
                                        mask[k][cy, cx] = index if all(around) or any(around) and diff[k][cy][cx] > 95 else 0
                    ch, cw = sizes[k]
                    box = (max(2 * l - 2, 1), max(2 * t - 2, 1), min(2 * r + 2, cw - 1), min(2 * b + 2, ch - 1))
                    own = [(cy, cx) for cy in range(box[1], box[3]) for cx in range(box[0], box[2]) if at(k, cy, cx) == index]
                    if not own:
                        ok = False
                        for level, (l, t, r, b) in path:
                            for c, v in list(mask[level].items()):
                                if v == index and t <= c[0] < b and l <= c[1] < r:
                                    mask[level][c] = 2
                        break
                    ys, xs = [c[0] for c in own], [c[1] for c in own]
                    rect = (max(min(xs) - 1, 1), max(min(ys) - 1, 1), min(max(xs) + 2, cw - 1), min(max(ys) + 2, ch - 1))
                    path.append((k, rect))
                if ok:
                    found.append(rect)
                    index += 1
        return found, sum(v >= 3 for v in mask[0].values())

    def track(self, found, now):
        mid = lambda r: (ROUND((r[0] + r[2]) / 2), ROUND((r[1] + r[3]) / 2))
        has = lambda r, c: r[0] <= c[0] < r[2] and r[1] <= c[1] < r[3]
        d2 = lambda a, b: (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2
        gone = [o for o in self.objects if now - o["places"][-1][0] >= 1.0]
        self.objects = [o for o in self.objects if now - o["places"][-1][0] < 1.0]
        near, used = [], set()
        for r in found:
            best = None
            for o in self.objects:
                if best is None or d2(o["at"], mid(r)) < d2(best["at"], mid(r)):
                    best = o
            near.append(best)
        for o in self.objects:
            best = None
            for k, r in enumerate(found):
                if near[k] is o and (has(r, o["at"]) or has(o["rect"], mid(r))) and (best is None or d2(o["at"], mid(r)) < d2(o["at"], mid(found[best]))):
                    best = k
            if best is not None:
                r = found[best]
                used.add(best)
                o["places"].append((now, *mid(r), r))
                last = [p[3] for p in o["places"][-12:]]
                mean = [sum(q[i] for q in last) // len(last) for i in range(4)]
                dx, dy = mid(r)[0] - mid(mean)[0], mid(r)[1] - mid(mean)[1]
                o["rect"] = (max(mean[0] + dx, 0), max(mean[1] + dy, 0), min(mean[2] + dx, self.w), min(mean[3] + dy, self.h))
                o["at"] = mid(r)
        for k, r in enumerate(found):
            if k not in used and not any(has(o["rect"], mid(r)) for o in self.objects):
                o = {"at": mid(r), "rect": r, "start": (now, *mid(r)), "id": None, "places": [(now, *mid(r), r)]}
                o["row"] = lambda o=o: (o["id"], *o["rect"], *o["places"][-1][1:3], len(o["places"]))
                self.objects.append(o)
        return gone

    def background(self, cells, now):
        restart = self.state == "init" or self.state == "grow" and self.unstable
        if self.state == "update":
            if self.unstable:
                self.sabotaged += 1
                restart = self.sabotaged > 3
            else:
                self.sabotaged = 0
                self.stat += now - self.last
                self.upd += now - self.last
                if self.stat > 0.04:
                    self.stat, self.n_upd = 0, self.n_upd + 1
                    for k, f, y, x, v in cells:
                        c = self.bg[k, f, y, x]
                        c[2] += v < c[0]
                        c[3] += v > c[1]
                    if self.upd > 1.0 and self.n_upd >= 8:
                        self.upd = self.n_upd = 0
                        for c in self.bg.values():
                            c[0] = max(0, min(255, c[0] + (-1 if c[2] > 1 else 1 if c[2] < 1 else 0)))
                            c[1] = max(0, min(255, c[1] + (1 if c[3] > 1 else -1 if c[3] < 1 else 0)))
                            c[2] = c[3] = 0
        elif not restart:
            for k, f, y, x, v in cells:
                c = self.bg[k, f, y, x]
                c[0], c[1] = min(c[0], v), max(c[1], v)
            if self.grow_end < now:
                self.state, self.n_upd = "update", 0
        if restart:
            self.bg = {(k, f, y, x): [v, v, 0, 0] for k, f, y, x, v in cells}
            self.state, self.grow_end, self.stat, self.upd, self.n_upd = "grow", now + 1.0, 0, 0, 0
        self.last = now


H, W = 33, 46
OPTIONS = MotionOptions(object_width=0.4, object_height=0.4, top_size=8, scale_levels=0)


def planes():
    """Frames of four cameras: one box, boxes that meet and part, silence and another light, nothing but noise."""
    rng, out = random.Random(9), []
    for cam in range(4):
        for k in range(70):
            if cam == 2 and 40 <= k < 55 or cam == 1 and k > 62:
                continue
            p = [[(x * 5 + y * 9) % 60 + 60 + rng.randrange(3) for x in range(W)] for y in range(H)]
            for box in ([(k // 2 - 4, 5)], [(k // 2 - 6, 4), (30 - k // 2, 14)], [(k // 2 - 6, 12)], [])[cam]:
                if 14 <= k < 64:
                    for y in range(box[1], box[1] + 12):
                        for x in range(max(box[0], 0), min(max(box[0] + 14, 0), W)):
                            p[y][x] = min(255, p[y][x] + 120)
            if cam == 2 and k >= 60:
                p = [[255 - v // 2 for v in row] for row in p]
            out.append((cam, k, p))
    return out


@pytest.fixture(scope="module")
def frames(spark):
    rows = [(cam, k, W, H, bytes(v for row in p for v in row)) for cam, k, p in planes()]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([*rows, (None, 1, W, H, b""), (1, None, W, H, b""), (1, 2, W, H, None)], "cam long, k long, w int, h int, data binary")
    return df.select("cam", F.timestamp_millis(F.col("k") * 100 + 10**12).alias("ts"), "w", "h", "data").repartition(5)


def told(df):
    return sorted(tuple(map(str, r)) for r in df.select("cam", F.unix_millis("ts") - 10**12, "kind", "id", "l", "t", "r", "b", "x", "y", "n_places").collect())


@pytest.fixture(scope="module")
def plain():
    assert Layout.of(W, H, OPTIONS) == Layout(0, ((33, 46), (17, 23), (9, 12)), 14)
    cams, out = {}, []
    for cam, k, p in planes():
        c = cams.setdefault(cam, Plain(H, W, 14))
        out += [(cam, round(1000 * r[1]) - 10**12, r[0], *(r[2:] or [None] * 8)) for r in c.frame(p, (10**12 + k * 100) / 1000)]
    return out, cams


def test_a_table_gives_what_the_plain_detector_gives(spark, frames, plain):
    rows, _ = plain
    kinds = [(r[0], r[2]) for r in rows]
    assert {(0, "in"), (0, "object"), (1, "in"), (2, "in"), (2, "out"), (2, "sabotage on"), (2, "sabotage off")} <= set(kinds) and 3 not in {k for k, _ in kinds}
    assert told(motion(frames, OPTIONS)) == sorted(tuple(map(str, r)) for r in rows)


@pytest.mark.parametrize("batches", [3, 9])
def test_a_stream_gives_the_table_s_rows_and_timers(spark, frames, plain, batches):
    rows, cams = plain
    # camera 1 ends early: its objects leave when the others' frames have moved the watermark on; the last frames of all hold no objects
    end = cams[1].last + 1.0
    assert cams[1].objects and end > (10**12 + 69 * 100) / 1000
    later = spark.createDataFrame([(9, 95, W, H, bytes(W * H))], "cam long, k long, w int, h int, data binary").select("cam", F.timestamp_millis(F.col("k") * 100 + 10**12).alias("ts"), "w", "h", "data")
    stream = micro_batches(frames.unionByName(later), "ts", batches)
    got = told(replayed(motion(stream, OPTIONS)))
    left = [(k, round(1000 * (c.last + 1.0)) - 10**12, "out", *o["row"]()) for k, c in cams.items() for o in c.objects if o["id"] is not None and c.last + 1.0 <= 10**9 + 9.5]
    assert left and got == sorted(tuple(map(str, r)) for r in rows + left)


def test_frames_are_scaled_and_masked():
    assert Layout.of(1920, 1080, MotionOptions()) == Layout(3, ((135, 240), (68, 120), (34, 60)), 5)
    assert Layout.of(20, 20, MotionOptions()).sizes == ((20, 20),)
    half = inside([(0, 0), (0.5, 0), (0.5, 1), (0, 1)], (4, 6))
    assert np.array_equal(half, np.repeat([[255, 255, 255, 0, 0, 0]], 4, 0)) and inside([], (2, 2)).min() == 255


def test_other_sizes_and_a_region_of_interest(spark):
    rows = [(1, k, 40, 40, bytes([90 + (60 if 20 <= x < 34 and 10 <= y < 24 and k == 12 else 0) for y in range(40) for x in range(40)])) for k in range(14)]
    rows += [(1, 20 + k, 8, 8, bytes(64)) for k in range(3)]
    df = spark.createDataFrame(rows, "cam long, k long, w int, h int, data binary").select("cam", F.timestamp_millis(F.col("k") * 100).alias("ts"), "w", "h", "data")
    assert motion(df, MotionOptions(roi=((0, 0), (0.4, 0), (0.4, 1), (0, 1)))).count() == 0
    assert motion(df.limit(0)).count() == 0


def test_the_query_by_stream_is_the_query_by_table(spark):
    sf = "/root/testdata/sf0.001"
    told = lambda f: {tuple(r) for r in f(spark, sf).collect()}
    table, stream = told(cameras.motion_detector_table), told(cameras.motion_detector)
    assert table <= stream and all(r[2] == "out" for r in stream - table)


def test_a_table_needs_no_state_and_one_shuffle_of_packed_frames(spark, frames):
    plan = motion(frames, OPTIONS)._jdf.queryExecution().optimizedPlan().toString()
    assert "TransformWithState" not in plan and plan.count("RepartitionByExpression [cam") == 1
    flat = spark.createDataFrame([(1, 1, 60, 50, bytes(3000))], "cam long, k long, w int, h int, data binary").select("cam", F.timestamp_millis("k").alias("ts"), "w", "h", "data")
    assert len(scaled_frames(flat, OPTIONS).first()["data"]) < 300


def test_a_stream_carries_what_frames_are_drawn_from(spark):
    events = cameras.camera_events(spark, "/root/testdata/sf0.001")
    assert events.columns == ["cam", "ts", "frame", "noise"]
    stream = cameras.with_planes(micro_batches(events, "ts", 3))
    assert stream.isStreaming and "Join" not in stream._jdf.queryExecution().analyzed().toString()
    assert cameras.with_planes(events).count() == events.count()


def test_the_query_shuffles_events_and_no_frames(spark):
    plan = cameras.motion_detector_table(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1 and plan.index("Repartition") > plan.rindex("MapInArrow")


def test_an_ordered_table_gives_the_same_rows_without_a_shuffle(spark, frames, plain):
    ordered = frames.repartition(3, "cam").sortWithinPartitions("cam", "ts")
    got = motion(ordered, OPTIONS, ordered=True)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression [cam") == 1
    assert told(got) == sorted(tuple(map(str, r)) for r in plain[0])
    assert told(motion(ordered, OPTIONS, ordered=True, made=lambda batches: batches)) == told(got)  # rows without camera, time or data go
    with pytest.raises(ValueError):
        motion(frames, OPTIONS, made=lambda batches: batches)
    large = spark.createDataFrame([(1, k, 75, 50, bytes([200 if k > 12 and y > 20 and x > 30 else 90 for y in range(50) for x in range(75)])) for k in range(14)], "cam long, k long, w int, h int, data binary").select("cam", F.timestamp_millis(F.col("k") * 100).alias("ts"), "w", "h", "data")
    halves = MotionOptions(object_width=0.4, object_height=0.4, top_size=8, levels_min=2, time_min=0.0, shift_min=0.0)
    assert Layout.of(75, 50, halves).scaled == 2 and told(motion(large.coalesce(1).sortWithinPartitions("ts"), halves, ordered=True)) == told(motion(large, halves)) != []


def blobs(rng, n, h, w):
    """Planes of few strong spots on weak ones."""
    return np.where(rng.random((n, h, w)) < 0.55, rng.integers(96, 128, (n, h, w)), 0).astype(np.uint8) + np.where(rng.random((n, h, w)) < 0.1, 100, 0).astype(np.uint8)


def test_pools_are_what_floods_reach():
    rng = np.random.default_rng(4)
    for h, w in [(9, 12), (1, 1), (3, 40), (30, 5)]:
        inner = np.zeros((6, h, w), bool)
        inner[:, 1:-1, 1:-1] = True
        d = blobs(rng, 6, h, w)
        for seeds, free in (((d > 127) & inner, (d > 95) & inner), ((d > 95) & inner, (d > 127) & inner)):
            labels, of, boxes = pools(seeds, free)
            flood = list(grown(seeds, free))
            assert len(of) == len(boxes) == len(flood) == labels.max()
            for k, (f, cells) in enumerate(flood):
                rows, columns = np.divmod(np.array(cells), w)
                assert of[k] == f and np.array_equal(np.argwhere(labels == k + 1), sorted([f, r, c] for r, c in zip(rows.tolist(), columns.tolist())))
                assert boxes[k].tolist() == [columns.min(), rows.min(), columns.max() + 1, rows.max() + 1]


def test_regions_of_many_frames_are_those_of_each():
    rng, n_found = np.random.default_rng(5), 0
    for sizes in (((33, 46), (17, 23), (9, 12)), ((40, 31), (20, 16)), ((20, 20),), ((600, 800), (300, 400))):
        levels = [blobs(rng, 7, *size) for size in sizes]
        levels[0][3] = 0
        levels[-1][4] = 0
        roi = np.full(sizes[-1], 255, np.uint8)
        roi[: sizes[-1][0] // 3] = 0
        for area in (1, 6):
            found, covered = regions(levels, roi, area, OPTIONS)
            each = [regions([d[k : k + 1] for d in levels], roi, area, OPTIONS) for k in range(7)]
            assert found == [f[0] for f, _ in each] and covered == [c[0] for _, c in each]
            n_found = max(n_found, *map(len, found))
            if len(sizes) == 3:
                for k in range(7):
                    detector = Plain(*sizes[0], area)
                    seeds = [np.where(roi > 0, levels[2][k], np.minimum(levels[2][k], 127))]
                    assert detector.segment([d.tolist() for d in (levels[0][k], levels[1][k], *seeds)]) == (found[k], covered[k])
    assert n_found > 300  # more than a byte counts


@pytest.mark.parametrize("at_once", [1, 3, 64])
def test_frames_at_once_are_frames_one_by_one(at_once):
    """Other light again and again, so that the background goes back in the midst of frames."""
    rng, light = np.random.default_rng(6), 0
    planes = np.empty((60, H, W), np.uint8)
    for k in range(60):
        light = 90 - light if k in (14, 15, 20, 31, 33, 40, 41, 42, 43, 44, 52) else light
        planes[k] = 60 + light + rng.integers(0, 3, (H, W))
        planes[k, 5:17, k // 2 : k // 2 + 14] += 80
    s, plain_, want = Scene(W, H, OPTIONS), Plain(H, W, 14), []
    s.at_once = s.ahead = at_once
    got = s.frames(s.values(planes), [k / 10 for k in range(60)])
    for k in range(60):
        want += plain_.frame(planes[k].tolist(), k / 10)
    assert [r[2:] for r in got if r[0] == "object"] == [r[2:] for r in want if r[0] == "object"]
    assert [(r[0], r[1]) for r in got] == [(r[0], r[1]) for r in want] and sum(r[0] == "sabotage on" for r in got) > 3


def lit(seed, turns):
    """Frames of a camera whose light changes at some of them."""
    rng, light = np.random.default_rng(seed), 0
    out = np.empty((60, H, W), np.uint8)
    for k in range(60):
        light = 90 - light if k in turns else light
        out[k] = 60 + light + rng.integers(0, 3, (H, W))
        out[k, 5 + seed : 17 + seed, k // 2 : k // 2 + 14] += 80
    return out


def test_cameras_together_are_cameras_alone():
    cams = {7: lit(1, (14, 15, 31, 40, 41, 42)), -3: lit(2, ()), 8: lit(3, range(30, 40)), 9: lit(4, (52,))}
    frames = {cam: [(100_000 * k, W, H, W, H, p.tobytes()) for k, p in enumerate(planes) if cam != 9 or k % 3] for cam, planes in cams.items()}
    alone = {cam: through({}, OPTIONS, {cam: own}, False)[cam] for cam, own in frames.items()}
    assert through({}, OPTIONS, frames, False) == alone and all(alone.values())
    # part by part, the state written and read between
    got, scenes = {cam: [] for cam in cams}, {}
    for k in range(0, 60, 7):
        for cam, rows in through(scenes, OPTIONS, {cam: own[k : k + 7] for cam, own in frames.items()}, False).items():
            got[cam] += rows
        data = kept(scenes)
        scenes = restored(data, OPTIONS)
        assert kept(scenes) == data and list(scenes) == list(cams)
    assert got == alone
    scenes = [Scene(W, H, OPTIONS) for _ in range(2)]
    assert advance(scenes, [s.values(p) for s, p in zip(scenes, (cams[7], cams[8]))], [[k / 10 for k in range(60)]] * 2) == [alone[7], alone[8]]


def test_counts_of_state_are_kept_as_far_as_they_tell():
    s = Scene(W, H, OPTIONS)
    s.back.planes[:] = np.random.default_rng(1).integers(0, 128, s.back.planes.shape)
    s.back.planes[1] += s.back.planes[0]
    (t,) = restored(kept({5: s}), OPTIONS).values()
    assert np.array_equal(t.back.planes[:2], s.back.planes[:2]) and np.array_equal(t.back.planes[2:], np.minimum(s.back.planes[2:], 2))


@pytest.mark.parametrize("batches", [3, 9])
def test_a_stream_of_made_frames_shuffles_what_they_are_made_of(spark, frames, plain, batches):
    rows, cams = plain
    later = spark.createDataFrame([(9, 95, W, H, bytes(W * H))], "cam long, k long, w int, h int, data binary").select("cam", F.timestamp_millis(F.col("k") * 100 + 10**12).alias("ts"), "w", "h", "data")
    stream = motion(micro_batches(frames.unionByName(later), "ts", batches), OPTIONS, made=lambda batches: batches)
    assert "MapInArrow" not in stream._jdf.queryExecution().analyzed().toString()
    left = [(k, round(1000 * (c.last + 1.0)) - 10**12, "out", *o["row"]()) for k, c in cams.items() for o in c.objects if o["id"] is not None and c.last + 1.0 <= 10**9 + 9.5]
    assert told(replayed(stream)) == sorted(tuple(map(str, r)) for r in rows + left)


def test_the_query_s_state_is_a_small_part_of_its_planes(spark):
    streams = f"{shared_folder(spark).removeprefix('file://')}/stream-*"
    before = glob.glob(streams)
    cameras.motion_detector(spark, "/root/testdata/sf0.001").count()
    (own,) = {*glob.glob(streams)} - {*before}
    n = cameras.camera_events(spark, "/root/testdata/sf0.001").select("cam").distinct().count()
    stored = sum(os.path.getsize(f) for f in glob.glob(f"{own}/state/state/**/*.sst", recursive=True))
    planes = 4 * 3 * sum(h * w for h, w in Layout.of(cameras.WIDTH, cameras.HEIGHT, cameras.OPTIONS).sizes)
    assert 0 < stored < n * planes / 2, stored / n / planes  # all five batches' versions


def test_settings_hold_for_a_replay_alone(spark):
    key = "spark.sql.streaming.minBatchesToRetain"
    before = spark.conf.get(key, None)
    stream = micro_batches(spark.range(4).select("id", F.timestamp_millis("id").alias("ts")), "ts", 2)
    assert replayed(stream, settings={key: "2"}).count() == 4 and spark.conf.get(key, None) == before
