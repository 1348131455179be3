"""Cascades as tables, stage-wise evaluation, scales, components and groups of rectangles."""

import random

import pytest
from pyspark.sql import functions as F

from quiltra.model import pixels
from quiltra.operators import cascade as K
from quiltra.operators.graph import components
from quiltra.operators.grouping import grouped
from quiltra.plans import detection as D

SF = "/root/testdata/sf0.001"
TABLES = ("info", "stages", "trees", "rects")


def rows(df):
    return sorted(str(r) for r in df.collect())


def test_files_and_texts_give_equal_tables(spark, tmp_path):
    for kind in D.SMALL:
        (tmp_path / f"{kind}.xml").write_text('<?xml version="1.0"?>\n<!-- a comment -->\n' + D.small_xml(kind))
    by_text, by_file = D.small(spark), K.read_cascades(spark, f"file://{tmp_path}")
    for name in TABLES:
        ours = getattr(by_file, name).withColumn("model", F.regexp_replace("model", r"\.xml$", ""))
        assert rows(ours) == rows(getattr(by_text, name))
    info = {r.model: (r.kind, r.w, r.h, r.categories, r.tilted, r.int16) for r in by_text.info.collect()}
    assert info == {"HAAR": ("HAAR", 8, 8, 0, True, False), "LBP": ("LBP", 8, 8, 256, False, True)}
    assert by_text.trees.where("model = 'HAAR'").count() == 7 and by_text.rects.where("model = 'HAAR'").count() == 9


@pytest.mark.parametrize(
    "old, new, told",
    [("BOOST", "HOG", "stage type"), (">HAAR<", ">HOG<", "feature type"), ("<width>8", "<width>0", "size"), ("<featureParams>", "<stageParams><maxDepth>2</maxDepth></stageParams><featureParams>", "depth of trees"), ("features>", "others>", "stages or features")],
)
def test_models_that_are_not_supported_are_told(spark, old, new, told):
    bad = spark.createDataFrame([("m", D.small_xml("HAAR").replace(old, new))], "model string, xml string")
    with pytest.raises(Exception, match=f"cascade m: not supported or missing: {told}"):
        K.cascades_of_text(bad).stages.collect()


def test_models_that_are_missing(spark):
    none = K.cascades_of_text(spark.createDataFrame([("a", None), ("b", "<opencv_storage/>")], "model string, xml string"))
    assert none.info.count() == none.trees.count() == 0
    with pytest.raises(ValueError, match="no cascade"):
        K.stage_rows(none, "a")


@pytest.mark.parametrize("kind", list(D.SMALL))
def test_windows_fall_stage_by_stage(spark, kind):
    planes = pixels(spark, SF).select("img", "y", "x", F.col("a").alias("v"))
    info, stages = K.stage_rows(D.small(spark), kind)
    every = K.windows(K.integral_corners(planes, "v"), info["w"], info["h"])
    left = [K.passing(every, kind, stages[:k]).count() for k in range(len(stages) + 1)]
    assert left == sorted(left, reverse=True) and left[0] == 43 * 23 and len(set(left)) == len(left) and left[-1] > 0
    plan = K.passing(every, kind, stages)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == len(stages) and plan.count("bound") >= len(stages)


def test_images_that_are_too_small_or_narrow(spark):
    small = spark.createDataFrame([(1, y, x, 9) for y in range(8) for x in range(7)] + [(2, y, x, (3 * x + y) % 5) for y in range(8) for x in range(8)] + [(3, 0, 0, 1)], "img long, y long, x long, v long")
    corners = K.integral_corners(small, "v")
    assert {r["img"]: r["count"] for r in corners.groupBy("img").count().collect()} == {1: 72, 2: 81, 3: 4}
    assert [(r.img, r.y, r.x) for r in K.windows(corners, 8, 8).collect()] == [(2, 0, 0)]
    by = {(r.img, r.y, r.x): (r.s, r.sq, r.t) for r in corners.collect()}
    plane = {(r.img, r.y, r.x): r.v for r in small.collect()}
    for (img, y, x), (s, sq, t) in by.items():
        own = [(i, j, v) for (g, i, j), v in plane.items() if g == img]
        assert s == sum(v for i, j, v in own if i < y and j < x) and sq == sum(v * v for i, j, v in own if i < y and j < x)
        assert t == sum(v for i, j, v in own if i < y and abs(j + 1 - x) < y - i)


def test_levels():
    assert D.LEVELS == [(1.0, 50, 30), (1.5, 33, 20), (2.25, 22, 13), (3.375, 15, 9)]
    assert [s for s, _, _ in K.levels_of((50, 30), (8, 8), 1.5, (10, 10), (20, 20))] == [1.5, 2.25]
    assert K.levels_of((7, 30), (8, 8), 1.5) == []


def test_candidates_need_a_level(spark):
    planes = spark.createDataFrame([(1, 0, 0, 3)], "img long, y long, x long, v long")
    assert K.candidates(planes, D.small(spark), "HAAR", (1, 1)).count() == 0


def test_components_are_those_of_a_walk(spark):
    rng = random.Random(2)
    order = list(range(1000, 1300))
    rng.shuffle(order)
    edges = list(zip(order, order[1:])) + [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(7, 7), (500, 501), (501, 500)]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for k in sorted(near):
        todo = [k] if k not in want else []
        while todo:
            n = todo.pop()
            if n not in want:
                want[n] = k
                todo += near[n]
    assert {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_groups(boxes, least, differ):
    alike = lambda p, q: all(abs(a - b) <= differ * (min(p[2] - p[0], q[2] - q[0]) + min(p[3] - p[1], q[3] - q[1])) / 2 for a, b in zip(p, q))
    left, groups = list(boxes), []
    while left:
        todo, own = [left.pop()], []
        while todo:
            p = todo.pop()
            own.append(p)
            close = [q for q in left if alike(p, q)]
            for q in close:
                left.remove(q)
            todo += close
        if len(own) >= least:
            groups.append((len(own), *[int(sum(p[k] for p in own) / len(own) + 0.5) for k in range(4)]))
    out = []
    for i, (n, *p) in enumerate(groups):
        held = False
        for j, (m, *q) in enumerate(groups):
            dx, dy = int((q[2] - q[0]) * differ + 0.5), int((q[3] - q[1]) * differ + 0.5)
            held |= i != j and (m > max(3, n) or n < 3) and p[0] >= q[0] - dx and p[1] >= q[1] - dy and p[2] <= q[2] + dx and p[3] <= q[3] + dy
        if not held:
            out.append((n, *p))
    return out


@pytest.mark.parametrize("least, differ", [(1, 0.2), (2, 0.2), (3, 0.35)])
def test_groups_are_those_of_all_pairs(spark, least, differ):
    rng = random.Random(least)
    boxes = {1: [], 2: [(5, 5, 5, 5), (5, 5, 5, 5)], 3: [(0, 0, 10, 10)] * 50 + [(1, 1, 10, 10)] * 3}
    for _ in range(14):
        x, y, w, h = rng.randrange(200), rng.randrange(200), rng.randint(4, 60), rng.randint(4, 60)
        boxes[1] += [(x + rng.randint(-2, 2), y + rng.randint(-2, 2), x + w + rng.randint(-2, 2), y + h + rng.randint(-2, 2)) for _ in range(rng.randint(1, 8))]
        boxes[1] += [(x + w // 4, y + h // 4, x + w // 2, y + h // 2)] * rng.randint(0, 3)
    df = spark.createDataFrame([(k, *b) for k, bs in boxes.items() for b in bs], "img long, l long, t long, r long, b long")
    got = sorted((r.img, r.n, r.l, r.t, r.r, r.b) for r in grouped(df, least, differ).collect())
    assert got == sorted((k, *g) for k, bs in boxes.items() for g in plain_groups(bs, least, differ))


def test_a_text_is_parsed_once(spark):
    for name in TABLES:
        assert "from_xml" not in getattr(D.small(spark), name)._jdf.queryExecution().optimizedPlan().toString()


def test_windows_of_binary_patterns_carry_plain_sums(spark):
    planes = spark.createDataFrame([(1, y, x, (3 * x + y * y) % 7) for y in range(9) for x in range(10)], "img long, y long, x long, v long")
    every, plain = K.integral_corners(planes, "v"), K.integral_corners(planes, "v", True)
    assert rows(every.select("img", "y", "x", "s")) == rows(plain.select("img", "y", "x", "s"))
    assert rows(K.windows(every, 8, 8).select("img", "y", "x", "s")) == rows(K.windows(plain, 8, 8)) and K.windows(plain, 8, 8).columns == ["img", "y", "x", "s"]


def test_the_region_meets_rows_without_sums(spark):
    plan = D.over_scales(spark, SF, "HAAR")._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join LeftSemi")
    assert join < plan.index("bound")
