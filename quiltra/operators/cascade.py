"""Cascades of boosted stumps over Haar rectangles or local binary patterns: models as tables, windows that pass stage after stage.

A model is four tables: info (model, kind, w, h, categories, tilted, int16),
stages (model, stage, threshold), trees (model, stage, tree, feature, threshold,
subset, low, high) and rects (model, feature, part, x, y, w, h, weight, tilted).
A window is a row with the corners of the integral images that lie in it; each
stage is a join with the stage's one row, which is sent to all tasks, and a
filter on the sum of its trees, so that a stage only sees what the one before
let pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import kept

KEY = ["img", "y", "x"]
#: Fixed value: what a stage's sum may fall short of its threshold.
SLACK = 1e-5
#: Trees and rectangles that a model may have; it is sent to every task stage by stage.
MOST_TREES = 100_000

_STAGE = "array<struct<stageThreshold: string, weakClassifiers: struct<`_`: array<struct<internalNodes: string, leafValues: string>>>>>"
_FEATURE = "array<struct<rects: struct<`_`: array<string>>, rect: string, tilted: string>>"
#: The part of the format that is read: words of numbers stay strings until they are cut.
SCHEMA = f"stageType string, featureType string, width int, height int, stageParams struct<maxDepth: int>, featureParams struct<maxCatCount: int>, stages struct<`_`: {_STAGE}>, features struct<`_`: {_FEATURE}>"
XML = {"rowTag": "cascade", "attributePrefix": "@", "valueTag": "#text", "ignoreSurroundingSpaces": "true", "mode": "FAILFAST"}


@dataclass
class Cascades:
    info: DataFrame
    stages: DataFrame
    trees: DataFrame
    rects: DataFrame


def _words(text: Column, kind: str) -> Column:
    return F.split(F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), "^ ", ""), " ").cast(f"array<{kind}>")


def flattened(models: DataFrame) -> Cascades:
    """Tables of (model, c): c is the content of a `cascade` element.

    Models must be boosted stumps of kind HAAR or LBP of a positive size; others
    are told with an error.  Rows without content go.
    """
    models = models.where("c is not null")
    bad = F.when(F.coalesce("c.stageType", F.lit("")) != "BOOST", "stage type")
    bad = bad.when(~F.coalesce("c.featureType", F.lit("")).isin("HAAR", "LBP"), "feature type").when(F.coalesce(F.least("c.width", "c.height"), F.lit(0)) <= 0, "size").when(F.coalesce("c.stageParams.maxDepth", F.lit(1)) != 1, "depth of trees")
    bad = bad.when(F.col("c.stages._").isNull() | F.col("c.features._").isNull(), "stages or features")
    models = models.where(F.when(bad.isNull(), True).otherwise(F.raise_error(F.concat(F.lit("cascade "), F.col("model").cast("string"), F.lit(": not supported or missing: "), bad)).cast("boolean")))
    models = models.withColumn("categories", F.coalesce("c.featureParams.maxCatCount", F.lit(0)))

    stages = models.select("model", "categories", F.posexplode("c.stages._").alias("stage", "s"))
    trees = stages.select("model", "categories", "stage", F.posexplode("s.weakClassifiers._").alias("tree", "t"))
    node, leaf = F.col("node"), F.col("leaf")
    trees = trees.select("model", "categories", "stage", "tree", _words(F.col("t.internalNodes"), "double").alias("node"), _words(F.col("t.leafValues"), "double").alias("leaf"))
    subset = F.when(F.col("categories") > 0, F.slice(node, 4, F.greatest(F.size(node) - 3, F.lit(0))).cast("array<bigint>").cast("array<int>"))
    trees = trees.select("model", "stage", "tree", node[2].cast("int").alias("feature"), F.when(F.col("categories") == 0, node[3]).alias("threshold"), subset.alias("subset"), leaf[0].alias("low"), leaf[1].alias("high"))

    features = models.select("model", F.col("c.featureType").alias("kind"), F.posexplode("c.features._").alias("feature", "f"))
    parts = F.when(F.col("kind") == "HAAR", F.col("f.rects._")).otherwise(F.array("f.rect"))
    rects = features.select("model", "feature", (F.coalesce(F.col("f.tilted").cast("int"), F.lit(0)) != 0).alias("tilted"), F.posexplode(parts).alias("part", "text"))
    v = F.col("v")
    rects = rects.withColumn("v", _words(F.col("text"), "double"))
    rects = rects.select("model", "feature", "part", *[v[k].cast("int").alias(n) for k, n in enumerate("xywh")], F.coalesce(F.get(v, F.lit(4)), F.lit(1.0)).alias("weight"), "tilted")

    of = rects.groupBy("model").agg(F.bool_or("tilted").alias("tilted"), (F.max(F.col("w") * F.col("h")) <= 256).alias("small"))
    info = models.select("model", F.col("c.featureType").alias("kind"), F.col("c.width").alias("w"), F.col("c.height").alias("h"), "categories").join(of, "model")
    info = info.select("model", "kind", "w", "h", "categories", "tilted", (F.col("small") & (F.col("kind") == "LBP")).alias("int16"))
    return Cascades(info, stages.select("model", "stage", (F.col("s.stageThreshold").cast("double") - SLACK).alias("threshold")), trees, rects)


def cascades_of_text(models: DataFrame, model_col: str = "model", xml_col: str = "xml") -> Cascades:
    """Models from a column of XML documents, whole files in the format of OpenCV."""
    inner = F.regexp_extract(xml_col, r"(?s)<cascade\b.*</cascade>", 0)
    return flattened(kept(models.select(F.col(model_col).alias("model"), F.from_xml(F.when(inner != "", inner), SCHEMA, XML).alias("c"))))


def read_cascades(spark: SparkSession, path: str) -> Cascades:
    """Models from XML files; a model is named by its file."""
    found = spark.read.format("xml").options(**XML).schema(SCHEMA).load(path)
    return flattened(found.select(F.regexp_extract(F.input_file_name(), r"([^/]*)$", 1).alias("model"), F.struct("*").alias("c")))


# -- evaluation -------------------------------------------------------------------------------------------


def integral_corners(planes: DataFrame, value: str, plain: bool = False) -> DataFrame:
    """img, y, x, s, sq, t: sums above and left of each corner of `value` and of its square, and over the triangle that opens upwards from it.

    Corners are (h + 1) x (w + 1).  A triangle grows from one row to the next by
    the two diagonals that end beside the corner's last pixel, so running sums
    along both diagonals and then down each column give it.  Windows of one image
    share one shuffle; nothing is joined.  plain: s only, which is all that local
    binary patterns look at.
    """
    up = lambda *keys: Window.partitionBy("img", *keys).orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    v = F.col("v")
    size = F.max("x").over(Window.partitionBy("img")) + 1
    high = F.max("y").over(Window.partitionBy("img")) + 1
    p = planes.select("img", "y", "x", F.col(value).cast("long").alias("v")).repartition("img").select("*", size.alias("w"), high.alias("h"))
    row = Window.partitionBy("img", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0).cast("long")
    if plain:
        p = p.select("*", F.sum("v").over(row).alias("rs")).select("*", F.sum("rs").over(up("x")).alias("s"))
        corner = lambda y, x, s=zero: F.struct(y.alias("y"), x.alias("x"), s.alias("s"))
        below, right, none = F.col("y") + 1, F.col("x") + 1, F.array().cast("array<struct<y: bigint, x: bigint, s: bigint>>")
        first = lambda k, *found: F.when(k, F.array(*found)).otherwise(none)
        more = F.concat(F.array(corner(below, right, F.col("s"))), first(F.col("y") == 0, corner(zero, right)), first(F.col("x") == 0, corner(below, zero)), first((F.col("x") == 0) & (F.col("y") == 0), corner(zero, zero)))
        return p.select("img", F.inline(more))
    p = p.select("*", F.sum("v").over(row).alias("rs"), F.sum(v * v).over(row).alias("rq"))
    p = p.select("*", F.sum("rs").over(up("x")).alias("s"), F.sum("rq").over(up("x")).alias("sq"))
    # pixels on the way up-left and up-right from a pixel, itself included
    diagonal = lambda d: Window.partitionBy("img", F.col("y") + d * F.col("x")).orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    p = p.select("*", F.sum("v").over(diagonal(-1)).alias("ul"), F.sum("v").over(diagonal(1)).alias("ur"))
    edge = F.col("ul") + F.col("ur") - v
    # corners below and right of a pixel; corners of the first row and column are added beside the pixels that know them
    own = F.struct((F.col("y") + 1).alias("y"), (F.col("x") + 1).alias("x"), "s", "sq", edge.alias("e"))
    top = F.struct(zero.alias("y"), (F.col("x") + 1).alias("x"), zero.alias("s"), zero.alias("sq"), zero.alias("e"))
    left = F.struct((F.col("y") + 2).alias("y"), zero.alias("x"), zero.alias("s"), zero.alias("sq"), F.col("ur").alias("e"))
    ends = [F.struct(F.lit(k).cast("long").alias("y"), zero.alias("x"), zero.alias("s"), zero.alias("sq"), zero.alias("e")) for k in (0, 1)]
    more = F.concat(F.array(own), F.when(F.col("y") == 0, F.array(top)).otherwise(F.array()), F.when((F.col("x") == 0) & (F.col("y") < F.col("h") - 1), F.array(left)).otherwise(F.array()), F.when((F.col("x") == 0) & (F.col("y") == 0), F.array(*ends)).otherwise(F.array()))
    corners = p.select("img", F.inline(more))
    return corners.select("img", "y", "x", "s", "sq", F.sum("e").over(up("x")).alias("t"))


def windows(corners: DataFrame, w: int, h: int, step: int = 1) -> DataFrame:
    """img, y, x, s, t, norm: windows of w x h whose place is a multiple of `step`; s and t are the corners inside, row by row.

    norm is the root of area * squares - sum * sum inside a border of one, 1 where that is negative.
    Plain corners give no t and no norm.
    """
    sums = [k for k in ("s", "sq", "t") if k in corners.columns]
    rows = corners.groupBy("img", "y").agg(F.array_sort(F.collect_list(F.struct("x", *sums))).alias("row"))
    rows = rows.select("img", "y", *[F.col("row")[k].alias(k) for k in sums])
    down = Window.partitionBy("img").orderBy("y").rowsBetween(0, h)
    rows = rows.select("img", "y", *[F.collect_list(k).over(down).alias(k) for k in sums]).where((F.size("s") == h + 1) & (F.col("y") % step == 0))
    cut = lambda k, x: F.flatten(F.transform(k, lambda r: F.slice(r, x + 1, w + 1)))

    def inner(k: str, x: Column) -> Column:
        at = lambda i, j: F.get(F.get(F.col(k), F.lit(i)), (x + j).cast("int"))
        return (at(1, 1) - at(1, w - 1) - at(h - 1, 1) + at(h - 1, w - 1)).cast("double")

    area = float((w - 2) * (h - 2))
    last = F.size(F.get("s", F.lit(0))) - 1 - w
    places = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda x: (x % step == 0) & (x <= last))
    if sums == ["s"]:
        return rows.select("img", "y", F.inline(F.transform(places, lambda x: F.struct(x.cast("long").alias("x"), cut("s", x).alias("s")))))
    one = F.transform(places, lambda x: F.struct(x.cast("long").alias("x"), cut("s", x).alias("s"), cut("t", x).alias("t"), (inner("sq", x) * area - inner("s", x) * inner("s", x)).alias("q")))
    out = rows.select("img", "y", F.inline(one))
    return out.select("img", "y", "x", "s", "t", F.when(F.col("q") < 0, F.lit(1.0)).otherwise(F.sqrt("q")).alias("norm"))


def stage_rows(cascades: Cascades, model, int16: bool = False) -> tuple[dict, list[DataFrame]]:
    """The model's info row, and one row (bound, trees) for each of its stages.

    int16 gives leaves and thresholds as whole numbers, scaled so that a stage's
    sum fits 16 bits, where the model allows that.
    """
    info = cascades.info.where(F.col("model") == F.lit(model)).first()
    if info is None:
        raise ValueError(f"no cascade {model!r}")
    rects, trees, stages = (t.where(F.col("model") == F.lit(model)) for t in (cascades.rects, cascades.trees, cascades.stages))
    count, n = trees.count() + rects.count(), stages.count()
    if count > MOST_TREES:
        raise ValueError(f"cascade {model!r} has {count} trees and rectangles, more than {MOST_TREES}")
    wide = info["w"] + 1
    corner = lambda y, x: (y * wide + x).cast("int")
    x, y, w, h = map(F.col, "xywh")
    if info["kind"] == "HAAR":
        at = F.when(F.col("tilted"), F.array(corner(y, x), corner(y + h, x - h), corner(y + w, x + w), corner(y + w + h, x + w - h))).otherwise(F.array(corner(y, x), corner(y, x + w), corner(y + h, x), corner(y + h, x + w)))
    else:
        at = F.array(*[corner(y + h * i, x + w * j) for i in range(4) for j in range(4)])
    parts = rects.groupBy("feature").agg(F.collect_list(F.struct(at.alias("at"), "weight", "tilted")).alias("parts"))
    rows = trees.join(parts, "feature").groupBy("stage").agg(F.array_sort(F.collect_list(F.struct("tree", "threshold", "subset", "low", "high", "parts"))).alias("trees"))
    rows = rows.join(stages.select("stage", F.col("threshold").alias("bound")), "stage")
    if int16 and info["int16"]:
        total = lambda f: F.aggregate("trees", F.lit(0.0), lambda s, t: s + f(t["low"], t["high"]))
        k = F.lit(32767 * 0.9) / F.greatest(F.abs(total(F.least)), F.abs(total(F.greatest)))
        near = lambda v: F.signum(v) * F.floor(F.abs(v) + 0.5)
        rows = rows.withColumn("k", k)
        rows = rows.select("stage", near(F.col("bound") * F.col("k")).alias("bound"), F.transform("trees", lambda t: t.withField("low", near(t["low"] * F.col("k"))).withField("high", near(t["high"] * F.col("k")))).alias("trees"))
    rows = rows.select("stage", F.lit(True).alias("here"), "bound", "trees")
    found = sorted(rows.collect())  # MOST_TREES at most
    if len(found) != n:
        raise ValueError(f"cascade {model!r} has stages without trees or trees without rectangles")
    spark = cascades.info.sparkSession
    return info.asDict(), [spark.createDataFrame([r], rows.schema).drop("stage") for r in found]


def haar_sum(tree: Column) -> Column:
    """Weighted sum of a tree's rectangles in the window's corners."""

    def part(total: Column, p: Column) -> Column:
        v = lambda k: F.when(p["tilted"], F.get("t", p["at"][k])).otherwise(F.get("s", p["at"][k]))
        return total + p["weight"] * (v(0) - v(1) - v(2) + v(3))

    return F.aggregate(tree["parts"], F.lit(0.0), part)


def lbp_code(tree: Column) -> Column:
    """Which of the eight cells around a tree's middle cell are not below it, as 8 bits."""
    at = tree["parts"][0]["at"]
    v = lambda i, j: F.get("s", at[4 * i + j])
    cell = lambda i, j: v(i, j) - v(i, j + 1) - v(i + 1, j) + v(i + 1, j + 1)
    around = ((0, 0), (0, 1), (0, 2), (1, 2), (2, 2), (2, 1), (2, 0), (1, 0))
    return sum((F.when(cell(i, j) >= cell(1, 1), F.lit(128 >> k)).otherwise(0) for k, (i, j) in enumerate(around)), F.lit(0))


def passing(found: DataFrame, kind: str, stages: list[DataFrame]) -> DataFrame:
    """Windows that pass all stages, each stage on what the one before left."""

    def leaf(total: Column, tree: Column) -> Column:
        if kind == "HAAR":
            high = haar_sum(tree) >= tree["threshold"] * F.col("norm")
        else:
            code = lbp_code(tree)
            word = F.get(tree["subset"], F.floor(code / 32).cast("int"))
            high = F.call_function("shiftright", word, code % 32).bitwiseAND(F.lit(1)) == 0
        return total + F.when(high, tree["high"]).otherwise(tree["low"])

    names = [k for k in ("img", "y", "x", "s", "t", "norm") if k in found.columns]
    out = found.withColumn("here", F.lit(True))
    for rows in stages:
        out = out.join(F.broadcast(rows), "here").where(F.aggregate("trees", F.lit(0.0), leaf) >= F.col("bound")).select(*names, "here")
    return out.drop("here")


def detected(planes: DataFrame, cascades: Cascades, model, value: str = "v", step: int = 1, int16: bool = False) -> DataFrame:
    """img, y, x of the windows of (img, y, x, value) that the model's cascade accepts.

    step 2 looks at every other row and column.  Sums are double precision.  An
    image that is smaller than the window has none; null pixels are not allowed.
    """
    info, stages = stage_rows(cascades, model, int16)
    return passing(windows(integral_corners(planes, value, info["kind"] == "LBP"), info["w"], info["h"], step), info["kind"], stages).select("img", "y", "x")


# -- scales and groups -----------------------------------------------------------------------------------------


def levels_of(size: tuple[int, int], window: tuple[int, int], factor: float, least: tuple[int, int] = (0, 0), most: tuple[int, int] = (1 << 30, 1 << 30)) -> list[tuple[float, int, int]]:
    """Scale, width and height of each level at which the window, scaled up, fits the image and the bounds."""
    out, scale = [], 1.0
    near = lambda v: int(v + 0.5)
    while True:
        w, h = near(window[0] * scale), near(window[1] * scale)
        if w > min(most[0], size[0]) or h > min(most[1], size[1]):
            return out
        if w >= least[0] and h >= least[1]:
            out.append((scale, near(size[0] / scale), near(size[1] / scale)))
        scale *= factor


def resampled(planes: DataFrame, value: str, size: tuple[int, int], levels: list[tuple[float, int, int]]) -> DataFrame:
    """img, lvl, y, x, v: all levels by bilinear resampling, rounded; pixels send their shares, one shuffle adds them up."""
    near = planes.select("img", F.col("y").alias("sy"), F.col("x").alias("sx"), F.col(value).alias("v"), F.posexplode(F.array(*[F.struct(F.lit(w).alias("dw"), F.lit(h).alias("dh")) for _, w, h in levels])).alias("lvl", "to"))
    near = near.select("img", "lvl", "sy", "sx", "v", "to.dw", "to.dh")

    def reach(at: str, n: int, to: str) -> Column:
        scale = F.col(to) / n
        return F.explode(F.sequence(F.greatest(F.floor((F.col(at) - 1) * scale - 1), F.lit(0)), F.least(F.ceil((F.col(at) + 2) * scale), F.col(to) - 1)))

    def weight(dst: str, src: str, n: int, to: str) -> Column:
        pos = (F.col(dst) + F.lit(0.5)) * (F.lit(float(n)) / F.col(to)) - 0.5
        return F.greatest(1 - F.abs(F.least(F.greatest(pos, F.lit(0.0)), F.lit(n - 1.0)) - F.col(src)), F.lit(0.0))

    near = near.select("*", reach("sy", size[1], "dh").alias("y")).withColumn("wy", weight("y", "sy", size[1], "dh")).where("wy > 0")
    near = near.select("*", reach("sx", size[0], "dw").alias("x")).withColumn("wx", weight("x", "sx", size[0], "dw")).where("wx > 0")
    sums = near.groupBy("img", "lvl", "y", "x").agg(F.sum(F.col("v") * F.col("wy") * F.col("wx")).alias("v"))
    return sums.select("img", "lvl", "y", "x", F.floor(F.round("v", 6) + 0.5).cast("long").alias("v"))


def candidates(planes: DataFrame, cascades: Cascades, model, size: tuple[int, int], factor: float = 1.1, value: str = "v", roi: DataFrame | None = None, least=(0, 0), most=(1 << 30, 1 << 30), int16: bool = True) -> DataFrame:
    """img, l, t, r, b: accepted windows of all levels at the scale of the image.

    Up to a scale of 2 every other window is looked at.  roi (img, y, x) holds the
    pixels that may be a window's middle; a window of a level belongs to the pixel
    that its middle has there.
    """
    info, stages = stage_rows(cascades, model, int16)
    w, h = info["w"], info["h"]
    levels = levels_of(size, (w, h), factor, least, most)
    if not levels:
        return planes.sparkSession.createDataFrame([], "img long, l long, t long, r long, b long")
    small = resampled(planes, value, size, levels)
    # an image and a level are one key to the stages, which know images only
    small = small.select(F.struct("img", "lvl").alias("img"), "y", "x", "v")
    found = windows(integral_corners(small, "v", info["kind"] == "LBP"), w, h)
    scale = F.element_at(F.array(*[F.lit(s) for s, _, _ in levels]), F.col("img.lvl") + 1)
    found = found.where((scale > 2) | ((F.col("y") % 2 == 0) & (F.col("x") % 2 == 0)))
    # the rows that pass are few and have no sums: only these meet the pixels of the region
    found = passing(found, info["kind"], stages).select("img", "y", "x")
    if roi is not None:
        middle = lambda k, half: F.floor((F.col(k) + half) * scale).cast("long")
        found = found.withColumns({"my": middle("y", h // 2), "mx": middle("x", w // 2)})
        inside = roi.select(F.col("img").alias("of"), F.col("y").cast("long").alias("ry"), F.col("x").cast("long").alias("rx")).distinct()
        found = found.join(inside, (found["img"]["img"] == inside["of"]) & (found["my"] == inside["ry"]) & (found["mx"] == inside["rx"]), "left_semi").drop("my", "mx")
    near = lambda v: F.floor(v * scale + 0.5).cast("long")
    x, y = F.col("x"), F.col("y")
    return found.select(F.col("img.img").alias("img"), near(x).alias("l"), near(y).alias("t"), near(x + w).alias("r"), near(y + h).alias("b"))
