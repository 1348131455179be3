"""Groups of similar rectangles in whole pixels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components, kept

BOX = ["l", "t", "r", "b"]


def similar_pairs(boxes: DataFrame, differ: float) -> DataFrame:
    """a, b: ids of similar rectangles of an image: all sides differ by at most `differ` times the mean of the lesser width and height.

    Such rectangles have sums of width and height that differ by a factor under
    1 + 2 differ, so they are in the same or in neighbouring classes of size; one
    of each pair looks into the nine places around it that a class has.
    """
    c = F.col
    size = c("r") - c("l") + c("b") - c("t")
    base = 1 + 2 * differ
    of = F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / math.log(base))
    own = boxes.select("img", "id", *BOX, F.explode(F.array(of, of + 1)).alias("size"))
    cell = F.greatest(F.lit(differ / 2) * F.pow(F.lit(base), c("size") + 1), F.lit(1.0))
    own = own.select("*", F.floor(c("l") / cell).alias("cx"), F.floor(c("t") / cell).alias("cy"))
    near = lambda k: F.explode(F.sequence(c(k) - 1, c(k) + 1))
    looks = own.select("img", "id", *BOX, "size", near("cx").alias("cx"), "cy").select("img", "id", *BOX, "size", "cx", near("cy").alias("cy"))
    looks = looks.toDF("img", "a", *[k + "1" for k in BOX], "size", "cx", "cy")
    met = looks.join(own.withColumnRenamed("id", "b0"), ["img", "size", "cx", "cy"]).where("a < b0")
    reach = F.lit(differ) * (F.least(c("r1") - c("l1"), c("r") - c("l")) + F.least(c("b1") - c("t1"), c("b") - c("t"))) / 2
    alike = F.lit(True)
    for k in BOX:
        alike = alike & (F.abs(c(k + "1") - c(k)) <= reach)
    return met.where(alike).select("a", c("b0").alias("b")).distinct()


def grouped(boxes: DataFrame, least: int = 3, differ: float = 0.2) -> DataFrame:
    """img, n, l, t, r, b: groups of rectangles (img, l, t, r, b) that similarity connects, as rounded means.

    Equal rectangles count as often as they occur.  Groups of fewer than `least`
    rectangles go, and so do those that lie, but for `differ` of its size, inside
    another group of more than 3 and of more rectangles, or inside any if they have
    fewer than 3 themselves.  Only groups of one image meet.
    """
    c = F.col
    distinct = boxes.groupBy("img", *BOX).agg(F.count("*").alias("c"))
    distinct = kept(distinct.withColumn("id", F.monotonically_increasing_id()))
    labels = components(similar_pairs(distinct, differ))
    found = distinct.join(labels, "id", "left").withColumn("root", F.coalesce("root", "id"))
    near = lambda v: F.floor(v + 0.5).cast("long")
    mean = [near(F.sum(c("c") * c(k)).cast("double") / F.sum("c")).alias(k) for k in BOX]
    groups = kept(found.groupBy("img", "root").agg(F.sum("c").alias("n"), *mean).where(c("n") >= least))
    return groups.join(_held(groups, differ).select("root"), "root", "left_anti").select("img", "n", *BOX)


def _held(groups: DataFrame, differ: float) -> DataFrame:
    """Groups inside a stronger one: candidates meet by the cells of a grid of the holder's size class."""
    c = F.col
    near = lambda v: F.floor(v + 0.5).cast("long")
    dx, dy = near(F.lit(differ) * (c("r") - c("l"))), near(F.lit(differ) * (c("b") - c("t")))
    holder = groups.select("img", c("root").alias("by"), c("n").alias("m"), (c("l") - dx).alias("l2"), (c("t") - dy).alias("t2"), (c("r") + dx).alias("r2"), (c("b") + dy).alias("b2"))
    side = F.greatest(c("r2") - c("l2"), c("b2") - c("t2"), F.lit(1))
    holder = holder.withColumn("size", F.ceil(F.log2(side.cast("double"))).cast("int"))
    cell = F.pow(F.lit(2.0), c("size"))
    spread = lambda a, b: F.explode(F.sequence(F.floor(c(a) / cell), F.floor(c(b) / cell)))
    holder = holder.select("*", spread("l2", "r2").alias("cx")).select("*", spread("t2", "b2").alias("cy"))
    sizes = holder.select("img", "size").distinct().groupBy("img").agg(F.collect_set("size").alias("sizes"))  # some 30 at most
    inner = groups.join(sizes, "img").select("img", "root", "n", *BOX, F.explode("sizes").alias("size"))
    inner = inner.withColumns({"cx": F.floor(c("l") / cell), "cy": F.floor(c("t") / cell)})
    inside = (c("l") >= c("l2")) & (c("t") >= c("t2")) & (c("r") <= c("r2")) & (c("b") <= c("b2"))
    stronger = (c("m") > F.greatest(F.lit(3), c("n"))) | (c("n") < 3)
    return inner.join(holder, ["img", "size", "cx", "cy"]).where(inside & stronger & (c("root") != c("by")))
