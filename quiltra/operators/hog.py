"""Histograms of oriented gradients with 31 values a cell of 8 x 8 pixels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import neighbourhood

CELL, TURNS = 8, 18
#: What a normalised entry is cut at, what keeps roots from zero, the weight of a texture sum.
CUT, SMALL, TEXTURE = 0.2, 0.0001, 0.2357
AXES = [(math.cos(k * math.pi / 9), math.sin(k * math.pi / 9)) for k in range(5)]


def direction(dx: Column, dy: Column) -> Column:
    """Which of 18 directions a gradient has: the nearest of five in its quadrant, turned into place; the first of equal ones."""
    ax, ay = F.abs(dx), F.abs(dy)
    dots = F.array(*[F.lit(c) * ax + F.lit(s) * ay for c, s in AXES])
    near = F.array_position(dots, F.array_max(dots)).cast("int") - 1
    turned = F.when(dx < 0, 9 - near).otherwise(near)
    return F.when((dy < 0) & (turned != 0), TURNS - turned - F.when(dx == 0, 1).otherwise(0)).otherwise(turned)


def cell_histograms(planes: DataFrame, value: str) -> DataFrame:
    """img, w, h, cy, cx, o, v: lengths of inner pixels' gradients, shared out among the four nearest cells."""
    size = Window.partitionBy("img")
    n = neighbourhood(planes.select("img", "y", "x", value), value, 1)
    n = n.select("img", "y", "x", (F.max("x").over(size) + 1).alias("w"), (F.max("y").over(size) + 1).alias("h"), (F.col("n12") - F.col("n10")).alias("dx"), (F.col("n21") - F.col("n01")).alias("dy"))
    n = n.where((F.col("x") > 0) & (F.col("y") > 0) & (F.col("x") < F.col("w") - 1) & (F.col("y") < F.col("h") - 1))
    length = F.sqrt((F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).cast("double"))
    share = lambda k: (((F.col(k) + 4) % CELL) * 2 + 1) / F.lit(2.0 * CELL)
    low = lambda k: F.floor((F.col(k) - 4) / CELL)
    put = [F.struct((low("y") + i).alias("cy"), (low("x") + j).alias("cx"), (length * (share("y") if i else 1 - share("y")) * (share("x") if j else 1 - share("x"))).alias("v")) for i in (0, 1) for j in (0, 1)]
    rows = n.select("img", "w", "h", direction(F.col("dx"), F.col("dy")).alias("o"), F.inline(F.array(*put)))
    rows = rows.where((F.col("cy") >= 0) & (F.col("cx") >= 0) & (F.col("cy") < F.floor(F.col("h") / CELL)) & (F.col("cx") < F.floor(F.col("w") / CELL)))
    return rows.groupBy("img", "cy", "cx", "o").agg(F.sum("v").alias("v"))


def features(planes: DataFrame, value: str = "v") -> DataFrame:
    """img, cy, cx, f: 18 signed, 9 unsigned and 4 texture values of each whole cell.

    Entries are divided by the energy of each of the four squares of 2 x 2 cells
    that hold the cell; cells outside the image have none.  Images without a whole
    cell or an inner pixel have no rows.
    """
    held = cell_histograms(planes, value).groupBy("img", "cy", "cx").agg(F.map_from_entries(F.collect_list(F.struct("o", "v"))).alias("m"))
    h = F.transform(F.sequence(F.lit(0), F.lit(TURNS - 1)), lambda o: F.coalesce(F.element_at("m", o), F.lit(0.0)))
    cells = held.select("img", "cy", "cx", h.alias("h"))
    both = F.transform(F.slice("h", 1, 9), lambda a, o: a + F.get("h", o + 9))
    cells = cells.withColumn("u", both).withColumn("e", F.aggregate("u", F.lit(0.0), lambda s, v: s + v * v)).repartition("img")
    row, column = Window.partitionBy("img", "cy").orderBy("cx"), Window.partitionBy("img", "cx").orderBy("cy")
    cells = cells.select("*", (F.col("e") + F.lead("e", 1, 0.0).over(row)).alias("r"), (F.col("e") + F.lag("e", 1, 0.0).over(row)).alias("l"))
    square = lambda side, move: 1 / F.sqrt(F.col(side) + move(side, 1, 0.0).over(column) + SMALL)
    cells = cells.select("img", "cy", "cx", "h", "u", F.array(square("r", F.lead), square("r", F.lag), square("l", F.lead), square("l", F.lag)).alias("n"))
    cut = lambda v, n: F.least(v * n, F.lit(CUT))
    mean = lambda k: F.transform(k, lambda v: 0.5 * F.aggregate("n", F.lit(0.0), lambda s, n: s + cut(v, n)))
    texture = F.transform("n", lambda n: TEXTURE * F.aggregate("h", F.lit(0.0), lambda s, v: s + cut(v, n)))
    return cells.select("img", "cy", "cx", F.concat(mean("h"), mean("u"), texture).alias("f"))
