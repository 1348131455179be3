"""Connected components by shrinking: labels run over edges, then over themselves, until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming.run import shared_folder


def kept(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def components(edges: DataFrame) -> DataFrame:
    """id, root of every id in (a, b): root is the least id that can be reached.

    A round gives each id the least label beside it and then follows the labels
    once (a label is an id), so a chain of n ids takes about log n rounds; edges
    between two equal labels are left out of the next one.
    """
    edges = kept(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "id")
    label = kept(label)
    while True:
        jump = label.select(F.col("id").alias("root"), F.col("root").alias("further"))
        label = label.join(jump, "root").select("id", F.least("root", "further").alias("root"))
        roots = label.select(F.col("id").alias("a"), F.col("root").alias("ra"))
        to = label.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        between = kept(edges.join(roots, "a").join(to, "b").where("ra <> rb").select(F.greatest("ra", "rb").alias("root"), F.least("ra", "rb").alias("low")))
        if between.isEmpty():
            loose = label.join(label.select(F.col("id").alias("root"), F.col("root").alias("further")), "root").where("root <> further")
            if loose.isEmpty():
                return label.select("id", "root")
            label = kept(label)
            continue
        hook = between.groupBy("root").agg(F.min("low").alias("low"))
        label = kept(label.join(hook, "root", "left").select("id", F.coalesce("low", "root").alias("root")))
