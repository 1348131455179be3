"""Connected components by alternating large-star and small-star steps.

Between steps every task replaces its edges, a bounded number at a time, by
stars of the same components; edges that fit one such block are done at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import checkpointed


#: Edges of one task: the tasks of an iteration follow the edges, not the session's shuffle partitions.
EDGES_PER_TASK = 200_000


def _large_star(edges: DataFrame, width: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(width)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(width)


def _small_star(edges: DataFrame, width: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().coalesce(width)
    least = down.groupBy("u").agg(F.min("v").alias("m")).coalesce(width)
    hung = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(width)
    return hung.union(least.select("u", F.col("m").alias("v"))).where("u <> v").coalesce(width).distinct().coalesce(width)


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of all nodes but roots, root being the least node that these edges reach."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(root, after := root[root]):
            root = after
    hung = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[hung], nodes[root[hung]]


def _contracted(edges: DataFrame) -> DataFrame:
    """(u, v): stars of each task's edges, which are taken EDGES_PER_TASK at a time; no shuffle."""
    most = EDGES_PER_TASK

    def run(batches) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            node, root = stars(*(np.concatenate([x[k] for x in held]) for k in (0, 1)))
            return pa.record_batch([pa.array(node), pa.array(root)], ["u", "v"])

        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                if n + part.num_rows > most:
                    yield flush()
                    held, n = [], 0
                held.append([c.to_numpy(zero_copy_only=False) for c in part.columns])
                n += part.num_rows
        if n:
            yield flush()

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of the edge list (u, v), root being the least node it reaches.

    Self loops and repeated edges change nothing; no edges give no rows.
    """
    now, before, width = checkpointed(_contracted(edges.where("u <> v"))), None, 0
    while True:
        row = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if row == before:
            break
        before, width = row, max(1, -(-row[0] // EDGES_PER_TASK))
        if width == 1:  # one block of edges
            now = _contracted(now.coalesce(1))
            break
        now = checkpointed(_contracted(_small_star(_large_star(now, width), width)))
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return checkpointed(roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()).coalesce(width))
