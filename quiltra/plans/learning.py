"""Queries of training by mini-batches, and the SQL of one step."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import table
from ..operators.neural import Convolution, Dense, Dropout, Pooling, Trainer

QUERIES: dict = {}
SQL: dict = {}
UNITS, RATE, EPSILON = 3, 0.05, 1e-4


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, embedding, wanted: one of two classes by the parity of the label."""
    even = F.col("label") % 2 == 0
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.array(even.cast("double"), (~even).cast("double")).alias("wanted"))


def fixed(loss: str, function: str) -> Trainer:
    """64, 3 and 2 units with fixed weights."""
    net = Trainer((1, 8, 8), [Dense("tanh", units=UNITS), Dense(function, units=2)], loss, RATE, EPSILON)
    one, two = np.arange(64)[:, None] * 7 + np.arange(UNITS)[None] * 3, np.arange(UNITS)[:, None] * 5 + np.arange(2)[None] * 2
    net.put(np.concatenate([((one % 11 - 5) * 0.1).ravel(), (np.arange(UNITS) - 1) * 0.2, ((two % 7 - 3) * 0.3).ravel(), [0.1, -0.1]]))
    return net


def one_step(loss: str, function: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """place, w: all parameters after a step over all rows."""
        net = fixed(loss, function)
        net.train(labelled(spark, sf_dir), "embedding", "wanted", 1, 1)
        return spark.createDataFrame([(k, round(v, 6)) for k, v in enumerate(net.flat().tolist())], "place long, w double")

    return run


def _step_sql(loss: str, function: str) -> str:
    value = {"softmax": "exp(z) / sum(exp(z)) OVER (PARTITION BY t)", "sigmoid": "1 / (1 + exp(-z))", "identity": "z"}[function]
    return f"""WITH v AS (SELECT vec_id AS t, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
o AS (SELECT unnest(range({UNITS})) AS o), p AS (SELECT unnest(range(2)) AS p),
w1 AS (SELECT i, o, (((i * 7 + o * 3) % 11) - 5) * 0.1::DOUBLE AS w FROM (SELECT unnest(range(64)) AS i), o),
w2 AS (SELECT o, p, (((o * 5 + p * 2) % 7) - 3) * 0.3::DOUBLE AS w FROM o, p),
h AS (SELECT t, o, tanh(sum(v * w) + (o - 1) * 0.2::DOUBLE) AS h FROM v JOIN w1 USING (i) GROUP BY t, o),
z AS (SELECT t, p, sum(h * w) + CASE WHEN p = 0 THEN 0.1 ELSE -0.1 END::DOUBLE AS z FROM h JOIN w2 USING (o) GROUP BY t, p),
d AS (SELECT t, p, {value} - CASE WHEN label % 2 = p THEN 1 ELSE 0 END AS d FROM z JOIN embeddings ON vec_id = t),
e AS (SELECT t, o, sum(d * w) * (1 - any_value(h) * any_value(h)) AS e FROM d JOIN w2 USING (p) JOIN h USING (t, o) GROUP BY t, o),
n AS (SELECT count(*)::DOUBLE AS n FROM embeddings),
g AS (SELECT i * {UNITS} + o AS place, any_value(w) AS w, sum(v * e) AS g FROM v JOIN e USING (t) JOIN w1 USING (i, o) GROUP BY i, o
UNION ALL SELECT 64 * {UNITS} + o, (o - 1) * 0.2::DOUBLE, sum(e) FROM e GROUP BY o
UNION ALL SELECT 65 * {UNITS} + o * 2 + p, any_value(w), sum(h * d) FROM h JOIN d USING (t) JOIN w2 USING (o, p) GROUP BY o, p
UNION ALL SELECT 67 * {UNITS} + p, CASE WHEN p = 0 THEN 0.1 ELSE -0.1 END::DOUBLE, sum(d) FROM d GROUP BY p)
SELECT CAST(place AS BIGINT) AS place, round(w - {RATE}::DOUBLE * (g / n) / sqrt((g / n) * (g / n) + {EPSILON}::DOUBLE), 6) AS w FROM g, n"""


for _loss, _function in (("cross_entropy_multiclass", "softmax"), ("cross_entropy", "sigmoid"), ("mse", "identity")):
    QUERIES[f"network_step_{_loss}"] = one_step(_loss, _function)
    SQL[f"network_step_{_loss}"] = _step_sql(_loss, _function)


def picture_net(loss: str = "cross_entropy_multiclass", function: str = "softmax") -> Trainer:
    """Convolution, pooling, dense and dropout layers over embeddings as pictures of 8 x 8."""
    layers = [Convolution("relu", depth=4, core=3, valid=False), Pooling(size=2, stride=2), Convolution("tanh", depth=6, core=2), Pooling(mean=True, size=3, stride=3), Dense("relu", units=8), Dropout(rate=0.8), Dense(function, units=2)]
    return Trainer((1, 8, 8), layers, loss, 0.1)


def trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t, right: whether the network, after 12 steps over 4 mini-batches, tells each embedding's class."""
    net, rows = picture_net(), labelled(spark, sf_dir)
    net.train(rows, "embedding", "wanted", 4, 12)
    found = net.predict(rows, "vec_id", "embedding").join(rows.select(F.col("vec_id").alias("t"), "wanted"), "t")
    return found.select("t", ((F.get("data", F.lit(0)) > F.get("data", F.lit(1))) == (F.get("wanted", F.lit(0)) > 0)).alias("right"))


QUERIES["network_train_pictures"] = trained
