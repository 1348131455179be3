"""Gradients by differences, mini-batches by table, saved and resumed steps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiltra.operators.neural import Convolution, Dense, Dropout, Pooling, Trainer, uniform
from quiltra.plans import learning

SF = "/root/testdata/sf0.001"


def net(loss, function, rate=0.7):
    layers = [Convolution("tanh", depth=3, core=3, valid=False), Pooling(size=2, stride=2), Convolution("sigmoid", depth=2, core=2, biased=False), Pooling("leaky_relu", mean=True, size=2, stride=1), Dropout(rate=rate), Dense("tanh", units=5), Dense(function, units=3, biased=False)]
    return Trainer((2, 7, 6), layers, loss)


@pytest.mark.parametrize("loss, function", [("mse", "identity"), ("mse", "tanh"), ("mse", "softmax"), ("cross_entropy", "sigmoid"), ("cross_entropy_multiclass", "softmax"), ("cross_entropy_multiclass", "sigmoid"), ("cross_entropy", "softmax")])
def test_gradients_are_differences(loss, function):
    rng = np.random.default_rng(3)
    n = net(loss, function)
    x, keys = rng.normal(size=(6, 84)), rng.integers(-(2**62), 2**62, 6)
    wanted = np.eye(3)[rng.integers(0, 3, 6)]
    got, flat = n.gradients(x, wanted, keys), n.flat()
    assert len(got) == len(flat) + 2 == n.size + 2

    def loss_at(values):
        n.put(values)
        return n.losses(n.forward(x, keys)[1], wanted).sum()

    assert got[-2:] == pytest.approx([loss_at(flat), 6])
    for k in range(0, len(flat), 3):
        step = np.zeros_like(flat)
        step[k] = 1e-5
        assert got[k] == pytest.approx((loss_at(flat + step) - loss_at(flat - step)) / 2e-5, rel=2e-4, abs=2e-6)


def test_layers_by_hand():
    x = np.arange(30, dtype=float).reshape(1, 1, 5, 6)
    most, mean = (Pooling(shape=(1, 5, 6), size=2, stride=2, mean=m) for m in (False, True))
    assert most.out() == (1, 3, 3) and most.linear(x, None)[0][0, 0].tolist() == [[7, 9, 11], [19, 21, 23], [25, 27, 29]]
    assert mean.linear(x, None)[0][0, 0, 0].tolist() == [3.5, 5.5, 7.5]
    one = Convolution(shape=(1, 5, 6), depth=1, core=2)
    one.weight, one.bias = np.array([[[[1.0, 2], [3, 4]]]]), np.array([0.5])
    assert one.linear(x, None)[0][0, 0, 1, 2] == 8 + 2 * 9 + 3 * 14 + 4 * 15 + 0.5
    drop = Dropout(shape=(1, 1, 4), rate=0.5)
    y, kept = drop.linear(np.ones((2000, 1, 1, 4)), lambda n: uniform(np.arange(2000), n, 1))
    assert set(np.unique(y)) == {0.0, 2.0} and abs(y.mean() - 1) < 0.05 and drop.linear(x, None)[0] is x
    with pytest.raises(ValueError, match="too large"):
        Trainer((1, 2, 2), [Convolution(core=3)])
    with pytest.raises(ValueError, match="none of"):
        Trainer((1, 2, 2), [Dense(units=1)], "other")


def test_a_step_over_a_table_is_a_step_in_memory(spark):
    rows = learning.labelled(spark, SF)
    held = rows.select(F.col("embedding").cast("array<double>"), F.col("wanted").cast("array<double>"))
    data = held.select(F.xxhash64("embedding", "wanted").alias("k"), "embedding", "wanted").collect()
    whole, table = learning.picture_net(), learning.picture_net()
    losses = table.train(rows.unionByName(spark.createDataFrame([(-1, None, [1.0, 0.0]), (-2, [0.0] * 64, None)], "vec_id long, embedding array<float>, wanted array<double>")), "embedding", "wanted", 3, 4)
    for step in range(4):
        part = [r for r in data if (r.k >> 7) % 3 == step % 3]
        loss = whole.move(whole.gradients(np.array([r.embedding for r in part]), np.array([r.wanted for r in part]), np.array([r.k for r in part])))
        assert losses[step] == pytest.approx(loss)
    assert np.allclose(table.flat(), whole.flat(), atol=1e-9) and table.step == 4


def test_runs_that_resume_are_equal(spark, tmp_path):
    rows, path = learning.labelled(spark, SF), f"file://{tmp_path}/weights"
    first = learning.picture_net()
    losses = first.train(rows, "embedding", "wanted", 2, 5, save=path)
    for _ in range(2):
        again = learning.picture_net("mse", "softmax")  # other weights do not matter
        again.loss = first.loss
        again.load(spark, path, 3)
        assert again.train(rows, "embedding", "wanted", 2, 2) == losses[3:]
        assert np.array_equal(again.flat(), first.flat()) and np.array_equal(again.squares, first.squares)
    assert again.load(spark, path).step == 5
    with pytest.raises(ValueError, match="parameters"):
        Trainer((1, 8, 8), [Dense(units=1)]).load(spark, path)


def test_training_tells_classes_apart(spark):
    assert learning.trained(spark, SF).count() == spark.read.parquet(f"{SF}/embeddings.parquet").count()
    rng = np.random.default_rng(5)
    pictures = rng.normal(size=(600, 8, 8))
    left = rng.random(600) < 0.5
    pictures[left, :, :4] += 0.8
    pictures[~left, :, 4:] += 0.8
    some = spark.createDataFrame([(k, p.ravel().tolist(), [float(a), float(not a)]) for k, (p, a) in enumerate(zip(pictures, left))], "t long, x array<double>, w array<double>")
    net = learning.picture_net()
    losses = net.train(some, "x", "w", 2, 16)
    told = {r.t: r.data[0] > r.data[1] for r in net.predict(some, "t", "x").collect()}
    assert losses[-1] < losses[0] / 2 and sum(told[k] == a for k, a in enumerate(left)) > 540
    net = learning.picture_net()
    rows = spark.createDataFrame([(1, None), (2, [0.5] * 64)], "t long, x array<double>")
    out = {r.t: r.data for r in net.predict(rows, "t", "x").collect()}
    assert out[1] is None and sum(out[2]) == pytest.approx(1)
    assert net.predict(rows.limit(0), "t", "x").count() == 0
    assert net.train(rows.limit(0).withColumn("w", F.col("x")), "x", "w", 2, 1) == [0.0]
