import math
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quiltra import model
from quiltra.functions import color
from quiltra.operators import stencil
from quiltra.operators import tensor as T
from quiltra.plans import catalog
from quiltra.sources import images
from quiltra.streaming import background

from .oracle import DATA


def plane(h, w, seed=1):
    return np.random.default_rng(seed).integers(0, 256, (h, w)).astype(np.uint8)


def long_plane(spark, v):
    return spark.createDataFrame([(0, y, x, int(v[y, x])) for y in range(v.shape[0]) for x in range(v.shape[1])], "img long, y long, x long, a long")


def as_array(rows, shape):
    out = np.zeros(shape, np.int64)
    for r in rows:
        out[r.y, r.x] = r.v
    return out


@pytest.mark.parametrize("shape", [(3, 3), (5, 7), (12, 16), (17, 33), (1, 4)])
def test_stencils_clamp_at_edges(spark, shape):
    v = plane(*shape)
    n = model.neighbourhood(long_plane(spark, v), "a")
    got = as_array(n.select("y", "x", stencil.sobel_dx().alias("v")).collect(), shape)
    p = np.pad(v.astype(int), 1, mode="edge")
    want = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    assert (got == want).all()


def test_pack_and_unpack_are_inverse(spark):
    v = plane(9, 11)
    df = long_plane(spark, v)
    got = as_array(model.unpack(model.pack(df, "a")).collect(), v.shape)
    assert (got == v).all()


def test_stencil_plan_has_one_shuffle(spark):
    plan = model.neighbourhood(model.pixels(spark, DATA).select("img", "y", "x", "a"), "a")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("kind", ["pgm", "pgm_txt", "ppm", "ppm_txt", "png", "bmp"])
def test_image_files_round_trip(spark, kind, tmp_path):
    v = plane(6, 5) if kind.startswith("pgm") else np.stack([plane(6, 5, s) for s in (1, 2, 3)], axis=2)
    raw = images.encode(v, kind)
    assert (images.decode(raw) == v).all()
    (tmp_path / "a.img").write_bytes(raw)
    (tmp_path / "b.img").write_bytes(b"no image")
    rows = {r.path[-5:]: r for r in images.read_images(spark, str(tmp_path)).collect()}
    assert bytes(rows["a.img"].data) == v.tobytes() and rows["b.img"].data is None
    packed = spark.createDataFrame([(5, 6, 1 if v.ndim == 2 else 3, v.tobytes())], images.PACKED)
    assert bytes(images.encoded(packed, kind).first().content) == raw


def test_crc32_and_gelu(spark):
    for r in catalog.QUERIES["crc32"](spark, DATA).join(spark.read.parquet(f"{DATA}/pages.parquet"), "page_id").collect():
        assert r.crc32 == zlib.crc32(r.html.encode())
    rows = catalog.QUERIES["synet_gelu_32f"](spark, DATA).limit(50).collect()
    e = {r.vec_id: r.embedding for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    for r in rows:
        x = e[r.t][r.i]
        assert abs(r.v - x * (1 + math.erf(x / math.sqrt(2))) / 2) < 1e-5


def test_yuv_round_trip_is_close(spark):
    df = spark.range(256).select(*[((F.col("id") * k) % 256).alias(n) for k, n in ((7, "b"), (13, "g"), (29, "r"))])
    for s in color.STANDARDS:
        yuv = df.select("b", "g", "r", *[v.alias(k + "_") for k, v in color.bgr_to_yuv(F.col("b"), F.col("g"), F.col("r"), s).items()])
        back = color.yuv_to_bgr(F.col("y_"), F.col("u_"), F.col("v_"), s)
        worst = yuv.select(F.max(F.greatest(*[F.abs(v - F.col(k)) for k, v in back.items()]))).first()[0]
        assert worst <= 6


def test_stream_equals_the_batch_replay(spark, tmp_path):
    rows = [(k % 3, k, (k * 7919) % 101) for k in range(60)]
    for i in range(3):
        spark.createDataFrame(rows[i * 20 : (i + 1) * 20], "key long, seq long, v long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key long, seq long, v long").parquet(str(tmp_path / "in"))
    q = background.background_range(stream).writeStream.format("memory").queryName("ranges").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.key, r.seq): (r.lo, r.hi) for r in spark.table("ranges").collect()}
    for key, seq, _ in rows:
        own = [v for k, s, v in rows if k == key and s <= seq]
        assert got[key, seq] == (min(own), max(own))


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert len(catalog.QUERIES) >= 200


def test_gram_multiplies_all_dimensions(spark):
    vectors = np.random.default_rng(5).standard_normal((300, 20))
    rows = [(k, v[: 20 - k % 3].tolist()) for k, v in enumerate(vectors)] + [(300, None), (301, []), (302, [None, 2.0])]
    full = np.zeros((303, 20))
    for k, v in rows:
        full[k, : len(v or [])] = [x or 0.0 for x in v or []]
    got = {(r.i, r.j): r.v for r in T.gram(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()}
    assert len(got) == 400 and np.allclose([[got[i, j] for j in range(20)] for i in range(20)], full.T @ full)
    assert T.gram(spark.createDataFrame([], "embedding array<double>")).count() == 0


def test_gemm_of_the_embeddings_has_every_cell(spark):
    found = catalog.QUERIES["gemm_full_32f"](spark, DATA)
    assert found.count() == 64 * 64
    assert {tuple(r) for r in catalog.QUERIES["gemm_32f"](spark, DATA).collect()} <= {tuple(r) for r in found.collect()}


def test_near_images_lose_no_pair(spark):
    from quiltra.operators import matching

    rng = np.random.default_rng(5)
    grid, rms, half = (5, 3), 10.0, 4
    base = rng.integers(0, 256, (60, 3, 5))
    noisy = [np.clip(base[k % 60] + rng.integers(-12, 13, (3, 5)), 0, 255) for k in range(240)]
    signs = np.concatenate([base, np.array(noisy)])
    half_of = lambda v: v[..., 3:].mean((1, 2)) - v[..., :2].mean((1, 2))
    gx, gy = half_of(signs), signs[:, 2].mean(1) - signs[:, 0].mean(1)
    rows = [(k, int(v.mean()), float(gx[k]), float(gy[k]), [int(x) for x in v.ravel()]) for k, v in enumerate(signs)]
    got = {(r.a, r.b, r.d) for r in matching.near_images(spark.createDataFrame(rows, "img long, mean long, gx double, gy double, sig array<long>"), half, rms, grid).collect()}
    want = set()
    for a in range(len(signs)):
        for b in range(a + 1, len(signs)):
            d = int(((signs[a] - signs[b]) ** 2).sum())
            if abs(rows[a][1] - rows[b][1]) <= half and d <= rms * rms * 15:
                want.add((a, b, d))
    assert got == want and len(want) > 100


def test_convolution_is_a_plain_loop():
    from quiltra.operators import layers

    rng = np.random.default_rng(2)
    for n, ch, h, w, out, kh, kw, s, d, p, g in ((2, 4, 7, 6, 6, 3, 2, 1, 1, (1, 0, 2, 1), 2), (1, 3, 9, 9, 4, 3, 3, 2, 2, (2, 2, 2, 2), 1), (3, 4, 5, 5, 4, 3, 3, 1, 1, (1, 1, 1, 1), 4)):
        x, weights = rng.normal(size=(n, ch, h, w)), rng.normal(size=(out, ch // g, kh, kw))
        got = layers.Convolution(weights, None, s, d, p, g)(x)
        padded = np.pad(x, ((0, 0), (0, 0), (p[0], p[2]), (p[1], p[3])))
        for o in range(out):
            for i in range(got.shape[2]):
                for j in range(got.shape[3]):
                    group = o // (out // g) * (ch // g)
                    patch = padded[:, group : group + ch // g, i * s : i * s + (kh - 1) * d + 1 : d, j * s : j * s + (kw - 1) * d + 1 : d]
                    assert np.allclose(got[:, o, i, j], (patch * weights[o]).sum((1, 2, 3)))


def test_streams_give_every_row_back(spark, tmp_path):
    from quiltra.streaming.run import replayed

    (spark.range(100).selectExpr("id % 7 as key", "id as seq", "(id * 37) % 50 as v").coalesce(1).write.parquet(f"{tmp_path}/in"))
    frames = spark.readStream.schema("key long, seq long, v long").parquet(f"{tmp_path}/in")
    rows = replayed(background.background_range(frames)).collect()
    assert len(rows) == 100
    for r in rows:
        seen = [(k * 37) % 50 for k in range(100) if k % 7 == r.key and k <= r.seq]
        assert (r.lo, r.hi) == (min(seen), max(seen))


def test_late_rows_leave_closed_windows_alone(spark, tmp_path):
    """Files of one micro-batch each: a row behind the watermark changes no window."""
    from pyspark.sql import functions as F

    from quiltra.streaming.run import shared_folder

    steps = [[("2024-01-01 00:10:00", 1), ("2024-01-01 00:50:00", 2)], [("2024-01-01 05:00:00", 3)], [("2024-01-01 09:00:00", 4)], [("2024-01-01 00:20:00", 100), ("2024-01-01 14:00:00", 5)], [("2024-01-01 20:00:00", 6)]]
    for k, rows in enumerate(steps):
        spark.createDataFrame(rows, "ts string, v int").selectExpr("to_timestamp(ts) as ts", "v").coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
        for file in (tmp_path / "in" / f"part={k}").glob("*.parquet"):
            os.utime(file, (1_700_000_000 + 10 * k,) * 2)  # files are taken in the order of their times
    frames = spark.readStream.schema("ts timestamp, v int, part int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").select("ts", "v")
    out = f"{shared_folder(spark)}/late-{tmp_path.name}"
    query = background.windowed_statistic(frames, "ts", "v", [], "1 hour", "1 hour").writeStream.format("parquet").outputMode("append").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {str(r.start): (r.n, r.s) for r in spark.read.parquet(f"{out}/rows").select(F.col("window.start").alias("start"), "n", "s").collect()}
    assert got["2024-01-01 00:00:00"] == (2, 3) and got["2024-01-01 05:00:00"] == (1, 3)


def test_training_sums_gradients_over_partitions(spark):
    from quiltra.operators.training import Network

    rows = [(r.embedding, r.label % 2) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    x, y = np.array([r[0] for r in rows], np.float64), np.array([r[1] for r in rows])
    net, losses = Network((64, 8, 2)), []
    for _ in range(8):
        losses.append(net.step(net.gradients(x, y)))
    got = [r.loss for r in catalog.QUERIES["network_train"](spark, DATA).orderBy("step").collect()]
    assert np.allclose(got, losses, rtol=1e-9) and got[-1] < got[0]


def test_gradients_are_differences():
    from quiltra.operators.training import Network

    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(6, 5)), rng.integers(0, 3, 6)
    net = Network((5, 4, 3))
    total = net.gradients(x, y)
    for k, at in ((0, 7), (1, 4)):
        w = net.weights[k].ravel()
        held = w[at]
        loss = []
        for d in (1e-6, -1e-6):
            net.weights[k].ravel()[at] = held + d
            loss.append(net.gradients(x, y)[-2])
        net.weights[k].ravel()[at] = held
        begin = sum(v.size for v in net.weights[:k])
        assert abs((loss[0] - loss[1]) / 2e-6 - total[begin + at]) < 1e-5


def test_links_of_rectangles_make_no_rows_of_pairs(spark):
    from quiltra.plans import scenes

    plan = scenes.linked(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "array_min" in plan and "collect_list" in plan
