import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiltra import model
from quiltra.functions import bits
from quiltra.operators import packed

from .test_library import long_plane, plane


def test_half_and_bfloat16_bits(spark):
    values = np.array([0.0, -0.0, 1.0, 1.0039062, 65504.0, 1e-8, -3.14159, 123456.0], np.float32)
    df = spark.createDataFrame([(float(v),) for v in values], "v float")
    rows = df.select("v", bits.float16_bits(F.col("v")).alias("h"), bits.bfloat16_bits(F.col("v")).alias("b"))
    rows = rows.select("*", bits.float16(F.col("h")).alias("hv"), bits.bfloat16(F.col("b")).alias("bv")).collect()
    for r, v in zip(rows, values):
        with np.errstate(over="ignore"):
            half = np.float16(v)
            assert r.h & 0x7FFF == int(half.view(np.uint16)) & 0x7FFF and (np.isinf(half) or r.hv == float(half))
        assert abs(r.bv - v) <= abs(float(v)) * 2**-8


def test_half_bits_are_numpys(spark):
    values = np.random.default_rng(3).normal(0, 1, 4000).astype(np.float32) * np.float32(10.0) ** np.random.default_rng(4).integers(-8, 5, 4000).astype(np.float32)
    rows = spark.createDataFrame([(float(v),) for v in values], "v float").select("v", bits.float16_bits(F.col("v")).alias("h"), bits.bfloat16_bits(F.col("v")).alias("b")).collect()
    with np.errstate(over="ignore"):
        assert [r.h for r in rows] == [int(np.float16(r.v).view(np.uint16)) for r in rows]
    u = np.array([r.v for r in rows], np.float32).view(np.uint32)
    assert [r.b for r in rows] == ((u + np.uint32(0x7FFF) + ((u >> np.uint32(16)) & np.uint32(1))) >> np.uint32(16)).tolist()


def test_crc32c(spark):
    known = {b"": 0, b"123456789": 0xE3069283, bytes(32): 0x8A9136AA}
    df = spark.createDataFrame([(k,) for k in known], "v binary").select("v", bits.crc32c("v").alias("c"))
    assert {bytes(r.v): r.c for r in df.collect()} == known


def test_gaussian_blur_keeps_flat_planes_and_mean(spark):
    flat = np.full((9, 12), 77, np.uint8)
    assert (packed.gaussian_blur(flat, 1.5) == 77).all()
    v = plane(12, 16)
    got = packed.on_planes(model.pack(long_plane(spark, v), "a"), lambda p: packed.gaussian_blur(p, 0.8)).first()
    out = np.frombuffer(got.data, np.uint8).reshape(got.h, got.w)
    assert out.shape == v.shape and abs(out.mean() - v.mean()) < 3 and out.std() < v.std()


def plain_bilateral(p, spatial, range_):
    h, w, n = len(p), len(p[0]), len(p[0][0])
    a = math.exp(-math.sqrt(2) / (spatial * 255))
    mean = lambda i, j: (i + j + 1) // 2

    def share(u, v):
        d = [abs(i - j) for i, j in zip(u, v)]
        return a * math.exp(-(d[0] if n == 1 else mean(*d) if n == 2 else mean(d[1], mean(d[0], d[2]))) / (range_ * 255))

    def line(source, values):
        sums = [[0.0] * (n + 1) for _ in source]
        for order in (range(len(source)), range(len(source) - 1, -1, -1)):
            f, g = 1.0, list(map(float, values[order[0]]))
            for k, i in enumerate(order):
                if k:
                    s = share(source[i], source[order[k - 1]])
                    f, g = 1 - a + s * f, [(1 - a) * v + s * u for v, u in zip(values[i], g)]
                sums[i] = [x + y for x, y in zip(sums[i], [*g, f])]
        return [[math.floor(v / s[n] + 1e-4) for v in s[:n]] for s in sums]

    rows = [line(r, r) for r in p]
    columns = [line([p[y][x] for y in range(h)], [rows[y][x] for y in range(h)]) for x in range(w)]
    return [[columns[x][y] for x in range(w)] for y in range(h)]


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_recursive_bilateral_is_the_plain_recursion(channels):
    v = np.random.default_rng(channels).integers(0, 256, (9, 14, channels))
    v[:, 7:] //= 8
    got = packed.recursive_bilateral(v.astype(np.uint8), 0.02, 0.1)
    assert got.tolist() == plain_bilateral(v.tolist(), 0.02, 0.1)
    even = np.full((4, 5, channels), 9, np.uint8)
    assert (packed.recursive_bilateral(even, 0.01, 0.1) == 9).all()
    step = np.zeros((8, 20), np.uint8)
    step[:, 10:] = 200
    out = packed.recursive_bilateral(step, 0.012, 0.04)
    assert (out[:, :9] <= 2).all() and (out[:, 11:] >= 197).all()


def test_affine_inverse():
    m = (1.2, -0.3, 5.0, 0.4, 0.9, -2.0)
    a, b, c, d, e, f = packed.affine_inverse(m)
    x, y = 3.0, 7.0
    u, w = m[0] * x + m[1] * y + m[2], m[3] * x + m[4] * y + m[5]
    assert np.allclose((a * u + b * w + c, d * u + e * w + f), (x, y))
    with pytest.raises(ValueError):
        packed.affine_inverse((1, 2, 0, 2, 4, 0))


def test_draw_line_is_cut_at_the_borders():
    out = packed.draw_line(np.zeros((5, 5), np.uint8), -3, 2, 9, 2, 200, 3)
    assert (out[1:4] == 200).all() and (out[[0, 4]] == 0).all()


def test_pack_needs_one_shuffle(spark):
    plan = model.pack(model.pixels(spark, "/root/testdata/sf0.001"), "a").where(F.col("img") == 0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
