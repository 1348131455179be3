"""Image hashes and the pairs of similar images against all pairs."""

import math
import random

import duckdb
import pytest

from quiltra.operators import matching as M

W, H = 24, 20


def pictures(n=200):
    """Gradients and blends of a few; many are near copies."""
    rng, out = random.Random(11), []
    for k in range(n):
        if k % 4 and k > 8:
            base = out[rng.randrange(0, k, 4)]
            out.append([max(0, min(255, v + rng.randint(-12, 12))) for v in base])
        else:
            a, b, c = rng.uniform(-6, 6), rng.uniform(-6, 6), rng.randrange(60, 200)
            out.append([max(0, min(255, int(c + a * (x - W / 2) + b * (y - H / 2)))) for y in range(H) for x in range(W)])
    return out


@pytest.fixture(scope="module")
def planes(spark):
    return spark.createDataFrame([(k, i // W, i % W, v) for k, p in enumerate(pictures()) for i, v in enumerate(p)], "img long, y long, x long, v long").repartition(4)


def hashed(p, main):
    def share(n, d):
        low, high = d * n / main, (d + 1) * n / main
        return [(s, (min(high, s + 1) - max(low, s)) * main / n) for s in range(n) if min(high, s + 1) - max(low, s) > 1e-12]

    cells = [[math.floor(round(sum(p[y * W + x] * wy * wx for y, wy in share(H, i) for x, wx in share(W, j)), 6) + 0.5) for j in range(main)] for i in range(main)]
    step = main // 4
    fast = [(sum(cells[y][x] for y in range(i * step, (i + 1) * step) for x in range(j * step, (j + 1) * step)) + step * step // 2) // (step * step) for i in range(4) for j in range(4)]
    return [v for r in cells for v in r], fast


@pytest.mark.parametrize("main", M.HASH_SIZES)
def test_hashes(spark, planes, main):
    got = {r.img: (r.main, r.fast) for r in M.image_hashes(planes.where("img < 6"), "v", (W, H), main).collect()}
    assert got == {k: hashed(p, main) for k, p in enumerate(pictures()[:6])}
    with pytest.raises(ValueError, match="is none of"):
        M.image_hashes(planes, "v", (W, H), 20)


@pytest.mark.parametrize("threshold, normalized, deal", [(0.03, False, 256), (0.05, True, 3), (0.09, False, 7), (0.0, False, 2)])
def test_no_pair_is_lost(spark, planes, threshold, normalized, deal):
    hashes = {k: hashed(p, 16) for k, p in enumerate(pictures())}
    side, want = int(threshold * 255), {}
    for a in hashes:
        for b in range(a + 1, len(hashes)):
            main, fast = (sum((u - v) ** 2 for u, v in zip(hashes[a][k], hashes[b][k])) for k in (0, 1))
            if fast <= side * side * 16 and main <= side * side * 256 and math.sqrt(main / 256) / 255 <= threshold:
                want[a, b] = math.sqrt(main / 256) / 255
    df = spark.createDataFrame([(k, *h) for k, h in hashes.items()], "img long, main array<int>, fast array<int>").repartition(3)
    got = {(r.a, r.b): r.difference for r in M.similar_images(df, threshold, normalized, deal).collect()}
    assert got == pytest.approx(want) and (threshold < 0.03 or len(want) > 30)


def test_images_that_are_absent(spark, planes):
    assert M.similar_images(M.image_hashes(planes.limit(0), "v", (W, H))).count() == 0


def test_a_bucket_of_many_images_meets_in_packed_cells(spark):
    rows = [(k, [(k * 3 + j) % 7 + 100 for j in range(256)], [100] * 16) for k in range(120)]
    df = spark.createDataFrame(rows, "img long, main array<int>, fast array<int>").repartition(3)
    found = M.similar_images(df, 0.05, False, 16)
    assert found.count() == 120 * 119 // 2 and found.where("a >= b").count() == 0
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "zip_with" not in plan


def test_normalized_pairs_are_those_of_all_pairs_over_several_deals(spark):
    hashes = {k: hashed(p, 16) for k, p in enumerate(pictures(80))}
    df = spark.createDataFrame([(k, *h) for k, h in hashes.items()], "img long, main array<int>, fast array<int>")
    whole, dealt = (sorted(map(tuple, M.similar_images(df, 0.06, True, n).collect())) for n in (8192, 5))
    assert whole == dealt and whole


@pytest.mark.parametrize("main", [32, 64])
def test_pixels_of_hashes_meet_once(spark, planes, main):
    plan = M.image_hashes(planes, "v", (W, H), main)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Join" not in plan
    few = spark.createDataFrame([(1, 0, 0, 200), (1, 0, 0, 20), (1, 5, 3, None), (1, 99, 0, 7)], "img long, y long, x long, v long")
    r = M.image_hashes(few, "v", (W, H), main).first()
    p = [220] + [0] * (W * H - 1)
    assert (r.main, r.fast) == hashed(p, main)


def test_the_best_shift_sends_a_pixel_once(spark):
    rows = [(k, y, x, (y * 7 + x * 3 + k) % 50, ((y - 1) * 7 + (x + 2) * 3 + k) % 50) for k in range(3) for y in range(9) for x in range(11) if (k, y, x) != (2, 4, 4)]
    df = spark.createDataFrame(rows, "img long, y long, x long, v long, w long")
    out = M.best_shift(df, "v", "w", 2)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    v, w = ({r[:3]: r[n] for r in rows} for n in (3, 4))
    for r in out.collect():
        every = []
        for dy in range(-2, 3):
            for dx in range(-2, 3):
                d = [abs(a - w[k, y + dy, x + dx]) for (k, y, x), a in v.items() if k == r.img and (k, y + dy, x + dx) in w]
                every.append((sum(d) / len(d), dy, dx, sum(d), len(d)))
        assert tuple(r)[1:] == min(every)[1:]


@pytest.mark.parametrize("main", M.HASH_SIZES)
def test_packed_rows_give_the_hashes_of_pixels(spark, main):
    rows = [(1, [200, 7, None] + [90] * 30), (1, [20]), (2, [250] * 480 + [99]), (3, []), (4, None)]
    df = spark.createDataFrame(rows, "img long, data array<short>").repartition(3)
    got = {r.img: (r.main, r.fast) for r in M.packed_image_hashes(df, (W, H), main).collect()}
    assert got == {1: hashed([220, 7, 0] + [90] * 30 + [0] * (W * H - 33), main), 2: hashed([250] * 480, main)}
    with pytest.raises(ValueError, match="is none of"):
        M.packed_image_hashes(df, (W, H), 20)


@pytest.mark.parametrize("query", ["image_hash_32", "image_hash_64"])
def test_hash_queries_shuffle_a_row_for_an_image(spark, tmp_path, query):
    from quiltra.plans import cameras

    rows = [(k, [float("nan"), None, float("inf")] + [(k * j % 9 - 4) / 3 for j in range(61)]) for k in range(20)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = cameras.QUERIES[query](spark, str(tmp_path))
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = duckdb.sql(cameras.SQL[query].replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet/*.parquet'")).fetchall()
    assert sorted(map(tuple, out.collect())) == sorted(want) and len(want) == 20


def test_a_bucket_of_20000_images_is_sent_once_for_each_neighbour(spark):
    """With deals of 8192 a bucket of 20,000 images had three deals, and each image three copies in its own bucket alone."""
    assert -(-20_000 // M.DEAL) == 1
