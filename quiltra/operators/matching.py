"""Matching of images and frames: block signatures, shift search, warping, relational set operations on masks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import area_taps
from .graph import kept


def signatures(df: DataFrame, value: str, cell: int, grid: tuple[int, int]) -> DataFrame:
    """(img, mean, gx, gy, sig): rounded block means in row order, their mean and how much the right half tops the left and the lower the upper; one shuffle of partial sums.

    grid: blocks in a row and in a column.
    """
    cells = df.groupBy("img", F.expr(f"y div {cell}").alias("cy"), F.expr(f"x div {cell}").alias("cx")).agg(F.floor(F.avg(value)).alias("v"))
    sig = F.transform(F.array_sort(F.collect_list(F.struct("cy", "cx", "v"))), lambda s: s["v"])
    half = lambda k, n: F.avg(F.when(2 * F.col(k) > n - 1, F.col("v"))) - F.avg(F.when(2 * F.col(k) < n - 1, F.col("v")))
    return cells.groupBy("img").agg(sig.alias("sig"), F.floor(F.avg("v")).alias("mean"), half("cx", grid[0]).alias("gx"), half("cy", grid[1]).alias("gy"))


def near_images(sigs: DataFrame, half: int, rms: float, grid: tuple[int, int]) -> DataFrame:
    """Pairs a < b within `half` of mean and `rms` root mean square difference.

    Images are dealt into buckets of mean and of both gradients, each so wide
    that a pair lies in the same or in neighbouring buckets: a gradient over m
    of n blocks differs by 2 rms sqrt(n / m) at most.  One side looks into all
    27 neighbours; the join is on the bucket, and no pair is lost.
    """
    nx, ny = grid

    def bucket(value: str, width: float) -> Column:
        return F.floor(F.col(value) / width).cast("long")

    def width(n: int) -> float:
        used = 2 * (n // 2) / n
        return 2 * rms * (1 / used) ** 0.5 + 1e-6

    keys = {"bm": bucket("mean", half + 1), "bx": bucket("gx", width(nx)), "by": bucket("gy", width(ny))}
    left = sigs.select(F.col("img").alias("p"), F.col("mean").alias("mp"), F.col("sig").alias("sp"), *[v.alias(k) for k, v in keys.items()])
    right = sigs.select(F.col("img").alias("q"), F.col("mean").alias("mq"), F.col("sig").alias("sq"), *[v.alias(k) for k, v in keys.items()])
    for k in keys:
        right = right.withColumn(k, F.explode(F.array(F.col(k) - 1, F.col(k), F.col(k) + 1)))
    pairs = left.join(right, list(keys)).where(f"p < q and abs(mp - mq) <= {half}")
    square = F.aggregate(F.zip_with("sp", "sq", lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda s, v: s + v)
    return pairs.withColumn("d", square).where(F.col("d") <= F.lit(rms * rms) * F.size("sp")).select(F.col("p").alias("a"), F.col("q").alias("b"), "d")


#: Sides of an image's main hash, side of its fast hash, and images of one bucket that one task holds on one side.
HASH_SIZES, FAST, DEAL = (16, 32, 64), 4, 32768


def image_hashes(planes: DataFrame, value: str, size: tuple[int, int], main: int = 16) -> DataFrame:
    """img, main, fast: gray values by area resampling to main x main, rounded, and their rounded means over 4 x 4 blocks, in row order.

    size: width and height of the images.  Pixels meet once, on their image;
    a task then resamples some hundred images at a time by two products with the
    taps.  Pixels that are absent or null count as 0, equal places add up.
    """
    kind = planes.schema["img"].dataType.simpleString()
    w, h = size
    point = F.struct(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col(value).cast("double").alias("v"))
    whole = planes.where(f"y between 0 and {h - 1} and x between 0 and {w - 1}").groupBy("img").agg(F.collect_list(point).alias("p"))

    def dense(p: pa.ListArray) -> np.ndarray:
        flat = p.flatten()
        of = np.repeat(np.arange(len(p)), p.value_lengths().to_numpy(zero_copy_only=False))
        y, x, v = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        return np.bincount((of * h + y) * w + x, np.nan_to_num(v), len(p) * h * w)

    return _hashed(whole, kind, size, main, dense)


def packed_image_hashes(planes: DataFrame, size: tuple[int, int], main: int = 16) -> DataFrame:
    """image_hashes of rows img, data: an image's values in row order as an array of numbers.

    The one shuffle carries arrays, no pixels.  Values that are absent or null
    count as 0, those beyond the image go, rows of one image add up.
    """
    kind = planes.schema["img"].dataType.simpleString()
    n = size[0] * size[1]
    whole = planes.where("size(data) > 0").groupBy("img").agg(F.collect_list("data").alias("p"))

    def dense(p: pa.ListArray) -> np.ndarray:
        rows = p.flatten()
        of, many = np.repeat(np.arange(len(p)), p.value_lengths().to_numpy(zero_copy_only=False)), rows.value_lengths().to_numpy(zero_copy_only=False)
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        v, within = np.nan_to_num(rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)), place < n
        return np.bincount((np.repeat(of, many) * n + place)[within], v[within], len(p) * n)

    return _hashed(whole, kind, size, main, dense)


def _hashed(whole: DataFrame, kind: str, size: tuple[int, int], main: int, dense: Callable[[pa.ListArray], np.ndarray]) -> DataFrame:
    """img, main, fast of (img, p); dense gives the pixels of some images, one image after another."""
    if main not in HASH_SIZES:
        raise ValueError(f"{main} is none of {HASH_SIZES}")
    (w, h), step = size, main // FAST

    def taps(n: int) -> np.ndarray:
        out = np.zeros((main, n))
        for d, s, share in area_taps(n, main):
            out[d, s] = share
        return out

    def run(batches):
        down, across = taps(h), taps(w).T
        for whole in batches:
            for k in range(0, whole.num_rows, 200):
                batch = whole.slice(k, 200)
                n = batch.num_rows
                cells = np.floor(np.round(down @ dense(batch.column("p")).reshape(n, h, w) @ across, 6) + 0.5).astype(np.int32)
                fast = (cells.reshape(n, FAST, step, FAST, step).sum((2, 4)) + step * step // 2) // (step * step)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * m), pa.array(c.reshape(-1).astype(np.int32))) for c, m in ((cells, main * main), (fast, FAST * FAST))]
                yield pa.record_batch([batch.column("img"), *lists], ["img", "main", "fast"])

    return whole.mapInArrow(run, f"img {kind}, main array<int>, fast array<int>")


def _pairs_of_cell(left: list, right: list | None, side: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places on both sides and difference of the similar pairs of (main, fast) of two sides, or of one with itself."""
    own = right is None
    (main, fast), (main_b, fast_b) = left, left if own else right
    n = main.shape[1]
    # around 0, so that all sums of a hash of 16 x 16 are whole in single precision
    kind = np.float32 if n * 128 * 128 * 4 <= 1 << 24 else np.float64
    norm, norm_b = ((m.astype(np.int64) - 128) ** 2 @ np.ones(n, np.int64) for m in (main, main_b))
    step = max(1, (1 << 18) // n)
    for j in range(0, len(main_b), step):
        b = main_b[j : j + step].astype(kind) - 128
        for i in range(0, min(len(main), j + len(b)) if own else len(main), step):
            a = main[i : i + step].astype(kind) - 128
            dots = a @ b.T
            dots *= -2
            dots += norm[i : i + step, None].astype(kind)
            dots += norm_b[None, j : j + step].astype(kind)
            p, q = np.nonzero(dots <= side * side * n)
            d, p, q = dots[p, q].astype(np.float64), p + i, q + j
            difference = np.sqrt(d / n) / 255
            apart = fast[p].astype(np.int64) - fast_b[q]
            good = ((apart * apart).sum(1) <= side * side * FAST * FAST) & (difference <= threshold) & ((p < q) if own else True)
            yield p[good], q[good], difference[good]


def similar_images(hashes: DataFrame, threshold: float = 0.05, normalized: bool = False, deal: int = DEAL) -> DataFrame:
    """a, b, difference of images a < b: root mean square difference of main hashes as a share of 255, at most `threshold`.

    Fast hashes rule pairs out, at the same mean square difference.  Sums of
    a fast hash with signs differ by 16 times that at most, so three of them -
    left against right, upper against lower half, and the sum, or with
    `normalized` images of one brightness the diagonals - deal images into buckets
    in which similar ones are neighbours: no pair is lost.  A bucket of many
    images is dealt out: a task holds `deal` of them on each side, packed, and
    compares them by products of matrices, some hundred by some hundred.
    """
    c = F.col
    side = int(threshold * 255)
    signs = {"bx": [1 if x < 2 else -1 for y in range(4) for x in range(4)], "by": [1 if y < 2 else -1 for y in range(4) for x in range(4)], "bz": [1 if not normalized or (y < 2) == (x < 2) else -1 for y in range(4) for x in range(4)]}
    kind = hashes.schema["img"].dataType.simpleString()

    def pack(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            main, fast = (batch.column(k).flatten().to_numpy().reshape(n, -1) for k in ("main", "fast"))
            keys = [pa.array((fast.astype(np.int64) @ np.array(s)) // (16 * side + 1)) for s in signs.values()]
            packed = [pa.array([r.tobytes() for r in v.astype(np.uint8)], pa.binary()) for v in (main, fast)]
            yield pa.record_batch([batch.column("img"), *packed, *keys], ["img", "main", "fast", *signs])

    own = kept(hashes.select("img", "main", "fast").where("img is not null").mapInArrow(pack, f"img {kind}, main binary, fast binary, bx long, by long, bz long"))
    sizes = own.groupBy(*signs).agg(F.ceil(F.count("*") / deal).cast("int").alias("deals"))
    # each pair of neighbouring buckets once: a bucket's own cells and those with the half of its neighbours that come after it
    at = F.struct(*signs)
    steps = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy"), F.lit(k).alias("dz")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    beside = sizes.select(at.alias("of"), c("deals").alias("own_deals"), F.explode(steps).alias("s"))
    beside = beside.select("of", "own_deals", F.struct((c("of.bx") + c("s.dx")).alias("bx"), (c("of.by") + c("s.dy")).alias("by"), (c("of.bz") + c("s.dz")).alias("bz")).alias("to"))
    beside = beside.join(sizes.select(at.alias("to"), "deals"), "to").groupBy("of", "own_deals").agg(F.collect_list(F.struct("to", "deals")).alias("near"))
    dealt = own.withColumn("of", at).drop(*signs).join(beside, "of").withColumn("deal", F.pmod(F.xxhash64("img"), c("own_deals")).cast("int"))
    every = F.flatten(F.transform("near", lambda z: F.transform(F.sequence(F.lit(0), z["deals"] - 1), lambda k: F.struct(z["to"].alias("to"), k.alias("deal")))))
    me = F.struct(c("of").alias("to"), c("deal").alias("deal"))
    cells = F.transform(every, lambda z: F.struct(F.least(me, z).alias("low"), F.greatest(me, z).alias("high"), (z < me).alias("right")))
    met = dealt.select("img", "main", "fast", F.explode(cells).alias("cell")).select("img", "main", "fast", "cell.low", "cell.high", c("cell.right").alias("right"))

    def compare(key, batches):
        sides: dict[bool, list] = {False: [], True: []}
        for batch in batches:
            right = batch.column("right").to_numpy(zero_copy_only=False)
            for k in (False, True):
                if (right == k).any():
                    sides[k].append(batch.filter(pa.array(right == k)))
        if not sides[False]:
            return
        ids, packed = {}, {}
        for k, found in sides.items():
            if found:
                ids[k] = pa.concat_arrays([b.column("img") for b in found])
                packed[k] = [np.concatenate([np.frombuffer(b"".join(b.column(name).to_pylist()), np.uint8).reshape(b.num_rows, -1) for b in found]) for name in ("main", "fast")]
        if True not in packed and key[0] != key[1]:
            return
        for p, q, difference in _pairs_of_cell(packed[False], packed.get(True), side, threshold):
            if len(p):
                yield pa.record_batch([ids[False].take(pa.array(p)), ids.get(True, ids[False]).take(pa.array(q)), pa.array(difference)], ["a", "b", "difference"])

    found = met.groupBy("low", "high").applyInArrow(_iterated(compare), f"a {kind}, b {kind}, difference double")
    return found.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "difference")


def _iterated(f):
    """f with the annotations by which Spark knows a function that takes and gives batches one by one."""
    f.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return f


def best_shift(df: DataFrame, current: str, background: str, reach: int) -> DataFrame:
    """(img, dy, dx, s, n): the shift of least mean absolute difference, ties by dy and dx.

    Pixels meet once, on their image; a task holds the planes of one image at a
    time and compares them shift by shift.  Pixels that are absent take no part;
    those with a null count in n only.
    """
    whole = all(df.schema[k].dataType.typeName() in ("byte", "short", "integer", "long") for k in (current, background))
    kind, total = df.schema["img"].dataType.simpleString(), "long" if whole else "double"

    def run(group: pa.Table) -> pa.Table:
        y, x = (group[k].to_numpy() for k in ("y", "x"))
        y, x = y - y.min(), x - x.min()
        h, w = int(y.max()) + 1, int(x.max()) + 1
        there, (known, planes) = np.zeros((h, w), bool), (np.zeros((2, h, w), bool), np.zeros((2, h, w), np.int64 if whole else np.float64))
        there[y, x] = True
        for k, name in enumerate("vw"):
            known[k][y, x] = group[name].is_valid().to_numpy()
            planes[k][y, x] = group[name].fill_null(0).to_numpy()
        best = None
        for dy in range(-reach, reach + 1):
            for dx in range(-reach, reach + 1):
                t, b, l, r = max(0, -dy), min(h, h - dy), max(0, -dx), min(w, w - dx)
                if t >= b or l >= r:
                    continue
                own, to = (slice(t, b), slice(l, r)), (slice(t + dy, b + dy), slice(l + dx, r + dx))
                n = int((there[own] & there[to]).sum())
                both = known[0][own] & known[1][to]
                s = np.abs(planes[0][own] - planes[1][to])[both].sum().item() if both.any() else None
                mean = s / n if s is not None else -1.0  # a null is less than all
                if n and (best is None or mean < best[0]):
                    best = mean, dy, dx, s, n
        return pa.table({"img": group["img"].slice(0, 1), **{k: pa.array([v], t) for k, v, t in zip(("dy", "dx", "s", "n"), best[1:], (pa.int64(), pa.int64(), pa.int64() if whole else pa.float64(), pa.int64()))}})

    rows = df.where("img is not null and y is not null and x is not null").select("img", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), *[F.col(k).cast(total).alias(n) for k, n in ((current, "v"), (background, "w"))])
    return rows.groupBy("img").applyInArrow(run, f"img {kind}, dy long, dx long, s {total}, n long")


def warp_nearest(df: DataFrame, value: str, inverse: tuple[float, ...], size: tuple[int, int], border: int) -> DataFrame:
    """Affine warp: a destination pixel takes the source pixel nearest to its inverse image, or the border value."""
    a, b, c, d, e, f = inverse
    grid = df.select("img", "y", "x").withColumns({"sx": F.floor(F.col("x") * a + F.col("y") * b + F.lit(c + 0.5)), "sy": F.floor(F.col("x") * d + F.col("y") * e + F.lit(f + 0.5))})
    source = df.select("img", F.col("y").alias("sy"), F.col("x").alias("sx"), F.col(value).alias("v"))
    return grid.join(source, ["img", "sy", "sx"], "left").select("img", "y", "x", F.coalesce("v", F.lit(border)).alias("v"))
