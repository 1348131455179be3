"""Queries on camera frames: motion detection and tracking by stream, shifts, contours."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import around, neighbourhood, pack, pixels, table
from ..operators import matching as M
from ..operators.contours import contours
from ..operators.shift import ShiftOptions, shifts
from ..streaming.motion import REWRITTEN, MotionOptions, motion
from ..streaming.run import micro_batches, replayed

QUERIES: dict = {}
SQL: dict = {}
#: A camera has FRAMES frames of the events table, each of WIDTH x HEIGHT pixels and STEP_MS after the one before.
FRAMES, WIDTH, HEIGHT, STEP_MS = 80, 96, 64, 100
#: Tasks that follow a table's cameras.
PARTS = 96
OPTIONS = MotionOptions(object_width=0.25, object_height=0.25)


@lru_cache(maxsize=303)
def texture(shift: int, noise: int) -> np.ndarray:
    y, x = np.arange(HEIGHT)[:, None], np.arange(WIDTH)[None]
    return ((x * 7 + y * 13 + shift) * 37 % 101 + 40 + (x + y + noise) % 3).astype(np.uint8)


def drawn(cam: int, frame: int, noise: int) -> np.ndarray:
    """A texture of the camera with noise; bright boxes that cross it from the 15th to the 60th frame; another light at the end for some."""
    plane = texture(cam * 29 % 101, noise % 3).copy()
    if 15 <= frame < 60:
        for k in range(1 + (cam % 3 == 0)):
            at_x, at_y = (cam * 11 % 20 + (frame - 15), cam * 7 % 40) if cam % 2 else (cam * 11 % 40 + 30 * k, (frame - 15) * 3 // 4)
            at_y = at_y if cam % 2 == 0 or k == 0 else (at_y + 32) % 44
            box = plane[at_y : at_y + 20, at_x : at_x + 28]
            np.minimum(box, 145, out=box)
            box += 110
    if cam % 7 == 0 and frame >= 66:
        plane = 255 - plane // 2
    return plane


def camera_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cam, ts, frame, noise: what a frame is drawn from, one for each event; every fifth camera is silent for 1.5 seconds."""
    e = table(spark, sf_dir, "events").select(F.expr(f"event_id div {FRAMES}").alias("cam"), (F.col("event_id") % FRAMES).cast("int").alias("frame"), F.floor(F.coalesce("value", F.lit(0.0))).cast("int").alias("noise"))
    e = e.where("cam % 5 <> 0 or frame not between 45 and 59")
    return e.select("cam", F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("frame") * STEP_MS).alias("ts"), "frame", "noise")


def planes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cam, ts, w, h, data: the frames of batches of camera_events, in their order."""
    for whole in batches:
        for k in range(0, whole.num_rows, 1000):  # about 6 MB of planes
            batch = whole.slice(k, 1000)
            data = [drawn(*r).tobytes() for r in zip(*(batch.column(c).to_pylist() for c in ("cam", "frame", "noise")))]
            n = batch.num_rows
            yield pa.record_batch([batch.column("cam"), batch.column("ts"), pa.array([WIDTH] * n, pa.int32()), pa.array([HEIGHT] * n, pa.int32()), pa.array(data, pa.binary())], ["cam", "ts", "w", "h", "data"])


def with_planes(events: DataFrame) -> DataFrame:
    """cam, ts, w, h, data: the frames of camera_events, drawn without a shuffle."""
    return events.mapInArrow(planes, "cam long, ts timestamp, w int, h int, data binary")


def _told(rows: DataFrame) -> DataFrame:
    """Times as milliseconds after the first frame."""
    return rows.select("cam", (F.unix_millis("ts") - 1_700_000_000_000).alias("ms"), "kind", "id", "l", "t", "r", "b", "x", "y", "n_places")


def motion_detector(spark: SparkSession, sf_dir: str, batches: int = 5) -> DataFrame:
    """Moving objects of all cameras, by a stream of `batches` micro-batches; the stream and its shuffle carry events, frames are drawn from them beside their camera's state."""
    events = micro_batches(camera_events(spark, sf_dir), "ts", batches)
    return _told(replayed(motion(events, OPTIONS, made=planes), settings=REWRITTEN))


def motion_detector_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same frames as one table; cameras that stay silent at the end keep their objects, as no timer comes.

    Events meet on their camera, and frames are drawn from them where they are looked at, so no frame is shuffled or sorted.
    """
    events = camera_events(spark, sf_dir).repartition(PARTS, "cam").sortWithinPartitions("cam", "ts")
    return _told(motion(events.where("cam is not null"), OPTIONS, ordered=True, made=planes))


# -- images by their hashes --------------------------------------------------------------------------------------
# An embedding is an image of 8 x 8 pixels; near embeddings are near images.

SIGN_W, SIGN_H = 8, 8


def signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """img, data of all embeddings: pixels in row order.  NaN is above all numbers, as in SQL."""
    v = lambda e: F.floor(F.nanvl(e.cast("double") * 120 + 128, F.lit(255.0)))
    pixel = lambda e: F.least(F.greatest(v(e), F.lit(0)), F.lit(255)).cast("short")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img"), F.transform("embedding", pixel).alias("data"))


_SIGN = f"""p AS (SELECT img, i // {SIGN_W} AS y, i % {SIGN_W} AS x, CAST(least(greatest(floor(e * 120 + 128), 0), 255) AS BIGINT) AS v FROM (SELECT vec_id AS img, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings))"""


def _hash_sql(main: int) -> str:
    step = main // 4
    axis = lambda n: f"(SELECT d, s, (least((d + 1) * {n} / {main}::DOUBLE, s + 1) - greatest(d * {n} / {main}::DOUBLE, s)) * {main} / {n} AS w FROM (SELECT unnest(range({main})) AS d), (SELECT unnest(range({n})) AS s) WHERE least((d + 1) * {n} / {main}::DOUBLE, s + 1) - greatest(d * {n} / {main}::DOUBLE, s) > 1e-12)"
    return f"""{_SIGN}, m AS (SELECT p.img, j.d AS y, i.d AS x, CAST(floor(round(sum(p.v * j.w * i.w), 6) + 0.5) AS BIGINT) AS v FROM p JOIN {axis(SIGN_H)} j ON j.s = p.y JOIN {axis(SIGN_W)} i ON i.s = p.x GROUP BY 1, 2, 3),
f AS (SELECT img, y // {step} AS y, x // {step} AS x, (CAST(sum(v) AS BIGINT) + {step * step // 2}) // {step * step} AS v FROM m GROUP BY 1, 2, 3)"""


THRESHOLD = 0.07
for _main in M.HASH_SIZES:
    QUERIES[f"image_hash_{_main}"] = lambda s, d, n=_main: M.packed_image_hashes(signs(s, d), (SIGN_W, SIGN_H), n).select("img", F.array_join(F.col("main").cast("array<string>"), " ").alias("main"), F.array_join(F.col("fast").cast("array<string>"), " ").alias("fast"))
    SQL[f"image_hash_{_main}"] = f"WITH {_hash_sql(_main)}, a AS (SELECT img, string_agg(v, ' ' ORDER BY y, x) AS main FROM m GROUP BY img), b AS (SELECT img, string_agg(v, ' ' ORDER BY y, x) AS fast FROM f GROUP BY img) SELECT img, main, fast FROM a JOIN b USING (img)"
for _name, _normal in (("similar_images", False), ("similar_images_normalized", True)):
    QUERIES[_name] = lambda s, d, k=_normal: M.similar_images(M.packed_image_hashes(signs(s, d), (SIGN_W, SIGN_H)), THRESHOLD, k).select("a", "b", F.round("difference", 6).alias("difference"))
    _side = int(THRESHOLD * 255)
    SQL[_name] = f"""WITH {_hash_sql(16)}, a AS (SELECT img, list(v ORDER BY y, x) AS main FROM m GROUP BY img), b AS (SELECT img, list(v ORDER BY y, x) AS fast FROM f GROUP BY img), h AS (SELECT img, main, fast FROM a JOIN b USING (img)),
q AS (SELECT p.img AS a, q.img AS b, list_sum(list_transform(list_zip(p.fast, q.fast), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS fd, p.main AS pm, q.main AS qm FROM h p JOIN h q ON p.img < q.img),
r AS (SELECT a, b, list_sum(list_transform(list_zip(pm, qm), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM q WHERE fd <= {_side * _side * 16})
SELECT a, b, round(sqrt(d / 256::DOUBLE) / 255, 6) AS difference FROM r WHERE d <= {_side * _side * 256} AND sqrt(d / 256::DOUBLE) / 255 <= {THRESHOLD}::DOUBLE"""

# -- shifts and contours of the pixel planes ----------------------------------------------------------------

REGION = (10, 6, 40, 24)


def shifted_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A smooth background for each image, and a part of it from (img % 7 - 3, img % 5 - 2) away with noise."""
    n = neighbourhood(pixels(spark, sf_dir).select("img", "y", "x", "a", "b"), "a", 2)
    smooth = n.select("img", "y", "x", "b", F.floor(sum(around(2), F.lit(0)) / 25).alias("v"))
    smooth = neighbourhood(smooth, "v", 2).select("img", "y", "x", "b", F.floor(sum(around(2), F.lit(0)) / 25).alias("v"))
    l, t, r, b = REGION
    tx, ty = F.col("img") % 7 - 3, F.col("img") % 5 - 2
    picture = smooth.select("img", (F.col("y") - ty - t).alias("y"), (F.col("x") - tx - l).alias("x"), (F.col("v") + F.col("b") % 2).alias("v")).where(f"y between 0 and {b - t - 1} and x between 0 and {r - l - 1}")
    front = pack(picture, "v").select("img", F.col("w").alias("pw"), F.col("h").alias("ph"), F.col("data").alias("picture"))
    return pack(smooth, "v").withColumnRenamed("data", "background").join(front, "img").select("*", F.lit(l).alias("x0"), F.lit(t).alias("y0"))


def _shift(options: ShiftOptions):
    fine = [f"round({k}, 6) as {k}" for k in ("fine_dx", "fine_dy", "stability", "correlation")]
    return lambda spark, sf_dir: shifts(shifted_pairs(spark, sf_dir), options).selectExpr("img", "found", "dx", "dy", *fine)


QUERIES["shift_detector_levels"] = _shift(ShiftOptions(levels=3, max_x=8, max_y=8, penalty=0.5))
QUERIES["shift_detector_levels_squared"] = _shift(ShiftOptions(levels=3, max_x=8, max_y=8, squared=True))
QUERIES["shift_detector_levels_gradients"] = _shift(ShiftOptions(levels=2, max_x=8, max_y=8, gradients=True))
QUERIES["contour_detector"] = lambda spark, sf_dir: contours(pixels(spark, sf_dir), "a", gradient=420, shortest=3)

QUERIES["motion_detector"] = motion_detector
QUERIES["motion_detector_table"] = motion_detector_table
