"""Queries on rectangles, shapes, format dispatch, streams and the relational operations around them, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color as C
from ..model import HEIGHT as H
from ..model import PIXELS_SQL as P
from ..model import WIDTH as W
from ..model import pack, pixels, table, unpack
from ..operators import geometry as G
from ..operators.grouping import grouped
from ..operators.layers import exploded
from ..operators.training import Network
from ..sources.images import encoded, read_images
from ..sources.sink import write_files
from ..streaming.background import background_range, windowed_statistic
from ..streaming.run import numbered_batches, replayed, shared_folder
from . import frames, images
from .detection import DIFFER, GROUPED_SQL, LEAST
from .formats import planes
from .images import _forward_sql
from .vectors import _EV

QUERIES: dict = {}
SQL: dict = {}
c = F.col
KEY = ["img", "y", "x"]


def add(name: str, f, sql: str | None) -> None:
    QUERIES[name] = f
    if sql is not None:
        SQL[name] = sql


# -- rectangles -----------------------------------------------------------------------------------------
# Twenty rectangles an image; every fourth starts a spot, the others lie near it.

_SPOT = "(p_partkey // 4 * 4)"
R = f"r AS (SELECT p_partkey // 20 AS img, p_partkey AS id, {_SPOT} * 37 % 90 + p_partkey * 5 % 4 AS l, {_SPOT} * 53 % 70 + p_partkey * 3 % 4 AS t, {_SPOT} * 37 % 90 + p_partkey * 5 % 4 + 8 + {_SPOT} % 13 AS r, {_SPOT} * 53 % 70 + p_partkey * 3 % 4 + 9 + {_SPOT} % 11 AS b FROM part)"


def rectangles(spark, sf_dir) -> DataFrame:
    """img, id, l, t, r, b."""
    spot, k = F.expr("p_partkey div 4 * 4"), c("p_partkey")
    left, top = spot * 37 % 90 + k * 5 % 4, spot * 53 % 70 + k * 3 % 4
    return table(spark, sf_dir, "part").select(F.expr("p_partkey div 20").alias("img"), k.alias("id"), left.alias("l"), top.alias("t"), (left + 8 + spot % 13).alias("r"), (top + 9 + spot % 11).alias("b"))


def pairs(spark, sf_dir) -> DataFrame:
    """A rectangle beside the one of the next id in its image."""
    r = rectangles(spark, sf_dir)
    return r.join(r.select("img", (c("id") - 1).alias("id"), *[c(k).alias(k + "2") for k in "ltrb"]), ["img", "id"])


def algebra(spark, sf_dir) -> DataFrame:
    p = pairs(spark, sf_dir)
    low, high = {k: F.greatest(k, k + "2") for k in "lt"}, {k: F.least(k, k + "2") for k in "rb"}
    return p.select(
        "id",
        F.least("l", "l2").alias("ul"),
        F.least("t", "t2").alias("ut"),
        F.greatest("r", "r2").alias("ur"),
        F.greatest("b", "b2").alias("ub"),
        (F.greatest(high["r"] - low["l"], F.lit(0)) * F.greatest(high["b"] - low["t"], F.lit(0))).alias("common"),
        ((c("l2") >= c("l")) & (c("t2") >= c("t")) & (c("r2") <= c("r")) & (c("b2") <= c("b"))).alias("holds"),
        (F.pow(F.expr("(l + r) div 2 - (l2 + r2) div 2"), 2) + F.pow(F.expr("(t + b) div 2 - (t2 + b2) div 2"), 2)).cast("long").alias("apart"),
        (c("l") - 2).alias("bl"),
        (c("b") + 2).alias("bb"),
    )


add(
    "rectangle_algebra",
    algebra,
    f"WITH {R} SELECT p.id, least(p.l, q.l) AS ul, least(p.t, q.t) AS ut, greatest(p.r, q.r) AS ur, greatest(p.b, q.b) AS ub, greatest(least(p.r, q.r) - greatest(p.l, q.l), 0) * greatest(least(p.b, q.b) - greatest(p.t, q.t), 0) AS common, q.l >= p.l AND q.t >= p.t AND q.r <= p.r AND q.b <= p.b AS holds, CAST(pow((p.l + p.r) // 2 - (q.l + q.r) // 2, 2) + pow((p.t + p.b) // 2 - (q.t + q.b) // 2, 2) AS BIGINT) AS apart, p.l - 2 AS bl, p.b + 2 AS bb FROM r p JOIN r q ON q.img = p.img AND q.id = p.id + 1",
)
add("detection_grouping", lambda s, d: grouped(rectangles(s, d).drop("id"), LEAST, DIFFER), f"WITH RECURSIVE {R}, {GROUPED_SQL}")


def linked(spark, sf_dir) -> DataFrame:
    """Rectangles linked to those of the image before, one to one: id, was (-1 for a new one), d.

    A rectangle asks for the nearest one before by centre, ties to the lesser id;
    of those that ask for it and of which one holds the other's centre, a
    rectangle takes the nearest.
    """
    r = rectangles(spark, sf_dir).select("img", "id", *"ltrb", F.expr("(l + r) div 2").alias("cx"), F.expr("(t + b) div 2").alias("cy"))
    # the rectangles of an image come as one list, so that a task holds no pairs
    before = r.groupBy((c("img") + 1).alias("img")).agg(F.collect_list(F.struct("id", *"ltrb", "cx", "cy")).alias("before"))
    holds = lambda l, t, r, b, x, y: (x >= l) & (x < r) & (y >= t) & (y < b)

    def asks(p: Column) -> Column:
        far = (c("cx") - p["cx"]) * (c("cx") - p["cx"]) + (c("cy") - p["cy"]) * (c("cy") - p["cy"])
        near = holds(*map(c, "ltrb"), p["cx"], p["cy"]) | holds(*(p[k] for k in "ltrb"), c("cx"), c("cy"))
        return F.struct(far.alias("d"), p["id"].alias("was"), near.alias("near"))

    asked = r.join(before, "img").select("id", F.array_min(F.transform("before", asks)).alias("m"))
    taken = asked.where("m.near").groupBy("m.was").agg(F.min(F.struct("m.d", "id")).alias("t"))
    links = taken.select(c("t.id").alias("id"), "was", c("t.d").alias("d"))
    return r.select("id").join(links, "id", "left").select("id", F.coalesce("was", F.lit(-1)).alias("was"), F.coalesce("d", F.lit(-1)).alias("d"))


add(
    "tracking_link",
    linked,
    f"""WITH {R}, k AS (SELECT *, (l + r) // 2 AS cx, (t + b) // 2 AS cy FROM r),
q AS (SELECT a.id, b.id AS was, (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) AS d,
b.cx >= a.l AND b.cx < a.r AND b.cy >= a.t AND b.cy < a.b OR a.cx >= b.l AND a.cx < b.r AND a.cy >= b.t AND a.cy < b.b AS near
FROM k a JOIN k b ON b.img = a.img - 1 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY d, b.id) = 1),
s AS (SELECT * FROM q WHERE near QUALIFY row_number() OVER (PARTITION BY was ORDER BY d, id) = 1)
SELECT k.id, coalesce(s.was, -1) AS was, coalesce(s.d, -1) AS d FROM k LEFT JOIN s ON s.id = k.id""",
)


def onvif(spark, sf_dir) -> DataFrame:
    x, y = (2 * c("l") - 100) / F.lit(100.0), (80 - 2 * c("t")) / F.lit(80.0)
    back = lambda v, n: F.least(F.greatest(F.rint(v * n / 2).cast("long"), F.lit(0)), F.lit(n - 1))
    return rectangles(spark, sf_dir).select("id", x.alias("ox"), y.alias("oy"), back(1 + x * F.lit(1.1), 100).alias("sx"), back(1 - y * F.lit(1.1), 80).alias("sy"))


_OX, _OY = "((2 * l - 100) / 100.0::DOUBLE)", "((80 - 2 * t) / 80.0::DOUBLE)"
add("onvif_coordinates", onvif, f"WITH {R} SELECT id, {_OX} AS ox, {_OY} AS oy, least(greatest(CAST(round_even((1 + {_OX} * 1.1::DOUBLE) * 100 / 2, 0) AS BIGINT), 0), 99) AS sx, least(greatest(CAST(round_even((1 - {_OY} * 1.1::DOUBLE) * 80 / 2, 0) AS BIGINT), 0), 79) AS sy FROM r")
_TURNS = {0: "rotate_0", 1: "rotate_90", 2: "rotate_180", 3: "rotate_270", 4: "transpose_rotate_0", 5: "transpose_rotate_90", 6: "transpose_rotate_180", 7: "transpose_rotate_270"}
_SWAPS = ("rotate_90", "rotate_270", "transpose_rotate_0", "transpose_rotate_180")


def turned_sizes(spark, sf_dir) -> DataFrame:
    """Width and height after each transform, from where a transform puts the last pixel."""
    r = rectangles(spark, sf_dir).select("id", (c("r") - c("l")).alias("w"), (c("b") - c("t")).alias("h"))
    out = []
    for k, name in _TURNS.items():
        y0, x0 = G.TRANSFORMS[name](F.lit(0), F.lit(0), c("h") - 1, c("w") - 1)
        y1, x1 = G.TRANSFORMS[name](c("h") - 1, c("w") - 1, c("h") - 1, c("w") - 1)
        out.append(F.struct(F.lit(k).alias("turn"), (F.abs(x1 - x0) + 1).alias("tw"), (F.abs(y1 - y0) + 1).alias("th")))
    return r.select("id", F.explode(F.array(*out)).alias("s")).select("id", "s.*")


_CASE = "turn IN (" + ", ".join(str(k) for k, n in _TURNS.items() if n in _SWAPS) + ")"
add("transform_size", turned_sizes, f"WITH {R} SELECT id, CAST(turn AS INTEGER) AS turn, CASE WHEN {_CASE} THEN b - t ELSE r - l END AS tw, CASE WHEN {_CASE} THEN r - l ELSE b - t END AS th FROM r, (SELECT unnest(range(8)) AS turn)")

# -- shapes: a pixel is in a shape or not --------------------------------------------------------------------

POLYGON = ((5, 3), (40, 8), (33, 26), (20, 14), (8, 25))


def in_polygon(corners, y: Column, x: Column) -> Column:
    """Even-odd rule at a pixel's centre."""
    odd = F.lit(0)
    for (x1, y1), (x2, y2) in zip(corners, [*corners[1:], corners[0]]):
        if y1 == y2:
            continue
        between = (F.lit(min(y1, y2)) <= y) & (y < F.lit(max(y1, y2)))
        # multiplied out, so that all numbers stay whole
        beyond = (x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)
        odd = odd + F.when(between & ((beyond > 0) if y2 > y1 else (beyond < 0)), 1).otherwise(0)
    return odd % 2 == 1


def shape(name: str, inside: Callable[[], Column], sql: str) -> None:
    add(name, lambda s, d: pixels(s, d).select(*KEY, F.when(inside(), 250).otherwise(c("a")).alias("v")), f"WITH {P} SELECT img, y, x, CASE WHEN {sql} THEN 250 ELSE a END AS v FROM p")


shape("draw_filled_rectangle", lambda: c("y").between(4, 25) & c("x").between(6, 43), "y BETWEEN 4 AND 25 AND x BETWEEN 6 AND 43")
shape("draw_circle", lambda: (c("x") - 22) * (c("x") - 22) + (c("y") - 14) * (c("y") - 14) <= 100, "pow(x - 22, 2) + pow(y - 14, 2) <= 100")
shape("draw_ellipse", lambda: (c("x") - 25) * (c("x") - 25) * 81 + (c("y") - 15) * (c("y") - 15) * 400 <= 400 * 81, "pow(x - 25, 2) / 400 + pow(y - 15, 2) / 81 <= 1")
_EDGES = " + ".join(f"CASE WHEN y >= {min(b, e)} AND y < {max(b, e)} AND {a} + (y - {b}) * {d - a} / {float(e - b)}::DOUBLE < x THEN 1 ELSE 0 END" for (a, b), (d, e) in zip(POLYGON, [*POLYGON[1:], POLYGON[0]]) if b != e)
shape("draw_filled_polygon", lambda: in_polygon(POLYGON, c("y"), c("x")), f"({_EDGES}) % 2 = 1")
add("view_flipped", lambda s, d: pixels(s, d).select("img", (H - 1 - c("y")).alias("y"), "x", c("a").alias("v")), f"WITH {P} SELECT img, {H - 1} - y AS y, x, a AS v FROM p")
add("view_clear", lambda s, d: pixels(s, d).select(*KEY, F.lit(0).cast("long").alias("v")), f"WITH {P} SELECT img, y, x, 0 AS v FROM p")
_LOW, _UP = (-1.0, -0.5, 0.0), (1.0, 0.5, 2.0)


def network_input(spark, sf_dir) -> DataFrame:
    """A colour image as a float tensor of three planes, each with bounds of its own."""
    planes_ = F.array(*[F.struct(F.lit(k).cast("long").alias("ch"), F.round(c(v) * ((_UP[k] - _LOW[k]) / 255) + _LOW[k], 5).alias("v")) for k, v in enumerate("abc")])
    return pixels(spark, sf_dir).select(*KEY, F.explode(planes_).alias("s")).select("img", "s.ch", "y", "x", "s.v")


add("synet_set_input", network_input, f"WITH {P} " + " UNION ALL ".join(f"SELECT img, CAST({k} AS BIGINT) AS ch, y, x, round({v} * {(_UP[k] - _LOW[k]) / 255!r}::DOUBLE + {_LOW[k]!r}::DOUBLE, 5) AS v FROM p" for k, v in enumerate("abc")))

# -- dispatch by format and method ----------------------------------------------------------------------------

_BGR = ("b", "g", "r")
#: Format -> expressions of blue, green, red and alpha from its channels v0, v1, ...
READ: dict[str, Callable] = {
    "gray": lambda v: (v[0], v[0], v[0], F.lit(255)),
    "bgr": lambda v: (v[0], v[1], v[2], F.lit(255)),
    "rgb": lambda v: (v[2], v[1], v[0], F.lit(255)),
    "bgra": lambda v: tuple(v[:4]),
    "rgba": lambda v: (v[2], v[1], v[0], v[3]),
    "yuv": lambda v: (*C.yuv_to_bgr(v[0], v[1], v[2]).values(), F.lit(255)),
}
#: Format -> its channels from blue, green, red and alpha.
WRITE: dict[str, Callable] = {
    "gray": lambda b, g, r, a: [C.gray(b, g, r)],
    "bgr": lambda b, g, r, a: [b, g, r],
    "rgb": lambda b, g, r, a: [r, g, b],
    "bgra": lambda b, g, r, a: [b, g, r, a],
    "rgba": lambda b, g, r, a: [r, g, b, a],
    "hsv": lambda b, g, r, a: list(C.bgr_to_hsv(b, g, r).values()),
    "hsl": lambda b, g, r, a: list(C.bgr_to_hsl(b, g, r).values()),
    "yuv": lambda b, g, r, a: list(C.bgr_to_yuv(b, g, r).values()),
}


def converted(df: DataFrame, source: list[str], from_: str, to: str) -> DataFrame:
    """Any format to any other, pixel by pixel: a projection put together from the two formats' rules."""
    if from_ not in READ or to not in WRITE:
        raise ValueError(f"no conversion from {from_} to {to}")
    out = WRITE[to](*READ[from_]([c(k) for k in source]))
    return df.select(*KEY, *[v.cast("long").alias(f"v{i}") for i, v in enumerate(out)])


_Y = _forward_sql("bt601")
_GRAY = lambda b, g, r: f"(1868 * {b} + 9617 * {g} + 4899 * {r} + 8192) >> 14"
for _from, _to, _cols in (
    ("rgba", "gray", [_GRAY("c", "b", "a")]),
    ("gray", "bgra", ["a", "a", "a", "255"]),
    ("rgba", "bgra", ["c", "b", "a", "al"]),
    ("bgra", "rgb", ["c", "b", "a"]),
    ("bgr", "yuv", [_Y["y"], _Y["u"], _Y["v"]]),
):
    add(f"convert_view_{_from}_to_{_to}", lambda s, d, f=_from, t=_to: converted(pixels(s, d), ["a", "b", "c", "al"], f, t), f"WITH {P} SELECT img, y, x, " + ", ".join(f"CAST({v} AS BIGINT) AS v{i}" for i, v in enumerate(_cols)) + " FROM p")


def converted_frame(df: DataFrame, from_: str, to: str) -> DataFrame:
    """A frame of one pixel format as planes of another: img, plane, y, x, v."""
    b, g, r, a = READ[from_]([c(k) for k in ("a", "b", "c", "al")])
    plain = df.select(*KEY, b.alias("a"), g.alias("b"), r.alias("c"), a.cast("long").alias("al"))
    cell = {"yuv444p": (1, 1), "yuv422p": (1, 2), "yuv420p": (2, 2)}[to]
    return planes(plain, *cell, "bt601")


_f = _forward_sql("bt601")
_m = ", m AS (SELECT img, y // 2 AS y, x // 2 AS x, " + ", ".join(f"(CAST(sum({k}) AS BIGINT) + 2) // 4 AS {k}" for k in "abc") + " FROM q GROUP BY 1, 2, 3)"
add(
    "convert_frame_rgba_to_yuv420p",
    lambda s, d: converted_frame(pixels(s, d), "rgba", "yuv420p"),
    f"WITH {P}, q AS (SELECT img, y, x, c AS a, b, a AS c FROM p){_m} SELECT img, 'y' AS plane, y, x, CAST({_f['y']} AS BIGINT) AS v FROM q UNION ALL SELECT img, 'u', y, x, CAST({_f['u']} AS BIGINT) FROM m UNION ALL SELECT img, 'v', y, x, CAST({_f['v']} AS BIGINT) FROM m",
)

#: name -> (value, derivative from the value) of the layers' activations.
FUNCTIONS: dict[str, tuple[Callable, Callable]] = {
    "identity": (lambda x: x, lambda y: F.lit(1.0)),
    "tanh": (F.tanh, lambda y: 1 - y * y),
    "sigmoid": (lambda x: 1 / (1 + F.exp(-x)), lambda y: y * (1 - y)),
    "relu": (lambda x: F.greatest(x, F.lit(0.0)), lambda y: F.when(y > 0, 1.0).otherwise(0.0)),
    "leaky_relu": (lambda x: F.when(x > 0, x).otherwise(0.01 * x), lambda y: F.when(y > 0, 1.0).otherwise(0.01)),
}
_FN = {"identity": ("v", "1::DOUBLE"), "tanh": ("tanh(v)", "1 - tanh(v) * tanh(v)"), "sigmoid": ("1 / (1 + exp(-v))", "exp(-v) / ((1 + exp(-v)) * (1 + exp(-v)))"), "relu": ("CASE WHEN v > 0 THEN v ELSE 0 END", "CASE WHEN v > 0 THEN 1::DOUBLE ELSE 0 END"), "leaky_relu": ("CASE WHEN v > 0 THEN v ELSE 0.01::DOUBLE * v END", "CASE WHEN v > 0 THEN 1::DOUBLE ELSE 0.01::DOUBLE END")}


def activations(spark, sf_dir) -> DataFrame:
    x = table(spark, sf_dir, "embeddings").select(c("vec_id").alias("t"), F.posexplode("embedding")).select("t", c("pos").cast("long").alias("i"), c("col").cast("double").alias("x"))
    for name, (f, _) in FUNCTIONS.items():
        x = x.withColumn(name, f(c("x")))
    return x.select("t", "i", *[F.round(c(n), 5).alias(n) for n in FUNCTIONS], *[F.round(g(c(n)), 5).alias("d_" + n) for n, (_, g) in FUNCTIONS.items()])


add("neural_activations", activations, "WITH v AS (SELECT vec_id AS t, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) SELECT t, CAST(i AS BIGINT) AS i, " + ", ".join(f"round({f}, 5) + 0::DOUBLE AS {n}" for n, (f, _) in _FN.items()) + ", " + ", ".join(f"round({g}, 5) + 0::DOUBLE AS d_{n}" for n, (_, g) in _FN.items()) + " FROM v")

# -- a network -------------------------------------------------------------------------------------------------

CLASSES, STEPS = 2, 8


def _weights() -> list[np.ndarray]:
    """Fixed weights of 64, 3 and 2 units."""
    one = np.array([[((i * 7 + o * 3) % 11 - 5) * 0.1 for o in range(3)] for i in range(65)])
    two = np.array([[((i * 5 + o * 2) % 7 - 3) * 0.3 for o in range(2)] for i in range(4)])
    return [one, two]


def predicted(spark, sf_dir) -> DataFrame:
    net = Network((64, 3, CLASSES), weights=_weights())
    return exploded(net.predict(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), 5)


add(
    "network_predict",
    predicted,
    """WITH v AS (SELECT vec_id AS t, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
h AS (SELECT t, o, tanh(sum(v * ((((i * 7 + o * 3) % 11) - 5) * 0.1::DOUBLE)) + any_value((((64 * 7 + o * 3) % 11) - 5) * 0.1::DOUBLE)) AS v FROM v, (SELECT unnest(range(3)) AS o) GROUP BY 1, 2),
z AS (SELECT t, p, exp(sum(v * ((((o * 5 + p * 2) % 7) - 3) * 0.3::DOUBLE)) + any_value((((3 * 5 + p * 2) % 7) - 3) * 0.3::DOUBLE)) AS e FROM h, (SELECT unnest(range(2)) AS p) GROUP BY 1, 2)
SELECT t, CAST(p AS BIGINT) AS i, round(e / sum(e) OVER (PARTITION BY t), 5) AS v FROM z""",
)


def trained(spark, sf_dir) -> DataFrame:
    """Mean loss before each of STEPS steps on all embeddings and the parity of their label; tests hold it against one machine's sums."""
    rows = table(spark, sf_dir, "embeddings").select("embedding", F.pmod("label", F.lit(CLASSES)).alias("label"))
    losses = Network((64, 8, CLASSES)).train(rows, "embedding", "label", STEPS)
    return spark.createDataFrame([(k, v) for k, v in enumerate(losses)], "step long, loss double")


add("network_train", trained, None)

# -- methods chosen by name ---------------------------------------------------------------------------------------


def by_name(name: str, methods: dict[str, str], queries: dict, sql: dict) -> None:
    """The methods of one operator under one query, a column saying which."""

    def run(s, d) -> DataFrame:
        out = None
        for kind, query in methods.items():
            some = queries[query](s, d).withColumn("kind", F.lit(kind))
            out = some if out is None else out.unionByName(some)
        return out

    add(name, run, " UNION ALL BY NAME ".join(f"(SELECT *, '{kind}' AS kind FROM ({sql[query]}))" for kind, query in methods.items()))


by_name("reduce_gray", {k: f"reduce_gray_{k}" for k in ("2x2", "3x3", "4x4", "5x5")}, {**images.QUERIES, **frames.QUERIES}, {**images.SQL, **frames.SQL})

# -- joins in time, JSON, approximate counts -------------------------------------------------------------------


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """left with the latest `value` of right at or before its time: one union and one window, no pairs."""
    both = left.select(key, time, F.lit(1).alias("asks"), F.col("id"), F.lit(None).cast(right.schema[value].dataType).alias(value)).unionByName(right.select(key, time, F.lit(0).alias("asks"), F.lit(None).cast("long").alias("id"), value))
    w = Window.partitionBy(key).orderBy(time, "asks", F.coalesce("id", F.lit(-1))).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("asks = 1").select("id", value)


def last_purchase(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").select(c("event_id").alias("id"), "ts", "user_id", "event_type", F.floor(c("value") * 100).alias("v"))
    bought = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("v").alias("v"))
    return as_of(e.where("event_type <> 'purchase'").select("id", "ts", "user_id"), bought, "user_id", "ts", "v").withColumn("v", F.coalesce("v", F.lit(-1)))


add("as_of_join", last_purchase, "WITH e AS (SELECT event_id AS id, ts, user_id, event_type, CAST(floor(value * 100) AS BIGINT) AS v FROM events), b AS (SELECT user_id, ts, max(v) AS v FROM e WHERE event_type = 'purchase' GROUP BY 1, 2) SELECT e.id, coalesce(b.v, -1) AS v FROM e ASOF LEFT JOIN b ON e.user_id = b.user_id AND e.ts >= b.ts WHERE e.event_type <> 'purchase'")
_GAP = 3600


def within_an_hour(spark, sf_dir) -> DataFrame:
    """Clicks with the user's purchases in the hour after them: both meet in buckets of an hour, a click also in the next one."""
    e = table(spark, sf_dir, "events").select(c("event_id").alias("id"), F.unix_micros(c("ts").cast("timestamp")).alias("at"), "user_id", "event_type")
    bucket = F.floor(c("at") / (_GAP * 1_000_000))
    click = e.where("event_type = 'click'").select("id", "user_id", "at", F.explode(F.array(bucket, bucket + 1)).alias("bucket"))
    bought = e.where("event_type = 'purchase'").select("user_id", c("id").alias("bought"), c("at").alias("then"), bucket.alias("bucket"))
    return click.join(bought, ["user_id", "bucket"]).where(f"then between at and at + {_GAP * 1_000_000}").select("id", "bought")


add("interval_join", within_an_hour, f"SELECT a.event_id AS id, b.event_id AS bought FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts AND a.ts + INTERVAL {_GAP} SECOND")
add(
    "event_properties",
    lambda s, d: table(s, d, "events").groupBy(F.date_trunc("day", "ts").alias("day"), F.upper("event_type").alias("kind")).agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"), F.max(F.size(F.map_keys(F.from_json("props", "map<string,string>")))).cast("long").alias("keys")),
    "SELECT date_trunc('day', ts) AS day, upper(event_type) AS kind, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k, CAST(max(len(json_keys(props))) AS BIGINT) AS keys FROM events GROUP BY 1, 2",
)


def approximate(spark, sf_dir) -> DataFrame:
    """Distinct values of each image by a sketch, and of all images by the union of the sketches (img -1), with medians.

    So few values are counted without error by a sketch of 2^12 places, and a
    quantile of a thousandth by the sketch is one of the values.
    """
    sketch = pixels(spark, sf_dir).groupBy("img").agg(F.hll_sketch_agg("a", 12).alias("s"), F.percentile_approx("b", 0.5, 10_000).cast("long").alias("median"))
    union = sketch.agg(F.lit(-1).cast("long").alias("img"), F.hll_union_agg("s").alias("s"), F.max("median").alias("median"))
    return sketch.unionByName(union).select("img", F.hll_sketch_estimate("s").alias("distinct_values"), "median")


_MID = "SELECT img, CAST(b AS BIGINT) AS b FROM p QUALIFY row_number() OVER (PARTITION BY img ORDER BY b) = (count(*) OVER (PARTITION BY img) + 1) // 2"
add("approximate_aggregates", approximate, f"WITH {P}, m AS ({_MID}), d AS (SELECT img, count(DISTINCT a) AS n FROM p GROUP BY img) SELECT img, n AS distinct_values, b AS median FROM d JOIN m USING (img) UNION ALL SELECT -1, (SELECT count(DISTINCT a) FROM p), (SELECT max(b) FROM m)")


@F.udtf(returnType="begin: bigint, length: bigint")
class Spans:
    """Runs of an array's elements that equal a value."""

    def eval(self, row: list[int], value: int):
        begin = None
        for k, v in enumerate([*(row or []), None]):
            if v == value and begin is None:
                begin = k
            elif v != value and begin is not None:
                yield begin, k - begin
                begin = None


def mask_spans(spark, sf_dir) -> DataFrame:
    """img, y, begin, length: spans of mask 2 in each row, by a table function."""
    rows = pixels(spark, sf_dir).groupBy("img", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "m"))), lambda z: z["m"]).alias("row"))
    spark.udtf.register("quiltra_spans", Spans)
    return spark.sql("SELECT img, y, begin, length FROM {rows}, LATERAL quiltra_spans(row, 2)", rows=rows)


add("mask_spans", mask_spans, f"WITH {P}, k AS (SELECT img, y, x, x - row_number() OVER (PARTITION BY img, y ORDER BY x) AS g FROM p WHERE m = 2) SELECT img, y, min(x) AS begin, count(*) AS length FROM k GROUP BY img, y, g")


def trimmed(spark, sf_dir) -> DataFrame:
    """Mean of each row of an image without its tenth of least and of largest values, by a grouped aggregate over Arrow batches."""

    @F.pandas_udf("double")
    def mean(v: pd.Series) -> float:
        cut = len(v) // 10
        return float(v.sort_values().iloc[cut : len(v) - cut].mean())

    return pixels(spark, sf_dir).groupBy("img", "y").agg(F.round(mean("a"), 6).alias("mean"))


add("trimmed_row_means", trimmed, f"WITH {P}, k AS (SELECT img, y, a, row_number() OVER (PARTITION BY img, y ORDER BY a) AS r, count(*) OVER (PARTITION BY img, y) AS n FROM p) SELECT img, y, round(sum(a)::DOUBLE / count(*), 6) AS mean FROM k WHERE r > n // 10 AND r <= n - n // 10 GROUP BY img, y")

# -- image files ----------------------------------------------------------------------------------------------------


def saved_and_loaded(spark, sf_dir, kind: str) -> DataFrame:
    """The images written as files of a kind and read again from their folder."""
    folder = f"{shared_folder(spark)}/images-{uuid.uuid4().hex}"
    planes_ = pack(pixels(spark, sf_dir), "a").withColumn("channels", F.lit(1))
    write_files(encoded(planes_, kind).select(F.format_string(f"%012d.{kind}", "img").alias("name"), "content"), folder)
    back = read_images(spark, f"{folder}/*.{kind}").where("data is not null")
    return unpack(back.select(F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("long").alias("img"), "w", "h", "data"))


for _kind in ("png", "pgm"):
    add(f"image_files_{_kind}", lambda s, d, kind=_kind: saved_and_loaded(s, d, kind), f"WITH {P} SELECT img, y, x, a AS v FROM p")

# -- real streams, read up and given back --------------------------------------------------------------------------


BATCHES = 4


def readings(spark, sf_dir) -> DataFrame:
    """The events table as a stream of (key, seq, v, ts), in BATCHES micro-batches by id."""
    e = table(spark, sf_dir, "events")
    e = e.select(c("user_id").alias("key"), c("event_id").alias("seq"), (F.floor(c("value") * 10) % 256).alias("v"), c("ts").cast("timestamp").alias("ts"))
    most = (e.agg(F.max("seq")).first()[0] or 0) + 1
    return numbered_batches(e, F.expr(f"seq * {BATCHES} div {most}"), BATCHES)


add("stream_background_model", lambda s, d: replayed(background_range(readings(s, d).select("key", "seq", "v"))), f"WITH {_EV} SELECT user_id AS key, event_id AS seq, min(v) OVER w AS lo, max(v) OVER w AS hi, coalesce(NOT v BETWEEN min(v) OVER b AND max(v) OVER b, false) AS moved FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id), b AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
# A window is closed, told once and forgotten when it ends two hours before the newest row of the batches before; rows that come for it one batch later, or after that, are lost.
add(
    "stream_windowed_statistic",
    lambda s, d: replayed(windowed_statistic(readings(s, d), "ts", "v", ["key"], "1 day", "2 hours")).select(c("window.start").cast("timestamp_ntz").alias("start"), "key", "n", "s"),
    f"""WITH e AS (SELECT ts, user_id AS key, CAST(floor(value * 10) AS BIGINT) % 256 AS v, event_id * {BATCHES} // (SELECT max(event_id) + 1 FROM events) AS batch, time_bucket(INTERVAL '1 day', ts) AS start FROM events),
m AS (SELECT batch, max(ts) AS newest FROM e GROUP BY batch), late AS (SELECT k AS batch, max(newest) - INTERVAL 2 HOUR AS mark FROM range({BATCHES + 2}) r(k) JOIN m ON m.batch <= k - 2 GROUP BY k)
SELECT start, key, count(*) AS n, CAST(sum(v) AS BIGINT) AS s FROM e LEFT JOIN late USING (batch) WHERE (mark IS NULL OR start + INTERVAL 1 DAY > mark) AND start + INTERVAL 1 DAY <= (SELECT max(mark) FROM late) GROUP BY start, key""",
)
