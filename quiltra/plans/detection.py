"""Queries of cascade models, detection by cascades at one and at many scales, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import HEIGHT as H
from ..model import PIXELS_SQL as P
from ..model import WIDTH as W
from ..model import neighbourhood_sql, pixels, table
from ..operators import aggregate as A
from ..operators import cascade as K
from ..operators import hog
from ..operators.grouping import grouped
from .images import _EQ, _HG

QUERIES: dict = {}
SQL: dict = {}
c = F.col
KEY = ["img", "y", "x"]

# -- models ------------------------------------------------------------------------------------------------
# Every brand of the part table spells a cascade: a part is a feature and a stump, three of them a stage.


def spelled(spark, sf_dir) -> DataFrame:
    """model, xml: a document for each brand."""
    at = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size", at.alias("at"))
    words = lambda *v: F.concat_ws(" ", *[x if isinstance(x, str) is False else F.lit(x) for x in v])
    k, size = c("p_partkey"), c("p_size")
    text = lambda v: v.cast("string")
    haar = F.substring("p_brand", -1, 1).isin("1", "3", "5")
    box = words(text(size % 5), text(k % 5), text(1 + size % 3), text(1 + k % 3))
    rects = F.concat(F.lit("<rects><_>"), box, F.lit(" -1.</_><_>"), words(text(size % 5), text(k % 5), F.lit("1"), text(1 + k % 3), F.lit("2.")), F.lit("</_></rects><tilted>"), F.when(k % 7 == 0, "1").otherwise("0"), F.lit("</tilted>"))
    feature = F.concat(F.lit("<_>"), F.when(haar, rects).otherwise(F.concat(F.lit("<rect>"), box, F.lit("</rect>"))), F.lit("</_>"))
    subset = words(*[text((k * 31 + j * 7919) % 1000 - 500) for j in range(8)])
    node = words(F.lit("0 -1"), text(c("at")), F.when(haar, text((k % 100 - 50) / 1000)).otherwise(subset))
    tree = F.concat(F.lit("<_><internalNodes>\n "), node, F.lit("</internalNodes><leafValues>"), words(text(-(k % 10) / 8), text((k % 16) / 8)), F.lit("</leafValues></_>"))
    p = p.select("p_brand", "at", F.expr("at div 3").alias("stage"), tree.alias("tree"), feature.alias("feature"), haar.alias("haar"))
    joined = lambda name, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, name))), lambda z: z[name]), "")
    stages = p.groupBy("p_brand", "stage", "haar").agg(joined("tree", "at").alias("trees"), joined("feature", "at").alias("features"))
    stage = F.concat(F.lit("<_><stageThreshold>"), text((c("stage") % 5) / 4), F.lit("</stageThreshold><weakClassifiers>"), c("trees"), F.lit("</weakClassifiers></_>"))
    models = stages.withColumn("body", stage).groupBy("p_brand", "haar").agg(joined("body", "stage").alias("stages"), joined("features", "stage").alias("features"))
    head = F.concat(F.lit('<?xml version="1.0"?>\n<opencv_storage><cascade type_id="opencv-cascade-classifier"><stageType>BOOST</stageType><featureType>'), F.when(c("haar"), "HAAR").otherwise("LBP"), F.lit("</featureType><height>9</height><width>11</width><stageParams><maxDepth>1</maxDepth></stageParams><featureParams><maxCatCount>"))
    xml = F.concat(head, F.when(c("haar"), "0").otherwise("256"), F.lit("</maxCatCount></featureParams><stages>"), c("stages"), F.lit("</stages><features>"), c("features"), F.lit("</features></cascade></opencv_storage>"))
    return models.select(c("p_brand").alias("model"), xml.alias("xml"))


_M = "m AS (SELECT p_brand AS model, p_partkey AS k, p_size AS z, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, p_brand[-1] IN ('1', '3', '5') AS haar FROM part)"


def _model(name: str, f, sql: str) -> None:
    QUERIES[name] = lambda s, d: f(K.cascades_of_text(spelled(s, d)))
    SQL[name] = f"WITH {_M} {sql}"


_model(
    "cascade_info",
    lambda m: m.info.select("model", "kind", c("w").cast("long").alias("w"), c("h").cast("long").alias("h"), c("categories").cast("long").alias("categories"), "tilted", "int16"),
    "SELECT model, CASE WHEN haar THEN 'HAAR' ELSE 'LBP' END AS kind, 11::BIGINT AS w, 9::BIGINT AS h, CASE WHEN haar THEN 0 ELSE 256 END::BIGINT AS categories, bool_or(haar AND k % 7 = 0) AS tilted, NOT haar AS int16 FROM m GROUP BY model, haar",
)
_model("cascade_stages", lambda m: m.stages.select("model", c("stage").cast("long").alias("stage"), F.round("threshold", 9).alias("threshold")), "SELECT model, CAST(i // 3 AS BIGINT) AS stage, round((i // 3 % 5) / 4 - 1e-5::DOUBLE, 9) AS threshold FROM m GROUP BY ALL")
_model(
    "cascade_trees",
    lambda m: m.trees.select("model", *[c(k).cast("long").alias(k) for k in ("stage", "tree", "feature")], "threshold", F.array_join(c("subset").cast("array<string>"), " ").alias("subset"), "low", "high"),
    "SELECT model, CAST(i // 3 AS BIGINT) AS stage, CAST(i % 3 AS BIGINT) AS tree, CAST(i AS BIGINT) AS feature, CASE WHEN haar THEN (k % 100 - 50)::DOUBLE / 1000::DOUBLE END AS threshold, CASE WHEN NOT haar THEN array_to_string(list_transform(range(8), lambda j: (k * 31 + j * 7919) % 1000 - 500), ' ') END AS subset, -(k % 10) / 8::DOUBLE AS low, (k % 16) / 8::DOUBLE AS high FROM m",
)
_model(
    "cascade_rects",
    lambda m: m.rects.select("model", *[c(k).cast("long").alias(k) for k in ("feature", "part", *"xywh")], "weight", "tilted"),
    "SELECT model, CAST(i AS BIGINT) AS feature, CAST(j AS BIGINT) AS part, CAST(z % 5 AS BIGINT) AS x, CAST(k % 5 AS BIGINT) AS y, CAST(CASE WHEN j = 0 THEN 1 + z % 3 ELSE 1 END AS BIGINT) AS w, CAST(1 + k % 3 AS BIGINT) AS h, CASE WHEN NOT haar THEN 1 WHEN j = 0 THEN -1 ELSE 2 END::DOUBLE AS weight, haar AND k % 7 = 0 AS tilted FROM m, range(2) r(j) WHERE haar OR j = 0",
)

# -- two small cascades over windows of 8 x 8 -------------------------------------------------------------------

#: kind: features as (tilted, ((x, y, w, h, weight), ...)), stages as (threshold, ((feature, threshold or subset, low, high), ...)).
SMALL = {
    "HAAR": (
        [(False, ((1, 1, 6, 6, -1.0), (1, 1, 3, 6, 2.0))), (False, ((2, 2, 4, 4, -1.0), (2, 2, 4, 2, 2.0))), (True, ((4, 1, 2, 2, -1.0), (4, 1, 1, 2, 2.0))), (False, ((0, 0, 8, 8, -1.0), (2, 2, 4, 4, 2.0), (3, 3, 2, 2, 3.0)))],
        [(0.25, ((0, -0.05, -0.5, 0.75), (1, 0.01, 0.5, -0.25))), (0.5, ((2, 0.0, 0.25, 0.5), (3, -0.9, -0.75, 0.25))), (0.125, ((1, -0.03, -0.25, 0.25), (0, 0.06, 0.25, -0.5), (2, 0.02, 0.125, -0.125)))],
    ),
    "LBP": (
        [(False, ((0, 0, 2, 2),)), (False, ((1, 1, 2, 2),)), (False, ((2, 0, 1, 2),)), (False, ((0, 3, 2, 1),))],
        [
            (0.25, ((0, (1431655765, -1, 858993459, 252645135, -252645136, 16711935, -1, 65535), 0.75, -0.5), (1, (-1, 1, -1431655766, 5, -65536, 77, 3, -2), 0.25, -0.25))),
            (0.5, ((2, (12345, -6789, 858993459, -1, 0, 16711935, -7, 99), 0.5, 0.125), (3, (-1, -1, 65535, -65536, 252645135, 7, 1431655765, 0), 0.375, -0.75))),
            (0.0, ((1, (858993459, 858993459, -1, -1, 0, 0, -858993460, 255), 0.25, -0.125), (0, (252645135, 0, -1, 252645135, -1, 3, -3, 0), 0.125, -0.5))),
        ],
    ),
}


def small_xml(kind: str) -> str:
    features, stages = SMALL[kind]
    words = lambda v: " ".join(map(str, v))
    body = "".join(
        f"<_><stageThreshold>{bound}</stageThreshold><weakClassifiers>"
        + "".join(f"<_><internalNodes>0 -1 {f} {words(t) if isinstance(t, tuple) else t}</internalNodes><leafValues>{low} {high}</leafValues></_>" for f, t, low, high in trees)
        + "</weakClassifiers></_>"
        for bound, trees in stages
    )
    rects = "".join(f"<_><rects>{''.join(f'<_>{words(r)}</_>' for r in parts)}</rects><tilted>{int(tilted)}</tilted></_>" if kind == "HAAR" else f"<_><rect>{words(parts[0])}</rect></_>" for tilted, parts in features)
    return f"<opencv_storage><cascade><stageType>BOOST</stageType><featureType>{kind}</featureType><height>8</height><width>8</width><featureParams><maxCatCount>{256 if kind == 'LBP' else 0}</maxCatCount></featureParams><stages>{body}</stages><features>{rects}</features></cascade></opencv_storage>"


def small(spark) -> K.Cascades:
    return K.cascades_of_text(spark.createDataFrame([(k, small_xml(k)) for k in SMALL], "model string, xml string"))


def _corners_sql(source: str, keys: str = "img") -> str:
    """CTEs l (keys, cw, ch, s, q, t): an image's corners as lists; source has (keys, y, x, v)."""
    return f"""z AS (SELECT {keys}, max(x) + 1 AS w, max(y) + 1 AS h FROM {source} GROUP BY {keys}),
n AS (SELECT {keys}, w, h, unnest(range(0, (w + 1) * (h + 1))) AS pos FROM z),
o AS (SELECT {keys}, w, h, pos // (w + 1) AS y, pos % (w + 1) AS x FROM n),
i1 AS (SELECT {keys}, y, x, sum(v) OVER r AS a, sum(v * v) OVER r AS b FROM {source} WINDOW r AS (PARTITION BY {keys}, y ORDER BY x)),
i2 AS (SELECT {keys}, y + 1 AS y, x + 1 AS x, sum(a) OVER k AS s, sum(b) OVER k AS q FROM i1 WINDOW k AS (PARTITION BY {keys}, x ORDER BY y)),
tr AS (SELECT {', '.join('o.' + k for k in keys.split(', '))}, o.y, o.x, sum(p.v) AS t FROM o JOIN {source} p USING ({keys}) WHERE p.y < o.y AND abs(p.x + 1 - o.x) < o.y - p.y GROUP BY ALL),
l AS (SELECT {keys}, any_value(w) AS cw, any_value(h) AS ch, list(CAST(coalesce(s, 0) AS BIGINT) ORDER BY y, x) AS s, list(CAST(coalesce(q, 0) AS BIGINT) ORDER BY y, x) AS q, list(CAST(coalesce(t, 0) AS BIGINT) ORDER BY y, x) AS t FROM o LEFT JOIN i2 USING ({keys}, y, x) LEFT JOIN tr USING ({keys}, y, x) GROUP BY {keys})"""


def _at(k: str, dy: int, dx: int) -> str:
    return f"{k}[(y + {dy}) * (cw + 1) + x + {dx} + 1]"


def _accepted_sql(kind: str, int16: bool = False) -> str:
    """The conjunction of all stages of a small cascade over corners s, q, t of an image and a window's y, x."""
    features, stages = SMALL[kind]
    box = lambda k, y, x, h, w: f"({_at(k, y, x)} - {_at(k, y, x + w)} - {_at(k, y + h, x)} + {_at(k, y + h, x + w)})"
    out = []
    for bound, trees in stages:
        scale = None
        if int16:
            scale = 32767 * 0.9 / max(abs(sum(min(t[2:]) for t in trees)), abs(sum(max(t[2:]) for t in trees)))
        near = lambda v, s=scale: v if s is None else (1 if v * s >= 0 else -1) * int(abs(v * s) + 0.5)
        parts = []
        for f, threshold, low, high in trees:
            tilted, rects = features[f]
            if kind == "HAAR":
                corner = lambda r: (r[1], r[0], r[3], r[2])
                t = lambda r: f"({_at('t', r[1], r[0])} - {_at('t', r[1] + r[3], r[0] - r[3])} - {_at('t', r[1] + r[2], r[0] + r[2])} + {_at('t', r[1] + r[2] + r[3], r[0] + r[2] - r[3])})"
                total = " + ".join(f"{r[4]}::DOUBLE * {t(r) if tilted else box('s', *corner(r))}" for r in rects)
                high_if = f"{total} >= {threshold}::DOUBLE * norm"
            else:
                x, y, w, h = rects[0]
                cell = lambda i, j: box("s", y + h * i, x + w * j, h, w)  # noqa: E731, B023
                code = " + ".join(f"CASE WHEN {cell(i, j)} >= {cell(1, 1)} THEN {128 >> k} ELSE 0 END" for k, (i, j) in enumerate(((0, 0), (0, 1), (0, 2), (1, 2), (2, 2), (2, 1), (2, 0), (1, 0))))
                bits = [(v >> b) & 1 for v in threshold for b in range(32)]
                high_if = f"[{', '.join(map(str, bits))}][{code} + 1] = 0"
            parts.append(f"CASE WHEN {high_if} THEN {near(high)} ELSE {near(low)} END::DOUBLE")
        out.append(f"({' + '.join(parts)}) >= {near(bound - K.SLACK)}::DOUBLE")
    return " AND ".join(out)


_NORM = lambda: (lambda s, q: f"CASE WHEN 36 * {q} - {s} * {s} < 0 THEN 1 ELSE sqrt((36 * {q} - {s} * {s})::DOUBLE) END")(*(f"({_at(k, 1, 1)} - {_at(k, 1, 7)} - {_at(k, 7, 1)} + {_at(k, 7, 7)})" for k in "sq"))


def _detect(name: str, kind: str, step: int, int16: bool) -> None:
    QUERIES[name] = lambda s, d: K.detected(pixels(s, d).select(*KEY, c("a").alias("v")), small(s), kind, step=step, int16=int16)
    SQL[name] = f"""WITH {P}, u AS (SELECT img, y, x, a AS v FROM p), {_corners_sql('u')},
g AS (SELECT img, cw, s, q, t, unnest(range(0, ch - 7)) AS y FROM l), k AS (SELECT img, cw, s, q, t, y, unnest(range(0, cw - 7)) AS x FROM g), j AS (SELECT *, {_NORM()} AS norm FROM k WHERE y % {step} = 0 AND x % {step} = 0)
SELECT img, y, x FROM j WHERE {_accepted_sql(kind, int16)}"""


_detect("detection_haar_detect_32fp", "HAAR", 1, False)
_detect("detection_haar_detect_32fi", "HAAR", 2, False)
_detect("detection_lbp_detect_32fp", "LBP", 1, False)
_detect("detection_lbp_detect_32fi", "LBP", 2, False)
_detect("detection_lbp_detect_16ip", "LBP", 1, True)
_detect("detection_lbp_detect_16ii", "LBP", 2, True)

# -- all scales, grouped ------------------------------------------------------------------------------------------

FACTOR, LEAST, DIFFER = 1.5, 2, 0.2
LEVELS = K.levels_of((W, H), (8, 8), FACTOR)


def normalised(spark, sf_dir) -> DataFrame:
    p = pixels(spark, sf_dir).withColumnRenamed("a", "v")
    return p.join(A.equalisation(A.histogram(p.withColumnRenamed("v", "a"), c("a"), ["img"]), ["img"]), ["img", "v"]).select(*KEY, c("new").alias("v"))


def over_scales(spark, sf_dir, kind: str) -> DataFrame:
    """img, l, t, r, b: candidates of a small cascade at all levels, middles inside the mask only."""
    planes = normalised(spark, sf_dir)
    roi = pixels(spark, sf_dir).where("m < 3").select(*KEY)
    return K.candidates(planes, small(spark), kind, (W, H), FACTOR, roi=roi)


def _over_sql(kind: str) -> str:
    axis = lambda d, n, dn: f"(SELECT {d}, least(greatest(({d} + 0.5::DOUBLE) * ({n}::DOUBLE / {dn}::DOUBLE) - 0.5::DOUBLE, 0::DOUBLE), {n} - 1.0::DOUBLE) AS pos FROM (SELECT unnest(range({dn})) AS {d}))"
    level = " UNION ALL ".join(
        f"SELECT p.img, {k} AS lvl, d.y, e.x, CAST(floor(round(sum(p.v * greatest(1 - abs(d.pos - p.y), 0) * greatest(1 - abs(e.pos - p.x), 0)), 6) + 0.5) AS BIGINT) AS v FROM nz p JOIN {axis('y', H, h)} d ON abs(d.pos - p.y) < 1 JOIN {axis('x', W, w)} e ON abs(e.pos - p.x) < 1 GROUP BY ALL"
        for k, (_, w, h) in enumerate(LEVELS)
    )
    scale = f"[{', '.join(f'{s}::DOUBLE' for s, _, _ in LEVELS)}][lvl + 1]"
    return f"""WITH RECURSIVE {P}{_HG}{_EQ}, nz AS (SELECT p.img, p.y, p.x, CAST(e.new AS BIGINT) AS v FROM p JOIN e ON e.img = p.img AND e.v = p.a), u AS ({level}), {_corners_sql('u', 'img, lvl')},
gw AS (SELECT img, lvl, cw, s, q, t, unnest(range(0, ch - 7)) AS y FROM l), k AS (SELECT img, lvl, cw, s, q, t, y, unnest(range(0, cw - 7)) AS x, {scale} AS scale FROM gw),
j AS (SELECT *, {_NORM()} AS norm FROM k SEMI JOIN (SELECT img AS ri, y AS ry, x AS rx FROM p WHERE m < 3) ON ri = img AND ry = CAST(floor((y + 4) * scale) AS BIGINT) AND rx = CAST(floor((x + 4) * scale) AS BIGINT) WHERE scale > 2 OR y % 2 = 0 AND x % 2 = 0),
r AS (SELECT img, CAST(floor(x * scale + 0.5) AS BIGINT) AS l, CAST(floor(y * scale + 0.5) AS BIGINT) AS t, CAST(floor((x + 8) * scale + 0.5) AS BIGINT) AS r, CAST(floor((y + 8) * scale + 0.5) AS BIGINT) AS b FROM j WHERE {_accepted_sql(kind, kind == 'LBP')})"""


_SIMILAR = " AND ".join(f"abs(p.{k} - q.{k}) <= {DIFFER}::DOUBLE * (least(p.r - p.l, q.r - q.l) + least(p.b - p.t, q.b - q.t)) / 2" for k in "ltrb")
#: CTEs from r (img, l, t, r, b; rows may be equal) to groups f, whole pixels, and the choice of those that stay.
GROUPED_SQL = f"""d0 AS (SELECT img, l, t, r, b, count(*) AS c FROM r GROUP BY ALL), d AS (SELECT *, row_number() OVER (ORDER BY img, l, t, r, b) AS id FROM d0),
ed AS (SELECT p.id AS a, q.id AS b FROM d p JOIN d q ON p.img = q.img AND {_SIMILAR}), mm AS (SELECT a AS id, a AS root FROM ed UNION SELECT ed.b, mm.root FROM mm JOIN ed ON ed.a = mm.id), kk AS (SELECT id, min(root) AS root FROM mm GROUP BY id),
f AS (SELECT d.img, kk.root, CAST(sum(c) AS BIGINT) AS n, CAST(floor(sum(c * l)::DOUBLE / sum(c) + 0.5) AS BIGINT) AS l, CAST(floor(sum(c * t)::DOUBLE / sum(c) + 0.5) AS BIGINT) AS t, CAST(floor(sum(c * r)::DOUBLE / sum(c) + 0.5) AS BIGINT) AS r, CAST(floor(sum(c * b)::DOUBLE / sum(c) + 0.5) AS BIGINT) AS b FROM d JOIN kk USING (id) GROUP BY 1, 2 HAVING sum(c) >= {LEAST})
SELECT img, n, l, t, r, b FROM f p WHERE NOT EXISTS (SELECT 1 FROM f q WHERE q.img = p.img AND q.root <> p.root AND (q.n > greatest(3, p.n) OR p.n < 3)
AND p.l >= q.l - floor({DIFFER}::DOUBLE * (q.r - q.l) + 0.5) AND p.r <= q.r + floor({DIFFER}::DOUBLE * (q.r - q.l) + 0.5) AND p.t >= q.t - floor({DIFFER}::DOUBLE * (q.b - q.t) + 0.5) AND p.b <= q.b + floor({DIFFER}::DOUBLE * (q.b - q.t) + 0.5))"""

for _kind in SMALL:
    QUERIES[f"detection_candidates_{_kind.lower()}"] = lambda s, d, k=_kind: over_scales(s, d, k).groupBy("img", *"ltrb").agg(F.count("*").alias("n"))
    SQL[f"detection_candidates_{_kind.lower()}"] = f"{_over_sql(_kind)} SELECT img, l, t, r, b, count(*) AS n FROM r GROUP BY ALL"
    QUERIES[f"detection_{_kind.lower()}"] = lambda s, d, k=_kind: grouped(over_scales(s, d, k), LEAST, DIFFER)
    SQL[f"detection_{_kind.lower()}"] = f"{_over_sql(_kind)}, {GROUPED_SQL}"

# -- histograms of oriented gradients ------------------------------------------------------------------------------

QUERIES["hog_extract_features"] = lambda s, d: hog.features(pixels(s, d), "a").select("img", c("cy").cast("long").alias("cy"), c("cx").cast("long").alias("cx"), F.posexplode("f").alias("k", "v")).select("img", "cy", "cx", c("k").cast("long").alias("k"), F.round("v", 4).alias("v"))
_DOTS = ", ".join(f"{x!r}::DOUBLE * abs(dx) + {y!r}::DOUBLE * abs(dy)" for x, y in hog.AXES)
SQL["hog_extract_features"] = f"""WITH {P}, {neighbourhood_sql('a', 1)},
g AS (SELECT img, y, x, n12 - n10 AS dx, n21 - n01 AS dy FROM n WHERE x BETWEEN 1 AND {W - 2} AND y BETWEEN 1 AND {H - 2}),
k AS (SELECT *, sqrt((dx * dx + dy * dy)::DOUBLE) AS len, CASE WHEN dx < 0 THEN 9 - b ELSE b END AS t FROM (SELECT *, list_position([{_DOTS}], list_max([{_DOTS}])) - 1 AS b FROM g)),
o AS (SELECT img, y, x, len, CASE WHEN dy < 0 AND t <> 0 THEN 18 - t - CASE WHEN dx = 0 THEN 1 ELSE 0 END ELSE t END AS o FROM k),
s AS (SELECT img, o, CAST(floor((y - 4) / 8) AS BIGINT) + i AS cy, CAST(floor((x - 4) / 8) AS BIGINT) + j AS cx, len * CASE WHEN i = 1 THEN ((y + 4) % 8 * 2 + 1) / 16::DOUBLE ELSE 1 - ((y + 4) % 8 * 2 + 1) / 16::DOUBLE END * CASE WHEN j = 1 THEN ((x + 4) % 8 * 2 + 1) / 16::DOUBLE ELSE 1 - ((x + 4) % 8 * 2 + 1) / 16::DOUBLE END AS v FROM o, range(2) a(i), range(2) b(j)),
q AS (SELECT img, cy, cx, o, sum(v) AS v FROM s WHERE cy BETWEEN 0 AND {H // 8 - 1} AND cx BETWEEN 0 AND {W // 8 - 1} GROUP BY ALL),
every AS (SELECT img, cy, cx, o FROM (SELECT DISTINCT img, cy, cx FROM q), range(18) r(o)), hh AS (SELECT img, cy, cx, o, coalesce(v, 0) AS v FROM every LEFT JOIN q USING (img, cy, cx, o)),
uu AS (SELECT a.img, a.cy, a.cx, a.o, a.v + b.v AS v FROM hh a JOIN hh b ON a.img = b.img AND a.cy = b.cy AND a.cx = b.cx AND b.o = a.o + 9),
e AS (SELECT img, cy, cx, sum(v * v) AS e FROM uu GROUP BY ALL),
z AS (SELECT a.img, a.cy, a.cx, m.m, 1 / sqrt(sum(b.e) + {hog.SMALL}::DOUBLE) AS n FROM e a, (VALUES (0, 1, 0, 1, 0), (1, -1, 0, 0, 1), (2, 0, 1, -1, 0), (3, -1, 0, -1, 0)) mm(m, y0, y1, x0, x1), LATERAL (SELECT m, CASE WHEN m IN (1, 3) THEN -1 ELSE 0 END AS dy, CASE WHEN m IN (2, 3) THEN -1 ELSE 0 END AS dx) m, e b WHERE b.img = a.img AND b.cy - a.cy - m.dy IN (0, 1) AND b.cx - a.cx - m.dx IN (0, 1) GROUP BY ALL),
f AS (SELECT img, cy, cx, o AS k, 0.5 * sum(least(v * n, {hog.CUT}::DOUBLE)) AS v FROM hh JOIN z USING (img, cy, cx) GROUP BY ALL
UNION ALL SELECT img, cy, cx, o + 18, 0.5 * sum(least(v * n, {hog.CUT}::DOUBLE)) FROM uu JOIN z USING (img, cy, cx) GROUP BY ALL
UNION ALL SELECT img, cy, cx, m + 27, {hog.TEXTURE}::DOUBLE * sum(least(v * n, {hog.CUT}::DOUBLE)) FROM hh JOIN z USING (img, cy, cx) GROUP BY ALL)
SELECT img, cy, cx, CAST(k AS BIGINT) AS k, round(v, 4) AS v FROM f"""
