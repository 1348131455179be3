"""Queries of fonts and text on images, and their SQL.  The atlas is spelled by the customer table: each row is a stroke."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import HEIGHT as H
from ..model import PIXELS_SQL as P
from ..model import WIDTH as W
from ..model import pixels, table
from ..operators import text as T
from .images import div255_sql

QUERIES: dict = {}
SQL: dict = {}
c = F.col
WIDE, TALL, INDENT = 12, 20, (2, 3)
SMALL, LARGE = T.FontSize.of(7, WIDE, TALL, *INDENT), T.FontSize.of(24, WIDE, TALL, *INDENT)
COLOURS, GROUND = {"a": 250, "b": 40, "c": 120}, {"a": 10, "b": 20, "c": 30}
LEFT, TOP = -3, 2


def atlas(spark, sf_dir):
    """code, y, x, v: strokes of three to seven pixels."""
    k = c("c_custkey")
    rows = table(spark, sf_dir, "customer").select((32 + k % 95).alias("code"), (k * 7 % TALL).alias("y"), (k * 11 % 9).alias("l"), (3 + c("c_nationkey") % 5).alias("n"))
    return rows.select("code", "y", F.explode(F.sequence(c("l"), F.least(c("l") + c("n"), F.lit(WIDE)) - 1)).alias("x")).select("code", "y", "x", F.lit(255).alias("v")).distinct()


_ATLAS = f"atl AS (SELECT DISTINCT code, y, x, 255 AS v FROM (SELECT 32 + c_custkey % 95 AS code, c_custkey * 7 % {TALL} AS y, unnest(range(c_custkey * 11 % 9, least(c_custkey * 11 % 9 + 3 + c_nationkey % 5, {WIDE}))) AS x FROM customer)), whole AS (SELECT k.code, gy.y, gx.x, coalesce(atl.v, 0) AS v FROM (SELECT DISTINCT code FROM atl) k, range({TALL}) gy(y), range({WIDE}) gx(x) LEFT JOIN atl ON atl.code = k.code AND atl.y = gy.y AND atl.x = gx.x)"


def _resized_sql(name: str, font: T.FontSize, level: int) -> str:
    w, h = font.width << level, font.height << level
    axis = lambda d, n, dn: f"(SELECT {d}, least(greatest(({d} + 0.5::DOUBLE) * ({n}::DOUBLE / {dn}::DOUBLE) - 0.5::DOUBLE, 0::DOUBLE), {n} - 1.0::DOUBLE) AS pos FROM (SELECT unnest(range({dn})) AS {d}))"
    out = f"{name}0 AS (SELECT p.code, d.y, e.x, CAST(floor(round(sum(p.v * greatest(1 - abs(d.pos - p.y), 0) * greatest(1 - abs(e.pos - p.x), 0)), 6) + 0.5) AS BIGINT) AS v FROM whole p JOIN {axis('y', TALL, h)} d ON abs(d.pos - p.y) < 1 JOIN {axis('x', WIDE, w)} e ON abs(e.pos - p.x) < 1 GROUP BY ALL)"
    for k in range(level):
        out += f", {name}{k + 1} AS (SELECT code, y // 2 AS y, x // 2 AS x, (CAST(sum(v) AS BIGINT) * 4 // count(*) + 2) // 4 AS v FROM {name}{k} GROUP BY 1, 2, 3)"
    return out + f", {name} AS (SELECT * FROM {name}{level})"


for _name, _font, _level in (("small", SMALL, 1), ("large", LARGE, 0)):
    QUERIES[f"font_resize_{_name}"] = lambda s, d, f=_font: T.resized(atlas(s, d), f).select(*[c(k).cast("long").alias(k) for k in ("code", "y", "x", "v")])
    SQL[f"font_resize_{_name}"] = f"WITH {_ATLAS}, {_resized_sql('f', _font, _level)} SELECT code, y, x, v FROM f"


def heights(spark, sf_dir):
    """Sizes of a font for the heights that the part table asks for."""
    size = c("p_size").cast("long")
    by = lambda n: F.floor(size * n / TALL).cast("long")
    return table(spark, sf_dir, "part").select(size.alias("height"), by(WIDE).alias("width"), by(INDENT[0]).alias("indent_x"), by(INDENT[1]).alias("indent_y"), size.between(4, 4 * TALL).alias("allowed")).distinct()


QUERIES["font_height"] = heights
SQL["font_height"] = f"SELECT DISTINCT CAST(p_size AS BIGINT) AS height, CAST(p_size * {WIDE} // {TALL} AS BIGINT) AS width, CAST(p_size * {INDENT[0]} // {TALL} AS BIGINT) AS indent_x, CAST(p_size * {INDENT[1]} // {TALL} AS BIGINT) AS indent_y, p_size BETWEEN 4 AND {4 * TALL} AS allowed FROM part"

QUERIES["font_measure"] = lambda s, d: T.measured(table(s, d, "documents").select("doc_id", "text"), LARGE).drop("text")
SQL["font_measure"] = f"""WITH n AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda s: len(regexp_extract_all(s, '[ -~]'))) AS n FROM documents),
m AS (SELECT doc_id, list_max(n) AS longest, list_max(list_transform(n, lambda v, i: CASE WHEN v > 0 THEN i ELSE 0 END)) AS filled FROM n)
SELECT doc_id, CAST(CASE WHEN longest > 0 THEN longest * {LARGE.width} + {2 * LARGE.indent_x} ELSE 0 END AS BIGINT) AS width, CAST(CASE WHEN longest > 0 THEN filled * {LARGE.height} + {2 * LARGE.indent_y} ELSE 0 END AS BIGINT) AS height FROM m"""


def written_on(spark, sf_dir, ground: bool):
    """The document whose id is an image's, written on that image; its room filled before, if asked."""
    p = pixels(spark, sf_dir).select("img", "y", "x", *COLOURS)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(p.select(c("img").alias("doc_id")).distinct(), "doc_id")
    alpha = T.text_alpha(docs, T.resized(atlas(spark, sf_dir), SMALL), SMALL, "doc_id", "text", 0 if ground else LEFT, 0 if ground else TOP, (W, H))
    room = T.measured(docs, SMALL).select(c("doc_id").alias("img"), "width", "height") if ground else None
    return T.drawn(p, alpha, COLOURS, (W, H), room, GROUND if ground else None)


def _drawn_sql(ground: bool) -> str:
    left, top = (0, 0) if ground else (LEFT, TOP)
    under = lambda k: f"CASE WHEN p.x < r.width AND p.y < r.height THEN {GROUND[k]} ELSE p.{k} END" if ground else f"p.{k}"
    return f"""WITH {P}, {_ATLAS}, {_resized_sql('f', SMALL, 1)},
l AS (SELECT doc_id AS img, unnest(string_split(coalesce(text, ''), chr(10))) AS s, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line FROM documents WHERE doc_id IN (SELECT img FROM p)),
g AS (SELECT img, line, unnest(regexp_extract_all(s, '[ -~]')) AS ch, generate_subscripts(regexp_extract_all(s, '[ -~]'), 1) - 1 AS i FROM l),
t AS (SELECT img, line * {SMALL.height} + {top + SMALL.indent_y} + f.y AS y, i * {SMALL.width} + {left + SMALL.indent_x} + f.x AS x, f.v FROM g JOIN f ON f.code = ascii(ch)),
m AS (SELECT img, line, count(*) AS n FROM g GROUP BY ALL), r AS (SELECT img, max(n) * {SMALL.width} + {2 * SMALL.indent_x} AS width, (max(line) + 1) * {SMALL.height} + {2 * SMALL.indent_y} AS height FROM m GROUP BY img)
SELECT p.img, p.y, p.x, {', '.join(f"CAST({div255_sql(f'{v} * coalesce(t.v, 0) + ({under(k)}) * (255 - coalesce(t.v, 0))')} AS BIGINT) AS {k}" for k, v in COLOURS.items())} FROM p LEFT JOIN t ON t.img = p.img AND t.y = p.y AND t.x = p.x LEFT JOIN r ON r.img = p.img"""


for _name, _ground in (("font_draw", False), ("font_draw_background", True)):
    QUERIES[_name] = lambda s, d, g=_ground: written_on(s, d, g)
    SQL[_name] = _drawn_sql(_ground)
