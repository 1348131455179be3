"""Text on images: a font is a relation of glyph pixels, a text becomes glyphs by its lines and places.

All glyphs of a font have one size.  A font is given as an atlas (code, y, x, v)
of opaque (255) to clear (0) pixels; pixels that are absent are clear.  Only
characters that the atlas's range of codes holds take room; a line feed begins a
new line, any other character is passed over.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cascade import resampled
from .geometry import reduce2x2


@dataclass(frozen=True)
class FontSize:
    """Size of the glyphs as drawn and as in the atlas, the room left around a text, and the first and last code."""

    width: int
    height: int
    atlas_width: int
    atlas_height: int
    indent_x: int
    indent_y: int
    first: int = 32
    last: int = 126

    @staticmethod
    def of(height: int, width: int, tall: int, indent_x: int = 0, indent_y: int = 0, first: int = 32, last: int = 126) -> FontSize:
        """A font of glyphs of width x tall, drawn `height` tall; heights run from 4 to four times that of the atlas."""
        if not 4 <= height <= 4 * tall:
            raise ValueError(f"height {height} is not in 4..{4 * tall}")
        return FontSize(height * width // tall, height, width, tall, height * indent_x // tall, height * indent_y // tall, first, last)

    @property
    def characters(self) -> str:
        """A character class of what takes room."""
        return f"[\\x{{{self.first:x}}}-\\x{{{self.last:x}}}]"


def resized(atlas: DataFrame, font: FontSize) -> DataFrame:
    """code, y, x, v: the atlas at the font's size: bilinear to the last doubling under the atlas's height, then means of 2 x 2.

    Every code with a pixel in the atlas has all pixels of its glyph.
    """
    level = 0
    while font.height << (level + 1) < font.atlas_height:
        level += 1
    # all pixels of a glyph, so that means know the clear ones
    codes = atlas.select("code").distinct()
    grid = codes.select("code", F.explode(F.sequence(F.lit(0), F.lit(font.atlas_height - 1))).alias("y")).select("code", "y", F.explode(F.sequence(F.lit(0), F.lit(font.atlas_width - 1))).alias("x"), F.lit(0).alias("v"))
    whole = grid.unionByName(atlas.select("code", "y", "x", "v")).groupBy("code", "y", "x").agg(F.max("v").alias("v"))
    out = resampled(whole.withColumnRenamed("code", "img"), "v", (font.atlas_width, font.atlas_height), [(1.0, font.width << level, font.height << level)]).drop("lvl")
    for _ in range(level):
        out = reduce2x2(out, "v")
    return out.select(F.col("img").alias("code"), "y", "x", "v")


def measured(texts: DataFrame, font: FontSize, text_col: str = "text") -> DataFrame:
    """Add width and height of the room that each text takes; 0 and 0 for texts without a drawable character, and for null."""
    lines = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda s: F.regexp_count(s, F.lit(font.characters)))
    longest = F.array_max(lines)
    filled = F.array_max(F.transform(lines, lambda n, i: F.when(n > 0, i + 1).otherwise(0)))
    size = lambda n, each, indent: F.when(longest > 0, n * each + 2 * indent).otherwise(0).cast("long")
    return texts.withColumns({"width": size(longest, font.width, font.indent_x), "height": size(filled, font.height, font.indent_y)})


def glyphs(texts: DataFrame, font: FontSize, id_col: str, text_col: str, left: int, top: int, canvas: tuple[int, int]) -> DataFrame:
    """img, code, gy, gx: upper left corners of the glyphs that touch a canvas of (width, height) at (left, top) of which the text begins."""
    lines = texts.select(F.col(id_col).alias("img"), F.posexplode(F.split(F.col(text_col), "\n")).alias("line", "s"))
    gy, gx = F.col("line") * font.height + top + font.indent_y, F.col("at") * font.width + left + font.indent_x
    lines = lines.where((gy > -font.height) & (gy < canvas[1]))
    drawn = F.array_join(F.regexp_extract_all("s", F.lit(f"({font.characters})")), "")
    # only the characters of a line that may touch the canvas become rows
    skip = max(0, -(-(-(left + font.indent_x) - font.width + 1) // font.width))
    most = max(0, -(-(canvas[0] - left - font.indent_x) // font.width))
    part = F.substring(drawn, skip + 1, max(0, most - skip))
    out = lines.select("img", "line", F.posexplode(F.split(part, "")).alias("at", "ch")).where("ch <> ''").withColumn("at", F.col("at") + skip)
    return out.select("img", F.ascii("ch").alias("code"), gy.cast("long").alias("gy"), gx.cast("long").alias("gx")).where((F.col("gx") > -font.width) & (F.col("gx") < canvas[0]))


def text_alpha(texts: DataFrame, atlas: DataFrame, font: FontSize, id_col: str, text_col: str, left: int, top: int, canvas: tuple[int, int]) -> DataFrame:
    """img, y, x, alpha: what a text covers of the canvas; atlas: glyphs at the font's size."""
    g = glyphs(texts, font, id_col, text_col, left, top, canvas).join(atlas, "code")
    out = g.select("img", (F.col("gy") + F.col("y")).alias("y"), (F.col("gx") + F.col("x")).alias("x"), F.col("v").alias("alpha"))
    return out.where((F.col("y") >= 0) & (F.col("y") < canvas[1]) & (F.col("x") >= 0) & (F.col("x") < canvas[0]))


def drawn(canvas: DataFrame, alpha: DataFrame, colours: dict[str, int], size: tuple[int, int], background: DataFrame | None = None, ground: dict[str, int] | None = None) -> DataFrame:
    """The canvas (img, y, x and the columns of `colours`) with the text blended in.

    The text's pixels of a row come as one list to the canvas's pixels of that row;
    of those at one place the most opaque counts.  With `background`
    (img, width, height: sizes at the upper left corner) that room is filled with
    `ground` first; an image has one row there at most.
    """
    names, x = list(colours), F.col("x")
    rows = alpha.groupBy("img", F.col("y").cast("long").alias("y")).agg(F.collect_list(F.struct(F.col("x").cast("long").alias("x"), F.col("alpha").cast("long").alias("alpha"))).alias("row"))
    met = canvas.select("img", F.col("y").cast("long").alias("y"), "x", *names).where(F.col(names[0]).isNotNull()).join(rows, ["img", "y"], "left")
    met = met.select("img", "y", "x", *names, F.array_max(F.transform(F.filter("row", lambda z: z["x"] == x), lambda z: z["alpha"])).alias("alpha"))
    if background is not None:
        met = met.join(background.select("img", F.col("width").alias("room_w"), F.col("height").alias("room_h")), "img", "left")
        met = met.withColumn("room", (x < F.least("room_w", F.lit(size[0]))) & (F.col("y") < F.least("room_h", F.lit(size[1]))))
    a = F.coalesce("alpha", F.lit(0))

    def blended(k: str):
        under = F.when(F.col("room"), F.lit(ground[k])).otherwise(F.col(k)) if ground and background is not None else F.col(k)
        v = F.lit(colours[k]) * a + under * (255 - a)
        return F.shiftright((v + 1 + F.shiftright(v, 8)).cast("long"), 8).alias(k)

    return met.select("img", "y", "x", *[blended(k) for k in names])
