"""Fonts: heights, measures, clipping and blending against a walk over the characters."""

import pytest

from quiltra.operators import text as T

FONT = T.FontSize.of(5, 4, 5, 1, 2, 97, 102)
TEXTS = {1: "abc\nfé a!b\n\n", 2: "", 3: None, 4: "\n\nzz", 5: "d" * 300, 6: "ab\n" * 50 + "f", 7: "xa"}


@pytest.fixture(scope="module")
def atlas(spark):
    rows = [(c, y, x, (c * 37 + y * 11 + x * 5) % 256) for c in range(97, 103) for y in range(5) for x in range(4)]
    return spark.createDataFrame(rows, "code int, y int, x int, v int"), {r[:3]: r[3] for r in rows}


def walk(text):
    x = y = w = h = 0
    for ch in text or "":
        if ch in "abcdef":
            yield ch, y, x
            x += FONT.width
        elif ch == "\n":
            x, y = 0, y + FONT.height


def test_heights():
    assert FONT == T.FontSize(4, 5, 4, 5, 1, 2, 97, 102) and T.FontSize.of(8, 4, 5, 1, 2).indent_y == 3
    for height in (3, 21):
        with pytest.raises(ValueError, match="is not in 4..20"):
            T.FontSize.of(height, 4, 5)


def test_measures(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "id long, text string")
    got = {r.id: (r.width, r.height) for r in T.measured(df, FONT).collect()}
    for k, text in TEXTS.items():
        cells = list(walk(text))
        want = (max(x for _, _, x in cells) + FONT.width + 2, max(y for _, y, _ in cells) + FONT.height + 4) if cells else (0, 0)
        assert got[k] == want, k


@pytest.mark.parametrize("left, top", [(0, 0), (-6, -7), (11, 3), (-1000, 0), (0, -230), (40, 40)])
def test_what_a_text_covers(spark, atlas, left, top):
    df = spark.createDataFrame(list(TEXTS.items()), "id long, text string")
    glyphs, pixels = atlas
    got = {(r.img, r.y, r.x): r.alpha for r in T.text_alpha(df, glyphs, FONT, "id", "text", left, top, (20, 17)).collect()}
    want = {}
    for k, text in TEXTS.items():
        for ch, y, x in walk(text):
            for i in range(5):
                for j in range(4):
                    at = (k, y + i + top + FONT.indent_y, x + j + left + FONT.indent_x)
                    if 0 <= at[1] < 17 and 0 <= at[2] < 20:
                        want[at] = pixels[ord(ch), i, j]
    assert got == want


def test_blending_with_and_without_ground(spark, atlas):
    canvas = spark.createDataFrame([(k, y, x, (x * y) % 256) for k in (1, 2) for y in range(17) for x in range(20)], "img long, y long, x long, v long")
    alpha = spark.createDataFrame([(1, 2, 3, 255), (1, 4, 5, 100), (9, 0, 0, 9)], "img long, y long, x long, alpha int")
    got = {(r.img, r.y, r.x): r.v for r in T.drawn(canvas, alpha, {"v": 200}, (20, 17)).collect()}
    div = lambda v: (v + 1 + (v >> 8)) >> 8
    assert len(got) == 2 * 340 and got[1, 2, 3] == 200 and got[1, 4, 5] == div(200 * 100 + 20 * 155) and got[2, 4, 5] == 20
    room = spark.createDataFrame([(1, 4, 30), (2, 0, 0)], "img long, width long, height long")
    got = {(r.img, r.y, r.x): r.v for r in T.drawn(canvas, alpha, {"v": 200}, (20, 17), room, {"v": 7}).collect()}
    assert got[1, 16, 3] == 7 and got[1, 16, 4] == 64 and got[2, 16, 3] == 48 and got[1, 2, 3] == 200 and got[1, 4, 5] == div(200 * 100 + 20 * 155)


def test_a_room_and_a_text_need_no_aggregate_of_the_canvas(spark, atlas):
    canvas = spark.createDataFrame([(1, y, x, 9) for y in range(4) for x in range(5)] + [(1, 0, 0, 9)], "img long, y long, x long, v long")
    alpha = spark.createDataFrame([(1, 1, 1, 10), (1, 1, 1, 255), (1, 7, 7, 3)], "img long, y long, x long, alpha int")
    room = spark.createDataFrame([(1, 2, 3)], "img long, width long, height long")
    out = T.drawn(canvas, alpha, {"v": 200}, (5, 4), room, {"v": 7})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("Aggregate") == 1
    got = sorted((r.y, r.x, r.v) for r in out.collect())
    assert got == sorted([(y, x, 200 if (y, x) == (1, 1) else 7 if x < 2 and y < 3 else 9) for y in range(4) for x in range(5)] + [(0, 0, 7)])
