"""Routes between frame formats: chains, planes there and back, odd sizes."""

import itertools

import pytest

from quiltra.operators.frames import DIRECT, FORMATS, Frame, convert, route


def test_routes_are_short_chains_of_direct_conversions():
    assert route("nv12", "rgba") == ["nv12", "yuv420p", "yuv444p", "bgr", "rgba"]
    assert route("rgb", "nv12") == ["rgb", "bgr", "yuv420p", "nv12"] and route("bgra", "rgba") == ["bgra", "rgba"]
    assert route("gray", "gray") == ["gray"]
    for a, b in itertools.product(FORMATS, FORMATS):
        steps = route(a, b)
        assert steps[0] == a and steps[-1] == b and all(pair in DIRECT for pair in zip(steps, steps[1:]))
    with pytest.raises(ValueError, match="no route"):
        route("bgr", "cmyk")


def frame(spark, format, h=3, w=5):
    channels, half = FORMATS[format]
    rows = [(1, n, y, x, (37 * y + 11 * x + 53 * k) % 256) for k, n in enumerate(channels) for y in range(h) for x in range(w)]
    if half:
        cells = [(y, x) for y in range((h + 1) // 2) for x in range((w + 1) // 2)]
        rows += [(1, "uv", y, 2 * x + k, (90 + 7 * y + 5 * x + 20 * k) % 256) if format == "nv12" else (1, "uv"[k], y, x, (90 + 7 * y + 5 * x + 20 * k) % 256) for k in (0, 1) for y, x in cells]
    return rows, Frame.of(format, spark.createDataFrame(rows, "img long, plane string, y long, x long, v long"))


@pytest.mark.parametrize("format", list(FORMATS))
def test_planes_there_and_back(spark, format):
    rows, own = frame(spark, format)
    assert sorted(map(tuple, own.planes().collect())) == sorted(rows)
    for to in FORMATS:
        got = {tuple(r)[:4]: r.v for r in convert(own, to).planes().collect()}
        sizes = {n: 15 for n in FORMATS[to][0]} | ({} if not FORMATS[to][1] else {"uv": 12} if to == "nv12" else {"u": 6, "v": 6})
        assert {n: sum(k[1] == n for k in got) for n in sizes} == sizes and len(got) == sum(sizes.values())
        assert all(v is not None and 0 <= v <= 255 for v in got.values())


def test_odd_edges_take_the_pixels_that_are_there(spark):
    _, own = frame(spark, "yuv444p")
    got = {(r.plane, r.y, r.x): r.v for r in convert(own, "yuv420p").planes().collect()}
    u = lambda y, x: (37 * y + 11 * x + 53) % 256
    assert got["u", 0, 0] == (u(0, 0) + u(0, 1) + u(1, 0) + u(1, 1) + 2) // 4
    assert got["u", 1, 0] == (u(2, 0) + u(2, 1) + 1) // 2 and got["u", 1, 2] == u(2, 4)
