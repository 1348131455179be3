"""Image files as rows: PGM, PPM, PNG and BMP bytes to and from packed planes.

Files are read with Spark's binaryFile source, so any store that Spark reads
will do; encoding gives a binary column that any sink takes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKED = "w int, h int, channels int, data binary"
_PNG = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(plane: np.ndarray, kind: str) -> bytes | None:
    """An (h, w) gray or (h, w, 3) RGB array as a file; None where the kind can't hold it."""
    h, w = plane.shape[:2]
    if h == 0 or w == 0:
        return None
    gray = plane.ndim == 2
    if kind in ("pgm", "pgm_txt") and gray or kind in ("ppm", "ppm_txt") and not gray:
        magic = {"pgm": "P5", "pgm_txt": "P2", "ppm": "P6", "ppm_txt": "P3"}[kind]
        head = f"{magic}\n{w} {h}\n255\n".encode()
        if kind.endswith("txt"):
            return head + "\n".join(" ".join(map(str, row.ravel())) for row in plane).encode() + b"\n"
        return head + plane.tobytes()
    if kind == "png":
        rows = plane.reshape(h, -1)
        raw = np.hstack([np.zeros((h, 1), np.uint8), rows]).tobytes()
        head = struct.pack(">IIBBBBB", w, h, 8, 0 if gray else 2, 0, 0, 0)
        return _PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw)) + _chunk(b"IEND", b"")
    if kind == "bmp":
        colour = np.repeat(plane[:, :, None], 3, axis=2) if gray else plane
        pad = -w * 3 % 4
        body = b"".join(row[:, ::-1].tobytes() + bytes(pad) for row in colour[::-1])
        return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body
    return None


def _netpbm(raw: bytes) -> np.ndarray:
    fields, at = [], 2
    while len(fields) < 3:
        while raw[at : at + 1].isspace():
            at += 1
        if raw[at : at + 1] == b"#":
            at = raw.index(b"\n", at) + 1
            continue
        end = at
        while not raw[end : end + 1].isspace():
            end += 1
        fields.append(int(raw[at:end]))
        at = end
    w, h, _ = fields
    depth = 1 if raw[1:2] in b"25" else 3
    if raw[1:2] in b"23":
        v = np.array(raw[at:].split()[: w * h * depth], np.uint8)
    else:
        v = np.frombuffer(raw, np.uint8, w * h * depth, at + 1)
    return v.reshape(h, w) if depth == 1 else v.reshape(h, w, 3)


def _png(raw: bytes) -> np.ndarray | None:
    at, body, head = 8, b"", None
    while at < len(raw):
        n, kind = struct.unpack(">I", raw[at : at + 4])[0], raw[at + 4 : at + 8]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", raw[at + 8 : at + 21])
        elif kind == b"IDAT":
            body += raw[at + 8 : at + 8 + n]
        at += 12 + n
    if head is None or head[2] != 8 or head[6] or head[3] not in (0, 2, 6):
        return None
    w, h, depth = head[0], head[1], {0: 1, 2: 3, 6: 4}[head[3]]
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * depth)
    out = np.zeros((h, w * depth), np.uint8)
    up = np.zeros(w * depth, np.int64)
    for y in range(h):
        mode, line = int(lines[y, 0]), lines[y, 1:].astype(np.int64)
        if mode == 2:
            line = line + up
        elif mode == 1:
            line = np.cumsum(line.reshape(w, depth), axis=0).ravel()
        elif mode in (3, 4):
            for i in range(len(line)):
                left = line[i - depth] if i >= depth else 0
                corner = up[i - depth] if i >= depth else 0
                if mode == 3:
                    guess = (left + up[i]) // 2
                else:
                    near = [abs(up[i] - corner), abs(left - corner), abs(left + up[i] - 2 * corner)]
                    guess = (left, up[i], corner)[near.index(min(near))]
                line[i] = (line[i] + guess) & 255
        up = line & 255
        out[y] = up
    return out.reshape(h, w) if depth == 1 else out.reshape(h, w, depth)[:, :, :3]


def _bmp(raw: bytes) -> np.ndarray | None:
    start, (w, h), bits = struct.unpack("<I", raw[10:14])[0], struct.unpack("<ii", raw[18:26]), struct.unpack("<H", raw[28:30])[0]
    if bits not in (24, 32):
        return None
    depth, step = bits // 8, (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(raw, np.uint8, step * abs(h), start).reshape(abs(h), step)[:, : w * depth].reshape(abs(h), w, depth)
    return (rows[::-1] if h > 0 else rows)[:, :, 2::-1]


def decode(raw: bytes) -> np.ndarray | None:
    """Gray or RGB array of a file, told by its first bytes; None if it is none of the kinds or broken."""
    try:
        if raw[:2] in (b"P2", b"P3", b"P5", b"P6"):
            return _netpbm(raw)
        if raw[:8] == _PNG:
            return _png(raw)
        if raw[:2] == b"BM":
            return _bmp(raw)
    except (ValueError, IndexError, struct.error, zlib.error):
        pass
    return None


def decoded(files: DataFrame, content: str = "content") -> DataFrame:
    """Add w, h, channels, data (nulls where a file can't be read)."""

    @F.pandas_udf(PACKED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            planes = [None if raw is None else decode(bytes(raw)) for raw in batch]
            yield pd.DataFrame([(None, None, None, None) if p is None else (p.shape[1], p.shape[0], 1 if p.ndim == 2 else 3, p.tobytes()) for p in planes], columns=["w", "h", "channels", "data"])

    return files.withColumn("_image", run(F.col(content))).select("*", "_image.*").drop("_image")


def encoded(images: DataFrame, kind: str, out: str = "content") -> DataFrame:
    """Add the file bytes of packed images (w, h, channels, data)."""

    @F.pandas_udf("binary")
    def run(w: pd.Series, h: pd.Series, channels: pd.Series, data: pd.Series) -> pd.Series:
        shapes = [(b, a) if c == 1 else (b, a, 3) for a, b, c in zip(w, h, channels)]
        return pd.Series([encode(np.frombuffer(d, np.uint8).reshape(s), kind) for s, d in zip(shapes, data)])

    return images.withColumn(out, run("w", "h", "channels", "data"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, w, h, channels, data of the image files under a path."""
    return decoded(spark.read.format("binaryFile").load(path)).select("path", "w", "h", "channels", "data")
