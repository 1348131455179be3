"""Vectorised text helpers shared by the corpus operators.

Everything here works on one Arrow slice inside a task: Spark partitions the
documents, these functions only replace per-character Python loops by NumPy
passes over the Arrow value buffer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
#: The bytes that separate words: space and TAB..CR.
SPACES = b" \t\n\x0b\x0c\r"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_BYTES = bytes(LOWER)

_RNG = np.random.default_rng(20240229)
BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
LOWER_VALUE = BYTE_VALUE[LOWER]
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 2**64)
SLICE_BYTES = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (every output bit depends on every input bit)."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        for k, base in enumerate((BASE, BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def value_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(batches, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of rows of about `most` bytes of text, one row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, off = value_buffer(batch.column(batch.schema.get_field_index(column)))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(off, off[begin] + most, "right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end


@dataclass
class Words:
    """Words of a slice: document row, byte range and 64-bit hash of each."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # n + 1 positions in the arrays above, one range for each row


def words(column: pa.Array, lower: bool = True) -> Words:
    """All runs of bytes other than SPACES, with hashes of their (ASCII lower-cased) bytes."""
    raw, off = value_buffer(column)
    n = len(off) - 1
    if len(raw) == 0:
        z = np.zeros(0, np.int64)
        return Words(z, z, z, z.astype(np.uint64), np.zeros(n + 1, np.int64))
    inside = ~IS_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((LOWER_VALUE if lower else BYTE_VALUE)[raw] * up[:-1], out=sums[1:])
    h = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    first = np.searchsorted(start, off)
    return Words(np.repeat(np.arange(n), np.diff(first)), start, end, h, first)


def shingles(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all `size`-word runs inside a document, and the row of each; shorter documents give their whole sequence."""
    h, doc = found.hash, found.doc
    counts = np.diff(found.first)
    out, rows = [], []
    if len(h) >= size:
        m = len(h) - size + 1
        acc = np.zeros(m, np.uint64)
        for j in range(size):
            acc = mix(acc + h[j : j + m])
        ok = doc[:m] == doc[size - 1 :]
        out.append(acc[ok])
        rows.append(doc[:m][ok])
    for k in range(1, size):
        short = np.flatnonzero(counts == k)
        if len(short):
            acc = np.full(len(short), U(0xA5A5 + k), np.uint64)
            for j in range(k):
                acc = mix(acc + h[found.first[short] + j])
            out.append(acc)
            rows.append(short)
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out, rows = np.concatenate(out), np.concatenate(rows)
    order = np.argsort(rows, kind="stable")
    return out[order], rows[order]


def as_long(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))
