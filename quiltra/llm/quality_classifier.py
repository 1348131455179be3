"""Quality classifier: random-indexing word vectors and a two-layer network.

Every word (hashed to a bucket) and every word shape has a fixed sparse random
index vector.  A bucket's context vector sums the index vectors of the words
within two places of it over the training sample; a document is the mean of
its words' vectors and shape vectors.  A two-layer NumPy network scores the
mean, and a temperature fitted on part of the sample calibrates its logit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text
from ._spark import crc_fold, table, tasks, written

U = np.uint64
#: Bound of the labelled sample that the classifier is fitted on, chosen by the hash of the id.
TRAIN_ROWS = 12_000
BUCKETS, DIM, BLOCKS = 1 << 15, 32, 64
SHAPES, SHAPE_DIM = 128, 32
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 256, 5e-3, 1e-4
THRESHOLD = 0.7
HELD_OUT = (4, 2)

_SYMBOL, _BANG, _DIGIT, _UPPER, _SMALL = (np.zeros(256, np.int32) for _ in range(5))
_SYMBOL[list(b"#*$%&|<>@=~^_\\{}[]")] = 1
_BANG[list(b"!?")] = 1
_DIGIT[48:58] = 1
_UPPER[65:91] = 1
_SMALL[97:123] = 1


def index_vectors(n: int, dim: int, seed: int, nonzero: int = 4) -> np.ndarray:
    """Sparse ternary random vectors, the same on every machine."""
    rng = np.random.default_rng(seed)
    out = np.zeros((n, dim), np.float32)
    at = rng.integers(0, dim, (n, nonzero))
    np.add.at(out, (np.repeat(np.arange(n), nonzero), at.ravel()), rng.choice([-1.0, 1.0], n * nonzero).astype(np.float32))
    return out


def tokens(column: pa.Array) -> tuple[_text.Words, np.ndarray, np.ndarray]:
    """Words of a slice, their buckets and shapes (case, symbols, marks, digits, repetition, length)."""
    found = _text.words(column)
    raw, _ = _text.value_buffer(column)
    bucket = (found.hash >> U(40)).astype(np.int64) % BUCKETS

    def has(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags[raw])])
        return sums[found.end] - sums[found.start]

    size = found.end - found.start
    upper, small = has(_UPPER), has(_SMALL)
    again = np.zeros(len(size), bool)
    again[1:] = (found.hash[1:] == found.hash[:-1]) & (found.doc[1:] == found.doc[:-1])
    shape = ((upper >= 2) & (small == 0)) * 1 + (has(_SYMBOL) > 0) * 2 + (has(_BANG) > 0) * 4 + (has(_DIGIT) > 0) * 8 + again * 16 + np.digitize(size, [4, 10, 20]) * 32
    return found, bucket, shape


def _mean(rows: np.ndarray, found: _text.Words, n: int) -> np.ndarray:
    counts = np.diff(found.first)
    out = np.zeros((n, rows.shape[1]), np.float32)
    some = counts > 0
    if some.any():
        out[some] = np.add.reduceat(rows, found.first[:-1][some], axis=0) / counts[some][:, None]
    return out


def pooled(column: pa.Array, vectors: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """One row of features per document; all zero but the length for an empty text."""
    found, bucket, shape = tokens(column)
    n = len(column)
    length = np.log1p(np.diff(found.first)).astype(np.float32)[:, None]
    return np.hstack([_mean(vectors[bucket], found, n), _mean(shapes[shape], found, n), length])


def context_vectors(sample: DataFrame, buckets: int = BUCKETS, dim: int = DIM) -> np.ndarray:
    """Context plus own index vector of each bucket, of unit length; partial sums meet block by block."""
    size = buckets // BLOCKS

    def run(batches) -> Iterator[pa.RecordBatch]:
        index = index_vectors(buckets, dim, 11)
        total = np.zeros((buckets, dim), np.float32)
        for part in _text.slices(batches):
            found, bucket, _ = tokens(part.column(0))
            order = np.argsort(bucket, kind="stable")
            around = np.zeros((len(bucket), dim), np.float32)
            for k in (1, 2):
                near = found.doc[k:] == found.doc[:-k]
                around[k:][near] += index[bucket[:-k][near]]
                around[:-k][near] += index[bucket[k:][near]]
            own, begin = np.unique(bucket[order], return_index=True)
            if len(own):
                total[own] += np.add.reduceat(around[order], begin, axis=0)
        yield pa.record_batch([pa.array(np.arange(BLOCKS, dtype=np.int32)), pa.array([total[i * size : (i + 1) * size].tobytes() for i in range(BLOCKS)], pa.binary())], ["block", "data"])

    def add(group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.float32) for x in group.column("data").to_pylist()]
        return pa.table({"block": group.column("block").slice(0, 1).cast(pa.int32()), "data": pa.array([np.sum(parts, axis=0, dtype=np.float64).astype(np.float32).tobytes()], pa.binary())})

    total = np.zeros((buckets, dim), np.float32)
    for row in sample.select("text").mapInArrow(run, "block int, data binary").groupBy("block").applyInArrow(add, "block int, data binary").collect():  # BLOCKS rows
        total[row["block"] * size : (row["block"] + 1) * size] = np.frombuffer(bytes(row["data"]), np.float32).reshape(size, dim)
    norm = np.linalg.norm(total, axis=1, keepdims=True)
    return (total / np.maximum(norm, 1e-9) + 0.5 * index_vectors(buckets, dim, 11)).astype(np.float32)


@dataclass
class Network:
    """Standardised input, one tanh layer, one logit, a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, seed: int = 5) -> Network:
        """Adam on four fifths of the rows, the temperature on the last fifth; one class alone gives its smoothed share."""
        dim = x.shape[1]
        if len(np.unique(y)) < 2:
            share = (y.sum() + 1) / (len(y) + 2)
            return cls(np.zeros(dim), np.ones(dim), np.zeros((dim, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(share / (1 - share))))
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(x))
        held, used = order[: max(1, len(x) // 5)], order[max(1, len(x) // 5) :]
        net = cls(x[used].mean(0), x[used].std(0) + 1e-3, rng.normal(0, dim**-0.5, (dim, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
        z = (x - net.mean) / net.scale
        params = [net.w1, net.b1, net.w2, np.zeros(1)]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(EPOCHS):
            for i in range(0, len(used), BATCH):
                b = used[i : i + BATCH]
                h = np.tanh(z[b] @ params[0] + params[1])
                p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -30, 30)))
                d = (p - y[b]) / len(b)
                back = np.outer(d, params[2]) * (1 - h * h)
                grads = [z[b].T @ back + DECAY * params[0], back.sum(0), h.T @ d + DECAY * params[2], d.sum(keepdims=True)]
                t += 1
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    params[k] -= RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
            rng.shuffle(used)
        net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
        net.temperature = fitted_temperature(net.logit(x[held]), y[held])
        return net


#: Temperatures tried on the rows kept from training: under 1 sharpens an under-confident network, above 1 softens an over-confident one.
TEMPERATURES = np.geomspace(0.25, 8, 61)


def fitted_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss."""
    loss = [np.mean(np.logaddexp(0, -np.where(y == 1, 1, -1) * logits / q)) for q in TEMPERATURES]
    return float(TEMPERATURES[int(np.argmin(loss))])


class QualityClassifier:
    """fit(docs, labels) on a bounded labelled sample, score(docs) for every row.

    Ids, languages, sources and labels are never inputs of a score, so equal
    texts get equal scores whatever their ids.  Null and empty texts are scored
    from an all-zero mean; a sample without rows gives 0.5 everywhere.  The
    sample is the labelled rows of least id hash, ties by id and label; a row
    labelled twice counts twice, null ids are never labelled.  score() keeps all
    columns of docs but one named like the score; a text of any length is read
    whole; an empty table gives an empty result.
    """

    def __init__(self, doc_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD):
        self.doc_col, self.text_col, self.label_col, self.train_rows, self.threshold = doc_col, text_col, label_col, train_rows, threshold

    def fit(self, docs: DataFrame, labels: DataFrame) -> QualityClassifier:
        """Learn from labelled rows outside the held-out fold, `train_rows` of them at most."""
        known = labels.select(F.col(self.doc_col).alias("doc"), F.col(self.label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1)).where(crc_fold(F.col("doc"), HELD_OUT[0]) != HELD_OUT[1])
        chosen = known.orderBy(F.xxhash64("doc"), "doc", "label").limit(self.train_rows)  # the bound of the sample
        rows = docs.select(F.col(self.doc_col).alias("doc"), F.col(self.text_col).alias("text")).join(F.broadcast(chosen), "doc")
        sample = written(rows.select("text", "label").repartition(max(1, min(24, tasks(docs.sparkSession)))), "labelled-sample")
        self.vectors = vectors = context_vectors(sample)
        self.shapes = shapes = index_vectors(SHAPES, SHAPE_DIM, 12)

        def run(batches) -> Iterator[pa.RecordBatch]:
            for part in _text.slices(batches):
                x = pooled(part.column(0), vectors, shapes)
                yield pa.record_batch([part.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["label", "x"])

        rows = sample.select("text", "label").mapInArrow(run, "label int, x binary").collect()  # train_rows at most
        dim = DIM + SHAPE_DIM + 1
        pairs = sorted((bytes(r["x"]), r["label"]) for r in rows)  # one order, whatever the tasks' order
        x = np.array([np.frombuffer(p[0], np.float32) for p in pairs], np.float64).reshape(-1, dim)
        y = np.array([p[1] for p in pairs], np.float64)
        self.network = Network.fit(x, y) if len(y) else Network(np.zeros(dim), np.ones(dim), np.zeros((dim, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0)
        return self

    def score(self, docs: DataFrame, score: str = "score") -> DataFrame:
        """All columns of docs (one named like `score` is replaced) and the calibrated probability."""
        sent = docs.sparkSession.sparkContext.broadcast((self.vectors, self.shapes, self.network))
        docs = docs.drop(score)
        fields, text_col = [f.name for f in docs.schema.fields], self.text_col

        def run(batches) -> Iterator[pa.RecordBatch]:
            vectors, shapes, network = sent.value
            for part in _text.slices(batches, text_col):
                p = network.score(pooled(part.column(fields.index(text_col)), vectors, shapes))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p)], [*fields, score])

        from pyspark.sql.types import DoubleType, StructField, StructType

        return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(score, DoubleType())]))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = QualityClassifier().fit(docs, table(spark, sf_dir, "labels"))
    out = model.score(docs)
    return out.select("doc_id", (crc_fold(F.col("doc_id"), HELD_OUT[0]) == HELD_OUT[1]).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
