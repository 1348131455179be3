"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into blocks of words; two neighbouring blocks are a passage.
Passages are TF-IDF vectors over the benchmark's words (other words add
nothing to a product with an item), with document frequencies over the whole
corpus.  A distributed randomised SVD gives the latent space: each task adds up
Y = A'(A Omega) of its own passages, and the singular values and right singular
vectors of A follow from Y and Omega'Y alone (Nystrom), without another pass;
the leading `rank` of them are kept.  The items take part with half of the
weight, so that their rare words keep a direction.  Every passage is
compared with every item by latent cosine, in blocks; an item of more words
than a passage is cut into overlapping parts of a passage's length, so that a
passage of its copy is like one of them however long it is.  A candidate is
confirmed by the longest common subsequence of its words with the item's and
with the item's closing words, its answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text
from ._spark import summed_over_tasks, table, text_bytes
from .ppm import HashTable

U = np.uint64
BLOCK_WORDS = 32
#: Singular vectors kept, and further columns of the sketch that make these exact.
RANK, OVERSAMPLE = 224, 32
#: Weight of the items among the rows of A.
ITEM_SHARE = 0.5
#: Words in more blocks than this share say little; every item keeps its RAREST anyway.
MAX_DF, RAREST = 0.005, 6
COSINE = 0.35
LCS_SHARE, ANSWER_SHARE = 0.6, 0.5
#: An item's last words, a quarter of it, are its answer.
ANSWER_PART = 4
#: Bytes of text that a task's matrices are made of at a time.
SLICE = 2 << 20
#: Bytes of item texts that one fit and one pass hold; a larger benchmark takes more of them.
ITEM_BYTES = 1 << 20


def item_words(text: str | None) -> np.ndarray:
    return _text.words(pa.array([text or ""])).hash


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, one machine word operation a place of b (bit-parallel)."""
    places: dict[int, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        m = places.get(w)
        if m is not None:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def parts(n: int) -> list[tuple[int, int]]:
    """Begin and end of the parts of an item of n words: passages a block apart, the last one at the end."""
    size = 2 * BLOCK_WORDS
    return [(b, b + size) for b in [*range(0, n - size, BLOCK_WORDS), n - size]] if n > size else [(0, n)]


class Terms:
    """Benchmark words of a slice of documents, by block."""

    def __init__(self, column: pa.Array, vocabulary: HashTable):
        self.found = _text.words(column)
        counts = np.diff(self.found.first)
        blocks = -(-counts // BLOCK_WORDS)
        self.first_block = np.concatenate([[0], np.cumsum(blocks)])
        self.n_blocks = int(self.first_block[-1])
        place = np.arange(len(self.found.hash)) - np.repeat(self.found.first[:-1], counts)
        col = vocabulary.find(self.found.hash).astype(np.int64)
        hit = np.flatnonzero(col >= 0)
        self.col = col[hit]
        self.block = (place[hit] // BLOCK_WORDS) + self.first_block[self.found.doc[hit]]
        self.doc_of_block = np.repeat(np.arange(len(counts)), blocks)


def _by_block(terms: Terms, used: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks that have terms in use, the sums of these terms' vectors, and each term's column and row of the sums."""
    use = used[terms.col]
    col, block = terms.col[use], terms.block[use]
    if not len(col):
        return np.zeros(0, np.int64), np.zeros((0, vectors.shape[1]), np.float32), col, col
    head = np.ones(len(block), bool)
    head[1:] = block[1:] != block[:-1]
    begin = np.flatnonzero(head)
    return block[begin], np.add.reduceat(vectors[col], begin, axis=0), col, np.cumsum(head) - 1


def _nystrom(y: np.ndarray, omega: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """The leading right singular vectors (columns) and singular values of A, from Y = A'A Omega."""
    shift = np.sqrt(len(y)) * np.finfo(np.float64).eps * max(float(np.linalg.norm(y)), 1e-30)
    y = y + shift * omega
    core = omega.T @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    keep = values > values[-1] * 1e-10
    left, squares, _ = np.linalg.svd(y @ (vectors[:, keep] / np.sqrt(values[keep])), full_matrices=False)
    return left[:, :rank], np.sqrt(np.maximum(squares[:rank] ** 2 - shift, 0))


class Decontamination:
    """fit(docs, items), then matches(docs).

    Texts of null or no words match nothing, and an item without words is never
    found.  Ids may be null, repeated and of any type: every row of docs and of
    items stands for itself, so repeated rows are matched each and equal items
    are found each.  Of one row and item the passage with the largest share
    counts, then the larger answer, then the larger cosine.  Other columns are
    not read.  Empty tables give an empty result.
    """

    def __init__(self, rank: int = RANK, cosine: float = COSINE, lcs_share: float = LCS_SHARE, answer_share: float = ANSWER_SHARE, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", item_share: float = ITEM_SHARE, item_bytes: int = ITEM_BYTES):
        self.rank, self.cosine, self.lcs_share, self.answer_share = rank, cosine, lcs_share, answer_share
        self.doc_col, self.text_col, self.item_col, self.item_text = doc_col, text_col, item_col, item_text
        self.item_share, self.item_bytes = item_share, item_bytes

    def fit(self, docs: DataFrame, items: DataFrame) -> Decontamination:
        """A latent space for each block of items; a block's texts are `item_bytes` or so, whatever the benchmark's size."""
        self.item_kind = items.schema[self.item_col].dataType.simpleString()
        items = items.select(F.col(self.item_col).alias("item"), F.coalesce(F.col(self.item_text), F.lit("")).alias("text"))
        blocks = max(1, -(-text_bytes(items) // self.item_bytes))
        text = docs.select(F.col(self.text_col).alias("text"))
        self.blocks = []
        for b in range(blocks):
            rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).orderBy("item", "text").toArrow()
            found = [(i, w) for i, w in enumerate(map(item_words, rows.column("text").to_pylist())) if len(w)]
            if found:
                ids = rows.column("item").combine_chunks().take(pa.array([i for i, _ in found]))
                self.blocks.append(self._space(text, ids, [w for _, w in found]))
        return self

    def _space(self, text: DataFrame, ids: pa.Array, items: list[np.ndarray]) -> dict:
        vocabulary = np.unique(np.concatenate(items))
        known, size = HashTable(vocabulary), len(vocabulary)

        def frequencies(batches) -> np.ndarray:
            total = np.zeros(size + 1, np.int64)
            for part in _text.slices(batches):
                terms = Terms(part.column(0), known)
                pairs = terms.block * size + terms.col
                pairs = np.sort(pairs.astype(np.int32) if terms.n_blocks * size < 2**31 else pairs)
                pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] if len(pairs) else pairs
                total[:size] += np.bincount(pairs % size, minlength=size)
                total[size] += terms.n_blocks
            return total

        # float32 sums of one task are exact up to 2**24 blocks; tasks are added as float64
        df = summed_over_tasks(text, frequencies, size + 1)
        n, df = df[-1], df[:-1]
        idf = np.log((n + 1) / (df + 1)) + 0.1
        keep = df <= max(5.0, MAX_DF * n)
        cuts = [(i, b, e) for i, w in enumerate(items) for b, e in parts(len(w))]
        columns = [np.searchsorted(vocabulary, items[i][b:e]) for i, b, e in cuts]
        for c in columns:
            own = np.unique(c)
            keep[own[np.argsort(df[own], kind="stable")[:RAREST]]] = True
        weights = np.where(keep, idf, 0).astype(np.float32)
        rank = min(self.rank, size)
        width = min(rank + OVERSAMPLE, size)
        omega = np.random.default_rng(3).standard_normal((size, width)).astype(np.float32)

        weighted, used = omega * weights[:, None], weights > 0

        def sketch(batches) -> np.ndarray:
            total = np.zeros((size + 1, width), np.float32)
            for part in _text.slices(batches, most=SLICE):
                own, y, col, row = _by_block(Terms(part.column(0), known), used, weighted)
                if not len(own):
                    continue
                order = np.argsort(col.astype(np.uint16) if size < 65536 else col, kind="stable")
                col = col[order]
                head = np.ones(len(col), bool)
                head[1:] = col[1:] != col[:-1]
                begin = np.flatnonzero(head)
                total[col[begin]] += np.add.reduceat(y[row[order]], begin, axis=0)
                total[size, 0] += float((weights[col] ** 2).sum())
            total[:size] *= weights[:, None]
            return total.ravel()

        corpus = summed_over_tasks(text, sketch, (size + 1) * width).reshape(size + 1, width)
        own, energy = np.zeros((size, width)), 0.0
        for c in columns:
            terms, n_terms = np.unique(c, return_counts=True)
            values = weights[terms] * n_terms
            own[terms] += np.outer(values, values @ omega[terms])
            energy += float(values @ values)
        share = self.item_share
        # relative weights of corpus and items; without a corpus the items alone make the space
        both = (1 - share) * corpus[:size] + share * max(corpus[size, 0], 1.0) / max(energy, 1e-9) * own
        basis, values = _nystrom(both, omega.astype(np.float64), rank)
        basis = basis.astype(np.float32)
        latent = np.stack([weights[c] @ basis[c] for c in columns])
        latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
        return {"vocabulary": vocabulary, "weights": weights, "basis": basis, "singular": values, "latent": latent, "item_of": np.array([i for i, _, _ in cuts]), "ids": ids, "items": [[int(x) for x in w] for w in items]}

    def matches(self, docs: DataFrame) -> DataFrame:
        """doc_col, item_col, cosine, lcs, answer: confirmed pairs, the best passage of each."""
        schema = f"doc {docs.schema[self.doc_col].dataType.simpleString()}, item {self.item_kind}, cosine double, lcs double, answer double"
        rows = docs.select(F.col(self.doc_col).alias("doc"), F.col(self.text_col).alias("text"))
        out = docs.sparkSession.createDataFrame([], schema)
        for space in self.blocks:
            some = self._pass(rows, space, schema)
            out = some if space is self.blocks[0] else out.unionByName(some)
        return out.toDF(self.doc_col, self.item_col, "cosine", "lcs", "answer")

    def _pass(self, rows: DataFrame, space: dict, schema: str) -> DataFrame:
        sent = rows.sparkSession.sparkContext.broadcast(space)  # bounded by item_bytes
        cosine, lcs_share, answer_share = self.cosine, self.lcs_share, self.answer_share

        def run(batches) -> Iterator[pa.RecordBatch]:
            vocabulary, weights, basis, latent, item_of, ids, items = (sent.value[k] for k in ("vocabulary", "weights", "basis", "latent", "item_of", "ids", "items"))
            known = HashTable(vocabulary)
            weighted, used = basis * weights[:, None], weights > 0
            bags = [set(w) for w in items]
            for part in _text.slices(batches):
                terms = Terms(part.column(1), known)
                own, z, _, _ = _by_block(terms, used, weighted)
                best: dict[tuple[int, int], tuple[float, float, float]] = {}
                if len(own):
                    # a passage is a block and the one after it, in one document: its products are the sums of theirs
                    start = np.union1d(own, own - 1)
                    start = start[start >= 0]
                    after = np.minimum(start + 1, terms.n_blocks - 1)
                    first, second = (np.minimum(np.searchsorted(own, x), len(own) - 1) for x in (start, after))
                    has_first = own[first] == start
                    has_second = (own[second] == start + 1) & (terms.doc_of_block[after] == terms.doc_of_block[start])
                    length = np.einsum("ij,ij->i", z, z)
                    both = has_first & has_second
                    norm = np.where(has_first, length[first], 0) + np.where(has_second, length[second], 0)
                    norm[both] += 2 * np.einsum("ij,ij->i", z[first[both]], z[second[both]])
                    norm = np.sqrt(np.maximum(norm, 1e-12))
                    step = max(1, 4_000_000 // max(1, len(latent)))
                    for i in range(0, len(start), step):
                        f, g = first[i : i + step], second[i : i + step]
                        low = min(f.min(), g.min())
                        product = z[low : max(f.max(), g.max()) + 1] @ latent.T
                        cos = product[f - low] * has_first[i : i + step, None]
                        cos += product[g - low] * has_second[i : i + step, None]
                        cos /= norm[i : i + step, None]
                        near: dict[tuple[int, int], float] = {}  # passage and item: of its parts, the nearest one's cosine
                        for p, q in zip(*np.nonzero(cos >= cosine)):
                            pair = int(p), int(item_of[q])
                            near[pair] = max(near.get(pair, -1.0), float(cos[p, q]))
                        for (p, q), like in near.items():
                            doc = int(terms.doc_of_block[start[i + p]])
                            lo, hi = terms.found.first[doc], terms.found.first[doc + 1]
                            begin = lo + (start[i + p] - terms.first_block[doc]) * BLOCK_WORDS
                            words = items[q]
                            n = len(words)
                            reach = max(BLOCK_WORDS // 2, n - BLOCK_WORDS)
                            region = terms.found.hash[max(lo, begin - reach) : min(hi, begin + 2 * BLOCK_WORDS + reach)].tolist()
                            if len(bags[q].intersection(region)) < lcs_share * len(bags[q]) * 0.8:
                                continue
                            share = lcs(words, region) / n
                            if share < lcs_share:
                                continue
                            tail = words[-max(1, n // ANSWER_PART) :]
                            answer = lcs(tail, region) / len(tail)
                            if answer < answer_share:
                                continue
                            key, value = (doc, q), (share, answer, like)
                            if value > best.get(key, (0.0, 0.0, 0.0)):
                                best[key] = value
                docs_ = pa.array([d for d, _ in best], pa.int64())
                found = list(best.values())
                yield pa.RecordBatch.from_arrays([part.column(0).take(docs_), ids.take(pa.array([q for _, q in best], pa.int64())), pa.array([v[2] for v in found], pa.float64()), pa.array([v[0] for v in found], pa.float64()), pa.array([v[1] for v in found], pa.float64())], ["doc", "item", "cosine", "lcs", "answer"])

        return rows.mapInArrow(run, schema)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return Decontamination().fit(docs, table(spark, sf_dir, "benchmark")).matches(docs)
