"""N-gram Jaccard join with PartEnum signatures.

A document's set holds the hashes of its distinct word shingles.  Sets are
dealt into size bands so that linked sets lie in one band or in neighbours; a
band's instance bounds the symmetric difference of its links by k.  The
feature domain is split into n1 groups of n2 parts, n1 large enough that in
some group at most k2 parts differ, and every subset of n2 - k2 parts of a
group gives a signature: linked sets share at least one.

Equal sets are one node from the start.  Signatures meet in packed blocks: a
task first merges equal signatures of its own sets, so a signature of a large
group of copies leaves each task once.  A meeting emits a star (least set,
other set) instead of all pairs.  One star edge of each set is verified
exactly; what is then left are pairs with a common signature whose sets lie in
different components.  Sketches of four-bit sums, which can only differ where
features differ, rule out most of these, the others are verified, so no link
between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text
from ._spark import SENT_IDS, checkpointed, keyed, small_batches, table, tasks, written
from .components import components

U = np.uint64
#: Signatures or features that a task gathers before it sends them on.
BLOCK = 200_000
HUB_DEALS = 64
#: Candidate sets of one task once candidates are known; most documents have none, so later steps are small.
SETS_PER_TASK = 2_000
#: Buckets of a sketch for each feature that a link may differ by: pairs that differ in 1.2 times as many are ruled out.
BUCKETS = 8
#: Stars around other sets of a signature before all pairs: they join most of a large group of near copies at little cost.
PIVOTS = 1
#: Sets of a signature that meet in one place at a time when all pairs are looked at.
SETS_PER_DEAL = 128


@dataclass(frozen=True)
class PartEnum:
    """Signature scheme for Jaccard >= num / den."""

    num: int = 90
    den: int = 100
    n2: int = 3
    k2: int = 1
    #: Groups beyond the least number, as a share of k: they let sets with a few empty parts do without signatures of empty parts.
    slack: float = 0.0

    def bands(self, most: int) -> np.ndarray:
        """Upper ends r_i of the size bands up to size `most`, one band more."""
        ends, low = [], 1
        while not ends or low <= most or len(ends) < 2:
            ends.append(low * self.den // self.num)
            low = ends[-1] + 1
        ends.append(low * self.den // self.num)
        return np.array(ends, np.int64)

    def differences(self, r: np.ndarray) -> np.ndarray:
        """Largest symmetric difference of a link between sets of at most r features."""
        return 2 * (self.den - self.num) * r // (self.den + self.num)

    def sketches(self, feats: np.ndarray, counts: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """Words of 64 buckets, each the parity of its number of features, and the words of each set.

        Sets of one instance have equally many buckets, BUCKETS times the
        instance's k; two sets differ in as many features as in buckets at least.
        """
        ends = self.bands(int(counts.max(initial=1)))
        words = np.maximum(1, -(-BUCKETS * self.differences(ends[np.searchsorted(ends, counts) + step]) // 64))
        row = np.repeat(np.arange(len(counts)), counts)
        first = np.concatenate([[0], np.cumsum(words)])
        slot = 64 * first[row] + (_text.mix(feats ^ U(0x2545F4914F6CDD1D)) % (64 * words[row]).astype(np.uint64)).astype(np.int64)
        odd = (np.bincount(slot, minlength=64 * int(first[-1])) & 1).astype(np.uint8)
        return np.packbits(odd, bitorder="little").view(np.uint64), words

    def signatures(self, feats: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(signature, row, step) for sets given as concatenated distinct features and their counts; step 1 is the next band's instance."""
        out, rows, steps = [], [], []
        if len(feats) == 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends = self.bands(int(counts.max()))
        band = np.searchsorted(ends, counts)
        row = np.repeat(np.arange(len(counts)), counts)
        spread, value = _text.mix(feats ^ U(0x5851F42D4C957F2D)), _text.mix(feats + U(0x14057B7EF767814F))
        low, high = (value & U(0xFFFFFFFF)).astype(np.float64), (value >> U(32)).astype(np.float64)
        subsets = list(combinations(range(self.n2), self.n2 - self.k2))
        for step in (0, 1):
            instance = band + step
            k = self.differences(ends[instance])
            use = (k > 0) & (counts > 0)  # at k = 0 only equal sets link, and these are one node
            groups = np.where(use, -(-(k + 1) // (self.k2 + 1)) + np.ceil(self.slack * k).astype(np.int64), 0)
            parts = groups * self.n2
            first = np.concatenate([[0], np.cumsum(parts)])
            mine = use[row]
            at = row[mine]
            slot = first[at] + (spread[mine] % parts[at].astype(np.uint64)).astype(np.int64)
            size = int(first[-1])
            if size == 0:
                continue
            n = np.bincount(slot, minlength=size).reshape(-1, self.n2)
            lo = np.bincount(slot, low[mine], size).astype(np.uint64).reshape(-1, self.n2)
            hi = np.bincount(slot, high[mine], size).astype(np.uint64).reshape(-1, self.n2)
            owner = np.repeat(np.arange(len(counts)), groups)
            index = np.arange(len(owner)) - np.repeat(first[:-1] // self.n2, groups)
            held = np.stack([n[:, s].sum(axis=1) for s in map(list, subsets)], axis=1) > 0
            # at least `sure` groups agree on a subset: fewer groups with an empty one can't be all of them
            sure = groups - k // (self.k2 + 1)
            bare = np.bincount(owner, ~held.all(axis=1), len(counts))
            keep = held | (bare >= sure)[owner][:, None]
            for j, s in enumerate(map(list, subsets)):
                mark = (instance[owner].astype(np.uint64) << U(40)) + (index.astype(np.uint64) << U(8)) + U(j)
                sign = _text.mix(_text.mix(lo[:, s].sum(axis=1) + _text.mix(hi[:, s].sum(axis=1))) + _text.mix(mark))
                out.append(sign[keep[:, j]])
                rows.append(owner[keep[:, j]])
                steps.append(np.full(len(rows[-1]), step))
        if not out:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(out), np.concatenate(rows), np.concatenate(steps)


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every row (concatenated), their counts and each row's set id."""
    h, row = _text.shingles(_text.words(column), size)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[fresh], row[fresh]
    counts = np.bincount(row, minlength=len(column))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_text.mix(h + U(77)), dtype=np.uint64)])
    ends = np.cumsum(counts)
    ids = _text.mix(sums[ends] - sums[ends - counts] + counts.astype(np.uint64))
    return h, counts, ids


def _packed(keys: np.ndarray, ids: np.ndarray, parts: int) -> pa.RecordBatch:
    part = (keys >> U(20)) % U(parts)
    order = np.argsort(part.astype(np.uint32), kind="stable")
    keys, ids, part = keys[order], ids[order], part[order]
    own, begin = np.unique(part, return_index=True)
    end = [*begin[1:], len(part)]
    return pa.record_batch([pa.array(own.astype(np.int32)), pa.array([keys[b:e].tobytes() for b, e in zip(begin, end)], pa.binary()), pa.array([ids[b:e].tobytes() for b, e in zip(begin, end)], pa.binary())], ["part", "keys", "ids"])


def _distinct_pairs(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, id) in order, and whether each is the first of its key."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
    keys, ids = keys[fresh], ids[fresh]
    head = np.ones(len(keys), bool)
    head[1:] = keys[1:] != keys[:-1]
    return keys, ids, head


def _stars(keys: np.ndarray, ids: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least id, other id) for every key with two ids or more."""
    pivot = ids[np.maximum.accumulate(np.where(head, np.arange(len(ids)), 0))]
    return pivot[~head], ids[~head]


def _set_slices(batches, scheme: PartEnum, signs: bool = True):
    """(signatures, steps, set id of each, set ids, (features, counts)) of slices of a (set_id, feats) frame."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            lists = part.column(1)
            values = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            sign, row, step = scheme.signatures(values, counts) if signs else (None, None, None)
            ids = part.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            yield sign, step, None if row is None else ids[row], part.column(0), (values, counts)


def _meet(blocks: DataFrame) -> DataFrame:
    """(a, b, n): stars over all signatures of packed blocks, and in how many places of the shuffle they met."""

    def merge(group: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(group.column("keys").to_pylist()), np.uint64)
        ids = np.frombuffer(b"".join(group.column("ids").to_pylist()), np.uint64)
        a, b = _stars(*_distinct_pairs(keys, ids))
        pairs, n = np.unique(np.stack([a, b], axis=1), axis=0, return_counts=True) if len(a) else (np.zeros((0, 2), np.uint64), np.zeros(0, np.int64))
        return pa.table({"a": _text.as_long(np.ascontiguousarray(pairs[:, 0])), "b": _text.as_long(np.ascontiguousarray(pairs[:, 1])), "n": pa.array(n)})

    return blocks.groupBy("part").applyInArrow(merge, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _ordered(pairs: DataFrame) -> DataFrame:
    """(a, b) from (set_id, other), the lesser first, as unsigned numbers like those of the stars."""
    first = F.expr(f"(set_id ^ {-(2**63)}) < (other ^ {-(2**63)})")
    return pairs.select(F.when(first, F.col("set_id")).otherwise(F.col("other")).alias("a"), F.when(first, F.col("other")).otherwise(F.col("set_id")).alias("b"))


class JaccardJoin:
    """Documents linked by Jaccard similarity of their word-shingle sets.

    `shingle` words make a feature, two documents link when
    den * intersection >= num * union.  Texts of fewer words have their whole
    word sequence as the only feature; null and empty texts have no set and
    link with nothing.  Repeated texts are one set.  Every row is a document,
    told by id and text: ids may be null or repeated; a null id is never the
    least of a component that has another.  An empty table gives an empty
    result; other columns of docs are not read, so no name clashes.
    """

    def __init__(self, docs: DataFrame, shingle: int = 3, num: int = 90, den: int = 100, doc_col: str = "doc_id", text_col: str = "text", scheme: PartEnum | None = None, rare_share: int | None = None):
        self.spark, self.shingle = docs.sparkSession, shingle
        small_batches(self.spark)
        self.docs = keyed(docs, doc_col, text_col)
        self.scheme = scheme or PartEnum(num, den, slack=0.0 if num * 100 >= 88 * den else 0.04)
        if rare_share is None and num * 100 < 85 * den:
            rare_share = max(1, int(0.75 * num / (den - num)))
        self.rare_share = rare_share
        self.width = tasks(self.spark)

    def _few(self, df: DataFrame) -> DataFrame:
        """So many tasks as the candidate sets need."""
        return df.coalesce(self.width)

    # -- sets -----------------------------------------------------------------

    def sets(self) -> DataFrame:
        """doc, print, n_shingles, set_id (null for an empty set), written once."""
        size, kind = self.shingle, self.docs.schema["doc"].dataType.simpleString()

        def run(batches) -> Iterator[pa.RecordBatch]:
            for part in _text.slices(batches):
                _, counts, ids = shingle_sets(part.column(2), size)
                yield pa.record_batch([*part.columns[:2], pa.array(counts.astype(np.int64)), pa.array(ids.view(np.int64), mask=counts == 0)], ["doc", "print", "n_shingles", "set_id"])

        return self.docs.mapInArrow(run, f"doc {kind}, print long, n_shingles long, set_id long")

    # -- candidates -----------------------------------------------------------

    def candidates(self, docs: DataFrame) -> DataFrame:
        """(a, b): stars of sets with a common signature."""
        size, scheme, parts = self.shingle, self.scheme, 2 * tasks(self.spark)

        def flush(keys, ids) -> pa.RecordBatch:
            keys, ids, head = _distinct_pairs(np.concatenate(keys), np.concatenate(ids))
            a, b = _stars(keys, ids, head)
            pairs = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.uint64)
            own = _text.mix(_text.mix(pairs[:, 0]) + pairs[:, 1])  # a meeting of its own for each local star edge
            return _packed(np.concatenate([keys[head], own, own]), np.concatenate([ids[head], pairs[:, 0], pairs[:, 1]]), parts)

        def run(batches) -> Iterator[pa.RecordBatch]:
            keys, ids, n = [], [], 0
            for part in _text.slices(batches):
                feats, counts, own = shingle_sets(part.column(0), size)
                sign, row, _ = scheme.signatures(feats, counts)
                keys.append(sign), ids.append(own[row])
                n += len(sign)
                if n >= BLOCK:
                    yield flush(keys, ids)
                    keys, ids, n = [], [], 0
            if n:
                yield flush(keys, ids)

        return _meet(docs.select("text").mapInArrow(run, "part int, keys binary, ids binary"))

    def possible(self, sets: DataFrame) -> DataFrame:
        """set_id of all sets but those with more features of their own than any link can differ by.

        One feature in `rare_share` is counted over the corpus; a set's own
        ones all lie in the symmetric difference with any other set.
        """
        size, share, parts = self.shingle, U(self.rare_share), 2 * tasks(self.spark)
        num, den = self.scheme.num, self.scheme.den

        def flush(keys, ids) -> pa.RecordBatch:
            keys, ids, head = _distinct_pairs(np.concatenate(keys), np.concatenate(ids))
            # of a feature that several own sets share, two sets are enough to mark it; the others are marked by a key of their own
            second = ~head & np.concatenate([[False], head[:-1]])
            rest = ~head & ~second
            own = _text.mix(keys[rest] + _text.mix(ids[rest]))
            return _packed(np.concatenate([keys[~rest], own, own]), np.concatenate([ids[~rest], ids[rest], ~ids[rest]]), parts)

        def run(batches) -> Iterator[pa.RecordBatch]:
            keys, ids, n = [], [], 0
            for part in _text.slices(batches):
                feats, counts, own = shingle_sets(part.column(0), size)
                row = np.repeat(np.arange(len(counts)), counts)
                pick = (feats >> U(7)) % share == 0
                keys.append(feats[pick]), ids.append(own[row[pick]])
                n += int(pick.sum())
                if n >= BLOCK:
                    yield flush(keys, ids)
                    keys, ids, n = [], [], 0
            if n:
                yield flush(keys, ids)

        def alone(group: pa.Table) -> pa.Table:
            """How many counted features each set has that no other set has, packed by the part of the set."""
            keys, ids, head = _distinct_pairs(*(np.frombuffer(b"".join(group.column(c).to_pylist()), np.uint64) for c in ("keys", "ids")))
            last = np.concatenate([head[1:], [True]]) if len(head) else head
            own, n = np.unique(ids[head & last], return_counts=True)
            return pa.Table.from_batches([_packed(own, n.astype(np.int64), parts)])

        def summed(group: pa.Table) -> pa.Table:
            own, back = np.unique(np.frombuffer(b"".join(group.column("keys").to_pylist()), np.uint64), return_inverse=True)
            n = np.bincount(back, np.frombuffer(b"".join(group.column("ids").to_pylist()), np.int64), len(own))
            return pa.table({"set_id": _text.as_long(own), "n": pa.array(n.astype(np.int64))})

        packed = "part int, keys binary, ids binary"
        alone = self.docs.select("text").mapInArrow(run, packed).groupBy("part").applyInArrow(alone, packed).groupBy("part").applyInArrow(summed, "set_id long, n long")
        sizes = sets.where("set_id is not null").groupBy("set_id").agg(F.first("n_shingles").alias("size"))
        return sizes.join(alone, "set_id", "left").where(F.coalesce("n", F.lit(0)) * num <= (den - num) * F.col("size")).select("set_id")

    # -- verification ---------------------------------------------------------

    def features(self, docs: DataFrame, sets: DataFrame, pairs: DataFrame, first: DataFrame) -> DataFrame:
        """set_id, a, feats of every set in pairs, written once; a is the set's partner in `first`, if any."""
        size = self.shingle
        ids = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct()
        reps = sets.groupBy("set_id").agg(F.min("print").alias("print"))
        chosen = ids.join(reps, "set_id").join(first.select(F.col("b").alias("set_id"), "a"), "set_id", "left")
        chosen = chosen.select("print", "set_id", "a").join(docs, "print").select("set_id", "a", "text")

        def run(batches) -> Iterator[pa.RecordBatch]:
            for part in _text.slices(batches):
                feats, counts, _ = shingle_sets(part.column(2), size)
                yield pa.record_batch([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), _text.as_long(feats))], ["set_id", "a", "feats"])

        return written(chosen.mapInArrow(run, "set_id long, a long, feats array<long>"), "set-features")

    def _picked(self, feats: DataFrame, ids: DataFrame, name: str) -> DataFrame:
        """Features of some sets as (name, f<name>); few ids are sent to all tasks, which then read what they need without a shuffle."""
        ids = checkpointed(ids.select(F.col(name).alias("set_id")).distinct().coalesce(self.width))
        own = feats.join(F.broadcast(ids) if ids.count() <= SENT_IDS else ids, "set_id", "left_semi")
        return self._few(own.select(F.col("set_id").alias(name), F.col("feats").alias("f" + name)).dropDuplicates([name]))

    def verified(self, pairs: DataFrame, feats: DataFrame, held: bool = False) -> DataFrame:
        """(a, b, linked) by exact intersection; a hub's features go to at most HUB_DEALS groups of its pairs.

        With `held`, pairs has the features fb already.
        """
        num, den = self.scheme.num, self.scheme.den
        dealt = pairs.withColumn("deal", F.pmod(F.xxhash64("b"), F.lit(HUB_DEALS)))
        hubs = self._few(self._few(dealt.select("a", "deal").distinct()).join(self._picked(feats, pairs, "a"), "a"))
        if not held:
            dealt = self._few(self._few(dealt).join(self._picked(feats, pairs, "b"), "b"))
        sides = dealt.join(hubs, ["a", "deal"])
        small = F.size(F.array_intersect("fa", "fb"))
        return checkpointed(sides.select("a", "b", small.alias("i"), (F.size("fa") + F.size("fb")).alias("s")).select("a", "b", (F.col("i") * den >= num * (F.col("s") - F.col("i"))).alias("linked")).coalesce(self.width))

    def links(self, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Verified (u, v) edges between sets whose components are those of all links, and (node, root)."""
        docs = self.docs
        if self.rare_share is not None:
            keep = self.possible(sets)
            reps = sets.groupBy("set_id").agg(F.min("print").alias("print")).join(keep, "set_id")
            reps = checkpointed(reps.select("print"))
            docs = written(docs.join(F.broadcast(reps) if reps.count() <= SENT_IDS else reps, "print", "left_semi").select("print", "text"), "possible-texts")
        pairs = checkpointed(self.candidates(docs))
        # each set's most frequent star edge first: most others lie within a component then and need no test
        first = checkpointed(pairs.groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a")).select("a", "b"))
        feats = self.features(docs, sets, pairs, first)
        self.width = max(1, -(-feats.count() // SETS_PER_TASK))
        pairs, first = self._few(pairs), self._few(first)
        result = self.verified(feats.where("a is not null").select("a", F.col("set_id").alias("b"), F.col("feats").alias("fb")), feats, held=True)
        edges = result.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
        roots = components(edges)
        # then the other star edges between components, then stars around other sets of each signature, then all pairs
        # between components with a common signature; sketches rule most of them out before features are read
        sketches, tested, shared = self._sketches(feats), first, None
        for turn in range(PIVOTS + 2):
            if turn == 0:
                rest = self._ruled(self._across(pairs, roots), sketches)
            else:
                shared = self._shared(feats) if shared is None else shared
                rows = self._rows(shared, roots)
                rest = self._ruled(self._star_pairs(rows, turn), sketches) if turn <= PIVOTS else self._open_pairs(rows, sketches)
            more = checkpointed(self._few(rest).join(self._few(tested), ["a", "b"], "left_anti").coalesce(self.width))
            if not more.isEmpty():
                tested = tested.union(more)
                fresh = self.verified(more, feats).where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
                edges = edges.union(fresh)
                roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(fresh))
        return edges, roots

    def _across(self, pairs: DataFrame, roots: DataFrame) -> DataFrame:
        """Pairs between two components."""
        root = lambda c: self._few(roots.select(F.col("node").alias(c), F.col("root").alias("r" + c)))
        both = self._few(self._few(pairs.select("a", "b")).join(root("a"), "a", "left")).join(root("b"), "b", "left")
        return self._few(both.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b"))

    def _near(self, sketch: str, other: str, size: str, other_size: str) -> Column:
        """Can sets with these sketches of one instance link?  Buckets that differ can't be more than features that may."""
        num, den = self.scheme.num, self.scheme.den
        differ = F.aggregate(F.zip_with(sketch, other, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda a, n: a + n)
        return differ * (den + num) <= (den - num) * (F.col(size) + F.col(other_size))

    def _ruled(self, pairs: DataFrame, sketches: DataFrame) -> DataFrame:
        """Pairs (a, b) that their sketches leave possible.

        A pair meets in one instance, the larger set's own; sets more than one band apart don't link.
        """
        band = lambda c: self._few(sketches.where("step = 0").select(F.col("set_id").alias(c), F.col("instance").alias("n" + c)).dropDuplicates([c]))
        side = lambda c: self._few(sketches.select(F.col("set_id").alias(c), "instance", F.col("size").alias("n" + c), F.col("sketch").alias("s" + c)).dropDuplicates([c, "instance"]))
        met = self._few(self._few(pairs.select("a", "b")).join(band("a"), "a")).join(band("b"), "b")
        met = self._few(met.where(F.abs(F.col("na") - F.col("nb")) <= 1).select("a", "b", F.greatest("na", "nb").alias("instance")))
        both = self._few(met.join(side("a"), ["a", "instance"])).join(side("b"), ["b", "instance"])
        return both.where(self._near("sa", "sb", "na", "nb")).select("a", "b")

    def _shared(self, feats: DataFrame) -> DataFrame:
        """sign, set_id, step of the signatures that two or more candidate sets have."""
        scheme, parts = self.scheme, 2 * self.width

        def run(batches) -> Iterator[pa.RecordBatch]:
            for sign, step, ids, _, _ in _set_slices(batches, scheme):
                for k in (0, 1):
                    block = _packed(sign[step == k], ids[step == k], parts)
                    yield pa.RecordBatch.from_arrays([pa.array(2 * block.column(0).to_numpy() + k), *block.columns[1:]], ["part", "keys", "ids"])

        def merge(group: pa.Table) -> pa.Table:
            keys, ids, head = _distinct_pairs(*(np.frombuffer(b"".join(group.column(c).to_pylist()), np.uint64) for c in ("keys", "ids")))
            more = ~(head & np.append(head[1:], True)) if len(head) else head
            step = np.full(int(more.sum()), group.column("part")[0].as_py() % 2, np.int32)
            return pa.table({"sign": _text.as_long(keys[more]), "set_id": _text.as_long(ids[more]), "step": pa.array(step)})

        blocks = self._few(feats.select("set_id", "feats").mapInArrow(run, "part int, keys binary, ids binary"))
        return checkpointed(blocks.groupBy("part").applyInArrow(merge, "sign long, set_id long, step int").coalesce(self.width))

    def _sketches(self, feats: DataFrame) -> DataFrame:
        """set_id, step, instance, size, sketch of every candidate set."""
        scheme = self.scheme

        def run(batches) -> Iterator[pa.RecordBatch]:
            for _, _, _, sets, (values, counts) in _set_slices(batches, scheme, False):
                for k in (0, 1):
                    words, n = scheme.sketches(values, counts, k)
                    sketch = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), _text.as_long(words))
                    instance = np.searchsorted(scheme.bands(int(counts.max(initial=1))), counts) + k
                    yield pa.record_batch([sets, pa.array(np.full(len(counts), k, np.int32)), pa.array(instance), pa.array(counts), sketch], ["set_id", "step", "instance", "size", "sketch"])

        return checkpointed(self._few(feats.select("set_id", "feats").mapInArrow(run, "set_id long, step int, instance long, size long, sketch array<long>")))

    def _rows(self, shared: DataFrame, roots: DataFrame) -> DataFrame:
        """sign, set_id, step, comp of the signatures that sets of two components share, and in how many deals a signature's sets lie."""
        named = self._few(shared.join(self._few(roots.select(F.col("node").alias("set_id"), "root")), "set_id", "left"))
        named = named.select("sign", "set_id", "step", F.coalesce("root", "set_id").alias("comp"))
        deals = F.ceil(F.count(F.lit(1)) / SETS_PER_DEAL).cast("int")
        mixed = self._few(named.groupBy("sign").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), deals.alias("deals")).where("x <> y").select("sign", "deals"))
        return checkpointed(named.join(mixed, "sign").coalesce(self.width))

    def _star_pairs(self, rows: DataFrame, turn: int) -> DataFrame:
        """(a, b): pairs across components of each signature's sets with one of them: the one of most signatures, or in later turns a chance one.

        What near copies were made from shares more signatures than they do with each other.
        """
        weight = rows.groupBy("set_id").agg(F.count(F.lit(1)).alias("weight")) if turn == 1 else rows.select("set_id", F.lit(0).alias("weight")).distinct()
        weighed = self._few(self._few(rows).join(self._few(weight), "set_id"))
        pivots = weighed.groupBy("sign").agg(F.max_by(F.struct("set_id", "comp"), F.struct("weight", F.xxhash64("set_id", F.lit(turn)))).alias("pivot"))
        both = self._few(self._few(rows).join(self._few(pivots), "sign")).where("comp <> pivot.comp")
        return self._few(_ordered(both.select("set_id", F.col("pivot.set_id").alias("other"))).distinct())

    def _open_pairs(self, rows: DataFrame, sketches: DataFrame) -> DataFrame:
        """Pairs (a, b) across components with a common signature, but those whose sketches differ too much for a link.

        The sets of a signature are dealt, and every two deals meet in a place of their own, so no task gets a frequent signature whole.
        """
        rows = self._few(self._few(rows).join(self._few(sketches.dropDuplicates(["set_id", "step"])), ["set_id", "step"]))
        deal, each = F.pmod(F.xxhash64("set_id"), F.col("deals")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("deals") - 1))
        rows = rows.select("sign", "set_id", "comp", "size", "sketch", "deals", deal.alias("deal"))
        left, right = rows.withColumn("other", each).alias("l"), rows.withColumnRenamed("deal", "other").withColumn("deal", each).alias("r")
        place = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in ("sign", "deal", "other")]
        near = (F.col("l.set_id") < F.col("r.set_id")) & (F.col("l.comp") != F.col("r.comp")) & self._near("l.sketch", "r.sketch", "l.size", "r.size")
        both = self._few(left.join(right, place[0] & place[1] & place[2] & near)).select(F.col("l.set_id").alias("set_id"), F.col("r.set_id").alias("other"))
        return _ordered(both).distinct()

    def groups(self) -> DataFrame:
        """doc, print, n_shingles, component, stays: the least doc reachable by links, the document itself included, and whether the row is its component's one.

        Equal rows stay or go together.
        """
        sets = written(self.sets(), "shingle-sets")
        _, roots = self.links(sets)
        row = F.struct(F.col("doc").isNull().alias("bare"), "doc", "print")
        reps = sets.where("set_id is not null").groupBy("set_id").agg(F.min(row).alias("head"), F.count(F.lit(1)).alias("n"))
        known = reps.join(roots.select(F.col("node").alias("set_id"), "root"), "set_id", "left")
        least = known.where("root is not null").groupBy("root").agg(F.min("head").alias("least"))
        named = known.where("root is not null or n > 1").join(least, "root", "left").select("set_id", F.coalesce("least", "head").alias("head"))
        out = sets.join(named, "set_id", "left")
        return out.select("doc", "print", "n_shingles", F.coalesce("head.doc", "doc").alias("component"), (F.col("head").isNull() | (F.col("head.print") == F.col("print"))).alias("stays"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    join = JaccardJoin(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3, num=90, den=100)
    return join.groups().select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
