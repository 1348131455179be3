"""Source divergence audit: how far the term frequencies of each source are from those of its language.

Counts of (lang, source, term) are made in tasks and merged by Spark.  The terms
with which a group leaves its language most are searched by upper bounds: a
group's terms of one count form a bucket, all of one probability p, and the
least probability q of the language inside it bounds f = p - q from above.
Buckets are taken by their bound, first those that hold enough terms to fix a
k-th value, then every other one whose bound is not strictly below that; no
bucket beyond is looked at.  Distances of two sources are sums over postings: a
pair starts from the distance that it would have without any term, buckets give
what each source adds alone, and the postings of a term what two sources that
both hold it take back.  All arithmetic is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import table, written
from ._text import LOWER, slices, value_buffer

MIN_DOCS, ADDED, MOST_TERMS = 30, 5, 50
SCALE = 1_000_000_000
#: Bytes of text that a task counts at once.
COUNT_BYTES = 4 << 20
#: Sources of a language that one matrix of pairs holds on each side, sources whose buckets one task holds, and postings of one group of terms.
BLOCK, OWN, POSTINGS = 512, 32, 200_000

IN_TERM = np.zeros(256, bool)
IN_TERM[65:91] = IN_TERM[97:123] = IN_TERM[128:] = True


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, docs, n of docs (lang, source, text), none null; a row with a null term counts the documents of each group."""

    def run(batches):
        for batch in slices(batches, most=COUNT_BYTES):
            raw, off = value_buffer(batch.column("text"))
            langs, sources = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
            code = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
            groups, code = np.unique(code, return_inverse=True)
            inside = IN_TERM[raw]
            edge = np.zeros(len(raw) + 1, bool)
            edge[off] = True
            begins, ends = inside.copy(), inside.copy()
            begins[1:] &= ~inside[:-1] | edge[1:-1]
            ends[:-1] &= ~inside[1:] | edge[1:-1]
            start, length = np.flatnonzero(begins), np.flatnonzero(ends) + 1
            length -= start
            held = np.zeros(len(start) + 1, np.int64)
            np.cumsum(length, out=held[1:])
            data = LOWER[raw[inside]]
            terms = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(held), pa.py_buffer(data)).dictionary_encode()
            t = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            size = max(1, len(terms.dictionary))
            row = np.searchsorted(off, start, "right") - 1
            keys, n = np.unique(code[row] * size + t, return_counts=True)
            once = np.unique(row * size + t)  # a document's terms
            in_docs = np.unique(code[once // size] * size + once % size, return_counts=True)[1]
            g = groups[np.concatenate([keys // size, np.arange(len(groups))])]
            yield pa.record_batch(
                [
                    langs.dictionary.take(pa.array(g // len(sources.dictionary))),
                    sources.dictionary.take(pa.array(g % len(sources.dictionary))),
                    pa.concat_arrays([terms.dictionary.take(pa.array(keys % size)).cast(pa.string()), pa.nulls(len(groups), pa.string())]),
                    pa.array(np.concatenate([in_docs, np.bincount(code, minlength=len(groups))])),
                    pa.array(np.concatenate([n, np.zeros(len(groups), np.int64)])),
                ],
                ["lang", "source", "term", "docs", "n"],
            )

    found = docs.mapInArrow(run, "lang string, source string, term string, docs long, n long")
    return found.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def probability(count: Column, total: Column, kept: Column, added: int) -> Column:
    """1 + floor(SCALE * (count + added) / (total + added * kept)), exact for any count of 64 bits."""
    wide = lambda c, digits: c.cast(f"decimal({digits},0)")
    over = (wide(count, 19) + wide(F.lit(added), 5)) * wide(F.lit(SCALE), 10)
    below = wide(total, 19) + wide(F.lit(added), 5) * wide(kept, 15)
    return F.lit(1) + F.call_function("div", over, below)


class SourceDivergence:
    """Counts of a corpus, and the two parts of its audit.

    Null texts, languages and sources are empty strings, which form groups of
    their own; a group whose documents hold no term still stands in part `pair`.
    Repeated rows count as often as they occur, ties are ranked by the item's
    UTF-8 bytes, an empty table gives empty parts.  Other columns are not read,
    so no name can clash.  A text is counted as a whole inside one task.
    """

    def __init__(self, docs: DataFrame, text_col="text", lang_col="lang", source_col="source", min_docs=MIN_DOCS, added=ADDED, block=BLOCK, own=OWN, postings=POSTINGS):
        docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for k, c in (("lang", lang_col), ("source", source_col), ("text", text_col))])
        self.added, self.block, self.own, self.deal = added, block, own, postings
        counts = written(term_counts(docs), "source-terms")
        kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all")).where(F.col("docs") >= min_docs)
        kept = written(kept.select("lang", "term", "all"), "source-kept")
        langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all").alias("lang_total"))
        found = counts.join(kept, ["lang", "term"])
        totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = counts.where("term is null").select("lang", "source").join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
        at = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
        groups = groups.select("lang", "source", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"), F.coalesce("total", F.lit(0)).alias("total"), at.alias("at"))
        #: lang, source, kept, lang_total, total, at: one row for each source of a language
        self.groups = written(groups, "source-groups")
        p, q = probability(F.col("n"), F.col("total"), F.col("kept"), added), probability(F.col("all"), F.col("lang_total"), F.col("kept"), added)
        #: lang, source, at, term, n, p, q: kept terms that a source holds
        self.postings = written(found.join(self.groups, ["lang", "source"]).select("lang", "source", "at", "term", "n", p.alias("p"), q.alias("q")), "source-postings")
        #: lang, source, at, n, p, least, terms, above: a source's terms of one count
        self.buckets = written(
            self.postings.groupBy("lang", "source", "at", "n").agg(F.first("p").alias("p"), F.min("q").alias("least"), F.count("*").alias("terms"), F.count_if(F.col("p") > F.col("q")).alias("above")), "source-buckets"
        )

    def terms(self, most: int = MOST_TERMS) -> DataFrame:
        """lang, source, item, value, rank: a source's terms of largest p - q > 0, by best-first search in buckets."""
        bound = F.col("p") - F.col("least")
        best_first = Window.partitionBy("lang", "source").orderBy(bound.desc(), "n")
        # buckets up to the one with which enough terms above their language are held
        before = F.coalesce(F.sum("above").over(best_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        buckets = written(self.buckets.where(bound > 0).select("lang", "source", "n", bound.alias("bound"), (before < most).alias("first")), "source-bounds")
        value = F.col("p") - F.col("q")

        def ranked(chosen: DataFrame) -> DataFrame:
            rows = self.postings.join(chosen.select("lang", "source", "n"), ["lang", "source", "n"]).where(value > 0)
            rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(value.desc(), "term"))
            return rows.select("lang", "source", F.col("term").alias("item"), value.alias("value"), rank.alias("rank")).where(F.col("rank") <= most)

        kth = ranked(buckets.where("first")).where(F.col("rank") == most).select("lang", "source", F.col("value").alias("kth"))
        seen = buckets.join(kth, ["lang", "source"], "left").where(F.col("first") | F.col("kth").isNull() | (F.col("bound") >= F.col("kth")))
        return ranked(seen)

    def pairs(self) -> DataFrame:
        """lang, source, item, value, rank: all other sources of the language by their distance."""
        none = probability(F.lit(0), F.col("total"), F.col("kept"), self.added)
        groups = self.groups.select("lang", "source", "at", "kept", F.when(F.col("kept") > 0, none).otherwise(0).alias("none"))
        parts = self._alone(groups).unionByName(self._both(groups))
        found = parts.groupBy("lang", "at", "to").agg(F.sum("value").alias("value"))
        names = groups.select("lang", "source", "at")
        out = found.join(names, ["lang", "at"]).join(names.toDF("lang", "item", "to"), ["lang", "to"])
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
        return out.select("lang", "source", "item", "value", rank.alias("rank"))

    def _alone(self, groups: DataFrame) -> DataFrame:
        """lang, at, to, value: the distance as if no term were in both, half of it in each direction's row.

        The buckets of a few sources meet p that every source of the language has for terms it lacks; ordered
        buckets with running sums give a source's part against any such p by one search.
        """
        size = self.own
        own = F.floor(F.col("at") / size)
        blocks = groups.groupBy("lang").agg((F.floor(F.max("at") / size) + 1).alias("blocks"))
        all_to = groups.join(blocks, "lang").select("lang", "at", "kept", "none", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"))
        held = self.buckets.select("lang", own.alias("own"), "at", "p", "terms")

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            to, kept, none = (right.column(c).to_numpy().astype(np.int64) for c in ("at", "kept", "none"))
            order = np.argsort(to)
            to, kept, none = to[order], kept[order], none[order]
            at, p, terms = (left.column(c).to_numpy().astype(np.int64) for c in ("at", "p", "terms"))
            lang, block = right.column("lang")[0].as_py(), right.column("own")[0].as_py()
            out = []
            for k in range(block * size, min(len(to), (block + 1) * size)):  # places are 0, 1, 2, ...
                mine = at == k
                order = np.argsort(p[mine])
                ps, m = p[mine][order], terms[mine][order]
                below = np.searchsorted(ps, none)
                n, s = (np.concatenate([[0], np.cumsum(x)]) for x in (m, m * ps))
                gap = np.abs(none[k] - none)
                away = none * n[below] - s[below] + (s[-1] - s[below]) - none * (n[-1] - n[below]) - n[-1] * gap
                others = to != k
                out += [(np.full(others.sum(), k), to[others], (away + kept * gap)[others]), (to[others], np.full(others.sum(), k), away[others])]
            columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
            return pa.table([pa.array([lang] * len(columns[0]), pa.string()), *map(pa.array, columns)], ["lang", "at", "to", "value"])

        return held.groupBy("lang", "own").cogroup(all_to.groupBy("lang", "own")).applyInArrow(meet, "lang string, at long, to long, value long")

    def _both(self, groups: DataFrame) -> DataFrame:
        """lang, at, to, value: what the terms that two sources both hold take back, in both directions.

        Matrices of block x block sources are added up inside a group of terms; no pair of a single term leaves it.
        """
        block = self.block
        sizes = self.postings.groupBy("lang").agg(F.count("*").alias("held"), (F.floor(F.max("at") / block) + 1).alias("blocks"))
        rows = self.postings.join(groups.select("lang", "at", "none"), ["lang", "at"]).join(sizes, "lang")
        own = F.floor(F.col("at") / block)
        deal = F.pmod(F.xxhash64("term"), F.ceil(F.col("held") / self.deal))
        rows = rows.select("lang", "term", "at", "p", "none", own.alias("own"), deal.alias("deal"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
        rows = rows.select("lang", "term", "at", "p", "none", "deal", F.least("own", "with").alias("a"), F.greatest("own", "with").alias("b"))

        def add(group: pa.Table) -> pa.Table:
            a, b = group.column("a")[0].as_py(), group.column("b")[0].as_py()
            of = group.column("lang")[0].as_py()
            term = group.column("term").combine_chunks().dictionary_encode()
            term = (term if isinstance(term, pa.DictionaryArray) else term.combine_chunks()).indices.to_numpy(zero_copy_only=False)
            at, p, none = (group.column(c).to_numpy().astype(np.int64) for c in ("at", "p", "none"))
            order = np.lexsort((at, term))
            term, at, p, none = term[order], at[order], p[order], none[order]
            low, high = at - a * block, at - b * block
            total = np.zeros(block * block, np.int64)
            for step in range(1, len(term)):
                i = np.flatnonzero(term[step:] == term[:-step])
                if not len(i):
                    break
                j = i + step
                if a != b:
                    apart = (at[i] // block == a) & (at[j] // block == b)
                    i, j = i[apart], j[apart]
                lost = np.abs(p[i] - p[j]) - np.abs(p[i] - none[j]) - np.abs(none[i] - p[j]) + np.abs(none[i] - none[j])
                np.add.at(total, low[i] * block + high[j], lost)
            i = np.flatnonzero(total)
            one, two, value = i // block + a * block, i % block + b * block, total[i]
            columns = [np.concatenate(c) for c in ((one, two), (two, one), (value, value))]
            return pa.table([pa.array([of] * len(columns[0]), pa.string()), *map(pa.array, columns)], ["lang", "at", "to", "value"])

        return rows.groupBy("lang", "a", "b", "deal").applyInArrow(add, "lang string, at long, to long, value long")


def source_divergence(docs: DataFrame, most: int = MOST_TERMS, **options) -> DataFrame:
    """lang, source, part, item, value, rank: parts `pair` and `term` of SourceDivergence."""
    audit = SourceDivergence(docs, **options)
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return columns(audit.pairs(), "pair").unionByName(columns(audit.terms(most), "term"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_P = "CAST(1 + (1000000000::HUGEINT * ({c} + 5)) // ({n} + 5 * v) AS BIGINT)"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
tok AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM tok GROUP BY ALL),
k AS (SELECT lang, term FROM tok GROUP BY ALL HAVING count(DISTINCT row) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
full_c AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
gp AS (SELECT lang, source, term, n, {_P.format(c="n", n="sum(n) OVER (PARTITION BY lang, source)")} AS p FROM full_c JOIN v USING (lang)),
lc AS (SELECT lang, term, sum(n) AS n FROM full_c GROUP BY ALL),
lq AS (SELECT lang, term, {_P.format(c="n", n="sum(n) OVER (PARTITION BY lang)")} AS q FROM lc JOIN v USING (lang)),
pv AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce((SELECT sum(abs(x.p - y.p)) FROM gp x JOIN gp y ON x.lang = y.lang AND x.term = y.term WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS BIGINT) AS value
       FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
tv AS (SELECT lang, source, term AS item, p - q AS value FROM gp JOIN lq USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pv
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM tv) WHERE rank <= 50
"""
