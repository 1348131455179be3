"""Quality rules: a threshold table compiled into one Spark projection.

Everything is built-in expressions: words and lines are arrays of the row, a
repeated 3-word window is found by sorting the row's window hashes, and each
rule of the table becomes one comparison.  No shuffle, no user function.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import free_name, table

SPACE_CLASS = r"[\x20\x09-\x0D]"
SYMBOL_CLASS = r"[#*$%&|<>]"

#: Very frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in is that for it with as was on be by at this from or an are "
    "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als "
    "de la le et les des en un une du que est pour qui dans par sur au avec pas "
    "el los las y del se por con no para su al lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """`numerator` must lie in [low, high] times `denominator` (a metric's name or 1)."""

    name: str
    numerator: str
    denominator: str | None = None
    low: float | None = None
    high: float | None = None


#: Length, symbol, stop-word and line ratios.
RULES = (
    Rule("min_words", "n_words", low=50),
    Rule("max_words", "n_words", high=10_000_000),
    Rule("mean_word", "word_chars", "n_words", low=2, high=25),
    Rule("symbols", "n_symbols", "n_words", high=0.25),
    Rule("stop_words", "n_stop_words", low=2),
    Rule("stop_word_ratio", "n_stop_words", "n_words", low=0.02),
    Rule("dup_lines", "n_dup_lines", "n_lines", high=0.5),
    Rule("capitals", "n_upper", "n_letters", high=0.6),
    Rule("repeats", "n_repeat_words", "n_words", high=0.5),
)


def let(value: Column, body) -> Column:
    """Bind `value` once inside an expression: body(value) with value evaluated a single time."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(tokens: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the array, the first occurrence included."""

    def covered(starts: Column) -> Column:
        gaps = F.zip_with(starts, F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(gaps, F.lit(0), lambda total, g: total + g)

    def repeated(pairs: Column) -> Column:
        last = F.size(pairs) - 1
        same = lambda i, j: F.get(pairs, i)["h"] == F.get(pairs, j)["h"]
        kept = F.filter(pairs, lambda x, i: ((i > 0) & same(i, i - 1)) | ((i < last) & same(i, i + 1)))
        return let(F.array_sort(F.transform(kept, lambda x: x["i"])), covered)

    def windows(w: Column) -> Column:
        n = F.size(w)
        third = F.slice(w, 3, n)
        hashes = F.transform(third, lambda x, i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), x).alias("h"), i.alias("i")))
        return let(F.array_sort(hashes), repeated)

    return F.when(F.size(tokens) < 3, F.lit(0)).otherwise(let(tokens, windows)).cast("long")


def metrics(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    """The rule table's metrics as expressions over a text and the arrays of its words and of its lines with a word."""
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOL_CLASS)).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeat_words(words),
        "n_lines": F.size(lines).cast("long"),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))).cast("long"),
        "n_upper": F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long"),
        "n_letters": F.regexp_count(text, F.lit(r"\p{L}")).cast("long"),
    }


def verdict(rules=RULES) -> Column:
    """The conjunction of all rules; a ratio over zero passes."""
    ok = F.lit(True)
    for r in rules:
        value, unit = F.col(r.numerator), F.col(r.denominator) if r.denominator else F.lit(1)
        if r.low is not None:
            ok = ok & (value >= unit * F.lit(r.low))
        if r.high is not None:
            ok = ok & (value <= unit * F.lit(r.high))
    return ok


def quality_rules(docs: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """Append the metrics, `base_failed` and `kept` to every row.

    Null and empty texts have no words: all counts are 0, base_failed is true
    and kept false.  Rows are judged alone, so ties and repeated rows get equal
    values; an empty table gives an empty result.  Columns of `docs` are kept but
    for those with the name of a metric, `base_failed` or `kept`, which are
    replaced.  A text of any length is one row's arrays.  Window equality is by 64-bit hash in a row.
    """
    name, words, lines = (free_name(docs, n) for n in ("_quality_text", "_quality_words", "_quality_lines"))
    out = docs.withColumn(name, F.coalesce(F.col(text_col), F.lit("")))
    out = out.withColumns(
        {
            words: F.filter(F.split(F.col(name), SPACE_CLASS + "+"), lambda w: w != ""),
            lines: F.filter(F.split(F.col(name), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        }
    )
    out = out.withColumns(metrics(F.col(name), F.col(words), F.col(lines)))
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & verdict(rules)).drop(name, words, lines)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality_rules(docs)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words", "n_upper", "n_letters")


_STOP_SQL = "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS)) + "]"


def _verdict_sql() -> str:
    parts = []
    for r in RULES:
        unit = f"{r.denominator} * " if r.denominator else ""
        if r.low is not None:
            parts.append(f"{r.numerator} >= {unit}CAST({r.low} AS DOUBLE)")
        if r.high is not None:
            parts.append(f"{r.numerator} <= {unit}CAST({r.high} AS DOUBLE)")
    return " AND ".join(parts)


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
a AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM a)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, CAST(sum(least(3, coalesce(nxt - i, 3))) AS BIGINT) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM hit) GROUP BY doc_id),
m AS (SELECT a.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
             coalesce(cov.n, 0) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines,
             CAST(len(list_filter(w, lambda x: list_contains({_STOP_SQL}, lower(x)))) AS BIGINT) AS n_stop_words,
             CAST(len(regexp_extract_all(t, '\\p{{Lu}}')) AS BIGINT) AS n_upper, CAST(len(regexp_extract_all(t, '\\p{{L}}')) AS BIGINT) AS n_letters
      FROM a LEFT JOIN cov ON cov.doc_id = a.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_verdict_sql()} AS kept,
       n_lines, n_stop_words, n_upper, n_letters FROM b
"""
