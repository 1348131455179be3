"""URL filters: a trie over reversed host labels and path segments, longest match of allow and block entries.

A rule is a host and the beginning of a path.  It fits its host and all
subdomains of it (an empty host fits all) where the path of the url starts with
the rule's.  Of the rules that fit, the one with most host labels wins, then the
one with the longest path.  Of an allow and a block entry of one host and path
the block entry wins.  Urls that no rule fits get the default.

The trie goes to all tasks only while the rules hold TRIE_BYTES of text at most,
which is counted first.  Longer tables are joined: each distinct url gives its
host suffixes and the folders of its path as keys.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import free_name, table

#: Text of the rules that one trie in every task may hold.
TRIE_BYTES = 4_000_000
#: Places over which the urls of one key are dealt where rules are joined.
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The production rules: verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
DEFAULT = "allow"


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class UrlTrie:
    """Edges (node, label) -> node: host labels from the last one, then whole path segments.

    A node of a path holds the rules that end inside its next segment, by that
    segment's beginning, longest first.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.edges: dict[tuple[int, str], int] = {}
        self.paths: dict[int, int] = {}
        self.ends: dict[int, list[tuple[str, str, str]]] = {}
        self.nodes = 1
        for verdict, host, path in rules:
            node = 0
            for label in reversed(host.split(".")) if host else ():
                node = self._child(node, label)
            if node not in self.paths:
                self.paths[node] = self._new()
            node = self.paths[node]
            *whole, begun = path.split("/")
            for segment in whole:
                node = self._child(node, segment)
            self.ends.setdefault(node, []).append((begun, host + path, verdict))
        for found in self.ends.values():
            found.sort(key=lambda e: -len(e[0]))

    def _new(self) -> int:
        self.nodes += 1
        return self.nodes - 1

    def _child(self, node: int, label: str) -> int:
        at = self.edges.get((node, label))
        if at is None:
            at = self.edges[node, label] = self._new()
        return at

    def hosts(self, host: str) -> list[int]:
        """Path roots of the host's suffixes, the longest first."""
        node, out = 0, [self.paths[0]] if 0 in self.paths else []
        end = len(host)
        while end >= 0:
            begin = host.rfind(".", 0, end) + 1
            node = self.edges.get((node, host[begin:end]))
            if node is None:
                break
            if node in self.paths:
                out.append(self.paths[node])
            end = begin - 1
        return out[::-1]

    def longest(self, roots: list[int], path: str) -> tuple[str, str] | None:
        """Rule and verdict of the longest match."""
        for node in roots:
            best, begin = None, 0
            while node is not None:
                for begun, rule, verdict in self.ends.get(node, ()):
                    if path.startswith(begun, begin):
                        best = rule, verdict
                        break
                slash = path.find("/", begin)
                if slash < 0:
                    break
                node = self.edges.get((node, path[begin:slash]))
                begin = slash + 1
            if best:
                return best
        return None


def _by_trie(spark: SparkSession, rules: list[tuple[str, str, str]]):
    sent = spark.sparkContext.broadcast(UrlTrie(rules))

    @F.arrow_udf("struct<rule: string, verdict: string>")
    def judge(host: pa.Array, path: pa.Array) -> pa.Array:
        trie = sent.value
        coded = host.dictionary_encode()
        roots = [trie.hosts(h) for h in coded.dictionary.to_pylist()]
        found = [trie.longest(roots[h], p) if roots[h] else None for h, p in zip(coded.indices.to_pylist(), path.to_pylist())]
        columns = [pa.array([f and f[k] for f in found], pa.string()) for k in range(2)]
        return pa.StructArray.from_arrays(columns, ["rule", "verdict"])

    return judge


def _by_join(urls: DataFrame, rules: DataFrame, most: int) -> DataFrame:
    """host, path, found of distinct urls that a rule fits; `most`: characters of the longest rule path."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, -k, k), "."))
    near = F.substring("path", 1, most)
    folders = F.transform(F.filter(F.sequence(F.lit(0), F.length(near)), lambda k: (k == 0) | (F.substring(near, k, F.lit(1)) == "/")), lambda k: F.substring(near, F.lit(1), k))
    keys = urls.select("host", "path", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).alias("salt"), F.explode(F.array_distinct(F.concat(suffixes, F.array(F.lit(""))))).alias("of_host"))
    keys = keys.withColumn("of_path", F.explode(folders))
    last = F.length("rule_path") - F.instr(F.reverse(F.col("rule_path")), "/") + 1
    folder = F.when(F.instr("rule_path", "/") == 0, F.lit("")).otherwise(F.substring(F.col("rule_path"), F.lit(1), last))
    dealt = rules.select(
        F.col("rule_host").alias("of_host"), folder.alias("of_path"), "rule_path", "verdict", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    )
    order = F.struct(F.when(F.col("of_host") == "", 0).otherwise(F.size(F.split("of_host", r"\."))), F.length("rule_path"))
    fits = keys.join(dealt, ["of_host", "of_path", "salt"]).where(F.startswith(F.col("path"), F.col("rule_path")))
    found = F.max_by(F.struct(F.concat("of_host", "rule_path").alias("rule"), "verdict"), order)
    return fits.groupBy("host", "path").agg(found.alias("found"))


def url_filters(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = DEFAULT, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """Append host, path, rule and verdict to every row; rules: verdict (allow or block), host, path.

    Null urls and urls without `://` have an empty host and path.  Rows are judged
    alone: repeated rows get equal values, an empty table gives an empty result, a
    url of any length is one value.  Columns of `pages` are kept but for those
    named host, path, rule or verdict, which are replaced.  Null hosts and paths
    of rules are empty, hosts of rules are lower-cased, rules without a verdict go.
    """
    spark = pages.sparkSession
    rules = rules.where("verdict is not null").select("verdict", F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"))
    rules = rules.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict"))  # block after allow
    size, most = rules.agg(F.sum(F.octet_length("rule_host") + F.octet_length("rule_path")), F.max(F.length("rule_path"))).first()
    found = free_name(pages, "_found")
    host, path = free_name(pages, "_host"), free_name(pages, "_path")
    out = pages.withColumns({host: url_host(F.col(url_col)), path: url_path(F.col(url_col))})
    if (size or 0) <= trie_bytes:
        judge = _by_trie(spark, [(r["verdict"], r["rule_host"], r["rule_path"]) for r in rules.collect()])
        out = out.withColumn(found, judge(F.col(host), F.col(path)))
    else:
        urls = out.select(F.col(host).alias("host"), F.col(path).alias("path")).distinct()
        hits = _by_join(urls, rules, most or 0).toDF("_to_host", "_to_path", "_hit")
        out = out.join(hits, (out[host] == hits["_to_host"]) & (out[path] == hits["_to_path"]), "left")
        out = out.withColumn(found, F.col("_hit")).drop(hits["_to_host"], hits["_to_path"], hits["_hit"])
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    return out.select(*kept, F.col(host).alias("host"), F.col(path).alias("path"), F.col(found)["rule"].alias("rule"), F.coalesce(F.col(found)["verdict"], F.lit(default)).alias("verdict"))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return url_filters(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


SQL = f"""
WITH r(verdict, rh, rp) AS (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)}),
u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
             regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, host, path,
       (SELECT rh || rp FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
        ORDER BY len(string_split(rh, '.')) DESC, length(rp) DESC LIMIT 1) AS rule,
       coalesce((SELECT verdict FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
                 ORDER BY len(string_split(rh, '.')) DESC, length(rp) DESC LIMIT 1), '{DEFAULT}') AS verdict
FROM u
"""
