"""Queries on descriptors: integer codes of 4 to 8 bits, half-float vectors, products with a stated query set, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import crc32c, float16, float16_bits
from ..model import table
from ..operators import tensor as T
from .formats import half_sql

QUERIES: dict = {}
SQL: dict = {}
c = F.col
V = "v AS (SELECT vec_id AS t, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"
DEPTHS = (4, 5, 6, 7, 8)
EPS = 0.000001


def add(name: str, f, sql: str | None) -> None:
    QUERIES[name] = f
    if sql is not None:
        SQL[name] = sql


def embeddings(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(c("vec_id").alias("t"), c("embedding").cast("array<double>").alias("e"))


def halved(vectors: DataFrame) -> DataFrame:
    """Vectors rounded to half floats."""
    return vectors.withColumn("e", F.transform("e", lambda x: float16(float16_bits(x))))


# -- integer codes ---------------------------------------------------------------------------------


def encoded(vectors: DataFrame, depths=DEPTHS) -> DataFrame:
    """t, depth, inv, lo, mean, norm, q: codes of `depth` bits between the least and the largest value, with what distances need.

    A value is q * inv + lo; `mean` is the values' sum less half of n * lo, `norm` their length.  A projection of the row.
    """
    out = vectors.select("t", "e", F.explode(F.array(*map(F.lit, depths))).alias("depth"))
    span = F.greatest(F.array_max("e") - F.array_min("e"), F.lit(EPS))
    out = out.withColumns({"lo": F.array_min("e"), "inv": span / (F.pow(F.lit(2.0), "depth") - 1)})
    out = out.withColumn("q", F.transform("e", lambda x: F.rint((x - c("lo")) / c("inv")).cast("long")))
    total = lambda f: F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + f(x))
    out = out.withColumns({"s": total(lambda x: x), "ss": total(lambda x: x * x), "n": F.size("q")})
    norm = F.sqrt(c("ss") * c("inv") * c("inv") + 2 * c("s") * c("inv") * c("lo") + c("n") * c("lo") * c("lo"))
    return out.select("t", "depth", "inv", "lo", (c("s") * c("inv") + 0.5 * c("n") * c("lo")).alias("mean"), norm.alias("norm"), "q")


def words(codes: DataFrame) -> DataFrame:
    """t, depth, word, bits: four codes after each other from the low bits up, as they lie in the packed bytes."""
    four = F.posexplode(F.transform(F.sequence(F.lit(1), F.size("q"), F.lit(4)), lambda i: F.slice("q", i, F.lit(4))))
    out = codes.select("t", "depth", four).select("t", "depth", c("pos").cast("long").alias("word"), "col")
    bits = sum((F.get("col", F.lit(k)) * F.pow(F.lit(2.0), k * c("depth")).cast("long") for k in range(1, 4)), F.get("col", F.lit(0)))
    return out.select("t", "depth", "word", bits.alias("bits"))


def code_distance(inv_a, lo_a, mean_a, norm_a, inv_b, lo_b, mean_b, norm_b, product) -> Column:
    """Cosine distance of two codes from the sum of their products."""
    dot = product * inv_a * inv_b + mean_a * lo_b + mean_b * lo_a
    return F.least(F.greatest(1 - dot / (norm_a * norm_b), F.lit(0.0)), F.lit(2.0))


def _codes_sql(v: str = "v") -> str:
    return f"""b AS (SELECT t, min(v) AS lo, greatest(max(v) - min(v), {EPS}::DOUBLE) AS span FROM {v} GROUP BY t),
d AS (SELECT unnest([4, 5, 6, 7, 8]) AS depth),
k AS (SELECT {v}.t, depth, i, lo, span / (pow(2.0::DOUBLE, depth) - 1) AS inv, CAST(round_even((v - lo) / (span / (pow(2.0::DOUBLE, depth) - 1)), 0) AS BIGINT) AS q FROM {v} JOIN b ON b.t = {v}.t, d),
h AS (SELECT t, depth, any_value(inv) AS inv, any_value(lo) AS lo, sum(q) * any_value(inv) + 0.5::DOUBLE * count(*) * any_value(lo) AS mean,
 sqrt(sum(q * q) * any_value(inv) * any_value(inv) + 2 * sum(q) * any_value(inv) * any_value(lo) + count(*) * any_value(lo) * any_value(lo)) AS norm FROM k GROUP BY 1, 2)"""


_HALF = f"v0 AS (SELECT vec_id AS t, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), w AS (SELECT t, i, {half_sql('v')} AS h FROM v0), v AS (SELECT t, i, CASE WHEN h >= 32768 THEN -1 ELSE 1 END * CASE WHEN h % 32768 < 1024 THEN (h % 1024) * pow(2.0::DOUBLE, -24) ELSE (1024 + h % 1024) * pow(2.0::DOUBLE, h % 32768 // 1024 - 25) END AS v FROM w)"
for _name, _source, _prepare in (("32f", V, lambda e: e), ("16f", _HALF, halved)):
    _with = f"WITH {_source}, {_codes_sql()}"
    add(f"descr_int_encode_{_name}", lambda s, d, f=_prepare: words(encoded(f(embeddings(s, d)))), f"{_with} SELECT t, depth, i // 4 AS word, CAST(sum(q << CAST(i % 4 * depth AS BIGINT)) AS BIGINT) AS bits FROM k GROUP BY 1, 2, 3")
    _back = "q * inv + lo"
    if _name == "32f":
        add("descr_int_decode_32f", lambda s, d: encoded(embeddings(s, d)).select("t", "depth", "inv", "lo", F.posexplode("q")).select("t", "depth", c("pos").cast("long").alias("i"), F.round(c("col") * c("inv") + c("lo"), 6).alias("v")), f"{_with} SELECT t, depth, i, round({_back}, 6) AS v FROM k")
    else:
        add(
            "descr_int_decode_16f",
            lambda s, d: encoded(embeddings(s, d)).select("t", "depth", "inv", "lo", F.posexplode("q")).select("t", "depth", c("pos").cast("long").alias("i"), (F.round((c("col") * c("inv") + c("lo")) * 1e5, 0) / 1e5).alias("r")).select("t", "depth", "i", float16_bits(c("r")).alias("bits")),
            f"WITH {V}, {_codes_sql()}, z AS (SELECT t, depth, i, CAST(CAST(round(({_back}) * 1e5::DOUBLE, 0) / 1e5::DOUBLE AS FLOAT) AS DOUBLE) AS r FROM k) SELECT t, depth, i, {half_sql('r')} AS bits FROM z",
        )
add("descr_int_vector_norm", lambda s, d: encoded(embeddings(s, d)).select("t", "depth", F.round("mean", 6).alias("mean"), F.round("norm", 6).alias("norm")), f"WITH {V}, {_codes_sql()} SELECT t, depth, round(mean, 6) AS mean, round(norm, 6) AS norm FROM h")


def neighbours_distance(spark, sf_dir) -> DataFrame:
    """Distances on codes of neighbouring ids."""
    a = encoded(embeddings(spark, sf_dir))
    b = a.select((c("t") - 1).alias("t"), "depth", *[c(k).alias(k + "_b") for k in ("inv", "lo", "mean", "norm", "q")])
    product = F.aggregate(F.zip_with("q", "q_b", lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)
    distance = code_distance(*map(c, ("inv", "lo", "mean", "norm", "inv_b", "lo_b", "mean_b", "norm_b")), product)
    return a.join(b, ["t", "depth"]).select("t", "depth", F.round(distance, 6).alias("d"))


_DIST = "round(least(greatest(1 - (p.s * a.inv * b.inv + a.mean * b.lo + b.mean * a.lo) / (a.norm * b.norm), 0::DOUBLE), 2::DOUBLE), 6)"
add(
    "descr_int_cosine_distance",
    neighbours_distance,
    f"WITH {V}, {_codes_sql()}, p AS (SELECT x.t, x.depth, sum(x.q * y.q) AS s FROM k x JOIN k y ON y.t = x.t + 1 AND y.depth = x.depth AND y.i = x.i GROUP BY 1, 2) SELECT p.t, p.depth, {_DIST} AS d FROM p JOIN h a ON a.t = p.t AND a.depth = p.depth JOIN h b ON b.t = p.t + 1 AND b.depth = p.depth",
)


def code_distances(spark, sf_dir) -> DataFrame:
    """Distances on 6-bit codes of the queries (ids divisible by 100) to every row: a code's value is linear, so decoded blocks multiply."""
    codes = encoded(embeddings(spark, sf_dir), (6,)).select("t", F.transform("q", lambda q: q * c("inv") + c("lo")).alias("e"))
    return T.query_distances(codes, codes.where("t % 100 = 0"), "t", "e").select("q", "r", F.round(F.least(F.greatest("d", F.lit(0.0)), F.lit(2.0)), 5).alias("d"))


_PAIRS = "SELECT a.t AS q, b.t AS r, round(least(greatest(1 - list_cosine_similarity(a.e, b.e), 0), 2), 5) AS d FROM l a, l b WHERE a.t % 100 = 0"
add("descr_int_cosine_distances_mxn", code_distances, f"WITH {V}, {_codes_sql()}, l AS (SELECT t, list(q * inv + lo ORDER BY i) AS e FROM k WHERE depth = 6 GROUP BY t) {_PAIRS}")

# -- half floats -----------------------------------------------------------------------------------

add("cosine_distances_mxn_16f", lambda s, d: (lambda e: T.query_distances(e, e.where("t % 100 = 0"), "t", "e").select("q", "r", F.round(F.least(F.greatest("d", F.lit(0.0)), F.lit(2.0)), 5).alias("d")))(halved(embeddings(s, d))), f"WITH {_HALF}, l AS (SELECT t, list(v ORDER BY i) AS e FROM v GROUP BY t) {_PAIRS}")
_dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda a, v: a + v)
add("vector_norm_16f", lambda s, d: halved(embeddings(s, d)).select("t", F.round(F.sqrt(_dot("e", "e")), 6).alias("v")), f"WITH {_HALF} SELECT t, round(sqrt(sum(v * v)), 6) AS v FROM v GROUP BY t")


def neighbours_16f(spark, sf_dir, f) -> DataFrame:
    e = halved(embeddings(spark, sf_dir))
    return e.join(e.select((c("t") - 1).alias("t"), c("e").alias("g")), "t").select("t", F.round(f(), 6).alias("v"))


add("cosine_distance_16f", lambda s, d: neighbours_16f(s, d, lambda: 1 - _dot("e", "g") / F.sqrt(_dot("e", "e") * _dot("g", "g"))), f"WITH {_HALF} SELECT a.t, round(1 - sum(a.v * b.v) / sqrt(sum(a.v * a.v) * sum(b.v * b.v)), 6) AS v FROM v a JOIN v b ON b.t = a.t + 1 AND a.i = b.i GROUP BY a.t")
add("squared_difference_sum_16f", lambda s, d: neighbours_16f(s, d, lambda: F.aggregate(F.zip_with("e", "g", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda a, v: a + v)), f"WITH {_HALF} SELECT a.t, round(sum((a.v - b.v) * (a.v - b.v)), 6) AS v FROM v a JOIN v b ON b.t = a.t + 1 AND a.i = b.i GROUP BY a.t")


def kahan(pairs) -> Column:
    """Compensated sum: (sum, what was lost) runs along the array."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("k"))

    def step(acc: Column, x: Column) -> Column:
        y = x - acc["k"]
        total = acc["s"] + y
        return F.struct(total.alias("s"), ((total - acc["s"]) - y).alias("k"))

    return F.aggregate(pairs, start, step, lambda acc: acc["s"])


def kahan_sums(spark, sf_dir) -> DataFrame:
    e = embeddings(spark, sf_dir)
    squares = F.zip_with("e", "g", lambda p, q: (p - q) * (p - q))
    return e.join(e.select((c("t") - 1).alias("t"), c("e").alias("g")), "t").select("t", F.round(kahan(squares), 6).alias("v"))


add("squared_difference_kahan_sum_32f", kahan_sums, f"WITH {V} SELECT a.t, round(kahan_sum((a.v - b.v) * (a.v - b.v)), 6) AS v FROM v a JOIN v b ON b.t = a.t + 1 AND a.i = b.i GROUP BY a.t")

# -- products with alpha and beta --------------------------------------------------------------------


def gemm(a: DataFrame, b: DataFrame, old: DataFrame, alpha: float, beta: float) -> DataFrame:
    """C = alpha A B + beta C of (i, k, av), (k, j, bv), (i, j, cv): one join on k with partial sums; C adds as one more term."""
    new = T.matmul(a, b).select("i", "j", (alpha * c("v")).alias("v"))
    return new.unionByName(old.select("i", "j", (beta * c("cv")).alias("v"))).groupBy("i", "j").agg(F.round(F.sum("v"), 4).alias("v"))


def gemm_of(spark, sf_dir, transposed: bool) -> DataFrame:
    """A: labels by dimensions (sums of a label's vectors); B: 64 by 16, stored by rows of its columns when transposed."""
    rows = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding"))
    a = rows.groupBy(c("label").cast("long").alias("i"), c("pos").cast("long").alias("k")).agg(F.sum(c("col").cast("double")).alias("av"))
    grid = spark.range(64 * 16).select((c("id") % 16).alias("p"), F.expr("id div 16").alias("q"))
    b = grid.select(c("p").alias("j"), c("q").alias("k")) if transposed else grid.select(c("q").alias("k"), c("p").alias("j"))
    b = b.withColumn("bv", ((c("k") * 7 + c("j") * 3) % 11 - 5) * F.lit(0.1))
    old = a.select("i").distinct().select("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))).alias("j")).select("i", "j", (c("i") + c("j") * F.lit(0.5)).alias("cv"))
    return gemm(a, b, old, 1.5, -0.25)


_GEMM = "WITH a AS (SELECT CAST(label AS BIGINT) AS i, generate_subscripts(embedding, 1) - 1 AS k, unnest(embedding)::DOUBLE AS v FROM embeddings), g AS (SELECT i, j, sum(a.v * ((((k * 7 + j * 3) % 11) - 5) * 0.1::DOUBLE)) AS v FROM a, (SELECT unnest(range(16)) AS j) GROUP BY 1, 2) SELECT i, j, round(1.5::DOUBLE * v - 0.25::DOUBLE * (i + j * 0.5::DOUBLE), 4) AS v FROM g"
add("gemm_32f_nn", lambda s, d: gemm_of(s, d, False), _GEMM)
add("gemm_32f_nt", lambda s, d: gemm_of(s, d, True), _GEMM)

# -- checksums -----------------------------------------------------------------------------------------


def crc_sql(polynomial: int, column: str) -> str:
    """Checksum of a text's bytes, bit-reflected, by a table of 256 rests."""
    rest = "n"
    for _ in range(8):
        rest = f"(SELECT CASE WHEN z % 2 = 1 THEN xor(z // 2, {polynomial}) ELSE z // 2 END FROM (SELECT {rest} AS z))"
    return f"""WITH r AS (SELECT list({rest} ORDER BY n) AS k FROM (SELECT unnest(range(256)) AS n)),
h AS (SELECT page_id, hex(encode({column})) AS x FROM pages),
b AS (SELECT page_id, list_transform(range(1, length(x), 2), lambda i: (strpos('0123456789ABCDEF', x[i]) - 1) * 16 + strpos('0123456789ABCDEF', x[i + 1]) - 1) AS x FROM h)
SELECT page_id, CAST(xor(list_reduce(list_prepend(4294967295, x), lambda s, v: xor(s // 256, k[xor(s % 256, v) + 1])), 4294967295) AS BIGINT) AS {{name}} FROM b, r"""


add("crc32", lambda s, d: table(s, d, "pages").select("page_id", F.crc32(F.encode("html", "UTF-8")).alias("crc32")), crc_sql(0xEDB88320, "html").replace("{name}", "crc32"))
add("crc32c", lambda s, d: table(s, d, "pages").select("page_id", crc32c(F.encode("html", "UTF-8")).alias("crc32c")), crc_sql(0x82F63B78, "html").replace("{name}", "crc32c"))
