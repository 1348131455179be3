"""The corpus pipeline: five stages, each a decision of one operator of quiltra.llm.

run() writes every stage as Parquet in the shared folder and reads it again as
the next one's documents.  No stage can be said in SQL as a whole (a trained
classifier, a similarity closure, latent retrieval, a packing plan), so
ORACLE_SQL is None and tests/llm holds the stages against brute force.

Every stage but the last returns all columns of its input, whatever they are.
A row is a document, told by id and text: null and repeated ids are allowed,
and equal rows stay or go together.  Null texts are empty ones.  An empty table
gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltra.llm._spark import free_name, row_print, small_batches, table, without, written
from quiltra.llm.decontamination import Decontamination
from quiltra.llm.jaccard_join import JaccardJoin
from quiltra.llm.line_dedup import LineDedup
from quiltra.llm.packing import best_fit_packing
from quiltra.llm.quality_classifier import THRESHOLD, QualityClassifier


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from `labels`, rejects go."""
    small_batches(spark)
    model, score = QualityClassifier().fit(docs, table(spark, sf_dir, "labels")), free_name(docs, "_score")
    return model.score(docs, score).where(F.col(score) >= THRESHOLD).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go from every document; n_chars follows the text."""
    into = free_name(docs, "_kept")
    out = LineDedup(spark).insert(docs.select("text")).apply(docs.select("doc_id", "text", *[c for c in docs.columns if c not in ("doc_id", "text")]), into=into)
    changed = {"text": F.col(into), "n_chars": F.length(into).cast("long")}
    return out.select(*[changed[c].alias(c) if c in changed else c for c in docs.columns])


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 the one with the least id stays."""
    groups = JaccardJoin(docs, shingle=5, num=80, den=100).groups()
    return without(docs, row_print("doc_id", "text"), groups.where("not stays").select("print"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or a paraphrase of one, go."""
    rows = docs.select(row_print("doc_id", "text").alias("row"), "text")
    found = Decontamination(doc_col="row").fit(rows, table(spark, sf_dir, "benchmark")).matches(rows)
    return without(docs, row_print("doc_id", "text"), found.select("row"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents left, packed into sequences of 4096 tokens."""
    return best_fit_packing(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("best_fit_packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
