"""Token counts kept as additive rollups over signed deltas.

A batch of changes adds signed rows (+1 insert, -1 delete; a revised count is
the old count taken off and the new one added) to the totals by source,
language and tokenizer version.  A batch is one folder of deltas and one
commit record; the record is created without overwriting and names the folder,
so a batch that is sent again, or whose writer was lost half way, counts once.
Compaction writes the sums of all batches so far and then one base record that
names the folder and these batches: it appears whole or not at all.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import checkpointed, shared_folder, table
from ._text import slices
from .packing import WordTokenizer, tokenizer_path

KEYS = ("source", "lang", "tokenizer")
DEALS = 32
SUMS = ("n_docs", "n_tokens", "n_chars")


class RankCounter:
    """Token counts of whole texts by a byte-level tokenizer given as ranks of byte strings."""

    kept: dict[str, "RankCounter"] = {}

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        self.model = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def counts(self, texts: list[str]) -> list[int]:
        return [len(self.model.encode_ordinary(t)) for t in texts]


class WordCounter:
    """Token counts by a tokenizer that drops white space."""

    kept: dict[str, "WordCounter"] = {}

    def __init__(self, path: str):
        self.tokenizer = WordTokenizer.of(path)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(ids) // 4 for ids in self.tokenizer.ids(texts)]


KINDS = {"word": WordCounter, "ranks": RankCounter}
#: Tokenizer version -> (kind, file).
VERSIONS = {"word_bpe_49k": ("word", "word_bpe_49k.json"), "byte_bpe_50k": ("ranks", "byte_bpe_50k.tiktoken")}


def _counter(kind: str, path: str):
    cls = KINDS[kind]
    if path not in cls.kept:
        cls.kept[path] = cls(path)
    return cls.kept[path]


def document_counts(docs: DataFrame, versions=None, doc_col: str = "doc_id", text_col: str = "text", by=("source", "lang")) -> DataFrame:
    """doc, source, lang, tokenizer, n_tokens, n_chars: one row per document and tokenizer version; null texts have 0 tokens."""
    tools = {v: (k, tokenizer_path(f)) for v, (k, f) in (versions or VERSIONS).items()}

    def run(batches) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = [t or "" for t in part.column(3).to_pylist()]
            chars = pa.array([len(t) for t in texts], pa.int64())
            for version, (kind, path) in tools.items():
                n = np.array(_counter(kind, path).counts(texts), np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([version] * len(texts)), pa.array(n), chars], ["doc", "source", "lang", "tokenizer", "n_tokens", "n_chars"])

    kind = docs.schema[doc_col].dataType.simpleString()
    rows = docs.select(F.col(doc_col).alias("doc"), F.col(by[0]).cast("string").alias("source"), F.col(by[1]).cast("string").alias("lang"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc {kind}, source string, lang string, tokenizer string, n_tokens long, n_chars long")


class TokenRollup:
    """Totals of a corpus in a folder that all executors share.

    insert, delete and revise take a batch id, a file name that starts with
    neither . nor _; the first commit of an id counts, later ones change
    nothing.  Deletes take counts (rows of document_counts), so a text need not
    be tokenised again.  Null keys are a group of their own; a group whose
    documents are all gone has no row; repeated rows count each; null texts
    have no tokens.  No rows at all give no totals.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _record(self, batch: str) -> str:
        if not batch or batch[0] in "._" or "/" in batch:
            raise ValueError(f"not a batch id: {batch!r}")
        return f"{self.path}/commits/{batch}"

    def _read(self, folder: str) -> dict[str, str]:
        """File name -> content of the records of a folder."""
        top, out = self._path(f"{self.path}/{folder}"), {}
        for status in self._fs.listStatus(top) if self._fs.exists(top) else []:
            name = status.getPath().getName()
            if name[0] in "._":
                continue
            stream = self._fs.open(status.getPath())
            try:
                out[name] = bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
        return out

    def _publish(self, record: str, content: str) -> bool:
        """A record appears whole under its name, or not at all: written aside, then renamed, which fails if the name is taken."""
        aside, target = self._path(f"{record.rpartition('/')[0]}/.{uuid.uuid4().hex}"), self._path(record)
        stream = self._fs.create(aside, False)
        stream.write(bytearray(content.encode()))
        stream.close()
        if self._fs.exists(target) or not self._fs.rename(aside, target):
            self._fs.delete(aside, False)
            return False
        return True

    def committed(self) -> dict[str, str]:
        """Batch id -> folder of its deltas, whether or not a base holds them already."""
        return self._read("commits")

    def _base(self) -> tuple[int, dict]:
        """Number and content of the newest base record."""
        found = self._read("bases")
        last = max(found, default=None)
        return (int(last), json.loads(found[last])) if last else (0, {"folder": None, "batches": []})

    def commit(self, batch: str, signed: DataFrame) -> bool:
        """Add signed rows (KEYS, sign, n_tokens, n_chars) once; False if the batch is in already."""
        if self._fs.exists(self._path(self._record(batch))):
            return False
        sums = signed.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("n_docs"), *(F.sum(F.col(c) * F.col("sign")).cast("long").alias(c) for c in SUMS[1:]))
        folder = f"{self.path}/deltas/{batch}-{uuid.uuid4().hex}"
        sums.write.parquet(folder)
        if not self._publish(self._record(batch), folder):
            self._fs.delete(self._path(folder), True)
            return False
        return True

    def insert(self, batch: str, counts: DataFrame) -> bool:
        return self.commit(batch, counts.withColumn("sign", F.lit(1)))

    def delete(self, batch: str, counts: DataFrame) -> bool:
        return self.commit(batch, counts.withColumn("sign", F.lit(-1)))

    def revise(self, batch: str, old: DataFrame, new: DataFrame) -> bool:
        """Replace counts: documents moved to another source or language, edited, or counted by a corrected tokenizer."""
        return self.commit(batch, old.withColumn("sign", F.lit(-1)).unionByName(new.withColumn("sign", F.lit(1))))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens, n_chars over all committed batches."""
        base = self._base()[1]
        return self._sums(base, self.committed())

    def _sums(self, base: dict, batches: dict[str, str]) -> DataFrame:
        folders = [base["folder"]] * bool(base["folder"]) + sorted(f for b, f in batches.items() if b not in base["batches"])
        schema = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"
        rows = self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)
        return rows.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS)).where("n_docs <> 0 or n_tokens <> 0 or n_chars <> 0")

    def compact(self) -> bool:
        """Sum all batches so far into a new base; batch ids stay committed.  False if another compaction came first."""
        number, base = self._base()
        had = self.committed()
        folder = f"{self.path}/deltas/base-{uuid.uuid4().hex}"
        self._sums(base, had).write.parquet(folder)
        return self._publish(f"{self.path}/bases/{number + 1:012d}", json.dumps({"folder": folder, "batches": sorted(had)}))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of `documents` by two tokenizers after four batches.

    All documents come in; that batch is sent again and changes nothing; exact
    copies of a text, but the one of the least id, are deleted (a document is its
    id; rows without one stay); the counts of
    the word tokenizer are revised to hold one end token a document.
    """
    docs = table(spark, sf_dir, "documents")
    rollup = TokenRollup(spark, f"{shared_folder(spark)}/token-rollup-{uuid.uuid4().hex}")
    folder = f"{rollup.path}/documents"
    document_counts(docs).write.parquet(folder)
    counts = spark.read.parquet(folder)
    rollup.insert("0-insert", counts)
    rollup.insert("0-insert", counts)
    prints = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("print"))
    first = prints.groupBy("print").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # a text of very many copies is dealt over DEALS tasks
    deal = F.pmod(F.xxhash64("doc_id"), F.lit(DEALS)).cast("int")
    first = first.select("first", "print", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))).alias("deal"))
    later = prints.withColumn("deal", deal).join(first, ["print", "deal"]).where("doc_id <> first").select(F.col("doc_id").alias("doc"))
    later = checkpointed(later)
    rollup.delete("1-copies", counts.join(later, "doc", "left_semi"))
    left = counts.where(F.col("tokenizer") == "word_bpe_49k").join(later, "doc", "left_anti")
    rollup.revise("2-end-token", left, left.withColumn("n_tokens", F.col("n_tokens") + 1))
    return rollup.totals()
