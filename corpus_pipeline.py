"""The training-corpus pipeline over documents: five stages, each one of the corpus operators.

Every stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept, which are written as Parquet and
read again in between. All stages but the last keep the columns of documents. Null and empty texts have no letters: language ID
rejects them. Repeated rows are kept alike up to the near-dedup stage, which keeps one document of each group: of ties, the rows of the
smallest id. Texts are read whole, however long. Stages that return documents' columns keep any further ones too, with their values and
whatever their names; the last stage gives its own columns.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, language_id, line_dedup, simhash
from tessera.llm.common import kept_only, own_names, small_batches, table
from tessera.llm.queries import vocabulary


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language is found. The label that a document has stays: it isn't an input of later stages."""
    small_batches(spark)
    return language_id.filtered(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that came earlier, alike or nearly, and counts n_chars anew; documents of which only blank lines are left go."""
    rows, names = own_names(docs)
    found = line_dedup.deduplicate(rows, names["doc_id"], names["text"])
    text = F.col(names["text"])
    some = (F.trim(F.coalesce(text, F.lit(""))) != "") | (F.col("n_exact") + F.col("n_near") == 0)
    size = F.length(text).cast("bigint")
    return found.where(some).select(*[(size if c == "n_chars" else F.col(i)).alias(c) for c, i in names.items()])


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each group of near-duplicates."""
    small_batches(spark)
    return simhash.deduplicate(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    small_batches(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids_sha256 and decoded_sha256 of what is left."""
    small_batches(spark)
    rows = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), vocabulary())
    return rows.select("doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontaminate", drop_benchmark),
    ("tokenize", tokenize),
]

#: Language models, fingerprint components and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept_only(spark, partial(stage, spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
