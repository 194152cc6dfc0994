"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

A document is a row's doc_id and text: rows that repeat an id with another text are judged on their own, rows alike
in both are copies.  Rows without doc_id have no say and pass the stages up to packing, which leaves them out.  Texts
that are null or empty are rejected by the first stage.  Empty tables give empty results, with the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from jobsieve.llm import decontaminate, neardup, packing, quality, suffix_dedup
from jobsieve.llm.common import read_table, stored
from jobsieve.operators.spread import with_position

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _row_id():
    """An id of a row's document, of its doc_id and text together: rows that repeat a doc_id with another text are documents of their own."""
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")))


def _by_row(docs: DataFrame) -> DataFrame:
    """(doc_id, text, lang) with the row ids as doc_id; rows without doc_id are left out."""
    return docs.where("doc_id is not null").select(_row_id().alias("doc_id"), "text", "lang")


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose row id is not a doc_id of ``gone``; rows without doc_id stay."""
    named = docs.withColumn("_row", F.when(F.col("doc_id").isNotNull(), _row_id()))
    return named.join(gone.select(F.col("doc_id").alias("_row")).distinct(), "_row", "left_anti").select(*docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not above their language's perplexity stay."""
    rows = docs.where("doc_id is not null").select("doc_id", _row_id().alias("_row"))
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    known = rows.join(labels, "doc_id").select(F.col("_row").alias("doc_id"), "quality")
    return _without(docs, quality.classify_quality(_by_row(docs), known).where(~F.col("kept")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return neardup.one_of_each(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that documents before hold, in order of doc_id, are cut.

    Where ids repeat with other texts, documents are numbered by doc_id and text first, so that each is cut by its own.
    """
    repeated = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count_distinct(_row_id()).alias("n")).where("n > 1")
    if repeated.isEmpty():
        return suffix_dedup.shorten_repeats(docs, span=50)
    rows = docs.where("doc_id is not null").select("doc_id", _row_id().alias("_row")).distinct()
    numbers = with_position(rows, ["doc_id", "_row"], name="_number").drop("doc_id")
    named = docs.withColumn("_row", F.when(F.col("doc_id").isNotNull(), _row_id())).withColumn("_id", F.col("doc_id"))
    numbered = named.join(numbers, "_row", "left").withColumn("doc_id", F.col("_number").cast("long"))
    cut = suffix_dedup.shorten_repeats(numbered.select(*docs.columns, "_id"), span=50)
    return cut.withColumn("doc_id", F.col("_id")).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item stay."""
    return _without(docs, decontaminate.find_leaks(_by_row(docs), read_table(spark, sf_dir, "benchmark")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of what is left, with their places in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, limit=4096)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None  # tokens, n-gram smoothing and the packing search are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, from the documents table."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
