"""Corpus pipeline: quality classifier, near-duplicates, repeated passages, personal data, packing.

Every stage takes the documents its predecessor kept and applies its decisions to all of them.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvane.llm import minhash, packing, phrases, pii, quality_fm
from tallyvane.llm.common import col, table
from tallyvane.storage import scratch_path

#: Stages are not SQL: a trained model, signatures and tokenizers. tests/llm/test_pipeline.py holds each against brute force.
ORACLE_SQL = None


def _sized(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text where a stage changed it."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that the classifier gives less than 0.7 go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_fm.fit(docs, labels)
    return quality_fm.scored(docs, model, score_col="_quality").filter("_quality >= 0.7").drop("_quality")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of each group of near-duplicates the document with the smallest id stays.

    Shingles of five words. A document is its id and text here, so of two texts under one id the
    one in a group with a smaller id goes alone; a row without id goes if its group has an id.
    Rows that repeat id and text are one document: here they stay or go together, and ``passages``
    folds those that stay. Texts without words are in no group.
    """
    key = F.struct(F.isnull("doc_id").alias("none"), col("doc_id").alias("id"), F.md5(F.coalesce("text", F.lit(""))).alias("text_key"))
    found = minhash.near_duplicates(docs.select(key.alias("doc_id"), "text"), width=5)
    stay = table(found.filter("kept").select("doc_id.id", "doc_id.text_key").distinct(), "stay")
    rows = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), key.alias("key"))
    same = rows["key"]["id"].eqNullSafe(stay["id"]) & (rows["key"]["text_key"] == stay["text_key"])
    return rows.join(stay, same, "left_semi").select("row.*")


def one_row_each(docs: DataFrame) -> DataFrame:
    """One row, the first, of those that repeat id and text; nulls are equal to each other alone.

    Only rows of repeated documents are numbered and written; without any, ``docs`` is returned.
    """
    keys = ["none", "id", "no_text", "text_key"]
    key = F.struct(F.isnull("doc_id").alias("none"), col("doc_id").alias("id"), F.isnull("text").alias("no_text"), F.md5(F.coalesce("text", F.lit(""))).alias("text_key"))
    rows = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), key.alias("key"))
    counts = rows.select("key.*").groupBy(keys).agg(F.count("*").alias("n"))
    again = table(counts.filter("n > 1").select(F.struct(*keys).alias("key")), "again")
    if again.isEmpty():
        return docs
    copies = table(rows.join(again, "key", "left_semi").select(F.monotonically_increasing_id().alias("at"), "key", "row"), "copies")
    first = table(copies.groupBy("key").agg(F.min("at").alias("at")).select("at"), "first")
    return rows.join(again, "key", "left_anti").select("row.*").unionByName(copies.join(first, "at", "left_semi").select("row.*"))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: words in 35-word windows that recur are cut; every document stays.

    A document is its id and text, as in ``near_duplicates``: its repeated rows become one before,
    as they would count as passages of each other and leave nothing of it.
    """
    return _sized(phrases.without_passages(one_row_each(docs)))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: each identifier is replaced by its kind."""
    return _sized(pii.masked(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("passages", passages), ("personal_data", personal_data), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
