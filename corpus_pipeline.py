"""A corpus pipeline of five of the operators: every stage works on what the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cedrela.llm import line_dedup, ngram_join, packing, pii, quality
from cedrela.llm.common import stage, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go. Without labels nothing goes."""
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go from the texts; every document stays."""
    return line_dedup.clean_documents(docs)


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest doc_id, one without any last.

    Groups are of rows, by their texts: rows that repeat a doc_id, or have none, go only as near duplicates.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc_id, text = (f"c{names.index(x)}" for x in ("doc_id", "text"))
    rows = stage(plain.withColumn("row", F.monotonically_increasing_id()))
    found = ngram_join.near_duplicates(rows.select(F.col("row").alias("doc_id"), F.col(text).alias("text"))).withColumnRenamed("doc_id", "row")
    order = F.struct(F.col(doc_id).isNull(), doc_id, "row")
    first = rows.select(doc_id, "row").join(found, "row").groupBy("component_id").agg(F.min(order).alias("first"))
    return rows.join(first.select("first.row"), "row", "left_semi").select(*plain.columns).toDF(*names)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms are replaced in the texts; every document stays, with n_chars brought up to date."""
    return pii.clean_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of at most 1024."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", duplicate_stage),
    ("personal data", pii_stage),
    ("packing", packing_stage),
]

#: No SQL can express a fitted classifier or a tokenizer; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
