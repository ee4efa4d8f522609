"""Corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and calls one operator of ``txrisk.llm``
on everything its predecessor kept. Stages are written as Parquet and reread.
An empty table gives no rows in every stage; null and empty texts end at the
quality rules; repeated rows are one near-duplicate component; further columns
are handed on unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.llm import packing, quality_rules, queries, secret_scan, simhash_dedup
from txrisk.llm._common import materialise, table, unused
from txrisk.llm.mixing import sample


def boxed(docs: DataFrame, *needed: str) -> DataFrame:
    """All columns as one struct and those that an operator needs beside it, so
    columns named like the operator's own stay as they are."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), *needed)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base test and the learned decision list."""
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(boxed(docs, "text"), rules).where("kept").select("__doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return simhash_dedup.drop_near_duplicates(docs, shingle=4, max_distance=4)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with found secrets replaced by a mark; n_chars follows the text."""
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("long"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents that follows the target shares: rows in whole
    copies, whose number is the last column."""
    mixed = queries.mixed(boxed(docs, "doc_id", "source", "lang", "text"))
    return sample(mixed).select("__doc.*", F.col("copy").alias(unused(docs, "copy")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of 1,024."""
    return packing.pack(docs, queries.vocabulary_path(), copy_col=docs.columns[-1])


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("secret_scan", secrets),
    ("mixing", mixing),
    ("packing", pack),
]

#: The learned rules, SimHash and tokenizer stages are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
