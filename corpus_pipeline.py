"""The corpus pipeline: each stage calls one operator of pitchlens/llm on all that its predecessor kept.

Rows with a null ``doc_id`` or text go through like any other; the classifier
rejects by score, so a text without words is kept if the bias alone says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlens.llm import op2_pack, op3_lines, op4_near, op5_quality, op9_decontaminate
from pitchlens.llm._text import read
from pitchlens.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good."""
    return op5_quality.keep_good(docs.select(COLUMNS), read(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the lines that many documents repeat; n_chars follows the text."""
    out = op3_lines.dedup_lines(docs.select(COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id."""
    return op4_near.drop_near(docs.select(COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that repeat benchmark passages."""
    return op9_decontaminate.drop_contaminated(docs.select(COLUMNS), read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes."""
    return op2_pack.pack(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``, each written as Parquet and read again; the last one's rows."""
    docs = read(spark, sf_dir, "documents").select(COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None  # the classifier and the fewest sequences have no SQL: tests/llm/test_pipeline.py holds each stage against a plain version
