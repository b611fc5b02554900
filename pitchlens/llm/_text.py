"""Column helpers that several operators of this folder share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for a null doc_id where a key must be comparable; such rows sort below all others.
NULL_ID = -(2**63)


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other code point as it is (``lower`` folds more)."""
    slow = F.translate(c, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(slow)


def id_key(c: Column) -> Column:
    return F.coalesce(c, F.lit(NULL_ID))
