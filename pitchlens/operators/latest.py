"""Latest state per key (W1-W3): first non-missing value per column, newest first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order_col: str = "minute",
                   cols: list[str] | None = None, tie_break: list[str] | None = None) -> DataFrame:
    """Per key, each column's value at the largest ``order_col`` where it is not null.

    ``max_by`` with a null ordering for missing values, so each column skips
    its own gaps; ``tie_break`` columns extend the ordering (as a struct)
    where several rows of a key share the newest ``order_col``.  A plain
    aggregate: partial aggregation runs map-side, so a hot key is collapsed
    before the shuffle.
    """
    tie_break = tie_break or []
    cols = [c for c in (cols or df.columns) if c not in keys]
    order = F.struct(order_col, *tie_break) if tie_break else F.col(order_col)
    aggs = []
    for c in cols:
        if c == order_col:
            aggs.append(F.max(order_col).alias(c))
        else:
            aggs.append(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c))
    return df.groupBy(*keys).agg(*aggs)


def latest_per_match(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """W1."""
    return latest_per_key(df, ["id_partita"], "minute", cols)


def dashboard(predictions: DataFrame) -> DataFrame:
    """Newest row per (bet_type, home), highest final probability first, no bet_type.

    Rows of one home team at the same minute are ordered by match id.
    """
    latest = latest_per_key(predictions, ["bet_type", "home"], "minute",
                            [c for c in predictions.columns if c != "id_partita"],
                            tie_break=["id_partita"])
    return latest.orderBy(F.col("probability_final").desc()).drop("bet_type")
