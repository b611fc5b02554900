"""Projections, casts, row filters and snapshot de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.masks import goals, null_false
from ..schema import API_MISSING_COLS, CAT_COLS, FINAL_COLS, KEY, LIVE_ODDS, PREMATCH_ODDS
from .joins import lookup_join


def to_numeric(df: DataFrame, cat_cols=CAT_COLS) -> DataFrame:
    """Cast every column outside ``cat_cols`` to double.

    Under ANSI mode (the default) malformed text raises, as the source does.
    """
    cats = set(cat_cols)
    return df.select([F.col(c) if c in cats else F.col(c).cast("double").alias(c)
                      for c in df.columns])


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating NaN (e.g. the text ``nan`` in CSV) becomes SQL null."""
    fl = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    return df.select([F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) if c in fl
                      else F.col(c) for c in df.columns])


def drop_api_missing_cols(df: DataFrame, missing_cols=API_MISSING_COLS) -> DataFrame:
    """Drop the API-missing columns when the first of them exists."""
    return df.drop(*missing_cols) if missing_cols and missing_cols[0] in df.columns else df


def drop_odds_cols(df: DataFrame, prematch: bool = True, live: bool = True) -> DataFrame:
    """Drop prematch and/or live odds (absent columns are ignored)."""
    cols = (PREMATCH_ODDS if prematch else []) + (LIVE_ODDS if live else [])
    return df.drop(*cols)


def drop_outcome_cols(df: DataFrame, extra=()) -> DataFrame:
    """Drop final scores and labels."""
    return df.drop(*FINAL_COLS, *extra)


def drop_stray_cols(df: DataFrame) -> DataFrame:
    """``fixture_id`` and a stray index column."""
    return df.drop("fixture_id", "Unnamed: 0", "_c0")


def pop_prematch_odds(df: DataFrame, kind: str = "uo") -> tuple[DataFrame, DataFrame]:
    """(key + prematch odds, df without prematch odds)."""
    cols = {"uo": ["odd_under", "odd_over"], "ef": ["odd_1", "odd_X", "odd_2"]}[kind]
    return df.select(KEY, "minute", *cols), df.drop(*PREMATCH_ODDS)


def pop_live_odds(df: DataFrame, kind: str = "uo") -> tuple[DataFrame, DataFrame]:
    """P5: UO and EF keep (under, over); the result variant keeps (1, X, 2)."""
    cols = {"uo": ["live_odd_under", "live_odd_over"],
            "ef": ["live_odd_under", "live_odd_over"],
            "result": ["live_odd_1", "live_odd_X", "live_odd_2"]}[kind]
    return df.select(KEY, "minute", *[c for c in cols if c in df.columns]), df.drop(*LIVE_ODDS)


def drop_sparse_rows(df: DataFrame, thresh: int | None = None) -> DataFrame:
    """keep rows with at least ``len(columns) // 2`` non-missing values."""
    return df.na.drop(thresh=len(df.columns) // 2 if thresh is None else thresh)


def drop_missing_key(df: DataFrame, subset=(KEY, "minute", *FINAL_COLS)) -> DataFrame:
    """drop rows missing any important column."""
    return df.na.drop(how="any", subset=list(subset))


def drop_any_null(df: DataFrame) -> DataFrame:
    """F14."""
    return df.na.drop(how="any")


def drop_over_rows(df: DataFrame) -> DataFrame:
    """F4 (training): drop rows already at 3+ goals; unknown goals are kept."""
    return df.where(~null_false(goals() >= 3))


def drop_over_matches(df: DataFrame) -> DataFrame:
    """F5 (test, live): drop every row of a match that has any row at 3+ goals.

    A left-anti lookup join against the (aggregated) ids of such matches.
    """
    bad = df.where(goals() >= 3).select(F.col(KEY).alias("__id")).distinct()
    return lookup_join(df, bad, [KEY], ["__id"], "left_anti")


def dedupe_snapshots(df: DataFrame, order_col: str = "minute") -> DataFrame:
    """A5: rows equal on every column except ``minute`` collapse to the earliest.

    Missing equals missing (grouping semantics).  An aggregate, so partial
    aggregation collapses repeats map-side before the shuffle.
    """
    others = [c for c in df.columns if c != order_col]
    out = df.groupBy(*others).agg(F.min(order_col).alias(order_col))
    return out.select(*df.columns)


def keep_rows(df: DataFrame, cond: Column) -> DataFrame:
    return df.where(cond)


def cv_prune(df: DataFrame, in_fold: Column, mask: Column) -> DataFrame:
    """drop rows of held-out matches that fail the scenario mask."""
    return df.where(~null_false(in_fold & ~null_false(mask)))


def null_profile(df: DataFrame, cols=None) -> DataFrame:
    """A3: number of missing values per column, one row (0 = complete)."""
    cols = cols or df.columns
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in cols])
