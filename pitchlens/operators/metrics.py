"""Accuracy and revenue metrics (A6-A9), each a single distributed aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.masks import confident


def _acc(pred: Column, truth: Column) -> Column:
    return F.avg((pred == truth).cast("double"))


def accuracy(df: DataFrame, p_col: str, pred_col: str, truth_col: str,
             threshold: float) -> Column:
    """A6 as an aggregate Column: accuracy over rows with ``p > t or p < 1 - t``."""
    keep = confident(F.col(p_col), threshold)
    return F.avg(F.when(keep, (F.col(pred_col) == F.col(truth_col)).cast("double")))


def accuracy_uo(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    return df.agg(accuracy(df, "probability_final_over", "prediction_final_encoded", "final_uo",
                           threshold).alias("accuracy"),
                  F.count_if(confident("probability_final_over", threshold)).alias("n_rows"))


def accuracy_ef(df: DataFrame, threshold: float = 0.33) -> DataFrame:
    """EF default 0.33 keeps every row (decision D13)."""
    return df.agg(accuracy(df, "probability_final", "prediction_final_encoded", "final_ef",
                           threshold).alias("accuracy"),
                  F.count_if(confident("probability_final", threshold)).alias("n_rows"))


def revenue_expr(thresh: float = 0.75) -> Column:
    """A7 per row: right pays ``live_odd - 1`` when that odd > 1, wrong costs 1."""
    pu = F.col("probability_final_under")
    bet = (pu >= thresh) | (pu <= 1 - thresh)
    right = F.col("final_uo") == F.col("prediction_final_encoded")
    odd = F.when(F.col("prediction_final") == "under", F.col("live_odd_under")).otherwise(
        F.col("live_odd_over"))
    win = F.when(odd > 1, odd - 1).otherwise(F.lit(0.0))
    return F.when(bet, F.when(right, win).otherwise(F.lit(-1.0))).otherwise(F.lit(0.0))


def revenue_uo(df: DataFrame, thresh: float = 0.75) -> DataFrame:
    return df.agg(F.coalesce(F.sum(revenue_expr(thresh)), F.lit(0.0)).alias("revenue"))


def insights_uo(df: DataFrame, rev_thresh: float = 0.75) -> DataFrame:
    """Plain accuracy and revenue in one pass."""
    return df.agg(_acc(F.col("prediction_final_encoded"), F.col("final_uo")).alias("accuracy"),
                  F.coalesce(F.sum(revenue_expr(rev_thresh)), F.lit(0.0)).alias("revenue"))


def insights_ef(df: DataFrame) -> DataFrame:
    return df.agg(_acc(F.col("prediction_final_encoded"), F.col("final_ef")).alias("accuracy"))


def fold_metrics(df: DataFrame, fold_col: str, p_col: str, truth_col: str,
                 threshold: float) -> DataFrame:
    """Per-fold thresholded and 0.5 accuracy."""
    return df.groupBy(fold_col).agg(
        accuracy(df, p_col, "prediction_final_encoded", truth_col, threshold).alias("accuracy_thresh"),
        accuracy(df, p_col, "prediction_final_encoded", truth_col, 0.5).alias("accuracy_05"))


def cv_mean(per_fold: DataFrame, n_folds: int) -> DataFrame:
    """Sum of fold metrics / number of folds (a missing fold counts 0)."""
    return per_fold.agg(
        (F.coalesce(F.sum("accuracy_thresh"), F.lit(0.0)) / F.lit(float(n_folds))).alias("accuracy_thresh"),
        (F.coalesce(F.sum("accuracy_05"), F.lit(0.0)) / F.lit(float(n_folds))).alias("accuracy_05"))
