"""Derived feature and label Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total_goals() -> Column:
    return F.col("home_score") + F.col("away_score")


def over_strongness() -> Column:
    """Goals so far weighted by the minutes left."""
    return total_goals() * (F.lit(90) - F.col("minute"))


def result_strongness() -> Column:
    """Goal difference weighted by the minutes played."""
    return (F.col("home_score") - F.col("away_score")) * F.col("minute")


def add_input_cols_uo(df: DataFrame) -> DataFrame:
    """P8 (UO)."""
    return df.withColumns({"actual_total_goals": total_goals(),
                           "over_strongness": over_strongness()})


def add_input_cols_ef(df: DataFrame, with_goals: bool = True) -> DataFrame:
    """P8 (EF; the result variant has no goal count)."""
    cols = {"actual_total_goals": total_goals()} if with_goals else {}
    cols["result_strongness"] = result_strongness()
    return df.withColumns(cols)


def label_uo() -> Column:
    """1 when the final total is over 2.5; null scores give 0."""
    return F.when(F.col("home_final_score") + F.col("away_final_score") > 2, 1).otherwise(0)


def label_ef() -> Column:
    """1 home win, 2 draw, 3 away win; null scores give 3."""
    h, a = F.col("home_final_score"), F.col("away_final_score")
    return F.when(h > a, 1).when(h == a, 2).otherwise(3)


def add_outcome_uo(df: DataFrame, name: str = "final_uo") -> DataFrame:
    return df.withColumn(name, label_uo())


def add_outcome_ef(df: DataFrame, name: str = "final_ef") -> DataFrame:
    return df.withColumn(name, label_ef())
