"""Decisions from model and market probabilities (M5-M8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.decide import argmax_first, blend, decode_1x2, decode_uo
from ..schema import MARKET_UO


def join_pred_odds(pred: DataFrame, odds: DataFrame) -> DataFrame:
    """Inner equi-join on (id_partita, minute); duplicate keys multiply."""
    return pred.join(odds, on=["id_partita", "minute"], how="inner")


def blend_uo(df: DataFrame, odds: DataFrame | None = None) -> DataFrame:
    """M5: blended over/under probabilities, argmax with under first.

    ``df`` carries ``probability_over`` and (unless ``odds`` is given) the
    probability-valued ``odd_over``/``odd_under`` beside it (decision D8).
    """
    if odds is not None:
        df = join_pred_odds(df, odds)
    p = F.col("probability_over")
    fo = blend(p, F.col("odd_over"))
    fu = blend(F.lit(1.0) - p, F.col("odd_under"))
    enc = argmax_first([F.col("probability_final_under"), F.col("probability_final_over")])
    return (df.withColumns({"probability_final_over": fo, "probability_final_under": fu})
              .withColumn("prediction_final_encoded", enc)
              .withColumn("prediction_final", decode_uo(F.col("prediction_final_encoded"))))


def _finish_1x2(df: DataFrame, names: list[str], enc_name: str, with_max: bool,
                max_name: str = "probability_final", label_name: str | None = "prediction_final") -> DataFrame:
    cols = [F.col(n) for n in names]
    df = df.withColumn(enc_name, argmax_first(cols) + 1)
    if with_max:
        df = df.withColumn(max_name, F.greatest(*cols))
    if label_name:
        df = df.withColumn(label_name, decode_1x2(F.col(enc_name)))
    return df


def blend_ef(df: DataFrame, odds: DataFrame | None = None) -> DataFrame:
    """M6: blended 1/X/2, encoded 1..3, ``probability_final`` = max."""
    if odds is not None:
        df = join_pred_odds(df, odds)
    names = ["probability_final_1", "probability_final_X", "probability_final_2"]
    df = df.withColumns({
        "probability_final_1": blend(F.col("probability_1"), F.col("odd_1")),
        "probability_final_X": blend(F.col("probability_X"), F.col("odd_X")),
        "probability_final_2": blend(F.col("probability_2"), F.col("odd_2"))})
    return _finish_1x2(df, names, "prediction_final_encoded", True)


def blend_result(df: DataFrame, odds: DataFrame | None = None) -> DataFrame:
    """M6 (result variant): no max column, no text label."""
    if odds is not None:
        df = join_pred_odds(df, odds)
    names = ["probability_final_result_1", "probability_final_result_X", "probability_final_result_2"]
    df = df.withColumns({
        "probability_final_result_1": blend(F.col("probability_1"), F.col("odd_1")),
        "probability_final_result_X": blend(F.col("probability_X"), F.col("odd_X")),
        "probability_final_result_2": blend(F.col("probability_2"), F.col("odd_2"))})
    return _finish_1x2(df, names, "prediction_final_result", False, label_name=None)


def model_only_uo(df: DataFrame) -> DataFrame:
    """M7 (UO): the model probability is the final one."""
    p = F.col("probability_over")
    df = df.withColumns({"probability_final_over": p, "probability_final_under": F.lit(1.0) - p})
    enc = argmax_first([F.col("probability_final_under"), F.col("probability_final_over")])
    return (df.withColumn("prediction_final_encoded", enc)
              .withColumn("prediction_final", decode_uo(F.col("prediction_final_encoded"))))


def model_only_ef(df: DataFrame) -> DataFrame:
    """M7 (EF); sets ``probability_final`` too (decision D14)."""
    df = df.withColumns({"probability_final_1": F.col("probability_1"),
                         "probability_final_X": F.col("probability_X"),
                         "probability_final_2": F.col("probability_2")})
    return _finish_1x2(df, ["probability_final_1", "probability_final_X", "probability_final_2"],
                       "prediction_final_encoded", True)


def prediction_record_uo(df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """M8 (UO): probabilities shown as max(p, 1 - p)."""
    pf, pm = F.col("probability_final_over"), F.col("probability_over")
    return df.select(*extra,
        "id_partita", "minute", "home", "away", "home_score", "away_score",
        F.lit(MARKET_UO).alias("market_name"), F.lit("uo").alias("bet_type"),
        F.col("prediction_final").alias("prediction"),
        F.when(pf > 0.5, pf).otherwise(F.lit(1.0) - pf).alias("probability"),
        F.when(pm > 0.5, pm).otherwise(F.lit(1.0) - pm).alias("model_probability"))


def prediction_record_ef(df: DataFrame, market_name: str | None = None,
                         extra: tuple[str, ...] = ()) -> DataFrame:
    """M8 (EF): model probability = max of the three model probabilities."""
    from ..schema import MARKET_1X2
    return df.select(*extra,
        "id_partita", "minute", "home", "away", "home_score", "away_score",
        F.lit(market_name or MARKET_1X2).alias("market_name"), F.lit("ef").alias("bet_type"),
        F.col("prediction_final").alias("prediction"),
        F.col("probability_final").alias("probability"),
        F.greatest("probability_1", "probability_X", "probability_2").alias("model_probability"))
