"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads the driver tables through the ``SNAP`` mapping (or data
Spark derives from them), runs over the whole tables and returns its full
result.  Double columns are rounded to 6 digits at the very end so that a
value check against another engine is not decided by the last bit of a sum.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import masks
from ..functions.decide import argmax_first
from ..functions.features import (add_input_cols_ef, add_input_cols_uo, label_ef, label_uo)
from ..functions.odds import odds_to_prob_1x2, odds_to_prob_uo, replace_sentinels
from ..operators import clean, decide, encode, folds, impute, latest, metrics
from ..schema import KEY
from . import preprocess

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select([F.round(F.col(f.name), digits).alias(f.name)
                      if f.dataType.typeName() in ("double", "float") else F.col(f.name)
                      for f in df.schema.fields])


def query(name: str):
    def deco(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        REGISTRY[name] = run
        return run
    return deco


def _uo_ready(spark, sf_dir) -> DataFrame:
    """SNAP with sentinel odds replaced and over/under odds as probabilities."""
    return odds_to_prob_uo(replace_sentinels(fx.snap(spark, sf_dir)))


def _ef_ready(spark, sf_dir) -> DataFrame:
    return odds_to_prob_1x2(replace_sentinels(fx.snap(spark, sf_dir)))


# ---------------------------------------------------------------- sources
@query("scan_match_table")
def q_scan_match_table(spark, sf):
    """S3: full scan of the snapshot table."""
    return fx.snap(spark, sf)


# ------------------------------------------------- projections and casts
@query("to_numeric")
def q_to_numeric(spark, sf):
    """Every non-text column as double."""
    return clean.to_numeric(fx.raw_snapshots(spark, sf))


@query("drop_cols")
def q_drop_cols(spark, sf):
    """Id, minute, teams, scores and statistics only."""
    df = clean.drop_api_missing_cols(fx.snap(spark, sf))
    df = clean.drop_odds_cols(df)
    df = clean.drop_outcome_cols(df)
    return clean.drop_stray_cols(df).drop(*fx.MODEL_OUTPUT, "match_date")


@query("pop_prematch_odds")
def q_pop_prematch_odds(spark, sf):
    """Key + probability-valued prematch odds (UO and 1X2)."""
    uo, _ = clean.pop_prematch_odds(_uo_ready(spark, sf), "uo")
    x12, _ = clean.pop_prematch_odds(_ef_ready(spark, sf), "ef")
    return uo.join(x12, [KEY, "minute"])


@query("pop_live_odds")
def q_pop_live_odds(spark, sf):
    """P5: key + live over/under odds."""
    odds, _ = clean.pop_live_odds(fx.snap(spark, sf), "uo")
    return odds


@query("input_features_uo")
def q_input_features_uo(spark, sf):
    """P8 (UO)."""
    return add_input_cols_uo(fx.snap(spark, sf)).select(
        KEY, "minute", "actual_total_goals", "over_strongness")


@query("input_features_ef")
def q_input_features_ef(spark, sf):
    """P8 (EF)."""
    return add_input_cols_ef(fx.snap(spark, sf)).select(
        KEY, "minute", "actual_total_goals", "result_strongness")


@query("label_uo")
def q_label_uo(spark, sf):
    """P9 (UO)."""
    return fx.snap(spark, sf).select(KEY, "minute", label_uo().alias("final_uo"))


@query("label_ef")
def q_label_ef(spark, sf):
    """P9 (EF)."""
    return fx.snap(spark, sf).select(KEY, "minute", label_ef().alias("final_ef"))


@query("sentinel_odds")
def q_sentinel_odds(spark, sf):
    """P11."""
    return replace_sentinels(fx.snap(spark, sf)).select(
        KEY, "minute", "odd_over", "odd_under", "odd_1", "odd_X", "odd_2")


@query("odds_prob_uo")
def q_odds_prob_uo(spark, sf):
    """P10 (over/under)."""
    return _uo_ready(spark, sf).select(KEY, "minute", "odd_over", "odd_under")


@query("odds_prob_1x2")
def q_odds_prob_1x2(spark, sf):
    """P10 (1X2)."""
    return _ef_ready(spark, sf).select(KEY, "minute", "odd_1", "odd_X", "odd_2")


@query("one_hot")
def q_one_hot(spark, sf):
    """P13 on the two score columns."""
    df = fx.snap(spark, sf).select(KEY, "minute", "home_score", "away_score")
    return encode.one_hot(df, ["away_score", "home_score"])


# ------------------------------------------------------------- predicates
@query("live_filter")
def q_live_filter(spark, sf):
    """minute >= 30 and at most two goals."""
    return fx.snap(spark, sf).where(masks.live_filter()).select(KEY, "minute", "home", "away")


_SPARSE = [KEY, "minute", "home_possesso_palla", "away_possesso_palla", "home_tiri",
           "away_tiri", "home_contrasti", "away_contrasti"]


@query("drop_sparse_rows")
def q_drop_sparse_rows(spark, sf):
    """F2 on id, minute and the three nullable stat pairs."""
    return clean.drop_sparse_rows(fx.snap(spark, sf).select(*_SPARSE))


@query("drop_missing_key")
def q_drop_missing_key(spark, sf):
    """F3 (training key set)."""
    df = fx.snap(spark, sf).select(KEY, "minute", "home_final_score", "away_final_score", "home_tiri")
    return clean.drop_missing_key(df)


@query("drop_any_null")
def q_drop_any_null(spark, sf):
    """F14 on id, minute and the nullable stat pairs."""
    return clean.drop_any_null(fx.snap(spark, sf).select(*_SPARSE))


@query("drop_over_rows")
def q_drop_over_rows(spark, sf):
    """F4."""
    return clean.drop_over_rows(fx.snap(spark, sf).select(KEY, "minute", "home_score", "away_score"))


@query("drop_over_matches")
def q_drop_over_matches(spark, sf):
    """F5."""
    return clean.drop_over_matches(
        fx.snap(spark, sf).select(KEY, "minute", "home_score", "away_score"))


def _mask_query(mask):
    def q(spark, sf):
        return fx.snap(spark, sf).where(mask()).select(KEY, "minute", "home_score", "away_score")
    return q


for _name, _m in masks.MASKS.items():
    query(f"mask_{_name}")(_mask_query(_m))


@query("test_match_ids")
def q_test_match_ids(spark, sf):
    """F7 with the one-goal scenario and both odds present."""
    return folds.test_match_ids(fx.snap(spark, sf), masks.mask_one_goal(), True, True)


@query("drop_late_rows")
def q_drop_late_rows(spark, sf):
    """F8."""
    return fx.snap(spark, sf).where(masks.late_rows_dropped(80)).select(KEY, "minute")


@query("open_fixtures")
def q_open_fixtures(spark, sf):
    """fixtures whose final score is still unknown in the saved table."""
    from ..sources.files import saved_match_table
    return (saved_match_table(spark, sf).where(F.col("home_final_score").isNull())
            .select("fixture_id").distinct())


# ------------------------------------------------------ dedupe and profile
@query("dedupe_snapshots")
def q_dedupe(spark, sf):
    """A5 on (id, scores, minute): repeated score lines collapse to the first minute."""
    return clean.dedupe_snapshots(
        fx.snap(spark, sf).select(KEY, "home_score", "away_score", "minute"))


@query("null_profile")
def q_null_profile(spark, sf):
    """A3."""
    return clean.null_profile(fx.snap(spark, sf).select(*fx.SNAP_FEATURES, "home_score"))


# ------------------------------------------------------------------ joins
@query("join_pred_odds")
def q_join_pred_odds(spark, sf):
    """Predictions with prematch (probability) odds on (id, minute)."""
    pred = fx.snap(spark, sf).select(KEY, "minute", "probability_over")
    odds, _ = clean.pop_prematch_odds(_uo_ready(spark, sf), "uo")
    return decide.join_pred_odds(pred, odds)


def _test_uo(spark, sf):
    h, lv = _split_raw(spark, sf)
    train = preprocess.prep_train(h, "uo")
    return train, preprocess.prep_test(lv, train, "uo")


@query("join_truth")
def q_join_truth(spark, sf):
    """Labels restricted to the surviving test rows."""
    _, test = _test_uo(spark, sf)
    y = test.select(KEY, "minute", "final_uo")
    x = test.drop("final_uo")
    return y.join(x.select(KEY, "minute"), [KEY, "minute"])


@query("join_live_odds")
def q_join_live_odds(spark, sf):
    """Blended predictions with live odds."""
    pred = decide.blend_uo(_uo_ready(spark, sf)).select(
        KEY, "minute", "probability_final_over", "prediction_final_encoded")
    odds, _ = clean.pop_live_odds(fx.snap(spark, sf), "uo")
    return pred.join(odds, [KEY, "minute"])


def _fold0(spark, sf):
    f = folds.grouped_folds(fx.snap(spark, sf), masks.mask_one_goal(), 5)
    return folds.fold_ids(f, 0)


@query("split_test")
def q_split_test(spark, sf):
    """Rows of the held-out fold."""
    return folds.split_test(fx.snap(spark, sf).select(KEY, "minute"), _fold0(spark, sf))


@query("split_train")
def q_split_train(spark, sf):
    """The other rows."""
    return folds.split_train(fx.snap(spark, sf).select(KEY, "minute"), _fold0(spark, sf))


@query("encode_category")
def q_encode_category(spark, sf):
    """League encoder fitted on training matches, applied to scoring matches."""
    state = encode.smooth_mean(fx.hist(spark, sf), "campionato", encode.total_goals_target())
    df = fx.live(spark, sf).select(KEY, "minute", "campionato")
    return encode.encode_category(df, state, "campionato")


# ----------------------------------------------------------- aggregations
@query("smooth_mean_uo")
def q_smooth_mean_uo(spark, sf):
    """A1 (target: final total goals)."""
    return encode.smooth_mean(fx.snap(spark, sf), "campionato", encode.total_goals_target())


@query("smooth_mean_ef")
def q_smooth_mean_ef(spark, sf):
    """A1 (target: 1/2/3 result code)."""
    return encode.smooth_mean(fx.snap(spark, sf), "campionato", label_ef())


@query("bin_means")
def q_bin_means(spark, sf):
    """A2: donor means per 5-minute bin for every stat pair of the table."""
    return impute.bin_means(fx.snap(spark, sf))


@query("impute_train")
def q_impute_train(spark, sf):
    """J10 (training: own donors, leftovers dropped)."""
    return impute.impute(fx.snap(spark, sf).select(KEY, "minute", *fx.SNAP_FEATURES))


@query("impute_score")
def q_impute_score(spark, sf):
    """J10 (scoring rows take training donors; nothing dropped)."""
    donors = fx.hist(spark, sf).select(KEY, "minute", *fx.SNAP_FEATURES)
    target = fx.live(spark, sf).select(KEY, "minute", *fx.SNAP_FEATURES)
    return impute.impute(target, donors=donors, drop_remaining=False)


# ------------------------------------------------------------ decisions
@query("blend_uo")
def q_blend_uo(spark, sf):
    """M5."""
    return decide.blend_uo(_uo_ready(spark, sf)).select(
        KEY, "minute", "probability_final_over", "probability_final_under",
        "prediction_final_encoded", "prediction_final")


@query("blend_ef")
def q_blend_ef(spark, sf):
    """M6."""
    return decide.blend_ef(_ef_ready(spark, sf)).select(
        KEY, "minute", "probability_final_1", "probability_final_X", "probability_final_2",
        "prediction_final_encoded", "probability_final", "prediction_final")


@query("blend_result")
def q_blend_result(spark, sf):
    """M6 (result variant, prematch odds joined on (id, minute))."""
    pred = fx.snap(spark, sf).select(KEY, "minute", "probability_1", "probability_X", "probability_2")
    odds = _ef_ready(spark, sf).select(KEY, "minute", "odd_1", "odd_X", "odd_2")
    return decide.blend_result(pred, odds).select(
        KEY, "minute", "probability_final_result_1", "probability_final_result_X",
        "probability_final_result_2", "prediction_final_result")


@query("model_only_uo")
def q_model_only_uo(spark, sf):
    """M7 (UO)."""
    return decide.model_only_uo(fx.snap(spark, sf)).select(
        KEY, "minute", "probability_final_over", "probability_final_under",
        "prediction_final_encoded", "prediction_final")


@query("model_only_ef")
def q_model_only_ef(spark, sf):
    """M7 (EF)."""
    return decide.model_only_ef(fx.snap(spark, sf)).select(
        KEY, "minute", "prediction_final_encoded", "probability_final", "prediction_final")


@query("prediction_record")
def q_prediction_record(spark, sf):
    """M8 for every UO and EF row."""
    uo = decide.prediction_record_uo(decide.blend_uo(_uo_ready(spark, sf)))
    ef = decide.prediction_record_ef(decide.blend_ef(_ef_ready(spark, sf)))
    return uo.unionByName(ef)


@query("alerts")
def q_alerts(spark, sf):
    """over/under records whose blended probability passes 0.7."""
    rec = decide.prediction_record_uo(decide.blend_uo(_uo_ready(spark, sf)))
    return rec.where(masks.alert("probability"))


# ------------------------------------------------------- latest / reports
_LATEST_COLS = [KEY, "home", "away", "minute", "home_score", "away_score", "home_tiri",
                "away_contrasti", "probability_over"]


@query("latest_per_match")
def q_latest_per_match(spark, sf):
    """Newest non-missing value per column and match."""
    return latest.latest_per_match(fx.snap(spark, sf).select(*_LATEST_COLS))


def _dash_rows(spark, sf):
    uo = decide.prediction_record_uo(decide.blend_uo(_uo_ready(spark, sf)))
    ef = decide.prediction_record_ef(decide.blend_ef(_ef_ready(spark, sf)))
    return (uo.unionByName(ef).withColumnRenamed("probability", "probability_final")
              .drop("market_name"))


@query("dashboard")
def q_dashboard(spark, sf):
    """Newest prediction per (bet type, home team), most probable first."""
    return latest.dashboard(_dash_rows(spark, sf))


def _result_table(spark, sf):
    df = fx.snap(spark, sf)
    probs = [F.col("probability_1"), F.col("probability_X"), F.col("probability_2")]
    return df.withColumns({"predictions": argmax_first(probs) + 1,
                           "probability": F.greatest(*probs)})


@query("prediction_table")
def q_prediction_table(spark, sf):
    """O2: 1X2 probability table, newest minute first."""
    return (_result_table(spark, sf)
            .select(KEY, "home", "away", "minute", "home_score", "away_score", "probability_1",
                    "probability_X", "probability_2", "predictions")
            .orderBy(F.col("minute").desc()))


@query("confident_nodraws")
def q_confident_nodraws(spark, sf):
    """F11 at threshold 0.5: level score, 20 < minute < 60, no draw predicted."""
    t = _result_table(spark, sf)
    keep = ((F.col("probability") >= 0.5) & (F.col("minute") < 60) & (F.col("minute") > 20)
            & (F.col("home_score") == F.col("away_score")) & (F.col("predictions") != 2))
    return (t.where(keep).select(KEY, "home", "away", "minute", "home_score", "away_score",
                                 "probability", "predictions")
             .orderBy(F.col("probability").desc()))


@query("confident_table")
def q_confident_table(spark, sf):
    """F12 at threshold 0.5, sorted by (probability, minute) descending."""
    t = _result_table(spark, sf)
    return (t.where(F.col("probability") >= 0.5)
             .select(KEY, "home", "away", "minute", "home_score", "away_score", "probability",
                     "predictions")
             .orderBy(F.col("probability").desc(), F.col("minute").desc()))


@query("report_cols")
def q_report_cols(spark, sf):
    """Key result columns of the blended UO table."""
    df = decide.blend_uo(_uo_ready(spark, sf)).withColumn("final_uo", label_uo())
    return df.select("minute", "home_score", "away_score", "probability_final_over",
                     "prediction_final_encoded", "final_uo")


# ---------------------------------------------------------------- metrics
def _uo_scored(spark, sf):
    return decide.blend_uo(_uo_ready(spark, sf)).withColumn("final_uo", label_uo())


def _ef_scored(spark, sf):
    return decide.blend_ef(_ef_ready(spark, sf)).withColumn("final_ef", label_ef())


@query("accuracy_uo")
def q_accuracy_uo(spark, sf):
    """A6 (UO) at the search threshold 0.7."""
    return metrics.accuracy_uo(_uo_scored(spark, sf), 0.7)


@query("accuracy_ef")
def q_accuracy_ef(spark, sf):
    """A6 (EF) at its default threshold 0.33."""
    return metrics.accuracy_ef(_ef_scored(spark, sf), 0.33)


@query("revenue_uo")
def q_revenue_uo(spark, sf):
    """A7 at 0.75."""
    return metrics.revenue_uo(_uo_scored(spark, sf), 0.75)


@query("insights")
def q_insights(spark, sf):
    """A9 (UO): accuracy and revenue."""
    return metrics.insights_uo(_uo_scored(spark, sf))


@query("grouped_folds")
def q_grouped_folds(spark, sf):
    """M9: five match-grouped folds of the one-goal scenario's matches."""
    return folds.grouped_folds(fx.snap(spark, sf), masks.mask_one_goal(), 5)


@query("cv_prune")
def q_cv_prune(spark, sf):
    """fold 0's matches keep only their one-goal rows; other rows stay."""
    return folds.cv_prune_fold(fx.snap(spark, sf).select(KEY, "minute", "home_score", "away_score"),
                               _fold0(spark, sf), masks.mask_one_goal())


@query("cv_mean_metrics")
def q_cv_mean_metrics(spark, sf):
    """Per-fold thresholded and 0.5 accuracy of the blended UO decision, averaged."""
    f = folds.grouped_folds(fx.snap(spark, sf), masks.mask_one_goal(), 5)
    scored = _uo_scored(spark, sf).join(f, KEY)
    per_fold = metrics.fold_metrics(scored, "fold", "probability_final_over", "final_uo", 0.7)
    return metrics.cv_mean(per_fold, 5)


# ------------------------------------------------------------ set ops
@query("all_teams")
def q_all_teams(spark, sf):
    """Distinct union of home and away teams."""
    df = fx.snap(spark, sf)
    return df.select(F.col("home").alias("team")).union(df.select(F.col("away").alias("team"))).distinct()


@query("union_sources")
def q_union_sources(spark, sf):
    """API rows (no API-missing stats, no live odds) with the scraped table."""
    from ..sources.files import union_sources
    api = fx.live(spark, sf).drop("home_contrasti", "away_contrasti", "live_odd_over",
                                  "live_odd_under", "live_odd_1", *fx.MODEL_OUTPUT)
    scraped = fx.hist(spark, sf).drop(*fx.MODEL_OUTPUT)
    return union_sources(api, scraped)


# ------------------------------------------------------- end to end prep
def _split_raw(spark, sf):
    return fx.as_raw(fx.hist(spark, sf)), fx.as_raw(fx.live(spark, sf))


def _prep_train_q(task):
    def q(spark, sf):
        return preprocess.prep_train(fx.as_raw(fx.snap(spark, sf)), task).table
    return q


def _prep_test_q(task):
    def q(spark, sf):
        h, lv = _split_raw(spark, sf)
        return preprocess.prep_test(lv, preprocess.prep_train(h, task), task)
    return q


def _prep_live_q(task):
    def q(spark, sf):
        h, lv = _split_raw(spark, sf)
        return preprocess.prep_live(lv, preprocess.prep_train(h, task), task)
    return q


for _t in ("uo", "ef"):
    query(f"prep_train_{_t}")(_prep_train_q(_t))
    query(f"prep_test_{_t}")(_prep_test_q(_t))
    query(f"prep_live_{_t}")(_prep_live_q(_t))
