"""End-to-end preprocessing of training, test and live snapshot tables.

Each function is a lazy composition of operators; Catalyst sees the whole
plan, prunes columns and pushes filters into the scans.  Test and live rows
take their imputation donors and category encoding from the *training*
table (decision D6), and the encoder is fitted on raw league names (D1).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.features import (add_input_cols_ef, add_input_cols_uo, add_outcome_ef,
                                  add_outcome_uo)
from ..functions.odds import odds_to_prob_1x2, odds_to_prob_uo
from ..operators import clean
from ..operators.encode import encode_category, smooth_mean, total_goals_target
from ..operators.impute import impute
from ..schema import API_MISSING_COLS, CAT_COLS, KEY
from ..session import materialize


@dataclass
class Prepared:
    """A prepared training table plus the fitted encoder state."""
    table: DataFrame
    encoder: DataFrame


def _drop_nan(df: DataFrame, key_cols, over: str | None) -> DataFrame:
    """Dedupe, sparse rows, missing keys, then the over filter (rows / matches)."""
    df = clean.dedupe_snapshots(df)
    df = clean.drop_sparse_rows(df)
    df = clean.drop_missing_key(df, key_cols)
    if over == "rows":
        df = clean.drop_over_rows(df)
    elif over == "matches":
        df = clean.drop_over_matches(df)
    return df


def prep_train(raw: DataFrame, task: str = "uo", cat_cols=CAT_COLS,
               missing_cols=API_MISSING_COLS) -> Prepared:
    """P1 P2 P3 A5 F2 F3 (F4) P11 J10 F14, then A1/J5, P9, P8."""
    df = clean.to_numeric(raw, cat_cols)
    df = clean.drop_api_missing_cols(df, missing_cols)
    df = clean.drop_odds_cols(df)
    df = _drop_nan(df, ["home_final_score", "minute", "away_final_score", KEY],
                   "rows" if task == "uo" else None)
    # The cleaned, imputed table feeds the encoder fit, its global mean and
    # the final projection: write it once instead of recomputing it per use.
    df = materialize(impute(df))
    # The encoder, a row for each league, is written too: joins to it are then planned
    # from its measured size, and no table is shuffled by league to meet a few rows.
    if task == "uo":
        enc = materialize(smooth_mean(df, "campionato", total_goals_target()), "encoder")
        df = encode_category(df, enc, "campionato")
        df = add_input_cols_uo(add_outcome_uo(df))
    else:
        df = add_outcome_ef(df)
        enc = materialize(smooth_mean(df, "campionato", F.col("final_ef")), "encoder")
        df = add_input_cols_ef(encode_category(df, enc, "campionato"))
    return Prepared(df, enc)


def prep_test(test: DataFrame, train: Prepared, task: str = "uo",
              missing_cols=API_MISSING_COLS) -> DataFrame:
    """A5 F2 F3 (F5) P9 P2 P11 J10 F14 J5 P10 P8; odds and label kept beside.

    Returns features + label (``final_uo`` / ``final_ef``) + probability-valued
    prematch odds + live odds; final scores are dropped (P6).
    """
    df = clean.to_numeric(test)
    df = _drop_nan(df, [KEY, "minute", "home_final_score", "away_final_score"],
                   "matches" if task == "uo" else None)
    df = add_outcome_uo(df) if task == "uo" else add_outcome_ef(df)
    df = clean.drop_api_missing_cols(df, missing_cols)
    df = impute(df, donors=train.table)
    df = encode_category(df, train.encoder, "campionato")
    if task == "uo":
        df = add_input_cols_uo(odds_to_prob_uo(df))
        keep_odds = ["odd_under", "odd_over"]
    else:
        df = add_input_cols_ef(odds_to_prob_1x2(df))
        keep_odds = ["odd_1", "odd_X", "odd_2"]
    drop = [c for c in ("odd_1", "odd_X", "odd_2", "odd_over", "odd_under",
                        "live_odd_1", "live_odd_X", "live_odd_2") if c not in keep_odds]
    return clean.drop_outcome_cols(df.drop(*drop))


def prep_live(live: DataFrame, train: Prepared, task: str = "uo", cat_cols=CAT_COLS) -> DataFrame:
    """P1 P11 J10 P10 P4 J5 P8; no null drop, no over filter."""
    df = clean.to_numeric(live, cat_cols)
    df = impute(df, donors=train.table, drop_remaining=False)
    if task == "uo":
        df = odds_to_prob_uo(df)
        keep_odds = ["odd_under", "odd_over"]
    else:
        df = odds_to_prob_1x2(df)
        keep_odds = ["odd_1", "odd_X", "odd_2"]
    df = df.drop(*[c for c in ("odd_1", "odd_X", "odd_2", "odd_over", "odd_under") if c not in keep_odds])
    df = encode_category(df, train.encoder, "campionato")
    df = add_input_cols_uo(df) if task == "uo" else add_input_cols_ef(df)
    return clean.drop_outcome_cols(df)


def feature_cols(df: DataFrame, task: str = "uo") -> list[str]:
    """Training columns minus id, label, outcome and odds columns, in order."""
    skip = {"home", "away", "date", "match_date", KEY, "fixture_id", "home_final_score",
            "away_final_score", "final_uo", "final_ef", "result", "odd_1", "odd_X", "odd_2", "odd_over",
            "odd_under", "live_odd_1", "live_odd_X", "live_odd_2", "live_odd_over",
            "live_odd_under", "probability_over", "probability_1", "probability_X",
            "probability_2"}
    text = {f.name for f in df.schema if f.dataType.simpleString() == "string"}   # an unencoded league
    return [c for c in df.columns if c not in skip | text]


def prep_train_result(raw: DataFrame, cat_cols=CAT_COLS) -> DataFrame:
    """M14 (result variant): odds dropped, P1, dedupe, sparse rows, missing
    finals / id, bin imputation, ``result`` label (1/2/3), goal difference x
    minute; no category encoding."""
    df = clean.drop_odds_cols(raw)
    df = clean.to_numeric(df, cat_cols)
    df = _drop_nan(df, ["home_final_score", "away_final_score", KEY], None)
    df = impute(df)
    df = add_outcome_ef(df, "result")
    return add_input_cols_ef(df, with_goals=False)


def prep_live_result(live: DataFrame, train: DataFrame) -> DataFrame:
    """M16 (result variant): finals dropped if present, dedupe, sparse rows,
    missing id, imputation from the training table, goal difference x minute."""
    df = clean.drop_outcome_cols(live)
    df = _drop_nan(df, [KEY], None)
    df = impute(df, donors=train)
    return add_input_cols_ef(df, with_goals=False)
