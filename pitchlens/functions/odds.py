"""Bookmaker odds as Columns: sentinels and margin-free probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import SENTINEL_1X2, SENTINEL_UO

SENTINELS = {"odd_over": SENTINEL_UO, "odd_under": SENTINEL_UO,
             "odd_1": SENTINEL_1X2, "odd_X": SENTINEL_1X2, "odd_2": SENTINEL_1X2}


def sentinel(c: Column | str, value: float) -> Column:
    """A missing odd is stored as 0; replace it by ``value``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c == 0, F.lit(value)).otherwise(c)


def replace_sentinels(df: DataFrame, sentinels: dict | None = None) -> DataFrame:
    """0 -> 2 for over/under odds, 0 -> 3 for 1X2 odds (present columns only)."""
    sentinels = SENTINELS if sentinels is None else sentinels
    todo = {c: sentinel(c, v).cast("double") for c, v in sentinels.items() if c in df.columns}
    return df.withColumns(todo) if todo else df


def implied_probs(odds: list[Column]) -> list[Column]:
    """Equal additive margin: ``p_i = 1/o_i + (1 - sum_j 1/o_j) / k``.

    ``try_divide`` keeps ANSI mode from raising on a 0 odd (gives null).
    """
    inv = [F.try_divide(F.lit(1.0), o) for o in odds]
    total = inv[0]
    for x in inv[1:]:
        total = total + x
    share = (F.lit(1.0) - total) / F.lit(float(len(odds)))
    return [x + share for x in inv]


def odds_to_prob(df: DataFrame, cols: list[str]) -> DataFrame:
    """P10: replace the odds columns ``cols`` by their probabilities, in place."""
    probs = implied_probs([F.col(c) for c in cols])
    return df.withColumns(dict(zip(cols, probs)))


def odds_to_prob_uo(df: DataFrame) -> DataFrame:
    return odds_to_prob(df, ["odd_over", "odd_under"])


def odds_to_prob_1x2(df: DataFrame) -> DataFrame:
    """1X2 variant; reciprocals are summed in the order 1, 2, X."""
    inv = {c: F.try_divide(F.lit(1.0), F.col(c)) for c in ("odd_1", "odd_X", "odd_2")}
    share = (F.lit(1.0) - (inv["odd_1"] + inv["odd_2"] + inv["odd_X"])) / F.lit(3.0)
    return df.withColumns({c: inv[c] + share for c in inv})


def best_quote(arr: Column, field: str, default: float) -> Column:
    """First element of a quote array; missing, null or 0 falls back to ``default``."""
    v = F.try_element_at(arr, F.lit(1)).getField(field)
    return F.coalesce(F.nullif(v, F.lit(0.0)), F.lit(default))
