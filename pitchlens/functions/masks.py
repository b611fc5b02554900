"""Boolean Column predicates: scenario masks, live filter, confidence filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ALERT_THRESHOLD, LIVE_MINUTE_THRESHOLD


def goals() -> Column:
    return F.col("home_score") + F.col("away_score")


def mask_one_goal() -> Column:
    """30 < minute < 70 and exactly one goal so far."""
    return (F.col("minute") < 70) & (F.col("minute") > 30) & (goals() == 1)


def mask_draw_now() -> Column:
    """30 < minute < 70, level score now, final result not a draw."""
    return ((F.col("minute") < 70) & (F.col("minute") > 30)
            & (F.col("home_score") == F.col("away_score"))
            & (F.col("home_final_score") != F.col("away_final_score")))


def mask_mid_game() -> Column:
    """30 < minute < 60."""
    return (F.col("minute") < 60) & (F.col("minute") > 30)


def mask_all() -> Column:
    """Every row with a known home score."""
    return F.col("home_score") >= 0


MASKS = {"one_goal": mask_one_goal, "draw_now": mask_draw_now,
         "mid_game": mask_mid_game, "all": mask_all}


def live_filter(minute_threshold: int = LIVE_MINUTE_THRESHOLD) -> Column:
    """minute at or past the threshold and at most two goals."""
    return (F.col("minute") >= minute_threshold) & (goals() <= 2)


def late_rows_dropped(minute: int = 80) -> Column:
    """F8: keep rows up to ``minute``."""
    return F.col("minute") <= minute


def confident(p: Column | str, threshold: float = ALERT_THRESHOLD) -> Column:
    """two-sided confidence ``p > t or p < 1 - t``."""
    p = F.col(p) if isinstance(p, str) else p
    return (p > threshold) | (p < 1 - threshold)


def alert(p: Column | str, threshold: float = ALERT_THRESHOLD) -> Column:
    """probability strictly above the threshold."""
    p = F.col(p) if isinstance(p, str) else p
    return p > threshold


def odds_available(prematch: bool = True, live: bool = True) -> Column:
    """the 1 odd is known before (prematch) and/or during (live) the match."""
    m = F.lit(True)
    if prematch:
        m = m & (F.col("odd_1") != 0)
    if live:
        m = m & (F.col("live_odd_1") != 0)
    return m


def null_false(c: Column) -> Column:
    """Null compares false, as in pandas boolean masks."""
    return F.coalesce(c, F.lit(False))
