"""Bet decision as table operators.

A prediction row is matched to an exchange event, its market and runner,
and the best quote; the side, risk tier, rule check and stake are columns.
No row is dropped: a rejected bet carries its reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.odds import best_quote
from .joins import lookup_join
from ..schema import (DEFAULT_BACK_PRICE, DEFAULT_LAY_PRICE, DEFAULT_SIZE, MARKET_1X2,
                      MARKET_UO, RUNNER_NAMES)

SEP = " v "


# ------------------------------------------------------------ listings
def event_table(listing: DataFrame, name_col: str = "name", id_col: str = "event_id") -> DataFrame:
    """Lowercase event name; home / away split at ``' v '`` and trimmed."""
    n = F.col(name_col)
    return listing.select(
        F.lower(n).alias("event_name"),
        F.trim(F.split_part(n, F.lit(SEP), F.lit(1))).alias("home"),
        F.trim(F.split_part(n, F.lit(SEP), F.lit(2))).alias("away"),
        F.col(id_col).alias("event_id"))


def selection_table(catalogue: DataFrame, market_name: str) -> DataFrame:
    """Runners of the event's first market with this name, tagged with it.

    ``catalogue``: (event_id, market_id, market_name, runners array<struct<
    selection_id, runner_name>>); the first market = smallest market id.
    """
    m = catalogue.where(F.col("market_name") == market_name)
    first = m.groupBy("event_id").agg(F.min("market_id").alias("market_id"))
    chosen = m.join(first, ["event_id", "market_id"], "left_semi")
    return chosen.select("event_id", "market_id", "market_name",
                         F.explode("runners").alias("r")).select(
        "event_id", F.col("r.selection_id").alias("selection_id"),
        F.col("r.runner_name").alias("runner_name"), "market_name", "market_id")


def best_quotes(books: DataFrame) -> DataFrame:
    """One row per runner with best back / lay price and size.

    ``books``: (selection_id, back array<struct<price,size>>, lay array<...>),
    ladders ordered best first.  An empty side or a 0 falls back to the
    exchange defaults.
    """
    return books.select(
        "selection_id",
        best_quote(F.col("back"), "price", DEFAULT_BACK_PRICE).alias("back_price"),
        best_quote(F.col("back"), "size", DEFAULT_SIZE).alias("back_size"),
        best_quote(F.col("lay"), "price", DEFAULT_LAY_PRICE).alias("lay_price"),
        best_quote(F.col("lay"), "size", DEFAULT_SIZE).alias("lay_size"))


# ------------------------------------------------------------ matching
def first_event_by_name(events: DataFrame, names: DataFrame) -> DataFrame:
    """For every name in ``names`` that occurs inside some event name, the first such event.

    ``contains`` turned into an equi-join key: each event name is cut into
    its substrings of the lengths the wanted names have (a set bounded by the
    longest name, read once), those equal to a wanted name are kept (a
    semi-join AQE broadcasts when the name set is small) and ``min(event_id)``
    is taken per name with partial aggregation.  Work is linear in the events,
    never events x predictions.
    """
    wanted = names.select(F.col("name").alias("part")).where(F.col("part").isNotNull()).distinct()
    lengths = wanted.agg(F.collect_set(F.length("part"))).scalar()   # a few numbers, read when the plan runs
    # the first event of each name, before any name is cut: names repeat far more than they differ
    own = events.groupBy("event_name").agg(F.min("event_id").alias("event_id"))
    n = F.length("event_name")
    starts = own.select("event_id", "event_name", F.explode(F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).alias("start"))
    cuts = starts.select("event_id", "event_name", "start", F.explode(lengths).alias("len"))
    cuts = cuts.where(F.col("start") + F.col("len") - 1 <= n)
    parts = cuts.groupBy(F.expr("substring(event_name, start, len)").alias("part")).agg(F.min("event_id").alias("event_id"))
    hits = parts.join(wanted, "part", "left_semi")
    return hits.groupBy("part").agg(F.min("event_id").alias("first_event_id"))


def match_event(preds: DataFrame, events: DataFrame) -> DataFrame:
    """Event whose name contains the home team, else the away team, else none.

    ``events`` as from :func:`event_table`; table order = ``event_id`` order.
    """
    names = preds.select(F.explode(F.array(F.lower("home"), F.lower("away"))).alias("name"))
    idx = first_event_by_name(events, names)
    h = idx.select(F.col("part").alias("__h"), F.col("first_event_id").alias("__eh"))
    a = idx.select(F.col("part").alias("__a"), F.col("first_event_id").alias("__ea"))
    p = preds.withColumns({"__lh": F.lower("home"), "__la": F.lower("away")})
    out = lookup_join(lookup_join(p, h, ["__lh"], ["__h"], "left"), a, ["__la"], ["__a"], "left")
    out = out.drop("__lh", "__la")
    return out.withColumn("event_id", F.coalesce("__eh", "__ea")).drop("__h", "__eh", "__a", "__ea")


# ------------------------------------------------------------ decision
def runner_to_bet(prediction: Column, market_name: Column) -> Column:
    """B1 (runner part): over/under back that runner; 1/X/2 lay the opponent
    (a '2' prediction lays the home team, anything else the away team)."""
    return (F.when(prediction == "under", F.lit(RUNNER_NAMES["under"]))
             .when(prediction == "over", F.lit(RUNNER_NAMES["over"]))
             .when(prediction == "2", F.lit("1"))
             .otherwise(F.lit("2")))


def bet_side(prediction: Column) -> Column:
    """B1: 1/X/2 predictions are laid, the others backed."""
    return F.when(prediction.isin("1", "X", "2"), F.lit("Lay")).otherwise(F.lit("Back"))


def join_selection(bets: DataFrame, selections: DataFrame) -> DataFrame:
    """Selection id of the runner to bet on (by name, within the event's market)."""
    runner = runner_to_bet(F.col("prediction"), F.col("market_name"))
    name = (F.when(runner == "1", F.col("event_home")).when(runner == "2", F.col("event_away"))
             .otherwise(runner))
    b = bets.withColumn("runner_name", name)
    s = selections.select(F.col("event_id").alias("__e"), F.col("runner_name").alias("__r"),
                          F.col("market_name").alias("__m"), "selection_id", "market_id")
    j = b.join(s, (b["event_id"] == s["__e"]) & (b["runner_name"] == s["__r"])
               & (b["market_name"] == s["__m"]), "left")
    return j.drop("__e", "__r", "__m")


def join_quote(bets: DataFrame, quotes: DataFrame) -> DataFrame:
    """Price and size on the wanted side of the chosen runner."""
    j = bets.join(quotes, "selection_id", "left")
    lay = F.col("side") == "Lay"
    return (j.withColumn("odd", F.when(lay, F.col("lay_price")).otherwise(F.col("back_price")))
             .withColumn("size_available", F.when(lay, F.col("lay_size")).otherwise(F.col("back_size")))
             .drop("back_price", "back_size", "lay_price", "lay_size"))


def risk_tier(odd: Column, level: float) -> Column:
    """B2: 'high' above the risk level, else 'low'."""
    return F.when(odd > level, F.lit("high")).otherwise(F.lit("low"))


def rule_reject(bet_type: Column, prediction: Column, home_score: Column, away_score: Column,
                minute: Column) -> Column:
    """Reason a bet is refused by the match-state rules (null = allowed)."""
    goals = home_score + away_score
    return (F.when((bet_type == "uo") & (prediction == "under") & (goals >= 1), F.lit("under_scored"))
             .when((bet_type == "uo") & (prediction == "under") & (minute < 45), F.lit("under_first_half"))
             .when((bet_type == "uo") & (prediction == "over") & (goals <= 1), F.lit("over_low_score"))
             .when((bet_type == "uo") & (prediction == "over") & (minute > 45), F.lit("over_second_half"))
             .when((bet_type == "ef") & (prediction == "X"), F.lit("draw"))
             .when((bet_type == "ef") & (prediction == "1") & (home_score <= away_score),
                   F.lit("not_leading"))
             .when((bet_type == "ef") & (prediction == "2") & (home_score >= away_score),
                   F.lit("not_leading")))


def stake(side: Column, odd: Column, size_available: Column, bet_size: Column | float):
    """(size, true_odd).  Back: min(available, bet).  Lay: min(available,
    ceil(bet / (odd - 1))); the risk odd of a lay is size / bet + 1 taken
    before the final floor."""
    bet = bet_size if isinstance(bet_size, Column) else F.lit(float(bet_size))
    lay_need = F.ceil(F.try_divide(bet, odd - F.lit(1.0))).cast("double")
    raw = F.when(side == "Back", F.least(size_available, bet)).otherwise(F.least(size_available, lay_need))
    true_odd = F.when(side == "Back", odd).otherwise(raw / bet + F.lit(1.0))
    return F.floor(raw).cast("double"), true_odd


def stake_per_slot(max_exposure: float, budget: dict) -> float:
    """The maximum exposure split over every budget slot."""
    return max_exposure / sum(budget.values())


def exposure_ok(balance_now: Column, start_balance: Column | float, max_exposure: float) -> Column:
    """Betting allowed while balance + max exposure exceeds the start balance."""
    sb = start_balance if isinstance(start_balance, Column) else F.lit(float(start_balance))
    return balance_now + F.lit(float(max_exposure)) > sb


MARKETS = {"uo": MARKET_UO, "ef": MARKET_1X2}
