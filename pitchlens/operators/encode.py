"""Target encoding (A1, J5), one-hot (P13) and first-stored-prior lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import SMOOTHING_M
from .joins import lookup_join


def smooth_mean(train: DataFrame, by: str, target: Column, m: float = SMOOTHING_M) -> DataFrame:
    """A1: per category ``(n*mean + m*global) / (n + m)``; null categories excluded.

    Returns (``by``, ``n``, ``mean``, ``smooth``, ``global_mean``).  The global
    mean is a scalar subquery (two-phase aggregate), not a join.
    """
    t = train.select(F.col(by).alias(by), target.cast("double").alias("__y"))
    glob = t.agg(F.avg("__y")).scalar()
    g = (t.where(F.col(by).isNotNull())
          .groupBy(by).agg(F.count("__y").alias("n"), F.avg("__y").alias("mean")))
    return g.select(by, "n", "mean",
                    ((F.col("n") * F.col("mean") + F.lit(float(m)) * glob)
                     / (F.col("n") + F.lit(float(m)))).alias("smooth"),
                    glob.alias("global_mean"))


def total_goals_target() -> Column:
    return F.col("home_final_score") + F.col("away_final_score")


def encode_category(df: DataFrame, state: DataFrame, by: str, out: str | None = None) -> DataFrame:
    """Replace ``by`` by its smoothed mean; unseen or null -> training mean.

    The state has one row per training category; the join is planned by its
    size, and a category holding a third of the rows is split.
    """
    out = out or by
    s = state.select(F.col(by).alias("__k"), "smooth")
    glob = state.agg(F.max("global_mean")).scalar()
    j = lookup_join(df, s, [by], ["__k"], "left")
    val = F.coalesce(F.col("smooth"), glob).cast("double")
    cols = [val.alias(out) if c == out else F.col(c) for c in df.columns]
    if out not in df.columns:
        cols.append(val.alias(out))
    return j.select(*cols)


def fit_and_encode(train: DataFrame, target_df: DataFrame, by: str, target: Column,
                   m: float = SMOOTHING_M) -> DataFrame:
    """Encoder fitted on raw training labels, applied to ``target_df``."""
    return encode_category(target_df, smooth_mean(train, by, target, m), by)


def one_hot(df: DataFrame, features: list[str], categories: dict[str, list] | None = None) -> DataFrame:
    """``<feature>_<value>`` 0/1 columns, smallest category dropped, originals kept.

    The category list defines the output schema.  ``categories`` gives it by
    feature; a feature without one has its distinct values read, one for each
    column of the result.
    """
    extra = []
    for f in features:
        vals = (categories or {}).get(f)
        if vals is None:
            vals = [r[0] for r in df.select(f).where(F.col(f).isNotNull()).distinct().collect()]
        for v in sorted(vals)[1:]:
            extra.append(F.when(F.col(f) == F.lit(v), 1).otherwise(0).alias(f"{f}_{v}"))
    return df.select("*", *extra)


def first_prior(train: DataFrame, key: str, value: str, order_cols: list[str]) -> DataFrame:
    """First stored ``value`` per ``key`` in an explicit order (min of a struct)."""
    return (train.where(F.col(key).isNotNull())
                 .groupBy(key)
                 .agg(F.min(F.struct(*order_cols, F.col(value).alias("__v")))["__v"].alias(value)))


def team_priors(train: DataFrame, test: DataFrame, order_cols: list[str],
                league_col: str = "avg_camp_goals",
                team_cols=("avg_goal_fatti", "avg_goal_subiti")) -> DataFrame:
    """Priors per league and per team taken from the first training row of the key.

    A league unseen in training takes the training mean.  A team absent from
    either the home or the away side of training takes the mean on both sides.
    Per key one aggregate (first row by ``order_cols``) and one
    lookup join; the training means are scalar subqueries.
    """
    lp = first_prior(train, "campionato", league_col, order_cols).withColumnRenamed("campionato", "__lk")
    lmean = train.agg(F.avg(league_col)).scalar()
    out = (lookup_join(test.drop(league_col), lp, ["campionato"], ["__lk"], "left").drop("__lk")
           .withColumn(league_col, F.coalesce(F.col(league_col), lmean).cast("double")))
    home_teams = train.select(F.col("home").alias("__t")).distinct()
    away_teams = train.select(F.col("away").alias("__t")).distinct()
    both = home_teams.join(away_teams, "__t", "left_semi")
    for side in ("home", "away"):
        cols = [f"{side}_{tc}" for tc in team_cols]
        first = (train.where(F.col(side).isNotNull()).groupBy(F.col(side).alias("__t"))
                      .agg(F.min(F.struct(*order_cols, *[F.col(c).alias(f"__p_{c}") for c in cols])).alias("__r"))
                      .select("__t", *[F.col(f"__r.__p_{c}").alias(f"__p_{c}") for c in cols]))
        look = first.join(both, "__t", "left_semi")   # teams seen on both sides only
        out = lookup_join(out.drop(*cols), look, [side], ["__t"], "left")
        for c in cols:
            pmean = train.agg(F.avg(c)).scalar()
            out = out.withColumn(c, F.when(F.col("__t").isNotNull(), F.col(f"__p_{c}"))
                                 .otherwise(pmean).cast("double"))
        out = out.drop("__t", *[f"__p_{c}" for c in cols])
    return out
