"""Minute-bin imputation of missing statistics.

A missing side of a stat pair is filled (both sides, same value) with the
mean of the pair over donor rows in the same 5-minute bin.  Bins are
``[m, m+5]`` for m = 5..85, closed on both ends, and a later bin wins, so:

* a target at minute t uses bin ``floor(t/5)*5`` for 5 <= t < 90, bin 85 at
  t = 90, and is not imputed below 5 or above 90;
* a donor on an inner edge (10, 15, ..., 85, and 90) counts in two bins.

One pass: each donor row is exploded to its one or two bins and a single
``groupBy(bin)`` averages every stat at once.  The result has at most 17
rows whatever the data size, so broadcasting it is size-safe.
Possession is set to 50/50 wherever a side is missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.odds import replace_sentinels
from ..schema import (BIN_FIRST, BIN_LAST, BIN_WIDTH, POSSESSION, POSSESSION_FILL,
                      present_stats)


def _imputed_stats(df: DataFrame, stats=None) -> list[str]:
    return [s for s in (stats or present_stats(df.columns)) if s != POSSESSION]


def target_bin(minute: Column) -> Column:
    """The bin whose mean a row at ``minute`` takes (null = not imputed)."""
    lo = F.floor(minute / BIN_WIDTH) * BIN_WIDTH
    return (F.when((lo >= BIN_FIRST) & (lo <= BIN_LAST), lo)
             .when(minute == BIN_LAST + BIN_WIDTH, F.lit(BIN_LAST))
             .cast("int"))


def donor_bins(minute: Column) -> Column:
    """All bins ``m`` with ``m <= minute <= m + 5`` (one or two of them)."""
    lo = F.floor(minute / BIN_WIDTH) * BIN_WIDTH
    below = lo - BIN_WIDTH
    return F.filter(
        F.array(lo.cast("int"), F.when(minute == lo, below).cast("int")),
        lambda b: b.isNotNull() & (b >= BIN_FIRST) & (b <= BIN_LAST))


def bin_means(donors: DataFrame, stats=None) -> DataFrame:
    """A2: per bin, ``(avg(home_s) + avg(away_s)) / 2`` over rows with both sides.

    Output: ``bin`` plus ``mean_<s>`` per stat; at most 17 rows.
    """
    stats = _imputed_stats(donors, stats)
    if not stats:  # nothing to average: an empty bin table
        return donors.select(F.lit(None).cast("int").alias("bin")).where(F.lit(False))
    both = {s: F.col(f"home_{s}").isNotNull() & F.col(f"away_{s}").isNotNull() for s in stats}
    exploded = donors.select(
        F.explode(donor_bins(F.col("minute"))).alias("bin"),
        *[F.when(both[s], F.col(f"home_{s}")).alias(f"h_{s}") for s in stats],
        *[F.when(both[s], F.col(f"away_{s}")).alias(f"a_{s}") for s in stats])
    aggs = []
    for s in stats:
        aggs += [F.avg(f"h_{s}").alias(f"h_{s}"), F.avg(f"a_{s}").alias(f"a_{s}")]
    g = exploded.groupBy("bin").agg(*aggs)
    return g.select("bin", *[((F.col(f"h_{s}") + F.col(f"a_{s}")) / F.lit(2.0)).alias(f"mean_{s}")
                             for s in stats])


def apply_bin_means(target: DataFrame, means: DataFrame, stats=None) -> DataFrame:
    """Fill missing pairs from the broadcast bin table; possession to 50."""
    stats = [s for s in (stats or present_stats(target.columns))]
    imputed = [s for s in stats if s != POSSESSION]
    cols = target.columns
    t = target.withColumn("__bin", target_bin(F.col("minute")))
    m = means.select(F.col("bin").alias("__bin"), *[f"mean_{s}" for s in imputed])
    j = t.join(F.broadcast(m), on="__bin", how="left")
    out = {}
    for s in stats:
        h, a = f"home_{s}", f"away_{s}"
        missing = F.col(h).isNull() | F.col(a).isNull()
        if s == POSSESSION:
            fill = F.lit(POSSESSION_FILL)
            cond = missing
        else:
            fill = F.col(f"mean_{s}")
            cond = missing & F.col("__bin").isNotNull()
        out[h] = F.when(cond, fill).otherwise(F.col(h)).cast("double")
        out[a] = F.when(cond, fill).otherwise(F.col(a)).cast("double")
    return j.withColumns(out).select(*cols)


def impute(target: DataFrame, donors: DataFrame | None = None, stats=None,
           drop_remaining: bool = True) -> DataFrame:
    """Sentinel odds, then minute-bin imputation, then (train/test) drop leftovers.

    ``donors`` defaults to ``target`` itself (training); test and live rows
    use the already imputed training table.
    """
    target = replace_sentinels(target)
    donors = target if donors is None else donors
    stats = stats or [s for s in present_stats(target.columns) if s in present_stats(donors.columns)
                      or s == POSSESSION]
    out = apply_bin_means(target, bin_means(donors, stats), stats)
    return out.na.drop(how="any") if drop_remaining else out
