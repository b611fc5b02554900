"""Newest values of each match across polls, as keyed state of a stream (W1 on the live loop).

The batch operator's aggregate runs as a streaming one: per match the state
holds, for every column, the newest value that was not missing, so a statistic
that a poll leaves out keeps the value of the poll before.  State lies beside
the checkpoint and survives a restart.  A match is kept until matches ``keep``
later were seen: its day belongs to the key, so the watermark forgets it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.latest import latest_per_key
from ..schema import KEY

DAY = "match_day"


def newest_values(snaps: DataFrame, date: str = "date", keep: str = "2 days") -> DataFrame:
    """A row for each match that a micro-batch has news of: its newest non-missing values over all polls so far.

    ``snaps``: a stream of snapshot rows; ``date`` starts with the day of the match.
    Written in update mode.  Rows of a match more than ``keep`` older than the
    newest match of the polls before come too late and are left out.
    """
    cols = [c for c in snaps.columns if c not in (KEY, date)]
    day = snaps.withColumn(DAY, F.to_timestamp(F.substring(date, 1, 10), "yyyy-MM-dd")).drop(date).withWatermark(DAY, keep)
    return latest_per_key(day, [KEY, DAY], "minute", cols)
