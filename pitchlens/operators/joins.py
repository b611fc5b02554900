"""Equi-joins of a large table to a lookup table.

A plain join: the optimizer broadcasts the lookup side where statistics or, at
run time, the finished shuffle show that it is small, and splits the partitions
of a hot key otherwise (adaptive skew join), whose rows then meet copies of the
lookup side's partition.  Nothing is counted, cached or run while planning.
:func:`salted_join` splits hot keys by construction, for sessions without
adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 32


def salted_join(big: DataFrame, small: DataFrame, big_keys: list[str], small_keys: list[str],
                how: str = "left", salts: int = SALTS) -> DataFrame:
    """``big JOIN small ON big_keys = small_keys`` with the big side salted.

    ``how``: 'inner', 'left', 'left_semi' or 'left_anti' (the large side is
    the left side).  Key columns of ``small`` keep their names, as in a
    column-expression join.  The salt comes from the row's content, so a
    recomputed task deals its rows as before.
    """
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]), F.lit(salts)).cast("int")
    b = big.withColumn("__salt", salt)
    s = small.withColumn("__salt_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    cond = b["__salt"] == s["__salt_s"]
    for bk, sk in zip(big_keys, small_keys):
        cond = cond & (b[bk] == s[sk])
    out = b.join(s, cond, how)
    if how in ("left_semi", "left_anti"):
        return out.drop("__salt")
    return out.drop("__salt", "__salt_s")


def lookup_join(big: DataFrame, small: DataFrame, big_keys: list[str], small_keys: list[str],
                how: str = "left") -> DataFrame:
    """``big JOIN small ON big_keys = small_keys``, planned by size and skew at run time."""
    cond = None
    for bk, sk in zip(big_keys, small_keys):
        c = big[bk] == small[sk]
        cond = c if cond is None else cond & c
    return big.join(small, cond, how)
