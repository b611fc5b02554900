"""Blend of model and market probabilities, and row-wise argmax (Columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BLEND_BASE, BLEND_MINUTES, BLEND_SPAN

RATE = BLEND_SPAN / BLEND_MINUTES


def model_weight(minute: Column | str = "minute") -> Column:
    m = F.col(minute) if isinstance(minute, str) else minute
    return F.lit(BLEND_BASE) + F.lit(RATE) * m


def market_weight(minute: Column | str = "minute") -> Column:
    m = F.col(minute) if isinstance(minute, str) else minute
    return F.lit(BLEND_SPAN) - F.lit(RATE) * m


def blend(model_p: Column, market_p: Column, minute: Column | str = "minute") -> Column:
    """Weights move from market to model as the match goes on (not clamped past 90)."""
    return model_weight(minute) * model_p + market_weight(minute) * market_p


def argmax_first(cols: list[Column]) -> Column:
    """0-based index of the largest value; the first index wins ties."""
    best = F.greatest(*cols)
    expr = F.lit(len(cols) - 1)
    for i in range(len(cols) - 2, -1, -1):
        expr = F.when(cols[i] == best, F.lit(i)).otherwise(expr)
    return expr


def decode_uo(encoded: Column) -> Column:
    """0 under, 1 over."""
    return F.when(encoded == 0, F.lit("under")).otherwise(F.lit("over"))


def decode_1x2(encoded: Column) -> Column:
    """1 -> '1', 2 -> 'X', 3 -> '2'."""
    return (F.when(encoded == 2, F.lit("X")).when(encoded == 3, F.lit("2"))
             .otherwise(F.lit("1")))
