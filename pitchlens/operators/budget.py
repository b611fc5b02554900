"""Bet budget over ordered predictions (B5, B6) as a distributed prefix scan.

The budget ``{high, low}`` is a state machine: an accepted bet uses a slot of
its risk tier; when no slot is left in sum and the exposure after the bet
allows it, it becomes ``{high: 1, low: 2}``; a balance above the start restores
the first budget.  What a row does to the state is a function, functions
compose, so the sequential fold runs as three scans over blocks of rows:

1. rows are range-sorted by (session, order); every ``block_rows`` of a session
   in a partition are a block, whose function is composed while the rows stream by;
2. per session the blocks' functions are applied in order: a state a block;
3. each block is replayed from its state.

A tier may go below zero without end (its check reads the quoted odd, its use
the risk odd, and without exposure nothing is reset), so the states are not
finite.  A function is still a finite table: a tier further below zero than the
other can ever be above can neither be empty nor part of a reset, so from there
on all values behave alike, shifted.  The bounds come from the two budgets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import BUDGET_RESET
from ..session import materialize

BLOCK_ROWS = 4096
RULES = ["tier_check", "tier_use", "eligible", "exposure_ok", "balance_up", "exposure_after"]


class Budgets:
    """The first and the reset budget, and the tables of functions between states."""

    def __init__(self, init: dict):
        self.init = (init["high"], init["low"])
        self.again = (BUDGET_RESET["high"], BUDGET_RESET["low"])
        most = max(*self.init, *self.again)
        self.least, self.width = -most - 1, 2 * most + 2   # least: this or anything below
        grid = np.arange(self.least, most + 1, dtype=np.int64)
        self.high, self.low = (g.ravel() for g in np.meshgrid(grid, grid, indexing="ij"))

    def decide(self, high, low, row: tuple):
        """(accepted, empty, budget decided on, budget after, whether it was set anew) of one row;
        ``high`` and ``low`` are numbers or arrays of states."""
        check, use, eligible, exposed, up, after = row
        fresh = False
        if exposed and up:
            high, low, fresh = high * 0 + self.init[0], low * 0 + self.init[1], True
        empty = (high == 0) if check == "high" else (low == 0) if check == "low" else (high != high)
        ok = ~empty & True if isinstance(empty, np.ndarray) else not empty
        if not (exposed and eligible):
            ok = ok & False
        high2 = high - ok * (use == "high")
        low2 = low - ok * (use == "low")
        done = ok & (high2 + low2 == 0) & bool(after)
        return ok, empty, (high, low), (high2, low2), done, fresh

    def start(self) -> list[np.ndarray]:
        """The function that changes nothing: high, low, and whether they were set anew."""
        return [self.high.copy(), self.low.copy(), np.zeros(len(self.high), bool)]

    def then(self, fn: list[np.ndarray], row: tuple) -> None:
        """``fn`` followed by what ``row`` does."""
        _, _, _, (high, low), done, fresh = self.decide(fn[0], fn[1], row)
        fn[0], fn[1] = np.where(done, self.again[0], high), np.where(done, self.again[1], low)
        fn[2] |= done | fresh

    def apply(self, table: np.ndarray, high: int, low: int) -> tuple[int, int]:
        """The state after a block, from its table (3 x states) and the state before."""
        i = (max(high, self.least) - self.least) * self.width + max(low, self.least) - self.least
        if table[2, i]:
            return int(table[0, i]), int(table[1, i])
        return high + int(table[0, i] - self.high[i]), low + int(table[1, i] - self.low[i])


def _rows(b: pa.RecordBatch) -> list[tuple]:
    return list(zip(*[b[c].to_pylist() for c in RULES], strict=True))


def _blocks(budgets: Budgets, session: str, block_rows: int):
    """Sorted rows to the same rows with their block and place, and a row with the function of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, n, now, fn = TaskContext.get().partitionId() << 32, 0, None, None
        schema = None

        def closed() -> pa.RecordBatch:
            cols = [pa.array([now], f.type) if f.name == session else pa.nulls(1, f.type) for f in schema]
            return pa.RecordBatch.from_arrays([*cols, pa.array([block]), pa.array([0], pa.int32()), pa.array([np.concatenate(fn).astype(np.int64)], pa.list_(pa.int64()))],
                                              names=[*schema.names, "__block", "__pos", "__fn"])

        for b in batches:
            schema, blocks, places = b.schema, [], []
            for s, row in zip(b[session].to_pylist(), _rows(b), strict=True):
                if fn is None or s != now or n == block_rows:
                    if fn is not None:
                        yield closed()
                    block, n, now, fn = block + 1, 0, s, budgets.start()
                budgets.then(fn, row)
                blocks.append(block)
                places.append(n)
                n += 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(blocks, pa.int64()), pa.array(places, pa.int32()), pa.nulls(b.num_rows, pa.list_(pa.int64()))],
                                             names=[*b.schema.names, "__block", "__pos", "__fn"])
        if fn is not None:
            yield closed()

    return run


def _states(budgets: Budgets, session: str):
    """Block functions in order to the state before each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = ..., budgets.init
        for b in batches:
            highs, lows = [], []
            for s, fn in zip(b[session].to_pylist(), b["__fn"].to_pylist(), strict=True):
                if s != now:
                    now, state = s, budgets.init
                highs.append(state[0])
                lows.append(state[1])
                state = budgets.apply(np.array(fn).reshape(3, -1), *state)
            yield pa.RecordBatch.from_arrays([b["__block"], pa.array(highs, pa.int64()), pa.array(lows, pa.int64())], names=["__block", "__high", "__low"])

    return run


def _replay(budgets: Budgets, out: list[str]):
    """Blocks, each with its state first, to decisions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = low = 0
        for b in batches:
            keep, found = [], []
            states = zip(b["__pos"].to_pylist(), b["__high"].to_pylist(), b["__low"].to_pylist(), strict=True)
            for i, ((pos, h, l), row) in enumerate(zip(states, _rows(b), strict=True)):
                if pos < 0:
                    high, low = h, l
                    continue
                ok, empty, used, (high, low), done, _ = budgets.decide(high, low, row)
                if done:
                    high, low = budgets.again
                keep.append(i)
                found.append((*used, bool(empty), bool(ok)))
            if keep:
                kinds = [pa.int32(), pa.int32(), pa.bool_(), pa.bool_()]
                rows = b.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([*[rows[c] for c in out], *[pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)]],
                                                 names=[*out, "budget_high", "budget_low", "budget_empty", "accepted"])

    return run


def budget_fold(bets: DataFrame, session: str, order: list[str], init: dict,
                keys: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``accepted`` and ``budget_empty`` per bet, budget carried in order.

    ``bets`` needs: ``tier_check`` / ``tier_use`` ('high'/'low', from the
    quoted and the risk odd), ``eligible`` (event, market, quote and rules
    passed), ``exposure_ok`` and ``balance_up`` (of the balance before the bet),
    and may have ``exposure_after`` (of the balance after it; else as before).
    A row without exposure is dropped and changes nothing.  Output: ``keys`` +
    ``budget_high`` / ``budget_low`` the bet is decided on, ``budget_empty``,
    ``accepted``.
    """
    budgets = Budgets(init)
    if "exposure_after" not in bets.columns:
        bets = bets.withColumn("exposure_after", F.col("exposure_ok"))
    names = list(dict.fromkeys([session, *order, *keys]))
    rules = [F.coalesce(F.col(c), F.lit(False)).alias(c) if c not in ("tier_check", "tier_use") else F.col(c) for c in RULES]
    rows = bets.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(names)], *rules)
    of = {c: f"__{i}" for i, c in enumerate(names)}
    sort = [of[session], *[of[c] for c in order]]
    schema = T.StructType([*rows.schema, T.StructField("__block", T.LongType()), T.StructField("__pos", T.IntegerType()),
                           T.StructField("__fn", T.ArrayType(T.LongType()))])
    for f in schema:
        f.nullable = True
    dealt = rows.repartitionByRange(*sort).sortWithinPartitions(*sort)
    cut = materialize(dealt.mapInArrow(_blocks(budgets, of[session], block_rows), schema), "bets")
    fns = cut.where(F.col("__fn").isNotNull()).select(of[session], "__block", "__fn")
    states = (fns.repartition(of[session]).sortWithinPartitions(of[session], "__block")
              .mapInArrow(_states(budgets, of[session]), "__block long, __high long, __low long"))
    rows = cut.where(F.col("__fn").isNull()).drop("__fn").withColumns({"__high": F.lit(None).cast("long"), "__low": F.lit(None).cast("long")})
    both = rows.unionByName(states.withColumn("__pos", F.lit(-1)), allowMissingColumns=True)
    out = [of[session], *[of[k] for k in keys if k != session]]
    kinds = T.StructType([*[f for c in out for f in cut.schema if f.name == c], *[T.StructField(c, T.IntegerType()) for c in ("budget_high", "budget_low")],
                          *[T.StructField(c, T.BooleanType()) for c in ("budget_empty", "accepted")]])
    done = both.repartition("__block").sortWithinPartitions("__block", "__pos").mapInArrow(_replay(budgets, out), kinds)
    back = {v: k for k, v in of.items()}
    return done.select(*[F.col(c).alias(back[c]) for c in out], "budget_high", "budget_low", "budget_empty", "accepted")
