"""SetSketch: registers of exponentially spaced, truncated minima.

A register is floor(1 - log_b x) of the smallest of as many exponential values
x as the set has elements; two sketches merge by the larger of each register.
With base b near 1 two registers are equal about as often as the Jaccard
similarity, which makes bands of them locality-sensitive; how often one is
larger tells, with the two sizes, the similarity by maximum likelihood.
"""

from __future__ import annotations

import numpy as np

from pitchlens.llm.suffixes import mix

BASE, RATE = 1.001, 20.0
TOP = 2**16 - 1


def seeds(m: int) -> tuple[np.ndarray, np.ndarray]:
    n = mix(np.arange(1, 2 * m + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return n[:m] | np.uint64(1), n[m:]


def registers(elements: np.ndarray, m: int) -> np.ndarray:
    """m registers of a set of 64-bit hashes."""
    a, b = seeds(m)
    low = np.full(m, 2**64 - 1, np.uint64)
    for at in range(0, len(elements), 1024):
        x = elements[at:at + 1024, None] * a
        x ^= x >> np.uint64(32)
        x *= b | np.uint64(1)
        np.minimum(low, x.min(axis=0), out=low)
    u = (low.astype(np.float64) + 0.5) / 2.0**64
    x = -np.log1p(-np.minimum(u, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP).astype(np.uint16)


def merge(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The registers of the union."""
    return np.maximum(one, other)


def band_keys(regs: np.ndarray, rows: int) -> np.ndarray:
    """One key for each band of ``rows`` registers: equal only for equal bands at the same place."""
    bands = regs.reshape(-1, rows).astype(np.uint64)
    out = np.arange(1, len(bands) + 1, dtype=np.uint64)
    for i in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + bands[:, i])
    return out.view(np.int64)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def log_likelihood(j: np.ndarray, more: np.ndarray, less: np.ndarray, same: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Of similarity j, when ``more`` registers of the first set are larger, ``less`` smaller and ``same`` equal."""
    u, v = n1 / (n1 + n2), n2 / (n1 + n2)
    p, q = np.maximum(_p(u - v * j), 1e-12), np.maximum(_p(v - u * j), 1e-12)
    return more * np.log(p) + less * np.log(q) + same * np.log(np.maximum(1 - p - q, 1e-12))


def may_reach(r1: np.ndarray, r2: np.ndarray, n1: np.ndarray, n2: np.ndarray, least: float, doubt: float = 18.0) -> tuple[np.ndarray, np.ndarray]:
    """Whether similarity ``least`` is possible, and the likeliest similarity; rows of registers against rows.

    A pair goes only if its sizes rule the similarity out, or if it is likeliest
    below ``least`` and ``least`` is exp(doubt) times less likely than that.
    """
    ok, guess = np.zeros(len(r1), bool), np.zeros(len(r1))
    m = r1.shape[-1]
    # far fewer equal registers than a pair of that similarity can have: no need of the likelihood
    near = (r1 == r2).sum(-1) >= least * m - (2 * doubt * least * (1 - least) * m) ** 0.5 - 1
    if near.all():
        return _likely(r1, r2, n1, n2, least, doubt)
    ok[near], guess[near] = _likely(r1[near], r2[near], n1[near], n2[near], least, doubt)
    return ok, guess


def _likely(r1: np.ndarray, r2: np.ndarray, n1: np.ndarray, n2: np.ndarray, least: float, doubt: float) -> tuple[np.ndarray, np.ndarray]:
    more, less = (r1 > r2).sum(-1), (r1 < r2).sum(-1)
    same = r1.shape[-1] - more - less
    n1, n2 = n1.astype(np.float64), n2.astype(np.float64)
    lo, hi = np.zeros_like(n1), np.minimum(n1 / n2, n2 / n1)
    possible = np.minimum(n1, n2) >= least * np.maximum(n1, n2) - 1e-9
    top = hi.copy()
    f = lambda j: log_likelihood(j, more, less, same, n1, n2)
    for _ in range(24):  # it is concave: a golden section finds the maximum
        a, b = hi - 0.618034 * (hi - lo), lo + 0.618034 * (hi - lo)
        up = f(a) < f(b)
        lo, hi = np.where(up, a, lo), np.where(up, hi, b)
    best = (lo + hi) / 2
    return possible & ((best >= least) | (f(best) - f(np.minimum(least, top)) <= doubt)), best
