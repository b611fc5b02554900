"""Class-conditional Kneser-Ney models of symbols: numpy kernels.

Text is read as symbols of 6 bits: blank (any run of white space), the letters
without case, one for digits, two for punctuation, and 32 for the bytes above
127 (a letter and its capital share theirs in Latin-1).  An n-gram of ``ORDER``
symbols is a number below ``SYMBOLS ** ORDER``, which bounds every table here,
whatever the size of the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SYMBOLS, BITS, ORDER = 64, 6, 4

#: Symbols worked on at once.
PART = 1 << 20

CODE = np.zeros(256, np.uint8)  # control characters and blanks: 0
CODE[33:127] = 29
CODE[[ord(c) for c in ".,;:!?"]] = 28
CODE[48:58] = 27
CODE[65:91] = CODE[97:123] = np.arange(1, 27)
CODE[128:] = 32 + np.arange(128) % 32


def symbols(text: bytes | None) -> np.ndarray:
    """The symbols of a text, each run of blanks as one, a blank behind the last word; empty without a word."""
    found = CODE[np.frombuffer(text or b"", np.uint8)]
    inner = np.empty(len(found), bool)
    if len(found):
        inner[0] = found[0] != 0
        np.logical_or(found[1:] != 0, found[:-1] != 0, out=inner[1:])
    found = found[inner]
    return np.append(found, np.uint8(0)) if len(found) and found[-1] else found


def grams(found: np.ndarray):
    """Run after run of numbers: the n-gram that ends at each symbol, with blanks before the first."""
    padded = np.concatenate([np.zeros(ORDER - 1, np.uint8), found])
    for at in range(0, len(found), PART):
        some = padded[at:at + PART + ORDER - 1]
        n = len(some) - ORDER + 1
        out = np.zeros(n, np.int64)
        for i in range(ORDER):
            out = (out << BITS) | some[i:i + n]
        yield out


@dataclass
class Level:
    """One order of the models: log ratio of the n-grams seen, and of the weights that contexts leave to the order below."""

    keys: np.ndarray
    ratio: np.ndarray
    contexts: np.ndarray
    weight: np.ndarray


def ratios(keys: np.ndarray, counts: np.ndarray, shared: int = 2, discount: float = 0.75) -> list[Level]:
    """log(P of class 1 / P of class 0) of each n-gram, as levels from the lowest order on.

    keys: sorted n-grams of ORDER symbols; counts (2, n): how often each class
    has them.  The highest order counts occurrences, every lower one the
    different symbols seen before it.  Orders up to ``shared`` add both
    classes' counts, so an expression that is rare in a class falls back to
    numbers that both have.
    """
    tables = {ORDER: (keys.astype(np.int64), counts.astype(np.float64))}
    for order in range(ORDER - 1, 0, -1):
        above, n = tables[order + 1]
        low, where = np.unique(above & ((1 << (BITS * order)) - 1), return_inverse=True)
        tables[order] = low, np.stack([np.bincount(where, weights=c > 0, minlength=len(low)) for c in n])
    out, below, p = [], np.arange(1), np.ones((2, 1)) / SYMBOLS
    for order in range(1, ORDER + 1):
        keys, n = tables[order]
        if order <= shared:
            n = np.stack([n.sum(0)] * 2)
        contexts, where = np.unique(keys >> BITS, return_inverse=True)
        total = np.stack([np.bincount(where, weights=c, minlength=len(contexts)) for c in n])
        kinds = np.stack([np.bincount(where, weights=c > 0, minlength=len(contexts)) for c in n])
        left = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)  # a context that a class lacks leaves all
        lower = p[:, np.searchsorted(below, keys & ((1 << (BITS * (order - 1))) - 1))] if order > 1 else np.full((2, len(keys)), 1 / SYMBOLS)
        p = np.maximum(n - discount, 0) / np.maximum(total, 1)[:, where] + left[:, where] * lower
        below = keys
        out.append(Level(keys, np.log(p[1] / p[0]).astype(np.float32), contexts, np.log(left[1] / left[0]).astype(np.float32)))
    return out


def table(levels: list[Level]) -> np.ndarray:
    """The log ratio of every n-gram there can be: SYMBOLS ** ORDER numbers."""
    out = np.zeros(1, np.float32)
    for order, level in enumerate(levels, 1):
        weight = np.zeros(SYMBOLS ** (order - 1), np.float32)
        weight[level.contexts] = level.weight
        out = (np.repeat(weight, SYMBOLS).reshape(SYMBOLS, -1) + out).ravel() if order > 1 else np.full(SYMBOLS, weight[0])
        out[level.keys] = level.ratio
    return out


def log_ratio(text: bytes | None, whole: np.ndarray) -> tuple[float, int]:
    """The sum over the symbols of a text and their number."""
    found = symbols(text)
    return float(sum(whole[some].sum(dtype=np.float64) for some in grams(found))), len(found)
