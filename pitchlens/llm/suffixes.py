"""Numpy kernels of the suffix operator: sampled suffixes of a buffer of texts, and names of their prefixes."""

from __future__ import annotations

import numpy as np

#: Fixed odd multipliers of the two rolling hashes.
R1, R2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Names:
    """Hashes of any stretch of a buffer from prefix sums: equal bytes give equal names wherever they stand."""

    def __init__(self, data: np.ndarray, r: int = R1):
        n = len(data)
        powers = np.full(n + 1, r, np.uint64)
        powers[0] = 1
        np.cumprod(powers, out=powers)
        back = np.full(n + 1, pow(r, -1, 2**64), np.uint64)
        back[0] = 1
        self.back = np.cumprod(back, out=back)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.back[start] + (stop - start).astype(np.uint64))

    def all(self, size: int) -> np.ndarray:
        """The name of each stretch of ``size`` bytes, by its start."""
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.back[:n])


def sampled(data: np.ndarray, ends: np.ndarray, span: int, gram: int, names: Names) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sampled suffixes and the windows each stands for.

    Each window of ``span`` bytes inside a text is stood for by the leftmost
    smallest of the grams in it.  Equal windows choose the same place, so a
    repeat of ``span`` bytes shares a sampled suffix at the same distance.

    ends: where each text ends in ``data``, in order.  Returns (place of the
    sampled gram, first window, past the last window), by place in ``data``.
    """
    width = span - gram + 1
    none = np.empty(0, np.int64)
    if len(data) < span:
        return none, none, none
    h = names.all(gram)
    low, n = h, 1
    while 2 * n <= width:
        low = np.minimum(low[:-n], low[n:])
        n *= 2
    if n < width:
        low = np.minimum(low[:len(low) - (width - n)], low[width - n:])
    starts = np.concatenate([[0], ends[:-1]])
    inside = ends - starts >= span
    starts, ends = starts[inside], ends[inside]
    if not len(starts):
        return none, none, none
    valid = np.zeros(len(low) + 1, np.int8)  # windows that lie in one text
    np.add.at(valid, starts, 1)
    np.add.at(valid, ends - span + 1, -1)
    valid = np.cumsum(valid[:-1], dtype=np.int8).astype(bool)
    new = np.zeros(len(low), bool)
    new[1:] = (low[1:] < low[:-1]) | (h[:len(low) - 1] == low[:-1])
    new[starts] = True
    new &= valid
    first = np.flatnonzero(new)
    place = np.empty(len(first), np.int64)
    grams = np.lib.stride_tricks.sliding_window_view(h, width)
    for at in range(0, len(first), 200_000):
        some = first[at:at + 200_000]
        place[at:at + 200_000] = some + grams[some].argmin(axis=1)
    text_stop = ends[np.searchsorted(ends, first, side="right")] - span + 1
    stop = np.minimum(np.append(first[1:], len(low)), text_stop)
    return place, first, stop
