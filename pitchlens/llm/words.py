"""Numpy kernels over a buffer of texts: words, their hashes, and hashes of word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pitchlens.llm.suffixes import Names, mix

#: Bytes of text that are worked on at once.
PART = 1 << 20
#: The same where each byte takes a hundred more for a while.
SMALL_PART = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def parts(texts: list[bytes | None], most: int = PART) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of neighbouring texts of about ``most`` bytes (a longer text alone) and the number of their first."""
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop] or b"") <= most):
            size += len(texts[stop] or b"")
            stop += 1
        yield at, [t or b"" for t in texts[at:stop]]
        at = stop


def binary(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def word_hashes(texts: list[bytes], want_bytes: bool = False):
    """A 64-bit hash for each word (A-Z lower-cased, split at ASCII white space) and the number of words of each text."""
    data = LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]  # a line end between two texts ends a word
    word = np.zeros(len(data) + 2, np.int8)
    word[1:-1] = ~SPACE[data]
    edge = np.diff(word)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ends = np.cumsum([len(t) + 1 for t in texts])
    count = np.diff(np.searchsorted(start, ends, side="left"), prepend=0)
    hashes = Names(data).of(start, stop)
    return (hashes, count, data, start, stop) if want_bytes else (hashes, count)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """The distinct hashes, sorted, of ``size`` words in a row of one text; with fewer words, of all of them; without words, none."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(size, n)
    out = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        out = mix(out + hashes[i:n - width + 1 + i])
    return np.unique(out)
