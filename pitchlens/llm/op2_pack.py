"""Best-fit packing of whole documents into sequences of at most ``capacity`` tokens.

Documents are tokenized once, cut into pieces of ``capacity`` where they are
longer, and the pieces written.  The histogram of their lengths, at most
``capacity`` counts however large the corpus, is packed by bin completion
(:mod:`binpack`); its plan, a few patterns a length, says for the i-th piece of
a length where it goes.  Pieces find their i in parallel: rows are dealt to
(length, bucket) groups of bounded size, numbered there, and moved by the sizes
of the buckets before, so a length that a third of all pieces have is spread.

Defined results: null or empty text is the end id alone; a null ``doc_id`` and
repeated rows are packed like any other row; an empty table gives no piece;
extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import string
import zlib
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchlens.llm._text import read
from pitchlens.llm.binpack import Plan, complete
from pitchlens.session import materialize

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, nth long"
#: Rows of a length that one task numbers.
BUCKET_ROWS = 200_000
#: Words whose ids a worker remembers; when there are more it forgets those that the texts at hand have not.
CACHED = 100_000
#: Bytes of text that a task has cut into words at once.
TEXT = 1 << 20
#: Words of lower-cased ASCII letters and letters from U+00C0 to U+00FF, all of them whole characters without combining marks.
LATIN = re.compile(rb"(?:[a-z]|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF])+").fullmatch
#: ASCII characters that are neither letter, digit nor white space.
MARKS = string.punctuation.encode()


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks fill the cores; threads of its own only cost memory and time
    return Tokenizer.from_file(path)


@cache
def _spelled(path: str) -> dict[int, str]:
    """How the tokenizer's model spells letters from U+00C0 to U+00FF: lower-cased, a character a byte, as its pre-tokenizer gives them."""
    tok = _tokenizer(path)
    return {ord(c): "".join(s for s, _ in tok.pre_tokenizer.pre_tokenize_str(c.lower())) for c in map(chr, range(0xC0, 0x100)) if c.isalpha()}


@cache
def _known(path: str) -> dict[bytes, bytes]:
    return {}


def token_ids(texts: list[bytes], path: str) -> Iterator[bytes]:
    """Each text's ids as little-endian 32-bit numbers.

    The tokenizer never joins anything across ASCII white space, so each stretch
    between is tokenized once and remembered.
    """
    known = _known(path)
    words = [t.split() for t in texts]
    at_hand = set().union(*words)
    if len(known) > CACHED:  # frequent words are among those at hand
        kept = {w: known[w] for w in at_hand if w in known}
        known.clear()
        known.update(kept)
    learn([w for w in at_hand if w not in known], path, known)
    for ws in words:
        yield b"".join(map(known.__getitem__, ws))


def learn(words: list[bytes], path: str, known: dict[bytes, bytes], together: int = 1000) -> None:
    """Adds each word's ids to those known.

    Letters that need no normalizing but lower case are one pre-token, for which the
    tokenizer's model is asked itself; marks after them stand alone.  All other words
    go through the whole tokenizer.
    """
    tok, spelled, other = _tokenizer(path), _spelled(path), []
    tokenize = tok.model.tokenize
    for w in words:
        low = w.lower()  # of bytes: ASCII letters only
        stem = low.rstrip(MARKS)
        ids = known.get(stem)
        if stem.isalpha():
            ids = ids or array("I", [t.id for t in tokenize(stem.decode())]).tobytes()
        elif LATIN(stem):
            ids = ids or array("I", [t.id for t in tokenize(stem.decode().translate(spelled))]).tobytes()
        else:
            other.append(w)
            continue
        known[stem] = ids
        if stem != low:
            marks = low[len(stem):]
            if marks not in known:
                known[marks] = array("I", tok.encode(marks.decode(), add_special_tokens=False).ids).tobytes()
            ids += known[marks]
        known[w] = ids
    for at in range(0, len(other), together):  # what the tokenizer returns is large, so some at a time
        some = other[at:at + together]
        found = tok.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)
        known.update((w, array("I", e.ids).tobytes()) for w, e in zip(some, found, strict=True))


def cut_pieces(path: str, capacity: int, end_id: int):
    """Arrow batches of (doc_id, text) to rows of PIECES; nth numbers a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, nth = np.array([end_id], "<u4").tobytes(), 0
        for b in batches:
            ids, column = b["doc_id"].to_pylist(), b["text"].cast(pa.binary())
            sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
            rows: list[tuple] = []
            at = 0
            while at < len(sizes):  # a few MB of text at a time
                stop, size = at, 0
                while stop < len(sizes) and (stop == at or size + sizes[stop] < TEXT):
                    size += sizes[stop]
                    stop += 1
                texts = [t or b"" for t in column.slice(at, stop - at).to_pylist()]
                for doc, coded in zip(ids[at:stop], token_ids(texts, path), strict=True):
                    coded += end
                    n = len(coded) // 4
                    for piece, start in enumerate(range(0, n, capacity)):
                        part = coded[4 * start:4 * (start + capacity)]
                        rows.append((doc, piece, start, len(part) // 4, zlib.crc32(part), nth))
                        nth += 1
                at = stop
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                                                 names=["doc_id", "piece", "start", "length", "ids_crc32", "nth"])

    return run


def slots(plan: Plan) -> dict[int, np.ndarray]:
    """For each length the plan's places in order: rows (rank from, rank to, bins from, offset, how many in a bin)."""
    out: dict[int, list[tuple[int, ...]]] = {}
    taken: dict[int, int] = {}
    first = 0
    for pattern, times in plan:
        offset = 0
        for size, per in pattern:
            at = taken.get(size, 0)
            taken[size] = at + per * times
            out.setdefault(size, []).append((at, taken[size], first, offset, per))
            offset += per * size
        first += times
    return {size: np.array(rows, np.int64) for size, rows in out.items()}


def place(where: dict[int, np.ndarray]):
    """Arrow batches with length and rank (from 0 in its length), with sequence_id and offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b["length"].to_numpy(zero_copy_only=False), b["rank"].to_numpy(zero_copy_only=False)
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(length):
                rows, own = where[int(size)], np.flatnonzero(length == size)
                at = rows[np.searchsorted(rows[:, 0], rank[own], side="right") - 1]
                i = rank[own] - at[:, 0]
                seq[own], off[own] = at[:, 2] + i // at[:, 4], at[:, 3] + i % at[:, 4] * size
            names = [n for n in b.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*[b[n] for n in names], pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    return run


def pack(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 0, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row a piece."""
    pieces = materialize(documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut_pieces(path or vocabulary(), capacity, end_id), PIECES), "pieces")
    sizes = pieces.groupBy("length").count().collect()  # a count for each length, capacity rows at most
    counts = np.zeros(capacity + 1, np.int64)
    for r in sizes:
        counts[r["length"]] = r["count"]
    where = slots(complete(counts, capacity))
    # rows of a length are dealt evenly over as many buckets as keep each within bounds
    dealt = pieces.withColumn("bucket", F.pmod("nth", F.lit(max(1, -(-int(counts.max()) // bucket_rows), 16))))
    held = dealt.groupBy("length", "bucket").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = held.withColumn("before", before).select(F.col("length").alias("_length"), F.col("bucket").alias("_bucket"), "before")
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("nth", "doc_id", "piece", "ids_crc32")) - 1
    ranked = dealt.withColumn("own", own).join(starts, (F.col("length") == F.col("_length")) & (F.col("bucket") == F.col("_bucket")))
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = ranked.select(*cols, (F.col("before") + F.col("own")).alias("rank"))
    return ranked.mapInArrow(place(where), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op2_pack(spark, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
