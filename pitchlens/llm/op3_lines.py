"""Line dedup: per-document keep bitmaps from hashes that are range-partitioned and streamed in order.

1. Every long enough line becomes (128-bit hash of its key, document, position).
2. These rows are range-partitioned by (hash, document) and sorted inside each
   partition by hash, then document from the largest down, then position, so
   the first row of a run belongs to the document that keeps the line.  A run
   is decided while it streams by.  A hash that holds a third of all rows
   spans many partitions: the first and the last run of a partition are left
   open, summed up in two rows a partition, and closed by those sums.
3. What is dropped, a set of positions a document, is packed to a compressed
   bitmap; :func:`apply_bitmaps` cuts the lines from the texts.

Defined results: null or empty text is one empty line, never dropped; rows with
the same ``doc_id`` are one document when documents are counted; rows with a
null ``doc_id`` count as one document below all others; repeated rows are
returned as often as they stand there; a line repeated inside the document
that keeps it stays everywhere there; empty tables give empty tables; extra
columns are kept, and a column named like one of the results is replaced.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlens.llm._text import id_key, read
from pitchlens.session import materialize

LINES = "h1 long, h2 long, doc long, tk long, pos int, n_lines int"
RUNS = "kind int, " + LINES + ", docs long, top long"
DROPPED, OPEN, SUM = 0, 1, 2


def line_keys(min_chars: int):
    """Arrow batches of (doc, tk, text) to rows of LINES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc, tk, text in zip(b["doc"].to_pylist(), b["tk"].to_pylist(), b["text"].cast(pa.binary()).to_pylist(), strict=True):
                lines = (text or b"").split(b"\n")
                for pos, line in enumerate(lines):
                    key = line.strip().lower()  # of bytes: ASCII white space and letters only
                    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
                        continue
                    out.append((hashlib.blake2b(key, digest_size=16).digest(), doc, tk, pos, len(lines)))
                if len(out) > 200_000:
                    yield _lines_batch(out)
                    out = []
            if out:
                yield _lines_batch(out)

    return run


def _lines_batch(rows: list[tuple]) -> pa.RecordBatch:
    digests, doc, tk, pos, n = zip(*rows, strict=True)
    h = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
    return pa.RecordBatch.from_arrays(
        [pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(doc, pa.int64()), pa.array(tk, pa.int64()), pa.array(pos, pa.int32()), pa.array(n, pa.int32())],
        names=["h1", "h2", "doc", "tk", "pos", "n_lines"])


def decide_runs(min_docs: int):
    """Sorted batches of LINES to rows of RUNS: what inner runs drop, and the open rows and sums of a partition's first and last run."""
    cols = ["h1", "h2", "doc", "tk", "pos", "n_lines"]

    def emit(rows: dict[str, np.ndarray], kind: np.ndarray, docs: np.ndarray, top: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(kind.astype(np.int32)), *[pa.array(rows[c]) for c in cols], pa.array(docs.astype(np.int64)), pa.array(top.astype(np.int64))],
            names=["kind", *cols, "docs", "top"])

    def decided(rows: dict[str, np.ndarray], first: bool, last: bool) -> pa.RecordBatch | None:
        """rows: whole runs; first, last: whether the first and the last of them touch the partition's ends."""
        n = len(rows["doc"])
        if not n:
            return None
        new = np.ones(n, bool)
        new[1:] = (rows["h1"][1:] != rows["h1"][:-1]) | (rows["h2"][1:] != rows["h2"][:-1])
        start = np.flatnonzero(new)
        new_doc = new.copy()
        new_doc[1:] |= rows["doc"][1:] != rows["doc"][:-1]
        size = np.diff(np.append(start, n))
        docs, top = np.repeat(np.add.reduceat(new_doc, start), size), np.repeat(rows["doc"][start], size)
        opened = np.zeros(n, bool)
        ends = ([0] if first else []) + ([len(start) - 1] if last else [])
        for r in ends:
            opened[start[r]:start[r] + size[r]] = True
        drop = ~opened & (docs >= min_docs) & (rows["doc"] != top)
        sums = np.unique(start[ends]) if ends else np.array([], int)
        take = np.concatenate([np.flatnonzero(drop), np.flatnonzero(opened), sums]).astype(int)
        kind = np.repeat([DROPPED, OPEN, SUM], [drop.sum(), opened.sum(), len(sums)])
        return emit({c: v[take] for c, v in rows.items()}, kind, docs[take], top[take]) if len(take) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, True
        for b in batches:
            if not b.num_rows:
                continue
            now = {c: b[c].to_numpy(zero_copy_only=False) for c in cols}
            rows = now if held is None else {c: np.concatenate([held[c], now[c]]) for c in cols}
            same = (rows["h1"] == rows["h1"][-1]) & (rows["h2"] == rows["h2"][-1])
            cut = int(np.flatnonzero(same)[0])  # the last run may go on in the next batch
            if cut:
                if (out := decided({c: v[:cut] for c, v in rows.items()}, first, False)) is not None:
                    yield out
                first = False
            held = {c: v[cut:] for c, v in rows.items()}
        if held is not None and (out := decided(held, first, True)) is not None:
            yield out

    return run


PACKED = "doc long, tk long, keep binary, n_dropped_lines int"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep, dropped = [], []
        for pos, n in zip(b["pos"].to_pylist(), b["n_lines"].to_pylist(), strict=True):
            bits = np.ones(n, bool)
            bits[pos] = False
            keep.append(zlib.compress(np.packbits(bits).tobytes()))
            dropped.append(int(n - bits.sum()))
        yield pa.RecordBatch.from_arrays([b["doc"], b["tk"], pa.array(keep, pa.binary()), pa.array(dropped, pa.int32())],
                                         names=["doc", "tk", "keep", "n_dropped_lines"])


def keep_bitmaps(documents: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc, tk, keep, n_dropped_lines) of each document that loses lines: zlib over packed bits, one a line, 1 to keep."""
    rows = documents.select(id_key(F.col("doc_id")).alias("doc"), F.xxhash64("text").alias("tk"), "text")
    lines = materialize(rows.mapInArrow(line_keys(min_chars), LINES), "lines")
    dealt = lines.repartitionByRange("h1", "h2", F.col("doc").desc()).sortWithinPartitions("h1", "h2", F.col("doc").desc(), "tk", "pos")
    runs = materialize(dealt.mapInArrow(decide_runs(min_docs), RUNS), "runs")
    sums = runs.where(F.col("kind") == SUM).groupBy("h1", "h2").agg(F.sum("docs").alias("all_docs"), F.max("top").alias("all_top"))
    late = runs.where(F.col("kind") == OPEN).join(F.broadcast(sums), ["h1", "h2"])  # two rows a partition at most
    late = late.where((F.col("all_docs") >= min_docs) & (F.col("doc") != F.col("all_top")))
    cols = ["doc", "tk", "pos", "n_lines"]
    gone = runs.where(F.col("kind") == DROPPED).select(cols).unionByName(late.select(cols))
    return gone.groupBy("doc", "tk").agg(F.collect_set("pos").alias("pos"), F.first("n_lines").alias("n_lines")).mapInArrow(_pack, PACKED)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, lines, dropped = [], [], []
        for text, keep in zip(b["text"].cast(pa.binary()).to_pylist(), b["keep"].to_pylist(), strict=True):
            n = (text or b"").count(b"\n") + 1
            lines.append(n)
            if keep is None:
                texts.append(text)
                dropped.append(0)
                continue
            bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n)
            texts.append(b"\n".join(line for line, bit in zip(text.split(b"\n"), bits, strict=True) if bit))
            dropped.append(int(n - bits.sum()))
        out = {c: b[c] for c in b.schema.names if c != "keep"}
        out |= {"text": pa.array(texts, pa.binary()).cast(pa.string()), "n_lines": pa.array(lines, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())}
        yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))


def apply_bitmaps(documents: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``documents`` with the kept lines as ``text`` (null stays null where nothing was cut), and n_lines, n_dropped."""
    docs = documents.drop("keep", "n_lines", "n_dropped")
    small = bitmaps.select(F.col("doc").alias("_doc"), F.col("tk").alias("_tk"), "keep")
    on = (id_key(docs["doc_id"]) == small["_doc"]) & (F.xxhash64(docs["text"]) == small["_tk"])
    both = docs.join(small, on, "left").drop("_doc", "_tk")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", n_lines long, n_dropped long"
    return both.mapInArrow(_cut, schema)


def dedup_lines(documents: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``documents`` without the repeated lines, all columns, and n_lines, n_dropped."""
    return apply_bitmaps(documents, keep_bitmaps(documents, min_chars, min_docs))


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.r, k.doc_id, k.line, k.pos, f.key IS NOT NULL AND k.doc_id <> f.top AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""
