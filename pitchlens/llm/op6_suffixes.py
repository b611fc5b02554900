"""Suffix dedup: bytes of every 100-byte string that also starts earlier go.

A difference cover takes suffixes at places of fixed remainder and sorts a row
for each of them again and again; for every byte of the corpus that is many
times its size in shuffles.  Here the cover is chosen by content instead: every
window of ``span`` bytes is stood for by one place in it (:func:`sampled`), the
same in equal windows, about one place in forty bytes.

1. *Sort the sampled suffixes by names.*  A sampled place has the name of its
   gram and the name of the stretch that its windows cover.  Rows are dealt and
   sorted by both; equal neighbours are repeats of the first, all windows at
   once.  A task keeps only its first row of each stretch, so a passage that a
   third of all documents hold sends a row a task, not a row a document.
2. *Merge the remaining suffixes.*  Where one gram stands in different stretches
   their bytes are fetched, dealt by the gram, and the suffixes that start at
   each window are sorted by the name of their ``span``-byte prefix; equal
   neighbours are repeats of the first.  A gram with more than ``hot`` stretches
   is dealt by the names of the windows themselves instead.
3. The repeats, a set of intervals a document, are cut from the texts.

Defined results: null text is empty; texts shorter than ``span`` bytes never
lose any; a null ``doc_id`` sorts before all others; rows with the same id and
different texts are documents of their own, in order of a hash of the text;
identical rows are one document and are returned as often as they stand there;
an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlens.llm._text import id_key, read
from pitchlens.llm.suffixes import R2, Names, mix, sampled
from pitchlens.session import materialize

ROWS = "kind int, key long, name long, doc long, tk long, lo long, n int"
KINDS = [("kind", pa.int32()), ("key", pa.int64()), ("name", pa.int64()), ("doc", pa.int64()), ("tk", pa.int64()), ("lo", pa.int64()), ("n", pa.int32())]
#: STRETCH: n windows from lo on under a gram's key, not yet decided. WINDOW: one window, key and name its name. REPEAT: n windows that start earlier too.
#: SHARED, BUSY: stretches whose gram stands in others, up to, or in more than, `hot` of them.
STRETCH, WINDOW, REPEAT, SHARED, BUSY = range(5)
#: Bytes of text that are worked on at once; longer texts go in overlapping parts.
PART = 1 << 21


def _batch(cols: dict[str, np.ndarray], data: list | None = None) -> pa.RecordBatch:
    arrays = [pa.array(np.ascontiguousarray(cols[c]).astype(t.to_pandas_dtype(), copy=False) if cols[c].dtype != np.uint64 else cols[c].view(np.int64), t) for c, t in KINDS]
    names = [c for c, _ in KINDS]
    if data is None:
        return pa.RecordBatch.from_arrays(arrays, names=names)
    return pa.RecordBatch.from_arrays([*arrays, pa.array(data, pa.binary())], names=[*names, "data"])


def _firsts(cols: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Sorted by key, name and place: the rows, whether each is its class's first, whether it is a repeat of it elsewhere."""
    order = np.lexsort([cols[c] for c in ("lo", "tk", "doc", "name", "key")])
    cols = {c: v[order] for c, v in cols.items()}
    new = np.ones(len(order), bool)
    new[1:] = (cols["key"][1:] != cols["key"][:-1]) | (cols["name"][1:] != cols["name"][:-1])
    at = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    own = (cols["doc"] == cols["doc"][at]) & (cols["tk"] == cols["tk"][at]) & (cols["lo"] == cols["lo"][at])
    return cols, new, ~own


def _first_and_repeats(cols: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Of each class the first row, and the others as REPEATs, dealt by their own place."""
    cols, new, repeat = _firsts(cols)
    cols["kind"] = np.where(repeat, REPEAT, cols["kind"])
    spread = mix((cols["doc"] ^ cols["tk"] ^ (cols["lo"] << 20)).view(np.uint64)).view(np.int64)
    cols["key"] = np.where(repeat, spread, cols["key"])
    return {c: v[new | repeat] for c, v in cols.items()}


def stretches(span: int, gram: int):
    """Arrow batches of (doc, tk, text) to the STRETCHes of their sampled suffixes."""

    def of_parts(parts: list[tuple[int, int, int, bytes]]) -> dict[str, np.ndarray] | None:
        data = np.frombuffer(b"".join(p[3] for p in parts), np.uint8)
        ends = np.cumsum([len(p[3]) for p in parts])
        names = Names(data)
        place, first, stop = sampled(data, ends, span, gram, names)
        if not len(first):
            return None
        which = np.searchsorted(ends, first, side="right")
        starts = ends - np.diff(ends, prepend=0)
        doc, tk, base = (np.array([p[i] for p in parts], np.int64) for i in range(3))
        return {"kind": np.full(len(first), STRETCH), "key": names.of(place, place + gram).view(np.int64), "name": names.of(first, stop + span - 1).view(np.int64),
                "doc": doc[which], "tk": tk[which], "lo": first - starts[which] + base[which], "n": stop - first}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, size, found = [], 0, []
            for doc, tk, text in zip(b["doc"].to_pylist(), b["tk"].to_pylist(), b["text"].cast(pa.binary()).to_pylist(), strict=True):
                for at in range(0, max(1, len(text) - span + 1), PART):  # parts share span - 1 bytes: each window is in one
                    parts.append((doc, tk, at, text[at:at + PART + span - 1]))
                    size += len(parts[-1][3])
                    if size >= PART:
                        found.append(of_parts(parts))
                        parts, size = [], 0
            found = [f for f in [*found, of_parts(parts) if parts else None] if f]
            if found:
                yield _batch(_first_and_repeats({c: np.concatenate([f[c] for f in found]) for c in found[0]}))

    return run


def whole_keys(decide, extra: tuple[str, ...] = ()):
    """Sorted Arrow batches, through ``decide`` with all rows of a key at once."""
    names = [c for c, _ in KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            table = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks()
            key, kind = table["key"].to_numpy(), table["kind"].to_numpy()
            same = (key == key[-1]) & (kind == kind[-1])
            cut = int(np.flatnonzero(same)[0])
            rows = table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()[0]
            if cut and (out := decide({c: rows[c].to_numpy() for c in names}, *[rows[c] for c in extra])) is not None:
                yield out
        if held is not None and (out := decide({c: held[c].to_numpy(zero_copy_only=False) for c in names}, *[held[c] for c in extra])) is not None:
            yield out

    return run


def by_stretch(hot: int):
    """Repeats among the stretches of each gram, and the first of each stretch where a gram stands in several."""

    def decide(cols: dict[str, np.ndarray]) -> pa.RecordBatch | None:
        done = cols["kind"] == REPEAT
        known = {c: v[done] for c, v in cols.items()}
        cols, new, repeat = _firsts({c: v[~done] for c, v in cols.items()})
        if len(new):
            grams = np.ones(len(new), bool)
            grams[1:] = cols["key"][1:] != cols["key"][:-1]
            start = np.flatnonzero(grams)
            kinds = np.repeat(np.add.reduceat(new, start), np.diff(np.append(start, len(new))))
            cols["kind"] = np.where(repeat, REPEAT, np.where(kinds > hot, BUSY, SHARED))
            keep = repeat | new & (kinds > 1)
            known = {c: np.concatenate([known[c], cols[c][keep]]) for c in cols}
        return _batch(known) if len(known["key"]) else None

    return decide


def fetch(span: int):
    """Arrow batches of (doc, tk, text, some: the document's shared stretches) to rows with their bytes, or windows of busy ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, data, busy = [], [], []
            for doc, tk, text, some in zip(b["doc"].to_pylist(), b["tk"].to_pylist(), b["text"].cast(pa.binary()).to_pylist(), b["some"].to_pylist(), strict=True):
                for s in some:
                    stretch = text[s["lo"]:s["lo"] + s["n"] + span - 1]
                    if s["kind"] == SHARED:
                        rows.append((STRETCH, s["key"], 0, doc, tk, s["lo"], s["n"]))
                        data.append(stretch)
                    else:
                        busy.append((doc, tk, s["lo"], stretch))
            if rows:
                yield _batch(dict(zip([c for c, _ in KINDS], np.array(rows, np.int64).T, strict=True)), data)
            for at in range(0, len(busy), 4000):
                some = busy[at:at + 4000]
                cols = windows([x[3] for x in some], *(np.array([x[i] for x in some], np.int64) for i in range(3)), span, pair=True)
                cols = _first_and_repeats(cols)
                yield _batch(cols, [None] * len(cols["key"]))

    return run


def windows(data: list[bytes], doc: np.ndarray, tk: np.ndarray, lo: np.ndarray, span: int, pair: bool) -> dict[str, np.ndarray]:
    """A row for each window of some stretches: key its name, and name a second one if ``pair``."""
    joined = np.frombuffer(b"".join(data), np.uint8)
    size = np.array([len(d) for d in data], np.int64)
    n, base = size - span + 1, np.cumsum(size) - size
    which = np.repeat(np.arange(len(data)), n)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    start = base[which] + nth
    key = Names(joined).of(start, start + span).view(np.int64)
    name = Names(joined, R2).of(start, start + span).view(np.int64) if pair else np.zeros(len(key), np.int64)
    return {"kind": np.full(len(key), WINDOW), "key": key, "name": name, "doc": doc[which], "tk": tk[which], "lo": lo[which] + nth, "n": np.ones(len(key), np.int64)}


def by_window(span: int):
    """Repeats among the windows of stretches that share a gram, and among windows of one name."""

    def decide(cols: dict[str, np.ndarray], data: pa.ChunkedArray | pa.Array) -> pa.RecordBatch | None:
        out = [{c: v[cols["kind"] == REPEAT] for c, v in cols.items()}]
        one = cols["kind"] == WINDOW
        if one.any():
            found, _, repeat = _firsts({c: v[one] for c, v in cols.items()})
            out.append({c: v[repeat] for c, v in found.items()})
        whole = np.flatnonzero(cols["kind"] == STRETCH)
        if len(whole):
            texts = data.take(pa.array(whole)).to_pylist()
            found = windows(texts, *(cols[c][whole] for c in ("doc", "tk", "lo")), span, pair=False)
            found, _, repeat = _firsts(found)
            out.append({c: v[repeat] for c, v in found.items()})
        cols = {c: np.concatenate([o[c] for o in out]) for c in cols}
        cols["kind"] = np.full(len(cols["key"]), REPEAT)
        return _batch(_runs(cols)) if len(cols["key"]) else None

    return decide


def _runs(cols: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Neighbouring windows of a document as one row."""
    order = np.lexsort([cols[c] for c in ("lo", "tk", "doc")])
    cols = {c: v[order] for c, v in cols.items()}
    stop = cols["lo"] + cols["n"]
    new = np.ones(len(order), bool)
    new[1:] = (cols["doc"][1:] != cols["doc"][:-1]) | (cols["tk"][1:] != cols["tk"][:-1]) | (cols["lo"][1:] > stop[:-1])
    start = np.flatnonzero(new)
    out = {c: v[start] for c, v in cols.items()}
    out["n"] = np.maximum.reduceat(stop, start) - out["lo"]
    return out


def repeats(documents: DataFrame, span: int = 100, gram: int = 24, hot: int = 5000) -> DataFrame:
    """(doc, tk, lo, n): from byte lo on, n windows of ``span`` bytes that start earlier too; they may overlap."""
    docs = documents.select(id_key(F.col("doc_id")).alias("doc"), F.xxhash64("text").alias("tk"), "text").where(F.octet_length("text") >= span)
    order = ["kind", "key", "name", "doc", "tk", "lo"]
    dealt = docs.mapInArrow(stretches(span, gram), ROWS).repartition("key").sortWithinPartitions(*order)
    found = materialize(dealt.mapInArrow(whole_keys(by_stretch(hot)), ROWS), "stretches")
    some = found.where(F.col("kind") != REPEAT).groupBy("doc", "tk").agg(F.collect_set(F.struct("kind", "key", "lo", "n")).alias("some"))
    dealt = docs.join(some, ["doc", "tk"]).mapInArrow(fetch(span), ROWS + ", data binary").repartition("key").sortWithinPartitions(*order)
    late = dealt.mapInArrow(whole_keys(by_window(span), ("data",)), ROWS)
    cols = ["doc", "tk", "lo", "n"]
    return found.where(F.col("kind") == REPEAT).select(cols).unionByName(late.select(cols))


def cut(span: int):
    """Arrow batches of (doc_id, text, some: its repeats) to the bytes kept and what went."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text, some in zip(b["doc_id"].to_pylist(), b["text"].cast(pa.binary()).to_pylist(), b["some"].to_pylist(), strict=True):
                text, kept, at, runs = text or b"", [], 0, 0
                for lo, n in sorted((s["lo"], s["n"]) for s in some or ()):
                    if lo > at or not runs:
                        runs += 1
                        kept.append(text[at:lo])
                    at = max(at, lo + n + span - 1)
                kept = b"".join([*kept, text[at:]])
                rows.append((doc, len(text), len(text) - len(kept), runs, kept))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                                                 names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def dedup_spans(documents: DataFrame, span: int = 100, gram: int = 24, hot: int = 5000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary): a row for each row of ``documents``."""
    found = materialize(repeats(documents, span, gram, hot), "repeats")
    per = found.groupBy(F.col("doc").alias("_doc"), F.col("tk").alias("_tk")).agg(F.collect_list(F.struct("lo", "n")).alias("some"))
    docs = documents.select(F.col("doc_id").cast("long"), "text")
    both = docs.join(per, (id_key(docs["doc_id"]) == per["_doc"]) & (F.xxhash64(docs["text"]) == per["_tk"]), "left")
    return both.select("doc_id", "text", "some").mapInArrow(cut(span), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_spans(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
