"""Quality classifier: hashed word and character n-gram vectors, averaged per document, with a softmax on top.

Features of a text are its words, its pairs of neighbouring words (a word after
itself is one feature, whatever the word) and the stretches of 3, 4 and 5 bytes
inside each word with the white space around it, all hashed into ``1 << bits``
rows of a table of vectors.  A document is the mean of its features' vectors; table and
softmax are learned by stochastic gradient descent in numpy.

Training takes at most ``sample`` labelled rows (a bound on labelled rows, half
of them for each label, drawn by a hash of the id).  They reach the driver as
counts by row of the table, whose size is bounded too.  Scoring needs of each
row only its product with the softmax, one number, so all texts are scored
where they lie, whole, without any shuffle.

Defined results: null, empty and wordless texts have no feature and get the
score of the bias alone; a row with a null ``doc_id`` is held out and never
learned from; of several labels of an id the smallest counts; null labels are no
labels; without labels of both kinds every score is the share of label 1 (1 if
there are none); repeated rows are returned as often as they stand there; an
empty table gives an empty table; extra columns are ignored or, by
:func:`keep_good`, kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchlens.llm._text import read
from pitchlens.llm.suffixes import Names, mix
from pitchlens.llm.words import SMALL_PART, SPACE, binary, parts

GRAMS = (3, 4, 5)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def features(texts: list[bytes], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Kind after kind of feature: the row of the table of each, and the number of its text."""
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    space = SPACE[data]
    data = np.where(space, np.uint8(32), data)  # any white space alike
    names, ends = Names(data), np.cumsum([len(t) + 1 for t in texts])
    shift = np.uint64(64 - bits)
    before = np.zeros(len(data) + 1, np.int32)
    np.cumsum(space, out=before[1:])
    for n in GRAMS:
        if len(data) < n:
            continue
        inner = before[n - 1:len(data)] - before[1:len(data) - n + 2]  # white space between the first and the last byte
        at = np.flatnonzero(inner == 0)
        yield (names.of(at, at + n) >> shift).astype(np.int64), np.minimum(np.searchsorted(ends, at, side="right"), len(texts) - 1)
    edge = np.diff(space.astype(np.int8))
    start, stop = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
    which = np.searchsorted(ends, start, side="right")
    yield (names.of(start - 1, stop) >> shift).astype(np.int64), which
    word = names.of(start, stop)
    pair = np.flatnonzero(which[1:] == which[:-1]) + 1
    # two words in a row; a word after itself is one feature, whatever the word
    two = np.where(word[pair] == word[pair - 1], np.uint64(0), mix(word[pair - 1] + mix(word[pair])))
    yield (two >> shift).astype(np.int64), which[pair]


def counted(bits: int):
    """Arrow batches of (label, text) to (label, rows, counts): a text's features as counts by row of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, counts = [], []
            for text in binary(b["text"]):
                found = [r for r, _ in features([text or b""], bits)]
                row, count = np.unique(np.concatenate(found), return_counts=True)
                rows.append(row.astype(np.int32))
                counts.append(count.astype(np.int32))
            yield pa.RecordBatch.from_arrays([b["label"], pa.array(rows, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], names=["label", "rows", "counts"])

    return run


@dataclass
class Classifier:
    table: np.ndarray  # row, dimension
    out: np.ndarray  # dimension, label
    bias: np.ndarray  # label

    def weights(self) -> tuple[np.ndarray, float]:
        """A feature's part in the difference of the two labels' inputs to the softmax, and the bias."""
        return (self.table @ (self.out[:, 1] - self.out[:, 0])).astype(np.float64), float(self.bias[1] - self.bias[0])


def fit(rows: list[np.ndarray], counts: list[np.ndarray], labels: np.ndarray, bits: int, dims: int = 8, epochs: int = 6, rate: float = 0.5, seed: int = 1) -> Classifier:
    """Stochastic gradient descent over documents in random order, the rate falling to nothing."""
    r = np.random.default_rng(seed)
    model = Classifier(r.uniform(-1 / dims, 1 / dims, (1 << bits, dims)).astype(np.float32), np.zeros((dims, 2), np.float32), np.zeros(2, np.float32))
    share = np.bincount(labels, minlength=2) / max(1, len(labels))
    if min(share) == 0:
        model.bias[:] = (0, 40) if share[0] == 0 else (40, 0)
        return model
    weight = 0.5 / share  # both labels weigh the same
    steps, step = epochs * len(labels), 0
    for _ in range(epochs):
        for i in r.permutation(len(labels)):
            if not len(rows[i]):
                step += 1
                continue
            part = (counts[i] / counts[i].sum()).astype(np.float32)
            mean = part @ model.table[rows[i]]
            z = mean @ model.out + model.bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            grad = (p * weight[labels[i]] * rate * (1 - step / steps)).astype(np.float32)
            back = model.out @ grad
            model.out -= np.outer(mean, grad)
            model.bias -= 0.1 * grad
            # the share of a feature in the mean is small, so its vector takes a longer step
            model.table[rows[i]] -= np.outer(np.minimum(part * 50, 1), back)
            step += 1
    return model


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of a column, as views of its numbers."""
    return [x for c in column.chunks for x in np.split(c.flatten().to_numpy(), c.offsets.to_numpy()[1:-1] - c.offsets[0].as_py())][:len(column)]


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 2400, bits: int = 17, **how) -> Classifier:
    """The model of at most ``sample`` labelled rows that are not held out."""
    own = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    turn, drawn = F.xxhash64("doc_id"), []
    size = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}  # two rows
    for k in (0, 1):  # about as many by hash, wherever they lie, then at most as many
        share = min(1.0, 1.5 * (sample // 2) / max(1, size.get(k, 0)))
        some = own.where((F.col("label") == k) & (F.pmod(turn, F.lit(1 << 30)) <= int(share * (1 << 30))))
        drawn.append(some.orderBy(turn, "doc_id").limit(sample // 2))
    drawn = F.broadcast(drawn[0].unionByName(drawn[1]).withColumnRenamed("doc_id", "_id"))  # sample rows of two numbers at most
    docs = documents.select("doc_id", "text")
    rows = docs.join(drawn, docs["doc_id"] == drawn["_id"]).select("label", "text").mapInArrow(counted(bits), "label int, rows array<int>, counts array<int>")
    got = rows.limit(2 * sample).toArrow()  # repeated ids could bring more
    rows, counts = (_arrays(got[c]) for c in ("rows", "counts"))
    y = got["label"].to_numpy().astype(np.int64)
    order = sorted(range(len(y)), key=lambda i: (y[i], len(rows[i]), rows[i].tobytes(), counts[i].tobytes()))  # whatever order the tasks end in
    return fit([rows[i] for i in order], [counts[i] for i in order], y[order] if len(y) else y, bits, **how)


def scored(weights: np.ndarray, bias: float, bits: int):
    """Arrow batches with a column text, with the column score beside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for _, some in parts(binary(b["text"]), SMALL_PART):
                total, n = np.zeros(len(some)), np.zeros(len(some))
                for row, which in features(some, bits):
                    total += np.bincount(which, weights=weights[row], minlength=len(some))
                    n += np.bincount(which, minlength=len(some))
                out.append(1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + bias, -500, 500))))
            names = b.schema.names
            if out:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(out))], names=[*names, "score"])

    return run


def with_scores(docs: DataFrame, model: Classifier) -> DataFrame:
    """``docs``, which has a column text and none named score, and the score."""
    weights, bias = model.weights()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", score double"
    return docs.mapInArrow(scored(weights, bias, len(weights).bit_length() - 1), schema)


def quality(documents: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each row of ``documents``."""
    out = with_scores(documents.select("doc_id", "text"), train(documents, labels, **how))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame, least: float = 0.5, **how) -> DataFrame:
    """``documents`` (all its columns) with a score of ``least`` or more."""
    model = train(documents, labels, **how)
    inside = documents.select(*[documents[c].alias(f"c{i}_{c}") if c != "text" else documents[c] for i, c in enumerate(documents.columns)])
    out = with_scores(inside, model).where(F.col("score") >= least)
    return out.select(*[F.col(f"c{i}_{c}").alias(c) if c != "text" else F.col(c) for i, c in enumerate(documents.columns)])


def op5_quality(spark, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
