"""Toxicity: two Kneser-Ney models, one of toxic and one of ordinary texts, and the ratio of their likelihoods.

Both are models of the symbols of a text (:mod:`kneser_ney`), so a toxic
stem is known by its letters under endings that were never seen.  The highest
orders belong to a class; the lowest ones are counts that both classes share,
which smooth what is rare in either.  A symbol's log ratio counts as far as it
goes beyond ``noise``: what is less shows how languages and topics are mixed in
the labelled rows.  A document's log ratio is the sum over its symbols divided
by their number plus ``slack``: a few words alone are no evidence.  A logistic curve through labelled rows that were not counted makes
it a score.

Training takes at most ``sample`` labelled rows, a bound on labelled rows, as
many for either label where there are (and at most half as many again of the
commoner); four of five are counted, the fifth sets the curve.  Spark counts
n-grams; the driver gets at most one row for each possible one, whatever the
corpus, and the curve is fitted to counts by steps of the ratio.  Scoring reads
whole texts where they lie, without any shuffle.

Defined results: null, empty and blank texts have no symbol and get the score of
a ratio of 0; a row with a null ``doc_id`` is held out and never learned from;
of several labels of an id the smallest counts; labels other than 0 and 1 are
no labels; without labels of both kinds every score is the share of label 1 (0
if there are none); repeated rows are returned as often as they stand there; an
empty table gives an empty table; extra columns are ignored or, by
:func:`drop_toxic`, kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlens.llm import kneser_ney as kn
from pitchlens.llm._text import read
from pitchlens.llm.op5_quality import held_out
from pitchlens.llm.words import binary, parts

#: A document is called toxic from this score on.
LEAST = 0.7
#: Steps of the log ratio in which the curve's rows are counted, and how far they go.
STEP, FAR = 0.0005, 4000


@dataclass
class Model:
    levels: list[kn.Level] = field(default_factory=list)
    slope: float = 0.0
    bias: float = 0.0
    noise: float = 2.0
    slack: float = 200.0


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (label, text) to (gram, n0, n1), one row for each n-gram and label of about a MB of text."""
    for b in batches:
        labels = b["label"].to_pylist()
        for at, texts in parts(binary(b["text"])):
            for label in (0, 1):
                some = [g for k, text in zip(labels[at:], texts, strict=False) if k == label for g in kn.grams(kn.symbols(text))]
                if some:
                    grams, n = np.unique(np.concatenate(some), return_counts=True)
                    none = np.zeros(len(n), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(none if label else n), pa.array(n if label else none)], names=["gram", "n0", "n1"])


def with_ratio(docs: DataFrame, model: Model) -> DataFrame:
    """``docs``, which has a column text and none named log_ratio, and the length-normalised log ratio."""
    levels, noise, slack = model.levels, model.noise, model.slack

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = kn.table(levels) if levels else np.zeros(kn.SYMBOLS**kn.ORDER, np.float32)
        whole -= np.clip(whole, -noise, noise)
        for b in batches:
            found = (kn.log_ratio(text, whole) for text in binary(b["text"]))
            out = pa.array([total / (n + slack) for total, n in found], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, out], names=[*b.schema.names, "log_ratio"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", log_ratio double"
    return docs.mapInArrow(run, schema)


def curve(ratio: np.ndarray, label: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and bias of the logistic curve through ``n`` rows of each (ratio, label), both labels weighing the same."""
    weight = n * np.where(label == 1, 0.5 / n[label == 1].sum(), 0.5 / n[label == 0].sum()) * n.sum()
    spread = max(float(np.sqrt(np.average(ratio**2, weights=weight))), 1e-9)
    x, at = np.stack([ratio / spread, np.ones(len(ratio))], 1), np.zeros(2)
    for _ in range(100):  # Newton's method with short steps and a little pull to a flat curve
        p = 1 / (1 + np.exp(-np.clip(x @ at, -500, 500)))
        down = x.T @ (weight * (p - label)) + 1e-2 * np.array([at[0], 0])
        bend = (x.T * (weight * p * (1 - p) + 1e-9)) @ x + np.diag([1e-2, 1e-9])
        step = np.clip(np.linalg.solve(bend, down), -2, 2)
        at = at - step
        if abs(step).max() < 1e-9:
            break
    return float(at[0] / spread), float(at[1])


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = 8000, shared: int = 2, discount: float = 0.75, noise: float = 2.0, slack: float = 200.0) -> Model:
    """The models of at most ``sample`` labelled rows that are not held out."""
    own = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    size = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}  # two rows
    if len(size) < 2:
        return Model(bias=500.0 if size.get(1) else -500.0)
    turn, drawn = F.xxhash64("doc_id"), []
    for k in (0, 1):
        most = min(sample // 2, int(1.5 * min(size.values())) + 1)
        share = min(1.0, 1.5 * most / size[k])  # about as many by hash, wherever they lie, then at most as many
        some = own.where((F.col("label") == k) & (F.pmod(turn, F.lit(1 << 30)) <= int(share * (1 << 30))))
        drawn.append(some.orderBy(turn, "doc_id").limit(most))
    drawn = F.broadcast(drawn[0].unionByName(drawn[1]).select(F.col("doc_id").alias("_id"), "label", (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(15)) < 3).alias("apart")))  # sample rows of two numbers at most
    docs = documents.select("doc_id", "text")
    rows = docs.join(drawn, docs["doc_id"] == drawn["_id"])
    found = rows.where("not apart").select("label", "text").mapInArrow(counted, "gram long, n0 long, n1 long")
    found = found.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()  # at most SYMBOLS ** ORDER rows
    grams = found["gram"].to_numpy()
    order = np.argsort(grams)
    levels = kn.ratios(grams[order], np.stack([found[c].to_numpy()[order] for c in ("n0", "n1")]), shared, discount) if len(grams) else []
    model = Model(levels, noise=noise, slack=slack)
    steps = F.greatest(F.least(F.round(F.col("log_ratio") / STEP), F.lit(FAR)), F.lit(-FAR)).cast("int").alias("step")
    for some in (rows.where("apart"), rows):  # a small set may leave one label without rows apart
        at = with_ratio(some.select("label", "text"), model).groupBy("label", steps).count().collect()  # 2 * FAR + 1 steps of two labels at most
        if len({r["label"] for r in at}) == 2:
            model.slope, model.bias = curve(np.array([r["step"] * STEP for r in at]), np.array([r["label"] for r in at]), np.array([r["count"] for r in at], np.float64))
            return model
    model.bias = 500.0 if at and at[0]["label"] else -500.0
    return model


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (a column text, none named log_ratio or score) with both."""
    z = F.greatest(F.least(F.col("log_ratio") * model.slope + model.bias, F.lit(500.0)), F.lit(-500.0))
    return with_ratio(docs, model).withColumn("score", 1 / (1 + F.exp(-z)))


def toxicity(documents: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, log_ratio, score, predicted: a row for each row of ``documents``."""
    out = with_scores(documents.select("doc_id", "text"), train(documents, labels, **how))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "log_ratio", "score", (F.col("score") >= LEAST).cast("int").alias("predicted"))


def drop_toxic(documents: DataFrame, labels: DataFrame, least: float = LEAST, **how) -> DataFrame:
    """``documents`` (all its columns) with a score below ``least``."""
    model = train(documents, labels, **how)
    inside = documents.select(*[documents[c].alias(f"c{i}_{c}") if c != "text" else documents[c] for i, c in enumerate(documents.columns)])
    out = with_scores(inside, model).where(F.col("score") < least)
    return out.select(*[F.col(f"c{i}_{c}").alias(c) if c != "text" else F.col(c) for i, c in enumerate(documents.columns)])


def op11_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
