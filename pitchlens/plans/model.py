"""Boosted-tree models (M1-M4, S14) and their grids.

Parameters by the source's own names are fitted by :mod:`boost`: one margin for
UO, one for each class and a softmax for EF and the result.  Any other estimator
of spark.ml, and ``GBTClassifier`` for parameters by its own names, is fitted
as it is: UO as one binary model, EF as three one-vs-rest models whose
probabilities are normalised to sum to 1.
"""

from __future__ import annotations

import json
import math
import random
import re
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.decide import argmax_first
from ..session import create_file, delete_path, list_names, path_exists, read_file, scratch_dir
from . import boost

# The original search grids (xgboost parameter names).
GRID_UO = {
    "learning_rate": [0.05, 0.1, 0.15, 0.20, 0.3],
    "n_estimators": [200, 300, 500, 700],
    "min_child_weight": [3, 5, 10, 15],
    "gamma": [0.3, 0.5, 0.7, 1, 1.5],
    "subsample": [0.4, 0.6, 0.8, 1.0],
    "colsample_bytree": [0.4, 0.6, 0.8, 1.0],
    "max_depth": [2, 3, 4, 5],
}
GRID_EF = {
    "learning_rate": [0.05, 0.1, 0.15, 0.20, 0.3],
    "n_estimators": [200, 300, 500, 700, 1000, 1200],
    "min_child_weight": [3, 5, 10, 13, 15],
    "gamma": [0.3, 0.5, 0.7, 1, 1.5],
    "subsample": [0.4, 0.6, 0.8, 1.0],
    "colsample_bytree": [0.4, 0.6, 0.8, 1.0],
    "max_depth": [2, 3, 4, 5],
}
# Fixed value: trees of the original result model; its other parameters are its library's defaults.
RESULT_PARAMS = {"n_estimators": 2000}
SEED = 12
#: Rows that one task of a spark.ml fit takes, whatever the files of the table hold.
FIT_ROWS = 1 << 18
EF_CLASSES = [1, 2, 3]
LABELS = {"uo": ("final_uo", [0, 1]), "ef": ("final_ef", EF_CLASSES), "result": ("result", EF_CLASSES)}


def gbt_params(p: dict) -> dict:
    """xgboost names -> nearest GBTClassifier params."""
    out = {}
    if "learning_rate" in p:
        out["stepSize"] = float(p["learning_rate"])
    if "n_estimators" in p:
        out["maxIter"] = int(p["n_estimators"])
    if "max_depth" in p:
        out["maxDepth"] = int(p["max_depth"])
    if "subsample" in p:
        out["subsamplingRate"] = float(p["subsample"])
    if "min_child_weight" in p:
        out["minInstancesPerNode"] = int(p["min_child_weight"])
    if "gamma" in p:
        out["minInfoGain"] = float(p["gamma"]) / 100.0
    if "colsample_bytree" in p:
        c = float(p["colsample_bytree"])
        out["featureSubsetStrategy"] = "all" if c >= 1.0 else str(c)
    return out


@dataclass
class Boosted:
    """Trees of each margin, and the cuts between the bins of each feature."""
    cuts: list[np.ndarray]
    trees: list[boost.Trees]


@dataclass
class Model:
    task: str
    features: list[str]
    models: list[PipelineModel | Boosted] = field(default_factory=list)


def by_source_names(params: dict | None) -> bool:
    return bool(params) and set(params) <= set(boost.DEFAULTS)


def _pipeline(features: list[str], label: str, params: dict, estimator=None) -> Pipeline:
    """Assembler + classifier.  ``estimator`` (H3) is any spark.ml probabilistic
    classifier; ``params`` are set on a copy of it by name.  Default: GBT."""
    va = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip")
    if estimator is None:
        clf = GBTClassifier(featuresCol="features", labelCol=label, seed=SEED, **params)
    else:
        extra = {estimator.getParam(k): v for k, v in params.items()}
        extra[estimator.getParam("featuresCol")] = "features"
        extra[estimator.getParam("labelCol")] = label
        clf = estimator.copy(extra)
    return Pipeline(stages=[va, clf])


def dealt(data: DataFrame) -> tuple[DataFrame, int]:
    """``data`` in partitions of ``FIT_ROWS`` rows at most, and their number; 1, left as it is, if one holds all."""
    n = -(-data.count() // FIT_ROWS)
    return (data.repartition(n), n) if n > 1 else (data, 1)


def fit(train: DataFrame, features: list[str], task: str = "uo", params: dict | None = None,
        estimator=None, path: str | None = None) -> Model:
    """M1 / M2 / M3.

    Parameters by the source's names: boosting in blocks below ``path``, a folder
    in which a stopped fit goes on; without one, a new folder of the session.

    Others: rows are dealt to tasks of ``FIT_ROWS`` at most, because a file of well
    compressed rows is large in memory, and persisted once, so no pass recomputes the
    preparation.  EF: the three one-vs-rest labels are added to one table; the three fits
    are submitted concurrently (as ``CrossValidator`` does with ``parallelism``), so their
    many small tree-level jobs share the cluster.  Fits whose passes have tasks for all
    cores follow one another, so one copy of the rows is held at a time.
    """
    params = params or (dict(boost.DEFAULTS) if estimator is None else {})
    if estimator is None and by_source_names(params):
        label, classes = LABELS[task]
        at = path or scratch_dir(train.sparkSession, "boost")
        trees, cuts = boost.boost(train, features, label, classes, [boost.Fit(0, params)], at, seed=SEED)
        if path is None:
            delete_path(train.sparkSession, at)
        return Model(task, features, [Boosted(cuts.get(0, [np.empty(0)] * len(features)), [trees[0, k] for k in range(len(trees))])])
    if task == "uo":
        labels = {"__y": F.col("final_uo").cast("double")}
    else:
        label = "final_ef" if "final_ef" in train.columns else "result"
        labels = {f"__y{k}": (F.col(label) == k).cast("double") for k in EF_CLASSES}
    data, n = dealt(train.select(*features, *[c.alias(name) for name, c in labels.items()]))
    data = data.persist()
    at_once = 1 if n > train.sparkSession.sparkContext.defaultParallelism else len(labels)
    try:
        with ThreadPoolExecutor(max_workers=at_once) as pool:
            models = list(pool.map(lambda name: _pipeline(features, name, params, estimator).fit(data), labels))
    finally:
        data.unpersist()
    return Model(task, features, models)


def _keeping(m: PipelineModel) -> PipelineModel:
    """The model with an assembler that passes missing features on as NaN: a tree sends
    them down its right branch, so every row gets a prediction."""
    return PipelineModel([m.stages[0].copy().setHandleInvalid("keep"), *m.stages[1:]])


def _positive(df: DataFrame, m: PipelineModel, name: str, keep: list[str]) -> DataFrame:
    out = _keeping(m).transform(df)
    return out.select(*keep, vector_to_array("probability")[1].alias(name))


def score(model: Model, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """M4: UO adds ``prediction`` and ``probability_over``; EF adds the three
    class probabilities (normalised), ``probability`` = max and ``prediction``.

    Rows with a missing feature are scored too; fitting leaves them out.
    """
    keep = keep or [c for c in df.columns]
    if isinstance(model.models[0], Boosted):
        m = model.models[0]
        names = [f"__margin{k}" for k in range(len(m.trees))]
        return from_margins(boost.with_margins(df, model.features, [(m.cuts, m.trees)], names), names, keep, model.task)
    if model.task == "uo":
        out = _positive(df, model.models[0], "probability_over", keep)
        return out.withColumn("prediction", (F.col("probability_over") > 0.5).cast("int"))
    # one pass per class model over the same rows, then a per-row combination
    names = ["p1", "pX", "p2"]
    out = df
    for m, n in zip(model.models, names):
        out = _keeping(m).transform(out).withColumn(n, vector_to_array("probability")[1]).drop(
            "features", "rawPrediction", "probability", "prediction")
    total = F.col("p1") + F.col("pX") + F.col("p2")
    out = out.select(*keep, (F.col("p1") / total).alias("probability_1"),
                     (F.col("pX") / total).alias("probability_X"),
                     (F.col("p2") / total).alias("probability_2"))
    probs = [F.col("probability_1"), F.col("probability_X"), F.col("probability_2")]
    return out.withColumns({"probability": F.greatest(*probs),
                            "prediction": argmax_first(probs) + 1})


def from_margins(df: DataFrame, names: list[str], keep: list[str], task: str) -> DataFrame:
    """Probabilities and the likeliest class from the margins in ``names``."""
    if task == "uo":
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), F.col(names[0])))))
        return df.select(*keep, p.alias("probability_over")).withColumn("prediction", (F.col("probability_over") > 0.5).cast("int"))
    top = F.greatest(*names)
    parts = [F.exp(F.col(n) - top) for n in names]
    total = parts[0] + parts[1] + parts[2]
    out = df.select(*keep, *[(p / total).alias(f"probability_{c}") for p, c in zip(parts, "1X2")])
    probs = [F.col(f"probability_{c}") for c in "1X2"]
    return out.withColumns({"probability": F.greatest(*probs), "prediction": argmax_first(probs) + 1})


def save(model: Model, path: str) -> None:
    """One PipelineModel per class, or all trees, under ``path``."""
    if isinstance(model.models[0], Boosted):
        spark, m = SparkSession.getActiveSession(), model.models[0]
        boost.save_trees(spark, {(0, k): t for k, t in enumerate(m.trees)}, f"{path}/trees")
        spark.createDataFrame([([c.tolist() for c in m.cuts],)], "cuts array<array<double>>").coalesce(1).write.mode("overwrite").parquet(f"{path}/cuts")
        return
    for i, m in enumerate(model.models):
        m.write().overwrite().save(f"{path}/m{i}")


def load(path: str, task: str, features: list[str]) -> Model:
    """The model below ``path``, the newest one if models were published there."""
    spark = SparkSession.getActiveSession()
    path = (newest(spark, path)[1] or {"model": path})["model"]
    if path_exists(spark, f"{path}/trees"):
        trees = boost.load_trees(spark, f"{path}/trees")
        cuts = spark.read.parquet(f"{path}/cuts").first()["cuts"]
        return Model(task, features, [Boosted([np.array(c, np.float64) for c in cuts], [trees[0, k] for k in range(len(trees))])])
    n = 1 if task == "uo" else len(EF_CLASSES)
    return Model(task, features, [PipelineModel.load(f"{path}/m{i}") for i in range(n)])


def newest(spark: SparkSession, path: str) -> tuple[int, dict | None]:
    """The number and record of the last model published below ``path``; 0 and None before the first."""
    numbers = [n for n in list_names(spark, f"{path}/commits") if re.fullmatch(r"\d{9}", n)]
    return (int(numbers[-1]), json.loads(read_file(spark, f"{path}/commits/{numbers[-1]}"))) if numbers else (0, None)


def publish(model: Model, path: str, record: dict, wins: Callable[[dict | None], bool] = lambda current: True) -> bool:
    """Save the model as a version of its own, then make it the newest one, in this order.

    A reader sees the model before or this one, never a part; after a crash in
    between, the model before stands.  ``wins`` is asked about the record that
    stands; of two writers one makes the next record, and the other asks again.
    """
    spark = SparkSession.getActiveSession()
    version = f"{path}/versions/{uuid.uuid4().hex[:12]}"
    save(model, version)
    while True:
        number, current = newest(spark, path)
        if not wins(current):
            delete_path(spark, version)
            return False
        if create_file(spark, f"{path}/commits/{number + 1:09d}", json.dumps({**record, "model": version})):
            return True


def feature_importance(model: Model) -> list[tuple[str, float]]:
    """The share of the splits on each feature; of spark.ml's trees, their own figure."""
    if isinstance(model.models[0], Boosted):
        n = sum(np.bincount(t.feature[t.cut < boost.BINS], minlength=len(model.features)) for t in model.models[0].trees)
        return list(zip(model.features, (n / max(1, n.sum())).tolist()))
    imp = [0.0] * len(model.features)
    for m in model.models:
        v = m.stages[-1].featureImportances.toArray()
        for i, x in enumerate(v):
            imp[i] += float(x) / len(model.models)
    return list(zip(model.features, imp))


def sample_grid(grid: dict, trials: int, seed: int = SEED) -> list[dict]:
    """``trials`` distinct combinations drawn once with one seed
    (decision D17), by index into the cross product (never materialised)."""
    keys = list(grid)
    sizes = [len(grid[k]) for k in keys]
    total = 1
    for s in sizes:
        total *= s
    idx = random.Random(seed).sample(range(total), min(trials, total))
    out = []
    for i in idx:
        combo = {}
        for k, s in zip(reversed(keys), reversed(sizes)):
            combo[k] = grid[k][i % s]
            i //= s
        out.append({k: combo[k] for k in keys})
    return out


def grid_size(grid: dict) -> int:
    return math.prod(len(v) for v in grid.values())


__all__ = ["fit", "score", "save", "load", "sample_grid", "grid_size", "gbt_params",
           "feature_importance", "Model"]
