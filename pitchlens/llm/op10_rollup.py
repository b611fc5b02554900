"""Token counts as delta-maintained rollups.

A store is a folder with one folder a committed batch.  A batch holds signed
changes of additive totals by source, language and tokenizer version: inserts
add a document's counts, deletes take them back, and a revised count is a
delete of the old and an insert of the new one.  They are added up before they
are written, so a batch has a few rows a key whatever the number of documents.

A batch is written to a folder of its own try and then takes the batch's name
in one rename, which only one try can do; a batch whose name is there is not
applied again.  A task that runs twice, a driver that dies, or a job that is
repeated therefore never counts anything twice.  Totals are the sums over all
batches; :func:`compact` adds old batches up into one row a key and keeps their names.

Defined results: null text has no tokens, bytes or words; null source or
language is a key of its own; repeated rows count as often as they stand there;
keys whose documents all went stay, with zeros, until ``live`` drops them; an
empty batch is a batch; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlens.llm._text import id_key, read
from pitchlens.llm.words import binary, parts, word_hashes
from pitchlens.session import scratch_dir

KEYS = ["source", "lang", "version"]
TOTALS = ["docs", "tokens", "bytes"]
BATCH = ", ".join(f"{k} string" for k in KEYS) + ", " + ", ".join(f"{t} long" for t in TOTALS)


# -- counting

def rank_file(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def _encoding(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def bpe_version(path: str | None = None):
    """Counts by a public byte-level vocabulary; the path is that of its rank file."""
    path = path or rank_file()

    def count(texts: list[bytes]) -> np.ndarray:
        return np.array([len(_encoding(path).encode_ordinary(t.decode())) for t in texts], np.int64)

    return count


def words_version(texts: list[bytes]) -> np.ndarray:
    """Stretches between ASCII white space."""
    return word_hashes(texts)[1].astype(np.int64) if texts else np.zeros(0, np.int64)


def token_counts(documents: DataFrame, versions: dict) -> DataFrame:
    """id, tk, source, lang, version, tokens, bytes: a row for each row of ``documents`` and version (name: function of texts)."""
    rows = documents.select(id_key(F.col("doc_id").cast("long")).alias("id"), F.xxhash64("text").alias("tk"), "source", "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = binary(b["text"])
            size = pa.array([len(t or b"") for t in texts], pa.int64())
            for name, count in versions.items():
                found = [count(some) for _, some in parts(texts)]
                n = pa.array(np.concatenate(found) if found else np.zeros(0, np.int64), pa.int64())
                yield pa.RecordBatch.from_arrays([b["id"], b["tk"], b["source"], b["lang"], pa.array([name] * len(texts), pa.string()), n, size],
                                                 names=["id", "tk", "source", "lang", "version", "tokens", "bytes"])

    return rows.mapInArrow(run, "id long, tk long, source string, lang string, version string, tokens long, bytes long")


# -- signed changes

def _signed(counts: DataFrame, sign: int) -> DataFrame:
    return counts.select(*KEYS, F.lit(sign).cast("long").alias("docs"), (sign * F.col("tokens")).alias("tokens"), (sign * F.col("bytes")).alias("bytes"))


def inserts(counts: DataFrame) -> DataFrame:
    return _signed(counts, 1)


def deletes(counts: DataFrame) -> DataFrame:
    return _signed(counts, -1)


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    return deletes(old).unionByName(inserts(new))


# -- the store

class Rollup:
    """The store in folder ``path``, which every executor can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def batches(self) -> list[str]:
        if not self._fs.exists(self._at(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(self.path))]
        merged = {n for m in names if m.startswith("merged=") for n in self._names(f"{self.path}/{m}/names")}
        return sorted(merged | {n.removeprefix("batch=") for n in names if n.startswith("batch=")})

    def _names(self, path: str) -> list[str]:
        return [r["name"] for r in self.spark.read.schema("name string").parquet(path).collect()]  # a row a batch

    def commit(self, name: str, changes: DataFrame) -> bool:
        """Apply the signed ``changes`` as batch ``name``; False, and nothing done, if it is applied already."""
        if not name or not all(c.isalnum() or c in "-_" for c in name):
            raise ValueError(f"not a batch name: {name!r}")
        if name in self.batches():
            return False
        tried = f"{self.path}/_try-{name}-{uuid.uuid4().hex}"
        added = changes.groupBy(*KEYS).agg(*[F.sum(t).alias(t) for t in TOTALS])
        added.write.parquet(tried)
        if not self._take(tried, f"{self.path}/batch={name}"):
            return False
        if name in self._snapshot()[2]:  # another try was merged, and its folder deleted, meanwhile
            self._fs.delete(self._at(f"{self.path}/batch={name}"), True)
            return False
        return True

    def _take(self, tried: str, wanted: str) -> bool:
        """Rename a folder; False, and the folder deleted, if the name is taken, by whoever was first."""
        self._fs.mkdirs(self._at(self.path))
        done = self._at(wanted)
        if self._fs.exists(done) or not self._fs.rename(self._at(tried), done):
            self._fs.delete(self._at(tried), True)
            return False
        inside = self._at(f"{done.toString()}/{self._at(tried).getName()}")
        if self._fs.exists(inside):  # another was first: a rename goes into a folder that is there
            self._fs.delete(inside, True)
            return False
        return True

    def _snapshot(self) -> tuple[str | None, list[str], set[str]]:
        """From one listing: the last merge, the batches that it lacks, and those that it holds."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(self.path))] if self._fs.exists(self._at(self.path)) else []
        merged = max((n for n in names if n.startswith("merged=")), default=None)  # the last one holds the earlier ones
        held = set(self._names(f"{self.path}/{merged}/names")) if merged else set()
        return merged, sorted({n.removeprefix("batch=") for n in names if n.startswith("batch=")} - held), held

    def _parts(self, merged: str | None, batches: list[str]) -> list[str]:
        return [f"{self.path}/{merged}/rows"] * (merged is not None) + [f"{self.path}/batch={n}" for n in batches]

    def totals(self, live: bool = False) -> DataFrame:
        """source, lang, version, docs, tokens, bytes over all batches; ``live``: only keys that still have documents."""
        merged, batches, _ = self._snapshot()
        out = self._sums(self._parts(merged, batches))
        return out.where("docs <> 0") if live else out

    def _sums(self, parts: list[str]) -> DataFrame:
        rows = self.spark.read.schema(BATCH).parquet(*parts) if parts else self.spark.createDataFrame([], BATCH)
        return rows.groupBy(*KEYS).agg(*[F.sum(t).alias(t) for t in TOTALS])

    def compact(self) -> bool:
        """The last merge and all batches since as one row a key; totals stay what they are at every moment.

        Rows and names come from one listing, and the next merge's name from the
        merge that it is built on: of two writers who build on the same one only
        one gets the name, and the other's work is dropped.  Only batches that the
        merge holds are deleted, so one committed meanwhile stays and counts.
        """
        merged, batches, held = self._snapshot()
        if not batches:
            return False
        tried = f"{self.path}/_try-merged-{uuid.uuid4().hex}"
        self._sums(self._parts(merged, batches)).write.parquet(f"{tried}/rows")
        self.spark.createDataFrame([(n,) for n in sorted(held | set(batches))], "name string").coalesce(1).write.parquet(f"{tried}/names")
        number = int(merged.removeprefix("merged=")) + 1 if merged else 0
        if not self._take(tried, f"{self.path}/merged={number:09d}"):
            return False
        for n in batches:
            self._fs.delete(self._at(f"{self.path}/batch={n}"), True)
        return True


def later_copies(counts: DataFrame) -> DataFrame:
    """Rows whose text stands in a row with a smaller id too."""
    firsts = counts.groupBy("tk", "bytes", "version").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    firsts = firsts.select(F.col("tk").alias("_tk"), F.col("bytes").alias("_bytes"), F.col("version").alias("_version"), "first")
    same = (F.col("tk") == F.col("_tk")) & (F.col("bytes") == F.col("_bytes")) & (F.col("version") == F.col("_version"))
    return counts.join(firsts, same).where(F.col("id") > F.col("first")).select(counts.columns)


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    """Totals of all documents, by a byte-level vocabulary and by words, after the texts' later copies have gone again.

    Three batches: all rows are inserted, later copies deleted, and the first
    batch is tried once more, to no effect.
    """
    from pitchlens.session import materialize

    counts = materialize(token_counts(read(spark, sf_dir, "documents"), {"byte_bpe_50k": bpe_version(), "words": words_version}), "counts")
    store = Rollup(spark, scratch_dir(spark, "rollup"))
    store.commit("ingest", inserts(counts))
    store.commit("copies", deletes(later_copies(counts)))
    store.commit("ingest", inserts(counts))
    return store.totals()
