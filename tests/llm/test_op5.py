"""The quality classifier: held-out accuracy, scores against single texts, and odd rows."""

import zlib

import numpy as np
import pyarrow as pa

from pitchlens.llm import op5_quality
from pitchlens.llm._text import read

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = op5_quality.op5_quality(spark, SF).join(read(spark, SF, "labels"), "doc_id").where("held_out").toPandas()
    assert len(got) > 100 and (got["predicted"] == got["quality"]).mean() > 0.97
    assert all((zlib.crc32(str(i).encode()) % 3 == 1) for i in got["doc_id"])


def test_features_of_a_text_do_not_depend_on_its_neighbours():
    texts = [b"one two", b"", b" \n ", "é a a a".encode(), b"x"]
    together = [[] for _ in texts]
    for rows, which in op5_quality.features(texts, 12):
        for r, w in zip(rows, which, strict=True):
            together[w].append(r)
    for text, found in zip(texts, together, strict=True):
        alone = np.concatenate([r for r, _ in op5_quality.features([text], 12)])
        assert sorted(alone) == sorted(found)
    assert not together[1] and not together[2]


def test_odd_rows(spark):
    docs = [(i, ("good words here " if i % 2 else "!! ## !! ") * (1 + i % 4), "s", 7) for i in range(80)] + [(None, "good", "s", 7), (200, None, "s", 7), (201, "", "s", 7), (5, "again", "s", 7)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, source string, score int")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (3, None, 0), (61, 5, 0)], "doc_id long, quality int, toxic int")
    got = op5_quality.quality(docs, labels, bits=10).collect()
    assert len(got) == 84 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert all(r["predicted"] == r["doc_id"] % 2 for r in got if r["doc_id"] is not None and r["doc_id"] < 80)
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [True]
    kept = op5_quality.keep_good(docs, labels, bits=10)
    assert kept.columns == docs.columns and {r["score"] for r in kept.collect()} == {7}
    one = op5_quality.quality(docs, labels.where("quality = 1"), bits=10)
    assert {r["predicted"] for r in one.collect()} == {1}
    assert op5_quality.quality(docs.where("false"), labels.where("false"), bits=10).count() == 0


def test_scoring_holds_little_at_a_time():
    import tracemalloc

    r = np.random.default_rng(3)
    texts = [" ".join("".join(map(chr, r.integers(97, 123, 6))) for _ in range(400)) for _ in range(800)]
    weights, b = r.normal(size=1 << 10), pa.RecordBatch.from_pydict({"text": texts})
    tracemalloc.start()
    try:
        together = next(op5_quality.scored(weights, 0.1, 10)(iter([b])))["score"].to_pylist()
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 30 << 20  # over 50 MB when a million bytes were worked on at once
    for i in (0, 399, 799):
        alone = next(op5_quality.scored(weights, 0.1, 10)(iter([b.slice(i, 1)])))["score"].to_pylist()
        assert abs(alone[0] - together[i]) < 1e-12
