"""Each stage of the pipeline against a plain version on its own input, and the whole run."""

import re
from collections import defaultdict

import pytest
from test_op4 import brute as near_brute

import corpus_pipeline as cp
from pitchlens.llm import op5_quality
from pitchlens.llm._text import read
from pitchlens.session import materialize

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


def lines_brute(rows):
    held = defaultdict(set)
    key = lambda line: low(line.strip(" \t\n\r\x0b\x0c"))
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                held[key(line)].add(i)
    gone = lambda i, line: len(held[key(line)]) >= 5 and i != max(held[key(line)])
    return {i: "\n".join(x for x in (t or "").split("\n") if not gone(i, x)) for i, t in rows}


def contaminated(rows, items):
    wins = defaultdict(set)
    for item in items:
        w = WORD.findall(low(item))
        n = min(13, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            wins[n].add(tuple(w[p:p + n]))
    out = set()
    for i, t in rows:
        w, hit = WORD.findall(low(t)), set()
        for n, some in wins.items():
            for p in range(len(w) - n + 1):
                if tuple(w[p:p + n]) in some:
                    hit.update(range(p, p + n))
        if hit and 20 * len(hit) >= len(w):
            out.add(i)
    return out


@pytest.fixture(scope="module")
def stages(spark, sf):
    """The rows before the first stage and after each."""
    docs = read(spark, sf, "documents").select(cp.COLUMNS)
    out = [docs]
    for name, stage in cp.STAGES:
        out.append(materialize(stage(spark, out[-1], sf), name))
    return [[tuple(r) for r in df.collect()] for df in out], [df.columns for df in out]


def test_names_and_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "packing"]
    assert all(c == cp.COLUMNS for c in stages[1][:-1])


def test_quality(spark, sf, stages):
    scores = op5_quality.op5_quality(spark, sf).collect()
    assert {r[0] for r in stages[0][1]} == {r["doc_id"] for r in scores if r["predicted"] == 1}
    labels = {r["doc_id"]: r["quality"] for r in read(spark, sf, "labels").collect()}
    kept = {r[0] for r in stages[0][1]}
    wrong = [i for i, q in labels.items() if (i in kept) != bool(q)]
    assert len(wrong) <= 0.05 * len(labels)


def test_lines(stages):
    want = lines_brute([r[:2] for r in stages[0][1]])
    assert {r[0]: r[1] for r in stages[0][2]} == want
    assert all(r[4] == len(r[1]) for r in stages[0][2])


def test_near(stages):
    rows = [r[:2] for r in stages[0][2]]
    assert {r[0] for r in stages[0][3]} == {i for i, _, _, kept in near_brute(rows, 5, 4, 5) if kept}


def test_benchmark(spark, sf, stages):
    items = [r["text"] for r in read(spark, sf, "benchmark").collect()]
    rows = [r[:2] for r in stages[0][3]]
    gone = contaminated(rows, items)
    assert {r[0] for r in stages[0][4]} == {i for i, _ in rows} - gone


def test_run(spark, sf, stages):
    got = sorted(tuple(r)[:5] for r in cp.run(spark, sf).collect())
    assert got == sorted(r[:5] for r in stages[0][5])
    assert {r[0] for r in got} == {r[0] for r in stages[0][4]}


def test_odd_rows(spark):
    """Nulls, empty texts, repeated rows and an empty table through every stage that takes documents."""
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", "s", 0), (2, "a b", "en", "s", 3), (2, "a b", "en", "s", 3), (3, "", "en", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sf = "/root/testdata/sf0.001"
    for _, stage in cp.STAGES:
        assert stage(spark, docs.where("false"), sf).count() == 0
    assert cp.line_dedup(spark, docs, sf).count() == 6
    assert cp.decontaminate(spark, docs, sf).count() == 6
    assert sorted(map(str, {r["doc_id"] for r in cp.near_dedup(spark, docs, sf).collect()})) == ["1", "2", "3", "None"]
    assert cp.packing(spark, docs, sf).count() == 6
