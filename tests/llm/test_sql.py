"""Operators that SQL can express against their SQL: on the test tables and on odd rows."""

import textwrap

import duckdb
import pyarrow as pa
import pytest

from pitchlens.llm import op1_licenses, op3_lines, op9_decontaminate, registry
from pitchlens.llm.licenses import RULES, SENTENCES, dictionary, normal

LONG = "This line is more than forty characters long, é."
DOCS = [
    (1, LONG + "\n" + LONG.upper() + "\nshort"), (2, " \t" + LONG.replace("T", "t") + "\x0b"), (3, LONG), (4, "x\n" + LONG), (5, LONG + "\n"), (6, "\n" + LONG), (6, "\n" + LONG), (7, None), (8, ""), (9, "\n\n"),
    (None, LONG + "\nof nobody"), (10, "É" * 40), (11, "é" * 40), (12, "É" * 40 + "\r"), (13, "É" * 39), (14, "É" * 40), (15, "É" * 40), (16, "É" * 40 + " "),
    (20, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (21, "x ONE, two three four; five six seven eight nine ten eleven twelve thirteen y z"),
    (22, "short item"), (23, "a Short  ITEM b short item"), (24, "w " * 100 + "short item"), (25, "ab\x00cd1 2é3 ü"), (26, "filler " * 5000 + "short item"),
    (30, "Copyright (c) 2020 A. Person\nLicensed under the Apache License, Version 2.0.\nx"), (31, "SPDX-License-Identifier: GPL-2.0-only. Released under the MIT License. All rights reserved."),
    (32, "\n".join(s[0] for k, s in SENTENCES.items() if k.startswith("MIT_") and k != "MIT_SHORT")), (33, "LICENSED UNDER THE APACHE LICENSE -- VERSION 2.0!\nLicensed under CC BY-NC 4.0."),
]
ITEMS = [(1, "One two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (2, "short item"), (10, "Short item!"), (3, None), (4, " ?"), (None, "two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (5, "2é3")]


def compare(got, con, sql):
    want = con.sql(sql).fetchall()
    names = [d[0] for d in con.sql(sql).description]
    assert sorted(names) == sorted(got.columns)
    assert sorted((tuple(r) for r in got.select(names).collect()), key=str) == sorted(want, key=str)


@pytest.fixture(scope="module")
def odd(spark):
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([d[0] for d in DOCS], pa.int64()), "text": pa.array([d[1] for d in DOCS])}))
    con.register("benchmark", pa.table({"item_id": pa.array([i[0] for i in ITEMS], pa.int64()), "text": pa.array([i[1] for i in ITEMS])}))
    docs = spark.createDataFrame([(*d, "w", 1, "k") for d in DOCS], "doc_id long, text string, word string, n_lines int, keep string").repartition(4)
    return con, docs, spark.createDataFrame([(*i, "x") for i in ITEMS], "item_id long, text string, win string")


def test_licenses(spark, odd, monkeypatch, tmp_path):
    con, docs, _ = odd
    monkeypatch.setattr(op1_licenses, "read", lambda *_: docs)
    compare(op1_licenses.op1_license_scan(spark, ""), con, op1_licenses.oracle())
    got = {r["doc_id"]: (list(r["identifiers"]), list(r["licences"])) for r in op1_licenses.scan(docs).collect()}
    assert got[30] == (["COPYRIGHT", "APACHE2_SHORT"], ["Apache-2.0"])
    assert got[31] == (["SPDX:gpl-2-0-only", "MIT_SHORT", "RIGHTS"], ["MIT", "proprietary", "gpl-2-0-only"])
    assert got[32][1] == ["MIT"] and len(got[32][0]) == 4
    assert got[33][1] == ["Apache-2.0", "CC-BY-NC-4.0"]
    assert got[7] == ([], [])
    assert op1_licenses.scan(docs.where("false")).count() == 0


NOTICES = {  # rules' sentences as the standard notices have them, in paragraphs
    "Apache-2.0": ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at', "http://www.apache.org/licenses/LICENSE-2.0", SENTENCES["APACHE2_ASIS"][0] + " " + SENTENCES["APACHE2_SEE"][0]],
    "MIT": [SENTENCES["MIT_GRANT"][0], SENTENCES["MIT_KEEP"][0], SENTENCES["MIT_ASIS"][0] + " " + SENTENCES["MIT_LIABLE"][0]],
    "BSD-3-Clause": [SENTENCES["BSD_GRANT"][0], "1. " + SENTENCES["BSD_SOURCE"][0], "2. " + SENTENCES["BSD_BINARY"][0], "3. " + SENTENCES["BSD_ENDORSE"][0]],
    "GPL-2.0-or-later": [SENTENCES["GPL2_FREE"][0], SENTENCES["GPL_HOPE"][0] + " " + SENTENCES["GPL_SEE"][0]],
    "GPL-3.0-or-later": [SENTENCES["GPL_FREE"][0], SENTENCES["GPL_HOPE"][0] + " " + SENTENCES["GPL_SEE"][0]],
    "MPL-2.0": [SENTENCES["MPL2_SHORT"][0] + " " + SENTENCES["MPL2_COPY"][0]],
}


def test_wrapped_licenses(spark):
    """Every rule's notice, and every sentence, wrapped at any width behind any comment signs."""
    cases = []
    for name, parts in [*NOTICES.items(), *[(name, [SENTENCES[i][0] for i in seq]) for name, seq in RULES]]:
        for width in (12, 20, 40, 72, 80, 5000):
            for sign in ("", "# ", " * ", "// ", ";; "):
                wrapped = [line for part in parts for line in (*textwrap.wrap(part, width, break_long_words=False, break_on_hyphens=False), "")]
                cases.append((name, "some code\n" + "\n".join(sign + line for line in wrapped) + "\r\nmore code"))
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: list(r["licences"]) for r in op1_licenses.scan(df).collect()}
    for i, (name, text) in enumerate(cases):
        assert got[i] == [name], text
    one = [(k, s) for k, some in SENTENCES.items() for s in some]
    df = spark.createDataFrame([(i, "\n".join(textwrap.wrap(s, 30, break_long_words=False))) for i, (_, s) in enumerate(one)], "doc_id long, text string")
    for r in op1_licenses.scan(df).collect():
        assert r["identifiers"] in ([one[r["doc_id"]][0]], ["APACHE2_NOTICE_A", "APACHE2_NOTICE_B"]), one[r["doc_id"]]
    part = spark.createDataFrame([(1, "Permission is hereby granted, free of\ncharge, to nobody."), (2, "we say mit license\nhere")], "doc_id long, text string")
    assert [list(r["identifiers"]) for r in op1_licenses.scan(part).collect()] == [[], []]


def test_license_tables():
    assert all(i in SENTENCES for _, seq in RULES for i in seq)
    assert len(dictionary()) == len({normal(s) for some in SENTENCES.values() for s in some})


def test_lines(spark, odd, monkeypatch):
    con, docs, _ = odd
    monkeypatch.setattr(op3_lines, "read", lambda *_: docs)
    compare(op3_lines.op3_line_dedup(spark, ""), con, op3_lines.ORACLE.replace("row_number() OVER () AS r, doc_id", "row_number() OVER () AS r, coalesce(doc_id, -1) AS doc_id").replace(
        "SELECT doc_id, count(*)", "SELECT nullif(doc_id, -1) AS doc_id, count(*)"))
    out = op3_lines.dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "word", "n_lines", "n_dropped"] and out.count() == len(DOCS)
    assert op3_lines.dedup_lines(docs.where("false")).count() == 0


def test_runs_over_many_partitions():
    """A hash over several partitions: inner runs are decided, the ends left open with their sums."""
    rows = [(1, 1, d, 0) for d in range(9, 0, -1)] + [(2, 2, d, 0) for d in range(7, 0, -1)] + [(3, 3, 5, 0), (3, 3, 5, 1)]
    names = ["h1", "h2", "doc", "tk", "pos", "n_lines"]
    cols = list(zip(*[(a, b, d, 0, p, 9) for a, b, d, p in rows], strict=True))
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 4 else pa.int32()) for i, c in enumerate(cols)], names=names)
    for size in (1, 4, 100):
        out = [r for b in op3_lines.decide_runs(5)(iter([batch.slice(i, size) for i in range(0, len(rows), size)])) for r in b.to_pylist()]
        assert [(r["h1"], r["docs"], r["top"]) for r in out if r["kind"] == op3_lines.SUM] == [(1, 9, 9), (3, 1, 5)]
        assert [(r["h1"], r["doc"]) for r in out if r["kind"] == op3_lines.DROPPED] == [(2, d) for d in range(6, 0, -1)]
        assert len([r for r in out if r["kind"] == op3_lines.OPEN]) == 11


def test_benchmark(spark, odd, monkeypatch):
    con, docs, items = odd
    monkeypatch.setattr(op9_decontaminate, "read", lambda s, d, t: docs if t == "documents" else items)
    compare(op9_decontaminate.op9_decontaminate(spark, ""), con, op9_decontaminate.ORACLE)
    monkeypatch.setattr(op9_decontaminate, "BROADCAST_BYTES", 0)
    compare(op9_decontaminate.op9_decontaminate(spark, ""), con, op9_decontaminate.ORACLE)
    kept = op9_decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and {20, 21, 22, 23}.isdisjoint({r["doc_id"] for r in kept.collect()}) and kept.where("doc_id in (24, 26)").count() == 2
    assert op9_decontaminate.contamination(docs, items.where("false")).where("n_hit > 0").count() == 0
    assert op9_decontaminate.contamination(docs.where("false"), items).count() == 0


def test_on_test_tables(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in registry.oracles().items():
        compare(registry.queries()[name](spark, sf), con, sql)
