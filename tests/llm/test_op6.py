"""Suffix dedup against the definition, on random texts with planted repeats."""

import hashlib
import random

import pytest

from pitchlens.llm import op6_suffixes, suffixes


def brute(rows, span):
    """The definition, read off the bytes: rows (id, text) to (id, bytes, removed, runs, digest)."""
    first, out = {}, []
    texts = sorted({(-(2**63) if i is None else i, t) for i, t in rows}, key=lambda r: r[0])
    drops = {}
    for i, t in texts:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - span + 1):
            w = b[p:p + span]
            if w in first:
                gone[p:p + span] = [True] * span
            else:
                first[w] = (i, p)
        drops[(i, t)] = gone
    for i, t in rows:
        b, gone = (t or "").encode(), drops[(-(2**63) if i is None else i, t)]
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def made(seed, n=60):
    r = random.Random(seed)
    say = lambda k: "".join(r.choice("abé \n") for _ in range(k))
    shared = [say(r.randint(90, 260)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [say(r.randint(0, 150))]
        for _ in range(r.randint(0, 3)):
            s = r.choice(shared)
            a = r.randint(0, 20)
            parts += [s[a:len(s) - r.randint(0, 20)], say(r.randint(0, 60))]
        rows.append((i, "".join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, "x" * 500), (103, "xy" * 300), (104, None), (105, ""), (106, "short"), (None, rows[5][1]), (7, rows[7][1])]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "hot", "part"), [(1, 5000, 1 << 21), (2, 1, 1 << 21), (3, 5000, 150)])
def test_like_definition(spark, monkeypatch, seed, hot, part):
    rows = made(seed)
    if part < 1000:  # workers import the module anew: parts are tried in this process
        monkeypatch.setattr(op6_suffixes, "PART", part)
        import pyarrow as pa

        run = op6_suffixes.stretches(100, 24)
        texts = [t for _, t in rows if t and len(t.encode()) >= 100]
        b = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([0] * len(texts), pa.int64()), pa.array(texts)], names=["doc", "tk", "text"])
        got = [r for x in run(iter([b])) for r in x.to_pylist() if r["kind"] != op6_suffixes.SHARED]
        for d, t in enumerate(texts):
            have = sorted((r["lo"], r["lo"] + r["n"]) for r in got if r["doc"] == d)
            n = len(t.encode()) - 99
            assert have[0][0] == 0 and have[-1][1] == n and all(a[1] == b[0] for a, b in zip(have, have[1:]))
        return
    df = spark.createDataFrame([(i, t, "extra") for i, t in rows], "doc_id long, text string, kind string")
    got = op6_suffixes.dedup_spans(df, hot=hot).collect()
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in got), key=str)
    assert got == brute(rows, 100)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert op6_suffixes.dedup_spans(df).count() == 0
    none = spark.createDataFrame([(1, None), (None, None)], "doc_id long, text string")
    assert [r["n_removed"] for r in op6_suffixes.dedup_spans(none).collect()] == [0, 0]


def test_multipliers_are_odd():
    assert suffixes.R1 % 2 and suffixes.R2 % 2
