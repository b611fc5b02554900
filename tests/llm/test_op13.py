"""Merkle manifest against a plain tree, rows of every odd kind, and a prover's view."""

import hashlib
import random
import zlib

import duckdb
import pytest

from pitchlens.llm import op13_manifest as op13

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, row string, n int, tree string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(level, marks):
    """The top of a list of digests; marks: for each leaf its proof so far, as (left, right) of each level, and where it stands."""
    while len(level) > 1:
        for m in marks:
            run = level[m["at"] // 8 * 8:][:8]
            k = m["at"] % 8
            m["way"].append(("".join(run[:k]), "".join(run[k + 1:])))
            m["at"] //= 8
        level = [h(*level[i:i + 8]) for i in range(0, len(level), 8)]
    return level[0]


def plain(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append({"row": r, "leaf": leaf(r[:5]), "way": []})
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for lang in langs:
        trees[lang].sort(key=lambda m: (m["row"][0] is not None, m["row"][0] or 0, m["leaf"]))
        for i, m in enumerate(trees[lang]):
            m["at"] = i
    subs = [climb([m["leaf"] for m in trees[lang]], trees[lang]) for lang in langs]
    for k, lang in enumerate(langs):
        for m in trees[lang]:
            m["at"], m["subroot"] = k, subs[k]
    root = climb(subs, [m for lang in langs for m in trees[lang]]) if subs else None
    out = []
    for lang in langs:
        for m in trees[lang]:
            doc_id, text = m["row"][0], m["row"][4]
            at = m["leaf"]
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 and text is not None:
                at = leaf([*m["row"][:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in text)])
            for left, right in m["way"]:
                at = h(left, at, right)
            out.append((doc_id, m["leaf"], m["subroot"], root, h(*[x for pair in m["way"] for x in pair]), at, at == root))
    return sorted(out, key=str)


def rows_of(n, seed, langs):
    r = random.Random(seed)
    rows = [(i * 3, r.choice(["a", None]), r.choice(langs), r.randrange(99), r.choice(["Ab Ç", "x" * r.randrange(50), "", None, "ÀB\nc"]), "clash", 5, "t") for i in range(n)]
    if n > 20:
        rows += [rows[3], rows[3], (None, *rows[4][1:]), (9, "b", rows[3][2], 1, "other", "r", 1, None), (10**12, "s", langs[0], 7, "Long " * 200_000, "c", 0, "x")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("n", "langs"), [(0, ["en"]), (1, ["en"]), (1, [None]), (8, ["en"]), (9, ["en"]), (30, [None, "", "en", "é", "z"]), (75, ["en"]), (150, [f"l{i}" for i in range(10)] + ["hot"] * 200)])
def test_against_a_plain_tree(spark, tmp_path, n, langs):
    rows = rows_of(n, n, langs)
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    out = op13.op13_merkle_manifest(spark, str(tmp_path))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    found = sorted([tuple(r) for r in out.collect()], key=str)
    assert found == plain(rows)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}/*.parquet'")
    assert sorted(con.execute(op13.oracle()).fetchall(), key=str) == found


def test_a_proof_holds_for_its_row_alone(spark):
    docs = spark.createDataFrame(rows_of(100, 4, ["en", "fr"]), SCHEMA)
    proofs, root = op13.manifest(docs)
    for r in proofs.collect():
        at = r["row"]["leaf"].hex()
        for s in r["way"]:
            assert len(s["left"]) % 32 == len(s["right"]) % 32 == 0 and len(s["left"]) + len(s["right"]) <= 7 * 32
            at = h(s["left"].hex(), at, s["right"].hex())
        assert at == root
    other, changed = op13.manifest(docs.union(docs.limit(1)))
    assert changed != root
