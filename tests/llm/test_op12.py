"""Spelling variants against all pairs, the promise of the pivots, and odd rows."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pitchlens.llm import op12_spelling as op12

SCHEMA = "doc_id long, text string, word string, n string, form int"


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(rows):
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    others = {w: [o for o in n if near(w, o)] for w in n}
    forms = {}
    for w in n:
        best = min(others[w], key=lambda o: (-n[o], o), default=None)
        forms[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, n[w], len(others[w]), forms[w], n.get(forms[w]), root))
    return sorted(out)


def texts(seed):
    r = random.Random(seed)
    words = ["".join(r.choices("abcÉéÿ×t", k=r.randint(4, 9))) for _ in range(60)] + ["tttttt", "ttttt", "ababab", "abababab", "Resumé", "À" * 7, "q" * 300, "q" * 299]
    for w in list(words):
        for _ in range(3):
            k = r.randrange(len(w))
            words.append(r.choice([w[:k] + w[k + 1:], w[:k] + "z" + w[k:], w[:k] + r.choice("abé") + w[k + 1:]]))
    rows = []
    for i in range(120):
        some = r.choices(words, weights=[1 + (hash_ % 7) ** 2 for hash_ in range(len(words))], k=40)
        rows.append((i, r.choice([" ", ", ", "-", "1", "\n"]).join(r.choice([w, w, w.upper() if w.isascii() else w]) for w in some), "x", "y", 1))
    return rows + [rows[0], rows[0], (None, rows[1][1], None, None, None), (500, None, "", "", 0), (501, "", "", "", 0), (502, "1 2 ³", "", "", 0), (503, "longer longed " * 30_000, "", "", 0)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, tmp_path, seed):
    rows, path = texts(seed), str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    out = op12.op12_spelling_variants(spark, str(tmp_path))
    assert out.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    found = sorted([tuple(r) for r in out.collect()])
    want = plain(rows)
    assert found == want and any(w[3] for w in want)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}/*.parquet'")
    assert sorted(con.execute(op12.ORACLE).fetchall()) == want


def test_empty_table_and_table_without_pairs(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert op12.variants(op12.vocabulary(none)).count() == 0
    words = spark.createDataFrame([("abcde", 9), ("vwxyz", 4)], "word string, n long")
    assert sorted(map(tuple, op12.variants(words).collect())) == [("abcde", 9, 0, None, None, "abcde"), ("vwxyz", 4, 0, None, None, "vwxyz")]


def test_long_chains_of_forms(spark):
    words = ["abcdefgh"]
    for i in range(8):
        words.append(words[-1][:i] + "z" + words[-1][i + 1:])
    table = spark.createDataFrame([(w, 3 * 2**k) for k, w in enumerate(words)], "word string, n long")
    got = {r["word"]: r for r in op12.variants(table).collect()}
    assert all(got[w]["root"] == words[-1] for w in words) and [got[w]["form"] for w in words[:-1]] == words[1:]


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_one_of_two_near_words_finds_the_other(data):
    words = data.draw(st.lists(st.text("abcd", min_size=5, max_size=9), min_size=1, max_size=12))
    r, k = data.draw(st.sampled_from(words)), data.draw(st.integers(0, 8))
    s = data.draw(st.sampled_from([r[:k] + r[k + 1:], r[:k] + "a" + r[k:], r[:k] + "d" + r[k + 1:]]))
    if len(s) < 5 or not near(r, s):
        return
    choose = op12.Chooser(Counter(w[i:i + 2] for w in [*words, r, s] for i in range(len(w) - 1)))
    (ends, _, a, b), (far, places, *_) = choose(r), choose(s)
    if (far, s) < (ends, r):
        r, s, (ends, _, a, b), (far, places, *_) = s, r, choose(s), choose(r)
    assert b >= a + 2
    start = r[:a + 2] == s[:a + 2] and a in places
    end = r[b:] in {s[p:] for p in places}
    assert start or end
    assert start == (r[:a + 2] == s[:a + 2])  # so that an end may be passed over
