"""Near classes against all pairs, the sketch against its theory, components against union-find."""

import random

import numpy as np
import pytest

from pitchlens.llm import op4_near, sketch
from pitchlens.llm.graph import components

WS = b" \t\n\r\x0b\x0c"


def word_sets(text, size):
    w = (text or "").encode().lower().split()
    if not w:
        return set()
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} or {tuple(w)}


def brute(rows, size, num, den):
    sets = [(i, word_sets(t, size)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if x and y and den * len(x & y) >= num * len(x | y):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return sorted((i, len(x), root(i), root(i) == i) for i, x in sets)


def made(seed):
    r = random.Random(seed)
    say = lambda k: [r.choice("alpha beta Gamma delta épsilon zeta eta theta".split()) + str(r.randint(0, 40)) for _ in range(k)]
    texts = []
    for _ in range(12):
        base = say(r.randint(1, 120))
        texts.append(base)
        for _ in range(r.randint(0, 12)):  # chains of edits: links between neighbours, not with the first
            base = list(base)
            for _ in range(r.randint(0, 3)):
                base[r.randrange(len(base))] = say(1)[0]
            texts.append(base)
    texts = ["  ".join(t) if r.random() < 0.2 else " ".join(t).upper() if r.random() < 0.1 else "\n".join(t) for t in texts]
    texts += [None, "", " \n", "one", "ONE", "one two", "Two one", texts[0], texts[0]]
    ids = r.sample(range(1000), len(texts))
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize(("seed", "size", "num", "den"), [(1, 3, 85, 100), (2, 5, 4, 5)])
def test_like_all_pairs(spark, seed, size, num, den):
    rows = made(seed)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, component long")
    got = sorted(tuple(r) for r in op4_near.near_classes(df, size, num, den).collect())
    assert got == brute(rows, size, num, den)
    if seed == 1:
        kept = {r["doc_id"] for r in op4_near.drop_near(df, size, num, den).collect()}
        assert kept == {i for i, _, _, k in got if k}


def test_odd_rows(spark):
    same = "a b c d e f g h"
    df = spark.createDataFrame([(5, same), (5, same), (None, same), (3, "x"), (None, None), (None, "q r s t u v")], "doc_id long, text string")
    got = sorted((tuple(r) for r in op4_near.near_classes(df).collect()), key=str)
    assert got == sorted([(5, 4, 5, True), (5, 4, 5, True), (None, 4, 5, False), (3, 1, 3, True), (None, 0, None, True), (None, 2, None, True)], key=str)
    kept = sorted((tuple(r) for r in op4_near.drop_near(df).collect()), key=str)
    assert kept == sorted([(5, same), (3, "x"), (None, None), (None, "q r s t u v")], key=str)
    assert op4_near.near_classes(df.where("false")).count() == 0


def test_register_likeness():
    r = np.random.default_rng(5)
    for j in (0.5, 0.85, 0.95):
        n = 2000
        shared = int(round(2 * n * j / (1 + j)))
        pool = r.integers(0, 2**64, 2 * n, dtype=np.uint64)
        x, y = pool[:n], pool[n - shared:2 * n - shared]
        a, b = sketch.registers(x, 1000), sketch.registers(y, 1000)
        ok, best = sketch.may_reach(a[None], b[None], np.array([n]), np.array([n]), 0.85)
        assert ok[0] == (j > 0.8) and (abs(best[0] - j) < 0.06 or not ok[0])
        assert abs((a == b).mean() - j) < 0.06
        assert (sketch.merge(a, b) == sketch.registers(np.union1d(x, y), 1000)).all()


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 400)]
    got = dict(tuple(x) for x in components(spark.createDataFrame(links, "a long, b long")).collect())
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    want = {i: root(i) for i in {x for p in links if p[0] != p[1] for x in p}}
    assert got == want
