"""Toxicity: the models against plain recursive Kneser-Ney, held-out texts, and odd rows."""

import random
from collections import Counter

import numpy as np

from pitchlens.llm import kneser_ney as kn
from pitchlens.llm import op11_toxicity as op11

INSULTS = ["idiot", "moron", "wretch"]


def text(r, toxic, n=None):
    words = ["".join(r.choices("abdeilmnorst", k=r.randint(2, 7))) for _ in range(n or r.randint(60, 200))]
    for i in range(0, len(words), 20):
        if toxic:
            words[r.randrange(len(words))] = r.choice(INSULTS) + r.choice(["", "s", "en", "ish"])
    return " ".join(words).capitalize() + "."


def plain(texts, shared, discount=0.75):
    """P(symbol | up to three symbols before) of both classes, by recursion over sets of n-grams."""
    seen = [Counter(), Counter()]
    for label, some in enumerate(texts):
        for t in some:
            s = [0, 0, 0, *kn.symbols(t.encode()).tolist()]
            seen[label].update(tuple(s[i:i + 4]) for i in range(len(s) - 3))
    tables = {4: seen}
    for order in (3, 2, 1):
        tables[order] = [Counter(g[1:] for g, n in c.items() if n) for c in tables[order + 1]]

    def p(label, gram):
        order = len(gram)
        if not order:
            return 1 / kn.SYMBOLS
        c = tables[order][0] + tables[order][1] if order <= shared else tables[order][label]
        after = [n for g, n in c.items() if g[:-1] == gram[:-1]]
        lower = p(label, gram[1:])
        return lower if not after else max(c[gram] - discount, 0) / sum(after) + discount * len(after) / sum(after) * lower

    return p


def counts(texts):
    grams = [np.concatenate([g for t in some for g in kn.grams(kn.symbols(t.encode()))]) for some in texts]
    keys = np.unique(np.concatenate(grams))
    return keys, np.stack([np.bincount(np.searchsorted(keys, g), minlength=len(keys)) for g in grams])


def test_ratios_are_those_of_plain_kneser_ney():
    r = random.Random(3)
    texts = [["ab ba cab", "abc. Ça va"], ["abba zz", "cab cab zz9"]]
    keys, n = counts(texts)
    for shared in (0, 1, 2, 4):
        p, whole = plain(texts, shared), kn.table(kn.ratios(keys, n, shared))
        assert abs(sum(p(1, (1, 2, 3, w)) for w in range(64)) - 1) < 1e-9
        for g in [*keys.tolist(), *[r.randrange(64**4) for _ in range(60)], *[int(k) ^ r.randrange(64) for k in keys]]:
            gram = tuple((g >> (6 * k)) & 63 for k in (3, 2, 1, 0))
            assert abs(whole[g] - np.log(p(1, gram) / p(0, gram))) < 1e-4, gram


def test_symbols_and_grams():
    assert kn.symbols(None).tolist() == kn.symbols(b" \t\n ").tolist() == []
    assert kn.symbols(b" aB\t\n9! ").tolist() == [1, 2, 0, 27, 28, 0]
    assert kn.symbols("é".encode()).tolist() == kn.symbols("É".encode()).tolist()
    long = kn.symbols(b"ab c" * kn.PART)
    whole = np.concatenate(list(kn.grams(long)))
    assert len(whole) == len(long) and (whole[5:-1:4] == whole[5]).all()  # runs meet without a gap


def docs_and_labels(spark, n=400):
    r = random.Random(5)
    toxic = [r.random() < 0.3 for _ in range(n)]
    docs = [(i, text(r, t), "s", 7) for i, t in enumerate(toxic)]
    return toxic, docs, spark.createDataFrame([(i, int(t)) for i, t in enumerate(toxic)], "doc_id long, toxic int")


def test_held_out_texts(spark):
    toxic, docs, labels = docs_and_labels(spark)
    got = op11.toxicity(spark.createDataFrame(docs, "doc_id long, text string, source string, score int"), labels).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(docs) and len(held) > 100
    assert np.mean([r["predicted"] == toxic[r["doc_id"]] for r in held]) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in got)


def test_odd_rows(spark):
    toxic, docs, labels = docs_and_labels(spark, 120)
    r = random.Random(7)
    extra = [(None, text(r, True), "s", 7), (500, None, "s", 7), (501, "", "s", 7), (502, " \n", "s", 7), (3, docs[3][1], "t", 8), (503, text(r, True, 60_000), "s", 7), (504, "idiot", "s", 7)]
    table = spark.createDataFrame(docs + extra, "doc_id long, text string, log_ratio string, score int")
    labels = labels.unionByName(spark.createDataFrame([(None, 1), (5, None), (6, 9), (3, 1)], "doc_id long, toxic int"))
    got = op11.toxicity(table, labels).collect()
    assert len(got) == 127 and all(0 <= x["score"] <= 1 for x in got)
    by = {}
    for x in got:
        by.setdefault(x["doc_id"], []).append(x)
    assert by[None][0]["held_out"] and by[None][0]["score"] > 0.7 and by[503][0]["predicted"] == 1
    assert by[500][0]["score"] == by[501][0]["score"] == by[502][0]["score"] and by[500][0]["predicted"] == 0
    assert len(by[3]) == 2 and by[3][0]["score"] == by[3][1]["score"]
    alone = op11.with_ratio(table.where("doc_id = 9").select("doc_id", "text"), op11.Model(noise=0.0)).first()
    assert alone["log_ratio"] == 0
    kept = op11.drop_toxic(table, labels)
    assert kept.columns == table.columns and kept.count() == sum(x["score"] < 0.7 for x in got)
    one = op11.toxicity(table, labels.where("toxic = 1")).collect()
    assert {x["predicted"] for x in one} == {1}
    assert {x["predicted"] for x in op11.toxicity(table, labels.where("false")).collect()} == {0}
    assert op11.toxicity(table.where("false"), labels).count() == 0
