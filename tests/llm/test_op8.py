"""Fingerprints against a plain version with the same hash, their search against all pairs, and odd rows."""

import hashlib
import random
import re

import pytest
import xxhash

from pitchlens.llm import op8_simhash as op

U = 2**64


def h(data: bytes, seed: int = 42) -> int:
    return xxhash.xxh64_intdigest(data, seed=seed % U)


def chain(words):
    out = 42
    for w in words:
        out = h(w.to_bytes(8, "little"), out)
    return out


def plain(text):
    words = [w for w in re.split("[ \t-\r]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")) if w]
    x = [h(w.encode()) for w in words]
    terms = [chain(x[i:i + 3]) for i in range(len(x) - 2)] or ([chain(x)] if x else [])
    both = [(a, h(op.SALT.to_bytes(4, "little"), h(a.to_bytes(8, "little")))) for a in terms]
    out = ""
    for k in (0, 1):
        bits = sum(1 << j for j in range(64) if 2 * sum(t[k] >> j & 1 for t in both) > len(both))
        out += f"{bits:016x}"
    return out


def like(a, b):
    return 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 128


def rows_of(docs):
    """Descending ids, nulls last; rows of one id are equal here, so their order is free."""
    key = lambda r: (r[0] is None, -(r[0] or 0))
    order = sorted(docs, key=key)
    out = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        t, after = t or "", after or ""
        n = len(t) // 3
        edited = t[:len(t) - n] + after[:n]
        f, e, a = plain(t), plain(edited), plain(after)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), f, e, like(f, e), like(f, a)))
    return sorted(out, key=str)


def made(seed, n):
    r = random.Random(seed)
    return [(i * 50, "".join(r.choice(["word ", "Éa", "b\n", "é😀 ", "X", "yy\t"]) for _ in range(r.choice([0, 1, 3, 30, 200])))) for i in range(n)]


@pytest.mark.parametrize("docs", [made(1, 30) + [(None, "last one here"), (7, None), (8, ""), (9, "same row twice now"), (9, "same row twice now")], [(5, "alone in the table")], []])
def test_rows(spark, docs):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, edited string, copies int").repartition(3)
    out = op.edited_likeness(df)
    got = sorted((tuple(r)[:7] for r in out.collect()), key=str)
    assert got == rows_of(docs)


def test_likeness_tells_edited_from_next(spark, sf):
    got = op.op8_simhash(spark, sf).toPandas()
    assert len(got) == 200 and (got["near_edited"] > got["near_next"]).mean() > 0.97
    assert got.loc[got["doc_id"] % 100 == 0, "n_near"].min() >= 1


@pytest.mark.parametrize("radius", [0, 3, 7])
def test_search_like_all_pairs(spark, radius):
    r = random.Random(radius)
    base = [r.getrandbits(128) for _ in range(40)]
    some = base + [b ^ sum(1 << k for k in r.sample(range(128), r.randint(0, radius + 2))) for b in base for _ in range(4)] + [0, 2**128 - 1]
    signed = lambda x: x - U if x >= U // 2 else x
    rows = [(signed(x >> 64), signed(x % U)) for x in some]
    df = spark.createDataFrame(rows, "f1 long, f2 long")
    got = {tuple(x) for x in op.near_fingerprints(df.limit(60), df, radius).collect()}
    asked = {tuple(x) for x in df.limit(60).collect()}
    apart = lambda a, b: sum(((x ^ y) % U).bit_count() for x, y in zip(a, b, strict=True))
    assert got == {(*a, *b) for a in asked for b in set(rows) if apart(a, b) <= radius}
    with pytest.raises(ValueError):
        op.near_fingerprints(df, df, 4)
