"""Packing: ids like the tokenizer's, gapless sequences, numbers of bins against the bound and against exhaustive search."""

import random
import string
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from pitchlens.llm import binpack, op2_pack
from pitchlens.llm._text import read


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(op2_pack.vocabulary())


def test_ids(tok):
    r = random.Random(1)
    signs = "aAbZ'’.,;:!?-<|>_09 \n\t\r\x0b\x1c\x85  éÉßσΣ́中😀"
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 60))) for _ in range(600)]
    texts += ["<|endoftext|>", "<|ENDOFTEXT|> x", "It's DON'T we'll, rock'n'roll... ok?! (yes)", "á b ́c"]
    got = list(op2_pack.token_ids([t.encode() for t in texts], op2_pack.vocabulary()))
    for t, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_ids_of_letters_and_marks(tok):
    r = random.Random(5)
    letters = "abzABZß×÷ªµ" + "".join(map(chr, range(0xC0, 0x100)))
    texts = [" ".join("".join(r.choice(letters) for _ in range(r.randint(0, 6))) + "".join(r.choice(string.punctuation) for _ in range(r.randint(0, 3)))
                      + r.choice(["", "", "", "s", "\u0301", "\u0338"]) for _ in range(20)) for _ in range(200)]
    for _ in range(2):  # from the tokenizer, then as remembered
        got = list(op2_pack.token_ids([t.encode() for t in texts], op2_pack.vocabulary()))
        for t, ids in zip(texts, got, strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_few_words_at_once(tok, monkeypatch):
    """What the tokenizer returns is far larger than the words, so it gets a bounded number of them."""
    class Counted:
        model, pre_tokenizer, sizes = tok.model, tok.pre_tokenizer, []

        def encode(self, *a, **k):
            return tok.encode(*a, **k)

        def encode_batch_fast(self, words, **k):
            self.sizes.append(len(words))
            return tok.encode_batch_fast(words, **k)

    monkeypatch.setattr(op2_pack, "_tokenizer", lambda path: Counted())
    text = " ".join(f"{i}é{i}" for i in range(5000))
    got, = op2_pack.token_ids([text.encode()], op2_pack.vocabulary())
    assert np.frombuffer(got, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids
    assert 0 < max(Counted.sizes) <= 1000


def fewest(sizes, capacity):
    """By trying everything."""
    best = [len(sizes)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for free in {r for r in rooms if r >= sizes[i]}:
            k = rooms.index(free)
            go(i + 1, [*rooms[:k], free - sizes[i], *rooms[k + 1:]])
        go(i + 1, [*rooms, capacity - sizes[i]])

    sizes = sorted(sizes, reverse=True)
    go(0, [])
    return best[0]


def bins(plan, counts, capacity):
    held = np.zeros_like(counts)
    for pattern, times in plan:
        assert sum(s * k for s, k in pattern) <= capacity and times > 0
        for s, k in pattern:
            held[s] += k * times
    assert (held == counts).all()
    return sum(t for _, t in plan)


def test_fewest_bins():
    r = random.Random(2)
    for _ in range(150):
        capacity = r.choice([10, 23, 50])
        sizes = [r.randint(1, capacity) for _ in range(r.randint(0, 9))]
        counts = np.bincount(np.array(sizes, int), minlength=capacity + 1)
        assert bins(binpack.complete(counts, capacity), counts, capacity) == fewest(sizes, capacity)
        assert binpack.lower_bound(counts, capacity) <= fewest(sizes, capacity)


def test_every_filling():
    """The fewest bins need more waste than the least, fillings past the third, or a filling fewer times than it could be."""
    sizes = [1229, 1208, 1188, 778, 553, 512, 328, 307]
    for times in (1, 1000):
        counts = times * np.bincount(sizes, minlength=2049)
        assert bins(binpack.complete(counts, 2048), counts, 2048) == 3 * times == binpack.lower_bound(counts, 2048)


def test_undominated():
    """Each bin's undominated fillings are those found by trying everything, or dominate them."""
    r = random.Random(5)
    for _ in range(300):
        room = r.randint(1, 16)
        counts = np.bincount([r.randint(1, 20) for _ in range(r.randint(1, 8))], minlength=21)
        got = [f for f in binpack.fillings(counts, room) if f is not None]
        assert len(set(got)) == len(got) and all(sum(s * k for s, k in f) <= room and all(counts[s] >= k for s, k in f) for f in got)
        every = {()}
        for s in range(1, room + 1):
            every |= {(*f, *[s] * k) for f in every for k in range(1, counts[s] + 1) if sum(f) + s * k <= room}
        held = [[s for s, k in f for _ in range(k)] for f in got]
        for f in every:
            assert any(inside(f, h) for h in held), (f, room, counts)


def inside(items, boxes):
    """The items fit into boxes of these sizes."""
    if not items:
        return True
    *rest, last = sorted(items)
    return any(inside(rest, [*boxes[:i], b - last, *boxes[i + 1:]]) for i, b in enumerate(boxes) if b >= last)


def test_many_lengths():
    r = np.random.default_rng(3)
    counts = np.bincount(np.clip(r.lognormal(6.3, 1, 5000).astype(int) + 1, 1, 2048), minlength=2049)
    plan = binpack.complete(counts, 2048)
    assert bins(plan, counts, 2048) <= binpack.lower_bound(counts, 2048) + 1


def whole(rows, texts, tok, capacity):
    """Every document once, every piece right, every sequence gapless and within bounds."""
    seen, places = {}, {}
    for r in rows:
        seen.setdefault(r["doc_id"], []).append(r)
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for used in places.values():
        used.sort()
        assert used[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(used, used[1:])) and sum(used[-1]) <= capacity
    assert set(seen) == {i for i, _ in texts}
    for i, t in texts:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        got = sorted(seen[i], key=lambda r: r["piece"])
        assert [r["start"] for r in got] == list(range(0, len(ids), capacity)) and [r["piece"] for r in got] == list(range(len(got)))
        for r in got:
            part = ids[r["start"]:r["start"] + capacity]
            assert (r["length"], r["ids_crc32"]) == (len(part), zlib.crc32(part.tobytes()))
    return len(places)


@pytest.mark.parametrize("bucket", [3, 200_000])
def test_rows(spark, tok, bucket):
    r = random.Random(4)
    texts = [(i, " ".join(r.choice(["alpha", "Beta,", "x"]) for _ in range(r.choice([0, 1, 1, 5, 20, 90])))) for i in range(120)] + [(200, None), (None, "one two")]
    df = spark.createDataFrame([(i, t, "s") for i, t in texts], "doc_id long, text string, length string").repartition(3)
    rows = op2_pack.pack(df, capacity=32, bucket_rows=bucket).collect()
    n = whole(rows, texts, tok, 32)
    assert n <= 1.02 * sum(x["length"] for x in rows) / 32 + 1
    assert op2_pack.pack(df.where("false")).count() == 0


def test_query(spark, sf, tok):
    texts = [tuple(x) for x in read(spark, sf, "documents").select("doc_id", "text").collect()]
    rows = op2_pack.op2_pack(spark, sf).collect()
    counts = np.bincount([x["length"] for x in rows], minlength=2049)
    assert whole(rows, texts, tok, 2048) <= binpack.lower_bound(counts, 2048) + 1
    again = spark.createDataFrame([(1, "same words")] * 5, "doc_id long, text string")
    got = op2_pack.pack(again, capacity=10).collect()
    assert len(got) == 5 and len({(x["sequence_id"], x["offset"]) for x in got}) == 5
