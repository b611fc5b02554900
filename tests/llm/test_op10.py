"""Rollups against plain sums, batches applied twice, a try that died, compaction; counts against the vocabulary itself."""

from collections import Counter

import pytest

from pitchlens.llm import op10_rollup as op
from pitchlens.llm._text import read

DOCS = "doc_id long, text string, source string, lang string, version int"


@pytest.fixture
def store(spark, tmp_path):
    return op.Rollup(spark, str(tmp_path / "store"))


def rows(df):
    return {(r["source"], r["lang"], r["version"]): (r["docs"], r["tokens"], r["bytes"]) for r in df.collect()}


def test_batches(spark, store):
    docs = spark.createDataFrame([(1, "a b c", "s", "en", 7), (2, "a b c", "s", "en", 7), (2, "é", "s", None, 7), (None, None, None, "en", 7), (4, "", "s", "en", 7)], DOCS)
    counts = op.token_counts(docs, {"words": op.words_version})
    assert rows(store.totals()) == {} and store.batches() == []
    assert store.commit("one", op.inserts(counts))
    want = {("s", "en", "words"): (3, 6, 10), ("s", None, "words"): (1, 1, 2), (None, "en", "words"): (1, 0, 0)}
    assert rows(store.totals()) == want
    assert not store.commit("one", op.inserts(counts)) and rows(store.totals()) == want
    # a try that died before its rename leaves nothing that counts
    op.inserts(counts).write.parquet(f"{store.path}/_try-two-dead")
    assert rows(store.totals()) == want and store.batches() == ["one"]
    assert store.commit("two", op.deletes(op.later_copies(counts)))
    want["s", "en", "words"] = (2, 3, 5)
    assert rows(store.totals()) == want
    new = op.token_counts(docs.replace("a b c", "a b c d").where("doc_id = 1"), {"words": op.words_version})
    assert store.commit("three", op.revisions(counts.where("id = 1"), new))
    want["s", "en", "words"] = (2, 4, 7)
    assert rows(store.totals()) == want
    store.compact()
    assert rows(store.totals()) == want and store.batches() == ["one", "three", "two"]
    assert not store.commit("two", op.inserts(counts)) and rows(store.totals()) == want
    assert store.commit("four", op.deletes(counts.where("source IS NULL"))) and rows(store.totals())[None, "en", "words"] == (0, 0, 0)
    assert (None, "en", "words") not in rows(store.totals(live=True))
    store.compact()
    assert store.commit("empty", op.inserts(counts.where("false"))) and "empty" in store.batches() and "four" in store.batches()
    with pytest.raises(ValueError):
        store.commit("../x", op.inserts(counts))


def test_query_like_plain_sums(spark, sf):
    got = rows(op.op10_token_counts(spark, sf))
    bpe, want, seen = op.bpe_version(), Counter(), set()
    for r in sorted(read(spark, sf, "documents").collect(), key=lambda r: r["doc_id"]):
        b = r["text"].encode()
        if b in seen:
            continue
        seen.add(b)
        for version, n in (("words", len(b.split())), ("byte_bpe_50k", int(bpe([b])[0]))):
            for i, x in enumerate((1, n, len(b))):
                want[r["source"], r["lang"], version, i] += x
    assert {k: v for k, v in got.items() if v[0]} == {k: tuple(want[(*k, i)] for i in range(3)) for k in {k[:3] for k in want}}


def test_counts_like_vocabulary():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = ["", "It's 12 o'clock, <|endoftext|> é 😀\n\n  x", "word " * 300]
    assert op.bpe_version()([x.encode() for x in texts]).tolist() == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


def test_two_writers_at_every_step(spark, tmp_path, monkeypatch):
    """Whatever another writer commits and merges between the steps of a commit or a merge, every batch counts once."""
    def changes(n):
        return spark.createDataFrame([("s", "en", "v", 1, n, n)], op.BATCH)

    real = op.Rollup._take
    for k, own in enumerate(("commit", "compact", "same batch")):
        for others in (["commit"], ["commit", "compact"], ["compact", "commit"], ["compact", "commit", "compact"]):
            store = op.Rollup(spark, str(tmp_path / f"{k}-{'-'.join(others)}"))
            assert store.commit("a", changes(1)) and store.commit("b", changes(2))
            done = []

            def take(self, tried, wanted, done=done, others=others, own=own, store=store):
                if not done:  # between writing and renaming, the other writer
                    done.append(1)
                    for step in others:
                        store.compact() if step == "compact" else store.commit("mine" if own == "same batch" else "other", changes(4))
                return real(self, tried, wanted)

            with monkeypatch.context() as m:
                m.setattr(op.Rollup, "_take", take)
                if own == "compact":
                    store.compact()
                elif own == "commit":
                    assert store.commit("mine", changes(8))
                else:
                    assert not store.commit("mine", changes(4))
            want = {"commit": 15, "compact": 7, "same batch": 7}[own]
            for _ in range(2):
                assert store.totals().first()["tokens"] == want, (own, others)
                assert set(store.batches()) == {"a", "b"} | ({"mine"} if own != "compact" else set()) | ({"other"} if own != "same batch" else set())
                assert not store.commit("a", changes(1))
                store.compact()
