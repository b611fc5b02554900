"""The hidden Markov model against sums over all paths, its counts against a plain count, and held-out texts."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from pitchlens.llm import op7_hmm
from pitchlens.llm._text import read


def small(seed, k=3, m=4):
    r = np.random.default_rng(seed)
    norm = lambda x, a: x / x.sum(a, keepdims=True)
    return op7_hmm.Hmm(norm(r.random(k), 0), norm(r.random((k, k)), 1), norm(r.random((m + 1, k)), 0))


def all_paths(model, seq):
    """Probability, and expected starts, moves and emissions, over every path of states."""
    k, total = model.states, 0.0
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros_like(model.emit)
    for path in itertools.product(range(k), repeat=len(seq)):
        p = model.start[path[0]]
        for i, s in enumerate(path):
            p *= model.emit[seq[i], s] * (model.move[path[i - 1], s] if i else 1)
        total += p
        start[path[0]] += p
        for i, s in enumerate(path):
            emit[seq[i], s] += p
            if i:
                move[path[i - 1], s] += p
    return total, start / total, move / total, emit / total


def test_recursions_like_all_paths():
    model, seqs = small(1), [[0, 1, 4], [2], [3, 3, 0, 1, 2], [4, 4]]
    cls, lengths = np.concatenate(seqs), np.array([len(s) for s in seqs])
    want = [all_paths(model, s) for s in seqs]
    assert np.allclose(op7_hmm.log_likelihoods(model, cls, lengths), [math.log(w[0]) for w in want])
    got = op7_hmm.expected(model, cls, lengths)
    for i in range(3):
        assert np.allclose(got[i], sum(w[i + 1] for w in want))


def test_training_raises_likelihood():
    r = np.random.default_rng(2)
    cls, lengths, prior = r.integers(0, 5, 400), np.full(40, 10), np.full(5, 0.2)
    model = small(3)
    last = -np.inf
    for _ in range(5):
        model = op7_hmm.maximized(*op7_hmm.expected(model, cls, lengths), prior, strength=0.0)
        now = op7_hmm.log_likelihoods(model, cls, lengths).sum()
        assert now >= last - 1.0  # the small counts added to moves and starts aside
        last = now
    assert np.allclose(model.emit.sum(0), 1) and np.allclose(model.move.sum(1), 1)


def test_cut_up():
    assert op7_hmm.cut_up(np.arange(9), np.array([3, 1, 5]), 2)[1].tolist() == [2, 1, 1, 2, 2, 1]


def plain(model, seq):
    """Expected starts, moves and emissions of one sequence, step by step."""
    alpha, beta = [model.start * model.emit[seq[0]]], [np.ones(model.states)]
    for c in seq[1:]:
        alpha.append(alpha[-1] @ model.move * model.emit[c])
        alpha[-1] /= alpha[-1].sum()
    for c in seq[:0:-1]:
        beta.append(model.move @ (model.emit[c] * beta[-1]))
        beta[-1] /= beta[-1].sum()
    beta = beta[::-1]
    gamma = np.array([a * b / (a @ b) for a, b in zip(alpha, beta)])
    move, emit = np.zeros((model.states,) * 2), np.zeros_like(model.emit)
    for t in range(len(seq) - 1):
        both = np.outer(alpha[t], model.emit[seq[t + 1]] * beta[t + 1]) * model.move
        move += both / both.sum()
    np.add.at(emit, seq, gamma)
    return gamma[0], move, emit


@pytest.mark.parametrize("most", [1, 7, 64, 1 << 18])
def test_windows_like_whole_texts(most):
    r, model = np.random.default_rng(4), small(6)
    seqs = [r.integers(0, 5, n) for n in (1, 300, 2, 2, 40, 7, 299, 1)]
    got = op7_hmm.expected(model, np.concatenate(seqs), np.array([len(s) for s in seqs]), most)
    want = [sum(x) for x in zip(*[plain(model, s) for s in seqs])]
    for g, w in zip(got, want, strict=True):
        assert np.allclose(g, w, rtol=1e-4)


def test_numbers_too_small_for_four_bytes():
    emit = np.array([[1, 1e-30], [1e-30, 1]]) / (1 + 1e-30)
    model = op7_hmm.Hmm(np.full(2, 0.5), np.array([[1 - 1e-12, 1e-12], [1e-12, 1 - 1e-12]]), emit)
    seq = np.array([0, 0, 1, 0, 1, 1])
    for g, w in zip(op7_hmm.expected(model, seq, np.array([6])), plain(model, seq), strict=True):
        assert np.allclose(g, w)


def test_every_round_reads_all_texts_whole(spark):
    """Also where a sample of one text and stretches of four tokens were asked for."""
    r = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{w}" for w in r.integers(0, 9, n))) for i, n in enumerate([3, 0, 400, 20, 1, 9, 35, 2] * 4)]
    got = op7_hmm.HmmModel(spark.createDataFrame(rows, "doc_id long, text string"), states=2, classes=8, rounds=1, sample=1, sample_rounds=2, stretch=4)
    seqs = [op7_hmm.class_of(h, 8) for h, _ in op7_hmm.tokens([t.encode() for i, t in rows if zlib.crc32(str(i).encode()) % 10])]
    ends = [np.split(s, np.flatnonzero(s == 8)[:-1] + 1) for s in seqs]
    model = op7_hmm.first_model(got.class_tokens, got.prior, 2)
    for _ in range(3):
        model = op7_hmm.maximized(*[sum(x) for x in zip(*[plain(model, s) for some in ends for s in some])], got.prior)
    for k in ("start", "move", "emit"):
        assert np.allclose(getattr(got.model, k), getattr(model, k), rtol=1e-4)


def base(rows):
    tok = lambda t: [*(t or "").encode().lower().split(), None]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, t in rows if not held(i) for w in tok(t))
    n, v = sum(c.values()), len(c)
    return sorted(((i, held(i), len(tok(t)), sum(c[w] > 0 for w in tok(t)), n, round(sum(math.log10((c[w] + .1) / (n + .1 * (v + 1))) for w in tok(t)), 6)) for i, t in rows), key=str)


@pytest.mark.parametrize("head", [0, 8, 1 << 18])
def test_base_like_plain_count(spark, head):
    rows = [(i, " ".join(f"W{(i * j) % 17}" for j in range(i % 9))) for i in range(60)] + [(None, "a b"), (61, None), (62, ""), (5, "W1 W1\tW1\nw2"), (5, "W1 W1\tW1\nw2")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, word string")
    got = op7_hmm.HmmModel(df, states=2, classes=8, rounds=1, sample=10, sample_rounds=1, head=head).scores().collect()
    assert sorted((tuple(r)[:5] + (round(r["base_score"], 6),) for r in got), key=str) == base(rows)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert op7_hmm.HmmModel(none, states=2, classes=8).scores().count() == 0
    only_held = spark.createDataFrame([(None, "a"), (None, None)], "doc_id long, text string")
    assert [r["train_tokens"] for r in op7_hmm.HmmModel(only_held, states=2, classes=8).scores().collect()] == [0, 0]


def test_probabilities_add_up():
    """Over all texts of at most two tokens and the rest of the mass: words of a class and one unknown."""
    model = small(5, k=2, m=2)
    one = sum(np.exp(op7_hmm.log_likelihoods(model, np.array([c]), np.array([1])))[0] for c in range(3))
    two = sum(np.exp(op7_hmm.log_likelihoods(model, np.array(c), np.array([2])))[0] for c in itertools.product(range(3), repeat=2))
    assert math.isclose(one, 1) and math.isclose(two, 1)


def test_better_than_base_on_held_out(spark, sf):
    got = op7_hmm.HmmModel(read(spark, sf, "documents")).scores().where("held_out").toPandas()
    assert got["score"].sum() > got["base_score"].sum()
