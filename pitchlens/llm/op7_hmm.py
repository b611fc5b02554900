"""Language-model scores: a hidden Markov model over word classes, trained by Baum-Welch over all training texts.

Words fall into ``classes`` classes by their hash, so the model's tables are
bounded however many words the corpus has.  A text's probability is that of its
class sequence under the Markov model times that of each word in its class,
(c + 0.1) / (C + 0.1 * (V + 1)) with the class's tokens C and distinct words V
and one more place for unknown words; so every text has a probability and they
add up to one.

1. Word counts: each task sends one count a word, summed by word.
2. Baum-Welch: the first emissions deal each class's tokens to the states at
   random; each round then runs the forward and backward recursions over all
   training texts, each from its first token to its end, and adds the expected
   counts up by class.  Texts are stored as classes, so words are hashed once.
   Texts of about the same length go on together; of a very long one only the
   variables of a window of steps are held.
3. Scores: the scaled forward recursion over each whole text.  Counts of the
   most frequent words (``head`` of them at most) are sent to all tasks; a
   text's other words are dealt by word to meet their counts and summed back.

Defined results: null and empty texts are the end alone; a row with a null
``doc_id`` is held out; repeated rows count and are scored as often as they
stand there; without training rows N and V are 0; an empty table gives an empty
table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlens.llm._text import read
from pitchlens.llm.words import binary, parts, word_hashes
from pitchlens.session import materialize

#: Stands for the end of a text among the hashes of words.
END = np.uint64(0x0123456789ABCDEF)
ALPHA = 0.1
#: Tokens whose variables are held at once.
HELD = 1 << 18


@dataclass
class Hmm:
    start: np.ndarray  # by state
    move: np.ndarray  # from, to
    emit: np.ndarray  # class, state

    @property
    def states(self) -> int:
        return len(self.start)


def class_of(hashes: np.ndarray, classes: int) -> np.ndarray:
    """Class of each hash; the end has the last class, number ``classes``, for itself."""
    out = (hashes >> np.uint64(40)).astype(np.int64) % classes
    out[hashes == END] = classes
    return out


def tokens(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For a few texts at a time: the hashes of all their tokens, ends included, and how many each has."""
    for _, some in parts(texts):
        hashes, count = word_hashes(some)
        yield np.insert(hashes, np.cumsum(count), END), count + 1


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [h for h, _ in tokens(binary(b["text"]))]
        if found:
            word, c = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(c.astype(np.int64))], names=["word", "c"])


def class_type(classes: int) -> type:
    """Classes, the end's included, as they are stored."""
    return np.uint16 if classes < 1 << 16 else np.uint32


def class_rows(classes: int):
    """Arrow batches of text to a row each: the classes of its tokens."""
    kind = class_type(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for hashes, count in tokens(binary(b["text"])):
                cls = class_of(hashes, classes).astype(kind)
                rows = np.split(cls, np.cumsum(count)[:-1])
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary())], names=["cls"])

    return run


def alike(lengths: np.ndarray, most: int = HELD) -> Iterator[np.ndarray]:
    """The numbers of sequences that go on together: neighbours by length, of at most ``most`` tokens unless one alone has more."""
    order = np.argsort(lengths, kind="stable")
    ends = np.cumsum(lengths[order])
    at = 0
    while at < len(order):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield order[at:stop]
        at = stop


class Steps:
    """Sequences step by step: at each step those still going, by falling length."""

    def __init__(self, cls: np.ndarray, lengths: np.ndarray, own: np.ndarray):
        own = own[np.argsort(-lengths[own], kind="stable")]
        first, n = (np.cumsum(lengths) - lengths)[own], lengths[own]
        self.own = own
        self.going = (len(n) - np.searchsorted(np.sort(n), np.arange(n.max()), side="right")).tolist()
        self.at = np.concatenate([[0], np.cumsum(self.going)]).tolist()  # where each step's tokens begin
        place = np.empty(self.at[-1], np.int64)
        for t, some in enumerate(self.going):
            np.add(first[:some], t, out=place[self.at[t]:self.at[t + 1]])
        self.cls = cls[place]

    def windows(self, most: int) -> list[tuple[int, int]]:
        """Runs of steps of at most ``most`` tokens, or of one step."""
        if self.at[-1] <= most:
            return [(0, len(self.going))]
        ends = np.cumsum(cut_up(self.cls, np.array([len(self.going)]), max(1, most // self.going[0]))[1]).tolist()
        return list(zip([0, *ends[:-1]], ends))

    def forward(self, a: int, b: int, start: np.ndarray, move: np.ndarray, emit: np.ndarray, before: np.ndarray | None, total: np.ndarray | None = None) -> np.ndarray:
        """Forward variables of the steps from ``a`` to ``b``, scaled every few steps; before: the last step's; total: takes the scales' logarithms."""
        base, every = self.at[a], 8 if emit.dtype == np.float64 else 2
        out = emit.take(self.cls[base:self.at[b]], 0)
        one, to = np.ones(len(start), emit.dtype), np.empty((self.going[a], len(start)), emit.dtype)
        for t in range(a, b):
            n, now = self.going[t], out[self.at[t] - base:self.at[t + 1] - base]
            if t:
                now *= np.matmul(before[:n], move, out=to[:n])
            else:
                now *= start
            ends = t + 1 == len(self.going) or self.going[t + 1] < n  # a sequence's last scale is its probability's
            if t % every == 0 or total is not None and ends:
                scale = now @ one
                now /= scale[:, None]
                if total is not None:
                    total[:n] += np.log(scale)
            before = now
        return out


def log_likelihoods(model: Hmm, cls: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Natural logarithm of the probability of each sequence (none is empty), by the scaled forward recursion."""
    out = np.zeros(len(lengths))
    for own in alike(lengths):
        steps, before = Steps(cls, lengths, own), None
        total = np.zeros(len(own))
        for a, b in steps.windows(HELD):
            before = steps.forward(a, b, model.start, model.move, model.emit, before, total)[-steps.going[b - 1]:].copy()
        out[steps.own] = total
    return out


def _expected(model: Hmm, steps: Steps, kind: type, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Expected starts, moves and emissions of sequences; None if a number gets too small for ``kind``."""
    k, at, going = model.states, steps.at, steps.going
    # an emission counts by its ratio to those of all states: posteriors are the same, and numbers stay near one
    ratio = (model.emit / np.maximum(model.emit.mean(1, keepdims=True), 1e-300)).astype(kind)
    start, move = model.start.astype(kind), model.move.astype(kind)
    back, one, every = np.ascontiguousarray(move.T), np.ones(k, kind), 8 if kind == np.float64 else 2
    moves, emit = np.zeros((k, k)), np.zeros_like(model.emit)
    windows, before = steps.windows(most), [None]
    for a, b in windows[:-1]:  # the last forward variables of each window but the last
        before.append(steps.forward(a, b, start, move, ratio, before[-1])[-going[b - 1]:].copy())
    after = np.empty((0, k), kind)  # emissions times backward variables of the step after
    for (a, b), last in zip(reversed(windows), reversed(before)):
        base = at[a]
        alpha, cls = steps.forward(a, b, start, move, ratio, last), steps.cls[base:at[b]]
        ahead, beta = ratio.take(cls, 0), np.ones((len(cls), k), kind)
        for t in range(b - 1, a - 1, -1):
            s, e = at[t] - base, at[t + 1] - base
            np.matmul(after, back, out=beta[s:s + len(after)])
            now = ahead[s:e]
            now *= beta[s:e]
            if t % every == 0:
                now /= (now @ one)[:, None]
            if t == b - 1:
                later = after
            after = now
        beta *= alpha
        z = beta @ one
        if not (z > 1e-20).all() and kind != np.float64:
            return None
        beta /= z[:, None]
        alpha /= z[:, None]
        # moves within the window, for runs of steps that as many sequences make, and those out of it
        t = a
        while t < b - 1:
            u = t + 1
            while u < b - 1 and going[t] == going[u] == going[u + 1]:
                u += 1
            n = at[u + 1] - at[t + 1]
            moves += alpha[at[t] - base:at[t] - base + n].T @ ahead[at[t + 1] - base:at[u + 1] - base]
            t = u
        n = len(later)
        moves += alpha[at[b - 1] - base:at[b - 1] - base + n].T @ later
        for s in range(k):
            emit[:, s] += np.bincount(cls, weights=beta[:, s], minlength=len(emit))
        after = after.copy()
    return beta[:going[0]].sum(0, dtype=np.float64), moves * model.move, emit


def expected(model: Hmm, cls: np.ndarray, lengths: np.ndarray, most: int = HELD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of starts, moves and emissions: the forward and backward recursions over whole sequences (none is empty).

    Variables are floats of four bytes, or of eight where those are too short; sums have eight.
    """
    total = [np.zeros(model.states), np.zeros((model.states, model.states)), np.zeros_like(model.emit)]
    for own in alike(lengths, most):
        steps = Steps(cls, lengths, own)
        for out, more in zip(total, _expected(model, steps, np.float32, most) or _expected(model, steps, np.float64, most)):
            out += more
    return tuple(total)


def maximized(start: np.ndarray, move: np.ndarray, emit: np.ndarray, prior: np.ndarray, strength: float = 5000.0) -> Hmm:
    """The model of expected counts; ``strength`` tokens dealt like ``prior`` keep every class possible in every state."""
    emit = emit + strength * prior[:, None]
    move, start = move + 0.1, start + 0.1
    return Hmm(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def cut_up(cls: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The same tokens as sequences of at most ``size``."""
    whole, rest = np.divmod(lengths, size)
    n = whole + (rest > 0)
    out = np.full(n.sum(), size, np.int64)
    last = np.cumsum(n) - 1
    out[last[rest > 0]] = rest[rest > 0]
    return cls, out


def e_step(model: Hmm, classes: int):
    """Arrow batches of :func:`class_rows` to a task's expected counts: rows (class, by state), moves below 0."""
    kind = class_type(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            texts = b["cls"].to_pylist()
            cls, count = np.frombuffer(b"".join(texts), kind), np.array([len(t) for t in texts], np.int64) // np.dtype(kind).itemsize
            del texts
            found = expected(model, cls, count)
            total = found if total is None else [a + c for a, c in zip(total, found, strict=True)]
        if total is not None:
            rows = np.concatenate([total[0][None], total[1], total[2]])
            number = np.arange(-1 - model.states, len(total[2]), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(number), *[pa.array(rows[:, s]) for s in range(model.states)]], names=["row", *[f"s{s}" for s in range(model.states)]])

    return run


def first_model(class_tokens: np.ndarray, prior: np.ndarray, states: int) -> Hmm:
    """States told apart: each class's tokens, of all training texts, are dealt to them at random.

    States last long to begin with, so that the words of a stretch agree on one.
    """
    deal = np.random.default_rng(7).dirichlet(np.ones(states), len(class_tokens))
    return maximized(np.ones(states), 200 * np.eye(states) + 1, class_tokens[:, None] * deal, prior)


class HmmModel:
    """Counts and model of the rows of ``documents`` that are not held out.

    ``sample_rounds`` and then ``rounds`` rounds of Baum-Welch are run, all of
    them over all training texts; ``sample`` and ``stretch``, which once limited
    the former to some texts and all to pieces of texts, limit nothing now.
    """

    def __init__(self, documents: DataFrame, states: int = 12, classes: int = 1 << 14, rounds: int = 2, sample: int = 1000,
                 sample_rounds: int = 8, stretch: int = 256, head: int = 1 << 18):
        self.docs = documents.select(F.col("doc_id").cast("long"), "text", held_out(F.col("doc_id")).alias("held_out"))
        self.classes = classes
        train = self.docs.where("NOT held_out").select("doc_id", "text")
        self.counts = materialize(train.select("text").mapInArrow(count_words, "word long, c long").groupBy("word").agg(F.sum("c").alias("c")), "counts")
        # per class at most: its tokens and distinct words
        unsigned = F.shiftrightunsigned("word", 40)
        cls = F.when(F.col("word") == int(END), F.lit(classes)).otherwise(F.pmod(unsigned, F.lit(classes)))
        self.class_tokens, self.class_words = np.zeros(classes + 1), np.zeros(classes + 1)
        for r in self.counts.groupBy(cls.alias("cls")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():
            self.class_tokens[r["cls"]], self.class_words[r["cls"]] = r["c"], r["v"]
        self.n, self.v = int(self.class_tokens.sum()), int(self.class_words.sum())
        self.prior = (self.class_tokens + ALPHA * (self.class_words + 1))
        self.prior /= self.prior.sum()
        # the most frequent words: all above a power of two that leaves `head` of them at most
        sizes = sorted(((r["e"], r["n"]) for r in self.counts.groupBy(F.floor(F.log2("c")).alias("e")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
        least, left = 62, head
        for e, n in sizes:
            if n > left:
                break
            least, left = e, left - n
        top = self.counts.where(F.col("c") >= 2**least).toArrow()
        order = np.argsort(top["word"].to_numpy().view(np.uint64))
        self.head = top["word"].to_numpy().view(np.uint64)[order], top["c"].to_numpy()[order]
        self.model = first_model(self.class_tokens, self.prior, states)
        sequences = materialize(train.select("text").mapInArrow(class_rows(classes), "cls binary"), "classes") if self.n else None
        for _ in range(sample_rounds + rounds if self.n else 0):
            cols = ["row long", *[f"s{s} double" for s in range(states)]]
            rows = sequences.mapInArrow(e_step(self.model, classes), ", ".join(cols)).groupBy("row").agg(
                *[F.sum(f"s{s}").alias(f"s{s}") for s in range(states)]).toArrow()  # a row a class and state
            table = np.zeros((classes + 2 + states, states))
            table[rows["row"].to_numpy() + 1 + states] = np.stack([rows[f"s{s}"].to_numpy() for s in range(states)], axis=1)
            self.model = maximized(table[0], table[1:1 + states], table[1 + states:], self.prior)

    def scores(self) -> DataFrame:
        """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row for each row of the documents."""
        kinds = "rid long, doc_id long, held_out boolean, n long, known long, logs double, classes double, word long, times int"
        spread = np.log10(self.class_tokens + ALPHA * (self.class_words + 1))
        rows = materialize(self.docs.mapInArrow(score_rows(self.model, self.classes, spread, self.head), kinds), "scores")
        rare = rows.where("word IS NOT NULL").select("rid", "word", "times").join(self.counts, "word", "left")
        rare = rare.groupBy("rid").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more"),
                                       F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + ALPHA)).alias("rest")).withColumnRenamed("rid", "_rid")
        out = rows.where("word IS NULL").join(rare, F.col("rid") == F.col("_rid"), "left")
        logs = F.col("logs") + F.coalesce("rest", F.lit(0.0))
        each = float(np.log10(self.n + ALPHA * (self.v + 1)))
        return out.select("doc_id", "held_out", F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
                          F.lit(self.n).cast("long").alias("train_tokens"), (logs - F.col("n") * each).alias("base_score"), (logs + F.col("classes")).alias("score"))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(True))


def score_rows(model: Hmm, classes: int, spread: np.ndarray, head: tuple[np.ndarray, np.ndarray]):
    """Arrow batches of documents to a row each, with what the model and the frequent words give, and a row for each rare word of each."""
    words, counts = head
    none = lambda t, n: pa.nulls(n, t)
    names = ["rid", "doc_id", "held_out", "n", "known", "logs", "classes", "word", "times"]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 33  # numbers the rows of this attempt's output, which is written once
        for b in batches:
            found, own = [], np.arange(rid, rid + b.num_rows)
            for hashes, count in tokens(binary(b["text"])):
                d = len(count)
                which = np.repeat(np.arange(d), count)
                place = np.minimum(np.searchsorted(words, hashes), max(len(words) - 1, 0))
                known = words[place] == hashes if len(words) else np.zeros(len(hashes), bool)
                logs = np.bincount(which[known], weights=np.log10(counts[place[known]] + ALPHA), minlength=d) if len(words) else np.zeros(d)
                cls = class_of(hashes, classes)
                found.append((count, np.bincount(which[known], minlength=d), logs, np.bincount(which, weights=spread[cls], minlength=d), cls.astype(class_type(classes))))
                rare = np.stack([which[~known].astype(np.uint64), hashes[~known]], axis=1)
                order = np.lexsort([rare[:, 1], rare[:, 0]])
                rare = rare[order]
                if len(rare):
                    new = np.ones(len(rare), bool)
                    new[1:] = (rare[1:] != rare[:-1]).any(1)
                    start = np.flatnonzero(new)
                    times = np.diff(np.append(start, len(rare))).astype(np.int32)
                    n = len(start)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rid + rare[start, 0].astype(np.int64)), *[none(t, n) for t in kinds[1:7]], pa.array(rare[start, 1].copy().view(np.int64)), pa.array(times)], names=names)
                rid += d
            if found:
                count, known, logs, spreads, cls = (np.concatenate(f) for f in zip(*found))
                by_class = log_likelihoods(model, cls, count) / np.log(10) - spreads
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own), b["doc_id"], b["held_out"], pa.array(count.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(logs), pa.array(by_class),
                     none(kinds[7], len(own)), none(kinds[8], len(own))], names=names)

    return run


def op7_hmm_score(spark, sf_dir: str) -> DataFrame:
    return HmmModel(read(spark, sf_dir, "documents")).scores()
