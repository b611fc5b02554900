"""Spelling variants: words one edit apart, found by pivotal grams, and grouped under their commonest form.

A word's grams are its pairs of neighbouring code points, from the rarest in the
vocabulary to the commonest; its prefix holds the ``PREFIX`` first of them (and
those as common as the last).  Two pivots are chosen from a prefix, a before b
and without a shared code point.  One edit touches one of them at most: if it
lies behind a, the word's beginning up to a is as it was, otherwise the word's
end from b on is.  Of two near words, let the one whose prefix ends first (with
the rarer gram, then by the word) ask: its pivot that survives stands in the
other's prefix too, since that reaches at least as far.  So each word is
indexed by its beginnings and ends at the grams of its prefix, and asks once
with a's beginning and once with b's end for words of its length, one less and
one more; equal beginnings and ends fix the positions.  What is found is
verified by its edit distance.  Every pair is found exactly once: an end is
passed over where the beginning has found the pair.

The pivots are the pair for which the fewest words are expected to share
beginning or end, by a first-order chain of grams; a dynamic programme over the
places, which keeps the best pivot so far, chooses them.  Gram counts are all
that the driver gets, at most 8100 numbers, the square of 90 letters.  Spark
counts words, joins and groups; a common beginning is a key of a plain join,
which adaptive execution splits.

Forms are followed by pointer jumping: a form is at least twice as common as
its word, so there is no circle, and rounds grow with the logarithm of the
longest chain.

Defined results: null and empty texts and texts without letters have no words;
a null ``doc_id`` reads as the empty string where misspellings are made;
repeated rows count again; ties go to the word first in code-point order; an
empty table has no words; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchlens.llm._sql import CRC32, crc32
from pitchlens.llm._text import ascii_lower, read
from pitchlens.session import materialize

#: A word is a run of these.
LETTERS = "[A-Za-zÀ-ÿ]+"
#: Code points and occurrences that a word has at least, and how much commoner a form is.
SHORTEST, RAREST, TIMES = 5, 3, 2
#: Grams of a prefix; pivots need three at least.
PREFIX = 4


def misspelt(doc_id: Column, run: Column, every: int = 97) -> Column:
    """``run`` without one code point where ``every`` divides the checksum of id and run."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(documents: DataFrame, every: int = 97) -> DataFrame:
    """word, n: the words of all texts and how often they stand there."""
    runs = documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= SHORTEST).select("doc_id", ascii_lower(F.col("run")).alias("run"))
    words = runs.select(misspelt(F.col("doc_id"), F.col("run"), every).alias("word")).where(F.length("word") >= SHORTEST)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= RAREST)


class Chooser:
    """Prefix and pivots of a word, from the counts of all grams."""

    def __init__(self, counts: dict[str, int], size: int = PREFIX):
        self.size = size
        self.rank = {g: k for k, g in enumerate(sorted(counts, key=lambda g: (counts[g], g)))}
        before, after, total = {}, {}, sum(counts.values())
        for g, n in counts.items():
            before[g[0]] = before.get(g[0], 0) + n
            after[g[1]] = after.get(g[1], 0) + n
        self.both = {g: math.log(n / total) for g, n in counts.items()}
        self.next = {g: math.log(n / before[g[0]]) for g, n in counts.items()}
        self.last = {g: math.log(n / after[g[1]]) for g, n in counts.items()}

    def __call__(self, word: str) -> tuple[int, list[int], int, int]:
        """The rank at which the prefix ends, the places of its grams, and the places of both pivots."""
        grams = [word[i:i + 2] for i in range(len(word) - 1)]
        ends = sorted(self.rank[g] for g in grams)[min(self.size, len(grams)) - 1]
        places = [i for i, g in enumerate(grams) if self.rank[g] <= ends]
        begin, end = [self.both[grams[0]]], [self.both[grams[-1]]]  # how likely it is to share a beginning, an end
        for g in grams[1:]:
            begin.append(begin[-1] + self.next[g])
        for g in grams[-2::-1]:
            end.append(end[-1] + self.last[g])
        end.reverse()
        best, left, at = None, None, 0
        for b in places:
            while places[at] <= b - 2:  # the best first pivot of those that share nothing with b
                if left is None or begin[places[at]] < begin[left]:
                    left = places[at]
                at += 1
            if left is not None:
                cost = math.exp(begin[left]) + math.exp(end[b])
                if best is None or cost < best[0]:
                    best = cost, left, b
        return ends, places, best[1], best[2]


def chosen(counts: dict[str, int]):
    """Arrow batches of words, each with its prefix and pivots."""
    choose = Chooser(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [choose(w) for w in b["word"].to_pylist()]
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int32(), pa.list_(pa.int32()), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([b["word"], b["n"], *columns], names=["word", "n", "ends", "places", "a", "b"])

    return run


def beginning(word: str, at: Column) -> Column:
    return F.substring(word, F.lit(1), at + 2)


def ending(word: str, at: Column) -> Column:
    return F.substring(word, at + 1, F.length(word))


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, other, m: every two words that one inserted, deleted or replaced code point makes equal, once.

    words: word (different words of at least SHORTEST code points) and n.
    """
    grams = F.expr("transform(sequence(1, length(word) - 1), i -> substring(word, i, 2))")
    counts = {r["g"]: r["n"] for r in words.select(F.explode(grams).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 90 * 90
    words = materialize(words.mapInArrow(chosen(counts), "word string, n long, ends int, places array<int>, a int, b int"), "words")
    size = F.length("word")
    index = words.select("word", "n", "ends", F.explode("places").alias("at"))
    index = index.select(F.col("word").alias("other"), F.col("n").alias("m"), F.col("ends").alias("far"), size.alias("_size"), F.explode(F.array(F.struct(F.lit(True).alias("start"), beginning("word", F.col("at")).alias("part")), F.struct(F.lit(False).alias("start"), ending("word", F.col("at")).alias("part")))).alias("x"))
    index = index.select("other", "m", "far", "_size", F.col("x.start").alias("_start"), F.col("x.part").alias("_part"))
    first = beginning("word", F.col("a"))
    asked = words.select("word", "n", "ends", first.alias("first"), F.explode(F.array(F.struct(F.lit(True).alias("start"), first.alias("part")), F.struct(F.lit(False).alias("start"), ending("word", F.col("b")).alias("part")))).alias("x"))
    asked = asked.select("word", "n", "ends", "first", "x.start", "x.part", F.explode(F.array(size - 1, size, size + 1)).alias("size"))
    # the one whose prefix ends first asks
    order = (F.col("ends") < F.col("far")) | ((F.col("ends") == F.col("far")) & (F.col("word") < F.col("other")))
    same = (F.col("start") == F.col("_start")) & (F.col("part") == F.col("_part")) & (F.col("size") == F.col("_size"))
    once = F.col("start") | ~F.startswith("other", "first")
    return asked.join(index, same & order & once & (F.levenshtein("word", "other", 1) == 1)).select("word", "n", "other", "m")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where following ``forms`` (word, form) ends, for each of its words."""
    ways, moved = materialize(forms.select("word", F.col("form").alias("root")), "roots"), None
    while moved != 0:
        ahead = ways.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        ways = materialize(ways.join(ahead, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "roots")
        moved = ways.where("moved").count()
        ways = ways.select("word", "root")
    return ways


def variants(words: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root: a row for each word of ``words`` (word, n)."""
    words = materialize(words, "vocabulary")
    pairs = near_pairs(words)
    both = F.explode(F.array(F.struct("word", "n", F.col("other").alias("near"), F.col("m").alias("near_n")), F.struct(F.col("other").alias("word"), F.col("m").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
    best = pairs.select(both.alias("x")).select("x.*").groupBy("word").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    is_form = -F.col("best.less") >= TIMES * F.col("n")
    best = materialize(best.select(F.col("word").alias("_word"), "n_near", F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")), "forms")
    ends = roots(best.where("form is not null").select(F.col("_word").alias("word"), "form")).select(F.col("word").alias("_w"), F.col("root").alias("_root"))
    out = words.join(best, F.col("word") == F.col("_word"), "left").join(ends, F.col("word") == F.col("_w"), "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("_root", "word").alias("root"))


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(vocabulary(read(spark, sf_dir, "documents")))


#: In DuckDB's SQL, by every deletion of every word: two words are near where one is the other without a code point, or where both are equal without the same one.
ORACLE = f"""
WITH RECURSIVE {CRC32},
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS times FROM runs WHERE length(run) >= {SHORTEST} GROUP BY ALL),
hashed AS (SELECT run, times, {crc32("flatten([CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [195, ord(c) - 64] END for c in string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, '')])")} AS h FROM counted, crc32_table),
made AS (SELECT CASE WHEN h % 97 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, times FROM hashed),
words AS (SELECT word, sum(times)::BIGINT AS n FROM made WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(times) >= {RAREST}),
cuts AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
    SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION ALL SELECT DISTINCT c.word, c.n, w.word, w.n FROM cuts c JOIN words w ON w.word = c.rest
    UNION ALL SELECT DISTINCT w.word, w.n, c.word, c.n FROM cuts c JOIN words w ON w.word = c.rest),
best AS (SELECT word, any_value(n) AS n, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {TIMES} * w.n THEN near END AS form, CASE WHEN near_n >= {TIMES} * w.n THEN near_n END AS form_n FROM words w LEFT JOIN best USING (word)),
ways AS (SELECT word, word AS root FROM forms UNION ALL SELECT w.word, f.form FROM ways w JOIN forms f ON f.word = w.root WHERE f.form IS NOT NULL),
ends AS (SELECT w.word, w.root FROM ways w JOIN forms f ON f.word = w.root WHERE f.form IS NULL)
SELECT f.word, n, n_near, form, form_n, root FROM forms f JOIN ends e ON e.word = f.word
"""
