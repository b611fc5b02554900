"""Benchmark decontamination (native): documents that repeat word windows of a benchmark.

The windows of the benchmark (``window`` consecutive words; a shorter item is
one window) form the small side of a hash join, keyed by the hash of their
longest word.  Every word of every document probes that set in the stage that
scans the texts; where it is found, the document's window around it is compared
word by word.  Only hits and one row a document leave that stage, so the
shuffle is small and a passage that a third of all documents hold is spread
over the documents.

Defined results: null or wordless text has no words, no hits and is clean; a
null or wordless benchmark item has no window; a null ``doc_id`` is an id like
any other; a repeated row is returned as often as it stands there; a null
``item_id`` never shows in the item list; an empty benchmark hits nothing;
extra columns are ignored (:func:`hits`) or kept (:func:`drop_contaminated`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchlens.llm._text import ascii_lower, read
from pitchlens.session import materialize

NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The benchmark's windows are broadcast up to this many bytes of words; beyond, the join shuffles both sides.
BROADCAST_BYTES = 64 << 20


def words_of(text: Column) -> Column:
    """Runs of digits, letters a-z and code points beyond ASCII, lower-cased in A-Z; null text gives none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NO_WORD), "")


def benchmark_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """The distinct windows: win (its words), n (how many), items, and off, akey: place and hash of its longest word.

    The longest word is the window's key in the set: a document window can only
    equal it where that word stands, and long words are rare.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w"))
    items = items.where(F.size("w") > 0).withColumn("n", F.least(F.size("w"), F.lit(window)))
    starts = items.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)))
    wins = starts.groupBy(F.slice("w", F.col("at"), F.col("n")).alias("win"), "n").agg(F.collect_set("item").alias("items"))
    key = F.array_max(F.transform("win", lambda w, i: F.struct(F.length(w).alias("chars"), F.xxhash64(w).alias("akey"), i.alias("off"))))
    return wins.withColumn("key", key).select("win", "n", "items", "key.off", "key.akey")


def hits(documents: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """For each row of ``documents``: doc_id, text_key, n_words, starts (set of (at, n) of hits), items (sorted)."""
    wins = materialize(benchmark_windows(benchmark, window), "windows")
    cost = wins.agg(F.sum(F.octet_length(F.concat_ws(" ", "win")) + F.octet_length(F.concat_ws(" ", "items")) + 64)).first()[0] or 0
    docs = documents.select("doc_id", F.xxhash64("text").alias("text_key"), words_of(F.col("text")).alias("w"))
    # a first element that is no word: each document has one row more than words, hit or not
    rows = docs.select("doc_id", "text_key", F.size("w").alias("n_words"), "w",
                       F.posexplode(F.concat(F.array(F.lit("")), F.col("w"))).alias("pos", "word"))
    start = F.col("pos") - 1 - F.col("off")
    # the words decide, but only for rows whose hash is found: as an equality Spark would make them part of the join's key
    same = F.array_contains(F.array(F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("n"))), F.col("win"))
    found = rows.join(F.broadcast(wins) if cost <= BROADCAST_BYTES else wins,
                      (F.xxhash64("word") == F.col("akey")) & (start >= 0) & same, "left")
    first, hit = F.col("pos") == 0, F.col("win").isNotNull()
    found = found.where(first | hit).select(
        "doc_id", "text_key", "n_words", first.cast("long").alias("first"), F.when(hit, F.col("items")).alias("items"),
        F.when(hit, F.struct(start.alias("at"), F.col("n").alias("n"))).alias("start"))
    per = found.groupBy("doc_id", "text_key", "n_words").agg(
        F.sum("first").alias("copies"), F.collect_set("start").alias("starts"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return per.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copy", "copies")


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """doc_id, text_key, n_words, starts, items, n_hit, contaminated: one row for each row of ``documents``.

    A document is contaminated if it has a hit word and at least one word in ``share`` is hit.
    """
    per = hits(documents, benchmark, window)
    at = F.flatten(F.transform("starts", lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1)))
    per = per.withColumn("n_hit", F.size(F.array_distinct(at)).cast("long")).withColumn("n_words", F.col("n_words").cast("long"))
    return per.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """``documents`` (all its columns) without the contaminated rows."""
    bad = contamination(documents, benchmark, window, share).where("contaminated").select(
        F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key"))
    return documents.join(bad, documents["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(documents["text"]) == bad["bad_key"]), "left_anti")


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    per = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return per.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item, least(len(w), 13) AS n, w[p:p + least(len(w), 13) - 1] AS win
  FROM (SELECT item, w, unnest(generate_series(1, len(w) - least(len(w), 13) + 1)) AS p FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, p, w[p:p + n - 1] AS win
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT dw.r, dw.p, dw.n, bw.item FROM dw JOIN bw ON dw.win = bw.win),
c AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(generate_series(p, p + n - 1)) AS pos FROM h) GROUP BY r),
i AS (SELECT r, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN i USING (r)
"""
