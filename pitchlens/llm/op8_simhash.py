"""Document fingerprints (native): 128-bit SimHash, and a search by permuted block tables.

A text's terms are its stretches of three words (all its words if it has fewer),
weighted by how often they occur.  Each occurrence votes with the bits of the
term's hash; a bit of the fingerprint is set where most votes have it set.
Votes are counted two bits to a long, so a document's are 64 sums of one scan.

:func:`near_fingerprints` finds all fingerprints within ``radius`` bits: the
bits are cut into ``radius`` + 1 blocks, of which at least one is equal in any
such pair, and each block leads a table of its own, joined on that block.

:func:`with_next` gives each document its neighbour in descending order of
``doc_id``: ids alone are range-partitioned and numbered, so nothing but one row
a partition meets in one place; the texts are shuffled once, by their key (the id -2**63 stands for a null one).

Defined results: null text is empty; a text without words has no votes and the
fingerprint 0; a null ``doc_id`` comes after all others; rows with one id are in
order of a hash of their text, and the next document of a repeated row is its
copy, of the last copy the next other row; a single row is its own next; an
empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchlens.llm._text import NULL_ID, ascii_lower, id_key, read
from pitchlens.session import materialize

WORDS = 3
SALT = 20250601
LANES = (1 << 32) | 1


def term_hashes(words: Column, size: int = WORDS) -> Column:
    """Hashes of all stretches of ``size`` elements of an array of longs, of the whole array if it is shorter."""
    short = F.transform(F.slice(F.array(F.lit(0)), F.lit(1), F.least(F.size(words), F.lit(1))), lambda _: F.xxhash64(words))
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - size, F.lit(0)))
    return F.when(F.size(words) < size, short).otherwise(F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)])))


def fingerprints(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, f1, f2: the two halves of the fingerprint of ``text``, a row for each distinct key."""
    words = F.array_remove(F.split(ascii_lower(F.coalesce("text", F.lit(""))), "[\\x20\\x09-\\x0D]+"), "")
    rows = texts.select(*keys, words.alias("w")).select(*keys, F.transform("w", lambda w: F.xxhash64(w)).alias("h"))
    rows = rows.select(*keys, term_hashes(F.col("h")).alias("terms")).select(*keys, F.explode_outer("terms").alias("a"))
    rows = rows.withColumn("b", F.when(F.col("a").isNotNull(), F.xxhash64("a", F.lit(SALT))))
    votes = [F.coalesce(F.sum(F.shiftrightunsigned(h, j).bitwiseAND(F.lit(LANES))), F.lit(0)).alias(f"{h}{j}") for h in "ab" for j in range(32)]
    sums = rows.groupBy(*keys).agg(F.count("a").alias("all"), *votes)
    half = lambda h: reduce(Column.bitwiseOR, [
        F.when(2 * ones > F.col("all"), F.lit(_bit(j + up))).otherwise(F.lit(0).cast("long"))
        for j in range(32) for up, ones in ((0, F.col(f"{h}{j}").bitwiseAND(F.lit(0xFFFFFFFF))), (32, F.shiftrightunsigned(f"{h}{j}", 32)))])
    return sums.select(*keys, half("a").alias("f1"), half("b").alias("f2"))


def _bit(j: int) -> int:
    return 1 << j if j < 63 else -(1 << 63)


def likeness(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Share of equal bits of two fingerprints, 0 to 1."""
    return 1 - (F.bit_count(a1.bitwiseXOR(b1)) + F.bit_count(a2.bitwiseXOR(b2))) / 128.0


def as_text(f1: Column, f2: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(f1), 16, "0"), F.lpad(F.hex(f2), 16, "0")))


def near_fingerprints(queries: DataFrame, index: DataFrame, radius: int = 3) -> DataFrame:
    """(q1, q2, f1, f2): all pairs of a distinct fingerprint of ``queries`` and one of ``index`` that differ in at most ``radius`` bits.

    ``radius`` + 1 must divide 128; both tables have the halves as f1, f2.
    """
    if radius < 0 or 128 % (radius + 1):
        raise ValueError("radius + 1 must divide 128")
    bits = F.concat(F.lpad(F.bin("f1"), 64, "0"), F.lpad(F.bin("f2"), 64, "0"))
    size = 128 // (radius + 1)

    def tables(df: DataFrame) -> DataFrame:
        blocks = F.array(*[F.substring(bits, 1 + size * i, size) for i in range(radius + 1)])
        return df.select("f1", "f2").distinct().select("f1", "f2", F.posexplode(blocks).alias("table", "lead"))

    asked = tables(queries).select(F.col("f1").alias("q1"), F.col("f2").alias("q2"), F.col("table").alias("t"), F.col("lead").alias("l"))
    found = asked.join(tables(index), (F.col("t") == F.col("table")) & (F.col("l") == F.col("lead")))
    apart = F.bit_count(F.col("q1").bitwiseXOR(F.col("f1"))) + F.bit_count(F.col("q2").bitwiseXOR(F.col("f2")))
    return found.where(apart <= radius).select("q1", "q2", "f1", "f2").distinct()


def next_keys(documents: DataFrame) -> DataFrame:
    """For each distinct (id, tk): chars, copies, and the key (next_id, next_tk) of the next document, in descending order."""
    rows = documents.groupBy("id", "tk").agg(F.first("chars").alias("chars"), F.count(F.lit(1)).alias("copies"))
    dealt = rows.repartitionByRange("id", "tk").withColumn("part", F.spark_partition_id())
    dealt = materialize(dealt, "order")
    tops = dealt.groupBy("part").agg(F.max(F.struct("id", "tk")).alias("top"))
    down = Window.orderBy(F.col("part").desc())  # one row a partition
    tops = tops.select("part", F.coalesce(F.lead("top").over(down), F.first("top").over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("below"))
    own = Window.partitionBy("part").orderBy(F.col("id").desc(), F.col("tk").desc())
    dealt = dealt.withColumn("after", F.lead(F.struct("id", "tk")).over(own)).join(F.broadcast(tops), "part")
    after = F.coalesce("after", "below")
    return dealt.select("id", "tk", "chars", "copies", after["id"].alias("next_id"), after["tk"].alias("next_tk"))


def with_next(documents: DataFrame) -> DataFrame:
    """id, tk, nth, doc_id, text, chars, edited, next_id, next_tk: each row with its text, its last third replaced by the next row's start."""
    text = F.coalesce("text", F.lit(""))
    docs = documents.select(id_key(F.col("doc_id").cast("long")).alias("id"), text.alias("text"), F.xxhash64(text).alias("tk"))
    keys = materialize(next_keys(docs.select("id", "tk", F.length("text").alias("chars"))), "next")
    same = Window.partitionBy("id", "tk").orderBy(F.lit(0))
    docs = docs.withColumn("nth", F.row_number().over(same))
    asked = keys.select(F.col("next_id").alias("id"), F.col("next_tk").alias("tk"), F.col("id").alias("for_id"), F.col("tk").alias("for_tk"), F.floor(F.col("chars") / 3).cast("int").alias("third"))
    # both joins read the same columns, and no limit by row number reaches below the window: so the texts are shuffled once for both
    starts = docs.where(F.col("nth").cast("string") == "1").join(asked, ["id", "tk"]).select("for_id", "for_tk", F.expr("substring(text, 1, third)").alias("start"))
    both = docs.join(keys, ["id", "tk"]).join(starts, (F.col("id") == F.col("for_id")) & (F.col("tk") == F.col("for_tk")))
    copy_next = F.col("nth") < F.col("copies")
    kept = F.expr("substring(text, 1, chars - cast(floor(chars / 3) AS int))")
    start = F.when(copy_next, F.expr("substring(text, 1, cast(floor(chars / 3) AS int))")).otherwise(F.col("start"))
    return both.select("id", "tk", "nth", F.nullif("id", F.lit(NULL_ID)).alias("doc_id"), "text", "chars", F.concat(kept, start).alias("edited"),
                       F.when(copy_next, F.col("id")).otherwise(F.col("next_id")).alias("next_id"), F.when(copy_next, F.col("tk")).otherwise(F.col("next_tk")).alias("next_tk"))


def edited_likeness(documents: DataFrame, radius: int = 3, every: int = 100) -> DataFrame:
    """Per row its fingerprints and likenesses; n_near: for ids divisible by ``every``, the distinct fingerprints within ``radius`` bits (its own too)."""
    rows = with_next(documents)
    facts = ["id", "tk", "nth", "doc_id", "chars", "edited_sha256", "next_id", "next_tk"]
    texts = rows.withColumn("edited_sha256", F.sha2("edited", 256)).select(*facts, F.posexplode(F.array("text", "edited")).alias("which", "text"))
    found = fingerprints(texts, [*facts, "which"])  # the rows of a document are where the join has put them
    pick = lambda f, w: F.max(F.when(F.col("which") == w, F.col(f)))
    found = materialize(found.groupBy(*facts).agg(pick("f1", 0).alias("f1"), pick("f2", 0).alias("f2"), pick("f1", 1).alias("e1"), pick("f2", 1).alias("e2")), "fingerprints")
    after = found.where("nth = 1").select(F.col("id").alias("n_id"), F.col("tk").alias("n_tk"), F.col("f1").alias("n1"), F.col("f2").alias("n2"))
    out = found.join(after, (F.col("next_id") == F.col("n_id")) & (F.col("next_tk") == F.col("n_tk")))
    near = near_fingerprints(found.where(F.col("doc_id") % every == 0), found, radius).groupBy("q1", "q2").agg(F.count(F.lit(1)).alias("n_near"))
    out = out.join(near, (F.col("f1") == F.col("q1")) & (F.col("f2") == F.col("q2")), "left")
    c = F.col
    return out.select("doc_id", c("chars").cast("long").alias("n_chars"), "edited_sha256", as_text(c("f1"), c("f2")).alias("fingerprint"), as_text(c("e1"), c("e2")).alias("edited_fingerprint"),
                      likeness(c("f1"), c("f2"), c("e1"), c("e2")).alias("near_edited"), likeness(c("f1"), c("f2"), c("n1"), c("n2")).alias("near_next"),
                      F.when(c("doc_id") % every == 0, c("n_near")).alias("n_near"))


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    return edited_likeness(read(spark, sf_dir, "documents"))
