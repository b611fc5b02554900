"""Connected components of links between documents, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlens.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component): for each node of ``links`` (a, b) the smallest node it reaches.

    Alternating large and small stars: each node's larger neighbours, then its
    smaller ones, are linked to the smallest; the links shrink to stars in a
    number of rounds that grows with the logarithm of their number.  A node
    with very many links meets them as a grouped minimum and a join.
    """
    stars, seen = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links"), None
    while True:
        now = stars.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                stars.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        seen = now
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        small = large.join(least, F.col("u") == F.col("w"))
        small = small.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        stars = materialize(small.select("e.u", "e.v").where("u <> v").distinct(), "links")
