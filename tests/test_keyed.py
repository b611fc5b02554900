"""Keyed state of the live loop against the batch operator, after every poll, over restarts, and its expiry."""

from pitchlens.operators.latest import latest_per_match
from pitchlens.session import scratch_dir
from pitchlens.streaming import keyed

SCHEMA = "id_partita string, date string, minute int, home string, home_tiri double, away_tiri double, home_score int"
DAY = "2024-05-01T13:00:00+00:00"
POLLS = [
    [("a", DAY, 10, "reds", 1.0, None, 0), ("b", DAY, 12, "blues", None, 2.0, 1)],
    [("a", DAY, 20, "reds", None, 3.0, 0), ("c", DAY, 5, None, None, None, None)],
    [("b", DAY, 30, None, 5.0, None, None), ("a", DAY, 15, "old", 9.0, 9.0, 9), ("a", DAY, 25, None, None, None, 2)],
]


def poll(spark, folder, check, rows):
    """One poll by a stream of its own, which goes on from the checkpoint; the rows it gives, and the matches it holds."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    sink = scratch_dir(spark, "sink")
    q = keyed.newest_values(spark.readStream.schema(SCHEMA).parquet(folder)).writeStream.foreachBatch(
        lambda b, n: b.write.mode("append").parquet(sink)).outputMode("update").option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    return spark.read.parquet(sink).collect(), held[-1]


def test_state_is_the_batch_result_after_every_poll(spark):
    folder, check, kept = scratch_dir(spark, "polls"), scratch_dir(spark, "ck"), {}
    for k, rows in enumerate(POLLS):
        found, _ = poll(spark, folder, check, rows)
        cols = ["id_partita", "minute", "home", "home_tiri", "away_tiri", "home_score"]
        kept |= {r["id_partita"]: tuple(r[c] for c in cols) for r in found}
        so_far = spark.createDataFrame([r for p in POLLS[:k + 1] for r in p], SCHEMA).drop("date")
        assert kept == {r["id_partita"]: tuple(r[c] for c in cols) for r in latest_per_match(so_far).collect()}, k


def test_matches_long_past_are_forgotten(spark):
    folder, check = scratch_dir(spark, "polls"), scratch_dir(spark, "ck")
    assert poll(spark, folder, check, POLLS[0])[1] == 2
    poll(spark, folder, check, [("z", "2024-05-09", 1, "x", 1.0, 1.0, 0)])
    found, held = poll(spark, folder, check, [("z", "2024-05-09", 2, "x", 2.0, 1.0, 0), ("a", DAY, 50, "late", 7.0, 7.0, 7)])
    assert held == 1 and [(r["id_partita"], r["minute"]) for r in found] == [("z", 2)]
