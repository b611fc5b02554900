"""What crosses a shuffle: narrow rows, and only those that need to."""

from collections import Counter

from pitchlens.sources import files as fl
from pitchlens.sources import payloads as pl


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_finished_snapshots_are_not_shuffled_to_be_backfilled(spark, tmp_path):
    # fixtures: 3 in 10 open, every 30th partly; 7 in 10 closed; one without id
    rows = [(i, m, None if i % 10 < 3 and (m or i % 30) else 7, 8) for i in range(3000) for m in range(2)]
    rows += [(None, 1, None, None), (None, 2, 4, 4)]
    kinds = "fixture_id long, minute int, home_final_score int, away_final_score int"
    spark.createDataFrame(rows, kinds).write.parquet(str(tmp_path / "saved"))
    done = {i: ("Match Finished" if i % 2 else "Second Half", i % 5, i % 4) for i in range(0, 3000)}
    spark.createDataFrame([(i, *r) for i, r in done.items()], "fixture_id long, status string, goalsHomeTeam int, goalsAwayTeam int").write.parquet(str(tmp_path / "results"))
    open_ids = {i for i, _, h, _ in rows if h is None and i is not None}
    want = [(i, m, done[i][1], done[i][2]) if i in open_ids and done[i][0] == "Match Finished" else (i, m, h, a) for i, m, h, a in rows]
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "6000")  # fewer bytes than the results have
    try:
        out = fl.backfill_outcomes(spark.read.parquet(str(tmp_path / "saved")), spark.read.parquet(str(tmp_path / "results")))
        assert "BroadcastHashJoin" in _plan(out)  # the finished snapshots stay where they are
        assert Counter(map(tuple, out.collect())) == Counter(want)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_fixture_documents_are_made_of_flat_rows(spark):
    rows = [(i, m, "2024-01-02", f"home {i}", None if i == 5 else "ÀWAY", "Serie A" if i % 3 else None, i % 4, None if i == 7 else 1) for i in range(150) for m in (3, 4, None)]
    snap = spark.createDataFrame([*rows, rows[0]], "fixture_id long, minute int, match_date string, home string, away string, campionato string, home_score int, away_score int")
    docs = pl.fixtures_payload(snap)
    gathered = [x for x in _plan(docs).splitlines() if "partial_collect_list" in x]
    assert gathered and not any("country" in x or "team_name" in x for x in gathered)
    assert docs.count() == 9
    want = Counter((i, "-".join([c] * 2) if c else "", d, m, h, a.lower() if a else None, hs, as_, f"{d}-{i}") for i, m, d, h, a, c, hs, as_ in [*rows, rows[0]])
    assert Counter(map(tuple, pl.parse_fixtures(docs).collect())) == want


def test_rows_are_not_sorted_to_be_written_by_month(spark, tmp_path, monkeypatch):
    rows = [(i, f"2024-{i % 12 + 1:02d}-05" if i % 13 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "fixture_id long, match_date string").coalesce(1)
    name, path = "spark.sql.maxConcurrentOutputFileWriters", str(tmp_path / "matches")
    held, seen = spark.conf.get(name), []
    real = type(df.write).parquet
    monkeypatch.setattr(type(df.write), "parquet", lambda w, *a, **k: (seen.append(int(spark.conf.get(name))), real(w, *a, **k)))
    fl.store_matches(df, path)
    assert seen and min(seen) >= 13 and spark.conf.get(name) == held
    assert Counter(map(tuple, spark.read.parquet(path).select("fixture_id", "match_date").collect())) == Counter(rows)
