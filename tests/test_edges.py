"""Hand-computed edge cases and algebraic properties (small in-memory inputs)."""

import random

import pytest
from pyspark.sql import functions as F

from pitchlens.functions.decide import argmax_first
from pitchlens.functions.odds import odds_to_prob_1x2, odds_to_prob_uo, replace_sentinels
from pitchlens.operators import clean, encode, folds, impute
from pitchlens.operators.bets import match_event
from pitchlens.operators.budget import budget_fold
from pitchlens.sources.payloads import extract_key_values, parse_statistics


def test_bins_edges(spark):
    # donors: pair (tiri) known at minutes 3, 10, 12, 90; target rows missing
    donors = spark.createDataFrame(
        [(3, 100.0, 100.0), (10, 2.0, 4.0), (12, 6.0, 8.0), (90, 10.0, 20.0)],
        "minute int, home_tiri double, away_tiri double")
    means = {r["bin"]: r["mean_tiri"] for r in impute.bin_means(donors).collect()}
    # minute 10 is on an inner edge: it counts in bins 5 and 10
    assert means[5] == pytest.approx((2.0 + 4.0) / 2)
    assert means[10] == pytest.approx(((2 + 6) / 2 + (4 + 8) / 2) / 2)
    assert means[85] == pytest.approx(15.0)
    assert 0 not in means
    target = spark.createDataFrame(
        [(4, None, 1.0), (10, None, 1.0), (14, 5.0, None), (90, None, None), (95, None, 2.0)],
        "minute int, home_tiri double, away_tiri double")
    out = {r["minute"]: (r["home_tiri"], r["away_tiri"])
           for r in impute.apply_bin_means(target, impute.bin_means(donors)).collect()}
    assert out[4] == (None, 1.0)          # below 5: not imputed
    assert out[10] == (means[10],) * 2    # later bin wins: 10, not 5
    assert out[14] == (means[10],) * 2    # both sides overwritten
    assert out[90] == (15.0, 15.0)        # 90 takes bin 85
    assert out[95] == (None, 2.0)         # above 90: not imputed


def test_possession_fill(spark):
    df = spark.createDataFrame([(40, None, 60.0), (41, 55.0, 45.0)],
                               "minute int, home_possesso_palla double, away_possesso_palla double")
    out = impute.apply_bin_means(df, impute.bin_means(df)).orderBy("minute").collect()
    assert (out[0][1], out[0][2]) == (50.0, 50.0)
    assert (out[1][1], out[1][2]) == (55.0, 45.0)


def test_odds_sentinels_and_probabilities(spark):
    df = spark.createDataFrame([(0.0, 1.8, 0.0, 3.2, 4.0), (2.1, 1.7, 1.5, 3.9, 6.5)],
                               "odd_over double, odd_under double, odd_1 double, odd_X double, odd_2 double")
    s = replace_sentinels(df)
    first = s.first()
    assert first["odd_over"] == 2.0 and first["odd_1"] == 3.0
    for r in odds_to_prob_uo(s).collect():
        assert r["odd_over"] + r["odd_under"] == pytest.approx(1.0)
    for r in odds_to_prob_1x2(s).collect():
        assert r["odd_1"] + r["odd_X"] + r["odd_2"] == pytest.approx(1.0)


def test_argmax_first_index_wins(spark):
    df = spark.createDataFrame([(0.4, 0.4, 0.2), (0.2, 0.4, 0.4), (0.1, 0.2, 0.7)], "a double, b double, c double")
    got = [r[0] for r in df.select(argmax_first([F.col("a"), F.col("b"), F.col("c")])).collect()]
    assert got == [0, 1, 2]


def test_dedupe_keeps_first_minute_and_nulls_equal(spark):
    df = spark.createDataFrame([("a", 1, None, 10), ("a", 1, None, 5), ("a", 2, None, 7)],
                               "id_partita string, home_score int, x double, minute int")
    out = sorted(tuple(r) for r in clean.dedupe_snapshots(df).collect())
    assert out == [("a", 1, None, 5), ("a", 2, None, 7)]
    again = sorted(tuple(r) for r in clean.dedupe_snapshots(clean.dedupe_snapshots(df)).collect())
    assert again == out


def test_over_filters(spark):
    df = spark.createDataFrame([("a", 1, 2, 1), ("a", 2, None, 1), ("b", 1, 0, 0), ("a", 3, 1, 1)],
                               "id_partita string, minute int, home_score int, away_score int")
    assert clean.drop_over_rows(df).count() == 3           # unknown goals kept
    assert {r[0] for r in clean.drop_over_matches(df).collect()} == {"b"}


def test_smooth_mean_unseen_gets_global(spark):
    train = spark.createDataFrame([("x", 1, 1), ("x", 2, 2), ("y", 0, 0), (None, 3, 3)],
                                  "campionato string, home_final_score int, away_final_score int")
    state = encode.smooth_mean(train, "campionato", encode.total_goals_target(), m=10)
    rows = {r["campionato"]: r for r in state.collect()}
    glob = (2 + 4 + 0 + 6) / 4
    assert rows["x"]["smooth"] == pytest.approx((2 * 3 + 10 * glob) / 12)
    assert None not in rows
    test = spark.createDataFrame([("x",), ("z",), (None,)], "campionato string")
    out = [r[0] for r in encode.encode_category(test, state, "campionato").collect()]
    assert sorted(out) == pytest.approx(sorted([(2 * 3 + 10 * glob) / 12, glob, glob]))


def test_folds_disjoint_by_match(spark, sf):
    from pitchlens import fixtures as fx
    from pitchlens.functions.masks import mask_all
    f = folds.grouped_folds(fx.snap(spark, sf), mask_all(), 5)
    assert f.count() == f.select("id_partita").distinct().count()
    assert {r[0] for r in f.select("fold").distinct().collect()} <= set(range(5))
    sizes = [r["count"] for r in f.groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_rank_is_the_place_in_the_order(spark):
    from pitchlens.operators.rank import with_rank
    rows = [((i * 7919) % 101, str(i % 3)) for i in range(500)] + [(None, "x")]
    df = spark.createDataFrame(rows, "a int, b string").repartition(7)
    got = sorted((r["rank"], r["a"], r["b"]) for r in with_rank(df, ["a", "b"]).collect())
    assert [g[0] for g in got] == list(range(501))
    assert [(a is not None, a or 0, b) for _, a, b in got] == sorted((a is not None, a or 0, b) for a, b in rows)
    assert with_rank(df.where("false"), ["a"]).count() == 0


def test_match_event_contains_semantics(spark):
    events = spark.createDataFrame([(1, "club_12 v club_7"), (2, "club_1 v club_3"), (3, "abc v def")],
                                   "event_id long, event_name string")
    preds = spark.createDataFrame([("club_1", "zzz"), ("qqq", "club_3"), ("qqq", "www"), ("CLUB_7", "x")],
                                  "home string, away string")
    got = {(r["home"], r["away"]): r["event_id"] for r in match_event(preds, events).collect()}
    # 'club_1' is inside 'club_12 v club_7' (event 1), which comes first
    assert got[("club_1", "zzz")] == 1
    assert got[("qqq", "club_3")] == 2
    assert got[("qqq", "www")] is None
    assert got[("CLUB_7", "x")] == 1


def test_extract_key_values_nested(spark):
    doc = '{"a": {"k": 1, "z": [{"k": "s"}]}, "k": 2, "q": {"k": {"k": true}}, "kk": 5}'
    df = spark.createDataFrame([(1, doc)], "id int, props string")
    got = [r["value"] for r in extract_key_values(df, "k", "props", ("id",)).orderBy("pos").collect()]
    assert got == ["1", "s", "2", "true"]


def test_extract_key_values_compares_keys_exactly(spark):
    doc = '{"axb": 1, "a.b": 2, "x\\"k": 3, "k": "q\\"uo\\u00e9", "s": "\\"k\\": 9", "a\\\\": 4}'
    df = spark.createDataFrame([(1, doc)], "id int, props string")
    find = lambda k: [r["value"] for r in extract_key_values(df, k, "props", ("id",)).orderBy("pos").collect()]
    assert (find("a.b"), find("k"), find('x"k'), find("a\\")) == (["2"], ['q"uoé'], ["3"], ["4"])


def test_statistics_defaults(spark):
    doc = ('{"api": {"statistics": {"Ball Possession": {"home": "45%", "away": null}, '
           '"Total Shots": {"home": "7", "away": null}}}}')
    df = spark.createDataFrame([("a", 1, doc), ("b", 2, '{"api": {"statistics": {}}}'), ("c", 3, '{"api": {}}')],
                               "id_partita string, minute int, payload string")
    rows = parse_statistics(df).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["home_possesso_palla"], r["away_possesso_palla"]) == (45, 50)
    assert (r["home_tiri"], r["away_tiri"], r["home_falli"]) == (7, 0, 0)


def _budget_sequential(rows, init):
    """Row after row: the balance before restores or drops, the one after allows the reset."""
    out, state = {}, {}
    for s, k, check, use, eligible, exposed, up, after in sorted(rows, key=lambda r: (r[0], r[1])):
        h, l = state.get(s, init)
        if exposed and up:
            h, l = init
        empty = (check == "high" and h == 0) or (check == "low" and l == 0)
        ok = exposed and eligible and not empty
        out[(s, k)] = (h, l, empty, ok)
        if ok:
            h, l = (h - 1, l) if use == "high" else (h, l - 1)
            if h + l == 0 and after:
                h, l = 1, 2
        state[s] = (h, l)
    return out


@pytest.mark.parametrize(("seed", "init", "block", "odds"), [
    (0, (1, 2), 4096, (0.95, 0.05, 0.9)), (1, (6, 1), 1, (1, 0, 1)), (2, (6, 1), 7, (0.9, 0.02, 0.5)),
    (3, (0, 4), 3, (1, 0, 0.1)), (4, (5, 5), 64, (1, 0.01, 0.3)), (5, (2, 0), 50, (0.8, 0.1, 0.8))])
def test_budget_fold_equals_sequential(spark, seed, init, block, odds):
    """Any budget, blocks of any length, long spells below zero without exposure."""
    r = random.Random(seed)
    rows = [(f"d{r.randrange(3)}", i, r.choice(["high", "low"]), r.choice(["high", "low", "high"]), r.random() < 0.8,
             *[r.random() < p for p in odds]) for i in range(300)]
    df = spark.createDataFrame(rows, "s string, k int, tier_check string, tier_use string, eligible boolean, "
                                     "exposure_ok boolean, balance_up boolean, exposure_after boolean").repartition(5)
    got = {(x["s"], x["k"]): (x["budget_high"], x["budget_low"], x["budget_empty"], x["accepted"])
           for x in budget_fold(df, "s", ["k"], {"high": init[0], "low": init[1]}, ["k"], block_rows=block).collect()}
    assert got == _budget_sequential(rows, init)


def test_backfill_sets_all_snapshots_of_finished_open_fixtures(spark):
    from pitchlens.sources.files import backfill_outcomes
    saved = spark.createDataFrame(
        [(1, 10, 0, 0), (1, 20, None, None), (2, 10, None, None), (3, 10, 1, 1)],
        "fixture_id long, minute int, home_final_score int, away_final_score int")
    results = spark.createDataFrame(
        [(1, "Match Finished", 2, 1), (2, "Second Half", 0, 0), (3, "Match Finished", 5, 5)],
        "fixture_id long, status string, goalsHomeTeam int, goalsAwayTeam int")
    got = sorted(tuple(r) for r in backfill_outcomes(saved, results).collect())
    # fixture 1 is open and finished: both rows rewritten; 2 is not finished;
    # 3 has no open row, so it is left alone
    assert got == [(1, 10, 2, 1), (1, 20, 2, 1), (2, 10, None, None), (3, 10, 1, 1)]


def _brute_impute(donors, targets):
    """Plain-Python statement of the bin rule: a target at minute t uses the
    largest m in 5, 10, ..., 85 with m <= t <= m + 5; the value is the mean of
    the home mean and the away mean over donors with both sides known and
    m <= minute <= m + 5; with no bin the row is left as it is."""
    out = []
    for t, h, a in targets:
        if h is not None and a is not None:
            out.append((t, h, a))
            continue
        bins = [m for m in range(5, 90, 5) if m <= t <= m + 5]
        if not bins:
            out.append((t, h, a))
            continue
        m = bins[-1]
        pool = [(dh, da) for dm, dh, da in donors if m <= dm <= m + 5 and dh is not None and da is not None]
        if not pool:
            out.append((t, None, None))
            continue
        v = (sum(p[0] for p in pool) / len(pool) + sum(p[1] for p in pool) / len(pool)) / 2
        out.append((t, v, v))
    return out


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_impute_equals_brute_force(spark, seed):
    rnd = random.Random(seed)

    def val():
        return None if rnd.random() < 0.3 else float(rnd.randint(0, 20))

    donors = [(rnd.randint(0, 95), val(), val()) for _ in range(300)]
    targets = [(i, val(), val()) for i in range(0, 96)] + [(rnd.randint(0, 95), val(), val()) for _ in range(100)]
    schema = "minute int, home_tiri double, away_tiri double"
    d = spark.createDataFrame(donors, schema)
    tg = spark.createDataFrame([(i, *r) for i, r in enumerate(targets)], "rid int, " + schema)
    got = {r["rid"]: (r["minute"], r["home_tiri"], r["away_tiri"])
           for r in impute.apply_bin_means(tg, impute.bin_means(d)).collect()}
    want = _brute_impute(donors, targets)
    for i, w in enumerate(want):
        g = got[i]
        assert g[0] == w[0]
        for x, y in zip(g[1:], w[1:]):
            assert (x is None and y is None) or x == pytest.approx(y)


def test_match_event_equals_brute_force(spark):
    rnd = random.Random(7)
    alphabet = "ab_1 "
    teams = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 4))).strip() or "a" for _ in range(40)]
    events = [(i, f"{rnd.choice(teams)} v {rnd.choice(teams)}") for i in range(60)]
    preds = [(rnd.choice(teams), rnd.choice(teams)) for _ in range(80)]
    ev = spark.createDataFrame(events, "event_id long, event_name string")
    pr = spark.createDataFrame([(i, *p) for i, p in enumerate(preds)], "pid int, home string, away string")
    got = {r["pid"]: r["event_id"] for r in match_event(pr, ev).collect()}
    for i, (h, a) in enumerate(preds):
        first_h = next((e for e, n in events if h.lower() in n), None)
        first_a = next((e for e, n in events if a.lower() in n), None)
        assert got[i] == (first_h if first_h is not None else first_a)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join_with_hot_key(spark, how):
    from pitchlens.operators.joins import salted_join
    big = spark.createDataFrame([("hot" if i % 3 else f"k{i % 50}", i) for i in range(600)], "k string, v int")
    small = spark.createDataFrame([("hot", 1.5), ("k3", 2.5), ("zz", 9.0)], "sk string, x double")
    got = sorted(tuple(r) for r in salted_join(big, small, ["k"], ["sk"], how, salts=8).collect())
    want = sorted(tuple(r) for r in big.join(small, big["k"] == small["sk"], how).collect())
    assert got == want


def test_lookup_join_with_hot_key_runs_no_job_while_planned(spark):
    from pitchlens.operators.joins import lookup_join
    big = spark.createDataFrame([("hot" if i % 3 else f"k{i % 50}", i) for i in range(300)], "k string, v int")
    small = spark.createDataFrame([("hot", 1.5), ("k3", 2.5)], "sk string, x double")
    for how in ("left", "left_anti"):
        got = sorted(tuple(r) for r in lookup_join(big, small, ["k"], ["sk"], how).collect())
        want = sorted(tuple(r) for r in big.join(small, big["k"] == small["sk"], how).collect())
        assert got == want


def test_stake_and_rules_hand_computed(spark):
    from pitchlens.operators import bets as bt
    df = spark.createDataFrame(
        [("Back", 2.5, 4.0), ("Back", 2.5, 50.0), ("Lay", 1.5, 100.0), ("Lay", 3.0, 3.0)],
        "side string, odd double, avail double")
    size, true_odd = bt.stake(F.col("side"), F.col("odd"), F.col("avail"), 10.0)
    got = [tuple(r) for r in df.select(size, true_odd).collect()]
    # back: min(avail, bet); lay: min(avail, ceil(bet / (odd - 1))), risk odd before the floor
    assert got == [(4.0, 2.5), (10.0, 2.5), (20.0, 3.0), (3.0, 1.3)]
    rules = spark.createDataFrame(
        [("uo", "under", 0, 0, 50), ("uo", "under", 1, 0, 50), ("uo", "under", 0, 0, 40),
         ("uo", "over", 2, 0, 30), ("uo", "over", 1, 0, 30), ("uo", "over", 2, 1, 60),
         ("ef", "X", 0, 0, 10), ("ef", "1", 1, 0, 10), ("ef", "1", 1, 1, 10), ("ef", "2", 0, 1, 10)],
        "bt string, p string, h int, a int, m int")
    reasons = [r[0] for r in rules.select(bt.rule_reject(F.col("bt"), F.col("p"), F.col("h"), F.col("a"),
                                                         F.col("m"))).collect()]
    assert reasons == [None, "under_scored", "under_first_half", None, "over_low_score", "over_second_half",
                       "draw", None, "not_leading", None]
    tiers = [r[0] for r in spark.createDataFrame([(3.5,), (3.0,)], "o double")
             .select(bt.risk_tier(F.col("o"), 3.0)).collect()]
    assert tiers == ["high", "low"]


def test_odds_payload_defaults_and_last_label_wins(spark):
    from pitchlens.sources.payloads import parse_odds_uo
    doc = ('{"api": {"odds": [{"bookmakers": [{"bets": [{"values": ['
           '{"value": "Over 2.5", "odd": "1.9"}, {"value": "Over 1.5", "odd": "1.2"}, '
           '{"value": "Over 2.5", "odd": "2.05"}]}]}, {"bets": [{"values": [{"value": "Under 2.5", "odd": "9"}]}]}]}]}}')
    df = spark.createDataFrame([("a", 1, doc), ("b", 2, '{"api": {}}')], "id_partita string, minute int, payload string")
    got = {r["id_partita"]: (r["odd_over"], r["odd_under"]) for r in parse_odds_uo(df).collect()}
    assert got["a"] == (2.05, 0.0)     # later duplicate wins; second bookmaker ignored
    assert got["b"] == (0.0, 0.0)      # no odds offered: 0 = missing


def test_numbered_files_by_name(spark, tmp_path):
    from pitchlens.sources import files as fl
    schema = fl.csv_schema(["id_partita", "x"])
    assert fl.read_numbered_files(spark, str(tmp_path / "none"), schema).count() == 0
    for n in (1, 2, 10):
        (tmp_path / f"stats{n}.csv").write_text(f",id_partita,x\n0,m{n},{n}.5\n1,k{n},nan\n")
    (tmp_path / "notes.txt").write_text("no number")
    read = lambda which: sorted(tuple(r) for r in fl.read_numbered_files(spark, str(tmp_path), schema, which).collect())
    assert read("latest") == [("k10", None), ("m10", 10.5)]
    assert [r[0] for r in read("older")] == ["k1", "k2", "m1", "m2"] and len(read("all")) == 6
    got = fl.read_numbered_files(spark, str(tmp_path), schema, number_col="n")
    assert {(r["id_partita"], r["n"]) for r in got.collect()} == {(f"{c}{n}", n) for c in "mk" for n in (1, 2, 10)}
    (tmp_path / "stats11.csv").write_text(",id_partita,x\n0,m,oops\n")
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST|oops"):
        fl.read_numbered_files(spark, str(tmp_path), schema, "latest").collect()


def test_result_model_features_and_missing_values(spark, sf):
    from pitchlens import fixtures as fx
    from pitchlens.plans import model as mdl
    from pitchlens.plans.preprocess import feature_cols, prep_train_result
    tr = prep_train_result(fx.as_raw(fx.snap(spark, sf)))
    feats = feature_cols(tr, "result")
    assert not {"result", "campionato", "home_final_score"} & set(feats) and "result_strongness" in feats
    m = mdl.fit(tr, feats, "result", {"maxIter": 2, "maxDepth": 2})
    some = tr.limit(20).withColumn(feats[1], F.lit(None).cast("double"))
    got = mdl.score(m, some, ["id_partita"]).collect()
    assert len(got) == 20 and all(abs(r["probability_1"] + r["probability_X"] + r["probability_2"] - 1) < 1e-9 for r in got)


def test_nothing_stays_cached(spark, sf):
    import pitchlens.plans.extra  # noqa: F401
    from pitchlens.plans.catalog import REGISTRY
    for name in ("drop_over_matches", "split_test", "match_event"):
        REGISTRY[name](spark, sf).count()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def test_backfill_leaves_other_months_alone(spark, tmp_path):
    import os
    from pitchlens.sources.files import backfill_stored, store_matches
    path = str(tmp_path / "matches")
    rows = [(1, 10, "2024-01-05", None, None), (1, 20, "2024-01-05", None, None), (2, 10, "2024-01-06", 0, 1),
            (3, 10, "2024-02-01", 1, 1), (4, 10, "2024-03-01", None, None), (5, 10, None, None, None)]
    store_matches(spark.createDataFrame(rows, "fixture_id long, minute int, match_date string, home_final_score int, away_final_score int"), path)

    def files():
        return {(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    before = files()
    results = spark.createDataFrame([(1, "Match Finished", 2, 0), (3, "Match Finished", 9, 9), (4, "Second Half", 1, 0)],
                                    "fixture_id long, status string, goalsHomeTeam int, goalsAwayTeam int")
    assert backfill_stored(spark, path, results) == ["2024-01"]
    after = files()
    other = {k: v for k, v in before.items() if "2024-01" not in k[0]}
    assert other and other.items() <= after.items() and not {k for k in before if "2024-01" in k[0]} & set(after)
    got = sorted((tuple(r)[:5] for r in spark.read.parquet(path).select("fixture_id", "minute", "match_date", "home_final_score", "away_final_score").collect()), key=str)
    want = sorted([(1, 10, "2024-01-05", 2, 0), (1, 20, "2024-01-05", 2, 0), *rows[2:]], key=str)
    assert got == want
    assert backfill_stored(spark, path, results) == [] and files() == after  # nothing left to fill


def test_book_replies_first_book_and_odd_replies(spark):
    import json
    from pitchlens.sources.payloads import parse_book_replies
    runner = {"selectionId": 7, "lastPriceTraded": 1.9, "totalMatched": 50.0, "status": "ACTIVE", "removalDate": None, "adjustmentFactor": 2.5,
              "ex": {"availableToBack": [{"price": 1.8, "size": 9.0}, {"price": 1.7, "size": 99.0}], "availableToLay": [{"price": 0, "size": 3.0}], "tradedVolume": []}}
    gone = {"selectionId": 8, "status": "REMOVED", "removalDate": "2024-01-01T00:00:00Z", "ex": {"availableToBack": []}}
    books = [{"marketId": "1.1", "status": "OPEN", "runners": [runner, gone]}, {"marketId": "1.2", "runners": [{**runner, "selectionId": 99}]}]
    rows = [(1, json.dumps(books)), (2, "[]"), (3, None), (4, json.dumps([{"marketId": "1.3", "runners": []}])), (5, json.dumps([{"marketId": "1.4"}]))]
    got = [tuple(r) for r in parse_book_replies(spark.createDataFrame(rows, "market_id long, reply string")).orderBy("selection_id").collect()]
    assert got == [(1, 7, 1.8, 9.0, 1000.0, 3.0, 1.9, 50.0, "ACTIVE", None, 2.5),
                   (1, 8, 1.01, 1.01, 1000.0, 1.01, None, None, "REMOVED", "2024-01-01T00:00:00Z", None)]


def test_extract_key_escapes_nesting_and_text_that_looks_like_keys(spark):
    from pitchlens.sources.payloads import extract_key_values
    docs = [r'{"k": 1, "a": [{"k": "x\"y"}, [{"k": [1, {"k": true}]}]], "k": {"k": null}, "l": {"m": {"k": -2.5e3}}}',
            r'{"a": "say \"k\": 5, and {\"k\": 6}", "b": ["x", ":7", "k"], "k\\": 8, "kk": 9, "K": 10}',
            '{"k" :\n "line", "u": "\\u006b"}', "{}", "[]", None, '"k"', '{"k": "\\u00e9"}']
    df = spark.createDataFrame(list(enumerate(docs)), "i int, d string")
    got = [tuple(r) for r in extract_key_values(df, "k", "d", ("i",)).orderBy("i", "pos").collect()]
    assert got == [(0, 1, "1"), (0, 2, 'x"y'), (0, 3, "true"), (0, 4, "null"), (0, 5, "-2.5e3"), (2, 1, "line"), (7, 1, "é")]
    odd = spark.createDataFrame([('{"a\\"b": 1, "é": 2}',)], "d string")
    assert [r["value"] for r in extract_key_values(odd, 'a"b', "d", ()).collect()] == ["1"]
    assert [r["value"] for r in extract_key_values(odd, "é", "d", ()).collect()] == ["2"]
    escaped = spark.createDataFrame([('{"\\u006b": 3, "a": {"\\u006B": "v"}}',)], "d string")
    assert [r["value"] for r in extract_key_values(escaped, "k", "d", ()).collect()] == ["3", "v"]
