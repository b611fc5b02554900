"""Registered queries for sources, bet decisions, models and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..schema import KEY
from ..sources import payloads as pl
from .catalog import query


# ------------------------------------------------------------ JSON payloads
@query("json_fixtures")
def q_json_fixtures(spark, sf):
    """Live-fixture documents (pages per minute) back to snapshot keys."""
    return pl.parse_fixtures(pl.fixtures_payload(fx.snap(spark, sf)))


@query("json_labels")
def q_json_labels(spark, sf):
    """Label documents to a label -> id lookup (last id wins)."""
    return pl.parse_labels(pl.labels_payload(fx.table(spark, sf, "part")))


@query("json_odds_uo")
def q_json_odds_uo(spark, sf):
    """over/under odds per snapshot from odds documents; missing = 0."""
    from ..schema import UO_LABELS
    docs = pl.odds_payload(fx.snap(spark, sf), UO_LABELS, "Over 1.5")
    return pl.parse_odds_uo(docs)


@query("json_odds_1x2")
def q_json_odds_1x2(spark, sf):
    """1X2 odds per snapshot from odds documents; missing = 0."""
    from ..schema import X12_LABELS
    docs = pl.odds_payload(fx.snap(spark, sf), X12_LABELS, "Home/Draw")
    return pl.parse_odds_1x2(docs)


@query("json_statistics")
def q_json_statistics(spark, sf):
    """Statistics documents to 26 columns; empty statistics rows dropped."""
    return pl.parse_statistics(pl.statistics_payload(fx.snap(spark, sf)))


@query("json_extract_key")
def q_json_extract_key(spark, sf):
    """Every scalar value of key ``k`` in ``events.props``."""
    ev = fx.table(spark, sf, "events")
    return pl.extract_key_values(ev, "k", "props", ("event_id",))


# ------------------------------------------------------------ exchange and bets
from ..operators import bets as bt  # noqa: E402
from ..operators import decide as dc  # noqa: E402
from ..functions.masks import alert  # noqa: E402
from .catalog import _ef_ready, _uo_ready  # noqa: E402

MAX_EXPOSURE = 30.0
BUDGET_INIT = {"high": 1, "low": 2}
RISK_LEVEL_HIGH = 3.0


def _events(spark, sf):
    return bt.event_table(fx.event_listing(fx.snap(spark, sf)))


def _alert_preds(spark, sf, extra=()):
    uo = dc.prediction_record_uo(dc.blend_uo(_uo_ready(spark, sf)), extra)
    ef = dc.prediction_record_ef(dc.blend_ef(_ef_ready(spark, sf)), None, extra)
    return uo.unionByName(ef).where(alert("probability"))


@query("event_table")
def q_event_table(spark, sf):
    """S16."""
    return _events(spark, sf)


@query("selection_table")
def q_selection_table(spark, sf):
    """Runners of each event's over/under market."""
    from ..schema import MARKET_UO
    return bt.selection_table(fx.market_catalogue(_events(spark, sf)), MARKET_UO)


@query("best_quotes")
def q_best_quotes(spark, sf):
    """S18 / O4 / S22."""
    return bt.best_quotes(fx.runner_books(fx.quote_lines(spark, sf)))


@query("runner_table")
def q_runner_table(spark, sf):
    """Order-book replies, one a market, to the runner table of their first book."""
    return pl.parse_book_replies(pl.book_replies(fx.quote_lines(spark, sf)))


@query("match_event")
def q_match_event(spark, sf):
    """Alert predictions to the first event naming the home (else away) team."""
    preds = _alert_preds(spark, sf).select(KEY, "minute", "bet_type", "home", "away")
    return bt.match_event(preds, _events(spark, sf))


def _bets(spark, sf, extra=()):
    """Predictions matched to event, market, runner and quote (B8 up to the stake)."""
    ev = _events(spark, sf)
    preds = bt.match_event(_alert_preds(spark, sf, extra), ev)
    preds = preds.join(ev.select("event_id", F.col("home").alias("event_home"),
                                 F.col("away").alias("event_away")), "event_id", "left")
    sel = fx.market_catalogue(ev)
    sel_uo = bt.selection_table(sel, bt.MARKETS["uo"])
    sel_mo = bt.selection_table(sel, bt.MARKETS["ef"])
    b = bt.join_selection(preds.withColumn("side", bt.bet_side(F.col("prediction"))),
                          sel_uo.unionByName(sel_mo))
    quotes = bt.best_quotes(fx.runner_books(fx.quote_lines(spark, sf)))
    return bt.join_quote(b, quotes)


@query("join_selection")
def q_join_selection(spark, sf):
    """Selection id of the runner each alert would bet on."""
    ev = _events(spark, sf)
    preds = bt.match_event(_alert_preds(spark, sf), ev).join(
        ev.select("event_id", F.col("home").alias("event_home"), F.col("away").alias("event_away")),
        "event_id", "left")
    sel = fx.market_catalogue(ev)
    allsel = bt.selection_table(sel, bt.MARKETS["uo"]).unionByName(bt.selection_table(sel, bt.MARKETS["ef"]))
    return bt.join_selection(preds, allsel).select(KEY, "minute", "bet_type", "event_id",
                                                   "runner_name", "selection_id", "market_id")


@query("join_quote")
def q_join_quote(spark, sf):
    """J9 with B1: side, price and size available for each alert's runner."""
    return _bets(spark, sf).select(KEY, "minute", "bet_type", "selection_id", "side", "odd",
                                   "size_available")


@query("bet_side")
def q_bet_side(spark, sf):
    """B1."""
    return _alert_preds(spark, sf).select(KEY, "minute", "bet_type", "prediction",
                                          bt.bet_side(F.col("prediction")).alias("side"))


@query("risk_tier")
def q_risk_tier(spark, sf):
    """B2 (tier of the quoted odd)."""
    return _bets(spark, sf).select(KEY, "minute", "bet_type", "odd",
                                   bt.risk_tier(F.col("odd"), RISK_LEVEL_HIGH).alias("tier"))


@query("bet_rules")
def q_bet_rules(spark, sf):
    """Match-state rule verdict per alert."""
    return _alert_preds(spark, sf).select(
        KEY, "minute", "bet_type", "prediction",
        bt.rule_reject(F.col("bet_type"), F.col("prediction"), F.col("home_score"),
                       F.col("away_score"), F.col("minute")).alias("reject_reason"))


@query("bet_stake")
def q_bet_stake(spark, sf):
    """Stake and risk odd with the exposure split over the budget slots."""
    b = _bets(spark, sf)
    size, true_odd = bt.stake(F.col("side"), F.col("odd"), F.col("size_available"),
                              bt.stake_per_slot(MAX_EXPOSURE, BUDGET_INIT))
    return b.select(KEY, "minute", "bet_type", "side", "odd", size.alias("size"),
                    true_odd.alias("true_odd"))


# ------------------------------------------------------------ files and tables
from ..operators.latest import latest_per_match  # noqa: E402
from ..session import scratch_dir  # noqa: E402
from ..sources import files as fl  # noqa: E402


@query("scan_csv")
def q_scan_csv(spark, sf):
    """Snapshots written as CSV (index column, ``nan``), read back typed."""
    raw = fx.raw_snapshots(spark, sf)
    path = scratch_dir(spark, "snap-csv")
    fl.write_snapshot_csv(raw, path)
    return fl.read_snapshot_csv(spark, path, fl.csv_schema(raw.columns))


def _season_files(spark, sf, which):
    """One folder of files a season, named with its year; the wanted ones are read back."""
    raw = fx.raw_snapshots(spark, sf).withColumn("season", F.year(F.to_date("date")))
    path = scratch_dir(spark, "snap-seasons")
    fl.write_snapshot_csv(raw, path, partition_by=["season"])
    schema = fl.csv_schema([c for c in raw.columns if c != "season"])
    return fl.read_numbered_files(spark, path, schema, which)


@query("scan_latest_file")
def q_scan_latest_file(spark, sf):
    """One file per season; the newest season is the live input."""
    return _season_files(spark, sf, "latest")


@query("latest_of_file")
def q_latest_of_file(spark, sf):
    """Newest non-missing values per match in the newest file."""
    df = _season_files(spark, sf, "latest")
    return latest_per_match(df.select(KEY, "minute", "home", "away", "home_score", "away_score",
                                      "home_tiri", "away_contrasti"))


@query("sink_append_open")
def q_sink_append_open(spark, sf):
    """Finished matches saved, live snapshots appended with open outcomes."""
    path = scratch_dir(spark, "match-table")
    fl.write_table(fx.hist(spark, sf).drop(*fx.MODEL_OUTPUT), path, "overwrite")
    fl.write_table(fl.with_open_outcome(fx.live(spark, sf).drop(*fx.MODEL_OUTPUT)), path, "append")
    return spark.read.parquet(path)


@query("backfill_outcomes")
def q_backfill_outcomes(spark, sf):
    """Open outcomes of finished fixtures filled in, in the stored match table's folders that have some."""
    path, saved = scratch_dir(spark, "matches"), fl.saved_match_table(spark, sf)
    fl.store_matches(saved, path)
    fl.backfill_stored(spark, path, fl.fixture_results(spark, sf))
    return spark.read.parquet(path).select(saved.columns)


# ------------------------------------------------------------ models
from ..functions import masks as mk  # noqa: E402
from . import model as mdl  # noqa: E402
from . import search as srch  # noqa: E402
from ..operators.clean import to_numeric  # noqa: E402
from .preprocess import feature_cols, prep_live_result, prep_test, prep_train, prep_train_result  # noqa: E402

# Models are fitted with the first seeded draw of the published grids (plans/model.py):
# 200 trees of depth 4 for UO, 300 of depth 3 for EF; the result model has its own 2000 trees.
PUBLISHED = {task: mdl.sample_grid(grid, 1)[0] for task, grid in (("uo", mdl.GRID_UO), ("ef", mdl.GRID_EF))}
PUBLISHED["result"] = mdl.RESULT_PARAMS
# Small trees where only keys, soundness or equality are asked for, which no tree count
# changes (scored_keys, live_keys, roundtrip_equal), and in the stream.
SMALL = {"maxIter": 5, "maxDepth": 3}
# Reduced-cost grid for random_search (random_search_full has the published one):
# tree counts scaled down, other axes as published.
SEARCH_GRID = {"learning_rate": [0.05, 0.1, 0.15, 0.20, 0.3], "n_estimators": [3, 5],
               "min_child_weight": [3, 5, 10, 15], "gamma": [0.3, 0.5, 0.7, 1, 1.5],
               "subsample": [0.4, 0.6, 0.8, 1.0], "colsample_bytree": [0.4, 0.6, 0.8, 1.0],
               "max_depth": [2, 3]}


def _fit(spark, sf, task, table=fx.hist, params=None):
    tr = prep_train(fx.as_raw(table(spark, sf)), task)
    m = mdl.fit(tr.table, feature_cols(tr.table, task), task, params or PUBLISHED[task])
    return tr, m


@query("fit_uo")
def q_fit_uo(spark, sf):
    """M1: over/under model on all matches; feature importances."""
    _, m = _fit(spark, sf, "uo", fx.snap)
    return spark.createDataFrame(mdl.feature_importance(m), "feature string, importance double")


@query("fit_ef")
def q_fit_ef(spark, sf):
    """M2 / M3: three one-vs-rest models for 1/X/2; mean feature importances."""
    _, m = _fit(spark, sf, "ef", fx.snap)
    return spark.createDataFrame(mdl.feature_importance(m), "feature string, importance double")


def _score_q(task, params=None):
    def q(spark, sf):
        tr, m = _fit(spark, sf, task, params=params)
        te = prep_test(fx.as_raw(fx.live(spark, sf)), tr, task)
        out = mdl.score(m, te, [KEY, "minute"])
        return out
    return q


query("score_uo")(_score_q("uo"))
query("score_ef")(_score_q("ef"))


def _result_model(spark, sf, table, params=None):
    tr = prep_train_result(fx.as_raw(table(spark, sf)))
    feats = feature_cols(tr, "result")
    return tr, mdl.fit(tr, feats, "result", params or PUBLISHED["result"])


@query("fit_result")
def q_fit_result(spark, sf):
    """M3: the result model on all matches; mean feature importances."""
    _, m = _result_model(spark, sf, fx.snap)
    return spark.createDataFrame(mdl.feature_importance(m), "feature string, importance double")


def _score_result(spark, sf, params=None):
    """M3 / M4: result model of the training matches on the scoring matches."""
    tr, m = _result_model(spark, sf, fx.hist, params)
    lv = prep_live_result(to_numeric(fx.as_raw(fx.live(spark, sf))), tr)
    return mdl.score(m, lv, [KEY, "minute"])


query("score_result")(_score_result)


@query("model_roundtrip")
def q_model_roundtrip(spark, sf):
    """Fit, save to the shared folder, load, score the scoring matches."""
    tr, m = _fit(spark, sf, "ef")
    path = scratch_dir(spark, "model-ef")
    mdl.save(m, path)
    back = mdl.load(path, "ef", m.features)
    te = prep_test(fx.as_raw(fx.live(spark, sf)), tr, "ef")
    return mdl.score(back, te, [KEY, "minute"])


def _sound(task):
    """Probabilities are probabilities, of EF and result they add up to 1, and the label is the likeliest class."""
    if task == "uo":
        p = F.col("probability_over")
        return p.between(0, 1) & (F.col("prediction") == (p > 0.5).cast("int"))
    p = [F.col(f"probability_{k}") for k in "1X2"]
    return ((F.abs(p[0] + p[1] + p[2] - 1) < 1e-9) & (F.col("probability") == F.greatest(*p))
            & (F.element_at(F.array(*p), F.col("prediction").cast("int")) == F.col("probability")))


def _scored_keys_q(task):
    def q(spark, sf):
        return _score_q(task, SMALL)(spark, sf).select(KEY, "minute", _sound(task).alias("sound"))
    return q


query("scored_keys_uo")(_scored_keys_q("uo"))
query("scored_keys_ef")(_scored_keys_q("ef"))


@query("scored_keys_result")
def q_scored_keys_result(spark, sf):
    """M3 / M4: every prepared live row is scored, missing features or not."""
    return _score_result(spark, sf, SMALL).select(KEY, "minute", _sound("result").alias("sound"))


@query("roundtrip_equal")
def q_roundtrip_equal(spark, sf):
    """A model saved and loaded scores every row as it did before."""
    tr, m = _fit(spark, sf, "uo", params=SMALL)
    path = scratch_dir(spark, "model-uo")
    mdl.save(m, path)
    te = prep_test(fx.as_raw(fx.live(spark, sf)), tr, "uo")
    before = mdl.score(m, te, [KEY, "minute"])
    after = mdl.score(mdl.load(path, "uo", m.features), te, [KEY, "minute"])
    after = after.select(F.col(KEY).alias("k"), F.col("minute").alias("m"), F.col("probability_over").alias("again"))
    return before.join(after, (F.col(KEY) == F.col("k")) & (F.col("minute") == F.col("m"))).select(
        KEY, "minute", (F.col("probability_over") == F.col("again")).alias("equal"))


def _cv_q(task, mask):
    def q(spark, sf):
        snaps = fx.snap(spark, sf).drop(*fx.MODEL_OUTPUT)
        res = srch.cross_validate(snaps, mask(), task, "odds", PUBLISHED[task], cv=5, threshold=0.7)
        return srch.cv_summary(spark, res, 5)
    return q


query("cv_uo")(_cv_q("uo", mk.mask_one_goal))
query("cv_ef")(_cv_q("ef", mk.mask_mid_game))


def _search(spark, sf, grid, trials, cv):
    snaps = fx.snap(spark, sf).drop(*fx.MODEL_OUTPUT)
    rows = srch.random_search(snaps, mk.mask_one_goal(), grid, "uo", "odds", trials=trials, cv=cv)
    base = scratch_dir(spark, "models")
    saved = srch.save_winner(spark, snaps, rows, base, "uo")
    out = [(r["trial"], r["params"], r["accuracy_thresh"], r["accuracy_05"], r["is_best"], r["is_best"] and saved)
           for r in rows]
    return spark.createDataFrame(out, "trial int, params string, accuracy_thresh double, "
                                      "accuracy_05 double, is_best boolean, saved boolean")


@query("random_search")
def q_random_search(spark, sf):
    """Two sampled trials, best kept, champion gate on the registry."""
    return _search(spark, sf, SEARCH_GRID, 2, 3)


@query("random_search_full")
def q_random_search_full(spark, sf):
    """M11 / M12 / M13 as published: 20 trials of the published grid in 5 folds."""
    return _search(spark, sf, mdl.GRID_UO, 20, 5)


def _live_q(task, params=None):
    def q(spark, sf):
        return srch.live_predictions(fx.as_raw(fx.hist(spark, sf)), fx.as_raw(fx.live(spark, sf)),
                                     task, params or PUBLISHED[task])
    return q


query("live_predictions_uo")(_live_q("uo"))
query("live_predictions_ef")(_live_q("ef"))


def _live_keys_q(task):
    def q(spark, sf):
        p = "probability_final_over" if task == "uo" else "probability_final"
        return _live_q(task, SMALL)(spark, sf).select(KEY, F.col(p).between(0, 1).alias("sound"))
    return q


query("live_keys_uo")(_live_keys_q("uo"))
query("live_keys_ef")(_live_keys_q("ef"))


# ------------------------------------------------------------ streams
from ..functions.odds import odds_to_prob_uo, replace_sentinels  # noqa: E402
from ..operators import decide  # noqa: E402
from ..streaming import live as lv  # noqa: E402


def _landing(spark, snap_df, name):
    """Poll records written as JSON-lines files, compressed, into a fresh landing folder."""
    path = scratch_dir(spark, name)
    lv.poll_records(snap_df).write.json(path, compression="gzip")
    return path


@query("stream_snapshots")
def q_stream_snapshots(spark, sf):
    """Poll files drained by a stream (availableNow), parsed to snapshot rows."""
    land = _landing(spark, fx.snap(spark, sf), "landing")
    sink, ck = scratch_dir(spark, "snap-sink"), scratch_dir(spark, "snap-ckpt")
    lv.run_available_now(lv.parse_polls(lv.read_polls(spark, land)), sink, ck)
    return spark.read.parquet(sink)


def _stream_scored(spark, sf):
    hist_raw = fx.as_raw(fx.hist(spark, sf)).drop("home_contrasti", "away_contrasti")
    tr = prep_train(hist_raw, "ef")
    m = mdl.fit(tr.table, feature_cols(tr.table, "ef"), "ef", SMALL)
    land = _landing(spark, fx.live(spark, sf), "landing-live")
    snaps = lv.parse_polls(lv.read_polls(spark, land))
    return lv.score_stream(snaps, tr, m, ["possesso_palla", "tiri", "falli"])


@query("stream_scores")
def q_stream_scores(spark, sf):
    """Live polls scored against the static training state, blended."""
    scored = _stream_scored(spark, sf).select(
        KEY, "minute", "probability_1", "probability_X", "probability_2",
        "probability_final", "prediction_final")
    sink, ck = scratch_dir(spark, "score-sink"), scratch_dir(spark, "score-ckpt")
    lv.run_available_now(scored, sink, ck)
    return spark.read.parquet(sink)


@query("stream_alerts")
def q_stream_alerts(spark, sf):
    """Polls drained in micro-batches, each joined to the stored probabilities of its
    snapshots, blended, and its alerts written to the batch's own folder."""
    land = _landing(spark, fx.snap(spark, sf), "landing-alerts")
    known = fx.snap(spark, sf).select(F.col("fixture_id").alias("__f"), F.col("minute").alias("__m"), "probability_over")

    def step(batch):
        # one task reads a compressed file: its records are dealt to all cores before their documents are parsed
        rows = odds_to_prob_uo(replace_sentinels(lv.parse_polls(batch.repartition("fixtures_doc"))))
        rows = rows.join(known, (rows["fixture_id"] == F.col("__f")) & (rows["minute"] == F.col("__m")))
        return decide.prediction_record_uo(decide.blend_uo(rows)).where(mk.alert("probability"))

    sink, ck = scratch_dir(spark, "alert-sink"), scratch_dir(spark, "alert-ckpt")
    lv.run_batches(lv.read_polls(spark, land, 2), step, sink, ck)
    return spark.read.parquet(sink).drop("batch")


# ------------------------------------------------------------ budget and backtest
from ..operators.budget import budget_fold  # noqa: E402

_BT_KEYS = [KEY, "minute", "bet_type"]
_BT_ORDER = ["minute", KEY, "bet_type"]   # within a trading day: match minute, then match, then market


START_BALANCE = 100.0


def _backtest_rows(spark, sf):
    """B8 inputs: every alert with event, runner, quote, rules, stake and tiers."""
    b = _bets(spark, sf, ("match_date",))
    size, true_odd = bt.stake(F.col("side"), F.col("odd"), F.col("size_available"),
                              bt.stake_per_slot(MAX_EXPOSURE, BUDGET_INIT))
    rule = bt.rule_reject(F.col("bet_type"), F.col("prediction"), F.col("home_score"),
                          F.col("away_score"), F.col("minute"))
    skip = (F.when(F.col("event_id").isNull(), F.lit("no event"))
             .when(F.col("selection_id").isNull(), F.lit("no market")))
    # account balance around each alert, from the fixture: of match and minute
    match = F.col(KEY).cast("long")
    before = F.pmod(match + 7 * F.col("minute"), F.lit(40)).cast("double") + 65.0
    after = F.pmod(match + 11 * F.col("minute"), F.lit(40)).cast("double") + 65.0
    return b.withColumns({
        "size": size, "true_odd": true_odd, "rule_reason": rule, "skip_reason": skip,
        "tier_check": bt.risk_tier(F.col("odd"), RISK_LEVEL_HIGH),
        "tier_use": bt.risk_tier(true_odd, RISK_LEVEL_HIGH),
        "eligible": skip.isNull() & rule.isNull(),
        "exposure_ok": bt.exposure_ok(before, START_BALANCE, MAX_EXPOSURE),
        "balance_up": before > START_BALANCE,
        "exposure_after": bt.exposure_ok(after, START_BALANCE, MAX_EXPOSURE)})


@query("bet_budget")
def q_bet_budget(spark, sf):
    """Budget slots before each alert of a trading day, in (minute, match, type) order."""
    rows = _backtest_rows(spark, sf)
    return budget_fold(rows, "match_date", _BT_ORDER, BUDGET_INIT, _BT_KEYS)


@query("bet_backtest")
def q_bet_backtest(spark, sf):
    """The full decision per alert: placed or the reason it was not.

    The decision columns ride through the budget fold, so the alert rows are
    computed once."""
    rows = _backtest_rows(spark, sf)
    carry = _BT_KEYS + ["prediction", "side", "odd", "size", "true_odd", "skip_reason", "rule_reason", "exposure_ok"]
    j = budget_fold(rows, "match_date", _BT_ORDER, BUDGET_INIT, carry)
    reason = (F.when(~F.col("exposure_ok"), F.lit("no exposure"))
               .when(F.col("skip_reason").isNotNull(), F.col("skip_reason"))
               .when(F.col("budget_empty"), F.lit("no budget"))
               .when(F.col("rule_reason").isNotNull(), F.col("rule_reason")))
    return j.select("match_date", KEY, "minute", "bet_type", "prediction", "side", "odd", "size",
                    "true_odd", "budget_high", "budget_low", "accepted",
                    reason.alias("reject_reason"))


# ------------------------------------------------------------ priors
from ..operators.encode import team_priors  # noqa: E402

_PRIORS = {"avg_camp_goals": "probability_over", "home_avg_goal_fatti": "probability_1",
           "away_avg_goal_fatti": "probability_2", "home_avg_goal_subiti": "probability_2",
           "away_avg_goal_subiti": "probability_1"}


@query("team_priors")
def q_team_priors(spark, sf):
    """League and team priors of the scoring matches from the first stored
    training row of each key (training mean for unseen leagues and for teams not
    seen on both sides).  Stored prior columns are stand-ins from the fixture."""
    train = fx.hist(spark, sf).select("fixture_id", "minute", "campionato", "home", "away",
                                      *[F.col(v).alias(k) for k, v in _PRIORS.items()])
    test = fx.live(spark, sf).select(KEY, "minute", "campionato", "home", "away")
    return team_priors(train, test, ["fixture_id", "minute"])


@query("exposure_ok")
def q_exposure_ok(spark, sf):
    """B6 on account balances: start = customer balance, now = start plus the
    customer's order results (total price mod 200 - 100 per order)."""
    cust = fx.table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("start_balance"))
    res = (fx.table(spark, sf, "orders")
           .groupBy("o_custkey").agg(F.sum(F.pmod(F.col("o_totalprice"), F.lit(200.0)) - 100.0).alias("pnl")))
    acct = cust.join(res, cust["c_custkey"] == res["o_custkey"], "left").select(
        "c_custkey", "start_balance",
        (F.col("start_balance") + F.coalesce(F.col("pnl"), F.lit(0.0))).alias("balance_now"))
    return acct.select("c_custkey", "start_balance", "balance_now",
                       bt.exposure_ok(F.col("balance_now"), F.col("start_balance"), MAX_EXPOSURE).alias("exposure_ok"),
                       (F.col("balance_now") > F.col("start_balance")).alias("restore_budget"))


@query("champion_gate")
def q_champion_gate(spark, sf):
    """runs = the blended over/under decision evaluated under each scenario
    mask in turn; a run is saved when its accuracy beats every earlier run
    (the registry keeps the best so far)."""
    from ..functions.features import label_uo
    scored = dc.blend_uo(_uo_ready(spark, sf)).withColumn("final_uo", label_uo())
    right = (F.col("prediction_final_encoded") == F.col("final_uo")).cast("double")
    runs = scored.agg(*[F.avg(F.when(mk.null_false(m()), right)).alias(f"r{i}")
                        for i, m in enumerate(mk.MASKS.values())])
    names = list(mk.MASKS)
    long = runs.select(F.explode(F.array(*[F.struct(F.lit(i).alias("run"), F.lit(n).alias("mask"),
                                                    F.col(f"r{i}").alias("accuracy"))
                                           for i, n in enumerate(names)])).alias("x")).select("x.*")
    reg, out = scratch_dir(spark, "registry"), []
    for r in sorted(long.collect(), key=lambda r: r["run"]):   # one row per mask
        prev = srch.best_on_record(spark, reg, "uo")
        accuracy = -1.0 if r["accuracy"] is None else r["accuracy"]
        out.append((r["run"], r["mask"], r["accuracy"], prev, srch.champion_gate(spark, reg, "uo", accuracy, r["mask"], "")))
    return spark.createDataFrame(out, "run int, mask string, accuracy double, previous_best double, saved boolean")


@query("sink_training")
def q_sink_training(spark, sf):
    """The processed training table written as parquet and read back."""
    tr = prep_train(fx.as_raw(fx.snap(spark, sf)), "uo")
    path = scratch_dir(spark, "training-uo")
    fl.write_table(tr.table, path)
    return spark.read.parquet(path)


# ------------------------------------------------------------ result variant


@query("prep_train_result")
def q_prep_train_result(spark, sf):
    """M14 result variant on all matches."""
    return prep_train_result(fx.as_raw(fx.snap(spark, sf)))


@query("prep_live_result")
def q_prep_live_result(spark, sf):
    """M16 result variant: scoring matches prepared against the training table."""
    tr = prep_train_result(fx.as_raw(fx.hist(spark, sf)))
    return prep_live_result(to_numeric(fx.as_raw(fx.live(spark, sf))), tr)
