"""Independent SQL (DuckDB dialect) for the registered queries.

Each entry recomputes a query from the raw driver tables (views ``lineitem``,
``orders``, ``customer``, ``nation``, ...) with plain SQL, so a match with the
Spark result checks the whole path.  Double outputs are rounded to 6 digits
on both sides.
"""

from __future__ import annotations

# --------------------------------------------------------------- fixtures
SNAP = """
snap AS (
  SELECT fixture_id, id_partita, match_date, minute, home, away, campionato,
         home_score, away_score, home_final_score, away_final_score,
         home_possesso_palla, away_possesso_palla, home_tiri, away_tiri, home_falli, away_falli,
         home_contrasti, away_contrasti, odd_over, odd_under, odd_1, odd_X, odd_2,
         live_odd_over, live_odd_under, live_odd_1,
         probability_over, probability_1, probability_X, probability_2
  FROM (
    SELECT
      l_orderkey AS fixture_id,
      CAST(l_orderkey AS VARCHAR) AS id_partita,
      strftime(o_orderdate, '%Y-%m-%d') AS match_date,
      CAST((l_linenumber - 1) * 13 + l_partkey % 13 AS INTEGER) AS minute,
      concat('club_', CAST(o_custkey % 100 AS VARCHAR)) AS home,
      concat('club_', CAST((o_orderkey + o_custkey) % 103 AS VARCHAR)) AS away,
      n_name AS campionato,
      CAST(CAST(l_quantity AS INTEGER) % 2 AS INTEGER) AS home_score,
      CAST(l_partkey % 3 AS INTEGER) AS away_score,
      CAST(o_custkey % 4 AS INTEGER) AS home_final_score,
      CAST((o_orderkey + o_custkey) % 3 AS INTEGER) AS away_final_score,
      CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE CAST(30 + l_suppkey % 41 AS DOUBLE) END AS home_possesso_palla,
      CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE CAST(70 - l_suppkey % 41 AS DOUBLE) END AS away_possesso_palla,
      CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE CAST(CAST(l_quantity AS INTEGER) % 20 AS DOUBLE) END AS home_tiri,
      CASE WHEN l_suppkey % 13 = 0 THEN NULL ELSE CAST(l_suppkey % 15 AS DOUBLE) END AS away_tiri,
      CAST(l_partkey % 9 AS DOUBLE) AS home_falli,
      CAST(l_suppkey % 8 AS DOUBLE) AS away_falli,
      CASE WHEN l_partkey % 3 > 0 THEN NULL ELSE CAST(l_partkey % 5 AS DOUBLE) END AS home_contrasti,
      CASE WHEN l_partkey % 3 > 0 THEN NULL ELSE CAST(l_suppkey % 6 AS DOUBLE) END AS away_contrasti,
      CASE WHEN o_custkey % 17 = 0 THEN 0e0 ELSE 12e-1 + CAST(o_custkey % 40 AS DOUBLE) / 10e0 END AS odd_over,
      CASE WHEN o_custkey % 17 = 0 THEN 0e0 ELSE 13e-1 + CAST(o_orderkey % 30 AS DOUBLE) / 10e0 END AS odd_under,
      CASE WHEN o_custkey % 19 = 0 THEN 0e0 ELSE 12e-1 + CAST(o_orderkey % 50 AS DOUBLE) / 10e0 END AS odd_1,
      CASE WHEN o_custkey % 19 = 0 THEN 0e0 ELSE 25e-1 + CAST(o_custkey % 20 AS DOUBLE) / 10e0 END AS odd_X,
      CASE WHEN o_custkey % 19 = 0 THEN 0e0 ELSE 14e-1 + CAST((o_orderkey + o_custkey) % 60 AS DOUBLE) / 10e0 END AS odd_2,
      CASE WHEN l_partkey % 5 = 0 THEN 0e0 ELSE 11e-1 + CAST(l_partkey % 40 AS DOUBLE) / 10e0 END AS live_odd_over,
      CASE WHEN l_partkey % 5 = 0 THEN 0e0 ELSE 11e-1 + CAST(l_suppkey % 40 AS DOUBLE) / 10e0 END AS live_odd_under,
      CASE WHEN l_partkey % 5 = 0 THEN 0e0 ELSE 12e-1 + CAST(l_suppkey % 30 AS DOUBLE) / 10e0 END AS live_odd_1,
      CAST((l_partkey * 7 + l_suppkey * 3) % 101 AS DOUBLE) / 100e0 AS probability_over,
      CAST(1 + l_partkey % 7 AS DOUBLE) / CAST(3 + l_partkey % 7 + l_suppkey % 5 + l_linenumber % 3 AS DOUBLE) AS probability_1,
      CAST(1 + l_suppkey % 5 AS DOUBLE) / CAST(3 + l_partkey % 7 + l_suppkey % 5 + l_linenumber % 3 AS DOUBLE) AS probability_X,
      CAST(1 + l_linenumber % 3 AS DOUBLE) / CAST(3 + l_partkey % 7 + l_suppkey % 5 + l_linenumber % 3 AS DOUBLE) AS probability_2,
      row_number() OVER (PARTITION BY l_orderkey, (l_linenumber - 1) * 13 + l_partkey % 13
                         ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_quantity,
                                  l_discount, l_shipdate) AS seq
    FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey
  ) t WHERE seq = 1
)"""

HIST = "hist AS (SELECT * FROM snap WHERE fixture_id % 5 > 0)"
WHOLE = "hist AS (SELECT * FROM snap)"  # operators that only train take every match
LIVE = "live AS (SELECT * FROM snap WHERE fixture_id % 5 = 0)"

SENT = """sent AS (
  SELECT * REPLACE (
    CASE WHEN odd_over = 0 THEN 2e0 ELSE odd_over END AS odd_over,
    CASE WHEN odd_under = 0 THEN 2e0 ELSE odd_under END AS odd_under,
    CASE WHEN odd_1 = 0 THEN 3e0 ELSE odd_1 END AS odd_1,
    CASE WHEN odd_X = 0 THEN 3e0 ELSE odd_X END AS odd_X,
    CASE WHEN odd_2 = 0 THEN 3e0 ELSE odd_2 END AS odd_2)
  FROM snap)"""

UO_READY = """uo_ready AS (
  SELECT * REPLACE (
    1 / odd_over + (1 - (1 / odd_over + 1 / odd_under)) / 2 AS odd_over,
    1 / odd_under + (1 - (1 / odd_over + 1 / odd_under)) / 2 AS odd_under)
  FROM sent)"""

EF_READY = """ef_ready AS (
  SELECT * REPLACE (
    1 / odd_1 + (1 - (1 / odd_1 + 1 / odd_2 + 1 / odd_X)) / 3 AS odd_1,
    1 / odd_X + (1 - (1 / odd_1 + 1 / odd_2 + 1 / odd_X)) / 3 AS odd_X,
    1 / odd_2 + (1 - (1 / odd_1 + 1 / odd_2 + 1 / odd_X)) / 3 AS odd_2)
  FROM sent)"""

RATE = "(6e-1 / 9e1)"
MW = f"(4e-1 + {RATE} * minute)"
KW = f"(6e-1 - {RATE} * minute)"

BLEND_UO = f"""buo0 AS (
  SELECT *,
    {MW} * probability_over + {KW} * odd_over AS probability_final_over,
    {MW} * (1 - probability_over) + {KW} * odd_under AS probability_final_under
  FROM uo_ready),
buo AS (
  SELECT *,
    CASE WHEN probability_final_under = greatest(probability_final_under, probability_final_over)
         THEN 0 ELSE 1 END AS prediction_final_encoded,
    CASE WHEN probability_final_under = greatest(probability_final_under, probability_final_over)
         THEN 'under' ELSE 'over' END AS prediction_final
  FROM buo0)"""


def _argmax3(a: str, b: str, c: str) -> str:
    g = f"greatest({a}, {b}, {c})"
    return f"CASE WHEN {a} = {g} THEN 1 WHEN {b} = {g} THEN 2 ELSE 3 END"


def _label3(enc: str) -> str:
    return f"CASE WHEN {enc} = 2 THEN 'X' WHEN {enc} = 3 THEN '2' ELSE '1' END"


BLEND_EF = f"""bef0 AS (
  SELECT *,
    {MW} * probability_1 + {KW} * odd_1 AS probability_final_1,
    {MW} * probability_X + {KW} * odd_X AS probability_final_X,
    {MW} * probability_2 + {KW} * odd_2 AS probability_final_2
  FROM ef_ready),
bef AS (
  SELECT *,
    {_argmax3('probability_final_1', 'probability_final_X', 'probability_final_2')} AS prediction_final_encoded,
    greatest(probability_final_1, probability_final_X, probability_final_2) AS probability_final,
    {_label3(_argmax3('probability_final_1', 'probability_final_X', 'probability_final_2'))} AS prediction_final
  FROM bef0)"""

LABEL_UO = "CASE WHEN home_final_score + away_final_score > 2 THEN 1 ELSE 0 END"
LABEL_EF = ("CASE WHEN home_final_score > away_final_score THEN 1 "
            "WHEN home_final_score = away_final_score THEN 2 ELSE 3 END")

REC_UO = """rec_uo AS (
  SELECT id_partita, minute, home, away, home_score, away_score,
         'Over/Under 2.5 Goals' AS market_name, 'uo' AS bet_type,
         prediction_final AS prediction,
         CASE WHEN probability_final_over > 0.5 THEN probability_final_over ELSE 1 - probability_final_over END AS probability,
         CASE WHEN probability_over > 0.5 THEN probability_over ELSE 1 - probability_over END AS model_probability
  FROM buo)"""

REC_EF = """rec_ef AS (
  SELECT id_partita, minute, home, away, home_score, away_score,
         'Match Odds' AS market_name, 'ef' AS bet_type,
         prediction_final AS prediction,
         probability_final AS probability,
         greatest(probability_1, probability_X, probability_2) AS model_probability
  FROM bef)"""

# Matches in seeded order, ((id mod p) * a + seed) mod p and then the key, dealt in turn.
FOLD = "CAST((row_number() OVER (ORDER BY ((fixture_id % 1000003) * 7919 + 12) % 1000003, id_partita) - 1) % 5 AS INTEGER)"
MASK_ONE_GOAL = "(minute < 70 AND minute > 30 AND home_score + away_score = 1)"
FOLDS = f"""folds AS (
  SELECT id_partita, {FOLD} AS fold FROM (SELECT DISTINCT id_partita, fixture_id FROM snap WHERE coalesce({MASK_ONE_GOAL}, false)))"""
FOLD0 = "fold0 AS (SELECT id_partita FROM folds WHERE fold = 0)"


def W(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def R(sql: str, doubles: list[str]) -> str:
    """Round the named double columns to 6 digits."""
    if not doubles:
        return sql
    # "+ 0" turns a negative zero into zero, as Spark's decimal rounding does
    rep = ", ".join(f"round({c}, 6) + 0e0 AS {c}" for c in doubles)
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) _r"


SNAP_DOUBLES = ["home_possesso_palla", "away_possesso_palla", "home_tiri", "away_tiri",
                "home_falli", "away_falli", "home_contrasti", "away_contrasti",
                "odd_over", "odd_under", "odd_1", "odd_X", "odd_2", "live_odd_over",
                "live_odd_under", "live_odd_1", "probability_over", "probability_1",
                "probability_X", "probability_2"]
STATS4 = ["possesso_palla", "tiri", "falli", "contrasti"]
FEATS = [f"{s}_{x}" for x in STATS4 for s in ("home", "away")]

ORACLES: dict[str, str] = {}

# ---------------------------------------------------------------- sources
ORACLES["scan_match_table"] = R(W(SNAP) + "SELECT * FROM snap", SNAP_DOUBLES)

RAW_COLS = ["id_partita", "match_date AS date", "minute", "home", "away", "campionato",
            "home_score", "away_score", "home_final_score", "away_final_score", *FEATS,
            "odd_over", "odd_under", "odd_1", "odd_X", "odd_2", "live_odd_over",
            "live_odd_under", "live_odd_1"]
RAW_NUM = ["minute", "home_score", "away_score", "home_final_score", "away_final_score", *FEATS,
           "odd_over", "odd_under", "odd_1", "odd_X", "odd_2", "live_odd_over",
           "live_odd_under", "live_odd_1"]
ORACLES["to_numeric"] = R(W(SNAP) + "SELECT id_partita, match_date AS date, "
                          + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" if c in RAW_NUM else c
                                      for c in ["minute", "home", "away", "campionato",
                                                "home_score", "away_score", "home_final_score",
                                                "away_final_score", *FEATS, "odd_over",
                                                "odd_under", "odd_1", "odd_X", "odd_2",
                                                "live_odd_over", "live_odd_under", "live_odd_1"])
                          + " FROM snap", RAW_NUM)

ORACLES["drop_cols"] = R(W(SNAP) + "SELECT id_partita, minute, home, away, campionato, home_score, "
                         "away_score, " + ", ".join(FEATS) + " FROM snap", FEATS)

ORACLES["pop_prematch_odds"] = R(
    W(SNAP, SENT, UO_READY, EF_READY)
    + "SELECT u.id_partita, u.minute, u.odd_under, u.odd_over, e.odd_1, e.odd_X, e.odd_2 "
      "FROM uo_ready u JOIN ef_ready e ON u.id_partita = e.id_partita AND u.minute = e.minute",
    ["odd_under", "odd_over", "odd_1", "odd_X", "odd_2"])

ORACLES["pop_live_odds"] = R(W(SNAP) + "SELECT id_partita, minute, live_odd_under, live_odd_over FROM snap",
                             ["live_odd_under", "live_odd_over"])

ORACLES["input_features_uo"] = (W(SNAP) + "SELECT id_partita, minute, home_score + away_score AS "
                                "actual_total_goals, (home_score + away_score) * (90 - minute) AS "
                                "over_strongness FROM snap")
ORACLES["input_features_ef"] = (W(SNAP) + "SELECT id_partita, minute, home_score + away_score AS "
                                "actual_total_goals, (home_score - away_score) * minute AS "
                                "result_strongness FROM snap")
ORACLES["label_uo"] = W(SNAP) + f"SELECT id_partita, minute, {LABEL_UO} AS final_uo FROM snap"
ORACLES["label_ef"] = W(SNAP) + f"SELECT id_partita, minute, {LABEL_EF} AS final_ef FROM snap"
ORACLES["sentinel_odds"] = R(W(SNAP, SENT) + "SELECT id_partita, minute, odd_over, odd_under, odd_1, "
                             "odd_X, odd_2 FROM sent", ["odd_over", "odd_under", "odd_1", "odd_X", "odd_2"])
ORACLES["odds_prob_uo"] = R(W(SNAP, SENT, UO_READY) + "SELECT id_partita, minute, odd_over, odd_under "
                            "FROM uo_ready", ["odd_over", "odd_under"])
ORACLES["odds_prob_1x2"] = R(W(SNAP, SENT, EF_READY) + "SELECT id_partita, minute, odd_1, odd_X, odd_2 "
                             "FROM ef_ready", ["odd_1", "odd_X", "odd_2"])
ORACLES["one_hot"] = (W(SNAP) + "SELECT id_partita, minute, home_score, away_score, "
                      "CASE WHEN away_score = 1 THEN 1 ELSE 0 END AS away_score_1, "
                      "CASE WHEN away_score = 2 THEN 1 ELSE 0 END AS away_score_2, "
                      "CASE WHEN home_score = 1 THEN 1 ELSE 0 END AS home_score_1 FROM snap")

# ------------------------------------------------------------- predicates
ORACLES["live_filter"] = (W(SNAP) + "SELECT id_partita, minute, home, away FROM snap "
                          "WHERE minute >= 30 AND home_score + away_score <= 2")
SPARSE = ["home_possesso_palla", "away_possesso_palla", "home_tiri", "away_tiri",
          "home_contrasti", "away_contrasti"]
_nn = " + ".join(f"(CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END)" for c in SPARSE)
ORACLES["drop_sparse_rows"] = R(W(SNAP) + "SELECT id_partita, minute, " + ", ".join(SPARSE)
                                + f" FROM snap WHERE 2 + {_nn} >= 4", SPARSE)
ORACLES["drop_missing_key"] = R(W(SNAP) + "SELECT id_partita, minute, home_final_score, away_final_score, "
                                "home_tiri FROM snap WHERE id_partita IS NOT NULL AND minute IS NOT NULL "
                                "AND home_final_score IS NOT NULL AND away_final_score IS NOT NULL",
                                ["home_tiri"])
ORACLES["drop_any_null"] = R(W(SNAP) + "SELECT id_partita, minute, " + ", ".join(SPARSE)
                             + " FROM snap WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in SPARSE),
                             SPARSE)
ORACLES["drop_over_rows"] = (W(SNAP) + "SELECT id_partita, minute, home_score, away_score FROM snap "
                             "WHERE NOT coalesce(home_score + away_score >= 3, false)")
ORACLES["drop_over_matches"] = (W(SNAP) + "SELECT id_partita, minute, home_score, away_score FROM snap "
                                "WHERE id_partita NOT IN (SELECT id_partita FROM snap "
                                "WHERE home_score + away_score >= 3)")
_MASK_SQL = {
    "one_goal": MASK_ONE_GOAL,
    "draw_now": "(minute < 70 AND minute > 30 AND home_score = away_score AND home_final_score <> away_final_score)",
    "mid_game": "(minute < 60 AND minute > 30)",
    "all": "(home_score >= 0)",
}
for _k, _v in _MASK_SQL.items():
    ORACLES[f"mask_{_k}"] = W(SNAP) + f"SELECT id_partita, minute, home_score, away_score FROM snap WHERE {_v}"
ORACLES["test_match_ids"] = (W(SNAP) + "SELECT DISTINCT id_partita FROM snap WHERE coalesce("
                             f"{MASK_ONE_GOAL} AND odd_1 <> 0 AND live_odd_1 <> 0, false)")
ORACLES["drop_late_rows"] = W(SNAP) + "SELECT id_partita, minute FROM snap WHERE minute <= 80"
ORACLES["open_fixtures"] = W(SNAP, LIVE) + "SELECT DISTINCT fixture_id FROM live"

# ------------------------------------------------------ dedupe and profile
ORACLES["dedupe_snapshots"] = (W(SNAP) + "SELECT id_partita, home_score, away_score, min(minute) AS minute "
                               "FROM snap GROUP BY id_partita, home_score, away_score")
ORACLES["null_profile"] = (W(SNAP) + "SELECT " + ", ".join(
    f"count(*) FILTER (WHERE {c} IS NULL) AS nulls_{c}" for c in FEATS + ["home_score"]) + " FROM snap")

# ------------------------------------------------------------------ joins
ORACLES["join_pred_odds"] = R(
    W(SNAP, SENT, UO_READY)
    + "SELECT s.id_partita, s.minute, s.probability_over, u.odd_under, u.odd_over FROM snap s "
      "JOIN uo_ready u ON s.id_partita = u.id_partita AND s.minute = u.minute",
    ["probability_over", "odd_under", "odd_over"])
ORACLES["join_live_odds"] = R(
    W(SNAP, SENT, UO_READY, BLEND_UO)
    + "SELECT b.id_partita, b.minute, b.probability_final_over, b.prediction_final_encoded, "
      "s.live_odd_under, s.live_odd_over FROM buo b JOIN snap s "
      "ON b.id_partita = s.id_partita AND b.minute = s.minute",
    ["probability_final_over", "live_odd_under", "live_odd_over"])
ORACLES["split_test"] = (W(SNAP, FOLDS, FOLD0) + "SELECT id_partita, minute FROM snap "
                         "WHERE id_partita IN (SELECT id_partita FROM fold0)")
ORACLES["split_train"] = (W(SNAP, FOLDS, FOLD0) + "SELECT id_partita, minute FROM snap "
                          "WHERE id_partita NOT IN (SELECT id_partita FROM fold0)")

SMOOTH_UO = """sm AS (
  SELECT campionato, count(home_final_score + away_final_score) AS n,
         avg(home_final_score + away_final_score) AS mean,
         (count(home_final_score + away_final_score) * avg(home_final_score + away_final_score)
          + 10e0 * (SELECT avg(home_final_score + away_final_score) FROM hist))
         / (count(home_final_score + away_final_score) + 10e0) AS smooth,
         (SELECT avg(home_final_score + away_final_score) FROM hist) AS global_mean
  FROM hist WHERE campionato IS NOT NULL GROUP BY campionato)"""
ORACLES["smooth_mean_uo"] = R(W(SNAP, WHOLE, SMOOTH_UO) + "SELECT * FROM sm",
                              ["mean", "smooth", "global_mean"])
ORACLES["smooth_mean_ef"] = R(W(SNAP, WHOLE, f"""sm AS (
  SELECT campionato, count({LABEL_EF}) AS n, avg({LABEL_EF}) AS mean,
         (count({LABEL_EF}) * avg({LABEL_EF}) + 10e0 * (SELECT avg({LABEL_EF}) FROM hist))
         / (count({LABEL_EF}) + 10e0) AS smooth,
         (SELECT avg({LABEL_EF}) FROM hist) AS global_mean
  FROM hist WHERE campionato IS NOT NULL GROUP BY campionato)""") + "SELECT * FROM sm",
    ["mean", "smooth", "global_mean"])
ORACLES["encode_category"] = R(
    W(SNAP, HIST, LIVE, SMOOTH_UO)
    + "SELECT l.id_partita, l.minute, CAST(coalesce(sm.smooth, (SELECT max(global_mean) FROM sm)) AS DOUBLE) "
      "AS campionato FROM live l LEFT JOIN sm ON l.campionato = sm.campionato",
    ["campionato"])


# ---------------------------------------------------------------- imputation
def bin_means_sql(src: str, stats: list[str], name: str = "bm") -> str:
    """Donor means per bin: a donor at minute t counts in every bin m (5..85 step 5)
    with m <= t <= m + 5; bin value = (avg home + avg away) / 2 over complete pairs."""
    cols = ",\n    ".join(
        f"(avg(CASE WHEN home_{s} IS NOT NULL AND away_{s} IS NOT NULL THEN home_{s} END) + "
        f"avg(CASE WHEN home_{s} IS NOT NULL AND away_{s} IS NOT NULL THEN away_{s} END)) / 2 AS mean_{s}"
        for s in stats)
    return f"""{name}_bins AS (SELECT CAST(range AS INTEGER) AS bin FROM range(5, 90, 5)),
{name} AS (
  SELECT b.bin,
    {cols}
  FROM {src} d JOIN {name}_bins b ON d.minute >= b.bin AND d.minute <= b.bin + 5
  GROUP BY b.bin)"""


def impute_sql(target: str, means: str, stats: list[str], poss: bool, name: str) -> tuple[str, list[str]]:
    """Target rows at minute t take the last bin m with m <= t <= m + 5."""
    reps = []
    for s in stats:
        miss = f"(t.home_{s} IS NULL OR t.away_{s} IS NULL)"
        for side in ("home", "away"):
            reps.append(f"CAST(CASE WHEN {miss} AND t.__bin IS NOT NULL THEN m.mean_{s} "
                        f"ELSE t.{side}_{s} END AS DOUBLE) AS {side}_{s}")
    if poss:
        miss = "(t.home_possesso_palla IS NULL OR t.away_possesso_palla IS NULL)"
        for side in ("home", "away"):
            reps.append(f"CAST(CASE WHEN {miss} THEN 50e0 ELSE t.{side}_possesso_palla END AS DOUBLE) "
                        f"AS {side}_possesso_palla")
    binx = ("CASE WHEN floor(minute / 5) * 5 BETWEEN 5 AND 85 THEN CAST(floor(minute / 5) * 5 AS INTEGER) "
            "WHEN minute = 90 THEN 85 END")
    sql = f"""{name}_t AS (SELECT *, {binx} AS __bin FROM {target}),
{name} AS (
  SELECT t.* EXCLUDE (__bin) REPLACE ({', '.join(reps)})
  FROM {name}_t t LEFT JOIN {means} m ON t.__bin = m.bin)"""
    return sql, []


IMP_STATS = ["tiri", "falli", "contrasti"]
ORACLES["bin_means"] = R(W(SNAP, WHOLE, bin_means_sql("hist", IMP_STATS)) + "SELECT * FROM bm",
                         [f"mean_{s}" for s in IMP_STATS])
_imp_tr, _ = impute_sql("ht", "bm", IMP_STATS, True, "imp")
ORACLES["impute_train"] = R(
    W(SNAP, WHOLE, "ht AS (SELECT id_partita, minute, " + ", ".join(FEATS) + " FROM hist)",
      bin_means_sql("ht", IMP_STATS), _imp_tr)
    + "SELECT * FROM imp WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in ["id_partita", "minute"] + FEATS),
    FEATS)
_imp_sc, _ = impute_sql("lt", "bm", IMP_STATS, True, "imp")
ORACLES["impute_score"] = R(
    W(SNAP, HIST, LIVE, "ht AS (SELECT id_partita, minute, " + ", ".join(FEATS) + " FROM hist)",
      "lt AS (SELECT id_partita, minute, " + ", ".join(FEATS) + " FROM live)",
      bin_means_sql("ht", IMP_STATS), _imp_sc)
    + "SELECT * FROM imp", FEATS)

# ------------------------------------------------------------ decisions
ORACLES["blend_uo"] = R(W(SNAP, SENT, UO_READY, BLEND_UO)
                        + "SELECT id_partita, minute, probability_final_over, probability_final_under, "
                          "prediction_final_encoded, prediction_final FROM buo",
                        ["probability_final_over", "probability_final_under"])
ORACLES["blend_ef"] = R(W(SNAP, SENT, EF_READY, BLEND_EF)
                        + "SELECT id_partita, minute, probability_final_1, probability_final_X, "
                          "probability_final_2, prediction_final_encoded, probability_final, "
                          "prediction_final FROM bef",
                        ["probability_final_1", "probability_final_X", "probability_final_2",
                         "probability_final"])
ORACLES["blend_result"] = R(
    W(SNAP, SENT, EF_READY, f"""br AS (
  SELECT s.id_partita, s.minute,
    {MW.replace('minute', 's.minute')} * s.probability_1 + {KW.replace('minute', 's.minute')} * e.odd_1 AS probability_final_result_1,
    {MW.replace('minute', 's.minute')} * s.probability_X + {KW.replace('minute', 's.minute')} * e.odd_X AS probability_final_result_X,
    {MW.replace('minute', 's.minute')} * s.probability_2 + {KW.replace('minute', 's.minute')} * e.odd_2 AS probability_final_result_2
  FROM snap s JOIN ef_ready e ON s.id_partita = e.id_partita AND s.minute = e.minute)""")
    + "SELECT *, " + _argmax3("probability_final_result_1", "probability_final_result_X",
                              "probability_final_result_2") + " AS prediction_final_result FROM br",
    ["probability_final_result_1", "probability_final_result_X", "probability_final_result_2"])
ORACLES["model_only_uo"] = R(
    W(SNAP) + "SELECT id_partita, minute, probability_over AS probability_final_over, "
    "1 - probability_over AS probability_final_under, "
    "CASE WHEN 1 - probability_over = greatest(1 - probability_over, probability_over) THEN 0 ELSE 1 END "
    "AS prediction_final_encoded, "
    "CASE WHEN 1 - probability_over = greatest(1 - probability_over, probability_over) THEN 'under' ELSE 'over' END "
    "AS prediction_final FROM snap",
    ["probability_final_over", "probability_final_under"])
ORACLES["model_only_ef"] = R(
    W(SNAP) + "SELECT id_partita, minute, "
    + _argmax3("probability_1", "probability_X", "probability_2") + " AS prediction_final_encoded, "
    "greatest(probability_1, probability_X, probability_2) AS probability_final, "
    + _label3(_argmax3("probability_1", "probability_X", "probability_2")) + " AS prediction_final FROM snap",
    ["probability_final"])
ORACLES["prediction_record"] = R(
    W(SNAP, SENT, UO_READY, EF_READY, BLEND_UO, BLEND_EF, REC_UO, REC_EF)
    + "SELECT * FROM rec_uo UNION ALL SELECT * FROM rec_ef",
    ["probability", "model_probability"])
ORACLES["alerts"] = R(W(SNAP, SENT, UO_READY, BLEND_UO, REC_UO)
                      + "SELECT * FROM rec_uo WHERE probability > 7e-1",
                      ["probability", "model_probability"])

# ------------------------------------------------------- latest / reports
ORACLES["latest_per_match"] = R(
    W(SNAP) + "SELECT id_partita, "
    + ", ".join(f"arg_max({c}, minute) FILTER (WHERE {c} IS NOT NULL) AS {c}" if c != "minute"
                else "max(minute) AS minute"
                for c in ["home", "away", "minute", "home_score", "away_score", "home_tiri",
                          "away_contrasti", "probability_over"])
    + " FROM snap GROUP BY id_partita",
    ["home_tiri", "away_contrasti", "probability_over"])
ORACLES["dashboard"] = R(
    W(SNAP, SENT, UO_READY, EF_READY, BLEND_UO, BLEND_EF, REC_UO, REC_EF,
      """dr AS (SELECT id_partita, bet_type, home, away, minute, home_score, away_score, prediction,
                probability AS probability_final, model_probability FROM rec_uo
                UNION ALL
                SELECT id_partita, bet_type, home, away, minute, home_score, away_score, prediction,
                probability AS probability_final, model_probability FROM rec_ef)""")
    + "SELECT home, "
    + ", ".join(f"arg_max({c}, (minute, id_partita)) FILTER (WHERE {c} IS NOT NULL) AS {c}" if c != "minute"
                else "max(minute) AS minute"
                for c in ["minute", "away", "home_score", "away_score", "prediction",
                          "probability_final", "model_probability"])
    + " FROM dr GROUP BY bet_type, home",
    ["probability_final", "model_probability"])
RESULT_T = f"""rt AS (SELECT *,
  {_argmax3('probability_1', 'probability_X', 'probability_2')} AS predictions,
  greatest(probability_1, probability_X, probability_2) AS probability FROM snap)"""
ORACLES["prediction_table"] = R(
    W(SNAP, RESULT_T) + "SELECT id_partita, home, away, minute, home_score, away_score, probability_1, "
    "probability_X, probability_2, predictions FROM rt", ["probability_1", "probability_X", "probability_2"])
ORACLES["confident_nodraws"] = R(
    W(SNAP, RESULT_T) + "SELECT id_partita, home, away, minute, home_score, away_score, probability, "
    "predictions FROM rt WHERE probability >= 0.5 AND minute < 60 AND minute > 20 "
    "AND home_score = away_score AND predictions <> 2", ["probability"])
ORACLES["confident_table"] = R(
    W(SNAP, RESULT_T) + "SELECT id_partita, home, away, minute, home_score, away_score, probability, "
    "predictions FROM rt WHERE probability >= 0.5", ["probability"])
ORACLES["report_cols"] = R(
    W(SNAP, SENT, UO_READY, BLEND_UO) + "SELECT minute, home_score, away_score, probability_final_over, "
    f"prediction_final_encoded, {LABEL_UO} AS final_uo FROM buo", ["probability_final_over"])

# ---------------------------------------------------------------- metrics
CONF = "(probability_final_over > 7e-1 OR probability_final_over < 1 - 7e-1)"
ORACLES["accuracy_uo"] = R(
    W(SNAP, SENT, UO_READY, BLEND_UO)
    + f"SELECT avg(CASE WHEN {CONF} THEN CAST(prediction_final_encoded = {LABEL_UO} AS DOUBLE) END) AS accuracy, "
      f"count(*) FILTER (WHERE {CONF}) AS n_rows FROM buo", ["accuracy"])
CONF_EF = "(probability_final > 33e-2 OR probability_final < 1 - 33e-2)"
ORACLES["accuracy_ef"] = R(
    W(SNAP, SENT, EF_READY, BLEND_EF)
    + f"SELECT avg(CASE WHEN {CONF_EF} THEN CAST(prediction_final_encoded = {LABEL_EF} AS DOUBLE) END) AS accuracy, "
      f"count(*) FILTER (WHERE {CONF_EF}) AS n_rows FROM bef", ["accuracy"])
REV = f"""CASE WHEN probability_final_under >= 75e-2 OR probability_final_under <= 1 - 75e-2 THEN
  CASE WHEN {LABEL_UO} = prediction_final_encoded THEN
    CASE WHEN (CASE WHEN prediction_final = 'under' THEN live_odd_under ELSE live_odd_over END) > 1
         THEN (CASE WHEN prediction_final = 'under' THEN live_odd_under ELSE live_odd_over END) - 1
         ELSE 0e0 END
  ELSE -1e0 END
ELSE 0e0 END"""
ORACLES["revenue_uo"] = R(W(SNAP, SENT, UO_READY, BLEND_UO)
                          + f"SELECT coalesce(sum({REV}), 0e0) AS revenue FROM buo", ["revenue"])
ORACLES["insights"] = R(W(SNAP, SENT, UO_READY, BLEND_UO)
                        + f"SELECT avg(CAST(prediction_final_encoded = {LABEL_UO} AS DOUBLE)) AS accuracy, "
                          f"coalesce(sum({REV}), 0e0) AS revenue FROM buo", ["accuracy", "revenue"])
ORACLES["grouped_folds"] = W(SNAP, FOLDS) + "SELECT * FROM folds"
ORACLES["cv_prune"] = (W(SNAP, FOLDS, FOLD0) + "SELECT id_partita, minute, home_score, away_score FROM snap "
                       f"WHERE NOT (id_partita IN (SELECT id_partita FROM fold0) AND NOT coalesce({MASK_ONE_GOAL}, false))")
ORACLES["cv_mean_metrics"] = R(
    W(SNAP, SENT, UO_READY, BLEND_UO, FOLDS, f"""pf AS (
  SELECT f.fold,
    avg(CASE WHEN {CONF} THEN CAST(b.prediction_final_encoded = {LABEL_UO.replace('home_final', 'b.home_final').replace('away_final', 'b.away_final')} AS DOUBLE) END) AS accuracy_thresh,
    avg(CASE WHEN (probability_final_over > 5e-1 OR probability_final_over < 1 - 5e-1) THEN CAST(b.prediction_final_encoded = {LABEL_UO.replace('home_final', 'b.home_final').replace('away_final', 'b.away_final')} AS DOUBLE) END) AS accuracy_05
  FROM buo b JOIN folds f ON b.id_partita = f.id_partita GROUP BY f.fold)""")
    + "SELECT coalesce(sum(accuracy_thresh), 0e0) / 5e0 AS accuracy_thresh, "
      "coalesce(sum(accuracy_05), 0e0) / 5e0 AS accuracy_05 FROM pf",
    ["accuracy_thresh", "accuracy_05"])

# ------------------------------------------------------------ set ops
ORACLES["all_teams"] = W(SNAP) + "SELECT home AS team FROM snap UNION SELECT away AS team FROM snap"
_UNION_COLS = ["fixture_id", "id_partita", "match_date", "minute", "home", "away", "campionato",
               "home_score", "away_score", "home_final_score", "away_final_score",
               "home_possesso_palla", "away_possesso_palla", "home_tiri", "away_tiri",
               "home_falli", "away_falli", "home_contrasti", "away_contrasti", "odd_over",
               "odd_under", "odd_1", "odd_X", "odd_2", "live_odd_over", "live_odd_under", "live_odd_1"]
_API_NULL = {"home_contrasti", "away_contrasti", "live_odd_over", "live_odd_under", "live_odd_1"}
ORACLES["union_sources"] = R(
    W(SNAP, HIST, LIVE)
    + "SELECT " + ", ".join(f"CAST(NULL AS DOUBLE) AS {c}" if c in _API_NULL else c for c in _UNION_COLS)
    + " FROM live UNION ALL SELECT " + ", ".join(_UNION_COLS) + " FROM hist",
    [c for c in _UNION_COLS if c in SNAP_DOUBLES])


def oracles() -> dict[str, str]:
    from oracle_prep import PREP_ORACLES
    out = dict(ORACLES)
    out.update(PREP_ORACLES)
    return out

# ------------------------------------------------------------ JSON payloads
ORACLES["json_fixtures"] = (W(SNAP) + "SELECT fixture_id, concat(campionato, '-', campionato) AS campionato, "
                            "match_date AS date, minute, home, away, home_score, away_score, "
                            "concat(match_date, '-', CAST(fixture_id AS VARCHAR)) AS id_partita FROM snap")
ORACLES["json_labels"] = "SELECT p_type AS label, max(p_partkey) AS id FROM part GROUP BY p_type"
ORACLES["json_odds_uo"] = R(W(SNAP) + "SELECT id_partita, minute, odd_over, odd_under FROM snap",
                            ["odd_over", "odd_under"])
ORACLES["json_odds_1x2"] = R(W(SNAP) + "SELECT id_partita, minute, odd_1, odd_X, odd_2 FROM snap",
                             ["odd_1", "odd_X", "odd_2"])
_STAT_OUT = ["possesso_palla", "tiri", "tiri_in_porta", "tiri_fuori", "tiri_fermati", "calci_d_angolo",
             "fuorigioco", "parate", "falli", "cartellini_rossi", "cartellini_gialli",
             "passaggi_totali", "passaggi_completati"]


def _stat_expr(stat: str, side: str) -> str:
    if stat == "possesso_palla":
        return f"coalesce(CAST({side}_possesso_palla AS INTEGER), 50) AS {side}_possesso_palla"
    if stat in ("tiri", "falli"):
        return f"coalesce(CAST({side}_{stat} AS INTEGER), 0) AS {side}_{stat}"
    return f"0 AS {side}_{stat}"


ORACLES["json_statistics"] = (W(SNAP) + "SELECT id_partita, minute, "
                              + ", ".join(_stat_expr(s, side) for s in _STAT_OUT for side in ("home", "away"))
                              + " FROM snap WHERE NOT (home_tiri IS NULL AND away_tiri IS NULL)")
ORACLES["json_extract_key"] = """
SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY i) AS INTEGER) AS pos, v ->> '$' AS value
FROM (
  SELECT event_id, unnest(vals) AS v, unnest(range(len(vals))) AS i
  FROM (SELECT event_id, json_extract(props, '$..k') AS vals FROM events)
) WHERE NOT (starts_with(CAST(v AS VARCHAR), '{') OR starts_with(CAST(v AS VARCHAR), '['))"""


# ------------------------------------------------------------ exchange and bets
EVENTS = """events_t AS (
  SELECT DISTINCT lower(concat(upper(home), ' v ', upper(away))) AS event_name,
         upper(home) AS home, upper(away) AS away, fixture_id AS event_id FROM snap)"""
ALERTS = """alerts_t AS (SELECT * FROM rec_uo WHERE probability > 7e-1
                         UNION ALL SELECT * FROM rec_ef WHERE probability > 7e-1)"""
TEAM_EVENT = """team_ev AS (
  SELECT t.team, min(e.event_id) AS event_id
  FROM (SELECT home AS team FROM alerts_t UNION SELECT away FROM alerts_t) t
  JOIN events_t e ON contains(e.event_name, lower(t.team))
  GROUP BY t.team)"""
MATCHED = """matched AS (
  SELECT a.*, coalesce(h.event_id, w.event_id) AS event_id
  FROM alerts_t a LEFT JOIN team_ev h ON lower(a.home) = h.team
  LEFT JOIN team_ev w ON lower(a.away) = w.team)"""
SELS = """sels AS (
  SELECT event_id, event_id * 10 + 1 AS selection_id, 'Under 2.5 Goals' AS runner_name,
         'Over/Under 2.5 Goals' AS market_name, event_id * 2 AS market_id FROM events_t
  UNION ALL SELECT event_id, event_id * 10 + 2, 'Over 2.5 Goals', 'Over/Under 2.5 Goals', event_id * 2 FROM events_t
  UNION ALL SELECT event_id, event_id * 10 + 3, home, 'Match Odds', event_id * 2 + 1 FROM events_t
  UNION ALL SELECT event_id, event_id * 10 + 4, away, 'Match Odds', event_id * 2 + 1 FROM events_t
  UNION ALL SELECT event_id, event_id * 10 + 5, 'The Draw', 'Match Odds', event_id * 2 + 1 FROM events_t)"""
QUOTES = """ql AS (
  SELECT l_orderkey * 10 + (l_linenumber - 1) % 5 + 1 AS selection_id, l_returnflag = 'N' AS is_back,
         l_discount * 100 + 1.01e0 AS price, l_quantity AS size FROM lineitem),
quotes0 AS (
  SELECT selection_id,
    max({'price': price, 'size': size}) FILTER (WHERE is_back) AS b,
    min({'price': price, 'neg': -size}) FILTER (WHERE NOT is_back) AS l
  FROM ql GROUP BY selection_id),
quotes AS (
  SELECT selection_id,
    coalesce(nullif(b.price, 0), 1.01e0) AS back_price,
    coalesce(nullif(b.size, 0), 1.01e0) AS back_size,
    coalesce(nullif(l.price, 0), 1000e0) AS lay_price,
    coalesce(nullif(-l.neg, 0), 1.01e0) AS lay_size
  FROM quotes0)"""
BETS = """bets0 AS (
  SELECT m.*, e.home AS event_home, e.away AS event_away,
    CASE WHEN m.prediction IN ('1', 'X', '2') THEN 'Lay' ELSE 'Back' END AS side,
    CASE WHEN m.prediction = 'under' THEN 'Under 2.5 Goals' WHEN m.prediction = 'over' THEN 'Over 2.5 Goals'
         WHEN m.prediction = '2' THEN e.home ELSE e.away END AS runner_name
  FROM matched m LEFT JOIN events_t e ON m.event_id = e.event_id),
bets1 AS (
  SELECT b.*, s.selection_id, s.market_id FROM bets0 b LEFT JOIN sels s
  ON b.event_id = s.event_id AND b.runner_name = s.runner_name AND b.market_name = s.market_name),
bets AS (
  SELECT b.*, CASE WHEN side = 'Lay' THEN q.lay_price ELSE q.back_price END AS odd,
         CASE WHEN side = 'Lay' THEN q.lay_size ELSE q.back_size END AS size_available
  FROM bets1 b LEFT JOIN quotes q ON b.selection_id = q.selection_id)"""
BET_BASE = [SNAP, SENT, UO_READY, EF_READY, BLEND_UO, BLEND_EF, REC_UO, REC_EF, ALERTS, EVENTS, TEAM_EVENT, MATCHED]

ORACLES["event_table"] = W(SNAP, EVENTS) + "SELECT * FROM events_t"
ORACLES["selection_table"] = (W(SNAP, EVENTS, SELS) + "SELECT event_id, selection_id, runner_name, market_name, "
                              "market_id FROM sels WHERE market_name = 'Over/Under 2.5 Goals'")
ORACLES["best_quotes"] = R(W(QUOTES) + "SELECT * FROM quotes", ["back_price", "back_size", "lay_price", "lay_size"])
ORACLES["runner_table"] = R(
    W(QUOTES, "more AS (SELECT selection_id, max(price) FILTER (WHERE is_back) AS last_price_traded, sum(size)::DOUBLE AS total_matched, count(*)::DOUBLE AS adjustment_factor FROM ql GROUP BY selection_id)")
    + "SELECT (selection_id // 10) * 2 + CASE WHEN selection_id % 10 <= 2 THEN 0 ELSE 1 END AS market_id, q.*, m.last_price_traded, m.total_matched, "
      "'ACTIVE' AS status, CAST(NULL AS VARCHAR) AS removal_date, m.adjustment_factor FROM quotes q JOIN more m USING (selection_id)",
    ["back_price", "back_size", "lay_price", "lay_size", "last_price_traded", "total_matched", "adjustment_factor"])
ORACLES["match_event"] = W(*BET_BASE) + "SELECT id_partita, minute, bet_type, home, away, event_id FROM matched"
ORACLES["join_selection"] = (W(*BET_BASE, SELS, QUOTES, BETS) + "SELECT id_partita, minute, bet_type, event_id, "
                              "runner_name, selection_id, market_id FROM bets1")
ORACLES["join_quote"] = R(W(*BET_BASE, SELS, QUOTES, BETS) + "SELECT id_partita, minute, bet_type, selection_id, side, "
                          "odd, size_available FROM bets", ["odd", "size_available"])
ORACLES["bet_side"] = (W(*BET_BASE) + "SELECT id_partita, minute, bet_type, prediction, CASE WHEN prediction IN "
                       "('1', 'X', '2') THEN 'Lay' ELSE 'Back' END AS side FROM alerts_t")
ORACLES["risk_tier"] = R(W(*BET_BASE, SELS, QUOTES, BETS) + "SELECT id_partita, minute, bet_type, odd, "
                         "CASE WHEN odd > 3e0 THEN 'high' ELSE 'low' END AS tier FROM bets", ["odd"])
ORACLES["bet_rules"] = (W(*BET_BASE) + """SELECT id_partita, minute, bet_type, prediction,
  CASE WHEN bet_type = 'uo' AND prediction = 'under' AND home_score + away_score >= 1 THEN 'under_scored'
       WHEN bet_type = 'uo' AND prediction = 'under' AND minute < 45 THEN 'under_first_half'
       WHEN bet_type = 'uo' AND prediction = 'over' AND home_score + away_score <= 1 THEN 'over_low_score'
       WHEN bet_type = 'uo' AND prediction = 'over' AND minute > 45 THEN 'over_second_half'
       WHEN bet_type = 'ef' AND prediction = 'X' THEN 'draw'
       WHEN bet_type = 'ef' AND prediction = '1' AND home_score <= away_score THEN 'not_leading'
       WHEN bet_type = 'ef' AND prediction = '2' AND home_score >= away_score THEN 'not_leading'
  END AS reject_reason FROM alerts_t""")
STAKE_RAW = ("CASE WHEN side = 'Back' THEN least(size_available, 10e0) "
             "ELSE least(size_available, CAST(ceil(10e0 / (odd - 1e0)) AS DOUBLE)) END")
ORACLES["bet_stake"] = R(W(*BET_BASE, SELS, QUOTES, BETS) + f"""SELECT id_partita, minute, bet_type, side, odd,
  CAST(floor({STAKE_RAW}) AS DOUBLE) AS size,
  CASE WHEN side = 'Back' THEN odd ELSE {STAKE_RAW} / 10e0 + 1e0 END AS true_odd FROM bets""",
                         ["odd", "size", "true_odd"])


# ------------------------------------------------------------ files and tables
_TONUM_SELECT = ORACLES["to_numeric"]
ORACLES["scan_csv"] = ORACLES["to_numeric"]
_SEASON = "year(CAST(match_date AS DATE))"
ORACLES["scan_latest_file"] = R(
    W(SNAP) + "SELECT id_partita, match_date AS date, "
    + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" if c in RAW_NUM else c
                for c in ["minute", "home", "away", "campionato", "home_score", "away_score",
                          "home_final_score", "away_final_score", *FEATS, "odd_over", "odd_under",
                          "odd_1", "odd_X", "odd_2", "live_odd_over", "live_odd_under", "live_odd_1"])
    + f" FROM snap WHERE {_SEASON} = (SELECT max({_SEASON}) FROM snap)", RAW_NUM)
ORACLES["latest_of_file"] = R(
    W(SNAP) + "SELECT id_partita, "
    + ", ".join(f"arg_max(CAST({c} AS DOUBLE), minute) FILTER (WHERE {c} IS NOT NULL) AS {c}"
                if c in ("home_score", "away_score", "home_tiri", "away_contrasti")
                else (f"arg_max({c}, minute) FILTER (WHERE {c} IS NOT NULL) AS {c}" if c != "minute"
                      else "CAST(max(minute) AS DOUBLE) AS minute")
                for c in ["minute", "home", "away", "home_score", "away_score", "home_tiri", "away_contrasti"])
    + f" FROM snap WHERE {_SEASON} = (SELECT max({_SEASON}) FROM snap) GROUP BY id_partita",
    ["minute", "home_score", "away_score", "home_tiri", "away_contrasti"])
_SAVED_COLS = ["fixture_id", "id_partita", "match_date", "minute", "home", "away", "campionato",
               "home_score", "away_score", "home_final_score", "away_final_score", *FEATS,
               "odd_over", "odd_under", "odd_1", "odd_X", "odd_2", "live_odd_over", "live_odd_under", "live_odd_1"]
SAVED = ("saved AS MATERIALIZED (SELECT " + ", ".join(_SAVED_COLS) + " FROM hist UNION ALL SELECT "
         + ", ".join("CAST(NULL AS INTEGER) AS " + c if c in ("home_final_score", "away_final_score") else c
                     for c in _SAVED_COLS) + " FROM live)")
_SAVED_DBL = [c for c in _SAVED_COLS if c in SNAP_DOUBLES]
ORACLES["sink_append_open"] = R(W(SNAP, HIST, LIVE, SAVED) + "SELECT * FROM saved", _SAVED_DBL)
RESULTS = """results AS MATERIALIZED (
  SELECT fixture_id, CASE WHEN max(minute) >= 85 THEN 'Match Finished' ELSE 'Second Half' END AS status,
         max(home_final_score) AS gh, max(away_final_score) AS ga FROM live GROUP BY fixture_id)"""
ORACLES["backfill_outcomes"] = R(
    W(SNAP, HIST, LIVE, SAVED, RESULTS)
    + "SELECT s.* REPLACE ("
      "CASE WHEN r.fixture_id IS NOT NULL THEN r.gh ELSE s.home_final_score END AS home_final_score, "
      "CASE WHEN r.fixture_id IS NOT NULL THEN r.ga ELSE s.away_final_score END AS away_final_score) "
      "FROM saved s LEFT JOIN (SELECT * FROM results WHERE status = 'Match Finished' AND fixture_id IN "
      "(SELECT fixture_id FROM saved WHERE home_final_score IS NULL)) r ON s.fixture_id = r.fixture_id",
    _SAVED_DBL)


# ------------------------------------------------------------ streams
ORACLES["stream_snapshots"] = R(
    W(SNAP) + "SELECT fixture_id, concat(campionato, '-', campionato) AS campionato, match_date AS date, minute, "
    "home, away, home_score, away_score, concat(match_date, '-', CAST(fixture_id AS VARCHAR)) AS id_partita, "
    + ", ".join(_stat_expr(s, side) for s in _STAT_OUT for side in ("home", "away"))
    + ", odd_over, odd_under, odd_1, odd_X, odd_2 FROM snap WHERE NOT (home_tiri IS NULL AND away_tiri IS NULL)",
    ["odd_over", "odd_under", "odd_1", "odd_X", "odd_2"])


REC_POLLS = (REC_UO.replace("SELECT id_partita,", "SELECT concat(match_date, '-', CAST(fixture_id AS VARCHAR)) AS id_partita,")
             .replace("FROM buo)", "FROM buo WHERE NOT (home_tiri IS NULL AND away_tiri IS NULL))"))
ORACLES["stream_alerts"] = R(W(SNAP, SENT, UO_READY, BLEND_UO, REC_POLLS) + "SELECT * FROM rec_uo WHERE probability > 7e-1",
                             ["probability", "model_probability"])


# ------------------------------------------------------------ budget (sequential oracle)
BT = f"""bt AS (
  SELECT b.*, d.match_date,
    CASE WHEN odd > 3e0 THEN 'high' ELSE 'low' END AS tier_check,
    CASE WHEN (CASE WHEN side = 'Back' THEN odd ELSE {STAKE_RAW} / 10e0 + 1e0 END) > 3e0
         THEN 'high' ELSE 'low' END AS tier_use,
    (b.event_id IS NOT NULL AND b.selection_id IS NOT NULL AND NOT (
       (bet_type = 'uo' AND prediction = 'under' AND (home_score + away_score >= 1 OR minute < 45))
    OR (bet_type = 'uo' AND prediction = 'over' AND (home_score + away_score <= 1 OR minute > 45))
    OR (bet_type = 'ef' AND prediction = 'X')
    OR (bet_type = 'ef' AND prediction = '1' AND home_score <= away_score)
    OR (bet_type = 'ef' AND prediction = '2' AND home_score >= away_score))) AS eligible
  FROM bets b JOIN (SELECT DISTINCT id_partita, match_date FROM snap) d ON b.id_partita = d.id_partita),
bal AS (
  SELECT *, (CAST(id_partita AS BIGINT) + 7 * minute) % 40 + 65 AS bal_before, (CAST(id_partita AS BIGINT) + 11 * minute) % 40 + 65 AS bal_after FROM bt),
brows AS (
  SELECT *, bal_before + 30 > 100 AS ex, bal_before > 100 AS up, bal_after + 30 > 100 AS ex_after,
    row_number() OVER (PARTITION BY match_date ORDER BY minute, id_partita, bet_type) AS rn FROM bal),
walk AS (
  SELECT match_date, CAST(1 AS BIGINT) AS rn, 1 AS h0, 2 AS l0 FROM (SELECT DISTINCT match_date FROM brows)
  UNION ALL
  SELECT match_date, rn + 1,
    CASE WHEN ok AND ex_after AND h2 + l2 = 0 THEN 1 ELSE h2 END,
    CASE WHEN ok AND ex_after AND h2 + l2 = 0 THEN 2 ELSE l2 END
  FROM (
    SELECT w.match_date, w.rn, ok, r.ex_after,
      w1.h - CASE WHEN ok AND r.tier_use = 'high' THEN 1 ELSE 0 END AS h2,
      w1.l - CASE WHEN ok AND r.tier_use = 'low' THEN 1 ELSE 0 END AS l2
    FROM walk w JOIN brows r ON r.match_date = w.match_date AND r.rn = w.rn
    CROSS JOIN LATERAL (SELECT CASE WHEN r.ex AND r.up THEN 1 ELSE w.h0 END AS h, CASE WHEN r.ex AND r.up THEN 2 ELSE w.l0 END AS l) w1
    CROSS JOIN LATERAL (SELECT r.ex AND r.eligible AND NOT ((r.tier_check = 'high' AND w1.h = 0)
                                                   OR (r.tier_check = 'low' AND w1.l = 0)) AS ok) o
  ) step),
decided AS (
  SELECT r.*, CASE WHEN r.ex AND r.up THEN 1 ELSE w.h0 END AS h, CASE WHEN r.ex AND r.up THEN 2 ELSE w.l0 END AS l
  FROM brows r JOIN walk w ON r.match_date = w.match_date AND r.rn = w.rn)"""
BUDGET_EMPTY = "((tier_check = 'high' AND h = 0) OR (tier_check = 'low' AND l = 0))"
ORACLES["bet_budget"] = ("WITH RECURSIVE " + ",\n".join([*BET_BASE, SELS, QUOTES, BETS, BT]) + f"""
SELECT match_date, id_partita, minute, bet_type, h AS budget_high, l AS budget_low, {BUDGET_EMPTY} AS budget_empty,
  ex AND eligible AND NOT {BUDGET_EMPTY} AS accepted
FROM decided""")


# ------------------------------------------------------------ priors
PRI = {"avg_camp_goals": "probability_over", "home_avg_goal_fatti": "probability_1",
       "away_avg_goal_fatti": "probability_2", "home_avg_goal_subiti": "probability_2",
       "away_avg_goal_subiti": "probability_1"}
_H = "h AS (SELECT fixture_id, minute, campionato, home, away, " + ", ".join(f"{v} AS {k}" for k, v in PRI.items()) + " FROM hist)"
_both = "both_t AS (SELECT home AS t FROM h INTERSECT SELECT away FROM h)"
_lp = "lp AS (SELECT campionato, arg_min(avg_camp_goals, (fixture_id, minute)) AS v FROM h WHERE campionato IS NOT NULL GROUP BY campionato)"
_tp = []
_sel = []
for side in ("home", "away"):
    for kind in ("fatti", "subiti"):
        c = f"{side}_avg_goal_{kind}"
        _tp.append(f"p_{c} AS (SELECT {side} AS t, arg_min({c}, (fixture_id, minute)) AS v FROM h "
                   f"WHERE {side} IS NOT NULL GROUP BY {side})")
        _sel.append(f"CAST(CASE WHEN l.{side} IN (SELECT t FROM both_t) THEN (SELECT v FROM p_{c} WHERE t = l.{side}) "
                    f"ELSE (SELECT avg({c}) FROM h) END AS DOUBLE) AS {c}")
ORACLES["team_priors"] = R(
    W(SNAP, HIST, LIVE, _H, _both, _lp, *_tp)
    + "SELECT l.id_partita, l.minute, l.campionato, l.home, l.away, "
      "CAST(coalesce(lp.v, (SELECT avg(avg_camp_goals) FROM h)) AS DOUBLE) AS avg_camp_goals, "
    + ", ".join(_sel) + " FROM live l LEFT JOIN lp ON l.campionato = lp.campionato",
    list(PRI))


ORACLES["exposure_ok"] = R("""
WITH res AS (SELECT o_custkey, sum(o_totalprice % 200e0 - 100e0) AS pnl
             FROM orders GROUP BY o_custkey),
acct AS (SELECT c_custkey, c_acctbal AS start_balance, c_acctbal + coalesce(pnl, 0e0) AS balance_now
         FROM customer LEFT JOIN res ON c_custkey = o_custkey)
SELECT c_custkey, start_balance, balance_now, balance_now + 30e0 > start_balance AS exposure_ok,
       balance_now > start_balance AS restore_budget FROM acct""", ["start_balance", "balance_now"])
_MASK_ORDER = ["one_goal", "draw_now", "mid_game", "all"]
ORACLES["champion_gate"] = R(
    W(SNAP, SENT, UO_READY, BLEND_UO, "runs AS (" + " UNION ALL ".join(
        f"SELECT {i} AS run, '{m}' AS mask, avg(CASE WHEN coalesce({_MASK_SQL[m]}, false) THEN "
        f"CAST(prediction_final_encoded = {LABEL_UO} AS DOUBLE) END) AS accuracy FROM buo"
        for i, m in enumerate(_MASK_ORDER)) + ")")
    + "SELECT run, mask, accuracy, max(accuracy) OVER (ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) "
      "AS previous_best, (max(accuracy) OVER (ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NULL "
      "OR accuracy > max(accuracy) OVER (ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS saved FROM runs",
    ["accuracy", "previous_best"])


RULE_REASON = """CASE WHEN bet_type = 'uo' AND prediction = 'under' AND home_score + away_score >= 1 THEN 'under_scored'
       WHEN bet_type = 'uo' AND prediction = 'under' AND minute < 45 THEN 'under_first_half'
       WHEN bet_type = 'uo' AND prediction = 'over' AND home_score + away_score <= 1 THEN 'over_low_score'
       WHEN bet_type = 'uo' AND prediction = 'over' AND minute > 45 THEN 'over_second_half'
       WHEN bet_type = 'ef' AND prediction = 'X' THEN 'draw'
       WHEN bet_type = 'ef' AND prediction = '1' AND home_score <= away_score THEN 'not_leading'
       WHEN bet_type = 'ef' AND prediction = '2' AND home_score >= away_score THEN 'not_leading' END"""
ORACLES["bet_backtest"] = R("WITH RECURSIVE " + ",\n".join([*BET_BASE, SELS, QUOTES, BETS, BT]) + f"""
SELECT match_date, id_partita, minute, bet_type, prediction, side, odd,
  CAST(floor({STAKE_RAW}) AS DOUBLE) AS size,
  CASE WHEN side = 'Back' THEN odd ELSE {STAKE_RAW} / 10e0 + 1e0 END AS true_odd,
  h AS budget_high, l AS budget_low, ex AND eligible AND NOT {BUDGET_EMPTY} AS accepted,
  CASE WHEN NOT ex THEN 'no exposure' WHEN event_id IS NULL THEN 'no event' WHEN selection_id IS NULL THEN 'no market'
       WHEN {BUDGET_EMPTY} THEN 'no budget'
       ELSE {RULE_REASON} END AS reject_reason
FROM decided""", ["odd", "size", "true_odd"])
