"""Independent SQL for the end-to-end preprocessing queries."""

from __future__ import annotations

from oracle_queries import (FEATS, HIST, LIVE, R, SNAP, W, WHOLE, bin_means_sql, impute_sql)

IMP = ["tiri", "falli", "contrasti"]
ODDS = ["odd_over", "odd_under", "odd_1", "odd_X", "odd_2"]
LIVE_ODDS = ["live_odd_over", "live_odd_under", "live_odd_1"]
BASE = ["id_partita", "date", "minute", "home", "away", "campionato", "home_score", "away_score",
        "home_final_score", "away_final_score", *FEATS]
NUM = {"minute", "home_score", "away_score", "home_final_score", "away_final_score", *FEATS, *ODDS, *LIVE_ODDS}
LABEL = {"uo": "CASE WHEN home_final_score + away_final_score > 2 THEN 1 ELSE 0 END",
         "ef": ("CASE WHEN home_final_score > away_final_score THEN 1 "
                "WHEN home_final_score = away_final_score THEN 2 ELSE 3 END")}
TARGET = {"uo": "home_final_score + away_final_score", "ef": "final_ef"}


def _num(src: str, name: str, cols: list[str]) -> str:
    sel = ", ".join("match_date AS date" if c == "date" else
                    (f"CAST({c} AS DOUBLE) AS {c}" if c in NUM else c) for c in cols)
    return f"{name} AS (SELECT {sel} FROM {src})"


def _nn(cols: list[str]) -> str:
    return " + ".join(f"(CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END)" for c in cols)


def _clean(src: str, p: str, cols: list[str], keys: list[str], over: str | None) -> list[str]:
    """dedupe -> sparse rows -> missing keys -> over filter (rows / matches)."""
    others = [c for c in cols if c != "minute"]
    out = [f"{p}_dd AS (SELECT {', '.join(others)}, min(minute) AS minute FROM {src} GROUP BY {', '.join(others)})",
           f"{p}_sp AS (SELECT * FROM {p}_dd WHERE {_nn(cols)} >= {len(cols) // 2})"]
    cond = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    if over == "rows":
        cond += " AND NOT coalesce(home_score + away_score >= 3, false)"
    out.append(f"{p}_key0 AS (SELECT * FROM {p}_sp WHERE {cond})")
    if over == "matches":
        out.append(f"{p}_key AS (SELECT * FROM {p}_key0 WHERE id_partita NOT IN "
                   f"(SELECT id_partita FROM {p}_key0 WHERE home_score + away_score >= 3))")
    else:
        out.append(f"{p}_key AS (SELECT * FROM {p}_key0)")
    return out


def _sent(src: str, name: str) -> str:
    return f"""{name} AS (SELECT * REPLACE (
    CASE WHEN odd_over = 0 THEN 2e0 ELSE odd_over END AS odd_over,
    CASE WHEN odd_under = 0 THEN 2e0 ELSE odd_under END AS odd_under,
    CASE WHEN odd_1 = 0 THEN 3e0 ELSE odd_1 END AS odd_1,
    CASE WHEN odd_X = 0 THEN 3e0 ELSE odd_X END AS odd_X,
    CASE WHEN odd_2 = 0 THEN 3e0 ELSE odd_2 END AS odd_2) FROM {src})"""


def train_ctes(task: str, hist: str = HIST) -> list[str]:
    """Prepared training table ``tr_final`` and encoder ``tr_sm`` from HIST."""
    ctes = [SNAP, hist, _num("hist", "tr_num", BASE)]
    ctes += _clean("tr_num", "tr", BASE, ["home_final_score", "minute", "away_final_score", "id_partita"],
                   "rows" if task == "uo" else None)
    ctes.append(bin_means_sql("tr_key", IMP, "tr_bm"))
    imp, _ = impute_sql("tr_key", "tr_bm", IMP, True, "tr_imp")
    ctes.append(imp)
    ctes.append(f"tr_cl AS (SELECT * FROM tr_imp WHERE {' AND '.join(f'{c} IS NOT NULL' for c in BASE)})")
    if task == "ef":
        ctes.append(f"tr_lab AS (SELECT *, {LABEL['ef']} AS final_ef FROM tr_cl)")
        src = "tr_lab"
    else:
        src = "tr_cl"
    t = TARGET[task]
    ctes.append(f"""tr_sm AS (
  SELECT campionato, count({t}) AS n, avg({t}) AS mean,
    (count({t}) * avg({t}) + 10e0 * (SELECT avg({t}) FROM {src})) / (count({t}) + 10e0) AS smooth,
    (SELECT avg({t}) FROM {src}) AS global_mean
  FROM {src} WHERE campionato IS NOT NULL GROUP BY campionato)""")
    enc = ("CAST(coalesce(m.smooth, (SELECT max(global_mean) FROM tr_sm)) AS DOUBLE) AS campionato")
    if task == "uo":
        ctes.append(f"""tr_final AS (
  SELECT s.* REPLACE ({enc}), {LABEL['uo']} AS final_uo,
    home_score + away_score AS actual_total_goals,
    (home_score + away_score) * (90 - minute) AS over_strongness
  FROM tr_cl s LEFT JOIN tr_sm m ON s.campionato = m.campionato)""")
    else:
        ctes.append(f"""tr_final AS (
  SELECT s.* REPLACE ({enc}),
    home_score + away_score AS actual_total_goals,
    (home_score - away_score) * minute AS result_strongness
  FROM tr_lab s LEFT JOIN tr_sm m ON s.campionato = m.campionato)""")
    return ctes


def _encode(src: str, name: str) -> str:
    return (f"{name} AS (SELECT s.* REPLACE (CAST(coalesce(m.smooth, (SELECT max(global_mean) FROM tr_sm)) "
            f"AS DOUBLE) AS campionato) FROM {src} s LEFT JOIN tr_sm m ON s.campionato = m.campionato)")


def _prob(src: str, name: str, task: str) -> str:
    if task == "uo":
        return f"""{name} AS (SELECT * REPLACE (
    1 / odd_over + (1 - (1 / odd_over + 1 / odd_under)) / 2 AS odd_over,
    1 / odd_under + (1 - (1 / odd_over + 1 / odd_under)) / 2 AS odd_under) FROM {src})"""
    return f"""{name} AS (SELECT * REPLACE (
    1 / odd_1 + (1 - (1 / odd_1 + 1 / odd_2 + 1 / odd_X)) / 3 AS odd_1,
    1 / odd_X + (1 - (1 / odd_1 + 1 / odd_2 + 1 / odd_X)) / 3 AS odd_X,
    1 / odd_2 + (1 - (1 / odd_1 + 1 / odd_2 + 1 / odd_X)) / 3 AS odd_2) FROM {src})"""


def _features(task: str) -> str:
    if task == "uo":
        return ("home_score + away_score AS actual_total_goals, "
                "(home_score + away_score) * (90 - minute) AS over_strongness")
    return ("home_score + away_score AS actual_total_goals, "
            "(home_score - away_score) * minute AS result_strongness")


RAW_LIVE = BASE + ODDS + LIVE_ODDS


def test_sql(task: str) -> tuple[str, list[str]]:
    ctes = train_ctes(task) + [LIVE, _num("live", "te_num", RAW_LIVE)]
    ctes += _clean("te_num", "te", RAW_LIVE, ["id_partita", "minute", "home_final_score", "away_final_score"],
                   "matches" if task == "uo" else None)
    lab = "final_uo" if task == "uo" else "final_ef"
    ctes.append(f"te_lab AS (SELECT *, {LABEL[task]} AS {lab} FROM te_key)")
    ctes.append(_sent("te_lab", "te_sent"))
    ctes.append(bin_means_sql("tr_final", IMP, "te_bm"))
    imp, _ = impute_sql("te_sent", "te_bm", IMP, True, "te_imp")
    ctes.append(imp)
    allc = RAW_LIVE + [lab]
    ctes.append(f"te_cl AS (SELECT * FROM te_imp WHERE {' AND '.join(f'{c} IS NOT NULL' for c in allc)})")
    ctes.append(_encode("te_cl", "te_enc"))
    ctes.append(_prob("te_enc", "te_prob", task))
    keep = ["odd_under", "odd_over"] if task == "uo" else ["odd_1", "odd_X", "odd_2"]
    drop = [c for c in ("odd_1", "odd_X", "odd_2", "odd_over", "odd_under", "live_odd_1")
            if c not in keep] + ["home_final_score", "away_final_score"]
    sql = W(*ctes) + f"SELECT * EXCLUDE ({', '.join(drop)}), {_features(task)} FROM te_prob"
    doubles = [c for c in RAW_LIVE if c in NUM and c not in drop] + ["campionato", "actual_total_goals",
                                                                      "over_strongness" if task == "uo" else "result_strongness"]
    return sql, doubles


def live_sql(task: str) -> tuple[str, list[str]]:
    ctes = train_ctes(task) + [LIVE, _num("live", "lv_num", RAW_LIVE), _sent("lv_num", "lv_sent")]
    ctes.append(bin_means_sql("tr_final", IMP, "lv_bm"))
    imp, _ = impute_sql("lv_sent", "lv_bm", IMP, True, "lv_imp")
    ctes.append(imp)
    ctes.append(_prob("lv_imp", "lv_prob", task))
    keep = ["odd_under", "odd_over"] if task == "uo" else ["odd_1", "odd_X", "odd_2"]
    drop = [c for c in ("odd_1", "odd_X", "odd_2", "odd_over", "odd_under") if c not in keep]
    ctes.append(_encode("lv_prob", "lv_enc"))
    drop_all = drop + ["home_final_score", "away_final_score"]
    sql = W(*ctes) + f"SELECT * EXCLUDE ({', '.join(drop_all)}), {_features(task)} FROM lv_enc"
    doubles = [c for c in RAW_LIVE if c in NUM and c not in drop_all] + ["campionato", "actual_total_goals",
                                                                          "over_strongness" if task == "uo" else "result_strongness"]
    return sql, doubles


PREP_ORACLES: dict[str, str] = {}
for _t in ("uo", "ef"):
    _dbl = [c for c in BASE if c in NUM] + ["campionato", "actual_total_goals",
                                            "over_strongness" if _t == "uo" else "result_strongness"]
    PREP_ORACLES[f"prep_train_{_t}"] = R(W(*train_ctes(_t, WHOLE)) + "SELECT * FROM tr_final", _dbl)
    _s, _d = test_sql(_t)
    PREP_ORACLES[f"prep_test_{_t}"] = R(_s, _d)
    _s, _d = live_sql(_t)
    PREP_ORACLES[f"prep_live_{_t}"] = R(_s, _d)

_s, _ = test_sql("uo")
PREP_ORACLES["join_truth"] = (_s.rsplit("SELECT * EXCLUDE", 1)[0]
                              + "SELECT id_partita, minute, final_uo FROM te_prob")
PREP_ORACLES["sink_training"] = PREP_ORACLES["prep_train_uo"]


# ------------------------------------------------------------ result variant
def result_train_ctes(hist: str = HIST) -> list[str]:
    cols = [c for c in BASE]
    ctes = [SNAP, hist, _num("hist", "rs_num", cols)]
    ctes += _clean("rs_num", "rs", cols, ["home_final_score", "away_final_score", "id_partita"], None)
    ctes.append(bin_means_sql("rs_key", IMP, "rs_bm"))
    imp, _ = impute_sql("rs_key", "rs_bm", IMP, True, "rs_imp")
    ctes.append(imp)
    ctes.append(f"rs_cl AS (SELECT * FROM rs_imp WHERE {' AND '.join(f'{c} IS NOT NULL' for c in cols)})")
    ctes.append(f"rs_final AS (SELECT *, {LABEL['ef']} AS result, (home_score - away_score) * minute AS "
                "result_strongness FROM rs_cl)")
    return ctes


_RDBL = [c for c in BASE if c in NUM] + ["result_strongness"]
PREP_ORACLES["prep_train_result"] = R(W(*result_train_ctes(WHOLE)) + "SELECT * FROM rs_final", _RDBL)
_lcols = [c for c in RAW_LIVE if c not in ("home_final_score", "away_final_score")]
_lctes = result_train_ctes() + [LIVE, _num("live", "rl_num", _lcols)]
_lctes += _clean("rl_num", "rl", _lcols, ["id_partita"], None)
_lctes.append(_sent("rl_key", "rl_sent"))
_lctes.append(bin_means_sql("rs_final", IMP, "rl_bm"))
_imp, _ = impute_sql("rl_sent", "rl_bm", IMP, True, "rl_imp")
_lctes.append(_imp)
_lctes.append(f"rl_cl AS (SELECT * FROM rl_imp WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _lcols)})")
PREP_ORACLES["prep_live_result"] = R(
    W(*_lctes) + "SELECT *, (home_score - away_score) * minute AS result_strongness FROM rl_cl",
    [c for c in _lcols if c in NUM] + ["result_strongness"])


# ------------------------------------------------------------ which rows the models score
for _t in ("uo", "ef"):
    PREP_ORACLES[f"scored_keys_{_t}"] = f"SELECT id_partita, minute, true AS sound FROM ({PREP_ORACLES[f'prep_test_{_t}']})"
    PREP_ORACLES[f"live_keys_{_t}"] = f"SELECT DISTINCT id_partita, true AS sound FROM ({PREP_ORACLES[f'prep_live_{_t}']})"
PREP_ORACLES["scored_keys_result"] = f"SELECT id_partita, minute, true AS sound FROM ({PREP_ORACLES['prep_live_result']})"
PREP_ORACLES["roundtrip_equal"] = f"SELECT id_partita, minute, true AS equal FROM ({PREP_ORACLES['prep_test_uo']})"
