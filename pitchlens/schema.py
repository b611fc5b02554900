"""Column names and types of the snapshot table.

One row = one match at one minute.  Text columns are strings, everything
else numeric (doubles in files, integers where the fixture derives them).
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the source data's naming for results to match)
# ---------------------------------------------------------------------------
# The 18 per-side statistics, in file order; each exists as home_<s>, away_<s>.
STATS = [
    "possesso_palla", "tiri", "tiri_in_porta", "tiri_fuori", "tiri_fermati",
    "punizioni", "calci_d_angolo", "fuorigioco", "rimesse_laterali", "parate",
    "falli", "cartellini_rossi", "cartellini_gialli", "passaggi_totali",
    "passaggi_completati", "contrasti", "attacchi", "attacchi_pericolosi",
]
# Statistics the live API does not deliver.
API_MISSING_STATS = ["punizioni", "rimesse_laterali", "contrasti", "attacchi",
                     "attacchi_pericolosi"]
API_MISSING_COLS = [f"{side}_{s}" for s in API_MISSING_STATS for side in ("home", "away")]
# Possession is imputed with a constant, not a minute-bin mean.
POSSESSION = "possesso_palla"
POSSESSION_FILL = 50.0
# Text columns (everything else is cast to numeric).
CAT_COLS = ["home", "away", "campionato", "date", "id_partita"]
# Columns dropped before fitting (id-like).
ID_COLS = ["home", "away", "date", "id_partita"]
KEY = "id_partita"
MINUTE = "minute"
FINAL_COLS = ["home_final_score", "away_final_score"]
PREMATCH_ODDS = ["odd_1", "odd_X", "odd_2", "odd_over", "odd_under"]
LIVE_ODDS = ["live_odd_1", "live_odd_X", "live_odd_2", "live_odd_over", "live_odd_under"]
# Missing odds are stored as 0 and replaced by these before conversion.
SENTINEL_UO = 2.0      # odd_over, odd_under
SENTINEL_1X2 = 3.0     # odd_1, odd_X, odd_2
# Blend of model and market probability by match minute:
#   model weight = 0.4 + 0.6/90 * minute, market weight = 0.6 - 0.6/90 * minute
BLEND_BASE = 0.4
BLEND_SPAN = 0.6
BLEND_MINUTES = 90.0
ALERT_THRESHOLD = 0.7
LIVE_MINUTE_THRESHOLD = 30
# Minute bins for imputation: [m, m+5] for m = 5, 10, ..., 85; later bins win.
BIN_WIDTH = 5
BIN_FIRST = 5
BIN_LAST = 85
SMOOTHING_M = 10
FOLD_SEED = 12
# Exchange market and runner names.
MARKET_UO = "Over/Under 2.5 Goals"
MARKET_1X2 = "Match Odds"
RUNNER_NAMES = {"under": "Under 2.5 Goals", "over": "Over 2.5 Goals", "X": "The Draw"}
# Best-quote defaults when the book side is empty or zero.
DEFAULT_BACK_PRICE = 1.01
DEFAULT_LAY_PRICE = 1000.0
DEFAULT_SIZE = 1.01
# Budget reset once every slot is used and exposure allows it.
BUDGET_RESET = {"high": 1, "low": 2}
# API statistic names -> snapshot stat names (statistics payload).
API_STAT_NAMES = [
    ("Ball Possession", "possesso_palla"),
    ("Total Shots", "tiri"),
    ("Shots on Goal", "tiri_in_porta"),
    ("Shots off Goal", "tiri_fuori"),
    ("Blocked Shots", "tiri_fermati"),
    ("Corner Kicks", "calci_d_angolo"),
    ("Offsides", "fuorigioco"),
    ("Goalkeeper Saves", "parate"),
    ("Fouls", "falli"),
    ("Red Cards", "cartellini_rossi"),
    ("Yellow Cards", "cartellini_gialli"),
    ("Total passes", "passaggi_totali"),
    ("Passes accurate", "passaggi_completati"),
]
# Odds payload labels.
UO_LABELS = {"Over 2.5": "odd_over", "Under 2.5": "odd_under"}
X12_LABELS = {"Home": "odd_1", "Draw": "odd_X", "Away": "odd_2"}
FINISHED_STATUS = "Match Finished"
# ---------------------------------------------------------------------------


def stat_cols(stats=STATS) -> list[str]:
    out = []
    for s in stats:
        out += [f"home_{s}", f"away_{s}"]
    return out


def present_stats(columns, stats=STATS) -> list[str]:
    """Stats whose home_ and away_ columns both exist in ``columns``."""
    cols = set(columns)
    return [s for s in stats if f"home_{s}" in cols and f"away_{s}" in cols]


def snapshot_schema(stats=STATS, with_live_odds=True, with_finals=True) -> T.StructType:
    """Explicit schema of a historical snapshot CSV (index column first)."""
    fields = [T.StructField("_c0", T.LongType()),
              T.StructField("date", T.StringType()),
              T.StructField("id_partita", T.StringType()),
              T.StructField("minute", T.DoubleType()),
              T.StructField("home", T.StringType()),
              T.StructField("away", T.StringType()),
              T.StructField("campionato", T.StringType()),
              T.StructField("home_score", T.DoubleType()),
              T.StructField("away_score", T.DoubleType())]
    fields += [T.StructField(c, T.DoubleType()) for c in stat_cols(stats)]
    fields += [T.StructField(c, T.DoubleType()) for c in PREMATCH_ODDS]
    if with_live_odds:
        fields += [T.StructField(c, T.DoubleType()) for c in LIVE_ODDS]
    if with_finals:
        fields += [T.StructField(c, T.DoubleType()) for c in FINAL_COLS]
    return T.StructType(fields)
