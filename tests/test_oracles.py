"""Every registered query with a SQL oracle equals DuckDB on the same tables."""

import duckdb
import pytest

from conftest import SF

import __spark_entry__ as entry_mod
from pitchlens.fixtures import TABLES
from tools.check_oracles import compare

ORACLES = entry_mod.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    line = compare(spark, con, name, entry_mod.queries()[name], ORACLES[name], SF)
    assert " OK  " in line, line


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    assert df.columns == ["id_partita", "minute", "home", "away", "home_score", "away_score",
                          "market_name", "bet_type", "prediction", "probability", "model_probability"]
    assert df.count() > 0
