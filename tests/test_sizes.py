"""What passes shuffle and what a task takes stays in proportion to the rows (plans and partitions, own rows)."""

import re

import pytest
from pyspark.sql import functions as F

from pitchlens import fixtures as fx
from pitchlens.plans import model as mdl
from pitchlens.plans.preprocess import prep_train


def plan(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


@pytest.fixture()
def small(spark, tmp_path):
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    # order 1: two lines of minute 5 that differ first in price, two of minute 6 that differ in what no column is taken from
    put("lineitem", [(1, 5, 3, 1, 7.0, 20.0, 0.01, "1996-01-02"), (1, 5, 3, 1, 9.0, 10.0, 0.05, "1996-01-03"),
                     (1, 6, 3, 1, 4.0, 10.0, 0.09, "1996-01-01"), (1, 6, 3, 1, 4.0, 10.0, 0.02, "1996-01-05"),
                     (2, 8, None, 1, 2.0, 1.0, 0.0, "1996-01-01"), (None, 5, 3, 1, 7.0, 20.0, 0.01, "1996-01-02"),
                     (3, 5, 3, 1, 7.0, 20.0, 0.01, "1996-01-02")],
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_shipdate string")
    put("orders", [(1, 10, "1996-01-01"), (2, 11, "1996-01-01"), (2, 11, "1996-01-02"), (3, None, "1996-01-01"), (None, 10, "1996-01-01")],
        "o_orderkey long, o_custkey long, o_orderdate string")
    put("customer", [(10, 0), (11, 0), (11, 0), (None, 0)], "c_custkey long, c_nationkey int")
    put("nation", [(0, "ALGERIA")], "n_nationkey int, n_name string")
    return str(tmp_path)


def test_lines_are_joined_once_and_read_no_column_they_do_not_need(spark, small):
    snap = fx.build_snap(spark, small)
    got = sorted((r["fixture_id"], r["minute"], r["match_date"], r["home_tiri"]) for r in snap.collect())
    # orders and customers that are there twice multiply, keys that are null meet nothing
    twice = [(2, 8, day, 2.0) for day in ("1996-01-01", "1996-01-02") for _ in range(2)]
    assert got == [(1, 5, "1996-01-01", 9.0), (1, 6, "1996-01-01", 4.0), *sorted(twice)]
    text = plan(snap)
    assert "l_orderkey" in re.search(r"Join Inner, (.*)", text)[1]  # the outermost join: customers came before
    assert "l_shipdate" not in plan(snap, "executedPlan") and "l_discount" not in plan(snap, "executedPlan")


@pytest.mark.parametrize("task", ["uo", "ef"])
def test_no_table_is_shuffled_by_league(spark, sf, task):
    tr = prep_train(fx.as_raw(fx.hist(spark, sf)), task)
    assert "Aggregate" not in plan(tr.encoder)  # stored, so its size is known
    assert "hashpartitioning(campionato" not in plan(tr.table, "executedPlan")


def test_a_fit_deals_rows_to_tasks_of_bounded_size(spark, monkeypatch):
    rows = [(float(i % 7), float(i % 3), (i * 7919) % 3 + 1, (i * 31) % 2) for i in range(250)]
    df = spark.createDataFrame(rows, "a double, b double, final_ef int, final_uo int").coalesce(1)
    assert mdl.dealt(df)[1] == 1
    monkeypatch.setattr(mdl, "FIT_ROWS", 100)
    data, n = mdl.dealt(df)
    sizes = data.groupBy(F.spark_partition_id()).count().collect()
    assert n == 3 and len(sizes) == 3 and max(r["count"] for r in sizes) <= 100
    assert sorted(map(tuple, data.collect())) == sorted(rows)
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    for task in ("uo", "ef"):
        m = mdl.fit(df, ["a", "b"], task, {"maxIter": 2, "maxDepth": 2})
        assert mdl.score(m, df).count() == 250
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == held
