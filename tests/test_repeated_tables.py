"""Plans over tables whose rows are there more than once under keys of their own, against DuckDB."""

import duckdb
import pytest
from pyspark.sql import Row

import sparkloom.plans as plans
from sparkloom.operators import rank, state


@pytest.fixture(scope="module")
def twice(tmp_path_factory, small):
    """Orders twice: every customer has each price for two orders."""
    folder = tmp_path_factory.mktemp("twice")
    duckdb.sql(f"copy (select * replace (o_orderkey + k * 1000000 as o_orderkey) from '{small}/orders.parquet', range(2) r(k)) to '{folder}/orders.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", ["shifted_checks", "table_snippets"])
def test_equal_prices(spark, twice, name):
    found = plans.queries()[name](spark, twice)
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{twice}/orders.parquet'")
    said = con.execute(plans.oracle_sql()[name])
    names = [x[0] for x in said.description]
    assert sorted(map(str, found.select(*names).collect())) == sorted(str(r) for r in (Row(**dict(zip(names, x))) for x in said.fetchall()))


@pytest.mark.parametrize("name", ["bm25_topk", "rrf_fusion", "stemmed_bm25"])
def test_lexical_search_in_buckets(spark, small, monkeypatch, name):
    """Small buckets and a query side joined by shuffle give the same ranks; pairs are ranked within buckets before any of them is shuffled."""
    whole = plans.queries()[name](spark, small)
    monkeypatch.setattr(rank, "BUCKET", 10)
    monkeypatch.setattr(rank, "BROADCAST_TERMS", 0)
    assert sorted(map(tuple, plans.queries()[name](spark, small).collect())) == sorted(map(tuple, whole.collect()))
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert "bucket#" in plan and plan.count("RepartitionByExpression [bucket#") == plan.count("RepartitionByExpression") > 0


def test_admission_walks_in_batches(spark):
    rows = [(1, 7, "2024-01-01 00:00:00"), (2, 7, "2024-01-01 10:00:00"), (3, 7, "2024-01-01 23:00:00"), (4, 7, "2024-01-02 00:00:01"), (5, None, "2024-01-01 00:00:00"), (6, 8, None)]
    events = spark.createDataFrame(rows, "event_id int, user_id int, at string").selectExpr("event_id", "user_id", "cast(at as timestamp) as ts")
    found = state.admit(events, "user_id", "ts", 2, 86_400)
    assert {r["event_id"]: r["admitted"] for r in found.collect()} == {1: True, 2: True, 3: False, 4: True, 5: True, 6: True}
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().optimizedPlan().toString()
