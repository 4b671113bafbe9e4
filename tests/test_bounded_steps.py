"""Steps whose cost must not grow with what they are applied to."""

import numpy as np
from pyspark.sql import functions as F

import sparkloom.plans as plans
from sparkloom.operators import rank, validate


def test_equations_are_found_once(spark):
    """One search a text, whatever is read from its matches; signs, spaces, per cent and several equations as before."""
    texts = ["1.234,50 - 34,50 = 1.200,00 e 2 × 3 = 6; 7 / 2 = 3,4", "10 % + 5 = 15", "8 ÷ 2 = 4", "sem números", None]
    df = spark.createDataFrame([(i, t, ["1234.50", "34.50", "2", "3", "7", "10", "5"]) for i, t in enumerate(texts)], "i int, t string, known array<string>")
    found = df.select("i", validate.derived_results(F.col("t"), F.col("known")).alias("r"))
    assert {r["i"]: r["r"] for r in found.collect()} == {0: ["1200.00", "6"], 1: ["15"], 2: [], 3: [], 4: None}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_vector_scores_are_held_in_bounded_pieces(spark, monkeypatch):
    """No comparison holds more scores than allowed (or one query's), and pieces give the whole result."""
    monkeypatch.setattr(rank, "SCORES", 700)
    v = np.random.default_rng(5).normal(size=(300, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, v array<double>")
    got = rank.vector_topk(df.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id"), df, 5).collect()
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    score = np.round(unit @ unit.T, 6)
    np.fill_diagonal(score, -np.inf)
    want = {(q, int(i)) for q in range(0, 300, 10) for i in np.argsort(-score[q], kind="stable")[:5]}
    assert {(r["query_id"], r["vec_id"]) for r in got} == want


def test_numbers_are_never_broadcast(spark, small):
    """Spark takes a small table for small, but the numbers of the texts made from it are not: none of them goes through the driver."""
    found = plans.queries()["verify_numbers"](spark, small)
    assert len(found.collect()) == 1500
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") >= 4 and "Broadcast" not in plan
    assert "ReusedExchange" in plan  # source numbers are found once, for their classes and their places


def test_equal_numbers_are_one_class(spark):
    """Source numbers that differ only in their place are scored once; classes of one score are used up in the order of their numbers' places."""
    told = [(1, i, f"A renda {'nova' if i % 2 else 'velha'} foi de 5.") for i in range(6)]
    answers = spark.createDataFrame([(1, "A renda foi de 5. " * 8), (2, "A renda foi de 5. " * 3), (3, " ".join(f"A renda foi de {i},5." for i in range(10_000)))], "answer_id int, text string")
    found = validate.verify_numbers(answers, spark.createDataFrame([*told, (2, 9, "A renda foi de 5. E a renda foi de 5,0.")], "answer_id int, source_id int, text string"))
    rows = found.orderBy("answer_id", "start").collect()
    assert [r["source_id"] for r in rows if r["answer_id"] == 1] == [0, 1, 2, 3, 4, 5, None, None]
    assert [(r["source_id"], r["source_start"]) for r in rows if r["answer_id"] == 2] == [(9, 15), (None, None), (None, None)]
    assert len(rows) == 10_011 and "dense_rank" in found._jdf.queryExecution().optimizedPlan().toString()


def test_snippets_of_every_order(spark, small):
    """Each order has its snippet; orders meet the reports by sort and merge, and a report's blocks are found before they do."""
    found = plans.queries()["table_snippets"](spark, small)
    orders = spark.read.parquet(f"{small}/orders.parquet")
    assert len(found.collect()) == orders.count() and found.select("answer_id").distinct().count() == orders.select("o_custkey").distinct().count()
    assert "%" not in plans.oracle_sql()["table_snippets"].split("where")[-1]
    plan = found._jdf.queryExecution()
    assert "SortMergeJoin" in plan.executedPlan().toString() and plan.optimizedPlan().toString().count("aggregate(") == 1
