"""Operators beyond SQL against plain Python on small tables."""

import itertools
import math
import re

import pytest
from pyspark.sql import functions as F

import sparkloom.plans as plans
from sparkloom.operators import rank, state, stats, tables

def test_recursive_chunks(spark, small):
    """Pieces are in order, within the size, cover every word and begin with units of the piece before."""
    size, overlap = 300, 60
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    number = itertools.count()
    texts = {i: re.sub(r"\w+", lambda m: f"{m[0]}{next(number)}", t) for i, t in texts.items()}  # no two words alike: a piece has one place
    texts[-1] = "".join(map(str, range(1000, 1400))) + ". Short end."
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {}
    for r in tables.split_recursively(df, "doc_id", "text", size, overlap).orderBy("doc_id", "chunk_idx").collect():
        found.setdefault(r["doc_id"], []).append(r["text"])
    for i, text in texts.items():
        at, pieces = 0, found.get(i, [])
        assert bool(pieces) == bool(text.strip())
        for n, piece in enumerate(pieces):
            assert 0 < len(piece) <= size and piece == piece.strip()
            blanks = len(text[at:]) - len(text[at:].lstrip())
            start = text.rfind(piece, 0, at + blanks + len(piece))  # nothing between two pieces but blanks
            assert start >= (at - overlap - 4 if n else 0)
            at = start + len(piece)
        assert not text[at:].strip()


def test_recursive_chunks_take_the_coarsest_mark(spark):
    text = "first part of it\n\n" + "second one. " * 10 + "\n\nthird"
    rows = tables.split_recursively(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"), "doc_id", "text", 125, 0).orderBy("chunk_idx").collect()
    assert [r["text"] for r in rows] == ["first part of it", ("second one. " * 10).strip(), "third"]


def brute_two_keys(rows):
    ids, texts, kept = set(), set(), []
    for row in sorted(rows, key=lambda r: r["position"]):
        if row["id"] not in ids and row["text"] not in texts:
            ids.add(row["id"])
            texts.add(row["text"])
            kept.append(row)
    return kept


def test_dedup_by_two_keys(spark, small):
    e = spark.read.parquet(f"{small}/events.parquet").selectExpr("user_id % 7 as g", "event_id as position", "event_type || cast(value as int) % 5 as id", "cast(cast(value as int) % 9 as string) as text")
    by_group = {}
    for r in e.collect():
        by_group.setdefault(r["g"], []).append(r)
    want = {(g, r["position"]) for g, rows in by_group.items() for r in brute_two_keys(rows)}
    assert {(r["g"], r["position"]) for r in rank.dedup_two_keys(e, ["g"], "id", "text", "position").collect()} == want
    odd = spark.createDataFrame([(None, 1, None, "a"), (None, 2, None, "b"), (1, 3, "x", None)], "g long, position long, id string, text string")
    assert sorted(r["position"] for r in rank.dedup_two_keys(odd, ["g"], "id", "text", "position").collect()) == [1, 3]


def test_admission(spark, small):
    e = spark.read.parquet(f"{small}/events.parquet").select("event_id", "user_id", "ts")
    got = {r["event_id"]: r["admitted"] for r in state.admit(e, "user_id", "ts", 2, 86_400).collect()}
    held, want = {}, {}
    for r in sorted(e.collect(), key=lambda r: (r["ts"], r["event_id"])):
        recent = [x for x in held.get(r["user_id"], []) if (r["ts"] - x).total_seconds() <= 86_400]
        want[r["event_id"]] = len(recent) < 2
        held[r["user_id"]] = recent + [r["ts"]] * want[r["event_id"]]
    assert got == want and not all(want.values())


@pytest.mark.parametrize("b, c", [(0, 0), (1, 0), (3, 9), (10, 10), (40, 61), (2000, 2100)])
def test_mcnemar(spark, b, c):
    got = spark.range(1).select(stats.mcnemar_exact(F.lit(b), F.lit(c)).alias("p")).first()["p"]
    n, k = b + c, min(b, c)
    want = 1.0 if not n else min(1.0, 2 * sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(k + 1)))
    assert abs(got - want) < 1e-6


def test_bootstrap_interval_holds_the_mean(spark, small):
    r = plans.queries()["bootstrap_interval"](spark, small).first()
    assert r["lo"] < r["mean"] < r["hi"] and (r["hi"] - r["lo"]) < 0.5 * r["mean"]
    again = plans.queries()["bootstrap_interval"](spark, small).first()
    assert (r["lo"], r["hi"]) == (again["lo"], again["hi"])


def test_tree_levels(spark, small):
    levels = {r["level"]: (r["nodes"], r["edges"]) for r in plans.queries()["kmeans_tree"](spark, small).collect()}
    assert levels[0][0] == spark.read.parquet(f"{small}/embeddings.parquet").where("embedding is not null").count()
    assert all(levels[k + 1][0] < levels[k][0] == levels[k][1] for k in range(len(levels) - 1)) and levels[max(levels)][1] == 0


def test_vectors_in_blocks(spark, small):
    """Small blocks and parts find what one block finds; nulls find nothing."""
    e = spark.read.parquet(f"{small}/embeddings.parquet").selectExpr("vec_id", "embedding as v", "label")
    e = e.unionByName(spark.createDataFrame([(-1, None, 0)], e.schema))
    q = e.where("vec_id % 50 = 0 or vec_id < 0").withColumnRenamed("vec_id", "query_id")
    whole = sorted(map(tuple, rank.vector_topk(q, e, 5, label=True).collect()))
    assert whole == sorted(map(tuple, rank.vector_topk(q, e, 5, label=True, block=3, part=40).collect())) and all(x[0] >= 0 for x in whole)
