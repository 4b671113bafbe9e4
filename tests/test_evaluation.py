"""Evaluation joins, reports and contexts on small tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import cited_tables, contexts, evaluation, rank, stats, usage


def one(spark, build, *values):
    kinds = ", ".join(f"c{i} string" for i in range(len(values)))
    return spark.createDataFrame([values], kinds).select(build(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


def test_reasoning(spark):
    rows = [(1, [2, None, 1], None), (2, [2, 2, 0], ["menor"]), (3, [None, None, None], ["grave"]), (4, [2, 2, 2], ["menor", "grave"])]
    score, grave = evaluation.reasoning_summary(F.col("n"), F.col("e"))
    found = {r["id"]: (r["s"], r["g"]) for r in spark.createDataFrame(rows, "id int, n array<int>, e array<string>").select("id", score.alias("s"), grave.alias("g")).collect()}
    assert found == {1: (0.75, False), 2: (pytest.approx(4 / 6), True), 3: (None, True), 4: (1.0, True)}


def test_agreement(spark):
    rng = random.Random(1)
    notes = [(i, p, rng.choice((0, 1, 2, None)), 2) for i in range(60) for p in (0, 1)]
    found = {r["criterion"]: r for r in evaluation.judge_agreement(spark.createDataFrame(notes, "id int, pass int, x int, y int"), ["id"], "pass", ["x", "y"]).collect()}
    by = {(i, p): x for i, p, x, _ in notes}
    pairs = [(by[i, 0], by[i, 1]) for i in range(60) if by[i, 0] is not None and by[i, 1] is not None]
    seen = sum((a - b) ** 2 / 4 for a, b in pairs)
    due = sum((a - b) ** 2 / 4 for a, _ in pairs for _, b in pairs) / len(pairs)
    assert found["x"]["n"] == len(pairs) and found["x"]["kappa"] == pytest.approx(1 - seen / due) and found["x"]["agreement"] == pytest.approx(sum(a == b for a, b in pairs) / len(pairs))
    assert found["y"]["kappa"] == 1.0


def test_recall(spark):
    rows = spark.createDataFrame([(1, 4, 3), (2, 2, 2), (3, 0, 0)], "id int, gold int, matched int")
    assert {tuple(r) for r in evaluation.indicator_recall(rows, "id").collect()} == {(1, 0.75, False), (2, 1.0, True), (3, None, None)}


def test_report(spark):
    rng = random.Random(6)
    rows = [(q, rng.random(), rng.random() < 0.3, rng.random() < 0.5) for q in range(40) for _ in range(3)]
    df = spark.createDataFrame(rows, "q int, score double, grave boolean, right boolean").withColumn("none", F.lit(None).cast("double"))
    found = {r["metric"]: r for r in evaluation.report(df, "q", ["score", "none"], [("grave", "grave"), ("given", "case when right then grave end"), ("never", "cast(null as boolean)")], repeats=2000).collect()}
    mean = sum(r[1] for r in rows) / len(rows)
    assert found["score"]["value"] == pytest.approx(mean) and found["score"]["lo"] < mean < found["score"]["hi"] and found["score"]["n"] == len(rows)
    right = [r for r in rows if r[3]]
    assert found["given"]["value"] == pytest.approx(sum(r[2] for r in right) / len(right)) and found["given"]["n"] == len(right)
    k, n, z = sum(r[2] for r in rows), len(rows), 1.959964
    half = z * math.sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    assert found["grave"]["hi"] - found["grave"]["lo"] == pytest.approx(2 * half)
    assert found["never"]["value"] is None and found["none"]["value"] is None and found["none"]["n"] == 0


def test_context_block(spark):
    rows = [
        (1, "text", 2, "b.pdf", None, "B", None), (1, "text", 1, "a.pdf", "3", "A", None), (1, "graph", 0, None, None, "G", None), (1, "series", 0, "s.csv", "1", "S", " "), (1, "table", 0, "t.csv", "1", "T", "x: 1"), (1, "table", 1, "t.csv", "1", "T", None),
        (2, "series", 0, "s.csv", None, "S", "y: 2"), (2, "series", 1, "r.csv", None, "R", None), (3, "table", 0, "t.csv", None, "T", None),
    ]
    found = {r["q"]: r["context"] for r in contexts.context_block(spark.createDataFrame(rows, "q int, kind string, position int, file string, page string, text string, structured string"), "q").collect()}
    joint = "\n\n---\n\n"
    assert found[1] == "\n\n[Dados Estruturados de Tabelas]\n[Fonte: t.csv, p./aba 1]\nx: 1\n\n[Contexto Narrativo dos Documentos]\n" + joint.join(["[Fonte: a.pdf, p./aba 3]\nA", "[Fonte: b.pdf]\nB", "[Fonte: ?]\nG", "[Fonte: s.csv, p./aba 1]\nS"])
    assert found[2] == "\n\n[Dados de Séries Temporais]\n[Fonte: s.csv]\n[Fonte: r.csv]\ny: 2" and found[3] == ""


@pytest.mark.parametrize("at, shown", [(0, "a: 1"), (11, "b: 2\nc: 3"), (12, "b: 2\nc: 3"), (29, "d: 9")])
def test_table_snippet(spark, at, shown):
    text = "a: 1\n\n---\n b: 2 \nc: 3\n ---\nd: 9\nFonte: x.pdf"
    assert one(spark, lambda c: contexts.table_snippet(c, F.lit(at)), text) == shown


@pytest.mark.parametrize("text, length, ends", [("x" * 4000, 4000, "x"), ("x" * 4001, 4000, "[Trecho truncado]"), ("  y ", 1, "y"), (None, 0, "")])
def test_excerpts(spark, text, length, ends):
    got = one(spark, contexts.excerpt, text)
    assert len(got) == length and got.endswith(ends)


@pytest.mark.parametrize("value, year", [("1999", True), (" 2150 ", True), ("2250", False), ("199", False), (None, False), ("20000", False)])
def test_calendar_years(spark, value, year):
    assert one(spark, contexts.is_calendar_year, value) is year


def test_exact_quantiles(spark):
    rng = random.Random(5)
    rows = [(g, float(rng.randrange(200))) for g in ("a", "b") for _ in range(501 if g == "a" else 40)] + [("a", None), ("c", 7.0)]
    found = {r["g"]: r for r in stats.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"lo": 0.1, "mid": 0.5, "hi": 0.99}).collect()}
    for g in "abc":
        v = sorted(x for h, x in rows if h == g and x is not None)
        for name, share in (("lo", 0.1), ("mid", 0.5), ("hi", 0.99)):
            at = (len(v) - 1) * share
            lo, hi = v[math.floor(at)], v[math.ceil(at)]
            assert found[g][name] == pytest.approx(lo + (hi - lo) * (at - math.floor(at)))


def test_rerank_without_verdicts(spark):
    rows = spark.createDataFrame([("s", i, v) for i, v in enumerate(("3", "x", None, "9", "4", "1"))] + [("t", 0, None), ("t", 1, "")], "g string, pos int, v string")
    found = {}
    for r in rank.rerank_tolerantly(rows, ["g"], "pos", "v", 2).collect():
        found.setdefault(r["g"], []).append((r["place"], r["pos"]))
    assert sorted(found["s"]) == [(1, 3), (2, 4), (3, 1), (4, 2)] and sorted(found["t"]) == [(1, 0), (2, 1)]


@pytest.mark.parametrize(
    "text, value, kind, subject, qualifiers",
    [
        ("| a | b |\n|---|:---|\n| 1 | 2 |\n| 3 | 4,5 |", "4,5", "grid", "b", [("a", "3")]), ("1 | 2\n3 | 4", "4", "grid", "Coluna 2", [("Coluna 1", "3")]), ("| a | b |\n|---|---|", "a", None, None, None),
        ("Valor: 7\nRegião: Sul\nAno: 2020\nFonte: x", "7", "key-value", "Sul", [("Ano", "2020")]), ("Valor: 7\nAno: 2020", "7", "key-value", "Valor", [("Ano", "2020")]), ("Taxa: 7: 8\n:x\ny:", "7: 8", "key-value", "Taxa", []),
        ("Taxa: 7", "9", "key-value", None, None), ("prosa", "1", None, None, None), ("", "1", None, None, None), (None, "1", None, None, None),
    ],
)
def test_cited_cells(spark, text, value, kind, subject, qualifiers):
    df = spark.createDataFrame([(text, value)], "text string, value string")
    got = cited_tables.tell_cells(cited_tables.read_snippets(df, "text"), "value").first()
    told = None if got["qualifiers"] is None else [(q["label"], q["value"]) for q in got["qualifiers"]]
    assert (got["kind"], got["subject"], told) == (kind, subject, qualifiers)


def test_usage(spark):
    calls = spark.createDataFrame([("g", "m", "10", "4", "2"), ("g", "m", "x", None, "-3"), ("g", "n", None, None, None), ("j", "n", "7", "0", "1.9")], "bucket string, model string, prompt string, cached string, completion string")
    found = usage.accumulate(calls, ["bucket", "model"])
    assert {tuple(r) for r in found.collect()} == {("g", "m", 2, 10, 4, 2, 0), ("g", "n", 1, 0, 0, 0, 1), ("j", "n", 1, 7, 0, 1, 0)}
    prices = spark.createDataFrame([("m", 1.0, 0.5, 3.0)], "model string, fresh double, cached_price double, out double")
    assert {tuple(r) for r in usage.cost(found, prices, ["bucket"]).collect()} == {("g", 12, (6 * 1.0 + 4 * 0.5 + 2 * 3.0) / 1e6), ("j", 8, None)}
