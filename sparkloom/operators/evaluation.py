"""Evaluation of answers: judged details, runs side by side, agreement of judges, injected errors, and the report of it all."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import stats

#: Differences up to this are none.
SAME = 0.05


def override(details: DataFrame, judged: DataFrame, key: str) -> DataFrame:
    """``details`` with the rows of ``judged`` (the same columns) in place of those of their key; what only ``judged`` has is left out."""
    others = [c for c in details.columns if c != key]
    new = judged.select(key, F.struct(*others).alias("__new"))
    joined = details.select(key, F.struct(*others).alias("__old")).join(new, key, "left")
    return joined.select(key, F.coalesce("__new", "__old").alias("x")).select(key, "x.*").select(*details.columns)


def compare_runs(base: DataFrame, candidate: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """(key, and per metric base_, candidate_, delta_, class_): every candidate beside its baseline.

    A delta needs both values. Classes: 'better', 'worse', 'same' (up to ``SAME`` apart), 'unknown'.
    """
    left = candidate.select(key, *[F.col(m).alias(f"candidate_{m}") for m in metrics])
    both = left.join(base.select(key, *[F.col(m).alias(f"base_{m}") for m in metrics]), key, "left")
    out = [key]
    for m in metrics:
        delta = F.round(F.col(f"candidate_{m}") - F.col(f"base_{m}"), 9)
        kind = F.when(delta.isNull(), "unknown").when(delta > SAME, "better").when(delta < -SAME, "worse").otherwise("same")
        out += [f"base_{m}", f"candidate_{m}", delta.alias(f"delta_{m}"), kind.alias(f"class_{m}")]
    return both.select(*out)


def reasoning_summary(notes: Column, severities: Column) -> tuple[Column, Column]:
    """(score, grave) of an array of notes 0..2, null where a criterion doesn't apply, and the severities of the errors named."""
    given = F.filter(notes, lambda n: n.isNotNull())
    score = F.when(F.size(given) > 0, F.aggregate(given, F.lit(0.0), lambda s, n: s + n) / (2 * F.size(given)))
    grave = F.exists(given, lambda n: n == 0) | F.coalesce(F.array_contains(severities, "grave"), F.lit(False))
    return score, grave


def judge_agreement(judged: DataFrame, keys: Sequence[str], turn: str, criteria: Sequence[str], classes: int = 3) -> DataFrame:
    """(criterion, n, kappa, agreement) of the first two passes (``turn`` 0 and 1) of a judge over the same answers; notes are 0..classes-1 or null.

    Quadratic weights. Where chance explains everything (one note throughout) kappa is 1.
    """
    long = judged.select(*keys, turn, F.explode(F.create_map(*[x for c in criteria for x in (F.lit(c), F.col(c))])).alias("criterion", "note")).where("note is not null")
    a = long.where(F.col(turn) == 0).select(*keys, "criterion", F.col("note").alias("a"))
    b = long.where(F.col(turn) == 1).select(*keys, "criterion", F.col("note").alias("b"))
    pairs = a.join(b, [*keys, "criterion"]).groupBy("criterion", "a", "b").agg(F.count(F.lit(1)).alias("n"))  # classes squared a criterion
    weight = F.pow((F.col("a") - F.col("b")).cast("double"), F.lit(2.0)) / (classes - 1) ** 2
    seen = pairs.groupBy("criterion").agg(F.sum("n").alias("n"), F.sum(weight * F.col("n")).alias("o"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    rows, columns = (pairs.groupBy("criterion", c).agg(F.sum("n").alias(m)) for c, m in (("a", "x"), ("b", "y")))
    due = rows.join(columns, "criterion").groupBy("criterion").agg(F.sum(weight * F.col("x") * F.col("y")).alias("e"))
    kappa = F.when(F.col("e") == 0, 1.0).otherwise(1 - F.col("o") * F.col("n") / F.nullif(F.col("e"), F.lit(0.0)))
    return seen.join(due, "criterion").select("criterion", "n", kappa.alias("kappa"), (F.col("same") / F.col("n")).alias("agreement"))


def judge_validation(probes: DataFrame) -> DataFrame:
    """(kind, measure, value, lo, hi, n) of probes (kind, detected, flagged_any): specificity of the control, sensitivity to each injected error."""
    hit = F.when(F.col("kind") == "controle", ~F.col("flagged_any")).otherwise(F.coalesce("detected", F.lit(False)))
    counts = probes.groupBy("kind").agg(F.count_if(hit).alias("k"), F.count(F.lit(1)).alias("n"))
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    measure = F.when(F.col("kind") == "controle", "specificity").otherwise("sensitivity")
    return counts.select("kind", measure.alias("measure"), (F.col("k") / F.col("n")).alias("value"), lo.alias("lo"), hi.alias("hi"), "n")


def indicator_recall(matched: DataFrame, key: str) -> DataFrame:
    """(key, recall, all_correct) of (key, gold, matched) counts; null where an answer has no gold number."""
    some = F.col("gold") > 0
    return matched.select(key, F.when(some, F.col("matched") / F.nullif(F.col("gold"), F.lit(0))).alias("recall"), F.when(some, F.col("matched") == F.col("gold")).alias("all_correct"))


def report(answers: DataFrame, question: str, means: Sequence[str], shares: Sequence[tuple[str, str]], repeats: int = 10_000) -> DataFrame:
    """(metric, value, lo, hi, n): means with the interval of the cluster bootstrap over questions, and shares with Wilson's.

    ``means`` name numeric columns, null where they don't apply; ``shares`` are (name, condition) over the answers,
    a condition being null where an answer doesn't count. Metrics without an answer are null.
    """
    rows = []
    for m in means:
        found = stats.cluster_bootstrap(answers, [question], m, repeats).join(answers.agg(F.count(m).alias("n")))  # one row each
        rows.append(found.select(F.lit(m).alias("metric"), F.col("mean").alias("value"), "lo", "hi", "n"))
    if shares:
        counts = answers.agg(*[x for name, condition in shares for x in (F.count_if(F.expr(condition)).alias(f"k_{name}"), F.count(F.expr(condition)).alias(f"n_{name}"))])
        each = counts.select(F.explode(F.array(*[F.struct(F.lit(name).alias("metric"), F.col(f"k_{name}").alias("k"), F.col(f"n_{name}").alias("n")) for name, _ in shares])).alias("x")).select("x.*")
        lo, hi = stats.wilson(F.col("k"), F.nullif(F.col("n"), F.lit(0)))
        rows.append(each.select("metric", (F.col("k") / F.nullif(F.col("n"), F.lit(0))).alias("value"), lo.alias("lo"), hi.alias("hi"), "n"))
    return reduce(DataFrame.unionByName, rows)
