"""Retrieval of tables and of series for many questions at once, and contexts by level."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import limit_context, scrub_controls, text_key

from .rank import dedup_two_keys
from .tables import is_static, is_temporal

CANDIDATES, FALLBACK, KEPT, BUDGET = 60, 3, 12, 24_000
JOINT = "\n\n---\n\n"
# Fixed value: what in a context names a period.
PERIOD = r"(?iu)([1-4][oO°]\s*trim)|(\b(19|20)\d{2}\b)|(jan(eiro)?|fev(ereiro)?|mar(ço)?|abr(il)?|mai(o)?|jun(ho)?|jul(ho)?|ago(sto)?|set(embro)?|out(ubro)?|nov(embro)?|dez(embro)?)|(\b(período|data|mês|mes|trimestre|semestre|anual|mensal)\b)"


def names_period(context: Column) -> Column:
    return F.rlike(context, F.lit(PERIOD))


def structured_chain(
    candidates: DataFrame, question: str, series: bool, extract: Callable[[Column], Column], accepted: str | None = None, kept: int = KEPT, limit: int = CANDIDATES, budget: int = BUDGET
) -> DataFrame:
    """(question, outcome, nodes, structured) for every question of candidates (question, position, node_id, type, granularity, text).

    Static tables, or with ``series`` temporal ones, without repeats of id or text, are cut to ``limit``;
    ``accepted`` names a column with a reranker's score, null where it refused. The best ``kept`` of those it
    accepted make the context, or the first ``FALLBACK`` if there are none. ``extract`` makes the structured
    text of a context, null or blank where it finds nothing; a series' context without a period is never
    handed to it. Outcomes: 'none' (no table at all), 'nodes' (tables, nothing extracted), 'text'.
    """
    kind = is_temporal if series else is_static
    asked = candidates.select(question).distinct()
    clean = candidates.where(kind(F.col("type"), F.col("granularity"))).withColumn("text", scrub_controls(F.col("text"))).withColumn("__key", text_key(F.col("text")))
    once = dedup_two_keys(clean, [question], "node_id", "__key", "position").drop("__key")
    order = Window.partitionBy(question).orderBy("position")
    first = once.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= limit)
    score = F.col(accepted).try_cast("double") if accepted else -F.col("position").cast("double")
    own = Window.partitionBy(question)
    judged = first.withColumn("__s", score).withColumn("__any", F.max(F.col("__s").isNotNull().cast("int")).over(own) > 0)
    place = F.row_number().over(own.orderBy(F.when(F.col("__any"), F.col("__s")).desc_nulls_last(), "position"))
    used = judged.withColumn("__place", place).where(F.when(F.col("__any"), F.col("__s").isNotNull() & (F.col("__place") <= kept)).otherwise(F.col("__place") <= FALLBACK))
    held = used.groupBy(question).agg(F.array_sort(F.collect_list(F.struct("__place", "node_id", "text"))).alias("x"))  # ``kept`` nodes at most
    context = limit_context(F.array_join("x.text", JOINT), budget)
    made = held.select(question, F.col("x.node_id").alias("nodes"), context.alias("__context"))
    found = F.nullif(F.trim(extract(F.col("__context"))), F.lit(""))
    made = made.withColumn("structured", F.when(names_period(F.col("__context")), found) if series else found).drop("__context")
    outcome = F.when(F.col("nodes").isNull(), "none").when(F.col("structured").isNull(), "nodes").otherwise("text")
    return asked.join(made, question, "left").select(question, outcome.alias("outcome"), "nodes", "structured")


def node_level(raw: Column) -> Column:
    """A whole number of 0 or more; anything else is level 0."""
    return F.greatest(F.coalesce(raw.try_cast("int"), F.lit(0)), F.lit(0))


def level_context(nodes: DataFrame, question: str, quota: int | None = None) -> DataFrame:
    """(question, levels, context): the nodes (question, position, level, text) in sections by level, summaries before details.

    ``quota`` is the number of nodes that each level may give, the first by position; a blank text gives none.
    """
    levelled = nodes.where(F.trim(F.col("text")) != "").withColumn("__level", node_level(F.col("level")))
    if quota:
        place = F.row_number().over(Window.partitionBy(question, "__level").orderBy("position"))
        levelled = levelled.withColumn("__n", place).where(F.col("__n") <= quota).drop("__n")
    sections = levelled.groupBy(question, "__level").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), JOINT).alias("body"))
    title = F.when(F.col("__level") == 0, F.lit("[Trechos originais (nível 0)]\n")).otherwise(F.concat(F.lit("[Resumos automáticos — nível "), F.col("__level").cast("string"), F.lit("]\n")))
    parts = sections.groupBy(question).agg(F.sort_array(F.collect_list(F.struct("__level", F.concat(title, "body").alias("part"))), asc=False).alias("x"))  # a part a level
    return parts.select(question, F.size("x").cast("long").alias("levels"), F.array_join("x.part", "\n\n").alias("context"))
