"""Citations as links in an answer's text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def link_citations(answers: DataFrame, citations: DataFrame, group: str, target: str = "#numeric-citation-") -> DataFrame:
    """Answers (group, text, others) with each citation (group, position, start, end, value) as a markdown link to its position.

    Spans are code points from 0. They are taken by start, then position: a span is linked if it lies
    behind the last linked one and the text holds its value there; others are left alone. Spans that
    are empty, negative, beyond the text or null never count. One pass over each answer's spans, and
    one over its text.
    """
    fits = (F.col("start") >= 0) & (F.col("end") > F.col("start"))
    own = citations.where(fits).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("start", "position", "end", "value"))).alias("__spans"))  # an answer's citations
    joined = answers.join(own, group, "left")
    text = F.col("text")
    inside = F.filter(F.coalesce("__spans", F.array().cast("array<struct<start:bigint,position:bigint,end:bigint,value:string>>")), lambda s: s["end"] <= F.length(text))
    right = F.filter(inside, lambda s: cut(text, s["start"], s["end"]) == s["value"])  # a wrong value never moves the cursor
    none = F.struct(F.lit(0).cast("long").alias("cursor"), F.filter(right, lambda s: F.lit(False)).alias("taken"))

    def take(state: Column, s: Column) -> Column:
        return F.when(s["start"] >= state["cursor"], F.struct(s["end"].cast("long").alias("cursor"), F.concat(state["taken"], F.array(s)).alias("taken"))).otherwise(state)

    chosen = joined.withColumn("__taken", F.aggregate(right, none, take)["taken"])
    taken = F.col("__taken")
    before = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.try_element_at(F.col("__taken.end"), i))
    parts = F.transform(taken, lambda s, i: F.concat(cut(text, before(i), s["start"]), F.lit("["), s["value"], F.lit(f"]({target}"), s["position"].cast("string"), F.lit(")")))
    tail = cut(text, F.coalesce(F.try_element_at(F.col("__taken.end"), F.lit(-1)), F.lit(0).cast("long")), F.length(text).cast("long"))
    return chosen.withColumn("text", F.concat(F.array_join(parts, ""), tail)).drop("__spans", "__taken")


def cut(text: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end``, counted from 0."""
    return F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))


def numeric_citations(checks: DataFrame, sources: DataFrame, group: str) -> DataFrame:
    """(group, position, start, end, value, source_id, file, page, kind): the numbers of an answer that a source proves.

    checks (group, start, end, raw, verified, derived, source_id); results of stated arithmetic have no
    source of their own and are left out. Positions count from 0 in order of start.
    """
    from pyspark.sql import Window

    proven = checks.where("verified and not derived and start is not null and end is not null and source_id is not null")
    place = F.row_number().over(Window.partitionBy(group).orderBy("start")) - 1
    held = sources.select(group, "source_id", "file", "page", F.coalesce("type", F.lit("text")).alias("kind"))
    found = proven.join(held, [group, "source_id"])
    return found.select(group, place.cast("long").alias("position"), "start", "end", F.col("raw").alias("value"), "source_id", "file", "page", "kind")
