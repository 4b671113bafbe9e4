"""Source notes under the tables of an answer: where tables stand, which sources hold their numbers, and offsets that move."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import source_label

# A number in a table's cell, a line of a table, and years, which tell no source.
CELL_NUMBER = r"\d{1,3}(?:\.\d{3})+(?:,\d+)?|\d+(?:,\d+)?"
TABLE_LINE = r"^[ \t]*\|.*\|[ \t]*$"
YEARS = (1990, 2035)
#: A number as running text bounds it: what comes before is neither digit nor mark, what comes after doesn't go on with one.
NUMBER_RUN = r"(?<![\d.,])\d+(?:[.,]\d+)*"


def distinctive_numbers(table: Column) -> Column:
    """The numbers of a table that tell it from others: no years, two characters at least."""
    found = F.array_distinct(F.regexp_extract_all(table, F.lit(CELL_NUMBER), F.lit(0)))
    year = lambda n: F.rlike(n, F.lit(r"^\d+$")) & F.coalesce(n.try_cast("long").between(*YEARS), F.lit(False))
    return F.filter(found, lambda n: (F.length(n) >= 2) & ~year(n))


def number_runs(text: Column) -> Column:
    """Every number that a text holds as a whole: a literal that isn't part of a longer one is among these."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(NUMBER_RUN), F.lit(0)))


def loose_sources(tables: DataFrame, sources: DataFrame, group: str, limit: int = 3) -> DataFrame:
    """(group, table_id, source_id, shared, place): up to ``limit`` sources that hold most of a table's numbers.

    tables (group, table_id, text), sources (group, source_id, text). Any number of literals meets any
    number of texts in one hash join on the number. A table with several numbers needs two in common.
    """
    own = tables.select(group, "table_id", distinctive_numbers(F.col("text")).alias("numbers"))
    asked = own.select(group, "table_id", F.size("numbers").alias("n"), F.explode("numbers").alias("number"))
    held = sources.select(group, "source_id", F.explode(number_runs(F.col("text"))).alias("number"))
    shared = asked.join(held, [group, "number"]).groupBy(group, "table_id", "source_id").agg(F.count(F.lit(1)).alias("shared"), F.max("n").alias("n"))
    enough = shared.where(F.col("shared") >= F.when(F.col("n") == 1, 1).otherwise(2))
    order = Window.partitionBy(group, "table_id").orderBy(F.col("shared").desc(), "source_id")
    return enough.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= limit).drop("n")


def table_spans(answers: DataFrame, group: str, text_col: str) -> DataFrame:
    """(group, table_id, start, end, lines): runs of two table lines or more, as code points from 0, the last line's end left out."""
    lines = answers.select(group, F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("i", "line"))
    order = Window.partitionBy(group).orderBy("i")
    begin = F.coalesce(F.sum(F.length("line") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bare = F.rtrim(F.col("line"), F.lit("\r"))
    placed = lines.select(group, "i", begin.alias("start"), (begin + F.length(bare)).alias("end"), F.rlike(bare, F.lit(TABLE_LINE)).alias("inside"))
    inside = placed.where("inside").withColumn("island", F.col("i") - F.row_number().over(order))
    runs = inside.groupBy(group, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("lines")).where("lines >= 2")
    return runs.select(group, (F.row_number().over(Window.partitionBy(group).orderBy("start")) - 1).cast("long").alias("table_id"), "start", "end", "lines")


def source_notes(answers: DataFrame, checks: DataFrame, sources: DataFrame, group: str) -> DataFrame:
    """(group, position, note): what is to be put behind each table of answers (group, text).

    checks (group, start, end, verified, source_id), sources (group, source_id, text, file, page). First
    come the sources of verified numbers inside the table, in order of the numbers, then those that hold
    its numbers as literals; each label once. Tables without a source get no note.
    """
    spans = table_spans(answers, group, "text")
    labels = sources.select(group, "source_id", source_label(F.col("file"), F.col("page")).alias("label"))
    inside = checks.where("verified and source_id is not null").select(group, F.col("start").alias("at"), "source_id").join(spans, group).where("at >= start and at < end")
    proven = inside.join(labels, [group, "source_id"]).select(group, "table_id", F.lit(0).alias("kind"), F.col("at").cast("long").alias("rank"), "label")
    blocks = spans.join(answers.select(group, "text"), group).select(group, "table_id", F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")).alias("text"))
    loose = loose_sources(blocks, sources, group).join(labels, [group, "source_id"]).select(group, "table_id", F.lit(1).alias("kind"), F.col("place").alias("rank"), "label")
    first = proven.unionByName(loose).groupBy(group, "table_id", "label").agg(F.min(F.struct("kind", "rank")).alias("first"))
    named = first.groupBy(group, "table_id").agg(F.array_sort(F.collect_list(F.struct("first", "label"))).alias("x"))  # the few sources of a table
    note = F.concat(F.lit("\n\n*Fonte: "), F.array_join("x.label", "; "), F.lit(".*"))
    return named.join(spans, [group, "table_id"]).select(group, F.col("end").alias("position"), note.alias("note"))


def insert_notes(answers: DataFrame, notes: DataFrame, group: str) -> DataFrame:
    """Answers (group, text, others) with the notes (group, position, note) put in, in one pass over each text."""
    gathered = notes.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("position", "note"))).alias("__notes"))  # a note a table
    joined = answers.join(gathered, group, "left")
    before = lambda i: F.when(i == 0, 0).otherwise(F.try_element_at(F.col("__notes.position"), i))
    parts = F.transform("__notes", lambda n, i: F.concat(F.substring(F.col("text"), (before(i) + 1).cast("int"), (n["position"] - before(i)).cast("int")), n["note"]))
    last = F.element_at(F.col("__notes.position"), -1)
    tail = F.substring(F.col("text"), (last + 1).cast("int"), F.greatest(F.length("text") - last, F.lit(0)).cast("int"))
    whole = F.when(F.col("__notes").isNull(), F.col("text")).otherwise(F.concat(F.array_join(parts, ""), tail))
    return joined.withColumn("text", whole).drop("__notes")


def shift_spans(spans: DataFrame, notes: DataFrame, group: str) -> DataFrame:
    """Spans (group, start, end, others) moved by the notes before them: a running sum of what was put in."""
    order = Window.partitionBy(group).orderBy("position")
    moves = notes.select(group, "position", F.sum(F.length("note")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("moved"))
    gathered = moves.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("position", "moved"))).alias("__moves"))
    by = lambda c: F.coalesce(F.array_max(F.transform(F.filter("__moves", lambda m: m["position"] <= F.col(c)), lambda m: m["moved"])), F.lit(0))
    return spans.join(gathered, group, "left").withColumns({c: (F.col(c) + by(c)).cast("long") for c in ("start", "end")}).drop("__moves")
