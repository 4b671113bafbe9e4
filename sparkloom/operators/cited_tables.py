"""Tables that a citation shows: read from a snippet, and the cited cell told in words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels that say nothing of what a value is of, and labels that do.
GENERIC = ("valor", "resultado", "total", "índice", "indice")
SUBJECTS = r"(?i)indicador|setor|categoria|atividade|região|regiao|produto"


def _none() -> Column:
    return F.array().cast("array<array<string>>")


def read_snippets(df: DataFrame, text_col: str) -> DataFrame:
    """Adds kind ('grid', 'key-value' or null), headers and rows of every snippet.

    Two lines with pipes make a grid: a rule below the first makes that the header, else columns are
    numbered. Other snippets are lines of 'label: value'; sources and lines without a value are left out.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(text_col, F.lit("")), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    staged = df.withColumn("__lines", lines).withColumn("__pipes", F.filter("__lines", lambda x: F.contains(x, F.lit("|"))))
    cells = F.transform("__pipes", lambda x: F.transform(F.split(F.regexp_replace(x, r"^\||\|$", ""), r"\|", -1), lambda c: F.trim(c)))
    staged = staged.withColumn("__grid", F.when(F.size("__pipes") >= 2, cells))
    ruled = F.coalesce(F.forall(F.col("__grid")[1], lambda c: F.rlike(c, F.lit(r"^:?-{3,}:?$"))), F.lit(False))
    staged = staged.withColumn("__ruled", ruled)
    staged = staged.withColumn("__rows", F.when(F.col("__ruled"), F.slice("__grid", 3, F.greatest(F.size("__grid") - 2, F.lit(0)))).otherwise(F.col("__grid")))
    pair = lambda x: F.array(F.trim(F.substring_index(x, ":", 1)), F.trim(F.regexp_replace(x, r"^[^:]*:", "")))
    entries = F.filter(F.transform(F.filter("__lines", lambda x: F.locate(":", x) > 1), pair), lambda e: (e[1] != "") & (F.lower(e[0]) != "fonte"))
    staged = staged.withColumn("__entries", entries)
    grid = F.coalesce(F.size("__rows") > 0, F.lit(False))
    numbered = F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.col("__grid")[0]), F.lit(1))), lambda i: F.concat(F.lit("Coluna "), i.cast("string")))
    kind = F.when(grid, "grid").when(F.size("__entries") > 0, "key-value")
    headers = F.when(grid, F.when(F.col("__ruled"), F.col("__grid")[0]).otherwise(numbered)).when(F.size("__entries") > 0, F.array(F.lit("Campo"), F.lit("Valor")))
    rows = F.when(grid, F.col("__rows")).when(F.size("__entries") > 0, F.col("__entries"))
    return staged.withColumn("kind", kind).withColumn("headers", headers).withColumn("rows", rows).drop("__lines", "__pipes", "__grid", "__ruled", "__rows", "__entries")


def tell_cells(df: DataFrame, value_col: str) -> DataFrame:
    """Adds subject, qualifiers (label, value) and cited_row for the cell that holds the cited value, to ``read_snippets``' columns.

    In a grid the subject is the cell's header and the rest of its row qualifies it. In a list it is the
    label, or where that is generic the value of an entry that names an indicator, a sector or the like.
    """
    target = F.trim(F.coalesce(value_col, F.lit("")))
    holds = lambda c: F.contains(c, F.col("__target"))
    listed = F.col("kind") == "key-value"
    found = df.withColumn("__target", target)
    row = F.filter(F.coalesce("rows", _none()), lambda r: F.when(listed, F.coalesce(holds(r[1]), F.lit(False))).otherwise(F.exists(r, holds)))
    found = found.withColumn("cited_row", F.try_element_at(row, F.lit(1)))
    found = found.withColumn("__at", F.array_position(F.transform("cited_row", holds), F.lit(True)).cast("int"))
    context = F.filter("rows", lambda r: r != F.col("cited_row"))
    found = found.withColumn("__context", F.when(listed, context))
    named = F.try_element_at(F.filter("__context", lambda r: F.rlike(r[0], F.lit(SUBJECTS))), F.lit(1))
    found = found.withColumn("__named", F.when(F.lower(F.col("cited_row")[0]).isin(*GENERIC), named))
    subject = F.when(listed, F.coalesce(F.col("__named")[1], F.col("cited_row")[0])).otherwise(F.coalesce(F.try_element_at("headers", F.col("__at")), F.lit("indicador")))
    label = lambda i: F.try_element_at(F.col("headers"), i + 1)
    pairs = F.transform("cited_row", lambda v, i: F.named_struct(F.lit("label"), label(i), F.lit("value"), v, F.lit("at"), i + 1))
    grid = F.transform(F.filter(pairs, lambda p: p["at"] != F.col("__at")), lambda p: F.named_struct(F.lit("label"), p["label"], F.lit("value"), p["value"]))
    rest = F.transform(F.filter("__context", lambda r: F.col("__named").isNull() | (r != F.col("__named"))), lambda r: F.named_struct(F.lit("label"), r[0], F.lit("value"), r[1]))
    told = F.col("cited_row").isNotNull()
    return found.withColumn("subject", F.when(told, subject)).withColumn("qualifiers", F.when(told, F.when(listed, rest).otherwise(grid))).drop("__target", "__at", "__context", "__named")
