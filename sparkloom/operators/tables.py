"""Pipe tables: reading, chunking and inferring what they hold."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import fold

SMALL_TABLE_ROWS = 10
JOINT = "\n---\n"
# Granularity words that make a table a series.
TEMPORAL_WORDS = ("mensal", "trimestral", "semestral", "bimestral", "semanal", "diário", "diaria", "diária", "anual", "ano a ano")
# Month names, as folded text has them.
MONTHS = "janeiro fevereiro marco abril maio junho julho agosto setembro outubro novembro dezembro".split()


def parse_pipe_tables(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row_idx, header, cells) of every data row; the first pipe line is the header, rules and rows of other width go.

    Text with fewer than two pipe lines has no rows.
    """
    lines = F.filter(F.transform(F.split(F.col(text_col), "\n"), lambda x: F.trim(x)), lambda x: F.contains(x, F.lit("|")))
    content = F.filter(lines, lambda x: ~F.rlike(x, F.lit(r"^[|\s:\-]+$")))
    cells = F.transform(content, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)))
    parsed = df.select(F.col(id_col), cells.alias("grid")).where(F.size("grid") >= 2)
    rows = parsed.select(id_col, F.col("grid")[0].alias("header"), F.posexplode(F.slice("grid", 2, F.greatest(F.size("grid") - 1, F.lit(0)))).alias("pos", "cells"))
    good = rows.where(F.size("cells") == F.size("header"))
    place = F.row_number().over(Window.partitionBy(id_col).orderBy("pos"))
    return good.select(id_col, (place - 1).cast("long").alias("row_idx"), "header", "cells")


def row_text(header: Column, cells: Column, source: Column) -> Column:
    """'column: value' lines of a row without its blanks, then the source."""
    pairs = F.filter(F.arrays_zip(header.alias("h"), cells.alias("c")), lambda p: F.trim(p["c"]) != "")
    return F.concat(F.array_join(F.transform(pairs, lambda p: F.concat(p["h"], F.lit(": "), p["c"])), "\n"), F.lit("\nFonte: "), source)


def chunk_tables(rows: DataFrame, id_col: str, text_col: str = "row_text", small: int = SMALL_TABLE_ROWS) -> DataFrame:
    """(id, chunk_idx, strategy, text): a table of ``small`` rows at most is one chunk, longer ones a chunk per row."""
    sizes = rows.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
    sized = rows.join(sizes, id_col)
    whole = (
        sized.where(F.col("n") <= small)
        .groupBy(id_col)
        .agg(F.array_sort(F.collect_list(F.struct("row_idx", text_col))).alias("parts"))
        .select(id_col, F.lit(0).cast("long").alias("chunk_idx"), F.lit("full_table").alias("strategy"), F.array_join(F.col(f"parts.{text_col}"), JOINT).alias("text"))
    )
    single = sized.where(F.col("n") > small).select(id_col, F.col("row_idx").alias("chunk_idx"), F.lit("row_per_chunk").alias("strategy"), F.col(text_col).alias("text"))
    return whole.unionByName(single)


def years_in(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)\b(?:19|20)\d{2}\b"), F.lit(0))))


def table_period(years: Column) -> Column:
    return F.when(F.size(years) == 0, "").when(F.size(years) == 1, years[0]).otherwise(F.concat(years[0], F.lit("-"), F.element_at(years, -1)))


def granularity(text: Column) -> Column:
    """Monthly before quarterly before annual (two years or more), else unknown."""
    low = fold(text)
    monthly = F.rlike(low, F.lit(r"\b(" + "|".join(MONTHS) + r"|mensal)\b"))
    quarterly = F.rlike(low, F.lit(r"\b([1-4]o? ?trimestre|trimestral|[1-4]t)\b"))
    return F.when(monthly, "mensal").when(quarterly, "trimestral").when(F.size(years_in(text)) >= 2, "anual").otherwise("")


def is_temporal(kind: Column, grain: Column) -> Column:
    """A table whose granularity names a rhythm; without one it is static."""
    low = F.lower(F.coalesce(grain, F.lit("")))
    found = F.exists(F.array(*[F.lit(w) for w in TEMPORAL_WORDS]), lambda w: F.contains(low, w))
    return (F.coalesce(kind, F.lit("")) == "table") & found


def is_static(kind: Column, grain: Column) -> Column:
    return (F.coalesce(kind, F.lit("")) == "table") & ~is_temporal(kind, grain)


def is_narrative(kind: Column) -> Column:
    """What the text path keeps: anything that is no table, an unknown kind included."""
    return ~kind.eqNullSafe(F.lit("table"))


def valid_series(rows: DataFrame, id_col: str, first_col: str, width: int) -> DataFrame:
    """(id, valid): two rows and columns at least; a first column of words, or of numbers that are all years in 1900..2100.

    A column is one of numbers if no value that it has is anything else; a missing value is no year.
    """
    number = F.col(first_col).try_cast("double")
    found = rows.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(F.col(first_col).isNotNull() & number.isNull()).alias("words"), F.bool_and(F.coalesce(number.between(1900, 2100), F.lit(False))).alias("years")
    )
    return found.select(id_col, ((F.col("n") >= 2) & (F.lit(width) >= 2) & (F.col("words") | F.col("years"))).alias("valid"))


def islands(lines: DataFrame, id_col: str, order: str, inside: str, least: int) -> DataFrame:
    """(id, first, last, lines) of every run of ``least`` or more consecutive lines inside, places counted from 0."""
    kept = lines.where(inside).withColumn("__island", F.col(order) - F.row_number().over(Window.partitionBy(id_col).orderBy(order)))
    runs = kept.groupBy(id_col, "__island").agg(F.min(order).cast("long").alias("first"), F.max(order).cast("long").alias("last"), F.count(F.lit(1)).alias("lines"))
    return runs.where(F.col("lines") >= least).drop("__island")


def fixed_stride_chunks(df: DataFrame, id_col: str, text_col: str, size: int = 1024, overlap: int = 200) -> DataFrame:
    """(id, chunk_idx, start, text): windows of ``size`` characters, each beginning ``size - overlap`` after the last."""
    step = size - overlap
    count = F.greatest(F.ceil((F.length(text_col) - overlap) / step), F.lit(1)).cast("int")
    rows = df.where(F.length(text_col) > 0).select(id_col, text_col, F.explode(F.sequence(F.lit(0), count - 1)).alias("k"))
    start = F.col("k") * step
    return rows.select(id_col, F.col("k").cast("long").alias("chunk_idx"), start.cast("long").alias("start"), F.substring(F.col(text_col), start + 1, F.lit(size)).alias("text"))


def split_recursively(df: DataFrame, id_col: str, text_col: str, size: int = 1024, overlap: int = 200) -> DataFrame:
    """(id, chunk_idx, text): pieces of at most ``size`` characters cut at the coarsest separator that fits.

    Paragraph breaks first, then lines, sentences, blanks, and characters at last; a piece begins
    with whole units from the end of the one before, ``overlap`` characters at most.
    """
    separators = ("\n\n", "\n", ". ", " ", "")

    def units(text: str, level: int = 0) -> list[str]:
        if len(text) <= size:
            return [text]
        mark = separators[level]
        if not mark:
            return [text[i : i + size] for i in range(0, len(text), size)]
        parts = text.split(mark)
        parts = [p + mark for p in parts[:-1]] + [parts[-1]]
        return [u for p in parts if p for u in units(p, level + 1)]

    def pieces(text: str | None) -> list[str]:
        out, held, used = [], [], 0
        for unit in units(text or ""):
            if held and used + len(unit) > size:
                out.append("".join(held).strip())
                while held and (used > overlap or used + len(unit) > size):
                    used -= len(held.pop(0))
            held.append(unit)
            used += len(unit)
        out.append("".join(held).strip())
        return [p for p in out if p]

    @F.pandas_udf("array<string>")
    def cut_up(texts: pd.Series) -> pd.Series:
        return texts.map(pieces)

    found = df.select(id_col, F.posexplode(cut_up(F.col(text_col))).alias("pos", "text"))
    return found.select(id_col, F.col("pos").cast("long").alias("chunk_idx"), "text")
