"""Files in and out: scans of folders of texts, tables and JSON, and sinks that swap in whole folders."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Suffixes that an ingest takes, and the delimiters it tries in this order.
SUFFIXES = (".pdf", ".csv", ".xlsx", ".xls", ".txt")
DELIMITERS = (",", ";", "\t")


def scan_directory(spark: SparkSession, path: str, suffixes: Sequence[str] | None = SUFFIXES) -> DataFrame:
    """(path, suffix, length, modified) of every file below ``path`` with one of the suffixes; None takes all. No content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.col("modificationTime").alias("modified"))
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    found = files.withColumn("suffix", suffix).select("path", "suffix", "length", "modified")
    return found.where(F.col("suffix").isin(*suffixes)) if suffixes is not None else found


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, text) of every .txt file: bytes that are no UTF-8 are ignored, blank ends cut off, empty texts left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    text = F.regexp_replace(F.regexp_replace(F.col("content").cast("string"), "�", ""), r"^\s+|\s+$", "")
    return files.select("path", F.lit(1).alias("page"), text.alias("text")).where("text <> ''")


def read_delimited(spark: SparkSession, path: str, delimiters: Sequence[str] = DELIMITERS) -> DataFrame:
    """(path, row, columns, cells) of every row of every .csv file; the delimiter is the first that splits a file's first line.

    Files are read by lines, so large ones spread over tasks; a file's first line reaches its rows by
    a join. Quotes around cells are taken off; a delimiter inside quotes doesn't split. Blank lines are left out.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("at"), "value")
    lines = lines.where(F.trim("value") != "")
    heads = lines.groupBy("path").agg(F.min_by("value", "at").alias("head"), F.min("at").alias("first"))

    def cells(line: Column, mark: str) -> Column:
        parts = F.split(line, F.lit(rf'{"[" + mark + "]"}(?=(?:[^"]*"[^"]*")*[^"]*$)'))
        return F.transform(parts, lambda c: F.trim(F.regexp_replace(c, r'^\s*"|"\s*$', "")))

    split = lambda column: F.coalesce(*[F.when(F.size(cells(F.col("head"), m)) > 1, cells(column, m)) for m in delimiters], F.array(F.trim(column)))
    rows = lines.join(heads, "path").where(F.col("at") > F.col("first"))
    place = F.row_number().over(Window.partitionBy("path").orderBy("at"))
    return rows.select("path", (place - 1).cast("long").alias("row"), split(F.col("head")).alias("columns"), split(F.col("value")).alias("cells"))


def read_golden(spark: SparkSession, path: str, ids: Sequence[str] | None = None) -> DataFrame:
    """Rows of a JSON list with a question that isn't blank; with ``ids`` these only."""
    rows = spark.read.option("multiLine", "true").json(path).where(F.trim(F.coalesce(F.col("question"), F.lit(""))) != "")
    return rows.where(F.col("id").cast("string").isin(*[str(i) for i in ids])) if ids is not None else rows


def read_artefacts(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation rows of every JSON-lines file with the repetition that its name tells (``..._rep3.jsonl``); null if none."""
    rows = spark.read.option("pathGlobFilter", "*.jsonl").json(path)
    return rows.withColumn("repetition", F.regexp_extract(F.col("_metadata.file_name"), r"rep(?:eat|etition)?[_-]?(\d+)", 1).try_cast("int"))


def without_nan(df: DataFrame) -> DataFrame:
    """NaN and infinities become null in every column, in lists, maps' values and structs too."""

    def clean(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: clean(x, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.transform_values(c, lambda _, x: clean(x, kind.valueType))
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[clean(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
        return c

    return df.select(*[clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def write_swapped(df: DataFrame, path: str, form: str = "json") -> None:
    """Writes beside ``path``, then renames: what stood there moves aside, goes last, and comes back if the new folder can't take its place.

    ``form``: json (a record a line, fields of null left in), parquet. Between the two renames there is
    nothing at ``path``; readers that can't bear that read an ``index_store``, which swaps a pointer.
    """
    spark = df.sparkSession
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    writer = df.write.option("ignoreNullFields", "false") if form == "json" else df.write
    writer.format(form).save(beside)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    target, made = hadoop(path), hadoop(beside)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    aside = hadoop(f"{beside}.old")
    had = files.exists(target)
    if had and not files.rename(target, aside):
        raise OSError(f"could not move {path} aside")
    if not files.rename(made, target):
        if had:
            files.rename(aside, target)
        raise OSError(f"could not put {beside} in place of {path}")
    if had:
        files.delete(aside, True)


def node_store(spark: SparkSession, path: str, nodes: DataFrame | None = None) -> DataFrame:
    """The nodes at ``path``; given ``nodes`` it is made of them first."""
    if nodes is not None:
        write_swapped(nodes, path, "parquet")
    return spark.read.parquet(path)
