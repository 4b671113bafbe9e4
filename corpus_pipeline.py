"""The corpus pipeline: toxicity, line dedup, near-dedup, mixing to target weights, packing.

Each stage works on all rows that its predecessor kept. All but the last return the columns of
``documents`` (and any others the table has); the mixing stage repeats a row once per copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.line_dedup import dedup_lines
from sparkloom.llm.odd_sketch import near_duplicates
from sparkloom.llm.packing import op7_cutting_stock_packing
from sparkloom.llm.pivotal_mix import take_copies
from sparkloom.llm.storage import cut, read_table
from sparkloom.llm.toxicity import THRESHOLD, fit_from_tables, score_documents


def _resized(docs: DataFrame) -> DataFrame:
    """n_chars follows the text, where the table has both."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go. Rows without an id or a text stay."""
    model = fit_from_tables(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return score_documents(docs, "text", model, keep=docs.columns).where(F.col("__score") < THRESHOLD).drop("__score", "__spans")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go; documents stay, with the text that is left."""
    return _resized(dedup_lines(docs, "doc_id", "text"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8 or more."""
    marked = near_duplicates(docs, "doc_id", "text", width=5, percent=80)
    gone = marked.where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it."""
    return take_copies(docs, "doc_id", "text", "source")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return op7_cutting_stock_packing(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_repeated_lines),
    ("near-dedup", drop_near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

#: Trained models, hashing and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are cut off from the work before them."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
