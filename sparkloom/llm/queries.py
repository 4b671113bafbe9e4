"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .block_max import SQL as SEARCH_SQL
from .block_max import op11_block_max_search
from .cap_filters import op3_cap_filter_near_dedup
from .hard_negatives import SQL as NEGATIVES_SQL
from .hard_negatives import op13_summa_hard_negatives
from .html_text import op5_block_rules_extraction
from .label_shards import op12_label_propagation_shards
from .language_id import op8_compression_language_id
from .line_dedup import op1_simhash_line_dedup
from .mpeg_audio import op4_mpeg_audio
from .odd_sketch import op2_odd_sketch_near_dedup
from .packing import op7_cutting_stock_packing
from .pivotal_mix import op6_pivotal_mixing
from .secret_scan import op10_forest_secret_scan
from .storage import read_table
from .toxicity import op9_crf_toxicity


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_simhash_line_dedup(read_table(spark, sf_dir, "documents"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_odd_sketch_near_dedup(read_table(spark, sf_dir, "documents"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_cap_filter_near_dedup(read_table(spark, sf_dir, "embeddings"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_mpeg_audio(read_table(spark, sf_dir, "documents"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_block_rules_extraction(read_table(spark, sf_dir, "pages"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_pivotal_mixing(read_table(spark, sf_dir, "documents"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_cutting_stock_packing(read_table(spark, sf_dir, "documents"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_compression_language_id(read_table(spark, sf_dir, "documents"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_crf_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_forest_secret_scan(read_table(spark, sf_dir, "documents"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_block_max_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_label_propagation_shards(read_table(spark, sf_dir, "documents"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_summa_hard_negatives(read_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash_line_dedup": op1,
        "op2_odd_sketch_near_dedup": op2,
        "op3_cap_filter_near_dedup": op3,
        "op4_mpeg_audio": op4,
        "op5_block_rules_extraction": op5,
        "op6_pivotal_mixing": op6,
        "op7_cutting_stock_packing": op7,
        "op8_compression_language_id": op8,
        "op9_crf_toxicity": op9,
        "op10_forest_secret_scan": op10,
        "op11_block_max_search": op11,
        "op12_label_propagation_shards": op12,
        "op13_summa_hard_negatives": op13,
    }


def oracle_sql() -> dict[str, str]:
    """The others can't be written in SQL; tests hold them against brute force, round trips or held-out rows."""
    return {"op11_block_max_search": SEARCH_SQL, "op13_summa_hard_negatives": NEGATIVES_SQL}
