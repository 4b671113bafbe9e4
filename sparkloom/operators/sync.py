"""Index synchronisation: manifests, diffs and incremental merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest_diff(snapshot: DataFrame, manifest: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): added, removed or modified; equal entries are left out."""
    now, then = snapshot.select(key, F.col(value).alias("now"), F.lit(True).alias("is_now")), manifest.select(key, F.col(value).alias("then"), F.lit(True).alias("was"))
    both = now.join(then, key, "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is_now").isNull(), "removed").when(~F.col("now").eqNullSafe(F.col("then")), "modified")
    return both.select(key, change.alias("change")).where("change is not null")


def merge_changed(cached: DataFrame, changed: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Cached rows of unchanged keys, and the fresh rows."""
    return cached.join(changed.select(key).distinct(), key, "left_anti").unionByName(fresh)


def split_changes(changes: DataFrame, snapshot: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Changed keys that are still there (to insert), and those that are gone (to delete)."""
    keys = snapshot.select(key)
    return changes.join(keys, key, "left_semi"), changes.join(keys, key, "left_anti")


def verify_manifest(declared: DataFrame, actual: DataFrame, path: str, digest: str) -> DataFrame:
    """(path, problem): missing, unexpected or corrupted files, and paths that leave the folder."""
    both = declared.select(path, F.col(digest).alias("told"), F.lit(True).alias("d")).join(actual.select(path, F.col(digest).alias("got"), F.lit(True).alias("a")), path, "full_outer")
    unsafe = F.col(path).startswith("/") | F.rlike(path, F.lit(r"(^|/)\.\.(/|$)"))
    problem = F.when(unsafe, "unsafe").when(F.col("a").isNull(), "missing").when(F.col("d").isNull(), "unexpected").when(~F.col("told").eqNullSafe(F.col("got")), "corrupted")
    return both.select(path, problem.alias("problem")).where("problem is not null")


def pivot_attributes(rows: DataFrame, id_col: str, key_col: str, value_cols: list[str]) -> DataFrame:
    """(id, attributes): one map an id; an attribute's value is its first typed value that isn't null."""
    value = F.coalesce(*[F.col(c).cast("string") for c in value_cols])
    return rows.groupBy(id_col).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key_col), value.alias("v"))))).alias("attributes"))
