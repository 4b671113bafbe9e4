"""Summary trees and property graphs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import entity_name, limit_context

MEMBERS, LEVELS, LEAST_NODES, RESTARTS = 20, 3, 4, 10


def cluster_texts(nodes: DataFrame, cluster: str, node: str, text: Column, max_tokens: int, members: int = MEMBERS) -> DataFrame:
    """(cluster, size, text): the first ``members`` texts joined and cut to the token budget."""
    place = F.row_number().over(Window.partitionBy(cluster).orderBy(node))
    shown = nodes.withColumn("__text", text).withColumn("__n", place)
    joined = shown.where(F.col("__n") <= members).groupBy(cluster).agg(F.array_sort(F.collect_list(F.struct("__n", "__text"))).alias("p"))
    sizes = nodes.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"))
    return joined.join(sizes, cluster).select(cluster, "size", limit_context(F.array_join("p.__text", "\n\n"), max_tokens).alias("text"))


def cluster_sources(nodes: DataFrame, cluster: str, source: str) -> DataFrame:
    """(cluster, source_files, source_file): distinct sources in order, and the first of them."""
    found = nodes.groupBy(cluster).agg(F.array_sort(F.collect_set(source)).alias("s"))
    return found.select(cluster, F.array_join("s", ",").alias("source_files"), F.col("s")[0].alias("source_file"))


def kmeans_groups(nodes: DataFrame, vector: str, k: int, seed: int = 42, restarts: int = RESTARTS) -> DataFrame:
    """Adds ``cluster``: the best of several seeded k-means runs by training cost."""
    data = nodes.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>"))).persist()
    models = [KMeans(k=k, seed=seed + i, featuresCol="__v", predictionCol="cluster").fit(data) for i in range(restarts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    found = best.transform(nodes.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))).drop("__v")
    data.unpersist()
    return found


def mean_members(grouped: DataFrame) -> DataFrame:
    """(cluster, v): each cluster's mean vector, summed place by place."""
    places = grouped.select("cluster", F.posexplode("v").alias("place", "x")).groupBy("cluster", "place").agg(F.avg("x").alias("x"))
    return places.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda p: p["x"]).alias("v"))  # a vector's places


def build_tree(nodes: DataFrame, summarise: Callable[[DataFrame], DataFrame], levels: int = LEVELS, least: int = LEAST_NODES, restarts: int = RESTARTS) -> tuple[DataFrame, DataFrame]:
    """(all nodes with their level, edges parent to child) of (node_id string, v) leaves.

    ``summarise`` makes (cluster, node_id, v) of clustered nodes: the model's place. Levels end
    when fewer than ``least`` nodes are left.
    """
    level, found, edges = nodes.select("node_id", "v"), nodes.select("node_id", "v", F.lit(0).alias("level")), None
    for depth in range(1, levels + 1):
        n = level.count()
        if n < least:
            break
        k = min(max(2, int(n**0.5)), n // 2)
        grouped = kmeans_groups(level, "v", k, restarts=restarts)
        parents = summarise(grouped).withColumn("node_id", F.concat(F.lit(f"L{depth}-"), F.col("cluster").cast("string")))
        link = grouped.select(F.concat(F.lit(f"L{depth}-"), F.col("cluster").cast("string")).alias("parent_id"), F.col("node_id").alias("child_id"))
        edges = link if edges is None else edges.unionByName(link)
        level = parents.select("node_id", "v")
        found = found.unionByName(level.withColumn("level", F.lit(depth)))
    return found, edges


def merge_entities(triplets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of (subject, relation, object) rows with names brought to one form."""
    edges = triplets.select(entity_name(F.col("subject")).alias("src"), "relation", entity_name(F.col("object")).alias("dst")).distinct()
    vertices = edges.select(F.col("src").alias("name")).unionByName(edges.select(F.col("dst").alias("name"))).groupBy("name").agg(F.count(F.lit(1)).alias("degree"))
    return vertices, edges


def two_hops(seeds: DataFrame, edges: DataFrame, seen: DataFrame) -> DataFrame:
    """(seed, node, hops) of nodes one or two edges from each seed, without the seed and what was seen."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    one = seeds.join(both, seeds["seed"] == both["src"]).select("seed", F.col("dst").alias("node"), F.lit(1).alias("hops"))
    step = both.select(F.col("src").alias("node"), F.col("dst").alias("next"))
    two = one.join(step, "node").select("seed", F.col("next").alias("node"), F.lit(2).alias("hops"))
    reached = one.unionByName(two).where("seed <> node").groupBy("seed", "node").agg(F.min("hops").cast("long").alias("hops"))
    return reached.join(seen, "node", "left_anti").select("seed", "node", "hops")
