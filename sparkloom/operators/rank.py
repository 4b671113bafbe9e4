"""Retrieval over sets of queries: lexical and vector scores, fusion, dedup, diversity."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import running_sums

K1, B, RRF_K = 1.5, 0.75, 60
#: Rows of queries and of vectors that one comparison holds.
QUERY_BLOCK, VECTOR_PART = 4096, 20_000
#: Scores of a comparison that are held at once.
SCORES = 1 << 20
#: Documents that one bucket of a lexical search holds, and how many buckets there are at least.
BUCKET, LEAST_BUCKETS = 4096, 16
#: Terms of queries that are broadcast; more are joined by shuffle. What stands beside a document's terms for the document.
BROADCAST_TERMS, MARK = 500_000, "\x00"


def lexical_scores(documents: DataFrame, queries: DataFrame, k1: float = K1, b: float = B, size: int | None = None) -> DataFrame:
    """(bucket, query_id, doc_id, score, overlap) of every document that shares a term with a query.

    documents: (doc_id, terms array); queries: (query_id, term) distinct; ``size``: about how many documents
    there are, counted if not given. ``score`` is BM25, ``overlap`` the number of shared terms over
    the root of the document's length. Only terms that queries have leave the scan. One shuffle deals documents
    into buckets of about ``BUCKET`` and what follows (frequencies, weights, sums, first ranks) stays there, where
    the query side is small enough for Spark to broadcast: a task's memory doesn't grow with the table.
    Document frequencies come from the same shuffle.
    """
    buckets = max(LEAST_BUCKETS, -(-(documents.count() if size is None else size) // BUCKET))
    small = F.broadcast if queries.count() <= BROADCAST_TERMS else lambda df: df
    held = documents.where(F.size("terms") > 0).select("doc_id", "terms", F.size("terms").alias("length"))
    # Every document brings a mark beside its terms: the table's figures come from the same shuffle, texts are read once.
    words = held.select("doc_id", "length", F.explode(F.concat(F.array(F.lit(MARK)), "terms")).alias("term"))
    asked = queries.select("term").distinct()
    mark = queries.sparkSession.range(1).select(F.lit(MARK).alias("term"))
    words = words.join(small(asked.unionByName(mark)), "term", "left_semi")
    found = words.select(F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("bucket"), "doc_id", "length", "term").repartition(buckets, "bucket")
    counted = found.groupBy("bucket", "doc_id", "term", "length").agg(F.count(F.lit(1)).alias("tf"))
    frequency = counted.groupBy("term").agg(F.count("length").alias("df"), F.sum("length").alias("total"))
    of_mark = lambda c: F.max(F.when(F.col("term") == MARK, F.col(c)))
    stats = frequency.agg(of_mark("df").alias("documents"), (of_mark("total") / of_mark("df")).alias("mean"))  # one row
    idf = F.log(1 + (F.col("documents") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = queries.join(frequency.join(F.broadcast(stats)).select("term", idf.alias("idf"), "mean"), "term")
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    shared = F.round(F.count(F.lit(1)) / F.sqrt(F.max("length")), 6)
    return counted.join(small(terms), "term").groupBy("bucket", "query_id", "doc_id").agg(F.round(F.sum(weight), 6).alias("score"), shared.alias("overlap"))


def ranked_lists(scores: DataFrame, columns: list[str], limit: int) -> DataFrame:
    """(query_id, doc_id, a rank per column) of rows among the first ``limit`` of their query in some column; ranks beyond are null.

    Documents of a query compete within the buckets that ``scores`` has them in first, so that a query with very many of
    them is no single task's work and few of them are shuffled.
    """
    order = {c: [F.col(c).desc(), F.col("doc_id")] for c in columns}

    def keep(df: DataFrame, group: list[str]) -> DataFrame:
        for c in columns:
            df = df.withColumn(f"{c}_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order[c])).cast("long"))
        return df.where(F.least(*[f"{c}_rank" for c in columns], F.lit(limit + 1)) <= limit)

    first = keep(scores, ["bucket", "query_id"]).drop("bucket", *[f"{c}_rank" for c in columns])
    final = keep(first, ["query_id"])
    return final.select("query_id", "doc_id", *[F.when(F.col(f"{c}_rank") <= limit, F.col(f"{c}_rank")).alias(f"{c}_rank") for c in columns])


def fuse_ranks(lists: DataFrame, columns: list[str], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of the rank columns of ``ranked_lists``: (query_id, doc_id, score)."""
    total = F.lit(0.0)
    for c in columns:
        total = total + F.coalesce(1.0 / (k + F.col(f"{c}_rank")), F.lit(0.0))
    return lists.select("query_id", "doc_id", F.round(total, 6).alias("score"))


def rank_by(df: DataFrame, group: list[str], order: list[Column], limit: int | None = None, name: str = "rank") -> DataFrame:
    """Adds the place within ``group``; a limit reaches the window as a group limit."""
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long"))
    return ranked.where(F.col(name) <= limit) if limit else ranked


def fuse(lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (query_id, doc_id, rank) lists: (query_id, doc_id, score)."""
    both = lists[0].select("query_id", "doc_id", "rank")
    for other in lists[1:]:
        both = both.unionByName(other.select("query_id", "doc_id", "rank"))
    return both.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 6).alias("score"))


def first_per_key(df: DataFrame, group: list[str], key: Column, order: list[Column]) -> DataFrame:
    """The first row of each key within a group."""
    place = F.row_number().over(Window.partitionBy(*group, key).orderBy(*order))
    return df.withColumn("__place", place).where("__place = 1").drop("__place")


def dedup_two_keys(df: DataFrame, group: list[str], id_col: str, text_col: str, position: str) -> DataFrame:
    """Rows in order, without those whose id or text a kept row has; a row left out registers neither.

    The rule is sequential. A group's rows pass in order, in batches of bounded size; only the keys
    that its kept rows have registered are held.
    """
    import pyarrow as pa

    names = df.columns

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, texts = None, set(), set()
        for batch in batches:
            keep = []
            for *key, i, t in zip(*[batch.column(c).to_pylist() for c in [*group, id_col, text_col]]):
                if key != last:
                    last, ids, texts = key, set(), set()
                fresh = i not in ids and t not in texts
                if fresh:
                    ids.add(i)
                    texts.add(t)
                keep.append(fresh)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return df.repartition(*group).sortWithinPartitions(*group, position).select(*names).mapInArrow(walk, df.schema)


def diversify(df: DataFrame, group: list[str], source: str, position: str, per_source: int, limit: int) -> DataFrame:
    """At most ``per_source`` of a source first, the overflow after, then the limit; adds ``place``.

    No more than ``limit`` rows of a source can be among the first ``limit``: each source is cut to
    these before the sources of a group come together.
    """
    own = F.row_number().over(Window.partitionBy(*group, source).orderBy(position))
    cut = df.withColumn("__own", own).where(F.col("__own") <= max(per_source, limit))
    return rank_by(cut.withColumn("__over", F.col("__own") > per_source), group, [F.col("__over"), F.col(position)], limit, "place").drop("__over", "__own")


def rerank_tolerantly(df: DataFrame, group: list[str], position: str, verdict: str, top_n: int) -> DataFrame:
    """Accepted rows (a verdict) by score and position, ``top_n`` at most, then the rest in order; nothing accepted: unchanged.

    Positions are unique in a group. The rest is placed by running counts over ranges of positions: no
    task orders a whole group.
    """
    scored = df.withColumn("__s", F.col(verdict).try_cast("double"))
    accepted = rank_by(scored.where("__s is not null"), group, [F.col("__s").desc(), F.col(position)], top_n, "place")
    most = accepted.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"))
    rest = running_sums(scored.where("__s is null").withColumn("__one", F.lit(1)), group, position, {"__one": "place"}).withColumn("place", F.col("place") + 1)
    moved = rest.join(most, group, "left").withColumn("place", F.col("place") + F.coalesce("__n", F.lit(0))).drop("__n")
    return accepted.unionByName(moved.select(*accepted.columns)).drop("__s")


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int, label: bool = False, block: int = QUERY_BLOCK, part: int = VECTOR_PART) -> DataFrame:
    """(query_id, vec_id, rank, score): the nearest ``k`` of (vec_id, v[, label]) by cosine, in double precision.

    Queries are dealt into blocks and vectors into parts; every part meets every block, as a task
    each: the rows of a part and block come together by a shuffle and are compared in numpy, and only
    the ``k`` best of a query and part go on. Nothing passes the driver. With ``label``, queries and
    vectors meet within their label only. A query never finds itself; null vectors find nothing.
    """
    import numpy as np
    import pandas as pd

    columns = ["id", "v", *(["label"] if label else [])]
    fresh = [F.col(c).alias(c) for c in columns[1:]]  # queries may come from the vectors' own table
    asked = queries.where("v is not null").select(F.col("query_id").alias("id"), *fresh)
    held = vectors.where("v is not null").select(F.col("vec_id").alias("id"), *fresh)

    own_label = ["label"] if label else []

    def pieces(df: DataFrame, rows: int, name: str) -> DataFrame:
        return df.groupBy(*own_label).agg(F.greatest(F.ceil(F.count(F.lit(1)) / rows), F.lit(1)).cast("int").alias(name))

    # One row, or one a label: queries of a label meet vectors of it alone, in as many tasks as it needs.
    both = pieces(asked, block, "blocks"), pieces(held, part, "parts")
    counts = both[0].join(both[1], "label") if label else F.broadcast(both[0].join(both[1]))
    dealt = lambda count: F.pmod(F.xxhash64("id"), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    sized = lambda df: df.join(counts, "label") if label else df.join(counts)
    q = sized(asked).withColumn("block", dealt("blocks")).withColumn("part", every("parts")).select(*[F.col(c).alias(c) for c in ("block", "part", *columns)])
    own = sized(held).withColumn("part", dealt("parts")).withColumn("block", every("blocks")).select(*[F.col(c).alias(c) for c in ("block", "part", *columns)])
    meet = [*own_label, "block", "part"]

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            x, y = (np.array(side["v"].tolist(), dtype=float) for side in (left, right))
            x, y = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, y))
            ids, theirs = left["id"].to_numpy(), right["id"].to_numpy()
            order = np.argsort(theirs, kind="stable")
            theirs, y = theirs[order], y[order]
            rows = max(1, SCORES // len(theirs))
            for lo in range(0, len(ids), rows):
                score = np.round(x[lo : lo + rows] @ y.T, 6)
                score[ids[lo : lo + rows, None] == theirs[None, :]] = -np.inf
                top = np.argsort(-score, axis=1, kind="stable")[:, :k]
                kept = np.take_along_axis(score, top, axis=1)
                at, place = np.nonzero(np.isfinite(kept))
                out.append(pd.DataFrame({"query_id": ids[lo + at], "vec_id": theirs[top[at, place]], "score": kept[at, place]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})

    found = q.groupBy(*meet).cogroup(own.groupBy(*meet)).applyInPandas(best, "query_id long, vec_id long, score double")
    return rank_by(found, ["query_id"], [F.col("score").desc(), F.col("vec_id")], k).select("query_id", "vec_id", "rank", "score")
