"""Hard-negative mining by a two-dimensional block matrix multiply.

The score matrix of anchors by rows is cut into tiles, and the dimensions into chunks. For every tile
and chunk, a task multiplies the anchors' and the rows' components of that chunk; the partial int64
tiles of the chunks meet by a shuffle and are added, and only the few best of a tile go on. Positives
come from tiles within a label alone. Negatives come from tiles over all rows: each anchor brings
its positives' scores along, and a tile gives the best rows of other labels in each window.

Rows with a null id, a null label, a null vector or any null or non-finite component take no part.
Rows that repeat an id are one row, the smallest in label and vector. Vectors that are shorter than
others have zeros behind. Components are ``floor(256 * x)``; what exceeds the range in which sums are
exact in 64 bits (above 90,000 for 64 dimensions) counts as its end. Equal scores are ordered by id;
a copy of the anchor is a row like any other. An anchor without a positive, or a positive without a
negative in its window, gives no rows. Empty tables give no rows. Other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut

#: Anchors and rows of a tile (8 MB of scores), and components of a chunk at least.
ANCHORS, ROWS, CHUNK = 512, 2048, 32
#: Chunks at most: what is added for a tile is held at once.
CHUNKS = 8

_TILE = "anchors array<long>, anchor_labels array<int>, wanted array<array<long>>, chosen array<array<long>>, rows array<long>, row_labels array<int>, tile binary"


def quantised(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, q): whole-number components of the rows that take part."""
    finite = F.forall(F.col("x"), lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & finite)
    end = F.floor(F.sqrt(F.lit(2.0**55) / F.greatest(F.size("x"), F.lit(1))))
    whole = F.transform("x", lambda v: F.least(F.greatest(F.floor(256 * v), -F.col("end")), F.col("end")).cast("int"))
    once = rows.withColumn("end", end).select("id", "label", whole.alias("q")).groupBy("id").agg(F.min(F.struct("label", "q")).alias("row"))
    return once.select("id", "row.label", "row.q")


def _matrix(table: pa.Table) -> np.ndarray:
    flat = table.column("part").combine_chunks()
    return flat.flatten().to_numpy().reshape(len(flat), -1) if len(flat) else np.zeros((0, 1), np.int64)


def _multiply(key: tuple, left: pa.Table, right: pa.Table, by: list[str]) -> pa.Table:
    """The partial tile of one chunk; the first chunk's has the sides' ids, labels and windows with it."""
    left, right = left.sort_by("id"), right.sort_by("id")
    names = dict(zip([*by, "k"], [k.as_py() for k in key]))
    if not left.num_rows or not right.num_rows:
        return pa.table([], schema=_tile_schema(by))
    a, b = _matrix(left).astype(np.int64), _matrix(right).astype(np.int64)
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    # Whole numbers below 2 ** 53 are exact in doubles, which multiply faster.
    tile = (a.astype(float) @ b.T.astype(float)).astype(np.int64) if most < 2.0**53 else a @ b.T
    first = names["k"] == 0
    sides = [(left, c, "id" if c == "anchors" else "label" if c == "anchor_labels" else c) for c in ("anchors", "anchor_labels", "wanted", "chosen")] + [(right, "rows", "id"), (right, "row_labels", "label")]
    row = names | {name: table.column(c).to_pylist() if first else [] for table, name, c in sides} | {"tile": tile.tobytes()}
    return pa.Table.from_pylist([row], schema=_tile_schema(by))


def _tile_schema(by: list[str]) -> pa.Schema:
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
    return pa.schema(
        [*[(c, pa.int64()) for c in by], ("k", pa.int64()), ("anchors", longs), ("anchor_labels", ints), ("wanted", pa.list_(longs)), ("chosen", pa.list_(longs)), ("rows", longs), ("row_labels", ints), ("tile", pa.binary())]
    )


def _added(tiles: pa.Table) -> tuple[dict, np.ndarray]:
    """The sides of a tile, and the sum of its partial tiles."""
    first = int(np.flatnonzero(tiles.column("k").to_numpy() == 0)[0])
    sides = {c: tiles.column(c)[first].as_py() for c in ("anchors", "anchor_labels", "wanted", "chosen", "rows", "row_labels")}
    total = np.zeros((len(sides["anchors"]), len(sides["rows"])), dtype=np.int64)
    for raw in tiles.column("tile"):
        total += np.frombuffer(raw.as_buffer(), dtype=np.int64).reshape(total.shape)
    return sides, total


def _positives(tiles: pa.Table, limit: int) -> pa.Table:
    """The ``limit`` best other rows of every anchor of a tile."""
    sides, score = _added(tiles)
    anchors, rows = np.array(sides["anchors"]), np.array(sides["rows"])
    order = np.argsort(-score, axis=1, kind="stable")[:, : limit + 1]  # rows are in order of id; one of them may be the anchor itself
    other = rows[order] != anchors[:, None]
    i, j = np.nonzero(other & (np.cumsum(other, axis=1) <= limit))
    return pa.table({"anchor": anchors[i], "row": rows[order[i, j]], "score": score[i, order[i, j]]})


def _negatives(tiles: pa.Table, limit: int, low: int, high: int) -> pa.Table:
    """The ``limit`` best rows of other labels in every window of every anchor of a tile."""
    sides, score = _added(tiles)
    anchors, labels = np.array(sides["anchors"]), np.array(sides["anchor_labels"])
    rows, theirs = np.array(sides["rows"]), np.array(sides["row_labels"])
    order = np.argsort(-score, axis=1, kind="stable")
    ranked = np.take_along_axis(score, order, axis=1)
    strange = theirs[order] != labels[:, None]
    width = max(map(len, sides["wanted"]), default=0)
    out = []
    for w in range(width):
        has = np.flatnonzero([len(x) > w for x in sides["wanted"]])
        bound = np.array([sides["wanted"][i][w] for i in has])
        chosen = np.array([sides["chosen"][i][w] for i in has])
        own = 100 * ranked[has]
        fits = strange[has] & (own >= low * bound[:, None]) & (own <= high * bound[:, None])
        i, j = np.nonzero(fits & (np.cumsum(fits, axis=1) <= limit))
        out.append((anchors[has[i]], chosen[i], bound[i], rows[order[has[i], j]], ranked[has[i], j]))
    columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 5
    return pa.table(dict(zip(("anchor", "positive", "positive_score", "row", "score"), columns)))


def tile_scores(anchors: DataFrame, rows: DataFrame, by: list[str], width: int, chunks: int, pick: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """Scores of (by, id, label, q, wanted, chosen) by (by, id, label, q), tile by tile of equal ``by``, reduced by ``pick``."""

    def pieces(df: DataFrame, columns: list[str]) -> DataFrame:
        cut_up = df.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
        at = F.sequence((F.col("k") * width).cast("int"), (F.col("k") * width + width - 1).cast("int"))
        return cut_up.select(*[F.col(c).alias(c) for c in [*by, "k", *columns]], F.transform(at, lambda d: F.coalesce(F.get("q", d), F.lit(0))).alias("part"))

    own = pieces(anchors, ["id", "label", "wanted", "chosen"]).groupBy(*by, "k")
    theirs = pieces(rows, ["id", "label"]).groupBy(*by, "k")
    shape = ", ".join(f"{c} long" for c in [*by, "k"])
    tiles = own.cogroup(theirs).applyInArrow(lambda key, left, right: _multiply(key, left, right, by), f"{shape}, {_TILE}")
    return tiles.groupBy(*by).applyInArrow(pick, schema)


def _dealt(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("id"), blocks).cast("long")


def _every(blocks: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))


def mine(df: DataFrame, id_col: str, vector_col: str, label_col: str, anchor: str = "id % 100 = 0", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that ``anchor``, a condition on ``id``, names."""
    rows = cut(quantised(df, id_col, vector_col, label_col))
    n, asked, dim = rows.agg(F.count(F.lit(1)), F.count(F.when(F.expr(anchor), 1)), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
    width = max(CHUNK, CHUNK * math.ceil(dim / CHUNK / CHUNKS))
    chunks = max(1, math.ceil(dim / width))
    none = F.array().cast("array<long>")

    # Positives: tiles within a label; a label with many rows is many tiles.
    ceil = lambda c, size: F.ceil(F.greatest(c, F.lit(1)) / size).cast("long")
    counts = cut(
        rows.groupBy("label").agg(F.count(F.when(F.expr(anchor), 1)).alias("asked"), F.count(F.lit(1)).alias("n")).where("asked > 0")
        .select("label", ceil(F.col("asked"), ANCHORS).alias("down"), ceil(F.col("n"), ROWS).alias("across"))
    )
    known = rows.join(counts, "label")
    left = known.where(anchor).withColumn("i", _dealt(F.col("down"))).withColumn("j", _every(F.col("across"))).withColumn("wanted", none).withColumn("chosen", none)
    right = known.withColumn("j", _dealt(F.col("across"))).withColumn("i", _every(F.col("down")))
    group = ["group", "i", "j"]
    sides = (side.withColumn("group", F.col("label").cast("long")) for side in (left, right))
    found = tile_scores(*sides, group, width, chunks, lambda tiles: _positives(tiles, positives), "anchor long, row long, score long")
    order = Window.partitionBy("anchor").orderBy(F.col("score").desc(), "row")
    best = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    windows = cut(best.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "row", "score"))).alias("x")).select(F.col("anchor").alias("id"), F.col("x.score").alias("wanted"), F.col("x.row").alias("chosen")))  # ``positives`` an anchor

    # Negatives: tiles over all rows; anchors bring their windows.
    down, across = (F.lit(max(1, math.ceil(size / step))).cast("long") for size, step in ((asked, ANCHORS), (n, ROWS)))
    left = rows.where(anchor).join(windows, "id").withColumn("i", _dealt(down)).withColumn("j", _every(across))
    right = rows.withColumn("j", _dealt(across)).withColumn("i", _every(down))
    found = tile_scores(left, right, ["i", "j"], width, chunks, lambda tiles: _negatives(tiles, negatives, low, high), "anchor long, positive long, positive_score long, row long, score long")
    order = Window.partitionBy("anchor", "positive").orderBy(F.col("score").desc(), "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("row").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_summa_hard_negatives(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of ``embeddings``; where the id is divisible by 7, the label moves on by one first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(embeddings.select("vec_id", "embedding", moved.alias("label")), "vec_id", "embedding", "label")


SQL = """
with r as (select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c as (select id, label, unnest(q) as v, unnest(range(len(q))) as d from r),
s as (select a.id as anchor, b.id as row, a.label = b.label as same, sum(a.v * b.v)::bigint as score from c a join c b using (d) where a.id % 100 = 0 and a.id <> b.id group by 1, 2, 3),
p as (select * from (select anchor, row, score, row_number() over (partition by anchor order by score desc, row) as place from s where same) where place <= 5),
f as (select p.anchor, p.row as positive, p.score as positive_score, s.row, s.score, row_number() over (partition by p.anchor, p.row order by s.score desc, s.row) as rank
  from p join s on p.anchor = s.anchor and not s.same and 100 * s.score >= 80 * p.score and 100 * s.score <= 100 * p.score)
select anchor as anchor_id, positive as positive_id, rank::int as rank, row as negative_id, positive_score, score as negative_score from f where rank <= 5
"""
