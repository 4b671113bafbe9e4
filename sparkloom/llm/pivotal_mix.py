"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every source gets a target of words; every document of it the same expected number of copies, its
whole part for certain and the rest as a fractional probability. Dependent rounding settles the
fractions: two documents of a source exchange probability so that their expected words stay
constant, in a random direction with fair odds, until one of them is 0 or 1; the other goes on.
Documents meet in groups of about ``GROUP``; each group leaves one open document, and these meet
again a level up, so that a source is settled by a tree of small groups. A source's words miss
its target by one document's size at most.

Rows of one id, source and size are interchangeable and go as one item: counted before any shuffle
of rows, they exchange probability among themselves first, which leaves a certain number of copies
and one open fraction, however many they are.

Randomness comes from hashes of the id, the size and the level: reruns agree. Null texts have size
0; sizes of 0 take nothing. A null source is a source of its own, last in order. Rows that repeat
an id are mixed row by row. Texts of any length are counted whole. An empty table gives no rows.
Extra columns are left out of the mix, whatever their names; ``take_copies`` keeps them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut, spare

GROUP = 64
#: Equal rows that one row of the result's plan is spread to at once.
SPREAD = 1000
_ONE = 1 << 52


def word_count(text: Column) -> Column:
    """Runs of characters outside space and 09-0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(*columns: Column | str) -> Column:
    """A number in [0, 1) from a hash of the columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(_ONE)) / float(_ONE)


def source_targets(items: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, source_size, items, target) of (source, size, rows) by filling sources in proportion to weight up to ``most`` times their size.

    Sources in code-point order, null last, take ``weights`` in turn. The common level at which the
    filled sources hold ``share`` of all words comes from running sums over the sources ordered by
    the level at which each is full; the table has a row per source.
    """
    totals = items.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count(F.lit(1)).alias("items"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.array(*[F.lit(float(w)) for w in weights])[(place % len(weights)).cast("int")]
    rows = totals.withColumn("weight", weight).withColumn("full", F.col("source_size") * float(most))
    by_level = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    total = F.sum("source_size").over(everything) * float(share)
    rows = rows.withColumn(
        "level",
        (total - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    )
    open_level = F.when(F.col("level") * F.col("weight") <= F.col("full"), F.col("level"))
    order = F.row_number().over(by_level)
    level = F.min(F.when(open_level.isNotNull(), F.struct(F.col("order"), open_level.alias("level")))).over(everything)["level"]
    rows = rows.withColumn("order", order).withColumn("common", level)
    # A share above what all sources can hold fills every one of them.
    target = F.coalesce(F.least("full", F.col("common") * F.col("weight")), F.col("full"))
    return rows.select("source", "source_size", "items", target.alias("target"))


def _meet(state: Column, item: Column) -> Column:
    """Two open documents exchange expected words; one is settled, the other stays open."""
    a, b = state["open"], item
    room_up = F.least((1 - a["p"]) * a["size"], b["p"] * b["size"])
    room_down = F.least(a["p"] * a["size"], (1 - b["p"]) * b["size"])
    up = b["u"] * (room_up + room_down) < room_down
    pa = F.when(up, F.when(room_up == (1 - a["p"]) * a["size"], 1.0).otherwise(a["p"] + room_up / a["size"])).otherwise(
        F.when(room_down == a["p"] * a["size"], 0.0).otherwise(a["p"] - room_down / a["size"])
    )
    pb = F.when(up, F.when(room_up == b["p"] * b["size"], 0.0).otherwise(b["p"] - room_up / b["size"])).otherwise(
        F.when(room_down == (1 - b["p"]) * b["size"], 1.0).otherwise(b["p"] + room_down / b["size"])
    )
    # Bind the new probabilities once, then hand on.
    pair = F.array(F.struct(pa.alias("pa"), pb.alias("pb")))

    def hand_on(v: Column) -> Column:
        first, second = a.withField("p", v["pa"]), b.withField("p", v["pb"])
        settled = (v["pa"] == 0.0) | (v["pa"] == 1.0)
        return F.struct(
            F.when(settled, second).otherwise(first).alias("open"),
            F.concat(state["done"], F.array(F.when(settled, first).otherwise(second))).alias("done"),
        )

    return F.transform(pair, hand_on)[0]


def round_copies(items: DataFrame, seed: int) -> DataFrame:
    """Settles ``items`` (stratum, count, size > 0, p, others): adds ``extra`` 0 or 1 to every row.

    ``count`` is the number of items of the stratum. Sum of p * size by stratum is kept, but for
    the last open item.
    """
    fields = items.columns
    groups = F.ceil(F.col("count") / GROUP).cast("long")
    level_rows = items.withColumn("bucket", F.pmod(F.xxhash64(*[c for c in fields if c != "p"], F.lit(seed)), groups))
    top = items.agg(F.max("count").alias("n")).first()["n"]
    levels = 0 if top is None else 1 + max(0, math.ceil(math.log(max(1, -(-top // GROUP)), GROUP)))
    settled: list[DataFrame] = []
    for level in range(levels):
        marks = [F.lit(seed), F.lit(level), *[F.col(c) for c in fields if c != "p"]]
        item = F.struct(uniform(*marks, F.lit("order")).alias("k"), uniform(*marks, F.lit("choice")).alias("u"), *fields)
        held = level_rows.groupBy("stratum", "bucket").agg(F.sort_array(F.collect_list(item)).alias("items"))
        start = F.struct(F.col("items")[0].alias("open"), F.filter("items", lambda x: F.lit(False)).alias("done"))
        rest = F.slice("items", 2, F.greatest(F.size("items") - 1, F.lit(0)))
        met = cut(held.select("stratum", "bucket", F.aggregate(rest, start, _meet).alias("state")))
        settled.append(met.select(F.explode("state.done").alias("x")).select("x.*"))
        level_rows = met.select("state.open.*", F.floor(F.col("bucket") / GROUP).alias("bucket"))
    marks = [F.lit(seed), F.lit(levels), *[F.col(c) for c in fields if c != "p"]]
    last = level_rows.withColumn("extra", (uniform(*marks, F.lit("choice")) < F.col("p")).cast("int")).select(*fields, "extra")
    for done in settled:
        last = last.unionByName(done.withColumn("extra", F.col("p").cast("int")).select(*fields, "extra"))
    return last


def mixed_items(
    df: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 6
) -> DataFrame:
    """(id, source, size, rows, source_size, target, whole, more): every row of an item is taken ``whole`` times, ``more`` of them once more."""
    sizes = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col).cast("string")).alias("size"))
    items = cut(sizes.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("rows")))
    sources = cut(source_targets(items, weights, share, most).withColumn("stratum", F.xxhash64("source", "source_size", "items")))
    rows = items.join(sources, items["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    expected = F.col("rows") * (rate - F.floor(rate))
    rows = cut(
        rows.withColumn("whole", F.floor(rate).cast("long")).withColumn("sure", F.floor(expected).cast("long")).withColumn("p", expected - F.floor(expected))
        .select("id", "source", "size", "rows", "source_size", "target", "whole", "sure", "p", "stratum", F.col("items").alias("count"))
    )
    open_rows = (F.col("size") > 0) & (F.col("p") > 0)
    settled = round_copies(rows.where(open_rows), seed).unionByName(rows.where(~open_rows).withColumn("extra", F.lit(0)))
    return settled.select("id", "source", "size", "rows", "source_size", "target", "whole", (F.col("sure") + F.col("extra")).alias("more"))


def mix_sources(df: DataFrame, id_col: str, text_col: str, source_col: str, **mix: object) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) for every row of ``df``."""
    items = mixed_items(df, id_col, text_col, source_col, **mix).withColumn("at", F.explode(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / SPREAD))))
    # Items of very many rows go out from many tasks.
    spread = items.where(F.col("rows") <= SPREAD).unionByName(items.where(F.col("rows") > SPREAD).repartition("id", "source", "size", "at"))
    first, last = F.col("at") * SPREAD + 1, F.least(F.col("rows"), (F.col("at") + 1) * SPREAD)
    rows = spread.withColumn("place", F.explode(F.sequence(first, last)))
    copies = F.col("whole") + (F.col("place") <= F.col("more")).cast("long")
    return rows.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def _places(df: DataFrame, row: str, place: str, keys: list[str]) -> DataFrame:
    """``df`` (with a row number ``row`` of its partition and place) with each row's place among the rows of its keys.

    Rows are counted within their partition first, so that no task holds a whole group.
    """
    part, own = spare(df, "__part", "__own")
    rows = df.withColumn(part, F.shiftright(row, 33))
    rows = rows.withColumn(own, F.row_number().over(Window.partitionBy(part, *keys).orderBy(row)))
    theirs = [f"k{i}" for i in range(1 + len(keys))]
    counts = rows.groupBy(*[F.col(c).alias(k) for k, c in zip(theirs, [part, *keys])]).agg(F.count(F.lit(1)).alias("n"))
    above = Window.partitionBy(*theirs[1:]).orderBy(theirs[0]).rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.withColumn("before", F.coalesce(F.sum("n").over(above), F.lit(0)))
    same = reduce(and_, [rows[c].eqNullSafe(shifts[k]) for c, k in zip([part, *keys], theirs)])
    return rows.join(shifts, same).select(*[rows[c] for c in df.columns], (rows[own] + shifts["before"]).alias(place))


def take_copies(df: DataFrame, id_col: str, text_col: str, source_col: str, **mix: object) -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it; all columns stay.

    Copies are counted without the texts and joined to them by id; where ids repeat, by id, source,
    size and the row's place among the rows of these.
    """
    row, place, source, size, copies, number = spare(df, "__row", "__place", "__source", "__size", "__copies", "__number")
    items = cut(mixed_items(df, id_col, text_col, source_col, **mix).select("id", "source", "size", "rows", "whole", "more"))
    repeats = items.groupBy("id").agg(F.sum("rows").alias("rows")).where("rows > 1").limit(1).count()
    items = items.where("whole > 0 or more > 0")
    if repeats:
        # Written with its row numbers: the same rows get the same numbers whenever they are read.
        rows = cut(df.withColumn(row, F.monotonically_increasing_id()).withColumn(source, F.col(source_col)).withColumn(size, word_count(F.col(text_col).cast("string"))))
        rows = _places(rows, row, place, [id_col, source, size])
        same = rows[id_col].eqNullSafe(items["id"]) & rows[source].eqNullSafe(items["source"]) & (rows[size] == items["size"])
    else:
        rows = df.withColumn(place, F.lit(1))
        same = rows[id_col].eqNullSafe(items["id"])
    times = items["whole"] + (rows[place] <= items["more"]).cast("long")
    taken = rows.join(items, same).select(*[rows[c] for c in df.columns], times.cast("int").alias(copies)).where(F.col(copies) > 0)
    return taken.withColumn(number, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*df.columns)


def op6_pivotal_mixing(documents: DataFrame) -> DataFrame:
    """All ``documents`` mixed to weights 3, 1, 2 over 150 % of their words; one row per row."""
    return mix_sources(documents, "doc_id", "text", "source").select("doc_id", "size", "source_size", "target", "taken", "copies")
