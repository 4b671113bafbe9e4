"""Sharding by balanced label propagation, in DataFrame operations only.

Documents that share a link should share a shard, and all shards should hold as many rows as one
another. Linked documents start in runs of links, largest first, a shard's room after the other: prefix
sums over links tell where each begins. In every round, joins tell each of them how many
fellows every shard holds; it proposes to move where most are, ties broken by a hash of the link that
all its fellows see alike. Proposals are admitted under quotas between pairs of shards: as many as go
the other way, and a share of the room that the shard has left. Who goes first is told by gain and
link, from a histogram of bounded size, so that groups move whole where a quota binds. Documents
without a fellow have no edge to cut: they, and what exceeds a shard's count, fill the shards up
at last, which makes the counts even to within one row.

Links of very many rows are few (``HEAVY`` of them at most): they alone are broadcast by name and
their votes dealt out by salt. A group larger than a shard is spread over as few as the quotas allow.

Null texts count as empty ones, which are equal to one another. Rows that repeat an id, and rows
without one, are rows of their own. Texts of any length are read whole, once. An empty table gives
no rows. Other columns are left out, whatever their names. Reruns over the same files agree.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pivotal_mix import uniform
from .storage import cut

#: Rounds of propagation at most, and the share of linked rows whose moves end it.
ROUNDS, SETTLED = 8, 0.001
#: A link is heavy if it has more than this share of all rows: there are no more than 2000 such.
HEAVY, SALTS = 1 / 2000, 64
#: Share of a shard's rows that moves without a counterpart may fill; the rest absorbs chance.
FILL = 0.98
#: Buckets by link within a gain, for the order of admission.
LINK_BUCKETS = 64
#: Bits of a link that deal links of a size out, for the prefix sums of the start.
RUN_BITS = 12


def _heavy(counts: DataFrame, rows: int) -> DataFrame:
    """Links (link, n) with more than their share of ``rows``: fewer than 1 / ``HEAVY``."""
    return counts.where(F.col("n") > max(2.0, rows * HEAVY)).select("link", F.lit(True).alias("hot"))


def _salted(counts: DataFrame, rows: int) -> DataFrame:
    """One row per light link, ``SALTS`` per heavy one."""
    last = F.when(F.col("n") > max(2.0, rows * HEAVY), SALTS - 1).otherwise(0)
    return counts.withColumn("salt", F.explode(F.sequence(F.lit(0), last)))


def linked_rows(members: DataFrame, rows: int) -> DataFrame:
    """(row, link, salt) of members whose link has two rows or more."""
    counts = cut(members.groupBy("link").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    marked = members.join(F.broadcast(_heavy(counts, rows)), "link", "left")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("row"), F.lit(SALTS))).otherwise(0).cast("int")
    return cut(marked.select("row", "link", salt.alias("salt")).join(_salted(counts, rows).select("link", "salt"), ["link", "salt"], "left_semi"))


def _votes(linked: DataFrame, place: DataFrame, shards: int, rows: int) -> DataFrame:
    """(row, link, votes): how many fellows (itself included) every shard holds, summed over a row's links."""
    held = linked.join(place, "row")
    names = [f"v{s}" for s in range(shards)]
    tally = held.groupBy("link").agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col("shard") == s, 1)).alias(v) for s, v in enumerate(names)])
    told = held.join(_salted(tally, rows), ["link", "salt"])
    each = told.groupBy("row").agg(F.min("link").alias("link"), F.min("shard").alias("shard"), *[F.sum(v).alias(v) for v in names])
    return each.select("row", "link", "shard", F.array(*names).alias("votes"))


def _quotas(loads: DataFrame, asked: DataFrame, capacity: float, shards: int) -> DataFrame:
    """(shard, best, quota) of every pair of shards that rows want to move between: shards squared rows at most."""
    back = asked.select(F.col("shard").alias("best"), F.col("best").alias("shard"), F.col("n").alias("other"))
    both = asked.join(F.broadcast(back), ["shard", "best"], "left").withColumn("swap", F.least("n", F.coalesce("other", F.lit(0)))).withColumn("more", F.col("n") - F.col("swap"))
    room = both.join(F.broadcast(loads.select(F.col("shard").alias("best"), "load")), "best", "left")
    free = F.greatest(F.lit(capacity) - F.coalesce("load", F.lit(0)), F.lit(0.0))
    wanted = F.sum("more").over(Window.partitionBy("best"))
    share = F.when(wanted > 0, F.least(F.lit(1.0), free / wanted)).otherwise(0.0)
    return room.select("shard", "best", (F.col("swap") + F.floor(F.col("more") * share)).alias("quota"))


def _start(linked: DataFrame, rows: int, shards: int) -> DataFrame:
    """(row, link, shard): links side by side, by falling powers of two of their size; heavy links spread over what they span."""
    sizes = linked.groupBy("link").agg(F.count(F.lit(1)).alias("n"))
    groups = cut(sizes.withColumn("power", F.floor(F.log2(F.col("n"))).cast("int")).withColumn("part", F.shiftrightunsigned("link", 64 - RUN_BITS)))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    parts = groups.groupBy("power", "part").agg(F.sum("n").alias("m"))
    powers = parts.groupBy("power").agg(F.sum("m").alias("m"))  # some dozens
    above = powers.select("power", F.coalesce(F.sum("m").over(Window.partitionBy().orderBy(F.col("power").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("above"))
    shifts = parts.select("power", "part", F.coalesce(F.sum("m").over(before("power", "part")), F.lit(0)).alias("beside")).join(F.broadcast(above), "power")
    own = groups.withColumn("own", F.coalesce(F.sum("n").over(before("power", "part", "link")), F.lit(0)))
    begins = own.join(shifts, ["power", "part"]).select("link", "n", (F.col("above") + F.col("beside") + F.col("own")).alias("begin"))
    total, largest = groups.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    room = max(1.0, total / shards, min(FILL * rows / shards, largest))
    first = linked.groupBy("row").agg(F.min(F.struct("link", "salt")).alias("x")).select("row", "x.link", "x.salt")
    placed = first.join(_salted(begins, rows), ["link", "salt"])
    within = F.when(F.col("n") > max(2.0, rows * HEAVY), F.floor(uniform("row", F.lit("start")) * F.col("n"))).otherwise(0)
    return placed.select("row", "link", F.least(F.floor((F.col("begin") + within) / room), F.lit(shards - 1)).cast("int").alias("shard"))


def propagate(linked: DataFrame, rows: int, shards: int, seed: int = 12) -> DataFrame:
    """(row, link, shard) of the linked rows after propagation; ``rows`` counts all rows, linked or not."""
    place = cut(_start(linked, rows, shards))
    total = place.count()
    capacity = FILL * rows / shards
    for turn in range(ROUNDS if total else 0):
        loads = place.groupBy("shard").agg(F.count(F.lit(1)).alias("load"))
        full = F.array_sort(F.collect_set(F.when(F.col("load") >= capacity, F.col("shard"))))  # of ``shards`` rows
        closed = loads.agg(full.alias("closed"))
        votes = _votes(linked, place.select("row", "shard"), shards, rows).join(F.broadcast(closed))
        order = [F.struct(F.element_at("votes", s + 1).alias("n"), F.xxhash64("link", F.lit(s), F.lit(seed)).alias("tie"), F.lit(s).alias("s")) for s in range(shards)]
        # Full shards are open to those that are in them alone.
        open_ = [F.when((F.col("shard") == s) | ~F.array_contains("closed", s), x) for s, x in enumerate(order)]
        best = votes.select("row", "link", "shard", F.greatest(*open_).alias("to"), F.element_at("votes", F.col("shard") + 1).alias("now"))
        gain = F.floor(F.log2(F.col("to.n") - F.col("now") + 1.0)).cast("int")
        bucket = F.pmod(F.xxhash64("link", F.lit(turn)), F.lit(LINK_BUCKETS)).cast("int")
        movers = cut(best.where("to.s <> shard").select("row", "shard", F.col("to.s").alias("best"), gain.alias("gain"), bucket.alias("bucket")))
        # Up to shards squared by some dozen gains by buckets: small, however many rows move.
        asked = movers.groupBy("shard", "best", "gain", "bucket").agg(F.count(F.lit(1)).alias("n"))
        quotas = _quotas(loads, asked.groupBy("shard", "best").agg(F.sum("n").alias("n")), capacity, shards)
        first = Window.partitionBy("shard", "best").orderBy(F.col("gain").desc(), "bucket").rowsBetween(Window.unboundedPreceding, -1)
        left = F.col("quota") - F.coalesce(F.sum("n").over(first), F.lit(0))
        admitted = asked.join(F.broadcast(quotas), ["shard", "best"]).select("shard", "best", "gain", "bucket", (F.greatest(left, F.lit(0)) / F.col("n")).alias("part"))
        moved = movers.join(F.broadcast(admitted), ["shard", "best", "gain", "bucket"]).where(uniform("row", F.lit(turn), F.lit(seed)) < F.col("part"))
        moved = cut(moved.select("row", "best"))
        place = cut(place.join(moved, "row", "left").select("row", "link", F.coalesce("best", "shard").alias("shard")))
        if moved.count() <= SETTLED * total:
            break
    return place


def places(df: DataFrame, row: str, key: str, name: str) -> DataFrame:
    """Adds each row's place, from 0, among the rows of its ``key``, in order of ``row``.

    ``row`` holds row numbers by partition: rows are counted within these first, so that no task
    holds a whole key.
    """
    rows = df.withColumn("__part", F.shiftright(row, 33))
    rows = rows.withColumn("__own", F.row_number().over(Window.partitionBy("__part", key).orderBy(row)) - 1)
    counts = rows.groupBy("__part", key).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select("__part", key, before.alias("__before"))
    return rows.join(shifts, ["__part", key]).withColumn(name, F.col("__own") + F.col("__before")).drop("__part", "__own", "__before")


def _stair(value: Column, steps: list[int]) -> Column:
    """The first step above ``value``; ``steps`` rise."""
    return reduce(add, [(value >= s).cast("int") for s in steps[:-1]], F.lit(0))


def fill_even(rows: DataFrame, shards: int) -> DataFrame:
    """(columns, shard, slot): rows (row, link, shard or null) to shards of equal counts; rows without one, and what exceeds a count, fill up."""
    placed = cut(places(rows.withColumn("key", F.coalesce("shard", F.lit(-1))), "row", "key", "place"))
    held = {r["key"]: r["n"] for r in placed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).collect()}  # a count a shard
    n = sum(held.values())
    due = [n // shards + (s < n % shards) for s in range(shards)]
    stay = [min(held.get(s, 0), due[s]) for s in range(shards)]
    over, ends, at, to = [], [], held.get(-1, 0), 0
    for s in range(shards):
        over.append(at)
        at += held.get(s, 0) - stay[s]
        to += due[s] - stay[s]
        ends.append(to)
    key, place = F.col("key"), F.col("place")
    pick = lambda values: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), key + 1)
    stays = (key >= 0) & (place < F.when(key >= 0, pick(stay)))
    pool = F.when(key < 0, place).otherwise(place - F.when(key >= 0, pick(stay)) + F.when(key >= 0, pick(over)))
    to_shard = _stair(pool, ends)
    begins = F.array(*[F.lit(e - (due[s] - stay[s]) - stay[s]).cast("long") for s, e in enumerate(ends)])
    shard = F.when(stays, key).otherwise(to_shard).cast("int")
    slot = F.when(stays, place).otherwise(pool - F.element_at(begins, to_shard + 1)).cast("long")
    return placed.select(*[c for c in rows.columns if c != "shard"], shard.alias("shard"), slot.alias("slot"))


def shard_documents(df: DataFrame, links: DataFrame, shards: int) -> DataFrame:
    """``df`` (with a column ``row`` of row numbers by partition) with shard and slot; links (row, link): a row may have any number of them."""
    rows = df.count()
    place = propagate(linked_rows(links.where("link is not null"), rows), rows, shards)
    return fill_even(df.join(place.select("row", "shard"), "row", "left"), shards)


def op12_label_propagation_shards(documents: DataFrame) -> DataFrame:
    """All ``documents`` in 8 shards whose row counts are at most one apart, equal texts together where that allows it."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = documents.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("link"))
    base = cut(base.withColumn("row", F.monotonically_increasing_id()))
    links = base.select("row", F.xxhash64("link", "size", "text_crc32").alias("link"))
    found = shard_documents(base.drop("link"), links, 8)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
