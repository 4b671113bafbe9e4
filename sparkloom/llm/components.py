"""Connected components and links inside buckets, by joins and partial aggregates only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import cut, rewritten

#: Members of a bucket that stand in one cell where all of them are compared.
CELL = 1024


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): for every id of ``edges`` the smallest id reachable.

    Each round points every vertex at its first neighbour in some order, follows that pointer once
    more and contracts the edges. The order is that of the ids, which settles groups around their
    smallest id at once; from the fourth round on, every other round goes by a hash of the ids, which
    leaves a fixed share of the vertices even where ids rise along a chain. No vertex's neighbours
    are gathered: only minima are aggregated. Null ends are ignored.
    """
    live = cut(
        edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        .where("a is not null and b is not null and a < b")
        .distinct()
    )
    maps: list[DataFrame] = []
    while live.limit(1).count():
        both = live.select(F.col("a").alias("id"), F.col("b").alias("n")).unionByName(
            live.select(F.col("b").alias("id"), F.col("a").alias("n"))
        )
        if len(maps) >= 3 and len(maps) % 2:
            rank = [F.xxhash64(c, F.lit(len(maps))) for c in ("n", "id")]
            first = both.groupBy("id").agg(F.min_by("n", rank[0]).alias("n"), F.min(rank[0]).alias("r"))
            parent = cut(first.select("id", F.when(F.col("r") < rank[1], F.col("n")).otherwise(F.col("id")).alias("p")))
        else:
            parent = cut(both.groupBy("id").agg(F.min("n").alias("n")).select("id", F.least("id", "n").alias("p")))
        above = parent.select(F.col("id").alias("p"), F.col("p").alias("pp"))
        jumped = cut(parent.join(above, "p").select("id", F.col("pp").alias("p")))
        maps.append(jumped)
        ja = jumped.select(F.col("id").alias("a"), F.col("p").alias("pa"))
        jb = jumped.select(F.col("id").alias("b"), F.col("p").alias("pb"))
        live = rewritten(
            live.join(ja, "a").join(jb, "b")
            .where("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
            .distinct()
        )
    if not maps:
        return live.select(F.col("a").alias("id"), F.col("a").alias("component"))
    out = maps[-1].select("id", F.col("p").alias("component"))
    for earlier in reversed(maps[:-1]):
        later = out.select(F.col("id").alias("p"), F.col("component").alias("root"))
        out = cut(earlier.join(later, "p", "left").select("id", F.coalesce("root", "p").alias("component")))
    if len(maps) > 3:  # roots found by hash need not be the smallest id
        least = out.groupBy("component").agg(F.min("id").alias("least"))
        out = cut(out.join(least, "component").select("id", F.col("least").alias("component")))
    return out


def link_buckets(
    members: DataFrame,
    features: DataFrame,
    near: Callable[[str, str], Column],
    verify: Callable[[DataFrame], DataFrame],
    rounds: int = 2,
    narrow: Callable[[DataFrame], DataFrame] | None = None,
    last: Callable[[str, str], Column] | None = None,
) -> DataFrame:
    """Verified links (a, b) that connect exactly the ids which some verified pair of a bucket connects.

    ``members`` (bucket, id; buckets of two or more) and ``features`` (id, feature columns). ``near(x, y)`` is a cheap
    condition on the features of two sides, necessary for ``verify``, which keeps the true pairs of
    (a, b). A bucket's pairs are never all listed: first each member meets one pivot of its bucket,
    which settles groups of copies in a row per member; then only members of a bucket that are
    still in different components meet one another. Pairs left out are within one component.
    ``narrow`` may give the members of those last buckets more features (id and others). ``last``
    stands for ``near`` there; it may also tell in which of the buckets that two ids share they meet.
    """
    columns = [c for c in features.columns if c != "id"]
    members = cut(members.join(features, "id").withColumn("label", F.col("id")))
    links = None
    for turn in range(rounds + 1):
        spread = members.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi")
        x = members.alias("x")
        if turn < rounds:
            pick = F.min_by if turn == 0 else F.max_by
            pivots = members.groupBy("bucket").agg(
                F.min("label").alias("lo"), F.max("label").alias("hi"),
                pick(F.struct("id", "label", *columns), "id").alias("pivot"),
            ).where("lo < hi").select("bucket", "pivot.*")
            y = pivots.alias("y")
            pairs = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.label") != F.col("y.label")) & near("x", "y"))
        else:
            # A bucket's members meet cell by cell: two cells of it are a task's work, however many there are.
            rest = members.join(spread.select("bucket", F.ceil(F.col("n") / CELL).cast("int").alias("cells")), "bucket")
            if narrow:
                rest = cut(rest)
                rest = rest.join(narrow(rest.select("id").distinct()), "id")
            rest = rest.withColumn("cell", F.pmod(F.xxhash64("id"), F.col("cells")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
            rest = rest.withColumn("i", F.least("cell", "other")).withColumn("j", F.greatest("cell", "other"))
            x, y = rest.alias("x"), rest.alias("y")
            same = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
            once = (F.col("x.i") == F.col("x.j")) | (F.col("x.cell") != F.col("y.cell"))
            pairs = x.join(y, same & once & (F.col("x.label") < F.col("y.label")) & (last or near)("x", "y"))
        pairs = pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
        found = cut(verify(pairs).select("a", "b"))
        links = found if links is None else links.unionByName(found)
        if turn < rounds:
            labels = connected_components(links).select("id", F.col("component").alias("label"))
            members = cut(
                members.drop("label").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
            )
    return links
