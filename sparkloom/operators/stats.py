"""Evaluation statistics in column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.special import chi_square_tail, normal_two_sided
from sparkloom.sources.scratch import pinned

Z95 = 1.959964
#: Ranges of values that a group's running sums are taken in.
RANGES = 64


def nearest_rank(values: Column, p: float) -> Column:
    """The element at round-half-even((n - 1) * p) of the sorted array."""
    ordered = F.array_sort(values)
    return F.element_at(ordered, (F.bround((F.size(ordered) - 1) * p, 0) + 1).cast("int"))


def wilson(successes: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson's 95 % interval of a share."""
    p, d = successes / n, 1 + z * z / n
    middle = (p + z * z / (2 * n)) / d
    half = F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) * z / d
    return middle - half, middle + half


def nearest_ranks(df: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(group, a column per share): the element at round-half-even((n - 1) * share) of each group's sorted values.

    From counts by distinct value and their running sum: no group's values are gathered.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("__n"))
    own, by = Window.partitionBy(*group), Window.partitionBy(*group).orderBy(value)
    seen = counts.withColumn("__upto", F.sum("__n").over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__all", F.sum("__n").over(own))
    at = {name: F.bround((F.col("__all") - 1) * share, 0) for name, share in shares.items()}
    return seen.groupBy(*group).agg(*[F.min(F.when(F.col("__upto") > place, F.col(value))).alias(name) for name, place in at.items()])


def exact_quantiles(df: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(group, a column per share): quantiles by linear interpolation between the values at (n - 1) * share, from running counts by value."""
    ranked = value_ranks(df.where(F.col(value).isNotNull()), group, value)
    sizes = ranked.groupBy(*group).agg(F.sum("t").alias("__n"))
    placed = ranked.join(F.broadcast(sizes)) if not group else ranked.join(sizes, group)
    upto = F.col("below") + F.col("t")
    bounds = []
    for name, share in shares.items():
        at = (F.col("__n") - 1) * share
        bounds += [F.min(F.when(upto > F.floor(at), F.col(value))).alias(f"__lo_{name}"), F.min(F.when(upto > F.ceil(at), F.col(value))).alias(f"__hi_{name}"), F.max(at - F.floor(at)).alias(f"__w_{name}")]
    found = placed.groupBy(*group).agg(*bounds)
    return found.select(*group, *[(F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * F.col(f"__w_{n}")).alias(n) for n in shares])


def snapshot_difference(now: DataFrame, then: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, values): what each key's values have grown by; a side that lacks a key counts 0, and rows of zeros are left out."""
    before = then.select(*keys, *[F.col(v).alias(f"__{v}") for v in values])
    both = now.join(before, keys, "full_outer")
    grown = both.select(*keys, *[(F.coalesce(v, F.lit(0)) - F.coalesce(f"__{v}", F.lit(0))).alias(v) for v in values])
    return grown.where(F.greatest(*[F.abs(v) for v in values], F.lit(0)) > 0)


def mcnemar_exact(b: Column, c: Column) -> Column:
    """Two-sided exact p of discordant counts b and c (up to some millions): binomial terms one from the other, in logarithms."""
    n, k = b + c, F.least(b, c)
    start = F.struct((-n * F.log(F.lit(2.0))).alias("term"), F.exp(-n * F.log(F.lit(2.0))).alias("sum"))

    def step(state: Column, i: Column) -> Column:
        term = state["term"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double"))
        return F.struct(term.alias("term"), (state["sum"] + F.exp(term)).alias("sum"))

    tail = F.aggregate(F.filter(F.sequence(F.lit(0), k.cast("int")), lambda i: i > 0), start, step)["sum"]
    return F.when(n == 0, 1.0).otherwise(F.least(2 * tail, F.lit(1.0)))


def running_sums(df: DataFrame, group: list[str], value: str, amounts: dict[str, str]) -> DataFrame:
    """Adds to rows of one value each, per group: for every (amount, name), the sum of the amounts of smaller values.

    A group's values are cut into ranges at its approximate quantiles: sums run within a range, and over
    the few ranges of a group, so that no task sorts a whole group. Null values come first.
    """
    shares = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    cuts = pinned(df.groupBy(*group).agg(F.percentile_approx(value, shares, 4 * RANGES).alias("__cuts")))  # both uses below must cut alike
    at = F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col(value))), F.lit(-1))
    joined = df.join(F.broadcast(cuts)) if not group else df.join(cuts, group)  # without a group: one row
    ranged = joined.withColumn("__range", at).drop("__cuts")
    own = Window.partitionBy(*group, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*group, "__range").agg(*[F.sum(a).alias(f"__{n}") for a, n in amounts.items()])
    shifts = totals.select(*group, "__range", *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in amounts.values()])
    found = ranged.join(shifts, [*group, "__range"])
    return found.withColumns({n: F.coalesce(F.sum(a).over(own), F.lit(0)) + F.col(f"__{n}") for a, n in amounts.items()}).drop("__range", *[f"__{n}" for n in amounts.values()])


def value_ranks(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, value, t, below): how many rows of a group have each value, and how many a smaller one."""
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("t"))
    return running_sums(counts, group, value, {"t": "below"})


def holm(df: DataFrame, family: list[str], p: str, tie: str) -> DataFrame:
    """Adds ``adjusted``: Holm's step-down p within each family.

    The last row of each p value decides: its predecessors of that value have larger steps, so a value's
    adjusted p is the largest first step of the values up to it; ``tie`` no longer matters then.
    """
    ranks = value_ranks(df.where(F.col(p).isNotNull()), family, p)
    sizes = df.where(F.col(p).isNotNull()).groupBy(*family).agg(F.count(F.lit(1)).alias("__m"))
    step = F.least((F.col("__m") - F.col("below")) * F.col(p), F.lit(1.0))
    steps = ranks.join(sizes, family).withColumn("__step", step)
    return df.join(_running_max(steps, family, p), [*family, p], "left")


def _running_max(steps: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, value, adjusted): the largest ``__step`` up to each value, by ranges as in ``running_sums``."""
    shares = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    cuts = pinned(steps.groupBy(*group).agg(F.percentile_approx(value, shares, 4 * RANGES).alias("__cuts")))
    ranged = steps.join(cuts, group).withColumn("__range", F.size(F.filter("__cuts", lambda c: c < F.col(value)))).select(*group, value, "__range", "__step")
    own = Window.partitionBy(*group, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    tops = ranged.groupBy(*group, "__range").agg(F.max("__step").alias("__top")).select(*group, "__range", F.coalesce(F.max("__top").over(before), F.lit(0.0)).alias("__before"))
    return ranged.join(tops, [*group, "__range"]).select(*group, value, F.greatest(F.max("__step").over(own), "__before").alias("adjusted"))


def average_ranks(df: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """Adds the average rank of ``value``; ties share theirs."""
    ranks = value_ranks(df, group, value).select(*group, value, (F.col("below") + (F.col("t") + 1) / 2).alias(name))
    return df.join(ranks, [*group, value])


def kruskal_h(df: DataFrame, group: str, value: str) -> DataFrame:
    """(h, groups, n, p): the tie-corrected Kruskal-Wallis statistic of all rows and its chance under chi-square."""
    ranks = value_ranks(df, [], value).select(value, "t", (F.col("below") + (F.col("t") + 1) / 2).alias("r"))
    sums = df.join(ranks, value).groupBy(group).agg(F.sum("r").alias("s"), F.count(F.lit(1)).alias("k"))
    ties = ranks.agg(F.sum(F.col("t").cast("double") * F.col("t") * F.col("t") - F.col("t")).alias("ties"), F.sum("t").alias("n"))
    total = sums.agg(F.sum(F.col("s") * F.col("s") / F.col("k")).alias("q"), F.count(F.lit(1)).alias("groups"))
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / F.nullif(1 - F.col("ties") / (n * n * n - n), F.lit(0.0))
    found = total.join(ties).select(h.alias("h"), "groups", F.col("n"))  # one row by one row
    return found.withColumn("p", F.when(F.col("h").isNull(), 1.0).otherwise(chi_square_tail(F.greatest("h", F.lit(0.0)), F.col("groups") - 1)))


#: Differences of a group up to which the signed-rank test lists every split of the signs.
EXACT = 50


def wilcoxon_zsplit(df: DataFrame, group: list[str], difference: str, exact: int = EXACT) -> DataFrame:
    """(group, n, plus, minus, p): the two-sided signed-rank test; zeros keep their ranks, half of them on either side.

    Up to ``exact`` differences without ties and zeros the chance comes from the number of ways to
    reach each sum, counted by dynamic programming; beyond, and with ties or zeros, from the normal
    approximation with its tie correction. Null differences are left out; all zero gives 1.
    """
    size = F.abs(F.col(difference))
    own = df.where(F.col(difference).isNotNull()).select(*group, size.alias("__size"), F.sign(difference).alias("__sign"))
    counts = own.groupBy(*group, "__size").agg(F.count(F.lit(1)).alias("t"), F.count(F.when(F.col("__sign") > 0, 1)).alias("up"), F.count(F.when(F.col("__sign") < 0, 1)).alias("down"))
    rank = F.col("below") + (F.col("t") + 1) / 2
    t = F.col("t").cast("double")
    half = F.when(F.col("__size") == 0, F.col("t") / 2).otherwise(0.0)
    sums = running_sums(counts, group, "__size", {"t": "below"}).groupBy(*group).agg(
        F.sum("t").alias("n"), F.sum(rank * (F.col("up") + half)).alias("plus"), F.sum(rank * (F.col("down") + half)).alias("minus"),
        F.sum(t * t * t - t).alias("ties"), F.max(F.when(F.col("__size") == 0, F.col("t")).otherwise(0)).alias("zeros"),
    )
    n, least = F.col("n").cast("double"), F.least("plus", "minus")
    spread = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("ties") / 2) / 24)
    far = F.when(spread > 0, normal_two_sided((least - n * (n + 1) / 4) / spread)).otherwise(1.0)
    p = F.when(F.col("zeros") == F.col("n"), 1.0).when((F.col("n") <= exact) & (F.col("ties") == 0) & (F.col("zeros") == 0), signed_rank_exact(F.col("n"), least)).otherwise(far)
    return sums.select(*group, "n", "plus", "minus", p.alias("p"))


def signed_rank_exact(n: Column, least: Column) -> Column:
    """Twice the chance that ranks 1..n with random signs sum up to ``least`` or less: ways by sum, one rank after the other."""
    places = F.sequence(F.lit(0), (n * (n + 1) / 2).cast("int"))
    start = F.transform(places, lambda s: F.when(s == 0, 1.0).otherwise(0.0))

    def add(ways: Column, r: Column) -> Column:
        return F.transform(ways, lambda w, s: (w + F.when(s >= r, F.try_element_at(ways, s - r + 1)).otherwise(0.0)) / 2)

    chances = F.aggregate(F.sequence(F.lit(1), n.cast("int")), start, add)
    tail = F.aggregate(F.slice(chances, 1, F.floor(least).cast("int") + 1), F.lit(0.0), lambda a, c: a + c)
    return F.least(2 * tail, F.lit(1.0))


def fleiss_kappa(counts: DataFrame, subject: str, category: str, n: str) -> DataFrame:
    """(kappa,) of (subject, category, n) ratings; subjects with the commonest number of ratings only."""
    totals = counts.groupBy(subject).agg(F.sum(n).alias("raters"), F.sum(F.col(n) * F.col(n)).alias("squares"))
    modal = totals.groupBy("raters").agg(F.count(F.lit(1)).alias("c")).orderBy(F.col("c").desc(), "raters").limit(1).select("raters")
    used = totals.join(F.broadcast(modal), "raters")  # one row
    agreement = used.agg(F.avg((F.col("squares") - F.col("raters")) / (F.col("raters") * (F.col("raters") - 1))).alias("p"))
    shares = counts.join(used.select(subject), subject).groupBy(category).agg(F.sum(n).alias("c"))
    chance = shares.agg((F.sum(F.col("c").cast("double") * F.col("c")) / (F.sum("c").cast("double") * F.sum("c"))).alias("e"))
    return agreement.join(chance).select(((F.col("p") - F.col("e")) / (1 - F.col("e"))).alias("kappa"))  # one row by one row


def weighted_kappa(pairs: DataFrame, a: str, b: str, k: int) -> DataFrame:
    """(kappa,): quadratic weights over ``k`` classes 0..k-1 of two raters."""
    weight = F.pow((F.col(a) - F.col(b)).cast("double"), F.lit(2.0)) / ((k - 1) ** 2)
    seen = pairs.agg(F.avg(weight).alias("o"), F.count(F.lit(1)).alias("n"))
    left, right = pairs.groupBy(a).agg(F.count(F.lit(1)).alias("x")), pairs.groupBy(b).agg(F.count(F.lit(1)).alias("y"))
    due = left.join(right).agg(F.sum(weight * F.col("x") * F.col("y")).alias("e"))  # k classes by k classes
    return seen.join(due).select((1 - F.col("o") / (F.col("e") / (F.col("n").cast("double") * F.col("n")))).alias("kappa"))


def cluster_bootstrap(df: DataFrame, cluster: list[str], value: str, repeats: int = 10_000, seed: int = 42) -> DataFrame:
    """(mean, lo, hi): the mean of all values, and its percentile interval over clusters drawn with replacement.

    A cluster goes by its sum and its count. Each is drawn a Poisson(1) number of times per repeat, from
    a generator keyed by the cluster: tasks add up what their clusters give to every repeat, so that a
    row per repeat and batch is all that is shuffled. Reruns agree.
    """
    import numpy as np
    import pandas as pd

    sums = df.where(F.col(value).isNotNull()).groupBy(*cluster).agg(F.sum(F.col(value).cast("double")).alias("s"), F.count(F.lit(1)).cast("double").alias("n"))
    keyed = sums.select(F.xxhash64(*cluster, F.lit(seed)).alias("key"), "s", "n")

    def draw(batches):
        for batch in batches:
            total, rows = np.zeros(repeats), np.zeros(repeats)
            for key, s, n in batch.itertuples(index=False):
                times = np.random.Generator(np.random.Philox(key=key % (1 << 64))).poisson(1.0, repeats)
                total += times * s
                rows += times * n
            yield pd.DataFrame({"r": np.arange(repeats), "s": total, "n": rows})

    each = keyed.mapInPandas(draw, "r long, s double, n double").groupBy("r").agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0.0))).alias("m"))
    bounds = each.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("b"))
    point = sums.agg((F.sum("s") / F.sum("n")).alias("mean"))
    return point.join(bounds).select("mean", F.col("b")[0].alias("lo"), F.col("b")[1].alias("hi"))  # one row by one row


def paired_deltas(base: DataFrame, arm: DataFrame, key: str, value: str) -> DataFrame:
    """(key, base, arm, delta): means of the questions that both arms answered; null values are left out."""
    left, right = (x.where(F.col(value).isNotNull()).groupBy(key).agg(F.avg(value).alias(name)) for x, name in ((base, "base"), (arm, "arm")))
    return left.join(right, key).withColumn("delta", F.col("arm") - F.col("base"))


def paired_comparison(base: DataFrame, arm: DataFrame, key: str, value: str, repeats: int = 10_000) -> DataFrame:
    """(n, base, arm, delta, lo, hi, p): two arms by question, with the bootstrap interval of the difference and the signed-rank p; no row below two questions."""
    pairs = pinned(paired_deltas(base, arm, key, value))
    means = pairs.agg(F.count(F.lit(1)).alias("n"), F.avg("base").alias("base"), F.avg("arm").alias("arm"), F.avg("delta").alias("delta")).where("n >= 2")
    interval = cluster_bootstrap(pairs, [key], "delta", repeats).select("lo", "hi")
    return means.join(interval).join(wilcoxon_zsplit(pairs, [], "delta").select("p"))  # single rows
