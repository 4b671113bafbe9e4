"""Rank tests, distribution functions and intervals against enumeration and published values."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import special
from sparkloom.operators import stats


@pytest.mark.parametrize("x, degrees, p", [(3.841, 1, 0.05), (5.991, 2, 0.05), (9.488, 4, 0.05), (13.277, 4, 0.01), (18.307, 10, 0.05), (124.342, 100, 0.05), (0.0, 3, 1.0), (149.449, 100, 0.001), (1.064, 4, 0.9)])
def test_chi_square(spark, x, degrees, p):
    got = spark.range(1).select(special.chi_square_tail(F.lit(x), F.lit(degrees)).alias("p")).first()["p"]
    assert abs(got - p) < 2e-4 * max(1, p / 0.05)


@pytest.mark.parametrize("z, p", [(1.959964, 0.05), (2.575829, 0.01), (0.0, 1.0), (0.674490, 0.5), (4.0, 6.334248e-05), (-1.644854, 0.1)])
def test_normal(spark, z, p):
    assert spark.range(1).select(special.normal_two_sided(F.lit(z)).alias("p")).first()["p"] == pytest.approx(p, rel=1e-5)


def test_log_gamma(spark):
    rows = spark.createDataFrame([(x / 4,) for x in range(1, 400)], "x double").select("x", special.log_gamma(F.col("x")).alias("g")).collect()
    assert all(r["g"] == pytest.approx(math.lgamma(r["x"]), abs=1e-10) for r in rows)


def ranks(values):
    order = sorted(values)
    return [order.index(v) + (order.count(v) + 1) / 2 for v in values]


@pytest.mark.parametrize("n", [1, 2, 5, 9, 12])
def test_wilcoxon_by_enumeration(spark, n):
    rng = random.Random(n)
    d = [rng.choice((-1, 1)) * v for v in rng.sample(range(1, 100), n)]
    r = ranks([abs(x) for x in d])
    plus = sum(k for k, x in zip(r, d) if x > 0)
    least = min(plus, sum(r) - plus)
    hits = sum(sum(k for k, s in zip(r, signs) if s) <= least for signs in itertools.product((0, 1), repeat=n))
    got = stats.wilcoxon_zsplit(spark.createDataFrame([(float(x),) for x in d], "d double"), [], "d").first()
    assert (got["n"], got["plus"]) == (n, plus) and got["p"] == pytest.approx(min(1.0, 2 * hits / 2**n), abs=1e-12)


def test_wilcoxon_with_ties_and_zeros(spark):
    """Groups by hand: zeros split to both sides, the tie correction of the normal approximation, all zero, nulls."""
    d = [0, 0, 1, 1, -1, 2, 3, -3, 5, 8]
    r = ranks([abs(x) for x in d])
    zero = sum(k for k, x in zip(r, d) if x == 0) / 2
    plus, minus = (sum(k for k, x in zip(r, d) if side * x > 0) + zero for side in (1, -1))
    ties = sum(c**3 - c for c in (2, 3, 1, 2, 1, 1))
    spread = math.sqrt((10 * 11 * 21 - ties / 2) / 24)
    p = math.erfc(abs(min(plus, minus) - 10 * 11 / 4) / spread / math.sqrt(2))
    rows = [("a", float(x)) for x in d] + [("z", 0.0)] * 3 + [("a", None)]
    found = {x["g"]: x for x in stats.wilcoxon_zsplit(spark.createDataFrame(rows, "g string, d double"), ["g"], "d").collect()}
    assert (found["a"]["plus"], found["a"]["minus"], found["a"]["n"]) == (plus, minus, 10) and found["a"]["p"] == pytest.approx(p, rel=1e-9)
    assert found["z"]["p"] == 1.0


def test_kruskal(spark):
    """Hollander and Wolfe's mucociliary example: H = 0.7714, p = 0.68."""
    groups = {"a": [2.9, 3.0, 2.5, 2.6, 3.2], "b": [3.8, 2.7, 4.0, 2.4], "c": [2.8, 3.4, 3.7, 2.2, 2.0]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    got = stats.kruskal_h(df, "g", "v").first()
    assert got["h"] == pytest.approx(0.7714, abs=1e-4) and got["p"] == pytest.approx(0.68, abs=1e-3)
    same = stats.kruskal_h(spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 1.0)], "g string, v double"), "g", "v").first()
    assert same["p"] == 1.0


def test_running_sums_over_many_ranges(spark):
    rng = random.Random(3)
    rows = [(g, v, rng.randrange(5)) for g in ("x", "y", None) for v in rng.sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "g string, v int, n int").where("g is not null")
    found = {(r["g"], r["v"]): r["below"] for r in stats.running_sums(df, ["g"], "v", {"n": "below"}).collect()}
    assert found == {(g, v): sum(n for h, w, n in rows if h == g and w < v) for g, v, _ in rows if g}


def test_bootstrap(spark):
    """10,000 repeats: the interval of a mean of clusters is near the normal one, and the ratio weighs clusters by size."""
    rng = random.Random(9)
    rows = [(c, 10 + rng.gauss(0, 2)) for c in range(200) for _ in range(1 + c % 3)]
    got = stats.cluster_bootstrap(spark.createDataFrame(rows, "c int, v double").repartition(3), ["c"], "v").first()
    mean = sum(v for _, v in rows) / len(rows)
    sd = math.sqrt(sum((v - mean) ** 2 for _, v in rows) / (len(rows) - 1) / len(rows))
    assert got["mean"] == pytest.approx(mean)
    assert got["lo"] == pytest.approx(mean - 1.96 * sd, abs=0.35 * sd) and got["hi"] == pytest.approx(mean + 1.96 * sd, abs=0.35 * sd)


def test_paired_comparison(spark):
    rng = random.Random(4)
    base = [(q, float(rng.randrange(10))) for q in range(30) for _ in range(2)]
    arm = [(q, v + 1.5 + rng.random()) for q, v in base if q < 25] + [(99, 1.0)]
    got = stats.paired_comparison(*(spark.createDataFrame(x, "q int, v double") for x in (base, arm)), "q", "v", repeats=2000).first()
    assert got["n"] == 25 and got["lo"] < got["delta"] < got["hi"] and got["lo"] > 1.5 and got["p"] < 1e-6
    one = spark.createDataFrame([(1, 2.0)], "q int, v double")
    assert stats.paired_comparison(one, one, "q", "v", repeats=10).count() == 0
