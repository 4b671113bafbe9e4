"""Distribution functions in column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of the series and of the continued fraction: enough for 1e-12 up to some thousands.
TERMS = 300


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0: Stirling's series at x + 10, brought back by the product of what lies between."""
    x = x.cast("double")
    y = x + 10
    between = F.lit(0.0)
    for k in range(10):
        between = between + F.log(x + k)
    inverse = 1 / (y * y)
    series = (1 / 12 - inverse * (1 / 360 - inverse * (1 / 1260 - inverse / 1680))) / y
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - between


def gamma_q(a: Column, x: Column) -> Column:
    """The regularised upper incomplete gamma function: the chance that a gamma(a) variable exceeds x >= 0."""
    a, x = a.cast("double"), x.cast("double")
    front = F.exp(a * F.log(x) - x - log_gamma(a))

    def add(s: Column, n: Column) -> Column:
        term = s["term"] * x / (a + n)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    steps = F.sequence(F.lit(1), F.lit(TERMS))
    lower = front * F.aggregate(steps, F.struct((1 / a).alias("term"), (1 / a).alias("sum")), add)["sum"]
    # The continued fraction from its far end: each level divides by the one below.
    down = F.transform(steps, lambda n: F.lit(TERMS + 1) - n)
    tail = F.aggregate(down, F.lit(0.0), lambda v, n: n * (n - a) / (x + 2 * n + 1 - a - v))
    upper = front / (x + 1 - a - tail)
    return F.when(x <= 0, 1.0).when(x < a + 1, 1 - lower).otherwise(upper)


def normal_two_sided(z: Column) -> Column:
    """The chance that a standard normal variable lies further from 0 than z."""
    return gamma_q(F.lit(0.5), z * z / 2)


def chi_square_tail(x: Column, degrees: Column) -> Column:
    return gamma_q(degrees / 2, x / 2)
