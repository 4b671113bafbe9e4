"""Token usage: what calls report, what it costs, and how it spreads over buckets and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("prompt", "cached", "completion")


def reported(raw: Column) -> Column:
    """A reported count: a whole number of 0 or more; anything else counts 0."""
    return F.greatest(F.coalesce(raw.try_cast("double").try_cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long"))


def accumulate(calls: DataFrame, by: list[str]) -> DataFrame:
    """(by, calls, prompt, cached, completion, without) of calls (by, prompt, cached, completion as text); ``without``: calls that reported nothing at all."""
    nothing = F.col("prompt").isNull() & F.col("cached").isNull() & F.col("completion").isNull()
    return calls.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), *[F.sum(reported(F.col(f))).alias(f) for f in FIELDS], F.count_if(nothing).alias("without"))


def cost(usage: DataFrame, prices: DataFrame, by: list[str]) -> DataFrame:
    """(by, tokens, cost) of usage (by, model, prompt, cached, completion) under prices (model, fresh, cached_price, out) per million tokens.

    Cached tokens are part of the prompt and have their own price. Models without a price cost nothing;
    where no model has one, there is no cost.
    """
    priced = usage.join(prices, "model", "left")
    fresh = (F.col("prompt") - F.col("cached")) * F.col("fresh") + F.col("cached") * F.col("cached_price") + F.col("completion") * F.col("out")
    return priced.groupBy(*by).agg(F.sum(F.col("prompt") + F.col("completion")).alias("tokens"), (F.sum(fresh) / 1_000_000).alias("cost"))
