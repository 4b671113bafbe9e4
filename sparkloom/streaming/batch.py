"""The state machines over tables: rows of a key pass in order, in batches of bounded size, and only the key's state is held."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .machines import Breaker, SessionCache


def _walk(df: DataFrame, key: str, order: list[str], fresh: Callable[[], object], step: Callable[[object, object], tuple], added: str) -> DataFrame:
    """Adds the columns ``added``: what ``step(machine, row)`` gives for each row of a key in order, with a ``fresh`` machine a key."""
    names = [x.split()[0] for x in added.split(", ")]
    schema = df.schema.simpleString()[len("struct<") : -1] + "," + ",".join(x.replace(" ", ":") for x in added.split(", "))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, machine = object(), None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                own = getattr(row, key)
                if own != last:
                    last, machine = own, fresh()
                out.append(step(machine, row))
            yield batch.assign(**dict(zip(names, zip(*out)))) if out else batch.assign(**dict.fromkeys(names))

    return df.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def session_cache(events: DataFrame, cap: int, ttl: int, max_turns: int = 6) -> DataFrame:
    """Adds was_held and held to events (store, conversation, at in microseconds, event_id, kind, messages)."""
    return _walk(events, "store", ["at", "event_id"], lambda: SessionCache(cap, ttl, max_turns), lambda m, r: m.step(r.at, r.kind, r.conversation, list(r.messages)), "was_held boolean, held int")


def breaker_calls(calls: DataFrame, threshold: int = 3, recovery: float = 30.0) -> DataFrame:
    """Adds found ('closed', 'open', 'half-open') to calls (service, at in microseconds, event_id, failed)."""
    return _walk(calls, "service", ["at", "event_id"], lambda: Breaker(threshold, recovery), lambda m, r: (m.step(r.at, r.failed),), "found string")


def session_memory(events: DataFrame, write: Column, ttl: int, max_turns: int = 6) -> DataFrame:
    """The session cache without a cap, in closed form: adds was_held and held to events (conversation, at, event_id).

    A silence of ``ttl`` seconds cuts a conversation's events; behind a cut, what comes before the
    first write finds nothing. No Python, and no more state than a window's.
    """
    order = Window.partitionBy("conversation").orderBy("at", "event_id")
    fresh = F.coalesce((F.col("at") - F.lag("at").over(order) >= ttl * 1_000_000).cast("int"), F.lit(0))
    cut = events.withColumn("__fresh", fresh).withColumn("__run", F.sum("__fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("conversation", "__run").orderBy("at", "event_id")
    upto = F.count(F.when(write, 1)).over(run.rowsBetween(Window.unboundedPreceding, 0))
    seen = cut.withColumn("__upto", upto)
    was = F.col("__upto") - F.when(write, 1).otherwise(0) > 0
    return seen.withColumn("was_held", was).withColumn("held", F.least(2 * F.col("__upto"), F.lit(2 * max_turns)).cast("int")).drop("__fresh", "__run", "__upto")
