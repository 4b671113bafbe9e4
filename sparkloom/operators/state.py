"""State machines over event tables: sessions, rate limits, breakers, conversation windows."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, ts: str, ttl_seconds: int) -> DataFrame:
    """Adds ``session``: a new one begins when a key was silent for ``ttl_seconds`` or longer."""
    order = Window.partitionBy(key).orderBy(ts, "event_id")
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    fresh = F.coalesce((micros - F.lag(micros).over(order) >= ttl_seconds * 1_000_000).cast("int"), F.lit(0))
    return events.withColumn("__fresh", fresh).withColumn("session", F.sum("__fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__fresh")


def window_counts(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Adds ``in_window``: events of the key in the ``seconds`` up to and including each event."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    frame = Window.partitionBy(key).orderBy(micros).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("in_window", F.count(F.lit(1)).over(frame))


def admit(events: DataFrame, key: str, ts: str, limit: int, seconds: int) -> DataFrame:
    """Adds ``admitted``: at most ``limit`` admitted events in a sliding window; refused ones leave no trace.

    Admission depends on earlier admissions, so a key is walked in order. A key's events pass in batches
    of bounded size; only the ``limit`` times that may count are held.
    """
    import pyarrow as pa

    walked = events.withColumn("__m", F.unix_micros(F.col(ts).cast("timestamp"))).repartition(key).sortWithinPartitions(key, F.col("__m").asc_nulls_last(), "event_id")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = object(), deque()
        for batch in batches:
            verdicts = []
            for own, at in zip(batch.column(key).to_pylist(), batch.column("__m").to_pylist()):
                if own != last:
                    last, held = own, deque()
                at = float("nan") if at is None else at  # no time: it drops none
                while held and at - held[0] > seconds * 1_000_000:
                    held.popleft()
                verdicts.append(len(held) < limit)
                if verdicts[-1]:
                    held.append(at)
            yield batch.select(names).append_column("admitted", pa.array(verdicts, pa.bool_()))

    names = events.columns
    return walked.mapInArrow(walk, events.withColumn("admitted", F.lit(True)).schema)


def breaker_runs(events: DataFrame, key: str, order_by: list[str], failed: str, threshold: int) -> DataFrame:
    """(key, island, failures, opened) of every run of consecutive failures."""
    order = Window.partitionBy(key).orderBy(*order_by)
    island = F.sum((~F.col(failed)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    runs = events.withColumn("island", island).where(failed).groupBy(key, "island").agg(F.count(F.lit(1)).alias("failures"))
    return runs.withColumn("opened", F.col("failures") >= threshold)


def fit_recent(messages: DataFrame, conversation: str, turn: str, text: str, last: int, budget: int) -> DataFrame:
    """The last messages of a conversation that fit the budget, newest first; the oldest kept one loses its beginning."""
    newest = Window.partitionBy(conversation).orderBy(F.col(turn).desc())
    recent = messages.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= last)
    used = F.coalesce(F.sum(F.length(text)).over(newest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = recent.withColumn("__room", F.lit(budget) - used).where("__room > 0")
    shown = F.expr(f"right({text}, cast(__room as int))")
    return kept.withColumn("shown", shown).drop("__n", "__room")
