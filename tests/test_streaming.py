"""Session memory and breaker: batch, stream and plain walks give the same rows."""

import pytest
from pyspark.sql import functions as F

import sparkloom.plans as plans
from sparkloom.plans import memory
from sparkloom.streaming import batch, stream


def walk_sessions(rows, cap, ttl, max_turns):
    """Every conversation's last touch and messages in a list, oldest touch first."""
    stores, out = {}, {}
    for r in sorted(rows, key=lambda r: (r["at"], r["event_id"])):
        held = [x for x in stores.get(r["store"], []) if r["at"] - x[1] < ttl * 1_000_000]
        own = next((x for x in held if x[0] == r["conversation"]), None)
        if r["kind"] == "write":
            held = [x for x in held if x is not own] + [(r["conversation"], r["at"], ((own[2] if own else []) + list(r["messages"]))[-2 * max_turns :])]
            held = held[-cap:]
        elif own and r["kind"] == "read":
            held = [x for x in held if x is not own] + [(own[0], r["at"], own[2])]
        elif own:
            held.remove(own)
        stores[r["store"]] = held
        out[r["event_id"]] = (own is not None, next((len(x[2]) for x in held if x[0] == r["conversation"]), 0))
    return out


def walk_breaker(rows, threshold, recovery):
    state, out = {}, {}
    for r in sorted(rows, key=lambda r: (r["at"], r["event_id"])):
        failures, opened = state.get(r["service"], (0, None))
        if opened is not None and r["at"] - opened < recovery * 1_000_000:
            out[r["event_id"]] = "open"
            continue
        out[r["event_id"]] = "half-open" if opened is not None else "closed"
        failures = failures + 1 if r["failed"] else 0
        state[r["service"]] = (failures, r["at"] if failures >= threshold else None)
    return out


@pytest.fixture(scope="module")
def events(spark, small):
    return spark.read.parquet(f"{small}/events.parquet")


@pytest.mark.parametrize("cap, ttl", [(1000, 86_400), (3, 86_400), (1, 7_200)])
def test_sessions_in_batch(spark, events, cap, ttl):
    rows = memory.session_events(events)
    want = walk_sessions(rows.collect(), cap, ttl, 2)
    assert {r["event_id"]: (r["was_held"], r["held"]) for r in batch.session_cache(rows, cap, ttl, 2).collect()} == want
    if cap == 1000:
        touched = rows.where("kind <> 'clear'")
        closed = batch.session_memory(touched, F.col("kind") == "write", ttl, 2)
        assert {r["event_id"]: (r["was_held"], r["held"]) for r in closed.collect()} == walk_sessions(touched.collect(), cap, ttl, 2)


def test_breaker_in_batch(spark, events):
    rows = memory.breaker_events(events)
    for threshold, recovery in ((3, 86_400), (1, 3_600), (2, 30)):
        want = walk_breaker(rows.collect(), threshold, recovery)
        assert {r["event_id"]: r["found"] for r in batch.breaker_calls(rows, threshold, recovery).collect()} == want
        assert set(want.values()) == {"closed", "open", "half-open"} or recovery == 30


def run_stream(spark, rows, path, build, name):
    """``rows`` in four files by time, one a micro-batch."""
    cuts = rows.approxQuantile("at", [0.0, 0.25, 0.5, 0.75], 0.0) + [float("inf")]
    source = str(path / "in")
    for n, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
        part = rows.where((F.col("at") >= lo) & (F.col("at") < hi)).coalesce(1)
        part.write.mode("append").parquet(source)
    spark.conf.set(*stream.STATE_STORE)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        incoming = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(source)
        query = build(incoming).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.table(name).collect()
    finally:
        spark.conf.unset(stream.STATE_STORE[0])
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_sessions_in_a_stream(spark, events, tmp_path):
    rows = memory.session_events(events)
    want = {r["event_id"]: (r["was_held"], r["held"]) for r in batch.session_cache(rows, 3, 86_400, 2).collect()}

    def build(incoming):
        timed = incoming.withColumn("ts", F.timestamp_micros("at")).withWatermark("ts", "1 minute")
        return stream.session_stream(timed, 3, 86_400, 2)

    found = run_stream(spark, rows, tmp_path, build, "sessions_seen")
    assert len(found) == len(want) and {r["event_id"]: (r["was_held"], r["held"]) for r in found} == want


def test_breaker_in_a_stream(spark, events, tmp_path):
    rows = memory.breaker_events(events)
    want = {r["event_id"]: r["found"] for r in batch.breaker_calls(rows, 3, 86_400).collect()}
    found = run_stream(spark, rows, tmp_path, lambda incoming: stream.breaker_stream(incoming, 3, 86_400), "calls_seen")
    assert {r["event_id"]: r["found"] for r in found} == want


def test_odd_rows(spark):
    calls = spark.createDataFrame([("s", 1, 1, True), (None, 2, 2, True), ("s", 3, 3, True)], "service string, at long, event_id long, failed boolean")
    assert {(r["event_id"], r["found"]) for r in batch.breaker_calls(calls, 2, 1).collect()} == {(1, "closed"), (3, "closed")}
    assert batch.breaker_calls(calls.where("false")).count() == 0
    assert {"session_cache", "session_memory", "breaker_calls"} <= set(plans.queries())
