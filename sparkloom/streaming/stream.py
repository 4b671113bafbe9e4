"""The state machines over streams: keyed state that survives restarts, and timers that free what has expired.

Both need the RocksDB state store. Rows of a micro-batch are taken in order of time and id; a later
batch continues from the state that the earlier ones left, so rows that come in order give what the
batch walks give.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from .machines import Breaker, SessionCache

STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _ordered(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(["at", "event_id"])  # a key's rows of one micro-batch


class SessionProcessor(StatefulProcessor):
    """Conversations of a store in a map state; ``seq`` tells the order of their last touch."""

    def __init__(self, cap: int, ttl: int, max_turns: int) -> None:
        self.settings = (cap, ttl, max_turns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sessions = handle.getMapState("sessions", "conversation string", "touched long, seq long, messages array<string>")

    def _load(self) -> tuple[SessionCache, dict[str, tuple]]:
        cache = SessionCache(*self.settings)
        stored = {k[0]: tuple(v) for k, v in self.sessions.iterator()}  # at most ``cap`` of them
        for name, (touched, _, messages) in sorted(stored.items(), key=lambda x: x[1][1]):
            cache.held[name] = (touched, list(messages))
        return cache, stored

    def _save(self, cache: SessionCache, stored: dict[str, tuple]) -> None:
        for name in stored:
            if name not in cache.held:
                self.sessions.removeKey((name,))
        for seq, (name, (touched, messages)) in enumerate(cache.held.items()):
            value = (touched, seq, messages)
            if stored.get(name) != value:
                self.sessions.updateValue((name,), value)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if cache.held:  # the front expires first
            self.handle.registerTimer((next(iter(cache.held.values()))[0] + cache.ttl) // 1000 + 1)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        cache, stored = self._load()
        batch = _ordered(rows)
        out = [cache.step(r.at, r.kind, r.conversation, list(r.messages)) for r in batch.itertuples(index=False)]
        self._save(cache, stored)
        yield pd.DataFrame({"event_id": batch["event_id"], "was_held": [x[0] for x in out], "held": [x[1] for x in out]})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        cache, stored = self._load()
        cache.expire(expiredTimerInfo.getExpiryTimeInMs() * 1000)
        self._save(cache, stored)
        yield pd.DataFrame({"event_id": pd.Series(dtype="int64"), "was_held": pd.Series(dtype="bool"), "held": pd.Series(dtype="int32")})

    def close(self) -> None:
        pass


class BreakerProcessor(StatefulProcessor):
    """Failures in a row and when the breaker opened last, of one service."""

    def __init__(self, threshold: int, recovery: float) -> None:
        self.settings = (threshold, recovery)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("breaker", "failures int, opened long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        machine = Breaker(*self.settings, *(self.state.get() if self.state.exists() else (0, None)))
        batch = _ordered(rows)
        found = [machine.step(r.at, r.failed) for r in batch.itertuples(index=False)]
        self.state.update((machine.failures, machine.opened))
        yield pd.DataFrame({"event_id": batch["event_id"], "found": found})

    def close(self) -> None:
        pass


def session_stream(events: DataFrame, cap: int, ttl: int, max_turns: int = 6) -> DataFrame:
    """(event_id, was_held, held) of a stream of events as ``batch.session_cache`` takes them, with a watermark on their time."""
    schema = StructType.fromDDL("event_id long, was_held boolean, held int")
    return events.groupBy("store").transformWithStateInPandas(SessionProcessor(cap, ttl, max_turns), schema, "Append", "EventTime")


def breaker_stream(calls: DataFrame, threshold: int = 3, recovery: float = 30.0) -> DataFrame:
    """(event_id, found) of a stream of calls as ``batch.breaker_calls`` takes them."""
    return calls.groupBy("service").transformWithStateInPandas(BreakerProcessor(threshold, recovery), StructType.fromDDL("event_id long, found string"), "Append", "None")
