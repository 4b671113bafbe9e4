"""State machines of one key, in plain Python: what batch walks and stream processors share."""

from __future__ import annotations

from collections import OrderedDict

MICROS = 1_000_000


class SessionCache:
    """Conversations of one store: touched by reads and writes, gone after ``ttl`` seconds of silence, at most ``cap`` of them.

    A write adds a question and an answer and keeps the last ``2 * max_turns`` messages; the conversation
    that was touched longest ago makes room. A read touches a conversation only if it is there.
    """

    def __init__(self, cap: int, ttl: int, max_turns: int) -> None:
        self.cap, self.ttl, self.keep = max(1, cap), max(1, ttl) * MICROS, 2 * max(1, max_turns)
        self.held: OrderedDict[str, tuple[int, list[str]]] = OrderedDict()

    def expire(self, now: int) -> list[str]:
        """Drops and names what was silent for too long. Recency is order of touch: only the front can be stale, as times rise."""
        gone = []
        while self.held and now - next(iter(self.held.values()))[0] >= self.ttl:
            gone.append(self.held.popitem(last=False)[0])
        return gone

    def step(self, now: int, kind: str, conversation: str, messages: list[str]) -> tuple[bool, int]:
        """(was it there, messages held after) of one event: 'read', 'write' or 'clear'."""
        self.expire(now)
        was = conversation in self.held
        if kind == "clear":
            self.held.pop(conversation, None)
        elif kind == "write" or was:
            old = self.held.pop(conversation, (now, []))[1]
            self.held[conversation] = (now, (old + messages)[-self.keep :] if kind == "write" else old)
            while len(self.held) > self.cap:
                self.held.popitem(last=False)
        return was, len(self.held.get(conversation, (0, []))[1])


class Breaker:
    """Calls of one service: ``threshold`` failures in a row open it; it rejects calls for ``recovery`` seconds, then lets them try.

    A rejected call leaves no trace. While it tries, a failure opens it anew and a success closes it.
    """

    def __init__(self, threshold: int, recovery: float, failures: int = 0, opened: int | None = None) -> None:
        self.threshold, self.recovery = threshold, int(recovery * MICROS)
        self.failures, self.opened = failures, opened

    def step(self, now: int, failed: bool) -> str:
        """How the call found the breaker: 'closed', 'open' (rejected) or 'half-open' (let through to try)."""
        tripped = self.failures >= self.threshold and self.opened is not None
        if tripped and now - self.opened < self.recovery:
            return "open"
        if failed:
            self.failures += 1
            if self.failures >= self.threshold:
                self.opened = now
        else:
            self.failures, self.opened = 0, None
        return "half-open" if tripped else "closed"
