"""Whether two texts are within an edit distance."""

from __future__ import annotations

import numpy as np


def _common_prefix(a: str, b: str) -> int:
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def edit_distance(a: str, b: str, most: int | None = None) -> int:
    """Levenshtein distance, a column of the table at a time as the bits of two integers; with ``most``, some number above it once that is sure."""
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    every, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, distance = every, 0, len(a)
    enough = float("inf") if most is None else most + len(b)
    for done, c in enumerate(b, 1):
        match = places.get(c, 0)
        diagonal = (((match & up) + up) ^ up) | match | down
        rise, fall = down | ~(diagonal | up) & every, up & diagonal
        if rise & top:
            distance += 1
        if fall & top:
            distance -= 1
        if distance + done > enough:  # each of the characters left takes one off at best
            break
        rise = rise << 1 & every | 1
        up, down = fall << 1 & every | ~(diagonal | rise) & every, rise & diagonal
    return distance


def words_bound(x: list[str], y: list[str]) -> int:
    """An upper bound of the distance of two texts of words: one walk along both, looking a few words ahead at each difference."""
    i = j = cost = 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            i, j = i + 1, j + 1
        elif x[i + 1 : i + 3] == y[j + 1 : j + 3]:
            cost, i, j = cost + max(len(x[i]), len(y[j])), i + 1, j + 1
        elif x[i + 1 : i + 3] == y[j : j + 2]:
            cost, i = cost + len(x[i]) + 1, i + 1
        elif x[i : i + 2] == y[j + 1 : j + 3]:
            cost, j = cost + len(y[j]) + 1, j + 1
        else:
            cost, i, j = cost + max(len(x[i]), len(y[j])), i + 1, j + 1
    return cost + sum(map(len, x[i:])) + len(x) - i + sum(map(len, y[j:])) + len(y) - j


def characters_bound(a: str, b: str) -> int:
    """A lower bound of the distance: characters that one text has more of."""
    x, y = (np.bincount(np.frombuffer(t.encode("latin-1", "replace"), dtype=np.uint8), minlength=256) for t in (a, b))
    more = x - y
    over = int(more[more > 0].sum())
    return max(over, over - len(a) + len(b))


def within_edits(a: str, b: str, most: int) -> bool:
    """Whether ``a`` becomes ``b`` by ``most`` insertions, deletions and replacements.

    Equal ends are cut off; then a walk along the words bounds the distance from above and the
    characters bound it from below, which settles most pairs; the rest is computed.
    """
    if abs(len(a) - len(b)) > most:
        return False
    n = _common_prefix(a, b)
    a, b = a[n:], b[n:]
    n = _common_prefix(a[::-1], b[::-1])
    a, b = a[: len(a) - n], b[: len(b) - n]
    if max(len(a), len(b)) <= most:
        return True
    if abs(len(a) - len(b)) > most:
        return False
    if words_bound(a.split(" "), b.split(" ")) <= most:
        return True
    return characters_bound(a, b) <= most and edit_distance(a, b, most) <= most
