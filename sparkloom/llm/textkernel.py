"""Vectorised word spans and word hashes over Arrow string columns.

A word is a maximal run of bytes outside space and 09-0D; A-Z count as a-z. Hashes are
polynomial over the word's bytes modulo 2**64, taken from one running sum per chunk, so a
chunk costs a handful of numpy passes however many words it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values() -> np.ndarray:
    values = mix64(np.arange(1, 257, dtype=np.uint64) * _ODD)
    values[65:91] = values[97:123]
    return values


_VALUE = _byte_values()
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False


class _Powers:
    """Powers of an odd base and of its inverse, grown as longer chunks appear."""

    base = np.uint64(0xD6E8FEB86659FD93)
    inverse = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            ones = np.ones(max(n, CHUNK_BYTES), dtype=np.uint64)
            ones[1:] = self.base
            self.up = np.cumprod(ones)
            ones[1:] = self.inverse
            self.down = np.cumprod(ones)
        return self.up, self.down


_POWERS = _Powers()


def chunks(column: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows holding about ``max_bytes``; a long row stays whole. Null is empty."""
    column = column.cast(pa.large_binary())
    if len(column) == 0:
        return
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < len(column):
        hi = int(np.searchsorted(offsets, offsets[lo] + max_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), len(column))
        yield lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; a word never crosses a row."""
    if len(data) == 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    word = inside[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | edge[1:-1]
    stop = word.copy()
    stop[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = _VALUE) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    up, down = _POWERS.upto(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _ODD)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its ``width``-word shingles; fewer words: the whole sequence as one; none: empty."""
    starts, ends, rows = word_spans(data, offsets)
    hashes = span_hashes(data, starts, ends)
    bounds = np.searchsorted(rows, np.arange(len(offsets)))
    rolled = np.zeros(max(0, len(hashes) - width + 1), dtype=np.uint64)
    for i in range(width):
        rolled = mix64(rolled + hashes[i : i + len(rolled)] * np.uint64(2 * i + 3))
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if hi - lo >= width:
            out.append(np.unique(rolled[lo : hi - width + 1]))
        elif hi > lo:
            whole = np.full(1, hi - lo, dtype=np.uint64)
            for i in range(lo, hi):
                whole = mix64(whole * _ODD + hashes[i : i + 1])
            out.append(whole)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
