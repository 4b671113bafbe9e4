"""Fuzzy line dedup: SimHash in blocks on normalised lines, pigeonhole join, edit-similarity verification.

A line is what stands between newlines. Normalised, it is its words (runs of letters and digits) in
lower case (A-Z), a blank between them. Lines of equal words are one; others link when the edit
similarity of the normalised lines (1 - distance / longer length, in code points) is ``similarity``
or more. Of every connected group the occurrence with the smallest (id, line number) is kept, the
others go.

Candidates: a line's features (its words; pairs of neighbouring bytes where it has few words) are
dealt into shares by their hash, and every share has a SimHash block of 64 bits of its own, in which a
feature has one vote however often it stands there. A word
replaced touches two blocks at most, so lines that differ in few words agree in whole blocks
(pigeonhole), however long the edited word is. The number of shares follows the number of features:
a power of two, about ``WORDS_A_BLOCK`` words each; lines near the step to the next power have both
layouts. The first ``BLOCKS`` shares that hold a feature make blocks. All lines of a block are compared by
length and whole SimHash, then by edit distance. Up to ``CROWD`` lines do so at once. Of a larger crowd
those that stand near in order of the block that follows do, and where many agree in both blocks, with the
first of them, which settles groups of copies in a row each; then all lines of the crowd that are not in
one group yet, in cells of bounded size: no crowd is too large for its pairs to be found.

Lines without a word (blank lines, rules) are always kept. Null texts stay null, a text that loses
all its lines becomes empty; rows are never dropped, and an empty table gives an empty table. Rows
that repeat an id are rows of their own, equal ones too: they are told apart by a row number. Rows
whose id is null are left as they are. Lines of any length count whole. Other columns pass through,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .edit_distance import within_edits
from .storage import batch_rows, cut, rewritten, spare
from .textkernel import chunks, mix64, span_hashes, word_spans

SIMILARITY = 0.9
#: Features of a block, by kind; a line has both kinds of blocks with 11 or 12 words.
WORDS_A_BLOCK, PAIRS_A_BLOCK = 5, 6
#: Shares that make blocks: lines of more shares are found by so many of them as well.
BLOCKS = 6
WORDS_FROM, PAIRS_TO = 11, 12
#: Words longer than this on average (text without blanks) have blocks of byte pairs too.
LONG_WORDS = 20
#: Lines whose length is near the step to the next layout have both: half of what a tenth of the length makes in log2.
STEP = 0.07
#: Whole SimHashes of a link differ in so many of their 120 bits at most.
MAX_BITS = 28
#: Members of a crowd that stand in one cell, where all of them are compared, and how many cells a length may have.
CELL, MOST_CELLS = 16384, 1 << 20
#: Bytes of a normalised line that a cell holds; longer ones are looked up pair by pair. Slots for pairs of letters.
LONG_TEXT, PAIR_SLOTS = 2000, 256
#: Close pairs a line up to which a group lists them.
DENSE = 16
#: Sixteenths of a doubling that lengths of one cell span: more than those of a link do.
BAND = 4
#: Rows and columns of a cell's comparisons that are held at once.
TILE = 128, 1024
#: Rows that one Arrow batch of line pairs holds: lines may be long.
PAIR_ROWS = 500
#: Lines that share a block meet one another at once up to this number; larger crowds meet after their near copies have become groups.
CROWD = 16
#: Keys that a task remembers, so as to describe a line that it meets again once; others are folded later.
REMEMBERED = 1 << 18
#: Bytes of text that a task looks at together, and documents in an Arrow batch.
LINE_BYTES, DOCUMENT_ROWS = 1 << 19, 2000
#: Candidate lines whose documents are looked up by a broadcast of ids (8 MB); more are joined by shuffle.
BROADCAST_IDS = 500_000

_LETTER = np.zeros(256, dtype=bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:256] = True


def _word_values() -> np.ndarray:
    values = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    values[65:91] = values[97:123]
    return values


_VALUES = _word_values()
_TO_NORMAL = bytes(b + 32 if 65 <= b < 91 else b if _LETTER[b] else 32 for b in range(256))
_LOWER = np.frombuffer(_TO_NORMAL, dtype=np.uint8)
_SALTS = (np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E6C63D0876A9A47))
#: Runs up to this length are counted side by side, longer ones by halves of this length.
_SIDE_BY_SIDE = 255


def _counters(features: np.ndarray, begins: np.ndarray, runs: np.ndarray) -> list[np.ndarray]:
    """Per run the number of features with each bit, as bit planes: plane p holds bit p of 64 counters. Runs are sorted, longest first."""
    planes: list[np.ndarray] = []
    alive = np.searchsorted(-runs, -np.arange(int(runs[0])), side="left")  # runs longer than k
    for k, m in enumerate(alive.tolist()):
        carry = features[begins[:m] + k]
        if (k + 1).bit_length() > len(planes):
            planes.append(np.zeros(len(runs), dtype=np.uint64))
        for plane in planes[:-1]:
            both = plane[:m] & carry
            plane[:m] ^= carry
            carry = both
        planes[-1][:m] ^= carry
    return planes


def simhashes(features: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit SimHash of each run of feature hashes: bits that more than half of them have. No run is empty."""
    out = np.empty(len(begins), dtype=np.uint64)
    runs = ends - begins
    order = np.argsort(-runs, kind="stable")
    long = order[: int(np.searchsorted(-runs[order], -_SIDE_BY_SIDE, side="left"))]
    for r in long.tolist():
        votes = np.zeros(64, dtype=np.int64)
        for lo in range(int(begins[r]), int(ends[r]), 1 << 14):
            part = features[lo : min(lo + (1 << 14), int(ends[r]))]
            votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[r] = np.packbits(votes > runs[r] // 2, bitorder="little").view(np.uint64)[0]
    order = order[len(long) :]
    if len(order):
        least = (runs[order] // 2 + 1).astype(np.uint64)
        more, same = np.zeros(len(order), dtype=np.uint64), np.full(len(order), ~np.uint64(0))
        planes = _counters(features, begins[order], runs[order])
        for p in range(len(planes) - 1, -1, -1):
            asked = np.where(least >> np.uint64(p) & np.uint64(1), ~np.uint64(0), np.uint64(0))
            more |= same & planes[p] & ~asked
            same &= ~(planes[p] ^ asked)
        out[order] = more | same
    return out


def sketches(features: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The SimHash of each run of features, as two words."""
    first, second = (simhashes(mix64(features ^ salt), begins, ends) for salt in _SALTS)
    return first, second


def layouts(features: np.ndarray, line: np.ndarray, lines: np.ndarray, level: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """(block names, offsets of each line's names) of ``lines`` in 2 ** ``level`` shares, of which the first ``BLOCKS`` filled ones make blocks.

    ``features`` belong to the lines that ``line`` names, in order; ``lines`` are these lines.
    """
    base = np.append(0, np.cumsum(np.left_shift(1, level)))
    at = np.searchsorted(lines, line)
    # By line and feature, that is by share as well. A feature that repeats has one vote: else a frequent word outvotes
    # all others of its share, and lines meet for that word alone.
    bits = max(len(lines).bit_length(), 1)
    order = np.argsort(at.astype(np.uint64) << np.uint64(64 - bits) | features >> np.uint64(bits))
    at, features = at[order], features[order]
    fresh = np.append(True, (at[1:] != at[:-1]) | (features[1:] != features[:-1]))
    at, features = at[fresh], features[fresh]
    slot = base[at] + (features >> (64 - level[at]).astype(np.uint64)).astype(np.int64)
    begins = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
    ends = np.append(begins[1:], len(slot))
    owner = np.searchsorted(base, slot[begins], side="right") - 1
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    kept = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner)))) < BLOCKS
    begins, ends, owner = begins[kept], ends[kept], owner[kept]
    share = (slot[begins] - base[owner]).astype(np.uint64)
    # Only the features of these blocks have a vote, one run after the other.
    sizes = ends - begins
    starts = np.cumsum(sizes) - sizes
    voters = mix64(features[np.repeat(begins - starts, sizes) + np.arange(sizes.sum())] ^ _SALTS[0])
    blocks = simhashes(voters, starts, starts + sizes)
    names = mix64(blocks ^ mix64(share + (level[owner].astype(np.uint64) << np.uint64(40)) + np.uint64(kind << 50)))
    return names, np.append(0, np.cumsum(np.bincount(owner, minlength=len(lines))))


def _levels(features: np.ndarray, a_block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which lines, their level) for the layouts of lines with so many features: one each, two near a step."""
    exact = np.log2(np.maximum(features, 1) / a_block)
    low, high = (np.maximum(np.round(exact + d), 2).astype(np.int64) for d in (-STEP, STEP))
    yield np.arange(len(features)), low
    both = np.flatnonzero(high > low)
    yield both, high[both]


def _among(lines: np.ndarray, count: int) -> np.ndarray:
    """Which of ``count`` lines are among ``lines``."""
    out = np.zeros(count, dtype=bool)
    out[lines] = True
    return out


def chunk_lines(data: np.ndarray, offsets: np.ndarray, blocks: bool = True) -> tuple:
    """(row, line number, 64-bit key, length, layouts) of every line that has a word.

    Layouts are lists of (line index, SimHash words, names, offsets); none are made without ``blocks``.
    """
    cuts = np.union1d(offsets, np.flatnonzero(data == 10) + 1)
    starts, ends, line = word_spans(data, cuts.astype(np.int64), _LETTER)
    if not len(starts):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, []
    words = span_hashes(data, starts, ends, _VALUES)
    begins = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
    stops = np.append(begins[1:], len(words))
    index = np.repeat(np.arange(len(begins)), stops - begins)
    line = line[begins]
    rows = np.searchsorted(offsets, cuts[line], side="right") - 1
    number = line - np.searchsorted(cuts, offsets[rows])
    # The key adds up word hashes times their place in the line: a second running sum, over words.
    place = (np.arange(len(words)) - begins[index]).astype(np.uint64)
    keys = mix64(np.add.reduceat(mix64(words + place * np.uint64(0xA24BAED4963EE407)), begins))
    length = np.add.reduceat(ends - starts + 1, begins) - 1
    found = []
    if blocks:
        count = stops - begins
        by_words = np.flatnonzero(count >= WORDS_FROM)
        if len(by_words):
            # Blocks from words, the whole SimHash from words in pairs: a word replaced touches two, other lines share few.
            pairs = mix64(words * np.uint64(3) + np.append(words[1:], np.uint64(0)))
            pairs[stops - 1] = mix64(words[stops - 1])
            whole = sketches(pairs, begins, stops)
            for which, level in _levels(count[by_words], WORDS_A_BLOCK):
                lines = by_words[which]
                if len(lines):
                    mine = _among(lines, len(begins))[index]
                    found.append((lines, whole[0][lines], whole[1][lines], *layouts(words[mine], index[mine], lines, level, 1)))
        by_bytes = np.flatnonzero((count <= PAIRS_TO) | (length > LONG_WORDS * count))
        if len(by_bytes):
            mine = np.flatnonzero(_among(by_bytes, len(begins))[index])
            size = ends[mine] - starts[mine]
            owner = np.repeat(index[mine], size)
            first = np.cumsum(size) - size
            at = np.repeat(starts[mine] - first, size) + np.arange(size.sum())
            before = _LOWER[data[np.maximum(at - 1, 0)]].astype(np.uint64)
            before[first] = 32
            pairs = (before << np.uint64(8)) + _LOWER[data[at]] + np.uint64(1 << 32)
            threes = mix64((pairs << np.uint64(8)) + np.append(_LOWER[data[at[1:]]], np.uint8(32)))
            pairs = mix64(pairs)
            runs = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            whole = sketches(threes, runs, np.append(runs[1:], len(owner)))
            letters = np.diff(np.append(runs, len(owner)))
            for which, level in _levels(letters, PAIRS_A_BLOCK):
                lines = by_bytes[which]
                if len(lines):
                    keep = _among(lines, len(begins))[owner]
                    found.append((lines, whole[0][which], whole[1][which], *layouts(pairs[keep], owner[keep], lines, level, 2)))
    return rows, number, keys.view(np.int64), length, found


_LAYOUT = pa.struct([("h1", pa.int64()), ("h2", pa.int64()), ("names", pa.list_(pa.int64()))])


def _layout_lists(length: np.ndarray, found: list) -> pa.Array:
    """Per line its layouts; the low byte of the second word holds the length, in sixteenths of a doubling."""
    scale = np.minimum(np.round(16 * np.log2(length)), 255).astype(np.uint64)
    lines = np.concatenate([f[0] for f in found])
    h1 = np.concatenate([f[1] for f in found])
    h2 = np.concatenate([f[2] for f in found]) & ~np.uint64(255) | scale[lines]
    shift = np.cumsum([0, *(len(f[3]) for f in found)])
    offsets = np.concatenate([f[4][:-1] + s for f, s in zip(found, shift)] + [shift[-1:]])
    names = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([f[3] for f in found]).view(np.int64)))
    rows = pa.StructArray.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), names], names=["h1", "h2", "names"])
    order = np.argsort(lines, kind="stable")
    ends = np.append(0, np.cumsum(np.bincount(lines, minlength=len(length))))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows.take(pa.array(order)))


def line_table(docs: DataFrame) -> DataFrame:
    """(id, row, line, key, layouts) of every line with a word of (id, row, text); layouts are null where the task has given them for the key."""
    names = ["id", "row", "line", "key", "layouts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for batch in batches:
            for lo, data, offsets in chunks(batch.column(2), LINE_BYTES):
                rows, number, keys, length, found = chunk_lines(data, offsets)
                at = pa.array(rows + lo)
                lists = pa.array([], pa.list_(_LAYOUT))
                if len(rows):
                    first = np.zeros(len(keys), dtype=bool)
                    first[np.unique(keys, return_index=True)[1]] = True
                    first &= np.fromiter((k not in known for k in keys.tolist()), bool, len(keys))
                    if len(known) > REMEMBERED:
                        known.clear()
                    known.update(keys[first].tolist())
                    lists = pc.if_else(pa.array(first), _layout_lists(length, found), pa.scalar(None, pa.list_(_LAYOUT)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(number, pa.int64()), pa.array(keys, pa.int64()), lists], names=names)

    return docs.select("id", "row", "text").mapInArrow(run, "id long, row long, line long, key long, layouts array<struct<h1: long, h2: long, names: array<long>>>")


def _close(h1: tuple[np.ndarray, np.ndarray], h2: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether lengths may allow the similarity and whole SimHashes are near."""
    low, top = np.uint64(255), ~np.uint64(255)
    lengths = np.abs((h2[0] & low).astype(np.int64) - (h2[1] & low).astype(np.int64)) <= 3
    return lengths & (np.bitwise_count(h1[0] ^ h1[1]).astype(np.int64) + np.bitwise_count((h2[0] ^ h2[1]) & top) <= MAX_BITS)


def meetings(members: DataFrame) -> DataFrame:
    """(a, b, bucket, h1, h2): close lines (a, b) that stand near one another in a bucket of (bucket, next, id, h1, h2), and every line a of a crowded bucket, with null b.

    Within a bucket, sorted by ``next``, a line meets the ``CROWD`` - 1 after it; where more lines than ``CROWD``
    share ``next`` as well, each meets the first of them. That is all of a bucket's pairs up to ``CROWD`` lines;
    lines of larger ones are handed on, for ``crowd_pairs``. One shuffle and sort by bucket; rows stream by in
    batches, and of an open bucket only the last few rows are held, so any bucket passes in bounded memory.
    Rows that repeat are one.
    """
    fields = ("bucket", "next", "id", "h1", "h2")
    names = ["a", "b", "bucket", "h1", "h2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # the last rows seen
        seen = 0  # how many of them have met those before them already
        head: list[int] | None = None  # the first row of the crowd that the first of them stands in
        waiting: list[np.ndarray] | None = None  # rows of the open bucket while it is small
        large: int | None = None  # the open bucket once it is crowded

        def pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            none = pa.nulls(len(a), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), none, none, none], names=names)

        def near(t: list[np.ndarray], x: np.ndarray, u: list[np.ndarray], y: np.ndarray) -> np.ndarray:
            return _close((t[3][x].view(np.uint64), u[3][y].view(np.uint64)), (t[4][x].view(np.uint64), u[4][y].view(np.uint64)))

        def met(t: list[np.ndarray], heads: list[np.ndarray], many: np.ndarray, done: int, end: int) -> Iterator[pa.RecordBatch]:
            """Meetings whose later row is in done..end."""
            for d in range(1, min(CROWD, len(t[0]))):
                at = np.flatnonzero(t[0][d:end] == t[0][: max(0, end - d)])
                at = at[at + d >= done]
                at = at[near(t, at, t, at + d)]
                yield pairs(t[2][at], t[2][at + d])
            on = np.flatnonzero(many[:end])
            on = on[on >= done]
            on = on[(heads[2][on] != t[2][on]) & near(t, on, heads, on)]
            yield pairs(t[2][on], heads[2][on])

        def crowds(t: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
            """The first row among those with every row's bucket and ``next``, and whether they are many."""
            begins = np.flatnonzero(np.append(True, (t[0][1:] != t[0][:-1]) | (t[1][1:] != t[1][:-1])))
            sizes = np.diff(np.append(begins, len(t[0])))
            heads = [x[np.repeat(begins, sizes)] for x in t]
            if head and head[0] == t[0][0] and head[1] == t[1][0]:
                for x, own in zip(heads, head):
                    x[: sizes[0]] = own
            return heads, np.repeat(sizes > CROWD, sizes)

        for batch in batches:
            t = [batch.column(c).to_numpy() for c in fields]
            if held:
                t = [np.concatenate(x) for x in zip(held, t)]
            if not len(t[0]):
                continue
            fresh = np.append(True, (t[0][1:] != t[0][:-1]) | (t[2][1:] != t[2][:-1]))
            before = len(held[0]) if held else 0
            fresh[:before] = True
            t = [x[fresh] for x in t]
            # All lines of a crowded bucket go on, the first of them once it shows that there are more than ``CROWD``.
            u = [t[c][before:] for c in (0, 2, 3, 4)]
            if waiting:
                u = [np.concatenate(x) for x in zip(waiting, u)]
            if len(u[0]):
                begins = np.flatnonzero(np.append(True, u[0][1:] != u[0][:-1]))
                sizes = np.diff(np.append(begins, len(u[0])))
                crowded = (sizes > CROWD) | ((u[0][begins] == large) if large is not None else False)
                on = np.repeat(crowded, sizes)
                yield pa.RecordBatch.from_arrays([pa.array(u[1][on]), pa.nulls(int(on.sum()), pa.int64()), *(pa.array(u[c][on]) for c in (0, 2, 3))], names=names)
                large, waiting = (int(u[0][-1]), None) if crowded[-1] else (None, [x[begins[-1] :] for x in u])
            # Whether many rows share ``next`` shows once ``CROWD`` + 1 of them are there: the last rows wait.
            last = len(t[0]) - 1
            begin = int(np.searchsorted(t[0], t[0][last]))
            begin += int(np.searchsorted(t[1][begin:], t[1][last]))
            end = len(t[0]) if last - begin >= CROWD else begin
            end = max(end, seen)
            heads, many = crowds(t)
            yield from met(t, heads, many, seen, end)
            keep = max(0, end - CROWD - 1)
            head = [int(x[keep]) for x in heads]
            held, seen = [x[keep:] for x in t], end - keep
        if held:
            yield from met(held, *crowds(held), seen, len(held[0]))

    ordered = members.select(*fields).repartition("bucket").sortWithinPartitions("bucket", "next", "id")
    return cut(ordered.mapInArrow(run, "a long, b long, bucket long, h1 long, h2 long"))


def candidates(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((a, b) of close lines that meet, (bucket, id, h1, h2) of the lines of crowded buckets) of lines (id, layouts), repeats allowed."""
    names = F.col("names")
    following = lambda p: F.xxhash64(F.element_at(names, p + 1), F.element_at(names, (p + 1) % F.size(names) + 1))
    runs = F.transform(F.sequence(F.lit(0), F.size(names) - 1), lambda p: F.struct(F.element_at(names, p + 1).alias("bucket"), following(p).alias("next")))
    layouts_of = lines.select("id", F.explode("layouts").alias("l")).select("id", "l.h1", "l.h2", "l.names")
    met = meetings(layouts_of.select("id", "h1", "h2", F.inline(runs)))
    return met.where("b is not null").select("a", "b").distinct(), met.where("b is null").select("bucket", F.col("a").alias("id"), "h1", "h2")


def _close_rows(x: list[np.ndarray], y: list[np.ndarray], one: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tile by tile the rows of x and y (length, h1, h2; sorted by length) that are close; of ``one`` table each pair once."""
    for lo in range(0, len(x[0]), TILE[0]):
        hi = min(lo + TILE[0], len(x[0]))
        first = int(np.searchsorted(y[0], x[0][lo] - 3))
        last = int(np.searchsorted(y[0], x[0][hi - 1] + 3, side="right"))
        for at in range(max(first, lo) if one else first, last, TILE[1]):
            to = min(at + TILE[1], last)
            bits = np.bitwise_count(x[1][lo:hi, None] ^ y[1][None, at:to])
            bits += np.bitwise_count(x[2][lo:hi, None] ^ y[2][None, at:to])
            i, j = np.divmod(np.flatnonzero(bits <= MAX_BITS), to - at)
            i, j = i + lo, j + at
            right = np.abs(x[0][i] - y[0][j]) <= 3
            if one:
                right &= i < j
            yield i[right], j[right]


def letter_pairs(texts: list[str]) -> np.ndarray:
    """Per text how often pairs of neighbouring characters fall into each of ``PAIR_SLOTS`` slots, up to 255: an edit changes four counts by one at most."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(texts)), sizes)
    within = row[1:] == row[:-1]
    slots = (mix64(points[:-1][within] * np.uint64(1 << 21) + points[1:][within]) % np.uint64(PAIR_SLOTS)).astype(np.int64)
    counts = np.bincount(row[1:][within] * PAIR_SLOTS + slots, minlength=len(texts) * PAIR_SLOTS)
    return np.minimum(counts, 255).astype(np.uint8).reshape(-1, PAIR_SLOTS)


def cell_links(h1: np.ndarray, h2: np.ndarray, component: np.ndarray, texts: list[str | None], sides: list[np.ndarray], similarity: float) -> Iterator[tuple[int, int, bool]]:
    """(row, row, whether verified) of links between the rows of two sides, or of one, that are in different components.

    Verified links that add nothing to those before them are left out. Rows whose text is not there
    give close pairs, all of them and not verified.
    """
    length = (h2 & np.uint64(255)).astype(np.int64)
    root = np.unique(component, return_inverse=True)[1]
    here = np.fromiter((t is not None for t in texts), bool, len(texts))
    size = np.fromiter((len(t or "") for t in texts), np.int64, len(texts))
    grams = letter_pairs([t or "" for t in texts])
    sides = [rows[np.argsort(length[rows], kind="stable")] for rows in sides]
    tables = [[length[r], h1[r], h2[r] & ~np.uint64(255)] for r in sides]
    for i, j in _close_rows(tables[0], tables[-1], len(sides) == 1):
        i, j = sides[0][i], sides[-1][j]
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
        blind = ~(here[i] & here[j])
        for x, y in zip(i[blind].tolist(), j[blind].tolist()):
            yield x, y, False
        i, j = i[~blind], j[~blind]
        for lo in range(0, len(i), 4096):
            x, y = i[lo : lo + 4096], j[lo : lo + 4096]
            most = (np.maximum(size[x], size[y]) * (1 - similarity) + 1e-9).astype(np.int64)
            u, v = grams[x], grams[y]
            may = ((np.maximum(u, v) - np.minimum(u, v)).sum(axis=1, dtype=np.int64) <= 4 * most) & (np.abs(size[x] - size[y]) <= most)
            for p, q, n in zip(x[may].tolist(), y[may].tolist(), most[may].tolist()):
                if root[p] != root[q] and within_edits(texts[p], texts[q], n):
                    root[root == root[p]] = root[q]
                    yield p, q, True


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of the whole groups (bucket, lo, hi) of sorted batches, a group each."""
    held: list[pa.Table] = []  # parts of the open group
    name = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy() for c in ("bucket", "lo", "hi")]
        begins = np.flatnonzero(np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])))
        table = pa.Table.from_batches([batch])
        for begin, end in zip(begins.tolist(), [*begins[1:].tolist(), batch.num_rows]):
            own = tuple(int(k[begin]) for k in keys)
            if held and own != name:
                yield pa.concat_tables(held).combine_chunks()
                held = []
            name = own
            held.append(table.slice(begin, end - begin))
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _sides(table: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(id, h1, h2 and component of a group's rows, the rows of its cell or two cells)."""
    ids, h1, h2, component, cell = (table.column(c).to_numpy() for c in ("id", "h1", "h2", "component", "cell"))
    cells = sorted({table.column(c)[0].as_py() for c in ("lo", "hi")})
    return [ids, h1.view(np.uint64), h2.view(np.uint64), component], [np.flatnonzero(cell == c) for c in cells]


def _sparse_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The close pairs (a, b) of groups that have few of them, and the names (bucket, lo, hi) of the other groups."""
    for table in _groups(batches):
        (ids, h1, h2, component), sides = _sides(table)
        length = (h2 & np.uint64(255)).astype(np.int64)
        sides = [rows[np.argsort(length[rows], kind="stable")] for rows in sides]
        tables = [[length[r], h1[r], h2[r] & ~np.uint64(255)] for r in sides]
        a, b, count = [], [], 0
        for i, j in _close_rows(tables[0], tables[-1], len(sides) == 1):
            i, j = sides[0][i], sides[-1][j]
            apart = component[i] != component[j]
            i, j = ids[i[apart]], ids[j[apart]]
            a.append(np.minimum(i, j))
            b.append(np.maximum(i, j))
            count += len(i)
            if count > DENSE * len(ids):
                break
        if count > DENSE * len(ids):
            none = pa.nulls(1, pa.int64())
            name = [pa.array([table.column(c)[0].as_py()], t) for c, t in (("bucket", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()))]
            yield pa.RecordBatch.from_arrays([none, none, *name], names=["a", "b", "bucket", "lo", "hi"])
        elif count:
            name = [pa.nulls(count, t) for t in (pa.int64(), pa.int32(), pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b)), *name], names=["a", "b", "bucket", "lo", "hi"])


def crowd_links(crowds: DataFrame, labels: DataFrame, words_of: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """(a, b, sure) of close lines of one crowd (bucket, id, h1, h2) that are in different components (id, component) yet.

    Crowds that the links have made one group are done. A crowd beyond ``CELL`` lines is dealt into cells by
    length, and by hash where too many have a length; every cell meets itself and those whose lengths are
    near as a group of its own, so that any crowd passes in bounded memory and no pair is left out. Groups
    with few close pairs list them. Where there are more than ``DENSE`` a line (a template, a group of near copies in
    pieces) they are not listed: such a group gets its lines' texts and gives the links that join components, ``sure`` ones.
    ``words_of`` gives (key, words) of ids; texts beyond ``LONG_TEXT`` bytes stay away, their pairs are not ``sure``.
    """
    members = crowds.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    members = rewritten(members.withColumn("band", F.floor(F.col("h2").bitwiseAND(F.lit(255)) / BAND).cast("int")))
    spread = cut(members.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("bucket", "n"))
    columns = ["id", "h1", "h2", "component"]
    whole = members.join(spread.where(F.col("n") <= CELL), "bucket").select("bucket", F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).alias("cell"), *columns)
    # Crowds beyond a cell are few, with a row for each band: broadcast, so that no crowd is dealt by its name alone.
    big = members.join(F.broadcast(spread.where(F.col("n") > CELL)), "bucket")
    bands = cut(big.groupBy("bucket", "band").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("cells")))
    own = big.join(F.broadcast(bands), ["bucket", "band"]).withColumn("cell", F.col("band") * MOST_CELLS + F.pmod(F.xxhash64("id"), F.col("cells")).cast("int")).drop("cells")
    beside = bands.select("bucket", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), F.col("band").alias("near"), "cells")
    met = own.join(F.broadcast(beside), ["bucket", "band"])
    met = met.withColumn("other", F.explode(F.transform(F.sequence(F.lit(0), F.col("cells") - 1), lambda c: F.col("near") * MOST_CELLS + c)))
    dealt = whole.unionByName(met.select("bucket", F.least("cell", "other").alias("lo"), F.greatest("cell", "other").alias("hi"), "cell", *columns))

    group = ["bucket", "lo", "hi"]
    listed = cut(dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(_sparse_pairs, "a long, b long, bucket long, lo int, hi int"))
    found = listed.where("a is not null").select("a", "b", F.lit(False).alias("sure")).distinct()
    dense = listed.where("a is null").select(*group)
    if not dense.limit(1).count():
        return found
    rest = cut(dealt.join(dense, group))
    words = words_of(rest.select("id").distinct())
    short = words.where(F.octet_length("words") <= LONG_TEXT).select(F.col("key").alias("id"), "words")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            (ids, h1, h2, component), sides = _sides(table)
            rows = [(*sorted((int(ids[x]), int(ids[y]))), sure) for x, y, sure in cell_links(h1, h2, component, table.column("words").to_pylist(), sides, similarity)]
            a, b, sure = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sure, pa.bool_())], names=["a", "b", "sure"])

    ordered = rest.join(short, "id", "left").repartition(*group).sortWithinPartitions(*group)
    return found.unionByName(cut(ordered.mapInArrow(links, "a long, b long, sure boolean")).distinct())


def normalised_lines(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, words) for ``wanted`` (id, row, line, key): the normalised line as text. docs: (id, row, text)."""
    asked = wanted.groupBy("id", "row").agg(F.collect_list(F.struct("line", "key")).alias("lines"))  # a document's lines at most
    ids = wanted.select("id").distinct()
    few = ids.count() <= BROADCAST_IDS
    joined = docs.join(F.broadcast(ids), "id").join(asked, ["id", "row"]) if few else docs.join(asked, ["id", "row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, words = [], []
            for text, lines in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("lines").to_pylist()):
                parts = (text or b"").split(b"\n")
                for x in lines:
                    keys.append(x["key"])
                    words.append(b" ".join(parts[x["line"]].translate(_TO_NORMAL).split()).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(words, pa.string())], names=["key", "words"])

    return joined.select("text", "lines").mapInArrow(run, "key long, words string")


def similar_pairs(pairs: DataFrame, similarity: float) -> DataFrame:
    """The (a, b) of (a, b, x, y) whose texts x and y have the edit similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stay = []
            sizes = [pc.fill_null(pc.utf8_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3)]
            most = (np.maximum(*sizes) * (1 - similarity) + 1e-9).astype(np.int64)
            may = np.abs(sizes[0] - sizes[1]) <= most
            near = np.flatnonzero(may & (np.maximum(*sizes) <= LONG_TEXT))
            u, v = (letter_pairs(batch.column(c).take(pa.array(near)).to_pylist()) for c in (2, 3))
            may[near] = (np.maximum(u, v) - np.minimum(u, v)).sum(axis=1, dtype=np.int64) <= 4 * most[near]
            for i, n in enumerate(most.tolist()):  # row by row: lines may be long
                stay.append(bool(may[i]) and within_edits(batch.column(2)[i].as_py(), batch.column(3)[i].as_py(), n))
            yield batch.filter(pa.array(stay, pa.bool_())).select(["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def _numbered(df: DataFrame, id_col: str, text_col: str, row: str = "__row") -> tuple[DataFrame, DataFrame]:
    """(``df`` with its row number, (id, row, text) of its rows with an id): numbers are 0 unless ids repeat."""
    repeats = df.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    # Written before it is numbered: the same rows get the same numbers whenever they are read.
    rows = cut(df).withColumn(row, F.monotonically_increasing_id()) if repeats else df.withColumn(row, F.lit(0).cast("long"))
    return rows, rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(row).alias("row"), F.col(text_col).cast("string").alias("text"))


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component) of components that links (a, b) join further; ends without a component are one each."""
    ends = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct()
    every = cut(ends.join(labels, "id", "full").withColumn("component", F.coalesce("component", "id")))
    of = lambda c: every.select(F.col("id").alias(c), F.col("component").alias(f"of_{c}"))
    roots = connected_components(links.join(of("a"), "a").join(of("b"), "b"), "of_a", "of_b")
    return cut(every.join(roots.select(F.col("id").alias("component"), F.col("component").alias("root")), "component", "left").select("id", F.coalesce("root", "component").alias("component")))


def _marked(docs: DataFrame, similarity: float) -> DataFrame:
    """(id, row, line, first, kept) for every line with a word of (id, row, text); ``first``: struct of id, row and line."""
    with batch_rows(docs.sparkSession, DOCUMENT_ROWS):
        lines = rewritten(line_table(docs))
    pairs, crowds = candidates(lines.where("layouts is not null").select(F.col("key").alias("id"), "layouts"))
    pairs = cut(pairs)
    ends = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).unionByName(crowds.select(F.col("id").alias("key")))
    # Most lines stand once and meet none: only the others' first occurrences are looked for.
    repeated = lines.groupBy("key").agg(F.count(F.lit(1)).alias("seen")).where("seen > 1").select("key")
    asked = cut(ends.unionByName(repeated).distinct())
    own = F.struct("id", "row", "line")
    distinct = cut(lines.select("id", "row", "line", "key").join(asked, "key").groupBy(F.col("key").alias("id")).agg(F.min(own).alias("first")))

    def words_of(ids: DataFrame) -> DataFrame:
        wanted = cut(distinct.join(ids, "id").select("first.*", F.col("id").alias("key")))
        with batch_rows(docs.sparkSession, DOCUMENT_ROWS):
            return cut(normalised_lines(docs, wanted))

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs.select("a", "b"))
        if not pairs.limit(1).count():
            return pairs
        words = words_of(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
        both = pairs.join(words.select(F.col("key").alias("a"), F.col("words").alias("x")), "a").join(words.select(F.col("key").alias("b"), F.col("words").alias("y")), "b")
        with batch_rows(docs.sparkSession, PAIR_ROWS):
            return cut(similar_pairs(both.select("a", "b", "x", "y"), similarity))

    labels = connected_components(verify(pairs))
    if crowds.limit(1).count():
        with batch_rows(docs.sparkSession, DOCUMENT_ROWS):
            met = crowd_links(crowds, labels, words_of, similarity)
        more = met.where("sure").select("a", "b").unionByName(verify(met.where("not sure")))
        if more.limit(1).count():
            labels = _joined(labels, more)
    heads = distinct.join(labels, "id", "left")
    groups = heads.where("component is not null").groupBy("component").agg(F.min("first").alias("group_first"))
    heads = heads.join(groups, "component", "left").select(F.col("id").alias("key"), F.coalesce("group_first", "first").alias("first"))
    out = lines.select("id", "row", "line", "key").join(heads, "key", "left").withColumn("first", F.coalesce("first", own))
    return out.select("id", "row", "line", "first", (F.col("first") == own).alias("kept"))


def mark_lines(df: DataFrame, id_col: str, text_col: str, similarity: float = SIMILARITY) -> DataFrame:
    """(id, line, first_id, first_line, kept) for every line with a word of rows with an id."""
    out = _marked(_numbered(df, id_col, text_col)[1], similarity)
    return out.select(F.col("id").alias(id_col), F.col("line"), F.col("first.id").alias("first_id"), F.col("first.line").alias("first_line"), "kept")


def dedup_lines(df: DataFrame, id_col: str, text_col: str, similarity: float = SIMILARITY) -> DataFrame:
    """``df`` without the lines that ``mark_lines`` doesn't keep; all rows and other columns stay."""
    row, own, at, gone = spare(df, "__row", "__id", "__at", "__gone")
    rows, docs = _numbered(df, id_col, text_col, row)
    drop = _marked(docs, similarity).where("not kept")
    dropped = drop.groupBy(F.col("id").alias(own), F.col("row").alias(at)).agg(F.collect_list("line").alias(gone))  # a document's lines at most

    @F.pandas_udf("string")
    def without(texts: pd.Series, lists: pd.Series) -> pd.Series:
        def left(text: str, lines: np.ndarray) -> str:
            out = set(lines.tolist())
            return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in out)

        return pd.Series([left(t, g) for t, g in zip(texts, lists)], dtype=object)

    joined = rows.join(dropped, (F.col(id_col) == F.col(own)) & (F.col(row) == F.col(at)), "left")
    touched, same = joined.where(F.col(gone).isNotNull()), joined.where(F.col(gone).isNull())
    return touched.withColumn(text_col, without(F.col(text_col).cast("string"), F.col(gone))).select(*df.columns).unionByName(same.select(*df.columns))


def op1_simhash_line_dedup(documents: DataFrame) -> DataFrame:
    """What becomes of every line (with a word) of ``documents``; one row per line."""
    return mark_lines(documents, "doc_id", "text").withColumnRenamed("first_id", "group_doc_id").withColumnRenamed("first_line", "group_line")
