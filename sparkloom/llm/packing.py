"""Packing: tokenised documents cut and packed into fixed-length sequences by cutting-stock column generation.

Spark tokenises, cuts and ranks the pieces; the driver only sees the histogram of piece lengths
(one count per length class, whatever the corpus holds) and solves the cutting-stock linear program
over patterns of that histogram. Knapsack dynamic programming prices new columns; the solution is
rounded down, a first-fit pass over the few left-over counts completes it, and every piece finds
its sequence from its rank among the pieces of its class.

Null and empty texts are one end token. Rows that repeat a ``doc_id``, or have none, are packed row by
row, and ranked in blocks dealt by row, so that a frequent id is no single task's work. Long texts are
encoded whole and cut every ``capacity`` tokens; pieces of equal length are told apart by id and place
alone. An empty table gives no rows. Other columns are left out, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut
from .textkernel import CHUNK_BYTES, chunks, span_hashes, word_spans

CAPACITY = 2048
CLASS_WIDTH = 16
END_ID = 1
CACHE_WORDS = 1_200_000
RANK_BLOCK = 8192

_PIECES_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_CLOSING, _ALNUM = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_CLOSING[[ord(c) for c in ".,;:!?"]] = True
#: A digit is always a pre-token, and so a token, of its own.
_SEPARATOR = b"0"
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = True


class WordEncoder:
    """Token ids of whole texts, a chunk of texts at a time.

    The vocabulary's pre-tokens never cross white space, nor join a letter or digit to closing
    punctuation, so distinct words are encoded once and remembered by their 64-bit hash (the table
    starts afresh when full); a text that may hold a special token is encoded whole.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.encode_batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.cache_words = cache_words
        self.separator = self._ids([_SEPARATOR.decode()])[0][0]
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, dtype=np.uint64)
        self.begin = self.length = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype="<u4")

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        if len(self.known) + len(words) > self.cache_words:
            self._forget()
        apart = np.array([_SEPARATOR in w or b"<|" in w for w in words], dtype=bool)
        lone = [w for w, alone in zip(words, apart.tolist()) if alone]
        order = np.argsort(apart, kind="stable")
        hashes = hashes[order]
        joined = (b" " + _SEPARATOR + b" ").join([w for w, alone in zip(words, apart.tolist()) if not alone] + [b""])
        ids = self._ids([joined.decode("utf-8", "replace")])[0]
        marks = np.flatnonzero(ids == self.separator)
        length = np.diff(marks, prepend=-1) - 1
        rest = self._ids([w.decode("utf-8", "replace") for w in lone])
        length = np.concatenate([length, np.array([len(x) for x in rest], dtype=np.int64)])
        begin = len(self.flat) + np.cumsum(length) - length
        self.flat = np.concatenate([self.flat, ids[ids != self.separator], *rest])
        order = np.argsort(np.concatenate([self.known, hashes]), kind="stable")
        self.known = np.concatenate([self.known, hashes])[order]
        self.begin = np.concatenate([self.begin, begin])[order]
        self.length = np.concatenate([self.length, length])[order]

    def _lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.known, hashes), max(0, len(self.known) - 1))
        return at, self.known[at] == hashes if len(self.known) else np.zeros(len(hashes), dtype=bool)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        """The ids of each text of a chunk."""
        starts, ends, rows = word_spans(data, offsets)
        last = np.maximum.accumulate(np.where(_CLOSING[data], -1, np.arange(len(data)))) if len(data) else np.zeros(0, dtype=np.int64)
        core = last[ends - 1] + 1
        split = np.flatnonzero((core < ends) & (core > starts))
        split = split[_ALNUM[data[core[split] - 1]]]
        at = np.concatenate([starts, core[split]])
        order = np.argsort(at, kind="stable")
        to = np.concatenate([ends, ends[split]])
        to[split] = core[split]
        starts, ends, rows = at[order], to[order], np.concatenate([rows, rows[split]])[order]
        hashes, first, back = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        _, have = self._lookup(hashes)
        if not have.all():
            if len(self.known) + len(hashes) > self.cache_words:
                have[:] = False
                self._forget()
            lack = np.flatnonzero(~have)
            self._learn(hashes[lack], [data[s:e].tobytes() for s, e in zip(starts[first[lack]].tolist(), ends[first[lack]].tolist())])
        at, _ = self._lookup(hashes)
        begin, length = (self.begin[at][back], self.length[at][back]) if len(hashes) else (np.zeros(0, dtype=np.int64),) * 2
        total = np.concatenate([[0], np.cumsum(length)])
        tokens = self.flat[np.repeat(begin - total[:-1], length) + np.arange(total[-1])]
        bounds = total[np.searchsorted(rows, np.arange(len(offsets)))]
        raw = data.tobytes()
        special = b"<|" in raw
        for i in range(len(offsets) - 1):
            text = raw[offsets[i] : offsets[i + 1]] if special else b""
            yield self._ids([text.decode("utf-8", "replace")])[0] if b"<|" in text else tokens[bounds[i] : bounds[i + 1]]


_ENCODERS: dict[str, WordEncoder] = {}


def tokenised_pieces(df: DataFrame, id_col: str, text_col: str, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Each document's ids and end id, cut every ``capacity`` ids: (doc_id, start, length, ids_crc32, doc_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(tokenizer_path) or _ENCODERS.setdefault(tokenizer_path, WordEncoder(tokenizer_path))
        end = np.array([END_ID], dtype="<u4")
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, data, offsets in chunks(batch.column(1), 2 * CHUNK_BYTES):
                rows = []
                for i, tokens in enumerate(encoder.encode(data, offsets), lo):
                    whole = np.append(tokens, end).astype("<u4", copy=False).tobytes()
                    n = len(whole) // 4
                    for at in range(0, n, capacity):
                        piece = whole[4 * at : 4 * (at + capacity)]
                        rows.append((ids[i], at, len(piece) // 4, zlib.crc32(piece), n))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, _PIECES_DDL)


def price_pattern(values: np.ndarray, units: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable pattern of classes 1..units whose sizes add up to ``units`` at most."""
    best, choice = np.zeros(units + 1), np.zeros(units + 1, dtype=np.int64)
    for v in range(1, units + 1):
        gains = best[v - 1 :: -1][: len(values)] + values[:v]
        c = int(np.argmax(gains))
        if gains[c] > best[v - 1]:
            best[v], choice[v] = gains[c], c + 1
        else:
            best[v] = best[v - 1]
    pattern, v = np.zeros(units), units
    while v > 0:
        if choice[v]:
            pattern[choice[v] - 1] += 1
            v -= choice[v]
        else:
            v -= 1
    return float(best[units]), pattern


def cutting_patterns(counts: np.ndarray, max_steps: int = 4000) -> list[tuple[int, np.ndarray]]:
    """(times, pattern) that hold each class c (size c + 1 of len(counts) units) exactly ``counts[c]`` times.

    Revised simplex over the classes present; its columns come from ``price_pattern``. Stopping
    early leaves a feasible, slightly longer solution.
    """
    units = len(counts)
    present = np.flatnonzero(counts)
    if not len(present):
        return []
    need = counts[present].astype(float)
    basis = np.zeros((len(present), len(present)))
    full = units // (present + 1)
    basis[np.arange(len(present)), np.arange(len(present))] = full
    inverse, x = np.diag(1.0 / full), need / full
    for _ in range(max_steps):
        duals = inverse.sum(axis=0)
        values = np.zeros(units)
        values[present] = np.maximum(duals, 0)
        worth, pattern = price_pattern(values, units)
        column = pattern[present]
        if worth <= 1 + 1e-7:
            break
        direction = inverse @ column
        usable = direction > 1e-9
        if not usable.any():
            break
        ratios = np.full(len(present), np.inf)
        ratios[usable] = x[usable] / direction[usable]
        out = int(np.argmin(ratios))
        step = max(ratios[out], 0.0)
        x = x - step * direction
        x[out] = step
        row = inverse[out] / direction[out]
        inverse -= np.outer(direction, row)
        inverse[out] = row
        basis[:, out] = column
    left = counts.astype(np.int64).copy()
    result: list[tuple[int, np.ndarray]] = []
    for j in np.argsort(-x):
        pattern = np.zeros(units, dtype=np.int64)
        pattern[present] = np.rint(basis[:, j]).astype(np.int64)
        used = pattern > 0
        times = min(int(x[j] + 1e-6), int((left[used] // pattern[used]).min()) if used.any() else 0)
        if times > 0:
            left -= times * pattern
            result.append((times, pattern))
    return result + _first_fit(left)


def _first_fit(left: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Largest first over the counts that rounding left; equal sequences are taken together."""
    units, out, left = len(left), [], left.copy()
    while left.any():
        pattern, room = np.zeros(units, dtype=np.int64), units
        for c in range(units - 1, -1, -1):
            n = min(int(left[c]), room // (c + 1))
            pattern[c] = n
            room -= n * (c + 1)
        used = pattern > 0
        times = int((left[used] // pattern[used]).min())
        left -= times * pattern
        out.append((times, pattern))
    return out


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, class_width: int = CLASS_WIDTH) -> DataFrame:
    """Adds sequence_id and offset to pieces of 1..``capacity`` tokens."""
    spark = pieces.sparkSession
    pieces = cut(pieces.withColumn("class", F.ceil(F.col("length") / class_width).cast("int")))
    units = -(-capacity // class_width)
    counts = np.zeros(units, dtype=np.int64)
    for row in pieces.groupBy("class").count().collect():  # at most ``units`` rows
        counts[row["class"] - 1] = row["count"]
    taken, slots, first = np.zeros(units, dtype=np.int64), [], 0
    for times, pattern in cutting_patterns(counts):
        for c in np.flatnonzero(pattern).tolist():
            slots.append((c + 1, int(taken[c]), int(taken[c] + times * pattern[c]), int(pattern[c]), first))
            taken[c] += times * pattern[c]
        first += times
    blocks = int(counts.sum()) // RANK_BLOCK + 1
    # The pieces are written: the same rows get the same numbers whenever they are read.
    dealt = pieces.withColumn("row", F.monotonically_increasing_id()).withColumn("block", F.pmod(F.xxhash64("doc_id", "start", "row"), F.lit(blocks)))
    before = Window.partitionBy("class").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("class", "block").agg(F.count(F.lit(1)).alias("n")).select(
        "class", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    within = Window.partitionBy("class", "block").orderBy("doc_id", "start", "ids_crc32", "doc_tokens", "row")
    ranked = dealt.withColumn("rank", F.row_number().over(within) - 1).join(offsets, ["class", "block"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("base"))
    table = spark.createDataFrame(slots, "class int, lo long, hi long, copies long, first long")
    placed = ranked.join(F.broadcast(table), "class").where("rank >= lo and rank < hi")  # bounded: patterns x classes
    placed = placed.withColumn("sequence_id", F.expr("first + (rank - lo) div copies"))
    inside = Window.partitionBy("sequence_id").orderBy(F.col("class").desc(), "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset")
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_cutting_stock_packing(documents: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """All ``documents`` packed into sequences of at most 2048 tokens; one row per piece."""
    return pack_pieces(tokenised_pieces(documents, "doc_id", "text", tokenizer_path or default_tokenizer()))
