"""MinHash near-dedup with odd sketches.

A document's set is its distinct word shingles. Equal sets are folded into one representative first.
Each representative gets ``SAMPLES`` MinHash values: bands of them name the buckets that propose
candidates, and all of them are folded into a parity bitmap (an odd sketch). The population count
of two bitmaps' XOR estimates high similarities closely, so that only likely pairs are confirmed on
the full sets. Confirmed links connect representatives; components are labelled with their
smallest id.

Link: intersection / union of the sets >= threshold, on 64-bit shingle hashes. Sets that are empty
(null texts, texts without a word) link with nothing. Rows that repeat an id are one document for
the purpose of linking. Rows whose id is null link with nothing, have a null component and are kept.
Texts of any length are read whole; an empty table gives no rows. Other columns are left out, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .buckets import crowded
from .components import connected_components, link_buckets
from .storage import cut
from .textkernel import chunks, mix64, shingle_sets

SAMPLES = 128
#: A pair at similarity 0.85 misses every band with probability below 1e-5, one at 0.8 below 3e-4.
BANDS, BAND_ROWS = 20, 5
SKETCH_BITS = 512
#: Bits of the parity bitmap of a whole set.
PARITY_BITS = 2048
#: Sets whose bits are counted together: 16 KB a set, and texts may be short.
SETS_AT_ONCE = 1024
#: Standard deviations of the estimate that the sketch filter leaves below the threshold.
SLACK = 5.0

_A = mix64(np.arange(1, SAMPLES + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
_B = mix64(np.arange(SAMPLES + 1, 2 * SAMPLES + 1, dtype=np.uint64)).astype(np.uint32)
_SAMPLE_SALT = mix64(np.arange(1, SAMPLES + 1, dtype=np.uint64) << np.uint64(33))


def minhashes(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """(sets, SAMPLES) minima of hashed ``values``; a set starts at each of ``begins``, none is empty."""
    x = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(begins), SAMPLES), dtype=np.uint32)
    y, z = np.empty_like(x), np.empty_like(x)
    for j in range(SAMPLES):
        np.multiply(x, _A[j], out=y)
        np.add(y, _B[j], out=y)
        np.right_shift(y, np.uint32(15), out=z)
        np.bitwise_xor(y, z, out=y)
        np.multiply(y, np.uint32(0x2C1B3C6D), out=y)
        out[:, j] = np.minimum.reduceat(y, begins)
    return out


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """(sets, SKETCH_BITS / 64) words: every (sample, value) flips one bit."""
    if len(samples) > SETS_AT_ONCE:
        return np.concatenate([odd_sketches(samples[lo : lo + SETS_AT_ONCE]) for lo in range(0, len(samples), SETS_AT_ONCE)])
    at = mix64(samples.astype(np.uint64) ^ _SAMPLE_SALT) % np.uint64(SKETCH_BITS)
    n = len(samples)
    flips = np.bincount((np.arange(n)[:, None] * SKETCH_BITS + at.astype(np.int64)).ravel(), minlength=n * SKETCH_BITS)
    bits = np.packbits((flips & 1).astype(np.uint8).reshape(n, SKETCH_BITS), axis=1)
    return bits.view(np.int64).reshape(n, SKETCH_BITS // 64)


def band_keys(samples: np.ndarray) -> np.ndarray:
    """(sets, BANDS) 64-bit bucket names."""
    keys = np.zeros((len(samples), BANDS), dtype=np.uint64)
    for b in range(BANDS):
        h = np.full(len(samples), b + 1, dtype=np.uint64)
        for r in range(BAND_ROWS):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + samples[:, b * BAND_ROWS + r])
        keys[:, b] = h
    return keys.view(np.int64)


def max_odd_bits(threshold: float) -> int:
    """The XOR population count that a pair at ``threshold`` exceeds only ``SLACK`` deviations out."""
    floor = max(0.0, threshold - SLACK * np.sqrt(threshold * (1 - threshold) / SAMPLES))
    return int(np.ceil(SKETCH_BITS / 2 * (1 - np.exp(-4 * SAMPLES * (1 - floor) / SKETCH_BITS))))


def estimated_similarity(odd_bits: Column) -> Column:
    """Jaccard similarity from the XOR population count of two sketches."""
    return 1 + F.log(F.greatest(1 - 2 * odd_bits / SKETCH_BITS, F.lit(1e-6))) * SKETCH_BITS / (4 * SAMPLES)


def fingerprints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that name each (non-empty) set."""
    if not sets:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    values = np.concatenate(sets)
    begins = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    other = mix64(values ^ np.uint64(0x5851F42D4C957F2D))
    return np.add.reduceat(mix64(values), begins).view(np.int64), np.add.reduceat(other, begins).view(np.int64)


def parity_bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, PARITY_BITS / 64) words: every element flips one bit, so an XOR counts differing elements from below."""
    n = len(sets)
    if not n:
        return np.zeros((0, PARITY_BITS // 64), dtype=np.int64)
    if n > SETS_AT_ONCE:
        return np.concatenate([parity_bitmaps(sets[lo : lo + SETS_AT_ONCE]) for lo in range(0, n, SETS_AT_ONCE)])
    at = (np.concatenate(sets) % np.uint64(PARITY_BITS)).astype(np.int64) + np.repeat(np.arange(n) * PARITY_BITS, [len(s) for s in sets])
    flips = np.bincount(at, minlength=n * PARITY_BITS)
    return np.packbits((flips & 1).astype(np.uint8).reshape(n, PARITY_BITS), axis=1).view(np.int64)


_SIGNATURE = "id long, n_shingles long, set_hi long, set_lo long, bands array<long>, sketch array<long>"


def signatures(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Per row its set's size, 128-bit fingerprint, band keys and odd sketch; all but the size null for empty sets."""
    longs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, data, offsets in chunks(batch.column(1)):
                sets = shingle_sets(data, offsets, width)
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                full = np.flatnonzero(sizes)
                hi, lo_, bands, sketch = (np.zeros(len(sets), dtype=object) for _ in range(4))
                for column in (hi, lo_, bands, sketch):
                    column[:] = None
                if len(full):
                    values = np.concatenate([sets[i] for i in full])
                    begins = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                    samples = minhashes(values, begins)
                    first, second = fingerprints([sets[i] for i in full])
                    keys, odd = band_keys(samples), odd_sketches(samples)
                    for k, i in enumerate(full.tolist()):
                        hi[i], lo_[i], bands[i], sketch[i] = int(first[k]), int(second[k]), keys[k], odd[k]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, len(sets)), pa.array(sizes), pa.array(hi.tolist(), pa.int64()), pa.array(lo_.tolist(), pa.int64()), pa.array(bands.tolist(), longs), pa.array(sketch.tolist(), longs)],
                    names=["id", "n_shingles", "set_hi", "set_lo", "bands", "sketch"],
                )

    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, _SIGNATURE)


def full_sets(df: DataFrame, width: int) -> DataFrame:
    """(id, set_hi, set_lo, items, parity) of (id, text) rows: fingerprint, distinct shingle hashes and their parity bitmap.

    Empty sets are left out.
    """
    ddl = "id long, set_hi long, set_lo long, items array<long>, parity array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, data, offsets in chunks(batch.column(1)):
                sets = shingle_sets(data, offsets, width)
                full = [i for i, s in enumerate(sets) if len(s)]
                hi, low = fingerprints([sets[i] for i in full])
                ids = batch.column(0).slice(lo, len(sets)).take(pa.array(full, pa.int64()))
                items = pa.array([sets[i].view(np.int64) for i in full], pa.list_(pa.int64()))
                parity = pa.array(list(parity_bitmaps([sets[i] for i in full])), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(hi), pa.array(low), items, parity], names=["id", "set_hi", "set_lo", "items", "parity"])

    return df.select("id", "text").mapInArrow(run, ddl)


def near_duplicates(df: DataFrame, id_col: str, text_col: str, width: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``df``; linked where 100 * common >= percent * union."""
    marked = cut(signatures(df, id_col, text_col, width))
    held = marked.where("id is not null and n_shingles > 0")
    groups = cut(held.groupBy("set_hi", "set_lo").agg(F.min("id").alias("rep")))
    # A row of its own set per representative: ids may repeat with other texts.
    reps = held.join(groups, ["set_hi", "set_lo"]).where("id = rep").dropDuplicates(["set_hi", "set_lo"])
    reps = reps.select(F.xxhash64("set_hi", "set_lo", "id").alias("key"), "id", "set_hi", "set_lo", "n_shingles", "bands", "sketch")
    features = reps.select(F.col("key").alias("id"), "sketch", F.col("n_shingles").alias("n"))
    members = crowded(reps.select(F.explode("bands").alias("bucket"), F.col("key").alias("id")))
    most = max_odd_bits(percent / 100)

    def near(x: str, y: str) -> Column:
        odd = reduce(add, [F.bit_count(F.col(f"{x}.sketch")[i].bitwiseXOR(F.col(f"{y}.sketch")[i])) for i in range(SKETCH_BITS // 64)])
        sizes = F.least(f"{x}.n", f"{y}.n") * 100 >= F.greatest(f"{x}.n", f"{y}.n") * percent
        return sizes & (odd <= most)

    def last(x: str, y: str) -> Column:
        # The bitmaps of whole sets differ in no more bits than the sets do in elements: an exact bound.
        differ = reduce(add, [F.bit_count(F.col(f"{x}.parity")[i].bitwiseXOR(F.col(f"{y}.parity")[i])) for i in range(PARITY_BITS // 64)])
        bound = differ * (100 + percent) <= (F.col(f"{x}.n") + F.col(f"{y}.n")) * (100 - percent)
        # Two sets may share many bands; their pair is made in the first of them alone.
        shared = F.coalesce(*[F.when(F.col(f"{x}.bands")[i] == F.col(f"{y}.bands")[i], F.col(f"{x}.bands")[i]) for i in range(BANDS)])
        return near(x, y) & bound & (shared == F.col(f"{x}.bucket"))

    def narrow(ids: DataFrame) -> DataFrame:
        return sets.join(ids, "id").select("id", "parity", "bands")

    asked = reps.select("key", "id", "set_hi", "set_lo", "bands").join(members.select(F.col("id").alias("key")).distinct(), "key")
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sets = full_sets(texts.join(asked.select("id").distinct(), "id"), width).join(asked, ["id", "set_hi", "set_lo"])
    sets = cut(sets.dropDuplicates(["key"]).select(F.col("key").alias("id"), "items", "parity", "bands"))

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("xs")), "a").join(sets.select(F.col("id").alias("b"), F.col("items").alias("ys")), "b")
        common = F.size(F.array_intersect("xs", "ys"))
        return both.where(100 * common >= percent * (F.size("xs") + F.size("ys") - common)).select("a", "b")

    links = link_buckets(members, features, near, verify, narrow=narrow, last=last)
    docs = reps.select("key", "id")
    ends = links.join(docs.select(F.col("key").alias("a"), F.col("id").alias("x")), "a").join(docs.select(F.col("key").alias("b"), F.col("id").alias("y")), "b")
    same = held.join(groups, ["set_hi", "set_lo"]).where("id <> rep").select(F.col("rep").alias("x"), F.col("id").alias("y"))
    labels = connected_components(ends.select("x", "y").unionByName(same), "x", "y")
    out = marked.join(labels, "id", "left").select(
        F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def op2_odd_sketch_near_dedup(documents: DataFrame) -> DataFrame:
    """Near duplicates among ``documents``: 3-word shingles, linked from 85 in 100 on; one row per row."""
    return near_duplicates(documents, "doc_id", "text", width=3, percent=85)
