"""Buckets that more than one member shares."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .storage import cut

#: Buckets up to this size are looked through at once; members of larger ones all stay.
SMALL = 128


def _staying(bucket: np.ndarray, hashes: np.ndarray | None, max_bits: int) -> np.ndarray:
    """Which rows of whole, sorted buckets have a fellow (within ``max_bits`` of their hash, in small buckets)."""
    stay = np.zeros(len(bucket), dtype=bool)
    for d in range(1, SMALL if hashes is not None else 2):
        same = bucket[d:] == bucket[:-d]
        if not same.any():
            break
        if hashes is not None:
            same &= np.bitwise_count(hashes[d:] ^ hashes[:-d]) <= max_bits
        stay[d:] |= same
        stay[:-d] |= same
    if hashes is not None and len(bucket) > SMALL:
        far = np.flatnonzero(bucket[SMALL:] == bucket[:-SMALL])
        if len(far):
            stay |= np.isin(bucket, np.unique(bucket[far]))
    return stay


def crowded(members: DataFrame, max_bits: int | None = None) -> DataFrame:
    """The rows (bucket, id) of ``members`` whose bucket holds two rows or more.

    With ``max_bits``, members have a 64-bit ``hash``, and rows of small buckets also need a fellow
    whose hash differs in so many bits at most. One shuffle and sort by bucket; rows stream by in
    batches, and of an open bucket only the first few rows are held, so any bucket passes in bounded
    memory.
    """
    columns = ["bucket", "id", *(["hash"] if max_bits is not None else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large = None, None

        def pick(table: pa.Table) -> pa.Table:
            bucket = table.column("bucket").to_numpy()
            hashes = table.column("hash").to_numpy().view(np.uint64) if max_bits is not None else None
            stay = _staying(bucket, hashes, max_bits or 0)
            if large is not None:
                stay |= bucket == large
            return table.filter(pa.array(stay)).select(["bucket", "id"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]).combine_chunks() if held is not None and held.num_rows else table
            bucket = table.column("bucket").to_numpy()
            last = bucket[-1]
            begin = int(np.searchsorted(bucket, last))
            if large == last or len(bucket) - begin > SMALL:
                # The open bucket is large already: its rows stay, those to come as well.
                yield from pick(table).to_batches()
                large, held = last, None
            else:
                yield from pick(table.slice(0, begin)).to_batches()
                held = table.slice(begin)
        if held is not None and held.num_rows:
            yield from pick(held).to_batches()

    ordered = members.where("bucket is not null").select(*columns).repartition("bucket").sortWithinPartitions("bucket")
    return cut(ordered.mapInArrow(run, "bucket long, id long"))
