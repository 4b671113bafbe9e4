"""Embedding near-dedup by spherical-cap filters.

A structured random product code gives the filter directions: the rotated space is split into
blocks, each block has its own random unit vectors, and a direction is one choice per block. List
decoding finds, for every vector, all directions whose cap it lies in, without visiting the others:
all caps of a code have one height, at which a vector lies in ``CAPS`` of them on average. Vectors
that share a cap are compared exactly, in double precision, cell by cell: crowded caps are dealt into
pairs of small blocks, so that no task ever holds a whole group. Cells give counts and a tree of
links, never all links of a dense group; a pair counts in the first cap it shares alone. Equal
vectors are folded into one first, so groups of copies cost one comparison.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and
only vectors of one dimension are compared. Rows that repeat an id are one vector for linking. Rows
whose id is null link with nothing, have a null component and are kept. An empty table gives no
rows. Other columns, labels among them, are left out, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import cut

#: Codes of two blocks, and how many caps of each a vector lies in on average; see ``code_draws`` for more blocks.
DRAWS, CAPS = 2, 20
#: A vector in fewer caps than this gets lower ones of its own, so that none is left out.
LEAST_CAPS = 10
MAX_BLOCK_CODES = 4096
CELL = 1024
_CODE_SEED, _TRIAL = 20_250_101, 400


class ProductCode:
    """Filter directions for vectors of ``dim`` components; ``draw`` tells codes of one shape apart."""

    def __init__(self, dim: int, blocks: int, codes: int, draw: int) -> None:
        rng = np.random.default_rng([_CODE_SEED, dim, blocks, codes, draw])
        self.rotation, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
        self.cuts = np.linspace(0, dim, min(blocks, dim) + 1).astype(int)
        self.codes = []
        for lo, hi in zip(self.cuts[:-1], self.cuts[1:]):
            c = rng.standard_normal((hi - lo, codes))
            self.codes.append(c / np.linalg.norm(c, axis=0) * math.sqrt((hi - lo) / dim))
        self._heights: dict[float, float] = {}

    def _above(self, scores: list[np.ndarray], best: list[np.ndarray], rows: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, score, direction) of all directions of ``rows`` that score ``least`` or more; partial sums that can't are dropped."""
        partial, name, need = np.zeros(len(rows)), np.zeros(len(rows), dtype=np.int64), np.zeros(len(best[0]))
        need[rows] = least
        for k, s in enumerate(scores):
            bound = need - sum(best[k + 1 :], np.zeros(len(need)))
            found = [], [], []
            for lo in range(0, len(rows), 256):
                at = rows[lo : lo + 256]
                total = partial[lo : lo + 256, None] + s[at]
                i, j = np.nonzero(total >= bound[at][:, None])
                found[0].append(at[i])
                found[1].append(total[i, j])
                found[2].append(name[lo : lo + 256][i] * s.shape[1] + j)
            if not found[0]:
                return rows[:0], partial[:0], name[:0]
            rows, partial, name = (np.concatenate(f) for f in found)
        return rows, partial, name

    def _scores(self, vectors: np.ndarray) -> list[np.ndarray]:
        turned = vectors @ self.rotation
        return [turned[:, lo:hi] @ c for lo, hi, c in zip(self.cuts[:-1], self.cuts[1:], self.codes)]

    def height(self, caps: float) -> float:
        """The score at which random vectors lie in ``caps`` caps on average: measured on ``_TRIAL`` of them.

        Directions are random, so the mean is that of any data.
        """
        if caps not in self._heights:
            trial = np.random.default_rng([_CODE_SEED, self.rotation.shape[0]]).standard_normal((_TRIAL, self.rotation.shape[0]))
            scores = self._scores(trial / np.linalg.norm(trial, axis=1, keepdims=True))
            best, rows = [s.max(axis=1) for s in scores], np.arange(_TRIAL)
            wanted = int(min(caps, math.prod(s.shape[1] for s in scores)) * _TRIAL)
            bound = float(np.mean(sum(best)))
            while len(found := self._above(scores, best, rows, np.full(_TRIAL, bound))[1]) < wanted:
                bound -= 0.02 * max(abs(bound), 0.05)
            self._heights[caps] = float(np.partition(found, len(found) - wanted)[len(found) - wanted])
        return self._heights[caps]

    def decode(self, vectors: np.ndarray, caps: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, direction) of all caps that each row of unit ``vectors`` lies in."""
        scores = self._scores(vectors)
        best = [s.max(axis=1) for s in scores]
        least = min(LEAST_CAPS, math.prod(s.shape[1] for s in scores))
        rows, bound, out = np.arange(len(vectors)), np.full(len(vectors), self.height(caps)), ([], [])
        while len(rows):
            at, _, name = self._above(scores, best, rows, bound[rows])
            counts = np.bincount(at, minlength=len(vectors))
            enough = counts[at] >= least
            out[0].append(at[enough])
            out[1].append(name[enough])
            rows = rows[counts[rows] < least]
            bound[rows] -= 0.02 * np.maximum(np.abs(bound[rows]), 0.05)
        return (np.concatenate(out[0]), np.concatenate(out[1])) if out[0] else (np.zeros(0, dtype=np.int64),) * 2


def code_shape(vectors: int) -> tuple[int, int]:
    """(blocks, codes a block): at least one direction per cap entry of a code, at any size."""
    wanted = max(2.0 * CAPS * max(1, vectors), 1 << 12)
    blocks = 2
    while wanted ** (1 / blocks) > MAX_BLOCK_CODES:
        blocks += 1
    return blocks, 1 << math.ceil(math.log2(wanted ** (1 / blocks)))


def code_draws(blocks: int) -> int:
    """Codes to draw: with more blocks a single code misses more of the close pairs, and more codes make up for it."""
    return DRAWS * (2 * blocks - 3)


def cap_name(space, bucket):
    """One number for a cap of a space: caps of a vector are ordered by it."""
    return (np.int64(space) << np.int64(48)) + bucket


def unit_rows(column: pa.Array) -> np.ndarray:
    """The rows of a list column of one length, in double precision, scaled to length 1."""
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    rows = flat.reshape(len(column), -1)
    # Scale by the largest component first, so that squares neither overflow nor vanish.
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def cap_members(vectors: DataFrame, shape: tuple[int, int], caps: int) -> DataFrame:
    """(space, bucket, id) for every cap that each vector of (id, v) lies in; a space is one code of one dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books: dict[int, list[ProductCode]] = {}
        draws = code_draws(shape[0])
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                sizes = np.asarray(part.column(1).value_lengths())
                for dim in np.unique(sizes).tolist():
                    rows = np.flatnonzero(sizes == dim)
                    if dim not in books:
                        books[dim] = [ProductCode(dim, *shape, draw) for draw in range(draws)]
                    unit = unit_rows(part.column(1).take(pa.array(rows)))
                    for draw, code in enumerate(books[dim]):
                        at, name = code.decode(unit, caps)
                        ids = part.column(0).take(pa.array(rows[at]))
                        space = pa.array(np.full(len(name), dim * draws + draw), pa.int32())
                        yield pa.RecordBatch.from_arrays([space, pa.array(name, pa.int64()), ids], names=["space", "bucket", "id"])

    return vectors.select("id", "v").mapInArrow(run, "space int, bucket long, id long")


def first_shared(caps: list[np.ndarray], here: int, pairs: np.ndarray) -> np.ndarray:
    """Of ``pairs`` (rows by rows) those that share no cap named below ``here``; ``caps`` are each row's names."""
    rows = np.flatnonzero(pairs.any(axis=0) | pairs.any(axis=1))
    below = [caps[r][caps[r] < here] for r in rows.tolist()]
    owner = np.repeat(np.arange(len(rows)), [len(x) for x in below])
    names, at, times = np.unique(np.concatenate(below) if below else np.zeros(0, dtype=np.int64), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)
    out, part = pairs.copy(), np.ix_(rows, rows)
    for lo in range(0, len(shared), 4096):
        column = np.full(len(names), -1)
        column[shared[lo : lo + 4096]] = np.arange(len(shared[lo : lo + 4096]))
        member = np.zeros((len(rows), len(shared[lo : lo + 4096])), dtype=np.float32)
        seen = column[at] >= 0
        member[owner[seen], column[at][seen]] = 1
        out[part] &= member @ member.T == 0
    return out


def spanning_labels(linked: np.ndarray) -> np.ndarray:
    """The smallest row that each row of a symmetric link matrix reaches."""
    labels = np.arange(len(linked))
    while True:
        lower = np.minimum(labels, np.where(linked, labels[None, :], len(linked)).min(axis=1))
        lower = lower[lower]
        if (lower == labels).all():
            return labels
        labels = lower


def _cell_links(cells: DataFrame, cosine: float) -> DataFrame:
    """Links found in sorted cells (space, bucket, i, j, block, id, copies, caps, v).

    Rows (a, null, n): vector a has n links (copies of the other end counted) that no earlier cap of
    both has found; rows (a, b, 0): a and b are connected.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            space, bucket, i, j = (table.column(c).to_numpy() for c in ("space", "bucket", "i", "j"))
            keys = np.stack([space, bucket, i, j])
            first = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
            ends = np.append(first[1:], table.num_rows)
            ids, block, copies = (table.column(c).to_numpy() for c in ("id", "block", "copies"))
            v, lists = table.column("v").combine_chunks(), table.column("caps").combine_chunks()
            found = [], [], []
            for lo, hi in zip(first.tolist(), ends.tolist()):
                if hi - lo < 2:
                    continue
                unit = unit_rows(v.slice(lo, hi - lo))
                linked = unit @ unit.T >= cosine
                np.fill_diagonal(linked, False)
                if i[lo] != j[lo]:
                    linked &= block[lo:hi, None] != block[None, lo:hi]
                if not linked.any():
                    continue
                labels = spanning_labels(linked)
                edge = np.flatnonzero(labels != np.arange(hi - lo))
                found[0].append(ids[lo:hi][labels[edge]])
                found[1].append(ids[lo:hi][edge])
                found[2].append(np.zeros(len(edge), dtype=np.int64))
                caps = [lists[k].values.to_numpy() for k in range(lo, hi)]
                count = first_shared(caps, int(cap_name(space[lo], bucket[lo])), linked) @ copies[lo:hi]
                some = np.flatnonzero(count)
                found[0].append(ids[lo:hi][some])
                found[1].append(np.full(len(some), -1))
                found[2].append(count[some])
            a, b, n = (np.concatenate(f) if f else np.zeros(0, dtype=np.int64) for f in found)
            counts = np.concatenate([np.full(len(f), k % 2 == 1) for k, f in enumerate(found[1])]) if found[1] else np.zeros(0, dtype=bool)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64(), mask=counts), pa.array(n, pa.int64())], names=["a", "b", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held is not None else table
            keys = np.stack([held.column(c).to_numpy() for c in ("space", "bucket", "i", "j")])
            other = np.flatnonzero((keys != keys[:, -1:]).any(axis=0))
            if len(other):
                yield from done(held.slice(0, int(other[-1]) + 1))
                held = held.slice(int(other[-1]) + 1)
        if held is not None and held.num_rows:
            yield from done(held)

    return cells.mapInArrow(run, "a long, b long, n long")


def embedding_near_duplicates(df: DataFrame, id_col: str, vector_col: str, cosine: float = 0.95, caps: float = CAPS) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``df``; linked from ``cosine`` on."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    sound = rows.where(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))
    groups = sound.groupBy("v").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("copies"))
    # An id that repeats with other vectors may stand for several groups: groups have keys of their own.
    groups = cut(groups.select(F.xxhash64("v", "rep").alias("key"), "rep", "copies", "v"))
    same = cut(sound.join(groups.select("key", "rep", "copies", "v"), "v").select("id", "key", "rep", "copies"))
    shape = code_shape(groups.count())
    vectors = groups.select(F.col("key").alias("id"), "v")
    members = cut(cap_members(vectors, shape, caps))
    sizes = members.groupBy("space", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = cut(members.join(sizes, ["space", "bucket"]))
    # A vector's caps that others lie in too: a few dozen.
    lists = met.groupBy("id").agg(F.collect_list(F.shiftleft(F.col("space").cast("long"), 48) + F.col("bucket")).alias("caps"))
    blocks = F.ceil(F.col("n") / CELL).cast("int")
    dealt = met.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "space", "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id"
    )
    known = groups.select(F.col("key").alias("id"), "copies", "v").join(lists, "id")
    cells = dealt.join(known, "id").select("space", "bucket", "i", "j", "block", "id", "copies", "caps", "v")
    cells = cells.repartition("space", "bucket", "i", "j").sortWithinPartitions("space", "bucket", "i", "j", "id")
    found = cut(_cell_links(cells, cosine))
    counted = found.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("others"))
    links = found.where("b is not null").select("a", "b").distinct()
    ends = groups.select("key", "rep")
    edges = (
        links.join(ends.select(F.col("key").alias("a"), F.col("rep").alias("x")), "a")
        .join(ends.select(F.col("key").alias("b"), F.col("rep").alias("y")), "b")
        .select("x", "y")
        .unionByName(same.where("id <> rep").select(F.col("rep").alias("x"), F.col("id").alias("y")))
    )
    labels = connected_components(edges, "x", "y")
    own = same.join(counted, "key", "left").groupBy("id").agg(F.sum(F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    out = rows.select("id").join(own, "id", "left").join(labels, "id", "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def op3_cap_filter_near_dedup(embeddings: DataFrame) -> DataFrame:
    """Links among all ``embeddings`` at cosine 0.95 or more; one row per row."""
    return embedding_near_duplicates(embeddings, "vec_id", "embedding")
