"""Ranked lexical search by block-max pruning.

The index is a table of forward-index blocks: a row per range of ``BLOCK`` documents in table order,
with the terms and frequencies of each of its documents. A second table has the largest impact of
every term in every block. A query's bound in a block is the sum of its terms' weights times these
maxima: no document of the block can score more. Blocks are visited in waves, best bounds first; a
block is scored only while its bound reaches the score that is the query's last place so far, so
what is left out can't be among the best.

Terms are the maximal runs of characters other than ASCII signs and white space, A-Z lower-cased.
They are carried as 64-bit hashes (two words of one hash count as one word). Terms that no query
asks for are dropped at the scan by a Bloom filter of fixed size; false positives cost space alone.

Null texts and texts without a term are no documents to the statistics. Rows that repeat a document
id are documents of their own; rows without an id count in the statistics and are never listed.
Rows that repeat an item id are one item, terms that an item repeats count once, and items whose id
is null or which have no term give no rows. Equal scores are ordered by ascending document id.
Texts of any length are indexed whole. Empty tables give no rows. Other columns are left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import batch_rows, cut

#: Documents of a block.
BLOCK = 128
#: Blocks a query visits in each of the first waves; what may still matter is visited in the last.
WAVES = (8, 64)
#: Items that are scored against a block at once.
ITEMS = 4096
#: Bits of the filter of asked terms: 2 MB, however many they are.
FILTER_BITS = 24
#: Rows of text that a Python worker is handed at once.
BATCH = 4 * BLOCK
#: Blocks that a Python worker is handed at once.
READ = 32

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: UTF-8 bytes to what they count as in a term; all that ends a term becomes a blank.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))
_SEED = 42  # of the engine's xxhash64

_INDEX = "block long, documents long, length long, ids array<long>, lengths array<long>, ends array<int>, terms array<long>, tfs array<int>, unique array<long>, df array<int>"


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, term): the distinct terms of every item, hashed."""
    folded = F.translate(F.col(text_col).cast("string"), _UPPER, _LOWER)
    words = F.array_distinct(F.regexp_extract_all(folded, F.lit(_TERM), F.lit(0)))
    return items.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item"), F.explode(F.transform(words, lambda w: F.xxhash64(w))).alias("term")).distinct()


def term_filter(spark: SparkSession, asked: DataFrame) -> Broadcast:
    """A bitmap of 2 ** ``FILTER_BITS`` bits that has a bit for every asked term: at most 2 ** (``FILTER_BITS`` - 6) words come in."""
    place = F.shiftrightunsigned("term", 64 - FILTER_BITS)
    words = asked.select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(term, {64 - FILTER_BITS}) & 63 as int))").alias("bit"))
    bitmap = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    for row in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        bitmap[row["word"]] = row["bits"]
    return spark.sparkContext.broadcast(bitmap.view(np.uint64))


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else np.zeros(0), kind))


def build_index(documents: DataFrame, id_col: str, text_col: str, asked: Broadcast) -> DataFrame:
    """Forward-index blocks: per block its documents' ids and lengths, their postings, and each term's number of documents."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = asked.value
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            text = batch.column(1).cast(pa.binary())
            for lo in range(0, len(text), BLOCK):
                block += 1
                ids, lengths, sizes, terms, tfs = [], [], [], [], []
                for i, raw in zip(batch.column(0).slice(lo, BLOCK).to_pylist(), text.slice(lo, BLOCK)):
                    counts = Counter(raw.as_py().translate(_BYTES).split())
                    if not counts:
                        continue
                    names = np.fromiter((xxhash.xxh64_intdigest(w, _SEED) for w in counts), np.uint64, len(counts))
                    tf = np.fromiter(counts.values(), np.int64, len(counts))
                    place = names >> np.uint64(64 - FILTER_BITS)
                    held = (filled[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
                    lengths.append(int(tf.sum()))
                    ids.append(i)
                    sizes.append(int(held.sum()))
                    terms.append(names[held].view(np.int64))
                    tfs.append(tf[held])
                if not ids:
                    continue
                names = np.concatenate(terms)
                unique, df = np.unique(names, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block]), pa.array([len(ids)]), pa.array([sum(lengths)]), pa.array([ids], pa.list_(pa.int64())), _lists([np.array(lengths)], pa.int64()),
                        _lists([np.cumsum(sizes)], pa.int32()), _lists([names], pa.int64()), _lists([np.concatenate(tfs)], pa.int32()), _lists([unique], pa.int64()), _lists([df], pa.int32()),
                    ],
                    names=[x.split()[0] for x in _INDEX.split(", ")],
                )

    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    with batch_rows(documents.sparkSession, BATCH):
        return cut(rows.mapInArrow(run, _INDEX))


def _impacts(tfs: np.ndarray, lengths: np.ndarray, documents: int, total: int) -> np.ndarray:
    m = 10 + 90 * lengths * documents // total
    return 1_000_000_000 * tfs // (1000 * tfs + 8 * m)


def _postings(index: pa.RecordBatch | pa.Table, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: each posting's document (a place), term and frequency, and the documents' lengths."""
    ends = index.column("ends")[row].values.to_numpy()
    at = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    return at, index.column("terms")[row].values.to_numpy(), index.column("tfs")[row].values.to_numpy().astype(np.int64), index.column("lengths")[row].values.to_numpy()


def block_maxima(index: DataFrame, documents: int, total: int) -> DataFrame:
    """(block, term, most): the largest impact of each term among the documents of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                at, terms, tfs, lengths = _postings(batch, row)
                if not len(terms):
                    continue
                order = np.argsort(terms, kind="stable")
                unique, first = np.unique(terms[order], return_index=True)
                most = np.maximum.reduceat(_impacts(tfs, lengths[at], documents, total)[order], first)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(unique), batch.column("block")[row].as_py())), pa.array(unique), pa.array(most)], names=["block", "term", "most"])

    with batch_rows(index.sparkSession, READ):
        return cut(index.select("block", "lengths", "ends", "terms", "tfs").mapInArrow(run, "block long, term long, most long"))


def _best(items: np.ndarray, docs: np.ndarray, scores: np.ndarray, limit: int) -> np.ndarray:
    """Places of the ``limit`` highest scores of each item, equal scores by document id."""
    order = np.lexsort((docs, -scores, items))
    ranked = items[order]
    fresh = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, int)
    place = np.arange(len(ranked)) - np.repeat(fresh, np.diff(np.r_[fresh, len(ranked)]))
    return order[place < limit]


def score_blocks(index: DataFrame, wanted: DataFrame, asked: DataFrame, documents: int, total: int, limit: int, buckets: int) -> DataFrame:
    """(item, doc_id, score): the ``limit`` best of each block that ``wanted`` (item, block) names, exactly scored."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        ask_item, ask_term, ask_weight = (right.column(c).to_numpy() for c in ("item", "term", "weight"))
        for row in range(left.num_rows if len(ask_item) else 0):
            at, terms, tfs, lengths = _postings(left, row)
            ids = left.column("ids")[row].values
            named = ids.is_valid().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            order = np.argsort(terms, kind="stable")
            at, impact, terms = at[order], _impacts(tfs, lengths[at], documents, total)[order], terms[order]
            lo, hi = np.searchsorted(terms, ask_term, "left"), np.searchsorted(terms, ask_term, "right")
            n = hi - lo
            which = np.repeat(np.arange(len(n)), n)
            posting = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[which]
            items, own = np.unique(ask_item, return_inverse=True)
            scores = np.zeros((len(items), len(ids)), dtype=np.int64)
            np.add.at(scores, (own[which], at[posting]), ask_weight[which] * impact[posting])
            i, d = np.nonzero((scores > 0) & named[None, :])
            top = _best(i, ids[d], scores[i, d], limit)
            out.append((items[i[top]], ids[d[top]], scores[i[top], d[top]]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("item", "doc_id", "score"), columns)))

    bucket = F.pmod(F.xxhash64("item"), F.lit(buckets))
    pairs = wanted.select("block", "item", bucket.alias("bucket"))
    blocks = index.select("block", "ids", "lengths", "ends", "terms", "tfs").join(pairs.select("block", "bucket").distinct(), "block")
    asking = pairs.join(asked, "item").select(*[F.col(c).alias(c) for c in ("block", "bucket", "item", "term", "weight")])
    return blocks.groupBy("block", "bucket").cogroup(asking.groupBy("block", "bucket")).applyInArrow(run, "item long, doc_id long, score long")


def search(documents: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str, item_text_col: str, limit: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``limit`` best documents with a score above 0. Ids are integers."""
    spark = documents.sparkSession
    terms = cut(item_terms(items.withColumn(item_col, F.col(item_col).cast("long")), item_col, item_text_col))
    index = build_index(documents, id_col, text_col, term_filter(spark, terms))
    n, total = index.agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0))).first()
    held = index.select(F.explode(F.arrays_zip("unique", "df")).alias("x")).groupBy(F.col("x.unique").alias("term")).agg(F.sum("x.df").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n) + 2) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    asked = cut(terms.join(held, "term").select("item", "term", weight.alias("weight")))
    buckets = max(1, -(-asked.select("item").distinct().count() // ITEMS))
    maxima = block_maxima(index, n, max(1, total))
    bounds = cut(maxima.join(asked, "term").groupBy("item", "block").agg(F.sum(F.col("weight") * F.col("most")).alias("bound")).where("bound > 0"))
    ordered = Window.partitionBy("item").orderBy(F.col("bound").desc(), "block")
    ranked = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id"))
    best, left = None, bounds
    for visit in (*WAVES, None):
        wanted = left.select("item", "block") if visit is None else left.withColumn("place", F.row_number().over(ordered)).where(F.col("place") <= visit).select("item", "block")
        wanted = cut(wanted)
        found = score_blocks(index, wanted, asked, n, max(1, total), limit, buckets)
        both = found if best is None else best.select("item", "doc_id", "score").unionByName(found)
        best = cut(both.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= limit))
        if visit is None:
            break
        last = best.where(F.col("rank") == limit).select("item", F.col("score").alias("least"))
        left = left.join(wanted, ["item", "block"], "left_anti").join(last, "item", "left").where("least is null or bound >= least").drop("least")
        left = cut(left)
        if not left.limit(1).count():
            break
    return best.select(F.col("item").alias("item_id"), F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op11_block_max_search(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every ``benchmark`` item against all ``documents``: its 10 best."""
    return search(documents, "doc_id", "text", benchmark, "item_id", "text")


_TERMS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SQL = f"""
with t as (select doc_id, unnest({_TERMS_SQL}) as term from documents),
lens as (select doc_id, count(*) as n from t group by 1),
stats as (select count(*) as docs, sum(n)::bigint as total from lens),
tf as (select doc_id, term, count(*) as tf from t group by 1, 2),
df as (select term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)::double))::bigint as w from tf, stats group by 1),
m as (select doc_id, 10 + (90 * n * docs) // total as m from lens, stats),
q as (select distinct item_id, unnest({_TERMS_SQL}) as term from benchmark),
s as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score from q join tf using (term) join df using (term) join m using (doc_id) group by 1, 2),
r as (select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score from s where score > 0)
select item_id, rank, doc_id, score from r where rank <= 10
"""
