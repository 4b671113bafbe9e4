"""Toxicity: a linear-chain conditional random field tags toxic words; its marginals score documents.

Labels come by document, so tokens are labelled first: in toxic training documents, a word counts as
toxic if it, or its beginning, is seen in enough toxic documents and in almost no clean ones. The
field (two tags, features: the word, its beginnings and ending) is fitted to these token labels.
Forward-backward marginals give the spans with byte-exact offsets (as code points), and a
logistic model over their sum, maximum and density gives the document's score.

Chains are sentences, cut after ``CHAIN`` words at most; every word of a text is in one chain. Null
and empty texts have no spans and a score near zero. With no training rows, or labels of one kind
only, every score is the share of toxic training rows (0 if there are none). Texts of any length are
tagged whole. One row out per row in: rows that repeat an id, or have none, are scored like any other,
ties of labels on one id count as toxic; an empty table gives no rows. Other columns are left out,
whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .language_id import fold
from .storage import spare
from .textkernel import chunks, mix64, span_hashes, word_spans

CHAIN = 64
TABLE_BITS = 19
TRAIN_DOCS = 1200
MIN_SHARE = 0.9
SIGNIFICANCE = 0.01
STEPS = 20
THRESHOLD = 0.7

_LETTER = np.zeros(256, dtype=bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:256] = True
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[ord(c) for c in ".!?\n"]] = True
_KINDS = 5


def token_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, rows, chain starts, features) of the words of a chunk; features: hashes, a row per kind."""
    starts, ends, rows = word_spans(data, offsets, _LETTER)
    if not len(starts):
        return starts, ends, rows, np.zeros(0, dtype=np.int64), np.zeros((_KINDS, 0), dtype=np.uint64)
    hashed = [span_hashes(data, starts, ends)]
    hashed += [span_hashes(data, starts, np.minimum(starts + k, ends)) for k in (4, 5, 6)]
    hashed.append(span_hashes(data, np.maximum(ends - 4, starts), ends))
    features = np.stack([mix64(h + np.uint64(k + 1)) for k, h in enumerate(hashed)])
    breaks = np.cumsum(_BREAK[data])[starts]
    first = np.ones(len(starts), dtype=bool)
    first[1:] = (rows[1:] != rows[:-1]) | (breaks[1:] != breaks[:-1])
    at = np.flatnonzero(first)
    place = np.arange(len(starts)) - np.repeat(at, np.diff(np.append(at, len(starts))))
    return starts, ends, rows, np.flatnonzero(place % CHAIN == 0), features


@dataclass
class ToxicityModel:
    weights: np.ndarray
    transitions: np.ndarray
    bias: float
    document: np.ndarray
    base: float

    def marginals(self, chain_starts: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """P(tag is toxic) of every token; slot: table places, a row per kind of feature."""
        if not slot.shape[1]:
            return np.zeros(0)
        return _forward_backward(_emissions(self.weights, slot) + self.bias, chain_starts, self.transitions)[0]

    def document_scores(self, marginal: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
        if self.document is None:
            return np.full(n_rows, self.base)
        return 1 / (1 + np.exp(-(_summaries(marginal, rows, n_rows) @ self.document)))


def slots(features: np.ndarray) -> np.ndarray:
    return (features >> np.uint64(64 - TABLE_BITS)).astype(np.int32)


def _emissions(weights: np.ndarray, slot: np.ndarray) -> np.ndarray:
    total = np.zeros(slot.shape[1])
    for row in slot:
        total += weights[row]
    return total


def _summaries(marginal: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    total = np.bincount(rows, marginal, n_rows)
    words = np.bincount(rows, minlength=n_rows)
    most = np.zeros(n_rows)
    np.maximum.at(most, rows, marginal)
    return np.stack([np.ones(n_rows), np.log1p(total), most, np.sqrt(total / np.maximum(words, 1))], axis=1)


def _forward_backward(scores: np.ndarray, chain_starts: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals by token, and expected transition counts; chains of like length advance together."""
    lengths = np.diff(np.append(chain_starts, len(scores)))
    order = np.argsort(-lengths, kind="stable")
    begin, length = chain_starts[order], lengths[order]
    longest = int(length[0])
    counts = np.searchsorted(-length, -np.arange(longest), side="left")  # chains longer than t
    move = np.exp(transitions)
    odds = np.exp(np.clip(scores, -30, 30))
    alpha = np.empty((len(scores), 2))
    local = np.empty((len(scores), 2))
    local[:, 0] = 1 / (1 + odds)
    local[:, 1] = odds * local[:, 0]
    state = None
    for t in range(longest):
        m = counts[t]
        at = begin[:m] + t
        state = local[at] if state is None else (state[:m] @ move) * local[at]
        state = state / state.sum(axis=1, keepdims=True)
        alpha[at] = state
    marginal = np.empty(len(scores))
    expected = np.zeros((2, 2))
    beta = np.ones((0, 2))
    for t in range(longest - 1, -1, -1):
        m = counts[t]
        at = begin[:m] + t
        here = np.ones((m, 2))
        k = len(beta)
        if k:
            after = local[at[:k] + 1] * beta
            both = alpha[at[:k]][:, :, None] * move[None] * after[:, None, :]
            expected += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            here[:k] = after @ move.T
            here /= here.sum(axis=1, keepdims=True)
        both = alpha[at] * here
        marginal[at] = both[:, 1] / both.sum(axis=1)
        beta = here
    return marginal, expected


def _label_tokens(features: np.ndarray, rows: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Which tokens of toxic documents are toxic: by the documents that hold their word or beginning.

    Sightings are distinct preceding words, so that copies of a document count once. A word or
    beginning counts if its sightings are toxic so much oftener than the sample's share that the
    log-likelihood ratio stays significant over all the words compared.
    """
    label = np.zeros(features.shape[1], dtype=bool)
    bad, base = toxic[rows], toxic.mean()
    context = np.roll(features[0], 1) * np.uint64(0x9E3779B97F4A7C15)
    for kind in features[:4]:
        _, once = np.unique(mix64(kind + context), return_index=True)
        values, where, seen = np.unique(kind[once], return_inverse=True, return_counts=True)
        hits = np.bincount(where.ravel(), toxic[rows[once]])
        share = np.clip(hits / seen, 1e-3, 1 - 1e-3)
        ratio = hits * np.log(share / base) + (seen - hits) * np.log((1 - share) / (1 - base))
        chosen = values[(share >= MIN_SHARE) & (ratio > np.log(len(values) / SIGNIFICANCE))]
        label |= bad & np.isin(kind, chosen)
    return label


def fit(texts: list[str], toxic: list[int]) -> ToxicityModel:
    """Fits the field and the document model to labelled texts."""
    y = np.array(toxic, dtype=bool)
    base = float(y.mean()) if len(y) else 0.0
    weights, transitions = np.zeros(1 << TABLE_BITS), np.zeros((2, 2))
    if not y.any() or y.all():
        return ToxicityModel(weights, transitions, 0.0, None, base)
    feats, all_rows, firsts, tokens = [], [], [], 0
    for lo, data, offsets in chunks(pa.array(texts, pa.string())):
        _, _, rows, first, f = token_features(data, offsets)
        feats.append(f)
        all_rows.append(rows + lo)
        firsts.append(first + tokens)
        tokens += len(rows)
    if not tokens:
        return ToxicityModel(weights, transitions, 0.0, None, base)
    features, rows, first = np.concatenate(feats, axis=1), np.concatenate(all_rows), np.concatenate(firsts)
    feats.clear()
    label = _label_tokens(features, rows, y)
    slot = slots(features)
    del features
    observed = np.zeros((2, 2))
    inner = np.ones(tokens, dtype=bool)
    inner[first] = False
    np.add.at(observed, (label[:-1][inner[1:]].astype(int), label[1:][inner[1:]].astype(int)), 1)
    bias = float(np.log((label.sum() + 1) / (tokens - label.sum() + 1)))
    squares, move_squares, bias_square = np.full(1 << TABLE_BITS, 1e-8), np.full((2, 2), 1e-8), 1e-8
    for _ in range(STEPS):  # adaptive gradient ascent on the conditional likelihood
        marginal, expected = _forward_backward(_emissions(weights, slot) + bias, first, transitions)
        error = label - marginal
        gradient = -1e-3 * weights
        for row in slot:
            gradient += np.bincount(row, error, 1 << TABLE_BITS)
        squares += gradient**2
        weights += gradient / np.sqrt(squares)
        step = observed - expected
        step[0, 0] = 0
        move_squares += step**2
        transitions = np.clip(transitions + 0.3 * step / np.sqrt(move_squares), -6, 6)
        bias_square += error.sum() ** 2
        bias += 0.3 * error.sum() / np.sqrt(bias_square)
    model = ToxicityModel(weights.astype(np.float32), transitions, bias, None, base)
    x = _summaries(model.marginals(first, slot), rows, len(y))
    beta = np.zeros(x.shape[1])
    for _ in range(30):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-(x @ beta)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(x.shape[1])
        beta += np.linalg.solve(hessian, x.T @ (y - p) - 0.05 * beta)
    model.document = beta
    return model


def training_rows(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, text, toxic): about ``bound`` labelled texts of either kind, drawn by a hash of the id; a bounded sample."""
    marked = labels.where("toxic is not null").where(fold("doc_id", 3) != 1).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}  # two rows
    u = F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1 << 40)) / float(1 << 40)
    share = F.coalesce(*[F.when(F.col("toxic") == kind, F.lit(min(1.0, bound / n))) for kind, n in counts.items()], F.lit(0.0))
    drawn = F.broadcast(marked.where(u < share))  # about 2 * bound ids at most
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(drawn, "doc_id").dropDuplicates(["doc_id", "text"])


def score_documents(df: DataFrame, text_col: str, model: ToxicityModel, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of every row, with __score and __spans: code-point offsets of neighbouring toxic words."""
    holder = df.sparkSession.sparkContext.broadcast(model)  # 2 MB of weights, whatever the corpus
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = holder.value
        for batch in batches:
            for lo, data, offsets in chunks(batch.column(len(keep))):
                starts, ends, rows, first, features = token_features(data, offsets)
                p = field.marginals(first, slots(features))
                n = len(offsets) - 1
                scores = field.document_scores(p, rows, n)
                point = np.append(np.cumsum((data & 0xC0) != 0x80), 0) if len(data) else np.zeros(1, dtype=np.int64)
                hit = np.flatnonzero(p >= 0.5)
                joined = np.split(hit, np.flatnonzero((np.diff(hit) > 1) | (np.diff(rows[hit]) > 0)) + 1) if len(hit) else []
                base = np.where(offsets > 0, point[offsets - 1], 0)
                spans: list[list] = [[] for _ in range(n)]
                for group in joined:
                    r = rows[group[0]]
                    spans[r].append({"start": int(point[starts[group[0]]] - 1 - base[r]), "end": int(point[ends[group[-1]] - 1] - base[r]), "p": float(p[group].max())})
                kept = [c.slice(lo, n) for c in batch.columns[: len(keep)]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(scores), pa.array(spans, pa.list_(span))], names=[*keep, "__score", "__spans"])

    source = df.select(*keep, F.col(text_col).cast("string").alias(spare(df, "__text")[0]))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("__score", T.DoubleType())])
    struct = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType())])
    return source.mapInArrow(run, schema.add("__spans", T.ArrayType(struct)))


def fit_from_tables(documents: DataFrame, labels: DataFrame, bound: int = TRAIN_DOCS) -> ToxicityModel:
    """Fits the model to the bounded sample of labelled rows, in one task; only the weights come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic = [], []
        for batch in batches:
            texts += [t or "" for t in batch.column(0).to_pylist()]
            toxic += batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts, toxic))], pa.binary())], names=["model"])

    rows = training_rows(documents, labels, bound).repartition(1).sortWithinPartitions("doc_id", "text")
    found = rows.select("text", "toxic").mapInArrow(run, "model binary").collect()  # one row
    return pickle.loads(found[0]["model"]) if found else fit([], [])


def op9_crf_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The toxicity of every text of ``documents``, learned from labelled rows with fold <> 1 alone.

    ``held_out`` is false where the id is null. Documents that repeat an id are scored row by row.
    """
    scored = score_documents(documents, "text", fit_from_tables(documents, labels), keep=["doc_id"])
    held = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"), F.col("__spans").alias("spans"))
