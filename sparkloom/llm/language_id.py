"""Language identification by compression: the language whose zstandard dictionary encodes a text smallest.

Each language's dictionary is raw content: whole training texts up to ``DICT_BYTES``. Text is
lower-cased and runs of anything but letters become one blank; it is encoded in blocks against
every dictionary, and the sizes are added up, so that long texts don't learn their own dictionary.
Narrow margins set ``rejected``.

Null texts and texts without a letter are ``und`` with score 0. With no training rows every text is
``und``. Ties go to the language with most training rows, then by code point. Texts of any length are
encoded whole. One row out per row in: rows that repeat an id, or have none, are judged like any other;
an empty table gives no rows. Other columns are left out, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DICT_BYTES = 1 << 17
BLOCK_BYTES = 2048
LEVEL, MIN_MATCH = 5, 3
TRAIN_DOCS = 300
MIN_MARGIN = 0.01
MARGIN_SCALE = 0.03

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters_only(text: str) -> bytes:
    """Lower-cased words of letters, a blank before and after each; empty without letters."""
    words = _NOT_LETTERS.sub(" ", text.lower()).strip()
    return f" {words} ".encode("utf-8", "replace") if words else b""


def training_dictionaries(labelled: DataFrame, text_col: str, lang_col: str, key: Column, docs: int = TRAIN_DOCS, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """Per language the bytes of whole texts drawn by a hash of ``key``.

    The sample is bounded: about ``docs`` rows a language are drawn (a share of each language's
    counted rows), and ``dict_bytes`` of them kept. Draws depend on the rows alone.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), (F.pmod(F.xxhash64(key, F.lit("lang-id")), F.lit(1 << 40)) / float(1 << 40)).alias("u")
    )
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row per language
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.5 * docs / n))])
    drawn = rows.where(F.col("u") < share[F.col("lang")]).orderBy("lang", "u").select("lang", F.substring("text", 1, dict_bytes).alias("text"))  # no more of a text could be kept
    out: dict[str, bytearray] = {}
    for r in drawn.toLocalIterator():
        have = out.setdefault(r["lang"], bytearray())
        if len(have) < dict_bytes:
            have += letters_only(r["text"])[: dict_bytes - len(have)]
    return {lang: bytes(out[lang]) for lang in sorted(out, key=lambda x: (-counts[x], x)) if out[lang]}


class CompressionClassifier:
    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        import zstandard

        self.langs, self.coders = list(dictionaries), []
        how = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=MIN_MATCH, write_checksum=0, write_content_size=0, write_dict_id=0)
        for raw in dictionaries.values():
            content = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=how)
            self.coders.append(zstandard.ZstdCompressor(dict_data=content, compression_params=how))

    def sizes(self, text: bytes) -> list[int]:
        """Encoded bytes of the whole text by language."""
        blocks = [text[i : i + BLOCK_BYTES] for i in range(0, len(text), BLOCK_BYTES)]
        return [sum(len(encode(b)) for b in blocks) for encode in (c.compress for c in self.coders)]

    def classify(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin); the score grows with the margin over the runner-up."""
        letters = letters_only(text or "")
        if not letters or not self.langs:
            return "und", 0.0, 0.0
        sizes = self.sizes(letters)
        order = sorted(range(len(sizes)), key=sizes.__getitem__)
        if len(order) == 1:
            return self.langs[0], 1.0, 1.0
        best, second = sizes[order[0]], sizes[order[1]]
        margin = (second - best) / second
        return self.langs[order[0]], 1.0 - math.exp(-margin / MARGIN_SCALE), margin


def classify_languages(df: DataFrame, id_col: str, text_col: str, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """(id, lang_pred, score, margin, rejected) for every row."""
    holder = df.sparkSession.sparkContext.broadcast(dictionaries)  # a few dictionaries of dict_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = CompressionClassifier(holder.value)
        for batch in batches:
            got = [model.classify(t.as_py()) for t in batch.column(1)]
            lang, score, margin = (list(c) for c in zip(*got)) if got else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array(np.array(margin, dtype=float) < min_margin)],
                names=["id", "lang_pred", "score", "margin", "rejected"],
            )

    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "id long, lang_pred string, score double, margin double, rejected boolean").withColumnRenamed("id", id_col)


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def op8_compression_language_id(documents: DataFrame) -> DataFrame:
    """The language of every text of ``documents``; dictionaries come from rows with fold <> 0 alone.

    ``held_out`` is false where the id is null (it has no fold; such rows are not learned from).
    """
    docs = documents.select("doc_id", "text", "lang")
    learn = docs.where(fold("doc_id", 5) != 0)
    found = classify_languages(docs, "doc_id", "text", training_dictionaries(learn, "text", "lang", F.col("doc_id")))
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "margin", "rejected")
