"""Which of a question's attempts is the answer: a first one, a recovery with all sources, and a last synthesis.

Attempts are counted beforehand: sentences, numbers and how many of them a source proves, statements
without support. The policy is a fixed table of conditions on three attempts at most, so it is columns
on one row a question; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import fold

# What a question of whole coverage speaks of, the refusal, and capitalised words that name nothing.
COMPLETE_COVERAGE = (
    r"(?iu)\b(?:quais|compare|comparar|evolu[cç][aã]o|dinamismo|melhoraram|pioraram|ao longo|entre os per[ií]odos|s[eé]rie hist[oó]rica)\b.*\b(?:regi[oõ]es?|setores?|indicadores?|per[ií]odos?|trimestres?|meses?|anos?)\b"
    r"|\b(?:regi[oõ]es?|setores?|indicadores?)\b.*\b(?:dinamismo|evolu[cç][aã]o|melhoraram|pioraram|per[ií]odos?)\b"
)
REFUSAL = "Não é possível determinar com segurança o resultado solicitado. As evidências disponíveis não sustentam uma conclusão comparável."
GENERIC_CAPITALISED = ("alem", "como", "contudo", "estado", "mercado", "regiao", "regioes", "nesse", "neste", "portanto", "trabalho")

#: Sentences, lines without an end mark, and runs of marks and line breaks: together they are the text.
PIECES = r"[^.!?\n]+(?:[.!?]|$)|[^.!?\n]+|[.!?\n]+"
#: Of an attempt: is it the refusal, has it sources, its length, sentences, numbers, those proven, statements without support, and whether its names stand in the sources.
FIELDS = "refused boolean, sourced boolean, length int, sentences int, numbers int, proven int, unsupported int, named boolean"


def wants_coverage(question: Column) -> Column:
    return F.coalesce(F.rlike(question, F.lit(COMPLETE_COVERAGE)), F.lit(False))


def sentence_count(text: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^.!?\n]+(?:[.!?]|$)"), F.lit(0))
    return F.size(F.filter(found, lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")) != ""))


def capitalised_names(text: Column) -> Column:
    """Folded capitalised words of three letters or more, but for those that name nothing."""
    found = F.regexp_extract_all(text, F.lit(r"(?U)\b[A-ZÀ-Ý][A-Za-zÀ-ÿ]{2,}\b"), F.lit(0))
    return F.array_except(F.array_distinct(F.transform(found, fold)), F.array(*map(F.lit, GENERIC_CAPITALISED)))


def unproven(a: Column) -> Column:
    return a["numbers"] - a["proven"]


def fully_supported(a: Column) -> Column:
    return ~a["refused"] & (unproven(a) == 0) & (a["unsupported"] == 0)


def incomplete(a: Column) -> Column:
    return (a["sentences"] < 2) | (a["numbers"] < 4) & (a["length"] < 500)


def usable_without_numbers(a: Column) -> Column:
    """A paraphrase whose names all stand in the sources."""
    return ~a["refused"] & (a["numbers"] == 0) & a["sourced"] & a["named"]


def _coverage(a: Column) -> Column:
    return F.struct(a["sentences"], a["numbers"], a["length"])


def needs_recovery(first: Column, coverage: Column) -> Column:
    return (unproven(first) > 0) | (first["unsupported"] > 0) | first["refused"] & first["sourced"] | coverage & incomplete(first)


def prefers_recovery(first: Column, second: Column, coverage: Column) -> Column:
    """A recovery that answers where the first refused, that is proven throughout, or that proves more and lacks no more."""
    proven = (unproven(second) == 0) & (second["unsupported"] == 0) & ((second["numbers"] > 0) | (first["unsupported"] > 0))
    more = (second["proven"] > first["proven"]) & (unproven(second) <= unproven(first)) & (second["unsupported"] <= first["unsupported"])
    better = first["refused"] & ~second["refused"] | proven | more
    return better & (~coverage | (_coverage(second) >= _coverage(first)))


def choose(attempts: DataFrame, question: str, coverage: str) -> DataFrame:
    """(question, recovered, resynthesised, chosen): which attempts were asked for, and the one that is kept.

    attempts: (question, a boolean ``coverage``, structs first, second, third of ``FIELDS``); the second and
    third are what recovery and synthesis would give, looked at only where the policy asks for them. A
    null attempt that is asked for counts as not made. ``chosen``: 'first', 'second', 'third', or 'names' for a
    third that is kept for its names although statements lack support.
    """
    first, second, third, whole = F.col("first"), F.col("second"), F.col("third"), F.coalesce(F.col(coverage), F.lit(False))
    recovered = F.coalesce(needs_recovery(first, whole), F.lit(False))
    takes = recovered & F.coalesce(prefers_recovery(first, second, whole), F.lit(False))
    one = attempts.withColumn("__recovered", recovered).withColumn("__takes", takes).withColumn("__held", F.when(takes, second).otherwise(first))
    held = F.col("__held")
    confirmed = held["refused"] & F.col("__recovered") & F.coalesce(second["refused"], F.lit(False))
    again = (held["refused"] | (held["unsupported"] > 0) & (held["numbers"] == 0)) & ~confirmed
    no_values = held["proven"] == 0
    kept_numbers = (third["numbers"] > 0) | no_values
    proven = fully_supported(third) | (third["numbers"] > 0) & (unproven(third) == 0)
    last = F.when(F.coalesce(proven & kept_numbers, F.lit(False)), "third").when(F.coalesce(no_values & usable_without_numbers(third), F.lit(False)), "names")
    chosen = F.coalesce(F.when(again, last), F.when(F.col("__takes"), F.lit("second")).otherwise("first"))
    return one.select(question, F.col("__recovered").alias("recovered"), again.alias("resynthesised"), chosen.alias("chosen"))


def trim_unsupported(text: Column, unsupported: Column, spans: Column) -> Column:
    """The text without the sentences that lack support and hold no number; blank if none is left.

    ``unsupported``: trimmed sentences; ``spans``: array of (start, end) of numbers, code points from 0. Removed
    in place: headings, line breaks and tables around them stay.
    """
    pieces = F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))
    size = F.transform(pieces, lambda p: F.length(p))
    none = F.struct(F.lit(0).alias("at"), F.filter(size, lambda x: F.lit(False)).alias("starts"))
    starts = F.aggregate(size, none, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts")))["starts"]
    placed = F.arrays_zip(pieces.alias("p"), starts.alias("s"))
    ends = lambda x: F.rlike(x["p"], F.lit(r"[.!?]$")) | (x["s"] + F.length(x["p"]) == F.length(text))  # noqa: E731  a line without an end mark is no sentence
    is_sentence = lambda x: F.rlike(x["p"], F.lit(r"[^.!?\n]")) & ends(x) & (F.regexp_replace(x["p"], r"^\s+|\s+$", "") != "")
    numbered = lambda x: F.exists(spans, lambda n: (n["start"] < x["s"] + F.length(x["p"])) & (n["end"] > x["s"]))
    goes = lambda x: is_sentence(x) & F.array_contains(unsupported, F.regexp_replace(x["p"], r"^\s+|\s+$", "")) & ~numbered(x)
    kept = F.filter(placed, lambda x: ~goes(x))
    return F.when(F.exists(kept, is_sentence), F.array_join(F.transform(kept, lambda x: x["p"]), "")).otherwise("")
