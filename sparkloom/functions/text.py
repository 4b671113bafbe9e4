"""Text column functions. All are built-in expressions: no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and what they fold to, position by position.
ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿºª"
PLAIN = "aaaaaaeeeeiiiiooooouuuucnyyoa"

# Words without content of their own in support checks.
STOPWORDS = (
    "ainda alem algo anos apos aquela aquele aquelas aqueles assim cada como com contra depois desde dessa desse deste desta diferentes durante elas eles "
    "entre essa esse esta este foram havia isso isto mais maior maiores menor menos mesma mesmo muito nao nessa nesse neste nesta onde para pela pelo pelas "
    "pelos pois ponto porque quando quanto quase sobre tambem todos todas tres teve tiveram fornecem disponiveis suficiente responder solicitado documentos evidencia"
).split()
# Words left out of a number's context, and metric words that stay in.
CONTEXT_STOPWORDS = (
    "acumulado analisado apresentou chegou emprego empregos entre estado formal mercado meses periodo postos regiao regioes registrou saldo saldos trabalho variacao"
).split()
METRIC_TERMS = (
    "indicador indicadores resultado resultados serie series indice indices taxa taxas dado dados valor valores medida medidas numero numeros participacao crescimento saldo saldos"
).split()

TRUNCATED = "\n[conteúdo truncado]"


def fold(text: Column) -> Column:
    """Lower case without accents; null counts as empty."""
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), ACCENTED, PLAIN)


def collapse(text: Column) -> Column:
    """White space runs become one blank; trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalise(text: Column) -> Column:
    return collapse(fold(text))


def contains_word(text: Column, word: Column) -> Column:
    """Whether the folded text holds the folded word between non-word characters."""
    quoted = F.regexp_replace(normalise(word), r"([\\.\[\]{}()*+?^$|\-])", r"\\$1")
    return F.rlike(normalise(text), F.concat(F.lit(r"(?U)(?<!\w)"), quoted, F.lit(r"(?!\w)")))


def content_terms(text: Column, least: int = 4) -> Column:
    """Letter runs of ``least`` or more, folded, without stop words; in order, repeats included."""
    found = F.regexp_extract_all(fold(text), F.lit(f"[a-z]{{{least},}}"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*STOPWORDS))


def context_terms(text: Column) -> Column:
    found = F.regexp_extract_all(fold(text), F.lit("[a-z]{3,}"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: ~t.isin(*CONTEXT_STOPWORDS) | t.isin(*METRIC_TERMS)))


def sentences(text: Column, least: int = 24) -> Column:
    """Trimmed sentences of ``least`` characters or more."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^.!?\n]+(?:[.!?]|$)"), F.lit(0))
    return F.filter(F.transform(found, lambda s: F.trim(s)), lambda s: F.length(s) >= least)


def entity_name(name: Column) -> Column:
    """White space collapsed, first letter upper case, the rest lower."""
    one = collapse(name)
    return F.concat(F.upper(F.substring(one, 1, 1)), F.lower(F.substring(one, F.lit(2), F.greatest(F.length(one) - 1, F.lit(0)))))


def scrub_controls(text: Column) -> Column:
    """Control characters go, but for tab, line feed and carriage return."""
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def token_estimate(text: Column) -> Column:
    return F.floor((F.length(text) + 3) / 4).cast("long")


def limit_context(text: Column, max_tokens: int, marker: str = TRUNCATED) -> Column:
    """The text, or its beginning and a marker if it exceeds four characters a token."""
    budget = 4 * max_tokens
    return F.when(F.length(text) <= budget, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, budget)), F.lit(marker)))


def snippet(text: Column, start: Column, length: Column, around: int = 60) -> Column:
    """The surroundings of [start, start + length), start counted from 0, between ellipses."""
    lo = F.greatest(start - around, F.lit(0))
    hi = F.least(F.length(text), start + length + around)
    return F.concat(F.lit("..."), F.trim(F.substring(text, lo + 1, hi - lo)), F.lit("..."))


def strip_fence(text: Column) -> Column:
    """Markdown code fences around a payload go."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def redact(text: Column) -> Column:
    """Credentials and query strings of addresses, and values of secret-looking assignments, go."""
    no_user = F.regexp_replace(text, r"(https?://)[^/@\s]+@", "$1")
    no_query = F.regexp_replace(no_user, r"(https?://[^\s?#]+)[?#]\S*", "$1")
    return F.regexp_replace(no_query, r"(?i)\b(api[_-]?key|token|secret|password)(\s*[=:]\s*)\S+", "$1$2[redacted]")


def relevance(score: Column) -> Column:
    """Scores to 0..1: non-finite 0, above 1 a tenth, two decimals half-even."""
    finite = F.when(score.isNull() | F.isnan(score) | (F.abs(score) == float("inf")), 0.0).otherwise(score)
    return F.bround(F.least(F.greatest(F.when(finite > 1, finite / 10).otherwise(finite), F.lit(0.0)), F.lit(1.0)), 2)


def text_key(text: Column, length: int = 300) -> Column:
    """What two passages are compared by: the beginning of the collapsed text."""
    return F.substring(collapse(text), 1, length)


def source_label(path: Column, page: Column) -> Column:
    """File name without folders and extension, separators as blanks, and the page if there is one."""
    name = F.regexp_replace(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[A-Za-z0-9]+$", ""), r"[-_]+", " ")
    return F.when(page.isNull() | (page == ""), name).otherwise(F.concat(name, F.lit(", p. "), page))
