"""Words changed for their opposites: texts whose numbers stay right and whose reading is wrong."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pairs that turn a direction or a comparison round, and a causal claim that no source makes.
DIRECTION = (
    ("aumento", "redução"), ("alta", "queda"), ("cresceu", "recuou"), ("crescimento", "retração"), ("elevação", "diminuição"), ("expansão", "contração"), ("avançou", "caiu"), ("subiu", "caiu"),
)
COMPARISON = (("maior", "menor"), ("superior", "inferior"), ("acima", "abaixo"), ("mais", "menos"))
CAUSAL = " Essa variação decorreu exclusivamente da política adotada pelo governo estadual no período, o que comprova seu efeito causal direto."
#: Runs of word characters and of others: together they are the text.
PIECES = r"(?U)\w+|\W+"


def swap_words(text: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """The text with every whole word of a pair changed for its partner, all at once: no word is changed twice.

    A word that begins with a capital gives one that does. Where a word stands in several pairs, the last
    tells what it becomes. What lies between words stays as it is.
    """
    partner = {a: b for a, b in pairs} | {b: a for a, b in pairs}
    table = F.create_map(*[F.lit(x) for pair in partner.items() for x in pair])

    def turn(piece: Column) -> Column:
        low = F.lower(piece)
        other = F.try_element_at(table, low)
        first = F.substring(piece, 1, 1)
        return F.when(other.isNull(), piece).when(first != F.lower(first), F.concat(F.upper(F.substring(other, 1, 1)), F.substring(other, F.lit(2), F.length(other)))).otherwise(other)

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(PIECES), F.lit(0)), turn), "")


def perturbations(text: Column) -> Column:
    """array<struct<kind, text>> of what applies: the text itself, both swaps, a changed unit, and the causal claim."""
    point = r"p\.\s?p\.|pontos? percentua"
    unit = F.when(F.rlike(text, F.lit(point)), F.regexp_replace(text, r"\s*(?:p\.\s?p\.|pontos? percentuais|ponto percentual)", "%")).when(F.contains(text, F.lit("%")), F.regexp_replace(text, r"^([^%]*)%", "$1 p.p."))
    made = [("controle", text), ("direcao", swap_words(text, DIRECTION)), ("comparacao", swap_words(text, COMPARISON)), ("unidade_escala", unit), ("inferencia", F.concat(text, F.lit(CAUSAL)))]
    rows = F.array(*[F.struct(F.lit(kind).alias("kind"), new.alias("text")) for kind, new in made])
    return F.filter(rows, lambda r: (r["kind"] == "controle") | (r["text"] != text))
