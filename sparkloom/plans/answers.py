"""From candidates to an answer: chains of tables and series, contexts by level, recovery, trimming, stems, perturbed texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from sparkloom.functions import swaps as W
from sparkloom.functions import text as X
from sparkloom.functions.stemmer import with_stems
from sparkloom.operators import chains, rank, recovery

from .base import Book
from .retrieval import BM25_SQL, bm25_topk, query_terms

book = Book()

# Frequent words of the languages of ``documents``, two and two.
EVERYDAY = (("the", "of"), ("que", "de"), ("und", "der"), ("les", "des"), ("la", "el"))


def _swap_sql(text: str, pairs: Sequence[tuple[str, str]]) -> str:
    partner = {a: b for a, b in pairs} | {b: a for a, b in pairs}
    turned = " ".join(f"when '{a}' then '{b}'" for a, b in partner.items())
    other = f"(case lower(x) {turned} end)"
    capital = f"upper(substr({other}, 1, 1)) || substr({other}, 2)"
    piece = f"case when {other} is null then x when substr(x, 1, 1) <> lower(substr(x, 1, 1)) then {capital} else {other} end"
    return rf"array_to_string(list_transform(regexp_extract_all({text}, '[\p{{L}}\p{{M}}\p{{N}}_]+|[^\p{{L}}\p{{M}}\p{{N}}_]+'), lambda x: {piece}), '')"


@book.add(f"select doc_id, {_swap_sql('text', EVERYDAY)} as text from documents")
def swapped_words(t):
    """Every document with frequent words changed for one another in one pass."""
    return t("documents").select("doc_id", W.swap_words(F.col("text"), EVERYDAY).alias("text"))


@book.add(rf"""
with v as (select doc_id, text as original, unnest([
  {{'kind': 'controle', 'text': text}}, {{'kind': 'direcao', 'text': {_swap_sql('text', W.DIRECTION)}}}, {{'kind': 'comparacao', 'text': {_swap_sql('text', W.COMPARISON)}}},
  {{'kind': 'unidade_escala', 'text': case when regexp_matches(text, 'p\.\s?p\.|pontos? percentua') then regexp_replace(text, '\s*(?:p\.\s?p\.|pontos? percentuais|ponto percentual)', '%', 'g') when contains(text, '%') then substr(text, 1, strpos(text, '%') - 1) || ' p.p.' || substr(text, strpos(text, '%') + 1) end}},
  {{'kind': 'inferencia', 'text': text || '{W.CAUSAL}'}}]) as x from documents)
select doc_id, x.kind as kind, md5(x.text) as digest, length(x.text) as length from v where x.kind = 'controle' or x.text <> original
""")
def perturbed_texts(t):
    """What applies of the perturbations to every document."""
    made = t("documents").select("doc_id", F.explode(W.perturbations(F.col("text"))).alias("x"))
    return made.select("doc_id", "x.kind", F.md5("x.text").alias("digest"), F.length("x.text").cast("long").alias("length"))


def _candidates(t):
    """The 20 best documents of every item as nodes; those that hold a digit stand for tables, and what these tell of comes from their ids."""
    kinds = F.array(*[F.lit(x) for x in ("Mensal", "por setor", None, "ANUAL", "")])
    nodes = t("documents").select(
        F.col("doc_id").alias("node_id"), "text", F.when(F.rlike("text", F.lit("[0-9]")), "table").otherwise("text").alias("type"), F.element_at(kinds, (F.col("doc_id") % 5 + 1).cast("int")).alias("granularity"),
        F.when(F.col("doc_id") % 4 > 0, F.round(F.length("text") / 100.0, 2).cast("string")).otherwise("n/a").alias("verdict"),
    )
    return bm25_topk(t).where("rank <= 20").select("query_id", F.col("doc_id").alias("node_id"), F.col("rank").alias("position")).join(nodes, "node_id")


def _numbers(context):
    """An extraction without a model: the numbers with a mark inside that the context holds."""
    return F.array_join(F.regexp_extract_all(context, F.lit(r"[0-9]+[.,][0-9]+"), F.lit(0)), " ")


def _chain_sql(series: bool) -> str:
    temporal = "doc_id % 5 in (0, 3)"
    period = "regexp_matches(context, '(?i)[1-4][oO°]\\s*trim|\\b(19|20)\\d{2}\\b|jan|fev|mar|abr|mai|jun|jul|ago|set|out|nov|dez|\\b(período|data|mês|mes|trimestre|semestre|anual|mensal)\\b')"
    return rf"""
with {BM25_SQL},
c as (select query_id, doc_id, rank as position, regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g') as text, case when doc_id % 4 > 0 then round(length(text) / 100.0::double, 2) end as s from bm25 join documents using (doc_id)
  where rank <= 20 and regexp_matches(text, '[0-9]') and {temporal if series else f"not ({temporal})"}),
f as (select *, row_number() over (partition by query_id, substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 300) order by position) as k from c),
l as (select *, max((s is not null)::int) over (partition by query_id) = 1 as judged from (select *, row_number() over (partition by query_id order by position) as n from f where k = 1) where n <= 60),
p as (select *, row_number() over (partition by query_id order by case when judged then s end desc nulls last, position) as place from l),
u as (select * from p where case when judged then s is not null and place <= 12 else place <= 3 end),
h as (select query_id, list(doc_id order by place) as nodes, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by place) as whole from u group by 1),
x as (select query_id, nodes, case when length(whole) <= 96000 then whole else rtrim(substr(whole, 1, 96000)) || chr(10) || '{X.TRUNCATED.strip()}' end as context from h),
e as (select query_id, nodes, {f"case when {period} then " if series else ""}nullif(trim(array_to_string(regexp_extract_all(context, '[0-9]+[.,][0-9]+'), ' ')), ''){" end" if series else ""} as structured from x)
select query_id, case when nodes is null then 'none' when structured is null then 'nodes' else 'text' end as outcome, nodes::varchar as nodes, structured from (select distinct query_id from bm25) left join e using (query_id)
"""


def _chain(t, series: bool):
    found = chains.structured_chain(_candidates(t), "query_id", series, _numbers, "verdict")
    return found.withColumn("nodes", F.when(F.col("nodes").isNotNull(), F.concat(F.lit("["), F.array_join(F.col("nodes").cast("array<string>"), ", "), F.lit("]"))))


@book.add(_chain_sql(False))
def table_chain(t):
    """Static tables among each item's candidates, reranked, and what their context gives."""
    return _chain(t, False)


@book.add(_chain_sql(True))
def series_chain(t):
    """Temporal tables among each item's candidates; contexts without a period give nodes alone."""
    return _chain(t, True)


@book.add("""
with n as (select lang, doc_id, text, greatest(coalesce(try_cast(case doc_id % 6 when 0 then '0' when 1 then '2' when 2 then 'x' when 4 then '-1' when 5 then '1' end as int), 0), 0) as level from documents where trim(text) <> ''),
k as (select * from (select *, row_number() over (partition by lang, level order by doc_id) as n from n) where n <= 20),
s as (select lang, level, case level when 0 then '[Trechos originais (nível 0)]' else '[Resumos automáticos — nível ' || level || ']' end || chr(10) || string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by doc_id) as part from k group by 1, 2)
select lang, count(*) as levels, md5(string_agg(part, chr(10) || chr(10) order by level desc)) as digest from s group by 1
""")
def level_context(t):
    """Documents of a language in sections by level, 20 of each; what is no whole number from 0 up is level 0."""
    marks = F.array(*[F.lit(x) for x in ("0", "2", "x", None, "-1", "1")])
    nodes = t("documents").select("lang", F.col("doc_id").alias("position"), "text", F.element_at(marks, (F.col("doc_id") % 6 + 1).cast("int")).alias("level"))
    return chains.level_context(nodes, "lang", 20).select("lang", "levels", F.md5("context").alias("digest"))


@book.add(r"""
with a as (select conv_id, turn, length(text) as n, length(text) % 6 as numbers, least(length(text) % 6, length(text) % 4) as proven, (length(text) // 7) % 3 as unsupported, length(text) % 5 = 0 as refused, length(text) % 2 = 0 as sourced,
  (length(text) // 3) % 2 = 0 as named, len(list_filter(regexp_extract_all(text, '[^.!?\n]+(?:[.!?]|$)'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g')) <> '')) as sentences from conversations),
q as (select conv_id, length(text) % 3 = 0 as coverage from conversations where turn = 0),
j as (select q.conv_id, coverage, x, y, z from q join (select conv_id, a as x from a where turn = 1) using (conv_id) left join (select conv_id, a as y from a where turn = 3) using (conv_id) left join (select conv_id, a as z from a where turn = 5) using (conv_id)),
r as (select *, x.numbers > x.proven or x.unsupported > 0 or (x.refused and x.sourced) or (coverage and (x.sentences < 2 or (x.numbers < 4 and x.n < 500))) as recovered from j),
p as (select *, coalesce(recovered and ((x.refused and not y.refused) or (y.numbers = y.proven and y.unsupported = 0 and (y.numbers > 0 or x.unsupported > 0)) or (y.proven > x.proven and y.numbers - y.proven <= x.numbers - x.proven and y.unsupported <= x.unsupported))
  and (not coverage or (y.sentences, y.numbers, y.n) >= (x.sentences, x.numbers, x.n)), false) as takes from r),
h as (select *, case when takes then y else x end as held from p),
g as (select *, (held.refused or (held.unsupported > 0 and held.numbers = 0)) and not (held.refused and recovered and coalesce(y.refused, false)) as again from h)
select conv_id, recovered, again as resynthesised, coalesce(case when again then case
    when coalesce(((not z.refused and z.numbers = z.proven and z.unsupported = 0) or (z.numbers > 0 and z.numbers = z.proven)) and (z.numbers > 0 or held.proven = 0), false) then 'third'
    when coalesce(held.proven = 0 and not z.refused and z.numbers = 0 and z.sourced and z.named, false) then 'names' end end, case when takes then 'second' else 'first' end) as chosen from g
""")
def recovery_choice(t):
    """The first three answers of every conversation as attempts; what is told of them comes from their texts."""
    c = t("conversations")
    n = F.length("text")
    attempt = F.struct(
        (n % 5 == 0).alias("refused"), (n % 2 == 0).alias("sourced"), n.alias("length"), recovery.sentence_count(F.col("text")).alias("sentences"), (n % 6).alias("numbers"), F.least(n % 6, n % 4).alias("proven"),
        (F.floor(n / 7) % 3).cast("int").alias("unsupported"), (F.floor(n / 3) % 2 == 0).alias("named"),
    )
    at = lambda turn: F.max(F.when(F.col("turn") == turn, attempt))
    rows = c.groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, n % 3 == 0)).alias("coverage"), *[at(turn).alias(name) for turn, name in ((1, "first"), (3, "second"), (5, "third"))])
    return recovery.choose(rows.where("first is not null and coverage is not null"), "conv_id", "coverage")


@book.add(r"""
with p as (select conv_id, turn, regexp_extract_all(text, '[^.!?\n]+(?:[.!?]|$)|[^.!?\n]+|[.!?\n]+') as pieces from conversations),
s as (select conv_id, turn, list_transform(pieces, lambda x, i: {'p': x, 't': case when regexp_matches(x, '[^.!?\n]') and (regexp_matches(x, '[.!?]$') or i = len(pieces)) then regexp_replace(x, '^\s+|\s+$', '', 'g') else '' end}) as x from p),
k as (select conv_id, turn, list_filter(x, lambda y: y.t = '' or length(y.t) % 3 > 0) as kept from s)
select conv_id, turn, case when len(list_filter(kept, lambda y: y.t <> '')) > 0 then array_to_string(list_transform(kept, lambda y: y.p), '') else '' end as text from k
""")
def trimmed_answers(t):
    """Every turn without the sentences whose length a third divides, which stand for those without support."""
    found = F.transform(F.regexp_extract_all(F.col("text"), F.lit(r"[^.!?\n]+(?:[.!?]|$)"), F.lit(0)), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    spans = F.array().cast("array<struct<start:int,end:int>>")
    gone = F.filter(found, lambda s: (s != "") & (F.length(s) % 3 == 0))
    return t("conversations").select("conv_id", "turn", recovery.trim_unsupported(F.col("text"), gone, spans).alias("text"))


@book.add()
def stemmed_bm25(t):
    """BM25 over Portuguese stems: each distinct term is stemmed once. Tests hold it against a plain walk."""
    terms = t("documents").select("doc_id", F.explode(X.content_terms(F.col("text"), least=2)).alias("term"))
    stems = with_stems(terms, "term").groupBy("doc_id").agg(F.collect_list("stem").alias("terms"))  # a document's own terms
    asked = with_stems(query_terms(t, least=2), "term").select("query_id", F.col("stem").alias("term")).distinct()
    scores = rank.lexical_scores(stems, asked, size=t("documents").count())
    return rank.rank_by(scores, ["query_id"], [F.col("score").desc(), F.col("doc_id")], 80).select("query_id", "doc_id", "rank", "score")


QUERIES, SQL = book.queries, book.sql
