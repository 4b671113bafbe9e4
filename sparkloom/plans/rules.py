"""Rules on texts: what questions ask for, what answers may show, routes, payloads, labels, numbers and citations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions import numbers as N
from sparkloom.functions import text as X
from sparkloom.operators import policy, recovery, tables, validate

from . import reports
from .base import Book

book = Book()


def _picked(values: Sequence, at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


def _list(values: Sequence) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower() for v in values) + "]"


def _any_sql(text: str, phrases: Sequence[str]) -> str:
    return f"len(list_filter({_list(phrases)}, lambda p: contains(lower({text}), p))) > 0"


# What is put behind a turn, so that every rule meets texts that it holds for and texts that come close.
_REMARKS = (
    "Não consta nos documentos.", "nao consta nos documentos", "NÃO ENCONTREI nada", "não está disponível", "não fornecem evidência suficiente", "Não é possível determinar com segurança", "Quais fontes foram usadas?",
    "de onde veio isso", "onde esse dado consta?", "origem da informação", "as fontes do rio", "quais regiões cresceram", "Compare os setores", "evolução por trimestre", "regiões com dinamismo", "compare",
    "um resumo", "panorama", "relação e impacto", "emprego formal", "taxa da PNAD", "rendimento", "CLT", "não tenho informação", "série histórica dos preços por ano", "nada disso", "Liste os PDFs",
)
_SAID = f"(select conv_id, turn, text || ' ' || {_list(_REMARKS)}[(conv_id * 7 + turn) % {len(_REMARKS)} + 1] as said from conversations)"


@book.add(f"""
select conv_id, turn, {_any_sql("said", policy.REFUSALS_EVALUATION)} as refused, {_any_sql("said", policy.REFUSALS_GATE)} as gate, regexp_matches(said, '(?i){recovery.COMPLETE_COVERAGE.removeprefix("(?iu)")}') as coverage,
  {" or ".join(f"regexp_matches(said, '(?i){p}')" for p in policy.SOURCE_REQUESTS)} as sources, {_any_sql("said", policy.LABOUR_SKILL)} as labour_skill, {_any_sql("said", policy.LABOUR_INTERPRETER)} as labour_interpreter,
  case when {_any_sql("said", policy.COMPARING)} then 'comparativo' when {_any_sql("said", policy.SUMMARISING)} then 'ampla' when {_any_sql("said", policy.RELATING)} then 'multi_hop' else 'pontual' end as kind from {_SAID}
""")
def question_flags(t):
    """Every turn, with a remark behind it: refusals by both lists, whole coverage, sources, labour market by both lists, kind."""
    said = t("conversations").select("conv_id", "turn", F.concat("text", F.lit(" "), _picked(_REMARKS, F.col("conv_id") * 7 + F.col("turn"))).alias("said"))
    q = F.col("said")
    return said.select(
        "conv_id", "turn", policy.holds_any(q, policy.REFUSALS_EVALUATION).alias("refused"), policy.holds_any(q, policy.REFUSALS_GATE).alias("gate"), recovery.wants_coverage(q).alias("coverage"),
        policy.asks_for_sources(q).alias("sources"), policy.holds_any(q, policy.LABOUR_SKILL).alias("labour_skill"), policy.holds_any(q, policy.LABOUR_INTERPRETER).alias("labour_interpreter"), policy.classify_question(q)["query_type"].alias("kind"),
    )


_TYPES, _NEEDS, _LEVELS, _AIMS, _SURE = (*policy.ALLOWED["query_type"], "outro"), ("lexical", "semantica", "hibrida", ""), ("baixa", "media", "alta", "7"), ("precisao", "abrangencia", "x"), ("0.9", "0.2", "1.7", "-3", "null", "0.5")
_CLASSIFIED = f"""
p as (select c_custkey as id, {_list(_TYPES)}[c_custkey % {len(_TYPES)} + 1] as ty, {_list(_NEEDS)}[c_nationkey % {len(_NEEDS)} + 1] as ne, {_list(_LEVELS)}[c_custkey % {len(_LEVELS)} + 1] as le, {_list(_AIMS)}[c_custkey % {len(_AIMS)} + 1] as ai,
  c_custkey % 3 = 0 as hops, c_nationkey % 5 > 0 as scope, {_list(_SURE)}[c_custkey % {len(_SURE)} + 1] as su from customer),
c as (select id, case when ty = 'outro' then 'pontual' else ty end as ty, case when ne = '' then 'hibrida' else ne end as ne, case when le = '7' then 'media' else le end as le, case when ai = 'x' then 'precisao' else ai end as ai, hops, scope,
  greatest(least(case when su = 'null' then 0.5 else su::double end, 1.0), 0.0) as sure from p),
s(pos, strategy, good_for, priority, retrieval, complexity) as (values {", ".join(f"({i}, '{k}', {', '.join(_list(x) for x in rest)})" for i, (k, *rest) in enumerate(policy.STRATEGIES))}),
x as (select c.*, pos, strategy, 3.0::double * list_contains(good_for, ty)::int + 2 * (hops and list_contains(good_for, 'multi_hop'))::int + list_contains(priority, ai)::int + list_contains(retrieval, ne)::int + list_contains(complexity, le)::int as score from c, s),
r as (select *, row_number() over (partition by id order by score desc, pos) as place from x)
"""


def _questions(t):
    """Customers as questions, each with the text of a classification; some of what it says isn't known."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    raw = F.concat(
        F.lit('```json\n{"query_type": "'), _picked(_TYPES, k), F.lit('", "retrieval_need": "'), _picked(_NEEDS, n), F.lit('", "complexity": '), F.when(_picked(_LEVELS, k) == "7", F.lit("7")).otherwise(F.concat(F.lit('"'), _picked(_LEVELS, k), F.lit('"'))),
        F.lit(', "priority": "'), _picked(_AIMS, k), F.lit('", "needs_multi_hop": '), (k % 3 == 0).cast("string"), F.lit(', "in_scope": '), (n % 5 > 0).cast("string"), F.lit(', "confidence": '), _picked(_SURE, k), F.lit("}\n```"),
    )
    read = t("customer").select(k.alias("id"), policy.json_object(raw).alias("payload"))
    return read.select("id", policy.classification(F.col("payload")).alias("classification"))


@book.add(f"with {_CLASSIFIED} select id, strategy, score, place from r")
def route_scores(t):
    """Every strategy's fit with every question."""
    return policy.route_scores(_questions(t), "id")


@book.add(f"""
with {_CLASSIFIED}, two as (select id, any_value(sure) as sure, any_value(scope) as scope, max(case when place = 1 then strategy end) as a, max(case when place = 2 then strategy end) as b, max(case when place = 1 then score end) - max(case when place = 2 then score end) as margin from r group by 1),
m as (select *, case when not scope and sure >= 0.75 then 'refuse' when margin < 1 or sure < 0.45 then 'multi' else 'single_best' end as mode from two)
select id, mode, case mode when 'refuse' then '' when 'multi' then a || '+' || b else a end as engines, margin, case when mode = 'refuse' then sure else round_even(0.6 * sure + 0.4 * least(margin / 3, 1.0), 3) end as confidence from m
""")
def routes(t):
    """Which strategies answer a question: the best, two where the choice is close, none out of scope."""
    return policy.route(_questions(t), "id", several=True).withColumn("engines", F.array_join("engines", "+"))


@book.add(f"""
with {_CLASSIFIED}, h(strategy, up) as (values ('hybrid', true), ('hierarchical', true), ('tools', true), ('reflective', false))
select id, strategy, row_number() over (partition by id order by place) as turn from r join h using (strategy) where up and not (place = 1 and id % 2 = 0)
""")
def failover_order(t):
    """What is left to try: strategies in good health, but for the first of every second question, which has failed."""
    ranked = policy.route_scores(_questions(t), "id")
    tried = ranked.where("place = 1 and id % 2 = 0")
    reports_ = ('{"status": "ok"}', '{"engine_ready": true}', "{}", '{"status": "ok", "engine_ready": false}')
    health = tried.sparkSession.range(4).select(_picked([s[0] for s in policy.STRATEGIES], F.col("id")).alias("strategy"), _picked(reports_, F.col("id")).alias("payload"))
    return policy.failover_order(ranked, tried, health, "id")


_SOURCES = ("tables", "web", "text", "timeseries", "graph")


@book.add(f"""
with a as (select event_id, [{_list(_SOURCES)}[event_id % 5 + 1], {_list(_SOURCES)}[user_id % 5 + 1], {_list(_SOURCES)}[length(event_type) % 5 + 1]] as asked from events),
k as (select event_id, list_filter(asked, lambda x: x <> 'web') as known from a), w as (select event_id, case when list_contains(known, 'text') then known else list_concat(['text'], known) end as x from k)
select event_id, array_to_string(case when list_contains(x, 'tables') and not list_contains(x, 'timeseries') then list_concat(x, ['timeseries']) else x end, ',') as chosen from w
""")
def chosen_sources(t):
    """Sources that three columns name: known ones in order, text always, series wherever tables are."""
    asked = F.array(_picked(_SOURCES, F.col("event_id")), _picked(_SOURCES, F.col("user_id")), _picked(_SOURCES, F.length("event_type")))
    return t("events").select("event_id", F.array_join(policy.chosen_sources(asked), ",").alias("chosen"))


# (before, behind, what is left behind): a turn is put between the first two.
_DRESSES = (
    ("", "", ""), ("No entanto, ", "", ""), ("", " (fonte: relatório anual.pdf, p. 3)", ""), ("", "\nFonte: relatório.pdf, página 2", ""), ("", "\n\n## Fontes\n- relatorio.pdf, p. 4\n\n* outro.csv", ""), ("O trecho recuperado traz chunks. ", "", ""),
    ("", " [1, 2]", ""), ("Segundo o documento anual, ", "", ""), ("", " " + recovery.REFUSAL, ""), ("", "\nValor de R$ 4. 038 e 2,0 p. p. acima", "\nValor de R$ 4.038 e 2,0 p.p. acima"), ("", "\n- planilha.xlsx com dados", ""), ("", "\n\n\n\nFim ( , ) .", "\n\nFim."),
    ("", " (veja dados_2020.csv agora)", ""), ("por outro lado: ", "\nDocumentos: a, b", ""),
)
_K = f"(conv_id * 3 + turn) % {len(_DRESSES)}"


def _values(column: int) -> str:
    return "[" + ", ".join("'" + d[column].replace("\n", "' || chr(10) || '") + "'" for d in _DRESSES) + "]"


@book.add(rf"""
with l as (select conv_id, turn, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i, {_values(2)}[{_K} + 1] as behind from conversations),
k as (select conv_id, turn, coalesce(string_agg(line, chr(10) order by i) filter (where not regexp_matches(line, '(?i)^\s*(?:[-*]\s*)?(?:\*{{0,2}})?(?:fonte|documento|p[áa]gina|aba)')), '') || any_value(behind) as text from l group by 1, 2),
s as (select conv_id, turn, regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+([,.;:!?])', '\1', 'g'), '[ \t]{{2,}}', ' ', 'g'), '^[ \t\n,;:-]+|[ \t\n,;:-]+$', '', 'g') as text from k)
select conv_id, turn, case when text = '' then '{recovery.REFUSAL}' else upper(substr(text, 1, 1)) || substr(text, 2) end as answer from s
""")
def answer_sanitiser(t):
    """Every turn, dressed up with what an answer must not show."""
    k = F.col("conv_id") * 3 + F.col("turn")
    raw = F.concat(_picked([d[0] for d in _DRESSES], k), "text", _picked([d[1] for d in _DRESSES], k))
    return t("conversations").select("conv_id", "turn", policy.sanitise_answer(raw).alias("answer"))


@book.add(rf"""
with d as (select doc_id, text, source, lower(text) as low, lang || '/' || source || '_doc-' || doc_id || '.v2.txt' as path, strpos(text, ' ') - 1 as pos from documents),
r as (select *, regexp_replace(regexp_replace('https://user:pw@h.example/' || doc_id || '?k=' || doc_id || ' ' || text, '(https?://)[^/@\s]+@', '\1', 'g'), '(https?://[^\s?#]+)[?#]\S*', '\1', 'g') as bare from d)
select doc_id, md5(regexp_replace(bare, '(?i)\b(api[_-]?key|token|secret|password)(\s*[=:]\s*)\S+', '\1\2[redacted]', 'g')) as redacted, md5(trim(regexp_replace(translate(low, '{X.ACCENTED}', '{X.PLAIN}'), '\s+', ' ', 'g'))) as plain,
  source || ' doc ' || doc_id || '.v2, p. ' || (doc_id % 9) as label, '...' || trim(substr(text, greatest(pos - 60, 0) + 1, least(length(text), pos + 1 + 60) - greatest(pos - 60, 0))) || '...' as around,
  regexp_matches(translate(low, '{X.ACCENTED}', '{X.PLAIN}'), '(^|[^\p{{L}}\p{{M}}\p{{N}}_])token($|[^\p{{L}}\p{{M}}\p{{N}}_])') as has_word, md5(trim(text)) as unfenced from r
""")
def text_helpers(t):
    """Every whole document: secrets redacted, folded, labelled, cut around its first blank, looked through for a word, unfenced."""
    text, key = F.col("text"), F.col("doc_id").cast("string")
    url = F.concat(F.lit("https://user:pw@h.example/"), key, F.lit("?k="), key, F.lit(" "), text)
    return t("documents").select(
        "doc_id", F.md5(X.redact(url)).alias("redacted"), F.md5(X.normalise(text)).alias("plain"), X.source_label(F.concat("lang", F.lit("/"), "source", F.lit("_doc-"), key, F.lit(".v2.txt")), (F.col("doc_id") % 9).cast("string")).alias("label"),
        X.snippet(text, F.expr("locate(' ', text) - 1"), F.lit(1)).alias("around"), X.contains_word(text, F.lit("Token")).alias("has_word"), F.md5(X.strip_fence(F.concat(F.lit("```json\n"), F.trim(text), F.lit("\n```")))).alias("unfenced"),
    )


@book.add(rf"""
with {reports._BASE},
n as (select answer_id, regexp_extract_all(text, '[-−]?(?:\p{{Nd}}{{1,3}}(?:\.\p{{Nd}}{{3}})+(?:,\p{{Nd}}+)?|\p{{Nd}}+,\p{{Nd}}+|\p{{Nd}}+)(?:\s*%)?') as x, text from a),
b as (select c_custkey as answer_id, c_custkey % 40 as p, c_nationkey as w from customer)
select answer_id, len(x) as tokens, len(list_filter(x, lambda y: regexp_matches(y, '^[0-9]+$') and coalesce(try_cast(y as int) between 1990 and 2035, false))) as years, length(text) as length, least(greatest(2, floor(sqrt(len(x)))), len(x) // 2)::bigint as fan_out,
  array_to_string(list_sort(list_distinct(list_concat(list_transform(range(p, p + w + 1), lambda i: i::varchar), [(p + 500)::varchar, (p + 900)::varchar, p::varchar, (p + w)::varchar]))), ',') as pages,
  greatest(least(case when w % 3 = 0 then 80 else w * 20 end, 200), 20)::bigint as bounded, case when p % 2 = 0 then least(2 * abs(p / 40.0::double - 0.5), 1.0) else least(w / 20.0::double, 1.0) end as decided from n join b using (answer_id)
""")
def number_helpers(t):
    """Numbers and years of every report, page lists, settings and decisiveness from the customer's own columns."""
    found = reports.answers(t).join(t("customer").select(F.col("c_custkey").alias("answer_id"), (F.col("c_custkey") % 40).alias("p"), F.col("c_nationkey").alias("w")), "answer_id")
    tokens = N.number_tokens(F.col("text"))
    pages = F.format_string("p. %d–%d, %d e %d-%d", "p", F.col("p") + F.col("w"), F.col("p") + 500, F.col("p"), F.col("p") + 900)
    raw = F.when(F.col("w") % 3 == 0, "x").otherwise((F.col("w") * 20).cast("string"))
    return found.select(
        "answer_id", F.size(tokens).cast("long").alias("tokens"), F.size(F.filter(tokens, lambda n: N.is_year(n))).cast("long").alias("years"), F.length("text").cast("long").alias("length"), N.fan_out(F.size(tokens)).alias("fan_out"),
        F.array_join(F.array_sort(N.pages_of(pages)), ",").alias("pages"), N.bounded(raw, 80, 20, 200).cast("long").alias("bounded"),
        N.decisiveness(F.when(F.col("p") % 2 == 0, "noul").otherwise("choice"), F.col("p") / 40, F.col("w") / 20).alias("decided"),
    )


_GRAINS = ("", "MENSAL", "por setor", "Ano a Ano", "Diário", "diario", "quinzenal")


@book.add(f"""
with g as (select doc_id, case when doc_id % 4 = 0 then 'text' when doc_id % 9 = 0 then null else 'table' end as kind, case when doc_id % 11 > 0 then substr(text, 1, 30) || {_list(_GRAINS)}[doc_id % 7 + 1] end as grain from documents),
f as (select *, coalesce(kind = 'table', false) as is_table, coalesce({_any_sql("grain", tables.TEMPORAL_WORDS)}, false) as named from g)
select doc_id, is_table and named as temporal, is_table and not named as static, kind is distinct from 'table' as narrative from f
""")
def table_kinds(t):
    """Nodes with a granularity of their own text: series, static tables, and what the text path keeps."""
    k = F.col("doc_id")
    kind = F.when(k % 4 == 0, "text").when(k % 9 == 0, None).otherwise("table")
    grain = F.when(k % 11 > 0, F.concat(F.substring("text", 1, 30), _picked(_GRAINS, k)))
    return t("documents").select("doc_id", tables.is_temporal(kind, grain).alias("temporal"), tables.is_static(kind, grain).alias("static"), tables.is_narrative(kind).alias("narrative"))


@book.add("""
with f as (select o_custkey as key, case o_custkey % 3 when 0 then case when o_orderkey % 50 = 0 then null else year(o_orderdate)::varchar end when 1 then round(o_totalprice)::bigint::varchar else o_orderpriority end as first from orders)
select key, count(*) >= 2 and case when max(case when first is not null and try_cast(first as double) is null then 1 else 0 end) = 1 then true else bool_and(coalesce(try_cast(first as double) between 1900 and 2100, false)) end as valid from f group by 1
""")
def series_validity(t):
    """A customer's orders as a table: its first column is years (some missing), amounts or words."""
    k = F.col("o_custkey") % 3
    first = F.when(k == 0, F.when(F.col("o_orderkey") % 50 > 0, F.year("o_orderdate").cast("string"))).when(k == 1, F.round("o_totalprice").cast("long").cast("string")).otherwise(F.col("o_orderpriority"))
    return tables.valid_series(t("orders").select(F.col("o_custkey").alias("key"), first.alias("first")), "key", "first", 2)


@book.add("""
select user_id as key, user_id % 7 not in (2, 3, 4) as ok, case user_id % 7 when 2 then 'ragged' when 3 then 'columns repeat' when 4 then 'nested' end as reason,
  case when user_id % 7 in (2, 3, 4) then null when user_id % 7 = 0 then 'at,kind' else 'kind,at' end as columns, case when user_id % 7 not in (2, 3, 4) then count(*) end as rows, case when user_id % 7 not in (2, 3, 4) then min(event_id)::varchar end as first from events group by 1 having count(*) <= 500
""")
def tabular_payloads(t):
    """A user's events as a payload: rows as objects or lists under several names; some ragged, nested or with columns twice."""
    k = F.col("user_id") % 7
    rows = F.array_sort(F.collect_list(F.struct(F.col("event_id").alias("at"), F.col("event_type").alias("kind"))))
    g = t("events").groupBy("user_id").agg(rows.alias("x"), F.count(F.lit(1)).alias("n")).where("n <= 500")  # what a payload may hold
    lists = lambda cell: F.concat(F.lit("["), F.array_join(F.transform("x", cell), ","), F.lit("]"))
    row = lambda x, extra="": F.concat(F.lit('["'), x["kind"], F.lit('",'), x["at"].cast("string"), F.lit(extra + "]"))
    last = F.col("x")[F.size("x") - 1]["at"]
    odd = lambda extra: lists(lambda x: F.when(x["at"] == last, row(x, extra)).otherwise(row(x)))
    nested = lists(lambda x: F.concat(F.lit('["'), x["kind"], F.lit('",['), x["at"].cast("string"), F.lit("]]")))
    text = (
        F.when(k == 0, F.concat(F.lit('{"linhas": '), F.to_json("x"), F.lit("}"))).when(k == 2, F.concat(F.lit('{"columns": ["kind", "at"], "rows": '), odd(",1"), F.lit("}")))
        .when(k == 3, F.concat(F.lit('{"columns": ["at", "at"], "rows": '), lists(lambda x: row(x)), F.lit("}"))).when(k == 4, F.concat(F.lit('{"columns": ["kind", "at"], "rows": '), nested, F.lit("}")))
        .when(k == 5, F.concat(F.lit('Segue: {"colunas": ["kind", "at"], "registros": '), lists(lambda x: row(x)), F.lit("} fim"))).otherwise(F.concat(F.lit('```json\n{"headers": ["kind", "at"], "series": '), lists(lambda x: row(x)), F.lit("}\n```")))
    )
    p = policy.tabular_payloads(g.select(F.col("user_id").alias("key"), policy.json_object(text).alias("payload")), "payload")
    good = lambda c: F.when(F.col("ok"), c)
    at = F.greatest(F.array_position("columns", F.lit("at")).cast("int"), F.lit(1))
    return p.select("key", "ok", "reason", good(F.array_join("columns", ",")).alias("columns"), good(F.size("rows").cast("long")).alias("rows"), good(F.element_at(F.col("rows")[0], at)).alias("first"))


@book.add("""
with o as (select o_custkey as answer_id, year(o_orderdate) as y, max((o_orderkey % 5 <> 0)::int) = 1 as told from orders group by 1, 2),
c as (select answer_id, y, unnest([{'k': 0, 'ok': true}, {'k': 1, 'ok': true}, {'k': 2, 'ok': false}, {'k': 3, 'ok': true}]) as x, told from o)
select answer_id, (row_number() over (partition by answer_id order by y, x.k) - 1)::bigint as position, told and x.ok as verified from c
""")
def citation_check(t):
    """A report's citations of its years: plain, in bold with folders and a page list, with a range that goes beyond, without a page."""
    years = t("orders").select(F.col("o_custkey").alias("answer_id"), F.year("o_orderdate").alias("y")).distinct()
    said = F.format_string("Em %d (Fonte: pedidos_de-%d.pdf, p. %d) e (**Fonte:** `DIR\\Pedidos_de-%d.pdf`, página %d, %d); (fonte: pedidos_de-%d.pdf, p. %d–%d), (Fonte: dir/pedidos_de-%d.pdf).", "y", "y", F.col("y") % 10, "y", F.col("y") % 10, F.col("y") % 10, "y", F.col("y") % 10, F.col("y") % 10 + 1, "y")
    texts = years.groupBy("answer_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", said.alias("s")))), lambda x: x["s"]), "\n").alias("text"))  # a customer's years
    return validate.citation_check(texts, reports.sources(t)).select("answer_id", "position", "verified")


@book.add("""
with o as (select o_custkey as answer_id, o_orderkey as k, translate(format('{:,.2f}', round(o_totalprice, 2)), ',.', '.,') as price from orders),
d as (select *, count(*) over (partition by answer_id, price) as same from o),
m as (select answer_id, k, price, unnest(range(case when answer_id % 4 = 0 then 1 when k % 3 = 0 then 2 else 1 end)) as n from d where same = 1)
select answer_id, price as raw, count(*) as mentions, sum(case when answer_id % 4 = 0 then 0 when k % 5 <> 0 and k % 7 <> 0 and n = 0 then 1 else 0 end)::bigint as verified, bool_and(answer_id % 4 > 0) as applicable from m group by 1, 2
""")
def verify_numbers(t):
    """Answers with a price for every order of a customer, every third said twice though a source has it once; sources that lack
    some orders or tell them of another year; every fourth customer's answer refuses and echoes its question."""
    k = F.col("o_orderkey")
    price = N.written_number(F.round("o_totalprice", 2))
    o = t("orders").select(F.col("o_custkey").alias("answer_id"), k.alias("k"), price.alias("price"))
    once = F.format_string("Em 2021 a receita de exportação foi de %s reais.", "price")
    told = F.when(F.col("answer_id") % 4 == 0, F.format_string("Não há dados sobre %s reais.", "price")).when(F.col("k") % 3 == 0, F.concat(once, F.lit(" "), once)).otherwise(once)
    asked = F.format_string("E %s?", "price")
    texts = o.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("k", told.alias("said"), asked.alias("asked")))).alias("x"))  # a customer's orders
    answers = texts.select("answer_id", F.array_join("x.said", " ").alias("text"), F.array_join("x.asked", " ").alias("question"))
    source = F.format_string("Em %d a exportação teve receita de %s reais.", F.when(F.col("k") % 7 == 0, 2019).otherwise(2021), "price")
    sources = o.where("k % 5 <> 0").select("answer_id", F.col("k").alias("source_id"), source.alias("text"))
    alone = o.groupBy("answer_id", "price").agg(F.count(F.lit(1)).alias("same")).where("same = 1").select("answer_id", F.col("price").alias("raw"))
    found = validate.verify_numbers(answers, sources).join(alone.hint("merge"), ["answer_id", "raw"], "left_semi")
    return found.groupBy("answer_id", "raw").agg(F.count(F.lit(1)).alias("mentions"), F.count_if("verified").alias("verified"), F.bool_and("applicable").alias("applicable"))


QUERIES, SQL = book.queries, book.sql
