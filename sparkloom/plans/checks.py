"""Checks of answers against sources, text helpers, payloads and conversation windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.functions import numbers as N
from sparkloom.functions import text as X
from sparkloom.operators import policy, state, validate

from .base import Book
from .retrieval import terms_sql

book = Book()
_SENTENCES = r"list_filter(list_transform(regexp_extract_all({}, '[^.!?\n]+(?:[.!?]|$)'), lambda x: trim(x)), lambda x: length(x) >= 24)"


def _brazilian(value: str) -> str:
    """SQL for a number as 1.234,56."""
    return f"translate(format('{{:,.2f}}', {value}), ',.', '.,')"


@book.add("""
with v as (select event_id, case event_id % 6 when 0 then null when 1 then 'nan'::double else value end as v from events),
m as (select event_id, case when v is null or isnan(v) then 0 when v > 1 then least(v / 10, 1) else greatest(v, 0) end as m from v),
t as (select event_id, m::double::varchar::decimal(30, 20) * 100 as t from m)
select event_id, ((case when t - floor(t) > 0.5 or (t - floor(t) = 0.5 and floor(t)::bigint % 2 = 1) then floor(t) + 1 else floor(t) end)::bigint / 100.0::double)::double as score from t
""")
def score_normalise(t):
    v = F.when(F.col("event_id") % 6 == 0, None).when(F.col("event_id") % 6 == 1, float("nan")).otherwise(F.col("value"))
    return t("events").select("event_id", X.relevance(v).alias("score"))


@book.add(f"""
with said as (select conv_id, unnest(l) as sentence, unnest(range(len(l))) as sentence_idx from (select conv_id, {_SENTENCES.format("text")} as l from conversations where turn = 1)),
w as (select conv_id, sentence_idx, unnest(list_distinct({terms_sql("sentence")})) as term from said),
known as (select distinct conv_id, unnest({terms_sql("text")}) as term, 1 as known from conversations where turn <> 1),
f as (select conv_id, sentence_idx, count(*) as n, count(known) as k from w left join known using (conv_id, term) group by 1, 2),
x as (select conv_id, sentence_idx, coalesce(n, 0) as n, coalesce(k, 0) as k from said left join f using (conv_id, sentence_idx))
select conv_id, sentence_idx, n as terms, case when n < 3 then 0 else n - k end as missing, case when n < 3 then 1.0::double else round(k / n::double, 2) end as support,
  n < 3 or (k / n::double >= 0.72 and n - k <= 3) as verified from x
""")
def argument_support(t):
    """Sentences of each conversation's first answer against the words of its other turns."""
    c = t("conversations")
    found = validate.argument_support(c.where("turn = 1").select("conv_id", "text"), "conv_id", "text", c.where("turn <> 1").select("conv_id", "text"), "text")
    return found.select("conv_id", "sentence_idx", "terms", "missing", F.round(F.when(F.col("terms") < 3, 1.0).otherwise((F.col("terms") - F.col("missing")) / F.col("terms")), 2).alias("support"), "verified")


@book.add("""
with m as (select o_orderkey as key, round(o_totalprice, 2) as a, round(lead(o_totalprice) over (order by o_orderkey), 2) as b from orders)
select key, case when key % 2 = 0 then b < a else b > a end as conflict from m where b is not null
""")
def direction_conflicts(t):
    """Sentences 'rose/fell from X to Y' with planted directions; each order is compared with the one that follows it."""
    o = t("orders").select("o_orderkey", "o_totalprice")
    following = o.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("o_totalprice").alias("b"))
    pairs = o.join(following, "o_orderkey")
    verb = F.when(F.col("o_orderkey") % 2 == 0, "cresceu").otherwise("recuou")
    said = F.concat(F.lit("O total "), verb, F.lit(" de R$ "), N.written_number(F.round("o_totalprice", 2)), F.lit(" para R$ "), N.written_number(F.round("b", 2)), F.lit(" no mês."))
    return pairs.select(F.col("o_orderkey").alias("key"), validate.direction_conflict(said).alias("conflict"))


@book.add("""
select l_orderkey as order_key, l_linenumber as line, case when (l_orderkey + l_linenumber) % 3 = 0 then 0 else 1 end as holding from lineitem
""")
def derived_equations(t):
    """'a - b = c' over known numbers, every third with a wrong result."""
    a, b = F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_quantity").cast("decimal(18,2)")
    wrong = (F.col("l_orderkey") + F.col("l_linenumber")) % 3 == 0
    c = a - b + F.when(wrong, F.lit("1.07").cast("decimal(18,2)")).otherwise(F.lit("0").cast("decimal(18,2)"))
    # In steps, so that a number is written once a row.
    rows = t("lineitem").select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"), *[N.written_number(v).alias(n) for v, n in ((a, "x"), (b, "y"), (c, "z"))])
    said = F.concat(F.lit("A diferença: "), "x", F.lit(" - "), "y", F.lit(" = "), "z")
    rows = rows.select("order_key", "line", said.alias("said"), F.array(N.plain_number(F.col("x")), N.plain_number(F.col("y"))).alias("known"))
    return rows.select("order_key", "line", F.size(validate.derived_results(F.col("said"), F.col("known"))).alias("holding"))


@book.add("""
with g as (select o_custkey as key, o_totalprice as value, o_orderkey % 3 as decimals, o_orderkey % 2 = 0 as is_pct from orders),
s as (select o_custkey as key, round(o_totalprice + case when o_orderkey % 5 = 0 then 70 else 0.11 end, 2) as value, o_orderkey % 4 <> 1 and o_orderkey % 2 = 0 as is_pct from orders),
h as (select key, count(*) as m from g where exists (select 1 from s where s.key = g.key and s.is_pct = g.is_pct and abs(s.value - g.value) <= 0.5 * power(10.0, -g.decimals) + 1e-9) group by 1)
select key, count(*) as gold, coalesce(any_value(m), 0) as matched from g left join h using (key) group by 1
""")
def band_match(t):
    """Gold numbers that some number said equals to half a unit of their last decimal."""
    k = F.col("o_orderkey")
    g = t("orders").select(F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("value"), (k % 3).alias("decimals"), (k % 2 == 0).alias("is_pct"))
    said = F.round(F.col("o_totalprice") + F.when(k % 5 == 0, 70.0).otherwise(0.11), 2)
    s = t("orders").select(F.col("o_custkey").alias("key"), said.alias("value"), ((k % 4 != 1) & (k % 2 == 0)).alias("is_pct"))
    return validate.band_match(g, s, "key")


@book.add("""
with n as (select *, row_number() over (partition by conv_id order by turn desc) as k from conversations), r as (select * from n where k <= 12),
u as (select *, 2000 - coalesce(sum(length(text)) over (partition by conv_id order by turn desc rows between unbounded preceding and 1 preceding), 0) as room from r)
select conv_id, turn, case when length(text) <= room then text else right(text, room::bigint) end as shown from u where room > 0
""")
def history_window(t):
    return state.fit_recent(t("conversations"), "conv_id", "turn", "text", 12, 2000).select("conv_id", "turn", "shown")


@book.add("""
with l as (select conv_id, max(turn) filter (where role = 'user') as last from conversations group by 1)
select conv_id, 'Histórico:' || chr(10) || string_agg(role || ': ' || text, chr(10) order by turn) filter (where turn < last) || chr(10) || chr(10) || 'Pergunta:' || chr(10) || max(case when turn = last then text end) as context
from conversations join l using (conv_id) group by conv_id having count(*) filter (where turn < last) > 0
""")
def chat_context(t):
    """The turns before a conversation's last question, and the question behind them."""
    last = Window.partitionBy("conv_id")
    c = t("conversations").withColumn("last", F.max(F.when(F.col("role") == "user", F.col("turn"))).over(last))
    before = F.when(F.col("turn") < F.col("last"), F.struct("turn", F.concat("role", F.lit(": "), "text").alias("line")))
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(before)).alias("lines"), F.max(F.when(F.col("turn") == F.col("last"), F.col("text"))).alias("asked"))  # a conversation's turns
    joined = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    return g.where(F.size("lines") > 0).select("conv_id", F.concat(F.lit("Histórico:\n"), joined, F.lit("\n\nPergunta:\n"), "asked").alias("context"))


@book.add(f"select doc_id, case when length(text) <= 400 then text else rtrim(substr(text, 1, 400)) || chr(10) || '{X.TRUNCATED.strip()}' end as shown from documents")
def context_budget(t):
    return t("documents").select("doc_id", X.limit_context(F.col("text"), 100).alias("shown"))


@book.add("""
select event_id, event_id % 4 in (0, 1) as ok, case when event_id % 4 in (0, 1) then json_extract_string(props, '$.k')::bigint end as k from events
""")
def json_payload_validate(t):
    """Objects bare, fenced or between words; lists and text without braces are none."""
    e = F.col("event_id") % 4
    raw = F.when(e == 0, F.concat(F.lit("Result: "), "props", F.lit(" as asked"))).when(e == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(e == 2, "no object").otherwise("[1, 2]")
    found = policy.json_object(X.strip_fence(raw))
    return t("events").select("event_id", found.isNotNull().alias("ok"), F.try_variant_get(found, "$.k", "bigint").alias("k"))


@book.add("""
select event_id, case when event_id % 7 < 2 then null else value end as value from events
""")
def nan_to_null(t):
    v = F.when(F.col("event_id") % 7 == 0, float("nan")).when(F.col("event_id") % 7 == 1, float("inf")).otherwise(F.col("value"))
    e = t("events").select("event_id", v.alias("value"))
    return e.select("event_id", N.finite(F.col("value")).alias("value"))


@book.add(f"""
select o_orderkey as key, round(o_totalprice, 2) as comma, floor(o_totalprice) / 1000 as dots_kept, floor(o_totalprice)::double as dots_dropped
from orders where o_totalprice >= 1000 and o_totalprice < 1000000
""")
def number_readings(t):
    """'1.234' is 1.234 where only a comma makes dots thousands, and 1234 where all dots are."""
    whole = F.floor("o_totalprice")
    written = F.translate(F.format_number(whole, 0), ",", ".")
    o = t("orders").where("o_totalprice >= 1000 and o_totalprice < 1000000")
    return o.select(
        F.col("o_orderkey").alias("key"), N.parse_decimal(N.written_number(F.round("o_totalprice", 2))).cast("double").alias("comma"),
        N.parse_decimal(written).cast("double").alias("dots_kept"), N.thousands_decimal(written).cast("double").alias("dots_dropped"),
    )


QUERIES, SQL = book.queries, book.sql
