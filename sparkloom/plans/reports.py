"""Answers and sources rendered from orders, and what is checked, cited and noted in them.

A report is a customer's answer: a sentence with its sum, a table of its orders and one of their
priorities. Its sources are its orders by year, but for those that no source tells of.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import numbers as N
from sparkloom.operators import cited_tables as G
from sparkloom.operators import citations as C
from sparkloom.operators import table_sources as T

from .base import Book

book = Book()
Tables = Callable[[str], DataFrame]


def _orders(t: Tables) -> DataFrame:
    return t("orders").select(
        F.col("o_custkey").alias("answer_id"), F.col("o_orderkey").alias("key"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("priority"),
        N.written_number(F.round("o_totalprice", 2)).alias("price"),
    )


def answers(t: Tables) -> DataFrame:
    """(answer_id, text)."""
    o = _orders(t)
    rows = o.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("key", F.format_string("| %d | %d | %s |", "key", "year", "price").alias("line")))).alias("x"))  # a customer's orders
    kinds = o.groupBy("answer_id", "priority").agg(F.count(F.lit(1)).alias("n"))
    kinds = kinds.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.format_string("| %s | %d |", "priority", "n"))).alias("y"))
    both = rows.join(kinds, "answer_id")
    head = F.format_string("Cliente %d: %d pedidos.\n\n| pedido | ano | valor |\n|---|---|---|\n", "answer_id", F.size("x"))
    middle = F.lit("\n\nPor prioridade, com – e 𝟛:\n| prioridade | pedidos |\n|---|---|\n")
    return both.select("answer_id", F.concat(head, F.array_join("x.line", "\n"), middle, F.array_join("y", "\n"), F.format_string("\nFim de %d.", "answer_id")).alias("text"))


def sources(t: Tables) -> DataFrame:
    """(answer_id, source_id, text, file, page, type): a customer's orders of a year, but for every fifth order."""
    told = _orders(t).where("key % 5 <> 0").groupBy("answer_id", "year").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "price"))), lambda x: F.concat(F.lit("valor de "), x["price"], F.lit(";"))), " ").alias("x"))
    return told.select("answer_id", F.col("year").cast("long").alias("source_id"), F.concat(F.lit("Pedidos: "), "x").alias("text"), F.format_string("dir/pedidos_de-%d.pdf", "year").alias("file"), (F.col("year") % 10).cast("string").alias("page"), F.lit("table").alias("type"))


def places(t: Tables, text: DataFrame) -> DataFrame:
    """(answer_id, key, start, end, raw, verified, derived, source_id, text and what else the reports carry) of the price of every order."""
    row = F.concat(F.lit("| "), F.col("key").cast("string"), F.lit(" | "), F.col("year").cast("string"), F.lit(" | "))
    # By sort and merge: reports stand by answer already, and orders are never broadcast.
    placed = _orders(t).hint("merge").join(text, "answer_id").withColumn("at", F.expr("locate(concat('\n| ', key, ' | ', year, ' | '), text)") + F.length(row))
    return placed.select(
        "answer_id", "key", F.col("at").cast("long").alias("start"), (F.col("at") + F.length("price")).cast("long").alias("end"), F.col("price").alias("raw"), (F.col("key") % 5 != 0).alias("verified"), (F.col("key") % 7 == 0).alias("derived"),
        F.when(F.col("key") % 5 != 0, F.col("year").cast("long")).alias("source_id"), *[c for c in text.columns if c != "answer_id"],
    )


def checks(t: Tables, text: DataFrame) -> DataFrame:
    """(answer_id, start, end, raw, verified, derived, source_id) of the price of every order that a source tells of."""
    return places(t, text).drop("key", "text")


_BASE = r"""
o as (select o_custkey as answer_id, o_orderkey as key, year(o_orderdate) as y, o_orderpriority as priority, translate(format('{:,.2f}', round(o_totalprice, 2)), ',.', '.,') as price from orders),
a as (select answer_id, 'Cliente ' || answer_id || ': ' || n || ' pedidos.' || chr(10) || chr(10) || '| pedido | ano | valor |' || chr(10) || '|---|---|---|' || chr(10) || x || chr(10) || chr(10) || 'Por prioridade, com – e 𝟛:' || chr(10) || '| prioridade | pedidos |' || chr(10) || '|---|---|' || chr(10) || z || chr(10) || 'Fim de ' || answer_id || '.' as text
  from (select answer_id, count(*) as n, string_agg('| ' || key || ' | ' || y || ' | ' || price || ' |', chr(10) order by key) as x from o group by 1)
  join (select answer_id, string_agg(line, chr(10) order by line) as z from (select answer_id, '| ' || priority || ' | ' || count(*) || ' |' as line from o group by answer_id, priority) group by 1) using (answer_id)),
s as (select answer_id, y::bigint as source_id, 'Pedidos: ' || string_agg('valor de ' || price || ';', ' ' order by key) as text, 'pedidos de ' || y || ', p. ' || (y % 10) as label from o where key % 5 <> 0 group by answer_id, y),
c as (select answer_id, key, y, price, strpos(text, chr(10) || '| ' || key || ' | ' || y || ' | ') + length('| ' || key || ' | ' || y || ' | ') as start from o join a using (answer_id)),
l as (select answer_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i from a),
p as (select *, coalesce(sum(length(line) + 1) over (partition by answer_id order by i rows between unbounded preceding and 1 preceding), 0)::bigint as start from l),
g as (select *, i - row_number() over (partition by answer_id order by i) as island from p where regexp_matches(line, '^[ \t]*\|.*\|[ \t]*$')),
spans as (select answer_id, row_number() over (partition by answer_id order by min(start)) - 1 as table_id, min(start) as start, max(start + length(line)) as "end", count(*) as lines from g group by answer_id, island having count(*) >= 2),
numbers as (select distinct answer_id, table_id, n from (select answer_id, table_id, unnest(regexp_extract_all(substr(text, spans.start + 1, spans."end" - spans.start), '\d{1,3}(?:\.\d{3})+(?:,\d+)?|\d+(?:,\d+)?')) as n from spans join a using (answer_id)) where length(n) >= 2 and not (regexp_matches(n, '^\d+$') and try_cast(n as bigint) between 1990 and 2035)),
wanted as (select answer_id, table_id, count(*) as n from numbers group by 1, 2),
runs as (select distinct answer_id, source_id, unnest(regexp_extract_all(text, '(?:^|[^\d.,])(\d+(?:[.,]\d+)*)', 1)) as n from s),
shared as (select answer_id, table_id, source_id, count(*) as shared from numbers join runs using (answer_id, n) group by 1, 2, 3),
loose as (select * from (select answer_id, table_id, source_id, shared, row_number() over (partition by answer_id, table_id order by shared desc, source_id) as place from shared join wanted using (answer_id, table_id) where shared >= case when wanted.n = 1 then 1 else 2 end) where place <= 3)
"""

_NOTES = """
named as (select answer_id, table_id, 0 as kind, c.start as rank, label from c join spans using (answer_id) join s on s.answer_id = c.answer_id and s.source_id = c.y where c.key % 5 <> 0 and c.start >= spans.start and c.start < spans."end"
  union all select answer_id, table_id, 1, place, label from loose join s using (answer_id, source_id)),
firsts as (select answer_id, table_id, label, min(kind * 1000000000 + rank) as first from named group by 1, 2, 3),
notes as (select answer_id, any_value(spans."end") as position, chr(10) || chr(10) || '*Fonte: ' || string_agg(label, '; ' order by first, label) || '.*' as note from firsts join spans using (answer_id, table_id) group by answer_id, table_id)
"""


@book.add(f'with {_BASE} select answer_id, table_id, start, "end", lines from spans')
def table_islands(t):
    """Where the tables of every answer stand."""
    return T.table_spans(answers(t), "answer_id", "text")


@book.add(f"with {_BASE} select answer_id, table_id, source_id, shared, place from loose")
def table_number_sources(t):
    """The sources that hold most of a table's numbers, as whole literals."""
    text = answers(t)
    blocks = T.table_spans(text, "answer_id", "text").join(text, "answer_id").select("answer_id", "table_id", F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")).alias("text"))
    return T.loose_sources(blocks, sources(t), "answer_id")


@book.add(r"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as source_id from documents),
n as (select distinct doc_id, n from (select doc_id, unnest(regexp_extract_all(text, '\d{1,3}(?:\.\d{3})+(?:,\d+)?|\d+(?:,\d+)?')) as n from documents) where length(n) >= 2 and not (regexp_matches(n, '^\d+$') and coalesce(try_cast(n as bigint) between 1990 and 2035, false))),
w as (select doc_id, count(*) as wanted from n group by 1),
r as (select distinct doc_id, source_id, unnest(regexp_extract_all(line, '(?:^|[^\d.,])(\d+(?:[.,]\d+)*)', 1)) as n from l),
s as (select doc_id, source_id, count(*) as shared from n join r using (doc_id, n) group by 1, 2)
select doc_id, source_id, shared, place from (select doc_id, source_id, shared, row_number() over (partition by doc_id order by shared desc, source_id) as place from s join w using (doc_id) where shared >= case when wanted = 1 then 1 else 2 end) where place <= 3
""")
def document_number_lines(t):
    """The lines of every document that hold most of its numbers."""
    docs = t("documents").select("doc_id", F.lit(0).alias("table_id"), "text")
    lines = t("documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "text")).withColumn("source_id", F.col("pos").cast("long"))
    return T.loose_sources(docs, lines, "doc_id").select("doc_id", "source_id", "shared", "place")


@book.add(f"""
with {_BASE}, {_NOTES},
k as (select answer_id, position, note, coalesce(lag(position) over (partition by answer_id order by position), 0) as before, max(position) over (partition by answer_id) as last from notes),
w as (select answer_id, string_agg(substr(text, before + 1, position - before) || note, '' order by position) || substr(any_value(text), any_value(last) + 1) as text from k join a using (answer_id) group by 1)
select a.answer_id, coalesce(w.text, a.text) as text from a left join w using (answer_id)
""")
def table_source_notes(t):
    """Every answer with a source note under each of its tables."""
    text = answers(t)
    notes = T.source_notes(text, checks(t, text), sources(t), "answer_id")
    return T.insert_notes(text, notes, "answer_id")


@book.add(f"""
with {_BASE}, {_NOTES}
select c.answer_id, c.key, c.start + coalesce(sum(length(note)), 0)::bigint as start, c.start + length(price) + coalesce(sum(length(note)), 0)::bigint as "end" from c left join notes on notes.answer_id = c.answer_id and position <= c.start group by c.answer_id, c.key, c.start, price
""")
def shifted_checks(t):
    """Where the checked numbers stand once the notes are in."""
    text = answers(t)
    own = places(t, text)
    notes = T.source_notes(text, own, sources(t), "answer_id")
    return T.shift_spans(own, notes, "answer_id").select("answer_id", "key", "start", "end")


def _cited(t: Tables, text: DataFrame) -> DataFrame:
    """Each checked number as a citation, and beside every third one a span that overlaps it and one whose value is wrong."""
    proven = C.numeric_citations(checks(t, text), sources(t), "answer_id").select("answer_id", "position", "start", "end", "value")
    odd = proven.where("position % 3 = 0")
    wide = odd.join(text, "answer_id").select("answer_id", (1000 + F.col("position")).alias("position"), (F.col("start") - 5).alias("start"), (F.col("end") - 1).alias("end"), C.cut(F.col("text"), F.col("start") - 5, F.col("end") - 1).alias("value"))
    wrong = odd.select("answer_id", (2000 + F.col("position")).alias("position"), (F.col("start") - 6).alias("start"), "end", F.lit("x").alias("value"))
    return proven.unionByName(wide).unionByName(wrong)


@book.add(f"""
with recursive {_BASE},
n as (select answer_id, row_number() over (partition by answer_id order by start) - 1 as position, start, start + length(price) as "end", price as value from c where key % 5 <> 0 and key % 7 <> 0),
cited as (select * from n union all select answer_id, 1000 + position, start - 5, "end" - 1, substr(text, start - 4, "end" - start + 4) from n join a using (answer_id) where position % 3 = 0
  union all select answer_id, 2000 + position, start - 6, "end", 'x' from n where position % 3 = 0),
good as (select cited.*, row_number() over (partition by answer_id order by start, position) as k from cited join a using (answer_id) where value = substr(text, start + 1, "end" - start)),
walk as (
  select answer_id, 0::bigint as k, 0::bigint as cursor, '' as out from a
  union all
  select w.answer_id, g.k, case when g.start >= w.cursor then g."end" else w.cursor end, case when g.start >= w.cursor then w.out || substr(a.text, w.cursor + 1, g.start - w.cursor) || '[' || g.value || '](#numeric-citation-' || g.position || ')' else w.out end
  from walk w join good g on g.answer_id = w.answer_id and g.k = w.k + 1 join a on a.answer_id = w.answer_id),
final as (select answer_id, max_by(out, k) as out, max_by(cursor, k) as cursor from walk group by 1)
select answer_id, out || substr(text, cursor + 1) as text from final join a using (answer_id)
""")
def linked_citations(t):
    """Every answer with its proven numbers as links; spans that overlap or don't hold their value are left alone."""
    text = answers(t)
    return C.link_citations(text, _cited(t, text), "answer_id")


@book.add("""
with o as (select o_orderkey as key, year(o_orderdate) as y, o_orderpriority as priority, translate(format('{:,.2f}', round(o_totalprice, 2)), ',.', '.,') as price from orders)
select key, case when key % 5 = 0 then null when key % 5 in (1, 2) then 'grid' else 'key-value' end as kind, case key % 5 when 1 then 'valor' when 2 then 'Coluna 3' when 3 then priority when 4 then 'Total de ' || y end as subject,
  case key % 5 when 1 then 'pedido=' || key || ';ano=' || y when 2 then 'Coluna 1=' || key || ';Coluna 2=' || y when 3 then 'Ano=' || y when 4 then 'Setor=' || priority || ';Ano=' || y end as qualifiers from o
""")
def cited_cells(t):
    """What a cited price is the value of: in grids with and without a rule, in lists with a generic and a telling label, and in prose."""
    o = _orders(t)
    grid = F.format_string("| pedido | ano | valor |\n|---|:---:|---|\n| 0 | 0 | 0 |\n| %d | %d | %s |", "key", "year", "price")
    bare = F.format_string("%d | %d | %s\n0|0|0", "key", "year", "price")
    generic = F.format_string("Setor: %s\nValor: %s\nAno: %d\nFonte: x.pdf", "priority", "price", "year")
    telling = F.format_string("Setor: %s\n Total de %d : %s\r\nAno: %d\n:x\nvazio:", "priority", "year", "price", "year")
    k = F.col("key") % 5
    shown = F.when(k == 1, grid).when(k == 2, bare).when(k == 3, generic).when(k == 4, telling).otherwise(F.format_string("Foi de %s", "price"))
    told = G.tell_cells(G.read_snippets(o.select("key", "price", shown.alias("text")), "text"), "price")
    joined = F.array_join(F.transform("qualifiers", lambda q: F.concat(q["label"], F.lit("="), q["value"])), ";")
    return told.select("key", "kind", "subject", joined.alias("qualifiers"))


QUERIES, SQL = book.queries, book.sql
