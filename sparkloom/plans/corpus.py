"""Corpus profiles, ingest statistics, table chunking and synchronisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import numbers as N
from sparkloom.functions import text as X
from sparkloom.operators import sync, tables

from .base import Book

book = Book()


@book.add("""
select lang, count(*) as n_docs, sum(length(text))::bigint as chars, round(avg(length(text)), 6) as mean_chars,
  sum((length(text) + 3) // 4)::bigint as tokens, count(distinct source) as sources
from documents group by lang
""")
def corpus_profile(t):
    return t("documents").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.length("text")).alias("chars"), F.round(F.avg(F.length("text")), 6).alias("mean_chars"),
        F.sum(X.token_estimate(F.col("text"))).alias("tokens"), F.count_distinct("source").alias("sources"),
    )


@book.add("""
select source, count(*) filter (where text like '%' || chr(10) || '%') as multi_line, count(*) filter (where text not like '%' || chr(10) || '%') as single_line,
  count(distinct lang) as langs from documents group by source
""")
def ingest_stats(t):
    many = F.contains(F.col("text"), F.lit("\n"))
    return t("documents").groupBy("source").agg(F.count_if(many).alias("multi_line"), F.count_if(~many).alias("single_line"), F.count_distinct("lang").alias("langs"))


@book.add(r"""
select doc_id, length(dirty)::bigint as before, length(regexp_replace(dirty, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'))::bigint as after
from (select doc_id, text || chr(7) || chr(9) || chr(127) as dirty from documents)
""")
def control_char_scrub(t):
    dirty = F.concat("text", F.lit("\x07\t\x7f"))
    return t("documents").select("doc_id", F.length(dirty).cast("long").alias("before"), F.length(X.scrub_controls(dirty)).cast("long").alias("after"))


def _nation_tables(t):
    """A pipe table per region: its nations."""
    line = F.format_string("| %d | %s |", "n_nationkey", "n_name")
    rows = t("nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("line")))).alias("r"))
    head = F.lit("| key | name |\n| --- | --- |\n")
    return rows.select("n_regionkey", F.concat(head, F.array_join("r.line", "\n")).alias("text"))


@book.add("""
select n_regionkey, 0::bigint as chunk_idx, 'full_table' as strategy,
  string_agg('key: ' || n_nationkey || chr(10) || 'name: ' || n_name || chr(10) || 'Fonte: nations', chr(10) || '---' || chr(10) order by n_nationkey) as text
from nation group by n_regionkey
""")
def table_full_chunks(t):
    rows = tables.parse_pipe_tables(_nation_tables(t), "n_regionkey", "text")
    rows = rows.withColumn("row_text", tables.row_text(F.col("header"), F.col("cells"), F.lit("nations")))
    return tables.chunk_tables(rows, "n_regionkey")


@book.add("""
select p_brand as brand, row_number() over (partition by p_brand order by p_partkey) - 1 as chunk_idx, 'row_per_chunk' as strategy,
  'name: ' || p_name || chr(10) || 'type: ' || p_type || chr(10) || 'Fonte: parts' as text
from part where p_brand in (select p_brand from part group by p_brand having count(*) > 10)
""")
def table_row_chunks(t):
    place = F.row_number().over(tables.Window.partitionBy("p_brand").orderBy("p_partkey")) - 1
    rows = t("part").select(
        F.col("p_brand").alias("brand"), place.cast("long").alias("row_idx"), tables.row_text(F.array(F.lit("name"), F.lit("type")), F.array("p_name", "p_type"), F.lit("parts")).alias("row_text")
    )
    return tables.chunk_tables(rows, "brand").where("strategy = 'row_per_chunk'")


@book.add("select n_regionkey, row_number() over (partition by n_regionkey order by n_nationkey) - 1 as row_idx, n_nationkey::varchar as key, n_name as name from nation")
def table_markdown_roundtrip(t):
    rows = tables.parse_pipe_tables(_nation_tables(t), "n_regionkey", "text")
    return rows.select("n_regionkey", "row_idx", F.col("cells")[0].alias("key"), F.col("cells")[1].alias("name"))


@book.add("""
select o_orderpriority, min(y)::varchar || case when min(y) < max(y) then '-' || max(y) else '' end as period, case when count(distinct y) >= 2 then 'anual' else '' end as grain,
  count(distinct y) as years
from (select o_orderpriority, year(o_orderdate) as y from orders) group by o_orderpriority
""")
def table_metadata_years(t):
    yearly = t("orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    line = F.format_string("| %d | %d pedidos |", "y", "n")
    text = yearly.groupBy("o_orderpriority").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text"))
    years = tables.years_in(F.regexp_replace("text", r"\| \d+ pedidos", ""))
    return text.select("o_orderpriority", tables.table_period(years).alias("period"), tables.granularity(F.regexp_replace("text", r"\| \d+ pedidos", "")).alias("grain"), F.size(years).cast("long").alias("years"))


@book.add("""
select doc_id, k as chunk_idx, k * 824 as start, substr(text, (k * 824 + 1)::bigint, 1024) as text
from (select doc_id, text, unnest(range(greatest(ceil((length(text) - 200) / 824.0), 1)::bigint)) as k from documents where length(text) > 0)
""")
def chunk_fixed_stride(t):
    return tables.fixed_stride_chunks(t("documents"), "doc_id", "text")


@book.add()
def chunk_recursive(t):
    return tables.split_recursively(t("documents"), "doc_id", "text")


@book.add("""
select conv_id, turn, i - 1 as sentence_idx, s as sentence from (
  select conv_id, turn, unnest(l) as s, unnest(range(1, len(l) + 1)) as i from (
    select conv_id, turn, list_filter(list_transform(regexp_extract_all(text, '[^.!?\\n]+(?:[.!?]|$)'), lambda x: trim(x)), lambda x: length(x) >= 24) as l from conversations))
""".replace("\\\\n", "\\n"))
def sentence_spans(t):
    return t("conversations").select("conv_id", "turn", F.posexplode(X.sentences(F.col("text"))).alias("pos", "sentence")).select("conv_id", "turn", F.col("pos").cast("long").alias("sentence_idx"), "sentence")


@book.add("""
select upper(substr(n, 1, 1)) || lower(substr(n, 2)) as entity, count(*) as parts, min(p_partkey) as first_part
from (select trim(regexp_replace(p_name, '\\s+', ' ', 'g')) as n, p_partkey from part) group by 1
""".replace("\\\\s", "\\s"))
def entity_merge(t):
    return t("part").groupBy(X.entity_name(F.col("p_name")).alias("entity")).agg(F.count(F.lit(1)).alias("parts"), F.min("p_partkey").alias("first_part"))


@book.add("""
select o_orderkey, round(o_totalprice, 2) as parsed, (floor(round(o_totalprice, 2) / 1000) > 0) as thousands, round(o_totalprice, 2) as thousands_reading
from orders
""")
def number_normalise(t):
    written = N.written_number(F.round("o_totalprice", 2))
    return t("orders").select(
        "o_orderkey", N.parse_decimal(written).cast("double").alias("parsed"), F.contains(written, F.lit(".")).alias("thousands"), N.thousands_decimal(written).cast("double").alias("thousands_reading")
    )


@book.add("""
select coalesce(a.doc_id, b.vec_id) as doc_id, case when b.vec_id is null then 'added' when a.doc_id is null then 'removed' else 'modified' end as change
from (select doc_id, toxic as h from labels) a full join (select vec_id, label as h from embeddings) b on a.doc_id = b.vec_id
where a.doc_id is null or b.vec_id is null or a.h is distinct from b.h
""")
def manifest_diff(t):
    """Two whole tables as snapshots of one store: labels now, vectors' labels then."""
    now = t("labels").select("doc_id", F.col("toxic").alias("h"))
    then = t("embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("h"))
    return sync.manifest_diff(now, then, "doc_id", "h")


@book.add("""
select doc_id, case when doc_id in (select doc_id from labels) then 'new' else 'cached' end as origin, length(text)::bigint as chars from documents
""")
def incremental_merge(t):
    """Labelled documents have changed: their cached rows go, fresh ones come."""
    docs = t("documents").select("doc_id", F.length("text").cast("long").alias("chars"))
    changed = t("labels").select("doc_id")
    fresh = docs.join(changed, "doc_id", "left_semi").withColumn("origin", F.lit("new"))
    return sync.merge_changed(docs.withColumn("origin", F.lit("cached")), changed, fresh, "doc_id").select("doc_id", "origin", "chars")


@book.add("""
select doc_id, case when doc_id in (select vec_id from embeddings) then 'upsert' else 'delete' end as action from documents
""")
def change_split(t):
    """All documents as changes: those that have a vector are put in, the others taken out."""
    up, gone = sync.split_changes(t("documents").select("doc_id"), t("embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")
    return up.withColumn("action", F.lit("upsert")).unionByName(gone.withColumn("action", F.lit("delete")))


@book.add("select doc_id, sha256(coalesce(text, '')) as digest, sha256(doc_id::varchar || chr(31) || lang || chr(31) || source) as cache_key from documents")
def sha_manifest(t):
    return t("documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.sha2(F.concat_ws("\x1f", F.col("doc_id").cast("string"), "lang", "source"), 256).alias("cache_key"))


@book.add("""
select coalesce(d.doc_id, p.page_id)::varchar as path, case when p.page_id is null then 'missing' when d.doc_id is null then 'unexpected' else 'corrupted' end as problem
from documents d full join pages p on d.doc_id = p.page_id where d.doc_id is null or p.page_id is null or sha256(d.text) is distinct from sha256(p.html)
union all select '../outside', 'unsafe'
""")
def artefact_verify(t):
    """The manifest of all documents against the pages that stand in their place."""
    docs = t("documents").select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("digest"))
    declared = docs.unionByName(docs.sparkSession.createDataFrame([("../outside", "x")], "path string, digest string"))
    actual = t("pages").select(F.col("page_id").cast("string").alias("path"), F.sha2("html", 256).alias("digest"))
    return sync.verify_manifest(declared, actual, "path", "digest")


@book.add("""
select o_orderkey as id, o_orderstatus as status, o_orderpriority as priority, round(o_totalprice, 2) as total from orders
""")
def eav_pivot(t):
    o = t("orders")
    text, num = F.lit(None).cast("string"), F.lit(None).cast("double")
    rows = o.select(
        F.col("o_orderkey").alias("id"),
        F.explode(F.array(
            F.struct(F.lit("status").alias("key"), F.col("o_orderstatus").alias("s"), num.alias("d")), F.struct(F.lit("priority").alias("key"), F.col("o_orderpriority").alias("s"), num.alias("d")),
            F.struct(F.lit("total").alias("key"), text.alias("s"), F.round("o_totalprice", 2).alias("d")),
        )).alias("x"),
    ).select("id", "x.*")
    maps = sync.pivot_attributes(rows, "id", "key", ["s", "d"])
    a = F.col("attributes")
    return maps.select("id", a["status"].alias("status"), a["priority"].alias("priority"), a["total"].cast("double").alias("total"))


@book.add("select count(*) as n, sum(length(text))::bigint as chars, round(avg(length(text)), 6) as mean_chars, count(distinct source) as keys, min(length(text))::bigint as least, max(length(text))::bigint as most from documents")
def store_inspection(t):
    n = F.length("text")
    return t("documents").agg(
        F.count(F.lit(1)).alias("n"), F.sum(n).alias("chars"), F.round(F.avg(n), 6).alias("mean_chars"), F.count_distinct("source").alias("keys"), F.min(n).cast("long").alias("least"), F.max(n).cast("long").alias("most")
    )


@book.add("""
select doc_id, 'Documento ' || doc_id || ' (' || lang || ')' || chr(10) || text as text, 'text' as type from documents
union all select s_suppkey, 'Tabela ' || s_suppkey || chr(10) || '| name | balance |' || chr(10) || '| ' || s_name || ' | ' || s_acctbal::decimal(18, 2)::varchar || ' |', 'table' from supplier
""")
def document_normalisation(t):
    texts = t("documents").select("doc_id", F.concat(F.format_string("Documento %d (%s)\n", "doc_id", "lang"), "text").alias("text"), F.lit("text").alias("type"))
    grid = F.concat(F.format_string("Tabela %d\n| name | balance |\n| ", "s_suppkey"), "s_name", F.lit(" | "), F.col("s_acctbal").cast("decimal(18,2)").cast("string"), F.lit(" |"))
    return texts.unionByName(t("supplier").select(F.col("s_suppkey").alias("doc_id"), grid.alias("text"), F.lit("table").alias("type")))


@book.add("""
select doc_id, text, 'text' as type from documents
union all select s_suppkey, 'Tabela extraída de supplier (página/aba: ' || s_suppkey || '):' || chr(10) || chr(10) || '| name | balance |' || chr(10) || '| --- | --- |' || chr(10)
  || '| ' || coalesce(s_name, '') || ' | ' || coalesce(s_acctbal::decimal(18, 2)::varchar, '') || ' |', 'table' from supplier
""")
def document_normalisation_whole(t):
    """Whole texts as they are; tables with their header, rule and values."""
    texts = t("documents").select("doc_id", "text", F.lit("text").alias("type"))
    balance = F.coalesce(F.col("s_acctbal").cast("decimal(18,2)").cast("string"), F.lit(""))
    grid = F.concat(
        F.lit("Tabela extraída de supplier (página/aba: "), F.col("s_suppkey").cast("string"), F.lit("):\n\n| name | balance |\n| --- | --- |\n| "),
        F.coalesce("s_name", F.lit("")), F.lit(" | "), balance, F.lit(" |"),
    )
    return texts.unionByName(t("supplier").select(F.col("s_suppkey").alias("doc_id"), grid.alias("text"), F.lit("table").alias("type")))


QUERIES, SQL = book.queries, book.sql
