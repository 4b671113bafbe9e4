"""Retrieval plans: BM25, vectors, fusion, dedup, diversity, hybrid search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.operators import rank as R

from .base import Book

book = Book()
_STOP = "[" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + "]"
_TERMS = f"list_filter(regexp_extract_all(translate(lower({{}}), '{X.ACCENTED}', '{X.PLAIN}'), '[a-z]{{{{4,}}}}'), lambda t: not list_contains({_STOP}, t))"


def terms_sql(column: str) -> str:
    return _TERMS.format(column)


_terms = terms_sql


_BM25 = f"""
terms as (select doc_id, unnest({_terms('text')}) as term from documents),
tf as (select doc_id, term, count(*) as tf from terms group by 1, 2),
lens as (select doc_id, count(*) as length from terms group by 1),
stats as (select count(*) as n, sum(length) / count(*)::double as mean from lens),
q as (select distinct item_id as query_id, unnest({_terms('text')}) as term from benchmark),
df as (select term, count(*) as df from tf group by 1),
scores as (select query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * length / mean))), 6) as score
  from q join tf using (term) join df using (term) join lens using (doc_id), stats group by 1, 2),
bm25 as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from scores) where rank <= 80),
overlap as (select * from (select query_id, doc_id, row_number() over (partition by query_id order by round(count(*) / sqrt(any_value(length)), 6) desc, doc_id) as rank
  from q join tf using (term) join lens using (doc_id) group by 1, 2) where rank <= 80)
"""


BM25_SQL = _BM25


def query_terms(t, least: int = 4):
    """(query_id, term) of every item."""
    return t("benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(X.content_terms(F.col("text"), least))).alias("term")).distinct()


_query_terms = query_terms


def _scores(t):
    return R.lexical_scores(t("documents").select("doc_id", X.content_terms(F.col("text")).alias("terms")), _query_terms(t))


def _fused(t):
    return R.fuse_ranks(R.ranked_lists(_scores(t), ["score", "overlap"], 80), ["score", "overlap"])


@book.add(f"with {_BM25} select query_id, doc_id, rank, score from bm25")
def bm25_topk(t):
    return R.rank_by(_scores(t), ["query_id"], [F.col("score").desc(), F.col("doc_id")], 80).select("query_id", "doc_id", "rank", "score")


@book.add(f"with {_BM25}, both_lists as (select query_id, doc_id, rank from bm25 union all select query_id, doc_id, rank from overlap) select query_id, doc_id, round(sum(1.0::double / (60 + rank)), 6) as score from both_lists group by 1, 2")
def rrf_fusion(t):
    return _fused(t)


@book.add(f"""
with {_BM25}, both_lists as (select query_id, doc_id, rank from bm25 union all select query_id, doc_id, rank from overlap),
fused as (select query_id, doc_id, round(sum(1.0::double / (60 + rank)), 6) as score from both_lists group by 1, 2),
shown as (select query_id, doc_id, score, source, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 300) as key, text from fused join documents using (doc_id)),
firsts as (select * from (select *, row_number() over (partition by query_id, key order by score desc, doc_id) as k from shown) where k = 1),
places as (select *, row_number() over (partition by query_id order by score desc, doc_id) as pos from firsts),
capped as (select *, row_number() over (partition by query_id, source order by pos) > 2 as over_cap from places),
final as (select * from (select *, row_number() over (partition by query_id order by over_cap, pos) as place from capped) where place <= 5),
known as (select distinct query_id, unnest({_terms('text')}) as term from final),
support as (select query_id, round_even(count(known.term) / count(*)::double, 3) as support from q left join known using (query_id, term) group by 1)
select query_id, doc_id, place, score, source, support from final join support using (query_id)
""".replace("\\\\s", "\\s"))
def hybrid_search(t):
    """Two ranked lists fused, passages alike left out, sources capped, and how much of the query the result covers."""
    docs = t("documents")
    shown = _fused(t).join(docs.select("doc_id", "source", X.text_key(F.col("text")).alias("key")), "doc_id")
    firsts = R.first_per_key(shown, ["query_id"], F.col("key"), [F.col("score").desc(), F.col("doc_id")])
    placed = R.rank_by(firsts, ["query_id"], [F.col("score").desc(), F.col("doc_id")], None, "pos")
    final = R.diversify(placed, ["query_id"], "source", "pos", 2, 5)
    # A second look at the few documents of the result, instead of texts that pass all the steps before.
    known = docs.select("doc_id", "text").join(final.select("query_id", "doc_id"), "doc_id").select("query_id", F.explode(X.content_terms(F.col("text"))).alias("term")).distinct()
    known = known.withColumn("k", F.lit(1))
    support = _query_terms(t).join(known, ["query_id", "term"], "left").groupBy("query_id").agg(F.bround(F.count("k") / F.count(F.lit(1)), 3).alias("support"))
    return final.join(support, "query_id").select("query_id", "doc_id", "place", "score", "source", "support")


_VECTOR = """
select query_id, vec_id, rank, score from (
  select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id) as rank from (
    select a.vec_id as query_id, b.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as score
    from embeddings a join embeddings b on a.vec_id <> b.vec_id {} where a.vec_id % 50 = 0)) where rank <= 10
"""


@book.add(_VECTOR.format(""))
def vector_topk(t):
    e = t("embeddings").select("vec_id", F.col("embedding").alias("v"))
    return R.vector_topk(e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), e, 10)


@book.add(_VECTOR.format("and a.label = b.label"))
def vector_topk_by_label(t):
    e = t("embeddings").select("vec_id", F.col("embedding").alias("v"), "label")
    return R.vector_topk(e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), e, 10, label=True)


@book.add("""
select lang, doc_id from (select lang, doc_id, row_number() over (partition by lang, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 300) order by doc_id) as k from documents) where k = 1
""".replace("\\\\s", "\\s"))
def dedup_text_key(t):
    return R.first_per_key(t("documents"), ["lang"], X.text_key(F.col("text")), [F.col("doc_id")]).select("lang", "doc_id")


@book.add()
def dedup_two_keys(t):
    """Candidates of a query whose ids and texts both repeat: the sequential rule."""
    e = t("events").select("user_id", F.col("event_id").alias("position"), F.col("event_type").alias("id"), F.round("value", 0).cast("string").alias("text"))
    return R.dedup_two_keys(e, ["user_id"], "id", "text", "position")


@book.add("""
select lang, doc_id, place from (
  select lang, doc_id, row_number() over (partition by lang order by over_cap, pos) as place from (
    select *, row_number() over (partition by lang, source order by pos) > 2 as over_cap from (
      select lang, source, doc_id, row_number() over (partition by lang order by length(text) desc, doc_id) as pos from documents))) where place <= 30
""")
def diversity_cap(t):
    """No more than 30 documents of a source can be among a language's first 30: each source is cut to these before languages are ordered."""
    order = [F.length("text").desc(), F.col("doc_id")]
    first = R.rank_by(t("documents").select("lang", "source", "doc_id", "text"), ["lang", "source"], order, 30, "own")
    placed = R.rank_by(first, ["lang"], order, None, "pos")
    return R.diversify(placed, ["lang"], "source", "pos", 2, 30).select("lang", "doc_id", "place")


@book.add("""
with d as (select *, row_number() over (partition by source order by doc_id) as pos, case when doc_id % 3 = 0 then round(length(text) / 100.0::double, 2) end as s from documents),
a as (select *, row_number() over (partition by source order by s desc nulls last, pos) as a from d)
select source, doc_id, row_number() over (partition by source order by case when s is not null and a <= 10 then 0 else 1 end, case when s is not null and a <= 10 then -s else 0 end, pos) as place
from a where s is null or a <= 10
""")
def tolerant_rerank(t):
    """Ids are positions: only their order counts."""
    d = t("documents").withColumn("pos", F.col("doc_id")).withColumn("verdict", F.when(F.col("doc_id") % 3 == 0, F.round(F.length("text") / 100.0, 2).cast("string")).otherwise(F.lit("n/a")))
    return R.rerank_tolerantly(d, ["source"], "pos", "verdict", 10).select("source", "doc_id", "place")


_VARIANTS = """
v as (select item_id, unnest([text, substr(text, 1, length(text) // 2), substr(text, length(text) // 2 + 1)]) as text, unnest([0, 1, 2]) as variant from benchmark),
vq as (select distinct item_id, variant, unnest({terms}) as term from v),
lexical as (select * from (select item_id, variant, doc_id, row_number() over (partition by item_id, variant order by round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * length / mean))), 6) desc, doc_id) as rank
  from vq join tf using (term) join df using (term) join lens using (doc_id), stats group by 1, 2, 3) where rank <= 80),
near as (select * from (select a.vec_id as item_id, b.vec_id as doc_id, row_number() over (partition by a.vec_id order by round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) desc, b.vec_id) as rank
  from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id in (select item_id from benchmark)) where rank <= 80)
""".format(terms=_terms("text"))


@book.add(f"""
with {_BM25}, {_VARIANTS}, lists as (select item_id, doc_id, rank from lexical union all select item_id, doc_id, rank from near)
select query_id, doc_id, score, place from (select *, row_number() over (partition by query_id order by score desc, doc_id) as place from (select item_id as query_id, doc_id, round(sum(1.0::double / (60 + rank)), 6) as score from lists group by 1, 2)) where place <= 80
""")
def hybrid_fusion(t):
    """Vectors and BM25 fused, BM25 for the item's text and for either half of it; an item's vector is that of its id, a document's as well."""
    n = F.length("text")
    texts = F.array(F.col("text"), F.expr("substring(text, 1, length(text) div 2)"), F.expr("substring(text, length(text) div 2 + 1)"))
    variants = t("benchmark").where(n > 0).select(F.col("item_id"), F.posexplode(texts).alias("variant", "said"))
    key = F.struct("item_id", "variant")
    terms = variants.select(key.alias("query_id"), F.explode(F.array_distinct(X.content_terms(F.col("said")))).alias("term")).distinct()
    scores = R.lexical_scores(t("documents").select("doc_id", X.content_terms(F.col("text")).alias("terms")), terms)
    lexical = R.rank_by(scores, ["query_id"], [F.col("score").desc(), F.col("doc_id")], 80).select(F.col("query_id.item_id").alias("query_id"), "doc_id", "rank")
    e = t("embeddings").select("vec_id", F.col("embedding").alias("v"))
    asked = e.join(t("benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi").withColumnRenamed("vec_id", "query_id")
    near = R.vector_topk(asked, e, 80).select("query_id", F.col("vec_id").alias("doc_id"), "rank")
    return R.rank_by(R.fuse([lexical, near]), ["query_id"], [F.col("score").desc(), F.col("doc_id")], 80, "place").select("query_id", "doc_id", "score", "place")


@book.add("""
select user_id, (k - 1) // 30 as batch, count(*) as n, min(event_id) as first_event from (
  select user_id, event_id, row_number() over (partition by user_id order by event_id) as k from events) group by 1, 2
""")
def numbered_batches(t):
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return t("events").withColumn("batch", F.floor((place - 1) / 30)).groupBy("user_id", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


QUERIES, SQL = book.queries, book.sql
