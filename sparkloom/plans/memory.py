"""Session memory, breakers and the index store, over events and documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.sources.index_store import IndexStore
from sparkloom.sources.scratch import shared_folder
from sparkloom.streaming import batch

from .base import Book

book = Book()


def session_events(events: DataFrame) -> DataFrame:
    """Events as touches of conversations: views read, sign-ups clear, the others write a question and an answer."""
    kind = F.when(F.col("event_type") == "view", "read").when(F.col("event_type") == "signup", "clear").otherwise("write")
    return events.select(
        (F.col("user_id") % 16).alias("store"), F.col("user_id").cast("string").alias("conversation"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", kind.alias("kind"),
        F.array(F.col("event_type"), F.col("props")).alias("messages"),
    )


def breaker_events(events: DataFrame) -> DataFrame:
    """Events as calls of a service a user; every error and purchase failed."""
    return events.select(F.col("user_id").alias("service"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", F.col("event_type").isin("error", "purchase").alias("failed"))


@book.add()
def session_cache(t):
    """Conversations of a store under a cap of 5 and a day's silence."""
    return batch.session_cache(session_events(t("events")), 5, 86_400).select("event_id", "was_held", "held")


@book.add("""
with e as (select event_id, user_id, epoch_us(ts) as us, event_type <> 'view' as w from events where event_type <> 'signup'),
f as (select *, coalesce((us - lag(us) over o >= 86400000000)::int, 0) as fresh from e window o as (partition by user_id order by us, event_id)),
r as (select *, sum(fresh) over (partition by user_id order by us, event_id rows unbounded preceding) as run from f),
u as (select *, count(*) filter (where w) over (partition by user_id, run order by us, event_id rows unbounded preceding) as upto from r)
select event_id, upto - w::int > 0 as was_held, least(2 * upto, 12)::int as held from u
""")
def session_memory(t):
    """Conversations without a cap: a read keeps one alive, a day of silence ends it."""
    touched = session_events(t("events")).where("kind <> 'clear'")
    return batch.session_memory(touched, F.col("kind") == "write", 86_400).select("event_id", "was_held", "held")


@book.add("""
with recursive e as (select user_id, event_id, epoch_us(ts) as at, event_type in ('error', 'purchase') as failed, row_number() over (partition by user_id order by ts, event_id) as k from events),
s as (
  select user_id, event_id, k, case when failed then 1 else 0 end as failures, null::bigint as opened, 'closed' as found from e where k = 1
  union all
  select e.user_id, e.event_id, e.k,
    case when s.opened is not null and e.at - s.opened < 43200000000 then s.failures when e.failed then s.failures + 1 else 0 end,
    case when s.opened is not null and e.at - s.opened < 43200000000 then s.opened when e.failed and s.failures + 1 >= 3 then e.at end,
    case when s.opened is null then 'closed' when e.at - s.opened < 43200000000 then 'open' else 'half-open' end
  from s join e on e.user_id = s.user_id and e.k = s.k + 1)
select event_id, found from s
""")
def breaker_calls(t):
    """Three failures in a row open a service for half a day; then calls try it again."""
    return batch.breaker_calls(breaker_events(t("events")), 3, 43_200).select("event_id", "found")


@book.add("""
with a as (select lang || '/' || source as src, count(*) as n, sum(doc_id) as m from documents where source not in ('src0', 'src1') or doc_id % 10 < 8 group by 1),
b as (select lang || '/' || source as src, count(*) as n, sum(doc_id) as m from documents where source <> 'src2' group by 1)
select doc_id, d.lang || '/' || d.source as source, case when a.n is not distinct from b.n and a.m is not distinct from b.m then 0 else 1 end as held from documents d join b on b.src = d.lang || '/' || d.source left join a on a.src = b.src where d.source <> 'src2'
""")
def index_sync(t):
    """An index of documents by source, synchronised twice: some sources grow, one goes; what a version holds stays where it is."""
    docs = t("documents").select(F.concat("lang", F.lit("/"), "source").alias("source"), F.col("source").alias("own"), "doc_id")
    spark = docs.sparkSession
    store = IndexStore(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    for corpus in (docs.where("own not in ('src0', 'src1') or doc_id % 10 < 8"), docs.where("own <> 'src2'")):
        snapshot = corpus.groupBy("source").agg(F.concat(F.count(F.lit(1)), F.lit(":"), F.sum("doc_id")).alias("value"))
        store.sync(snapshot, lambda wanted, corpus=corpus: corpus.join(wanted, "source", "left_semi").select("source", "doc_id"))
    return store.nodes().join(store.manifest().select("source", "held"), "source").select("doc_id", "source", "held")


QUERIES, SQL = book.queries, book.sql
