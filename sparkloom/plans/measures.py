"""Sessions, limits, counters, routing and evaluation statistics over event and order tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.functions import numbers as N
from sparkloom.operators import policy, state, stats, trees, usage

from .base import Book

book = Book()


@book.add("""
with e as (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over w >= 3600000000 then 1 else 0 end as fresh from events window w as (partition by user_id order by ts, event_id)),
s as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from e)
select user_id, session::bigint as session, count(*) as n, min(event_id) as first_event from s group by 1, 2
""")
def session_islands(t):
    return state.sessions(t("events"), "user_id", "ts", 3600).groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@book.add("""
select event_id, count(*) over (partition by user_id order by epoch_us(ts) range between 86400000000 preceding and current row) as in_window from events
""")
def rate_window_count(t):
    return state.window_counts(t("events"), "user_id", "ts", 86_400).select("event_id", "in_window")


@book.add()
def rate_admission(t):
    """At most two events a day and user; tests hold it against a walk in plain Python."""
    return state.admit(t("events").select("event_id", "user_id", "ts"), "user_id", "ts", 2, 86_400).select("event_id", "admitted")


@book.add("""
with e as (select *, sum(case when event_type <> 'error' then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as island from events)
select user_id, island::bigint as island, count(*) as failures, count(*) >= 3 as opened from e where event_type = 'error' group by 1, 2
""")
def breaker_islands(t):
    e = t("events").withColumn("failed", F.col("event_type") == "error")
    return state.breaker_runs(e, "user_id", ["ts", "event_id"], "failed", 3).select("user_id", "island", "failures", "opened")


@book.add("""
select event_type as service, user_id % 10 as path, count(*) as calls, count(*) filter (where status >= 400) as errors, round(sum(value), 4) as seconds, round(avg(value), 6) as mean
from (select *, case when event_id % 6 = 0 then 503 when event_id % 5 = 0 then 404 else 200 end as status from events) group by 1, 2
""")
def http_counters(t):
    status = F.when(F.col("event_id") % 6 == 0, 503).when(F.col("event_id") % 5 == 0, 404).otherwise(200)
    return t("events").groupBy(F.col("event_type").alias("service"), (F.col("user_id") % 10).alias("path")).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(status >= 400).alias("errors"), F.round(F.sum("value"), 4).alias("seconds"), F.round(F.avg("value"), 6).alias("mean")
    )


@book.add("""
select 'service_calls_total{path="' || (user_id % 10) || '",service="' || event_type || '"} ' || count(*) as line from events group by event_type, user_id % 10
""")
def counter_lines(t):
    """Counters as text, labels in order of their names."""
    counts = t("events").groupBy("event_type", (F.col("user_id") % 10).alias("path")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.format_string('service_calls_total{path="%d",service="%s"} %d', "path", "event_type", "n").alias("line"))


@book.add("""
select user_id, event_type, count(*) filter (where value <= 10) as calls, coalesce(sum(length(props)) filter (where value <= 10), 0)::bigint as chars from events group by 1, 2 having count(*) filter (where value <= 10) > 0
""")
def usage_diff(t):
    """What usage has grown by since a snapshot that held the events above 10; rows of zeros are left out."""
    early = F.col("value") > 10
    now = t("events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.length("props")).alias("chars"))
    then = t("events").groupBy("user_id", "event_type").agg(F.count_if(early).alias("calls"), F.sum(F.when(early, F.length("props")).otherwise(0)).alias("chars"))
    return stats.snapshot_difference(now, then, ["user_id", "event_type"], ["calls", "chars"])


@book.add("""
select user_id, sum(calls)::bigint as calls, sum(chars)::bigint as chars from (
  select user_id, 1 as calls, length(props) as chars from events union all select c_custkey, 1, length(c_name) from customer) group by 1
""")
def usage_merge(t):
    a = t("events").select("user_id", F.lit(1).alias("calls"), F.length("props").alias("chars"))
    b = t("customer").select(F.col("c_custkey").alias("user_id"), F.lit(1).alias("calls"), F.length("c_name").alias("chars"))
    return a.unionByName(b).groupBy("user_id").agg(F.sum("calls").alias("calls"), F.sum("chars").alias("chars"))


_USAGE = """
c as (select event_type as model, ['generation', 'judge', 'probe', 'other'][user_id % 4 + 1] as bucket, case when event_id % 7 > 0 then length(props) * 3 end as prompt, case when event_id % 7 in (0, 1) then null else length(props) end as cached,
  case when event_id % 7 = 0 then null when event_id % 5 = 0 then 0 else floor(value)::bigint end as completion, event_id % 7 = 0 as nothing from events),
u as (select bucket, model, count(*) as calls, sum(coalesce(prompt, 0))::bigint as prompt, sum(coalesce(cached, 0))::bigint as cached, sum(coalesce(completion, 0))::bigint as completion, sum(nothing::int)::bigint as without from c group by 1, 2)
"""


def _usage(t):
    """Events as calls of models in four buckets; what they report is text, some of it no count."""
    k, n = F.col("event_id"), F.length("props")
    text = lambda c: c.cast("string")
    calls = t("events").select(
        F.element_at(F.array(*map(F.lit, ("generation", "judge", "probe", "other"))), (F.col("user_id") % 4 + 1).cast("int")).alias("bucket"), F.col("event_type").alias("model"), F.when(k % 7 > 0, text(n * 3)).alias("prompt"),
        F.when(~(k % 7).isin(0, 1), text(n)).alias("cached"), F.when(k % 7 == 0, None).when(k % 10 == 0, "-12").when(k % 5 == 0, "many").otherwise(text(F.col("value"))).alias("completion"),
    )
    return usage.accumulate(calls, ["bucket", "model"])


@book.add(f"with {_USAGE} select * from u")
def reported_usage(t):
    """What calls report, added up; what is no count of 0 or more counts 0."""
    return _usage(t)


@book.add(f"""
with {_USAGE}, p(model, fresh, kept, out) as (values ('click', 0.25::double, 0.025::double, 2.0::double), ('view', 1.5::double, 0.5::double, 6.0::double), ('error', 0.0::double, 0.0::double, 0.0::double))
select bucket, sum(prompt + completion)::bigint as tokens, round(sum((prompt - cached) * fresh + cached * kept + completion * out) / 1000000, 9) as cost from u left join p using (model) where bucket <> 'other' or model = 'purchase' group by 1
""")
def usage_cost(t):
    """Cost by bucket with three prices a model; a bucket of models without a price has none."""
    spark = t("events").sparkSession
    prices = spark.createDataFrame([("click", 0.25, 0.025, 2.0), ("view", 1.5, 0.5, 6.0), ("error", 0.0, 0.0, 0.0)], "model string, fresh double, cached_price double, out double")
    found = usage.cost(_usage(t).where("bucket <> 'other' or model = 'purchase'"), prices, ["bucket"])
    return found.select("bucket", "tokens", F.round("cost", 9).alias("cost"))


@book.add("""
with o as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as place, count(*) over (partition by event_type) - 1 as top from events)
select event_type, max(case when place = round_even(top * 0.5::double, 0) then value end) as p50, max(case when place = round_even(top * 0.95::double, 0) then value end) as p95 from o group by 1
""")
def nearest_rank_percentiles(t):
    return stats.nearest_ranks(t("events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@book.add("""
select c_mktsegment as segment, count(*) as n, round(avg(case when o_orderkey % 4 > 0 then (o_orderkey % 3) / (o_orderkey % 4)::double end), 6) as precision_mean,
  round(sum(case when o_orderstatus = 'P' then 1 else 0 end) / count(*)::double, 6) as refusals
from orders join customer on o_custkey = c_custkey group by 1
""")
def split_summary(t):
    """Numeric precision where it applies, and the share of refusals."""
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    precision = F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderkey") % 3 / (F.col("o_orderkey") % 4))
    return o.groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(precision), 6).alias("precision_mean"), F.round(F.count_if(F.col("o_orderstatus") == "P") / F.count(F.lit(1)), 6).alias("refusals")
    )


@book.add("""
select event_type as criterion, user_id % 3 as severity, count(*) as n, row_number() over (order by count(*) desc, event_type, user_id % 3) as place from events where value > 20 group by 1, 2
""")
def error_counts(t):
    """Errors by criterion and severity, the commonest first: a row for each pair of them."""
    counts = t("events").where("value > 20").groupBy(F.col("event_type").alias("criterion"), (F.col("user_id") % 3).alias("severity")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.col("n").desc(), "criterion", "severity")).cast("long"))


@book.add("""
with r as (select o_custkey, o_orderkey, o_orderkey % 7 as good, o_orderkey % 7 + o_orderkey % 3 as total, o_orderkey % 8 as sources, o_orderstatus = 'P' as refused, o_orderkey % 11 = 0 as has_error from orders),
q as (select *, case when refused then -1.0::double else 10 * (case when total > 0 then good / total::double else 1.0::double end) + least(sources, 5) end as quality from r)
select o_custkey, o_orderkey, round(quality, 6) as quality, has_error from (
  select *, row_number() over (partition by o_custkey order by has_error, quality desc, o_orderkey) as k from q) where k = 1
""")
def quality_gate_score(t):
    """Orders as responses: the best of each customer; those with errors only where all have."""
    k = F.col("o_orderkey")
    r = t("orders").select(
        "o_custkey", "o_orderkey", policy.quality_score(k % 7, k % 7 + k % 3, k % 8, F.col("o_orderstatus") == "P").alias("quality"), (k % 11 == 0).alias("has_error")
    )
    return policy.select_best(r, "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey", F.round("quality", 6).alias("quality"), "has_error")


_SKILLS = (("metal", 2, "bolt"), ("metal", 2, "ring"), ("colour", 1, "red"), ("colour", 1, "blue widget"), ("tool", 3, "widget"), ("size", 1, "small"))


@book.add(f"""
with k(domain, priority, keyword) as (values {", ".join(f"('{d}', {p}, '{w}')" for d, p, w in _SKILLS)}),
h as (select p_partkey as id, domain, priority, sum(1 + length(keyword) - length(replace(keyword, ' ', '')))::bigint as score from part, k where regexp_matches(lower(p_name), '(^|[^a-z0-9_])' || keyword || '($|[^a-z0-9_])') group by 1, 2, 3)
select id, domain, score, place from (select *, row_number() over (partition by id order by score desc, priority desc, domain) as place from h) where place <= 2
""")
def skill_match(t):
    return policy.match_skills(t("part").select(F.col("p_partkey").alias("id"), "p_name"), "id", "p_name", _SKILLS)


@book.add("""
select quality, count(*) as n, count(*) filter (where toxic = 1) as k, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 6) as lo,
  round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 6) as hi
from (select quality, toxic, count(*) over (partition by quality)::double as n, avg(toxic) over (partition by quality) as p, 1.959964::double as z from labels where quality is not null and toxic is not null)
group by quality, n, p, z
""".replace("count(*) as n, count", "count(*) as total, count"))
def wilson_interval(t):
    g = t("labels").where("quality is not null and toxic is not null").groupBy("quality").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("toxic") == 1).alias("k"))
    lo, hi = stats.wilson(F.col("k"), F.col("total"))
    return g.select("quality", "total", "k", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


@book.add("select quality, toxic, count(*) as n from labels group by 1, 2")
def contingency(t):
    return t("labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


@book.add("""
with d as (select o_custkey % 40 as pair, count(*) filter (where o_orderstatus = 'O' and o_orderkey % 3 > 0) as b, count(*) filter (where o_orderstatus = 'F' and o_orderkey % 3 = 0) as c from orders group by 1),
x as (select pair, b, c, b + c as n, unnest(range(least(b, c) + 1)) as i from d)
select pair, b, c, round(least(1.0, case when any_value(n) = 0 then 1.0 else 2 * sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) end) + 1e-9, 5) as p from x group by pair, b, c
""")
def mcnemar_exact(t):
    o, k = t("orders"), F.col("o_orderkey")
    d = o.groupBy((F.col("o_custkey") % 40).alias("pair")).agg(
        F.count_if((F.col("o_orderstatus") == "O") & (k % 3 > 0)).alias("b"), F.count_if((F.col("o_orderstatus") == "F") & (k % 3 == 0)).alias("c")
    )
    return d.withColumn("p", F.round(stats.mcnemar_exact(F.col("b"), F.col("c")) + 1e-9, 5))


@book.add("""
with c as (select user_id as subject, event_type as category, count(*) as n from events group by 1, 2),
s as (select subject, sum(n) as raters, sum(n * n) as squares from c group by 1),
m as (select raters from s group by 1 order by count(*) desc, raters limit 1),
u as (select * from s where raters = (select raters from m)),
g as (select category, sum(n) as k from c where subject in (select subject from u) group by 1)
select round((p - e) / (1 - e), 6) as kappa from (select avg((squares - raters) / (raters * (raters - 1))::double) as p from u), (select sum(k * k) / (sum(k) * sum(k))::double as e from g)
""")
def fleiss_kappa(t):
    counts = t("events").groupBy(F.col("user_id").alias("subject"), F.col("event_type").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return stats.fleiss_kappa(counts, "subject", "category", "n").select(F.round("kappa", 6).alias("kappa"))


@book.add("""
with p as (select substr(o_orderpriority, 1, 1)::int - 1 as a, o_custkey % 5 as b from orders),
x as (select a, count(*) as n from p group by 1), y as (select b, count(*) as n from p group by 1)
select round(1 - o / (e / (n::double * n)), 6) as kappa from (select avg(power(a - b, 2) / 16.0) as o, count(*) as n from p), (select sum(power(a - b, 2) / 16.0 * x.n * y.n) as e from x, y)
""")
def weighted_kappa(t):
    p = t("orders").select((F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("a"), (F.col("o_custkey") % 5).cast("int").alias("b"))
    return stats.weighted_kappa(p, "a", "b", 5).select(F.round("kappa", 6).alias("kappa"))


@book.add("""
with p as (select c_mktsegment as family, c_custkey as test, (c_custkey * 37 % 997 + 1) / 100000.0::double as p from customer),
s as (select *, least((count(*) over (partition by family) - row_number() over (partition by family order by p, test) + 1) * p, 1.0) as step from p)
select family, test, round(max(step) over (partition by family order by p, test rows unbounded preceding), 8) as adjusted from s
""")
def holm_adjust(t):
    p = t("customer").select(F.col("c_mktsegment").alias("family"), F.col("c_custkey").alias("test"), ((F.col("c_custkey") * 37 % 997 + 1) / 100000).alias("p"))
    return stats.holm(p, ["family"], "p", "test").select("family", "test", F.round("adjusted", 8).alias("adjusted"))


@book.add("""
with r as (select o_orderpriority as priority, rank() over (partition by o_orderpriority order by o_totalprice) + (count(*) over (partition by o_orderpriority, o_totalprice) - 1) / 2.0 as x,
  rank() over (partition by o_orderpriority order by o_custkey) + (count(*) over (partition by o_orderpriority, o_custkey) - 1) / 2.0 as y from orders)
select priority, round(corr(x, y), 6) as rho from r group by 1
""")
def spearman_rank(t):
    o = t("orders").withColumnRenamed("o_orderpriority", "priority")
    ranked = stats.average_ranks(stats.average_ranks(o, ["priority"], "o_totalprice", "x"), ["priority"], "o_custkey", "y")
    return ranked.groupBy("priority").agg(F.round(F.corr("x", "y"), 6).alias("rho"))


@book.add("""
with r as (select o_orderpriority as g, rank() over (order by o_totalprice) + (count(*) over (partition by o_totalprice) - 1) / 2.0 as r, o_totalprice as v from orders),
s as (select g, sum(r) as s, count(*) as k from r group by 1), t as (select sum(c::double * c * c - c) as ties, sum(c) as n from (select count(*) as c from r group by v)),
h as (select (12 / (n::double * (n + 1)) * (select sum(s * s / k) from s) - 3 * (n + 1)) / (1 - ties / (n::double * n * n - n)) as h0, (select count(*) from s) as groups, n::bigint as n from t), select_p as (select *, round(exp(-h0 / 2) * (1 + h0 / 2), 6) as p from h)
select round(h0, 6) as h, groups, n, p from select_p
""")
def kruskal_h(t):
    """Five groups: chi-square of four degrees has a closed form."""
    return stats.kruskal_h(t("orders"), "o_orderpriority", "o_totalprice").select(F.round("h", 6).alias("h"), "groups", "n", F.round("p", 6).alias("p"))


def _arms(t):
    """Orders of odd and of even keys as the answers of two arms; a customer is a question."""
    o = t("orders").select(F.col("o_custkey").alias("question"), F.round(F.col("o_totalprice") / 1000, 0).alias("score"), (F.col("o_orderkey") % 2).alias("arm"))
    return o.where("arm = 0"), o.where("arm = 1")


_PAIRS = """
p as (select question, b.m as base, a.m as arm, round(a.m - b.m, 4) as delta from (select o_custkey as question, avg(round(o_totalprice / 1000)) as m from orders where o_orderkey % 2 = 0 group by 1) b
  join (select o_custkey as question, avg(round(o_totalprice / 1000)) as m from orders where o_orderkey % 2 = 1 group by 1) a using (question))
"""


@book.add(f"with {_PAIRS} select question, round(base, 4) as base, round(arm, 4) as arm, delta from p")
def paired_deltas(t):
    """Questions that both arms answered, and what they differ by."""
    found = stats.paired_deltas(*_arms(t), "question", "score")
    return found.select("question", F.round("base", 4).alias("base"), F.round("arm", 4).alias("arm"), F.round("delta", 4).alias("delta"))


@book.add(f"""
with {_PAIRS}, s as (select question % 7 as family, round(abs(delta)) as size, sign(round(delta)) as side from p),
r as (select *, rank() over (partition by family order by size) + (count(*) over (partition by family, size) - 1) / 2.0 as r from s)
select family, count(*) as n, round(sum(r * case side when 1 then 1.0 when 0 then 0.5 else 0 end), 4)::double as plus, round(sum(r * case side when -1 then 1.0 when 0 then 0.5 else 0 end), 4)::double as minus from r group by 1
""")
def signed_ranks(t):
    """Signed ranks of differences rounded to whole numbers: ties, and zeros that count for both sides."""
    found = stats.paired_deltas(*_arms(t), "question", "score").select((F.col("question") % 7).alias("family"), F.round(F.round("delta", 4)).alias("delta"))
    return stats.wilcoxon_zsplit(found, ["family"], "delta").select("family", "n", F.round("plus", 4).alias("plus"), F.round("minus", 4).alias("minus"))


@book.add()
def paired_comparison(t):
    """Two arms by question: means, difference, its interval of 10,000 repeats, and the signed-rank p."""
    return stats.paired_comparison(*_arms(t), "question", "score")


@book.add("""
with c as (select c_mktsegment as segment, o_custkey, avg(o_totalprice) as m, stddev_samp(o_totalprice) as sd, count(*) as n from orders join customer on o_custkey = c_custkey group by 1, 2)
select segment, count(*) as questions, round(avg(m), 4) as mean, round(avg(case when n > 1 then sd end), 4) as within_sd from c group by 1
""")
def subgroup_two_level(t):
    """Means of means: every customer counts once, however many orders."""
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    c = o.groupBy(F.col("c_mktsegment").alias("segment"), "o_custkey").agg(F.avg("o_totalprice").alias("m"), F.stddev_samp("o_totalprice").alias("sd"), F.count(F.lit(1)).alias("n"))
    return c.groupBy("segment").agg(F.count(F.lit(1)).alias("questions"), F.round(F.avg("m"), 4).alias("mean"), F.round(F.avg(F.when(F.col("n") > 1, F.col("sd"))), 4).alias("within_sd"))


@book.add("select round(avg(m), 4) as mean, count(*) as clusters from (select o_custkey, avg(o_totalprice) as m from orders group by 1)")
def cluster_means(t):
    """The point estimate of the cluster bootstrap; the interval is drawn, and held by tests."""
    return t("orders").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("m")).agg(F.round(F.avg("m"), 4).alias("mean"), F.count(F.lit(1)).alias("clusters"))


@book.add()
def bootstrap_interval(t):
    return stats.cluster_bootstrap(t("orders"), ["o_custkey"], "o_totalprice")


@book.add("""
with n as (select label, vec_id, row_number() over (partition by label order by vec_id) as k from embeddings)
select label, count(*) as size, least(greatest(2, floor(sqrt(count(*)))), count(*) // 2)::bigint as fan_out, string_agg('node ' || vec_id, chr(10) || chr(10) order by vec_id) filter (where k <= 20) as text from n group by 1
""")
def tree_fanout(t):
    nodes = t("embeddings").select("label", "vec_id")
    text = F.concat(F.lit("node "), F.col("vec_id").cast("string"))
    return trees.cluster_texts(nodes, "label", "vec_id", text, 4000).select("label", "size", N.fan_out(F.col("size")).alias("fan_out"), "text")


@book.add("select n_regionkey as cluster, string_agg(distinct n_name, ',' order by n_name) as source_files, min(n_name) as source_file from nation group by 1")
def cluster_sources(t):
    return trees.cluster_sources(t("nation").withColumnRenamed("n_regionkey", "cluster"), "cluster", "n_name")


@book.add("""
with e as (select 'n' || n_nationkey as src, 'r' || n_regionkey as dst from nation union all select 's' || s_suppkey, 'n' || s_nationkey from supplier),
b as (select src, dst from e union select dst, src from e), s as (select 'r' || r_regionkey as seed from region),
one as (select seed, dst as node, 1 as hops from s join b on seed = src), two as (select seed, b.dst as node, 2 as hops from one join b on one.node = b.src)
select seed, node, min(hops)::bigint as hops from (select * from one union all select * from two) where seed <> node and node not in ('n3', 's4') group by 1, 2
""")
def graph_two_hop(t):
    def name(mark, column):
        return F.concat(F.lit(mark), F.col(column).cast("string"))

    edges = t("nation").select(name("n", "n_nationkey").alias("src"), name("r", "n_regionkey").alias("dst")).unionByName(t("supplier").select(name("s", "s_suppkey").alias("src"), name("n", "s_nationkey").alias("dst")))
    seen = edges.select(F.col("src").alias("node")).where(F.col("src").isin("n3", "s4"))
    return trees.two_hops(t("region").select(name("r", "r_regionkey").alias("seed")), edges, seen)


@book.add("""
with e as (select distinct upper(substr(p_name, 1, 1)) || lower(substr(p_name, 2)) as src, upper(substr(p_brand, 1, 1)) || lower(substr(p_brand, 2)) as dst from part)
select name, count(*) as degree from (select src as name from e union all select dst from e) group by 1
""")
def entity_degrees(t):
    triplets = t("part").select(F.col("p_name").alias("subject"), F.lit("made by").alias("relation"), F.col("p_brand").alias("object"))
    return trees.merge_entities(triplets)[0]


@book.add()
def kmeans_tree(t):
    """Levels of clusters over the vectors: (level, nodes, edges up). Tests hold its invariants."""
    leaves = t("embeddings").where("embedding is not null").select(F.col("vec_id").cast("string").alias("node_id"), F.col("embedding").alias("v"))
    nodes, edges = trees.build_tree(leaves, trees.mean_members)
    up = edges.groupBy(F.col("child_id").alias("node_id")).agg(F.count(F.lit(1)).alias("parents"))
    return nodes.join(up, "node_id", "left").groupBy("level").agg(F.count(F.lit(1)).alias("nodes"), F.sum(F.coalesce("parents", F.lit(0))).alias("edges"))


QUERIES, SQL = book.queries, book.sql
