"""The frame vocabulary: what analysts write on a data frame, as DataFrame plans.

Order is explicit everywhere: rows have no index of their own, so cumulative and shifted columns name
the column they follow.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.operators import stats

from .base import Book

book = Book()


@book.add("""
select o_orderpriority as priority, count(*) as n, count(distinct o_custkey) as customers, round(sum(o_totalprice), 2) as total, round(avg(o_totalprice), 4) as mean,
  min(o_totalprice) as least, max(o_totalprice) as most, round(stddev_samp(o_totalprice), 3) as std, round(var_samp(o_totalprice) / 1e6, 3) as var_millions, round(median(o_totalprice), 4) as median
from orders group by 1
""")
def frame_groupby(t):
    price = F.col("o_totalprice")
    o = t("orders").select(F.col("o_orderpriority").alias("priority"), "o_custkey", "o_totalprice")
    middle = stats.exact_quantiles(o, ["priority"], "o_totalprice", {"median": 0.5}).select("priority", F.round("median", 4).alias("median"))
    return o.groupBy("priority").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("customers"), F.round(F.sum(price), 2).alias("total"), F.round(F.avg(price), 4).alias("mean"), F.min(price).alias("least"),
        F.max(price).alias("most"), F.round(F.stddev_samp(price), 3).alias("std"), F.round(F.var_samp(price) / 1e6, 3).alias("var_millions"),
    ).join(middle, "priority")


@book.add("""
select l_returnflag as flag, round(quantile_cont(l_extendedprice, 0.1), 4) as p10, round(quantile_cont(l_extendedprice, 0.5), 4) as p50, round(quantile_cont(l_extendedprice, 0.95), 4) as p95
from lineitem group by 1
""")
def frame_quantile(t):
    """From running counts by value: no group's values are gathered."""
    rows = t("lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice")
    found = stats.exact_quantiles(rows, ["flag"], "l_extendedprice", {"p10": 0.1, "p50": 0.5, "p95": 0.95})
    return found.select("flag", *[F.round(c, 4).alias(c) for c in ("p10", "p50", "p95")])


@book.add("""
select brand, p_size as mode from (
  select p_brand as brand, p_size, row_number() over (partition by p_brand order by count(*) desc, p_size) as k from part group by 1, 2) where k = 1
""")
def frame_mode(t):
    """The commonest value; of several the smallest."""
    return t("part").groupBy(F.col("p_brand").alias("brand")).agg(F.mode("p_size", True).alias("mode"))


@book.add("select l_orderkey as order_key, round(product(1 - l_discount), 6) as kept from lineitem group by 1")
def frame_product(t):
    return t("lineitem").groupBy(F.col("l_orderkey").alias("order_key")).agg(F.round(F.product(1 - F.col("l_discount")), 6).alias("kept"))


@book.add("""
select user_id, min(case when up = 1 then event_id end) as idxmax, min(case when down = 1 then event_id end) as idxmin from (
  select user_id, event_id, row_number() over (partition by user_id order by value desc, event_id) as up, row_number() over (partition by user_id order by value, event_id) as down from events)
group by 1
""")
def frame_idxmax(t):
    """Where the extremes stand; of several places the first."""
    first = F.struct("value", -F.col("event_id")), F.struct("value", "event_id")
    return t("events").groupBy("user_id").agg(F.max_by("event_id", first[0]).alias("idxmax"), F.min_by("event_id", first[1]).alias("idxmin"))


@book.add("""
select user_id, min(case when a = 1 then value end) as first_value, min(case when d = 1 then value end) as last_value from (
  select user_id, value, row_number() over (partition by user_id order by event_id) as a, row_number() over (partition by user_id order by event_id desc) as d from events) group by 1
""")
def frame_first_last(t):
    return t("events").groupBy("user_id").agg(F.min_by("value", "event_id").alias("first_value"), F.max_by("value", "event_id").alias("last_value"))


@book.add("""
select event_id, round(sum(value) over w, 4) as cumsum, max(value) over w as cummax, min(value) over w as cummin, round(product(1 + value / 1000) over w, 6) as cumprod, count(*) over w as cumcount
from events window w as (partition by user_id order by event_id rows unbounded preceding)
""")
def frame_cumulative(t):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    v = F.col("value")
    return t("events").select(
        "event_id", F.round(F.sum(v).over(w), 4).alias("cumsum"), F.max(v).over(w).alias("cummax"), F.min(v).over(w).alias("cummin"),
        F.round(F.product(1 + v / 1000).over(w), 6).alias("cumprod"), F.count(F.lit(1)).over(w).alias("cumcount"),
    )


@book.add("""
select event_id, lag(value) over w as before, lead(value) over w as after, round(value - lag(value) over w, 4) as diff, round(value / nullif(lag(value) over w, 0) - 1, 6) as pct_change
from events window w as (partition by user_id order by event_id)
""")
def frame_shift(t):
    w = Window.partitionBy("user_id").orderBy("event_id")
    v, before = F.col("value"), F.lag("value").over(w)
    return t("events").select("event_id", before.alias("before"), F.lead("value").over(w).alias("after"), F.round(v - before, 4).alias("diff"), F.round(F.try_divide(v, before) - 1, 6).alias("pct_change"))


@book.add("""
select event_id, rank() over w + (count(*) over (partition by event_type, value) - 1) / 2.0::double as average, rank() over w as least, dense_rank() over w as dense,
  row_number() over (partition by event_type order by value, event_id) as first
from events window w as (partition by event_type order by value)
""")
def frame_rank(t):
    """Ranks by each way of settling ties, from counts by distinct value: no window holds a whole group's rows but that of 'first'."""
    counts = t("events").groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("event_type").orderBy("value")
    below = F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.select("event_type", "value", (below + 1).alias("least"), (below + 1 + (F.col("n") - 1) / 2).alias("average"), F.row_number().over(by).cast("long").alias("dense"))
    place = F.row_number().over(Window.partitionBy("event_type", "value").orderBy("event_id"))
    return t("events").join(ranks, ["event_type", "value"]).select("event_id", "average", "least", "dense", (F.col("least") + place - 1).cast("long").alias("first"))


@book.add("""
select c_mktsegment as segment, c_custkey as key, row_number() over (partition by c_mktsegment order by case when c_custkey % 9 <> 0 then c_acctbal end desc nulls last, c_custkey) as place from customer
""")
def frame_sort_values(t):
    """Missing values come last, whatever the direction."""
    value = F.when(F.col("c_custkey") % 9 != 0, -F.col("c_acctbal"))
    # A place is the running count of what sorts before, over ranges of values, and the place among equals.
    rows = t("customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("key"), value.alias("value"))
    there, missing = rows.where("value is not null"), rows.where("value is null")
    tie = F.row_number().over(Window.partitionBy("segment", "value").orderBy("key"))
    first = there.withColumn("tie", tie).join(stats.value_ranks(there, ["segment"], "value"), ["segment", "value"]).select("segment", "key", (F.col("below") + F.col("tie")).cast("long").alias("place"))
    behind = stats.value_ranks(missing, ["segment"], "key").join(there.groupBy("segment").agg(F.count(F.lit(1)).alias("n")), "segment", "left")
    return first.unionByName(behind.select("segment", "key", (F.coalesce("n", F.lit(0)) + F.col("below") + 1).cast("long").alias("place")))


@book.add("select min(event_id) as event_id, user_id, event_type from events group by user_id, event_type")
def frame_drop_duplicates(t):
    """The first row of each combination."""
    return t("events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@book.add("select event_type, count(*) as n, round(count(*) / (select count(*) from events)::double, 6) as share from events group by 1")
def frame_value_counts(t):
    counts = t("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("event_type", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))  # one row


@book.add("""
with e as (select event_id, user_id, case when event_id % 4 <> 1 then value end as v from events)
select event_id, coalesce(v, 0.0) as filled, v is null as missing, last_value(v ignore nulls) over (partition by user_id order by event_id rows unbounded preceding) as forward,
  first_value(v ignore nulls) over (partition by user_id order by event_id rows between current row and unbounded following) as backward from e
""")
def frame_fillna(t):
    e = t("events").select("event_id", "user_id", F.when(F.col("event_id") % 4 != 1, F.col("value")).alias("v"))
    w = Window.partitionBy("user_id").orderBy("event_id")
    forward = F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    backward = F.first("v", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return e.fillna({"v": 0.0}).select("event_id", F.col("v").alias("filled")).join(
        e.select("event_id", F.col("v").isNull().alias("missing"), forward.alias("forward"), backward.alias("backward")), "event_id"
    )


@book.add("select event_id, value from events where event_id % 4 <> 1 and value is not null")
def frame_dropna(t):
    return t("events").select("event_id", F.when(F.col("event_id") % 4 != 1, F.col("value")).alias("value")).dropna(subset=["value"])


@book.add("select event_id, case event_type when 'error' then 'fault' when 'view' then 'visit' else event_type end as kind from events")
def frame_replace_rename(t):
    return t("events").replace({"error": "fault", "view": "visit"}, subset=["event_type"]).withColumnRenamed("event_type", "kind").select("event_id", "kind")


@book.add("""
select event_id, case when event_id % 3 = 0 then null else json_extract_string(props, '$.k')::double end as number, json_extract_string(props, '$.k')::bigint as whole, value::varchar is not null as shown from events
""")
def frame_to_numeric(t):
    """What is no number becomes missing."""
    k = F.get_json_object("props", "$.k")
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(k, F.lit(" items"))).otherwise(k)
    return t("events").select("event_id", raw.try_cast("double").alias("number"), k.cast("long").alias("whole"), F.col("value").cast("string").isNotNull().alias("shown"))


@book.add("select event_id, abs(value - 10) as distance, round_even(value * 2 - 20, 0) + 0 as rounded from (select event_id, floor(value * 4) / 4 as value from events)")
def frame_abs_round(t):
    """Halves go to the even neighbour."""
    v = F.floor(F.col("value") * 4) / 4
    return t("events").select("event_id", F.abs(v - 10).alias("distance"), (F.bround(v * 2 - 20, 0) + 0.0).alias("rounded"))


@book.add("""
select o_orderkey as key, year(o_orderdate) as year, month(o_orderdate) as month, quarter(o_orderdate) as quarter, day(o_orderdate) as day, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') as first_day,
  o_orderdate >= timestamp '1997-01-01' as late from orders
""")
def frame_dt(t):
    d = F.col("o_orderdate")
    return t("orders").select(
        F.col("o_orderkey").alias("key"), F.year(d).cast("long").alias("year"), F.month(d).cast("long").alias("month"), F.quarter(d).cast("long").alias("quarter"), F.dayofmonth(d).cast("long").alias("day"),
        F.date_format(F.date_trunc("month", d), "yyyy-MM-dd").alias("first_day"), (d >= F.lit("1997-01-01").cast("timestamp")).alias("late"),
    )


@book.add("""
select p_partkey as key, upper(p_name) as upper, lower(p_type) as lower, trim('  ' || p_name || ' ') as stripped, contains(p_name, 'ring') as has, starts_with(p_name, 'red') as starts, ends_with(p_name, 'bolt') as ends from part
""")
def frame_str(t):
    name = F.col("p_name")
    return t("part").select(
        F.col("p_partkey").alias("key"), F.upper(name).alias("upper"), F.lower("p_type").alias("lower"), F.trim(F.concat(F.lit("  "), name, F.lit(" "))).alias("stripped"),
        name.contains("ring").alias("has"), name.startswith("red").alias("starts"), name.endswith("bolt").alias("ends"),
    )


@book.add("""
select s_suppkey as key, 'balance' as variable, s_acctbal as value from supplier union all select s_suppkey, 'nation', s_nationkey::double from supplier
""")
def frame_melt(t):
    """Columns become rows."""
    wide = t("supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("double").alias("nation"))
    return wide.unpivot("key", ["balance", "nation"], "variable", "value")


@book.add("""
select user_id, count(*) filter (where event_type = 'click') as click, count(*) filter (where event_type = 'error') as error, count(*) filter (where event_type = 'purchase') as purchase from events group by 1
""")
def frame_pivot(t):
    """Rows become columns; the values are named, so no job looks for them first."""
    return t("events").groupBy("user_id").pivot("event_type", ["click", "error", "purchase"]).agg(F.count(F.lit(1))).fillna(0)


@book.add("""
select c_custkey as key, c_name as name, c_acctbal as balance, c_mktsegment as segment from customer union all select s_suppkey, s_name, s_acctbal, null from supplier
""")
def frame_concat(t):
    a = t("customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = t("supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True)


@book.add("""
select customer, order_key from (select o_custkey as customer, o_orderkey as order_key, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as k from orders) where k = 3
""")
def frame_iloc(t):
    """A row by its place; the place reaches the shuffle as a group limit."""
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    ranked = t("orders").withColumn("k", F.row_number().over(w)).where("k <= 3")
    return ranked.where("k = 3").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("order_key"))


@book.add("select o_orderkey as order_key, o_totalprice as price from orders where o_orderkey in (1, 5, 77)")
def frame_loc(t):
    """Rows by key: the condition reaches the scan."""
    return t("orders").where(F.col("o_orderkey").isin(1, 5, 77)).select(F.col("o_orderkey").alias("order_key"), F.col("o_totalprice").alias("price"))


@book.add("""
select user_id, bool_and(value > 1) as every, bool_or(value > 90) as some, count(*) filter (where v is null) as missing, count(v) as present
from (select user_id, value, case when event_id % 4 <> 1 then value end as v from events) group by 1
""")
def frame_all_any(t):
    e = t("events").withColumn("v", F.when(F.col("event_id") % 4 != 1, F.col("value")))
    return e.groupBy("user_id").agg(
        F.bool_and(F.col("value") > 1).alias("every"), F.bool_or(F.col("value") > 90).alias("some"), F.count_if(F.col("v").isNull()).alias("missing"), F.count("v").alias("present")
    )


@book.add("""
select 'events' as name, count(*) as rows, 6::bigint as columns, count(*) * 6 as size, 2::bigint as ndim, count(*) = 0 as empty from events
""")
def frame_shape(t):
    e = t("events")
    width = len(e.columns)
    n = F.count(F.lit(1))
    return e.agg(n.alias("rows")).select(
        F.lit("events").alias("name"), "rows", F.lit(width).cast("long").alias("columns"), (F.col("rows") * width).alias("size"), F.lit(2).cast("long").alias("ndim"), (F.col("rows") == 0).alias("empty")
    )


QUERIES, SQL = book.queries, book.sql
