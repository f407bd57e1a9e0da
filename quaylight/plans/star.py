"""Queries over the star schema and the event log: every kind of join, aggregate, window and set operation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaylight.operators import intervals
from quaylight.plans.registry import query
from quaylight.sources.tables import table


def _t(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [table(spark, d, n) for n in names]


def _net() -> Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


@query("star_pricing_summary", """
select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc, round(avg(l_discount), 6) as avg_disc, count(*) as n
from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2""")
def star_pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return t.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(_net()), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n")
    )


@query("star_open_orders", """
select o_orderkey, o_orderdate, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey
where c_mktsegment = 'BUILDING' group by 1, 2 order by revenue desc, o_orderkey limit 10""")
def star_open_orders(spark: SparkSession, d: str) -> DataFrame:
    c, o, li = _t(spark, d, "customer", "orders", "lineitem")
    j = c.where("c_mktsegment = 'BUILDING'").join(o, c.c_custkey == o.o_custkey).join(li, li.l_orderkey == o.o_orderkey)
    return j.groupBy("o_orderkey", "o_orderdate").agg(F.round(F.sum(_net()), 2).alias("revenue")).orderBy(F.desc("revenue"), "o_orderkey").limit(10)


@query("star_nation_revenue", """
select n_name, r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey and c_nationkey = s_nationkey group by 1, 2""")
def star_nation_revenue(spark: SparkSession, d: str) -> DataFrame:
    li, s, n, r, o, c = _t(spark, d, "lineitem", "supplier", "nation", "region", "orders", "customer")
    j = li.join(s, li.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).join(o, li.l_orderkey == o.o_orderkey)
    j = j.join(c, (o.o_custkey == c.c_custkey) & (c.c_nationkey == s.s_nationkey))
    return j.groupBy("n_name", "r_name").agg(F.round(F.sum(_net()), 2).alias("revenue"))


@query("star_forecast", "select round(sum(l_extendedprice * l_discount), 2) as revenue, count(*) as n from lineitem where l_discount between 0.05 and 0.07 and l_quantity < 24")
def star_forecast(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").where(F.col("l_discount").between(0.05, 0.07) & (F.col("l_quantity") < 24))
    return t.agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"), F.count("*").alias("n"))


@query("star_priority_counts", """
select o_orderpriority, count(*) as n from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') group by 1""")
def star_priority_counts(spark: SparkSession, d: str) -> DataFrame:
    """Semi join."""
    o, li = _t(spark, d, "orders", "lineitem")
    return o.join(li.where("l_returnflag = 'R'"), o.o_orderkey == li.l_orderkey, "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("star_idle_customers", "select c_mktsegment, count(*) as n, round(sum(c_acctbal), 2) as balance from customer where not exists (select 1 from orders where o_custkey = c_custkey) group by 1")
def star_idle_customers(spark: SparkSession, d: str) -> DataFrame:
    """Anti join."""
    c, o = _t(spark, d, "customer", "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("star_orders_per_customer", """
select k, count(*) as customers from (select c_custkey, count(o_orderkey) as k from customer left join orders on o_custkey = c_custkey and o_orderstatus <> 'P' group by 1) group by 1""")
def star_orders_per_customer(spark: SparkSession, d: str) -> DataFrame:
    """Outer join, counts of counts."""
    c, o = _t(spark, d, "customer", "orders")
    o = o.where("o_orderstatus <> 'P'")
    return c.join(o, c.c_custkey == o.o_custkey, "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("k")).groupBy("k").agg(F.count("*").alias("customers"))


@query("star_suppliers_and_customers", """
select coalesce(s.k, c.k) as nationkey, coalesce(suppliers, 0) as suppliers, coalesce(customers, 0) as customers from (select s_nationkey as k, count(*) as suppliers from supplier where s_acctbal > 5000 group by 1) s
full join (select c_nationkey as k, count(*) as customers from customer where c_acctbal > 9000 group by 1) c on s.k = c.k""")
def star_suppliers_and_customers(spark: SparkSession, d: str) -> DataFrame:
    """Full outer join."""
    s, c = _t(spark, d, "supplier", "customer")
    a = s.where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").alias("suppliers"))
    b = c.where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("customers"))
    return a.join(b, "nationkey", "full").select("nationkey", F.coalesce("suppliers", F.lit(0)).alias("suppliers"), F.coalesce("customers", F.lit(0)).alias("customers"))


@query("star_promo_share", "select round(100 * sum(case when p_type like 'PROMO%' then l_extendedprice * (1 - l_discount) else 0 end) / sum(l_extendedprice * (1 - l_discount)), 6) as share from lineitem join part on l_partkey = p_partkey")
def star_promo_share(spark: SparkSession, d: str) -> DataFrame:
    li, p = _t(spark, d, "lineitem", "part")
    j = li.join(p, li.l_partkey == p.p_partkey)
    return j.agg(F.round(100 * F.sum(F.when(F.col("p_type").startswith("PROMO"), _net()).otherwise(0.0)) / F.sum(_net()), 6).alias("share"))


@query("star_large_orders", """
select o_custkey, o_orderkey, q from orders join (select l_orderkey, sum(l_quantity) as q from lineitem group by 1 having sum(l_quantity) > 200) on l_orderkey = o_orderkey""")
def star_large_orders(spark: SparkSession, d: str) -> DataFrame:
    o, li = _t(spark, d, "orders", "lineitem")
    big = li.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q")).where("q > 200")
    return o.join(big, o.o_orderkey == big.l_orderkey).select("o_custkey", "o_orderkey", "q")


@query("star_rollup", "select n_regionkey, c_mktsegment, count(*) as n, grouping(n_regionkey) + grouping(c_mktsegment) as level from customer join nation on c_nationkey = n_nationkey group by rollup (n_regionkey, c_mktsegment)")
def star_rollup(spark: SparkSession, d: str) -> DataFrame:
    c, n = _t(spark, d, "customer", "nation")
    g = c.join(n, c.c_nationkey == n.n_nationkey).rollup("n_regionkey", "c_mktsegment")
    return g.agg(F.count("*").alias("n"), (F.grouping("n_regionkey").cast("bigint") + F.grouping("c_mktsegment").cast("bigint")).alias("level"))


@query("star_cube", "select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as q from lineitem group by cube (l_returnflag, l_linestatus)")
def star_cube(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query("star_grouping_sets", "select o_orderstatus, o_orderpriority, count(*) as n from orders group by grouping sets ((o_orderstatus), (o_orderpriority), ())")
def star_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.groupingSets([["o_orderstatus"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("star_pivot", "select o_orderpriority, count(*) filter (o_orderstatus = 'F') as f, count(*) filter (o_orderstatus = 'O') as o, count(*) filter (o_orderstatus = 'P') as p from orders group by 1")
def star_pivot(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return g.select("o_orderpriority", *[F.coalesce(x, F.lit(0)).alias(x.lower()) for x in "FOP"])


@query("star_unpivot", "select p_partkey, 'size' as what, cast(p_size as double) as x from part union all select p_partkey, 'price', p_retailprice from part")
def star_unpivot(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return p.unpivot("p_partkey", ["size", "price"], "what", "x")


@query("star_distinct_counts", "select l_returnflag, count(distinct l_suppkey) as suppliers, count(distinct l_partkey) filter (l_quantity > 25) as parts from lineitem group by 1")
def star_distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem")
    return t.groupBy("l_returnflag").agg(F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct(F.when(F.col("l_quantity") > 25, F.col("l_partkey"))).alias("parts"))


@query("star_statistics", "select o_orderstatus, round(stddev_samp(o_totalprice), 4) as sd, round(corr(o_totalprice, o_custkey), 6) as r, round(median(o_totalprice), 4) as med, mode(o_orderpriority) = mode(o_orderpriority) as has_mode from orders group by 1")
def star_statistics(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.groupBy("o_orderstatus").agg(F.round(F.stddev_samp("o_totalprice"), 4).alias("sd"), F.round(F.corr("o_totalprice", "o_custkey"), 6).alias("r"), F.round(F.median("o_totalprice"), 4).alias("med"), F.mode("o_orderpriority").isNotNull().alias("has_mode"))


@query("star_approximate_counts")
def star_approximate_counts(spark: SparkSession, d: str) -> DataFrame:
    """Sketches instead of exact counts: distinct keys and quantiles."""
    t = table(spark, d, "lineitem")
    return t.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"), F.percentile_approx("l_extendedprice", [0.5, 0.99], 10000).alias("quantiles"))


@query("star_top_orders_per_customer", """
select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as n from orders) where n <= 2""")
def star_top_orders_per_customer(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("n", F.row_number().over(w)).where("n <= 2").select("o_custkey", "o_orderkey", "o_totalprice")


@query("star_ranks", "select s_suppkey, rank() over w as r, dense_rank() over w as dr, ntile(4) over (partition by s_nationkey order by s_acctbal, s_suppkey) as q, round(percent_rank() over w, 6) as pr from supplier window w as (partition by s_nationkey order by s_acctbal)")
def star_ranks(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("s_nationkey").orderBy("s_acctbal")
    q = Window.partitionBy("s_nationkey").orderBy("s_acctbal", "s_suppkey")
    return table(spark, d, "supplier").select("s_suppkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("dr"), F.ntile(4).over(q).alias("q"), F.round(F.percent_rank().over(w), 6).alias("pr"))


@query("star_running_totals", """
select o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey), 2) as running, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as before,
 round(avg(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row), 4) as mean3 from orders""")
def star_running_totals(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"), F.lag("o_orderkey").over(w).alias("before"), F.round(F.avg("o_totalprice").over(w.rowsBetween(-2, 0)), 4).alias("mean3"))


@query("star_month_over_month", """
with m as (select date_trunc('month', o_orderdate) as month, round(sum(o_totalprice), 2) as total from orders group by 1) select cast(month as date) as month, total, round(total - lag(total) over (order by month), 2) as change from m""")
def star_month_over_month(spark: SparkSession, d: str) -> DataFrame:
    """Monthly totals are few rows, so one sorted partition of them is bounded."""
    m = table(spark, d, "orders").groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return m.select("month", "total", F.round(F.col("total") - F.lag("total").over(Window.orderBy("month")), 2).alias("change"))


@query("star_union_all", "select c_nationkey as nationkey, 'c' as side from customer union all select s_nationkey, 's' from supplier")
def star_union_all(spark: SparkSession, d: str) -> DataFrame:
    c, s = _t(spark, d, "customer", "supplier")
    return c.select(F.col("c_nationkey").alias("nationkey"), F.lit("c").alias("side")).unionByName(s.select(F.col("s_nationkey").alias("nationkey"), F.lit("s").alias("side")))


@query("star_set_operations", """
select 'both' as what, count(*) as n from (select l_partkey from lineitem where l_returnflag = 'R' intersect select l_partkey from lineitem where l_returnflag = 'A')
union all select 'only_r', count(*) from (select l_partkey from lineitem where l_returnflag = 'R' except select l_partkey from lineitem where l_returnflag = 'A')
union all select 'either', count(*) from (select l_partkey from lineitem where l_returnflag = 'R' union select l_partkey from lineitem where l_returnflag = 'A')""")
def star_set_operations(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    r, a = li.where("l_returnflag = 'R'").select("l_partkey"), li.where("l_returnflag = 'A'").select("l_partkey")
    out = [x.agg(F.lit(n).alias("what"), F.count("*").alias("n")) for n, x in (("both", r.intersect(a)), ("only_r", r.subtract(a)), ("either", r.union(a).distinct()))]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("star_below_average_parts", "select p_partkey, p_retailprice from part p where p_retailprice < (select 0.8 * avg(p_retailprice) from part q where q.p_brand = p.p_brand)")
def star_below_average_parts(spark: SparkSession, d: str) -> DataFrame:
    """Correlated subquery."""
    table(spark, d, "part").createOrReplaceTempView("part_view")
    return spark.sql("select p_partkey, p_retailprice from part_view p where p_retailprice < (select 0.8 * avg(p_retailprice) from part_view q where q.p_brand = p.p_brand)")


@query("star_price_bands", """
select a.p_partkey, count(b.p_partkey) as near from part a join part b on b.p_retailprice between a.p_retailprice - 1 and a.p_retailprice + 1 and a.p_partkey <> b.p_partkey and a.p_brand = b.p_brand group by 1""")
def star_price_bands(spark: SparkSession, d: str) -> DataFrame:
    """Range join by buckets of the width of the band."""
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice")
    b = p.toDF("k2", "p_brand", "price2").withColumn("bk", F.floor("price2"))
    a = p.withColumn("bk", F.explode(F.sequence(F.floor(F.col("p_retailprice") - 1), F.floor(F.col("p_retailprice") + 1))))
    j = a.join(b, ["p_brand", "bk"]).where("p_partkey <> k2 and price2 between p_retailprice - 1 and p_retailprice + 1")
    return j.groupBy("p_partkey").agg(F.count("*").alias("near"))


@query("asof_purchase_before_error", """
select e.event_id, p.event_id as asof_value from (select * from events where event_type = 'error') e asof left join (select user_id, ts, max(event_id) as event_id from events where event_type = 'purchase' group by 1, 2) p on e.user_id = p.user_id and e.ts >= p.ts""")
def asof_purchase_before_error(spark: SparkSession, d: str) -> DataFrame:
    """The latest purchase of the user at or before each error."""
    e = table(spark, d, "events")
    right = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("p"))
    return intervals.asof(e.where("event_type = 'error'").select("user_id", "ts", "event_id"), right, "user_id", "ts", "p").select("event_id", "asof_value")


@query("events_by_hour", "select time_bucket(interval 6 hours, ts, timestamp '1970-01-01') as bucket, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def events_by_hour(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling windows of six hours."""
    return table(spark, d, "events").groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("bucket"), "event_type", "n", "total")


@query("first_three_events", "select user_id, string_agg(event_type, '>' order by event_id) as path from (select *, row_number() over (partition by user_id order by event_id) as n from events) where n <= 3 group by 1")
def first_three_events(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    t = table(spark, d, "events").withColumn("n", F.row_number().over(w)).where("n <= 3")
    return t.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "event_type"))), lambda s: s["event_type"]), ">").alias("path"))
