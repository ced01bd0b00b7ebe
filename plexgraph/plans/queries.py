"""Queries over the driver's tables, one for each operator, beside SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from plexgraph.functions import scalar as S
from plexgraph.operators import analytics as A
from plexgraph.operators import governance as G
from plexgraph.operators import loading as L
from plexgraph.operators.paths import least_costs
from plexgraph.operators.quantiles import quantile
from plexgraph.plans.tables import co_bought, retail_graph, table
from plexgraph.sources import readers
from plexgraph.streaming import incremental
from plexgraph.streaming.buckets import BucketTable

QUERIES, SQL = {}, {}
c = F.col


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query("select n_name as name, count(*) as orders from customer join orders on o_custkey = c_custkey join nation on n_nationkey = c_nationkey where o_totalprice > 100000 group by n_name order by orders desc, name limit 10")
def flagship(spark, d):
    g = retail_graph(spark, d)
    rows = g.expand(g.scan("c", "Customer"), "c", "PLACED", "o", where=c("o.o_totalprice") > 100000)
    rows = g.expand(rows, "c", "IN_NATION", "n")
    return rows.groupBy(c("n.n_name").alias("name")).agg(F.count("o.id").alias("orders")).orderBy(F.desc("orders"), "name").limit(10)


@query("select n_nationkey as id, n_name as name from nation")
def p01_node_scan(spark, d):
    return retail_graph(spark, d).scan("n", "Nation").select("n.id", c("n.n_name").alias("name"))


@query("select c_custkey as id, c_acctbal from customer where c_mktsegment = 'BUILDING'")
def p02_inline_filter(spark, d):
    return retail_graph(spark, d).scan("c", "Customer", c_mktsegment="BUILDING").select("c.id", "c.c_acctbal")


@query("select c_custkey as customer, o_orderkey as placed from customer join orders on o_custkey = c_custkey where o_totalprice > 300000")
def p03_expand_out(spark, d):
    g = retail_graph(spark, d)
    return g.expand(g.scan("c", "Customer"), "c", "PLACED", "o", where=c("o.o_totalprice") > 300000).select(c("c.id").alias("customer"), c("o.id").alias("placed"))


@query("select o_orderkey as placed, c_name as customer from customer join orders on o_custkey = c_custkey where o_orderstatus = 'F'")
def p04_expand_in(spark, d):
    g = retail_graph(spark, d)
    return g.expand(g.scan("o", "Order", o_orderstatus="F"), "o", "PLACED", "c", direction="in").select(c("o.id").alias("placed"), c("c.c_name").alias("customer"))


@query("with e as (select distinct conv_id * 1000 + turn as a, conv_id * 1000 + turn + 1 as b from conversations where conv_id * 1000 + turn + 1 in (select conv_id * 1000 + turn from conversations)), s as (select a, b from e union all select b, a from e where a <> b) select a as id, count(*) as n from s group by a")
def p05_undirected(spark, d):
    g = retail_graph(spark, d)
    return g.expand(g.scan("t", "Turn").dropDuplicates(), "t", "NEXT", "u", "Turn", "both").select("t.id", c("u.id").alias("u")).distinct().groupBy("id").agg(F.count("u").alias("n"))


@query("select o_custkey as customer, l_partkey as part, count(*) as n from orders join lineitem on l_orderkey = o_orderkey group by 1, 2")
def p06_two_hop(spark, d):
    g = retail_graph(spark, d)
    rows = g.expand(g.scan("c", "Customer"), "c", "PLACED", "o", bare=True)
    return g.expand(rows, "o", "CONTAINS", "p", bare=True).groupBy(c("c.id").alias("customer"), c("p.id").alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("with recursive e as (select distinct conv_id * 1000 + turn as a, conv_id * 1000 + turn + 1 as b from conversations where conv_id * 1000 + turn + 1 in (select conv_id * 1000 + turn from conversations)), w as (select a as s, b as t, 1 as hops from e union all select s, b, hops + 1 from w join e on t = a where hops < 3) select s as start_id, t as end_id, hops from w")
def p07_var_length(spark, d):
    g = retail_graph(spark, d)
    return g.trails("NEXT", g.nodes("Turn").select("id").distinct(), 1, 3).select(c("start").alias("start_id"), c("end").alias("end_id"), "hops")


@query("select r_name as region, count(*) as n from region join nation on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey join orders on o_custkey = c_custkey group by 1")
def p08_fixed_path(spark, d):
    g = retail_graph(spark, d)
    rows = g.expand(g.scan("r", "Region"), "r", "IN_REGION", "n", direction="in")
    rows = g.expand(g.expand(rows, "n", "IN_NATION", "c", direction="in"), "c", "PLACED", "o", bare=True)
    return rows.groupBy(c("r.r_name").alias("region")).agg(F.count(F.lit(1)).alias("n"))


@query("select c_custkey as customer, o_orderkey as placed from customer left join orders on o_custkey = c_custkey and o_totalprice > 400000")
def p09_optional(spark, d):
    g = retail_graph(spark, d)
    return g.expand(g.scan("c", "Customer"), "c", "PLACED", "o", where=c("o.o_totalprice") > 400000, optional=True).select(c("c.id").alias("customer"), c("o.id").alias("placed"))


@query("select c_custkey as id from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
def p10_exists(spark, d):
    g = retail_graph(spark, d)
    return g.exists(g.scan("c", "Customer"), "c", "PLACED", where=c("x.o_totalprice") > 300000).select("c.id")


@query("select c_custkey as id from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
def p11_not_exists(spark, d):
    g = retail_graph(spark, d)
    return g.exists(g.scan("c", "Customer"), "c", "PLACED", where=c("x.o_totalprice") > 300000, negate=True).select("c.id")


@query("select r_name as region, s as segment from region, (select distinct c_mktsegment as s from customer)")
def p12_cartesian(spark, d):
    g = retail_graph(spark, d)
    segments = g.nodes("Customer").select(c("c_mktsegment").alias("segment")).distinct()
    return g.scan("r", "Region").crossJoin(segments).select(c("r.r_name").alias("region"), "segment")


@query("select a.l_partkey as part_a, b.l_partkey as part_b, count(*) as n from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_partkey < b.l_partkey group by 1, 2")
def p13_theta(spark, d):
    g = retail_graph(spark, d)
    rows = g.expand(g.expand(g.scan("o", "Order"), "o", "CONTAINS", "p", bare=True), "o", "CONTAINS", "q", bare=True).where("p.id < q.id")
    return rows.groupBy(c("p.id").alias("part_a"), c("q.id").alias("part_b")).agg(F.count(F.lit(1)).alias("n"))


@query("select n_name as nation, count(*) as n from orders join customer on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey join supplier on s_suppkey = l_suppkey and s_nationkey = c_nationkey join nation on n_nationkey = c_nationkey group by 1")
def p14_cyclic(spark, d):
    g = retail_graph(spark, d)
    rows = g.expand(g.expand(g.scan("c", "Customer"), "c", "IN_NATION", "n"), "c", "PLACED", "o", bare=True)
    rows = g.expand(rows, "o", "CONTAINS", "p", edge="l", bare=True).join(g.scan("s", "Supplier"), c("l.supplier") == c("s.id"))
    return g.expand(rows, "s", "BASED_IN", "n").groupBy(c("n.n_name").alias("nation")).agg(F.count(F.lit(1)).alias("n"))


@query("select 'Customer' as label, count(*) as n from customer union all select 'Nation', count(*) from nation union all select 'Order', count(*) from orders union all select 'Part', count(*) from part union all select 'Region', count(*) from region union all select 'Supplier', count(*) from supplier union all select 'Turn', count(*) from conversations")
def p15_label_less(spark, d):
    return retail_graph(spark, d).all_nodes().groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("select o_orderkey as id from orders where (o_totalprice >= 200000) <> (o_orderstatus = 'O') and not o_orderpriority = '1-URGENT'")
def f04_logic(spark, d):
    rows = table(spark, d, "orders").where(S.either_not_both(c("o_totalprice") >= 200000, c("o_orderstatus") == "O") & ~(c("o_orderpriority") == "1-URGENT"))
    return rows.select(c("o_orderkey").alias("id"))


@query("select p_partkey as id from part where p_size in (1, 2, 3) and p_brand is not null and false = false")
def f06_in_null(spark, d):
    return table(spark, d, "part").where(S.one_of(c("p_size"), [1, 2, 3]) & c("p_brand").isNotNull() & ~S.one_of(c("p_size"), [])).select(c("p_partkey").alias("id"))


@query("select c_custkey as id, case when c_acctbal < 0 then 'debt' when c_acctbal < 5000 then 'low' else 'high' end as band, starts_with(c_name, 'Customer#0') as a, suffix(c_name, '9') as b, contains(c_name, '00') as e, regexp_full_match(c_name, 'Customer#0+1\\d*') as r from customer")
def f08_strings_regex_case(spark, d):
    n = c("c_name")
    band = F.when(c("c_acctbal") < 0, "debt").when(c("c_acctbal") < 5000, "low").otherwise("high")
    return table(spark, d, "customer").select(c("c_custkey").alias("id"), band.alias("band"), n.startswith("Customer#0").alias("a"), n.endswith("9").alias("b"), n.contains("00").alias("e"), S.whole_match(n, r"Customer#0+1\d*").alias("r"))


@query("select c_custkey as id, (select count(*) from orders where o_custkey = c_custkey) as n from customer")
def f13_count_subquery(spark, d):
    counts = table(spark, d, "orders").groupBy(c("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "customer").select(c("c_custkey").alias("id")).join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


@query("select c_mktsegment as segment, count(*) as n, count(distinct c_nationkey) as nations, round(sum(c_acctbal), 2) as total, round(avg(c_acctbal), 4) as mean, min(c_acctbal) as low, max(c_acctbal) as high, round(coalesce(stddev_samp(c_acctbal), 0), 4) as spread, round(quantile_cont(c_acctbal, 0.5), 4) as middle from customer group by 1")
def a01_aggregates(spark, d):
    b = c("c_acctbal")
    return table(spark, d, "customer").groupBy(c("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("c_nationkey").alias("nations"), F.round(S.total(b), 2).alias("total"), F.round(F.avg(b), 4).alias("mean"), F.min(b).alias("low"), F.max(b).alias("high"), F.round(S.spread(b), 4).alias("spread"), F.round(F.percentile(b, 0.5), 4).alias("middle"))


@query("select 0 as total, 0 as n")
def a05_empty_sum(spark, d):
    return table(spark, d, "customer").where("false").agg(S.total(c("c_custkey")).alias("total"), F.count(F.lit(1)).alias("n"))


@query("select n_regionkey as region, array_to_string(list_sort(list(n_name)), ',') as names from nation group by 1")
def a08_collect(spark, d):
    return table(spark, d, "nation").groupBy(c("n_regionkey").alias("region")).agg(F.array_join(S.collected(c("n_name")), ",").alias("names"))


@query("select l_suppkey as supplier, count(*) filter (where l_returnflag = 'R') as returned, count(*) as n from lineitem group by 1")
def a13_conditional(spark, d):
    return table(spark, d, "lineitem").groupBy(c("l_suppkey").alias("supplier")).agg(F.count_if(c("l_returnflag") == "R").alias("returned"), F.count(F.lit(1)).alias("n"))


@query("select round(avg(n), 6) as mean, max(n) as most from (select count(*) as n from orders group by o_custkey)")
def a14_two_level(spark, d):
    per = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("most"))


@query("select c_nationkey as nation, count(*) as n from customer group by 1 having count(*) > 60")
def a15_having(spark, d):
    return table(spark, d, "customer").groupBy(c("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n")).where("n > 60")


def _daily(spark, d):
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 4).alias("value"))


_DAILY = "with s as (select ts::date as day, round(sum(value), 4) as value from events group by 1), w as (select day, value, avg(value) over (order by day rows 6 preceding) as m, coalesce((value / lag(value) over (order by day) - 1) * 100, 0) as p, row_number() over (order by day) - 1 as i from s)"


@query(_DAILY + " select day, round(m, 4) as moving_avg, round(p, 4) as pct_change from w")
def w01_moving_average(spark, d):
    return A.temporal(_daily(spark, d), "day", "value").select("day", F.round("moving_avg", 4).alias("moving_avg"), F.round("pct_change", 4).alias("pct_change"))


@query(_DAILY + " select round(regr_slope(value, i), 4) as slope, case when regr_slope(value, i) > 0 then 'increasing' when regr_slope(value, i) < 0 then 'decreasing' else 'flat' end as trend, min(value) as lowest, max(value) as highest, round(avg(value), 4) as mean from w")
def r6_temporal(spark, d):
    return A.trend(A.temporal(_daily(spark, d), "day", "value"), "value").select(F.round("slope", 4).alias("slope"), "trend", "lowest", "highest", F.round("mean", 4).alias("mean"))


@query("select o_custkey as customer, max(o_orderkey) as last_order from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as k from orders) where k = 1 group by 1")
def w04_latest(spark, d):
    return L.latest(table(spark, d, "orders"), ["o_custkey"], F.struct("o_orderdate", "o_orderkey")).select(c("o_custkey").alias("customer"), c("o_orderkey").alias("last_order"))


@query("select o_orderkey as id, o_totalprice as price from orders order by price desc, id offset 5 limit 20")
def o04_skip_limit(spark, d):
    return table(spark, d, "orders").select(c("o_orderkey").alias("id"), c("o_totalprice").alias("price")).orderBy(S.descending(c("price")), "id").offset(5).limit(20)


@query("select o_orderkey as id from orders order by case o_orderpriority when '1-URGENT' then 0 when '2-HIGH' then 1 else 2 end, o_orderkey limit 25")
def o06_case_sort(spark, d):
    rank = F.when(c("o_orderpriority") == "1-URGENT", 0).when(c("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    return table(spark, d, "orders").orderBy(rank, "o_orderkey").limit(25).select(c("o_orderkey").alias("id"))


@query("select event_id as id, ts from events where (ts, event_id) < ((select max(ts) from events), 0) order by ts desc, id desc limit 11")
def o07_keyset(spark, d):
    events = table(spark, d, "events")
    last = events.agg(F.max("ts").alias("at"))
    rows = events.join(F.broadcast(last), F.struct("ts", "event_id") < F.struct(c("at"), F.lit(0).cast("long")))
    return rows.select(c("event_id").alias("id"), "ts").orderBy(F.desc("ts"), F.desc("id")).limit(11)


@query("select c_nationkey as nation from customer union all select s_nationkey from supplier")
def u01_union_all(spark, d):
    return table(spark, d, "customer").select(c("c_nationkey").alias("nation")).unionByName(table(spark, d, "supplier").select(c("s_nationkey").alias("nation")))


@query("select c_nationkey as nation from customer union select s_nationkey from supplier")
def u02_union(spark, d):
    return u01_union_all(spark, d).distinct()


@query("with t as (select o_custkey, sum(o_totalprice) as spent from orders group by 1 order by spent desc, o_custkey limit 20) select c_name as name, n_name as nation from t join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey")
def c01_chain(spark, d):
    g = retail_graph(spark, d)
    best = g.edges_by_type["PLACED"].rows.join(g.nodes("Order"), c("dst") == c("id")).groupBy("src").agg(F.sum("o_totalprice").alias("spent")).orderBy(F.desc("spent"), "src").limit(20)
    rows = g.scan("c", "Customer").join(best, c("c.id") == c("src")).select("c")
    return g.expand(rows, "c", "IN_NATION", "n").select(c("c.c_name").alias("name"), c("n.n_name").alias("nation"))


@query("select o_custkey as customer, o_orderkey as best from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as k from orders) where k <= 2")
def c02_call_subquery(spark, d):
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, d, "orders").withColumn("k", rank).where("k <= 2").select(c("o_custkey").alias("customer"), c("o_orderkey").alias("best"))


@query("select o_orderstatus as status, count(*) as n from orders where o_totalprice > 150000 group by 1")
def c06_report(spark, d):
    return spark.sql("select o_orderstatus as status, count(*) as n from {orders} where o_totalprice > :least group by 1", args={"least": 150000}, orders=table(spark, d, "orders"))


_TURNS = "with recursive e as (select distinct conv_id * 1000 + turn as a, conv_id * 1000 + turn + 1 as b from conversations where conv_id * 1000 + turn + 1 in (select conv_id * 1000 + turn from conversations)), w as (select a as s, b as t, 1 as hops from e where a in (select min(conv_id * 1000 + turn) from conversations group by conv_id) union all select s, b, hops + 1 from w join e on t = a )"


def _paths(spark, d, every):
    g = retail_graph(spark, d)
    first = g.nodes("Turn").groupBy("conv_id").agg(F.min("id").alias("id")).select("id")
    return g.shortest(("NEXT",), first, every=every).select(c("start").alias("start_id"), c("end").alias("end_id"), "hops")


@query(_TURNS + " select s as start_id, t as end_id, min(hops) as hops from w group by 1, 2")
def pf1_shortest(spark, d):
    return _paths(spark, d, False)


@query(_TURNS + " select s as start_id, t as end_id, hops from w")
def pf2_all_shortest(spark, d):
    return _paths(spark, d, True)


@query(_TURNS + " select hops, count(*) as n, round(count(*) * 100.0 / (select count(*) from conversations), 2) as percent from (select s, t, min(hops) as hops from w group by 1, 2) group by 1")
def r3_reachability(spark, d):
    return A.reachability(_paths(spark, d, False), table(spark, d, "conversations"))


_PARTS = "l as (select distinct l_orderkey, l_partkey from lineitem), e as materialized (select distinct a.l_partkey as src, b.l_partkey as dst from l a join l b on a.l_orderkey = b.l_orderkey and a.l_partkey < b.l_partkey)"
_RANKS = ", ".join(f"r{k} as materialized (select nodes.id, 0.15 / (select count(*) from nodes) + 0.85 * coalesce(sum(r.score / g.degree), 0) as score from nodes left join e on e.dst = nodes.id left join g on g.src = e.src left join r{k - 1} r on r.id = e.src group by nodes.id)" for k in range(1, 31))


@query(f"with {_PARTS}, nodes as materialized (select src as id from e union select dst from e), g as materialized (select src, count(*) as degree from e group by src), r0 as (select id, 1.0 / (select count(*) from nodes) as score from nodes), {_RANKS} select id, round(score, 8) as score from r30")
def ga1_pagerank(spark, d):
    return A.pagerank(co_bought(spark, d, repeated=True)).select("id", F.round("score", 8).alias("score"))


@query()
def ga2_communities(spark, d):
    return A.label_propagation(co_bought(spark, d, repeated=True))


def _next_turns(spark, d):
    return retail_graph(spark, d).edges("NEXT").select("src", "dst")


@query("with recursive e as (select distinct conv_id * 1000 + turn as a, conv_id * 1000 + turn + 1 as b from conversations where conv_id * 1000 + turn + 1 in (select conv_id * 1000 + turn from conversations)), w as (select a as s, b as t from e union all select s, b from w join e on t = a) select t as id, (select count(*) from w x where x.t = y.t) * (select count(*) from w x where x.s = y.t)::double as score from (select distinct t from w) y")
def ga3_betweenness(spark, d):
    edges = _next_turns(spark, d)
    return A.betweenness(edges, edges.select(c("src").alias("id")).union(edges.select("dst")).distinct()).where("score is not null").select("id", F.round("score", 6).alias("score"))


@query()
def ga4_dijkstra(spark, d):
    """Least costs from the first part over orders, where a step from part to part costs both quantities.

    An order is a node between its parts (below 0), and each quantity is the weight of one link, so that the pairs of an
    order's parts needn't be made. Quantities below 0 and null ones are an error.
    """
    lines = table(spark, d, "lineitem").where("l_orderkey is not null and l_partkey is not null").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("weight"))
    edges = lines.select(c("l_partkey").cast("long").alias("src"), (-1 - c("l_orderkey").cast("long")).alias("dst"), "weight")
    start = table(spark, d, "part").agg(F.min("p_partkey")).first()[0] or 0
    # a quarter of the most that a step costs would be some 25; a round reads all links, so that few wide buckets take less
    return least_costs(edges, start, delta=100.0, undirected=True).where("id >= 0").select("id", "cost")


_SUPPLIES = "e as (select distinct l_suppkey as src, l_partkey as dst from lineitem)"


@query(f"with {_SUPPLIES}, dg as (select src, count(*) as d from e group by src), s as (select a.src as a, b.src as b, count(*) as shared from e a join e b on a.dst = b.dst and a.src < b.src group by 1, 2) select a, b, shared, round(shared / (x.d + y.d - shared), 4) as jaccard, round(shared / sqrt(x.d * y.d), 4) as cosine from s join dg x on x.src = a join dg y on y.src = b where round(shared / (x.d + y.d - shared), 4) >= 0.01")
def ga5_similarity(spark, d):
    return A.similarity(table(spark, d, "lineitem").select(c("l_suppkey").alias("src"), c("l_partkey").alias("dst")), least=0.01)


@query("with s as (select avg(o_totalprice) as m, stddev_pop(o_totalprice) as sd, quantile_cont(o_totalprice, 0.25) as q1, quantile_cont(o_totalprice, 0.75) as q3 from orders) select o_orderkey as id, abs((o_totalprice - m) / sd) > 1.5 as by_z, o_totalprice < q1 - 0.4 * (q3 - q1) or o_totalprice > q3 + 0.4 * (q3 - q1) as by_iqr from orders, s where abs((o_totalprice - m) / sd) > 1.5 or o_totalprice < q1 - 0.4 * (q3 - q1) or o_totalprice > q3 + 0.4 * (q3 - q1)")
def r5_anomaly(spark, d):
    return A.anomalies(table(spark, d, "orders"), "o_totalprice", 1.5, 0.4).select(c("o_orderkey").alias("id"), "by_z", "by_iqr")


@query("select p_partkey as id, lower(trim(p_name)) as name, try_cast(p_size::varchar as bigint) as size, try_cast(p_brand as double) as none, nullif(split_part(p_brand, '#', 2), '') as brand, (o.o_orderdate)::date as day from part left join orders o on o_orderkey = p_partkey")
def k_transforms(spark, d):
    dates = table(spark, d, "orders").select(c("o_orderkey").alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("t"))
    t = S.transform
    rows = table(spark, d, "part").join(dates, c("k") == c("p_partkey"), "left")
    return rows.select(c("p_partkey").alias("id"), t(t(c("p_name"), "trim"), "to_lower").alias("name"), t(t(c("p_size"), "to_string"), "to_int").alias("size"), t(c("p_brand"), "to_float").alias("none"), t(c("p_brand"), "split", "#", 1).alias("brand"), t(c("t"), "to_date", "%Y-%m-%d").alias("day"))


def _halves(spark, d):
    rows = table(spark, d, "customer").select(c("c_custkey").alias("id"), c("c_name").alias("name"), F.when(c("c_custkey") % 3 > 0, c("c_acctbal")).alias("balance"))
    new = rows.where("id % 4 <> 0").select("id", F.upper("name").alias("name"), F.when(c("id") % 5 > 0, F.lit(1.0)).alias("balance"))
    return rows.where("id % 2 = 0"), new


_HALVES = "with r as (select c_custkey as id, c_name as name, case when c_custkey % 3 > 0 then c_acctbal end as balance from customer), o as (select * from r where id % 2 = 0), n as (select id, upper(name) as name, case when id % 5 > 0 then 1.0 end as balance from r where id % 4 <> 0)"


@query(_HALVES + " select * from n union all select * from o where id not in (select id from n)")
def l01_upsert_update(spark, d):
    return L.upsert(*_halves(spark, d), ["id"], "update")


@query(_HALVES + " select * from o union all select * from n where id not in (select id from o)")
def l02_upsert_skip(spark, d):
    return L.upsert(*_halves(spark, d), ["id"], "skip")


@query(_HALVES + " select coalesce(n.id, o.id) as id, coalesce(n.name, o.name) as name, coalesce(n.balance, o.balance) as balance from o full join n on o.id = n.id")
def l04_upsert_merge(spark, d):
    return L.upsert(*_halves(spark, d), ["id"], "merge_non_null")


@query("select distinct o_custkey as src, o_custkey % 25 as dst from orders where o_custkey in (select c_custkey from customer where c_acctbal > 0) and o_custkey % 25 in (select n_nationkey from nation)")
def l05_upsert_edges(spark, d):
    g = retail_graph(spark, d)
    new = table(spark, d, "orders").select(c("o_custkey").alias("src"), (c("o_custkey") % 25).alias("dst")).distinct()
    return L.upsert_edges(new.where("false"), new, g.nodes("Customer").where("c_acctbal > 0"), g.nodes("Nation"))


@query("select event_id as id, ts from events where ts > (select quantile_disc(ts, 0.9) from events)")
def l09_incremental(spark, d):
    events = table(spark, d, "events")
    mark = quantile(events, "ts", 0.9)
    return (L.increment(events, "ts", mark) if mark else events).select(c("event_id").alias("id"), "ts")


@query("select c_custkey as id, case when c_acctbal < 0 then 'debt' else c_mktsegment end as segment from customer union all select 900001, 'new'")
def m1_create_set(spark, d):
    rows = table(spark, d, "customer").select(c("c_custkey").alias("id"), c("c_mktsegment").alias("segment"), "c_acctbal")
    rows = L.set_property(rows, "segment", F.lit("debt"), c("c_acctbal") < 0).select("id", "segment")
    return L.create(rows, spark.range(1).select(F.lit(900001).cast("long").alias("id"), F.lit("new").alias("segment")))


@query("select o_orderkey as eid, o_custkey as src, o_orderkey as dst from orders where o_custkey not in (select c_custkey from customer where c_acctbal < 0)")
def m6_detach_delete(spark, d):
    g = retail_graph(spark, d)
    return L.delete(g.nodes("Customer"), g.edges_by_type["PLACED"].rows, c("c_acctbal") < 0, detach=True, ends=("src",))[1]


@query("select c_custkey as id, case when c_nationkey <> 3 then c_name end as name from customer")
def m7_remove_property(spark, d):
    return L.remove_property(table(spark, d, "customer").select(c("c_custkey").alias("id"), c("c_name").alias("name"), "c_nationkey"), "name", c("c_nationkey") == 3).select("id", "name")


@query("select 'c_name' as \"column\", count(*) as n, count(*) - count(c_name) as n_null, count(distinct c_name) as n_distinct, min(c_name) as lowest, max(c_name) as highest from customer union all select 'c_nationkey', count(*), count(*) - count(c_nationkey), count(distinct c_nationkey), min(c_nationkey::varchar), max(c_nationkey::varchar) from customer")
def pr1_profile(spark, d):
    return G.profile(table(spark, d, "customer"), ["c_name", "c_nationkey"])


@query("select count(*) as n_edges, count(distinct o_custkey) as n_sources, round(count(*) / count(distinct o_custkey), 6) as avg_degree from orders")
def pr3_edge_profile(spark, d):
    return G.edge_profile(retail_graph(spark, d).edges_by_type["PLACED"].rows).withColumn("avg_degree", F.round("avg_degree", 6))


@query("select distinct o_orderpriority as value from orders order by value limit 30")
def pr7_samples(spark, d):
    return G.sample_values(table(spark, d, "orders"), "o_orderpriority")


@query("with t as (select count(*) as n, count(*) - count(case when c_acctbal > 0 then 1 end) as v from customer), u as (select count(*) as n, coalesce(sum(k) filter (where k > 1), 0) as v from (select c_nationkey, count(*) as m, count(*) as k from customer group by 1)) select 'completeness' as rule, v as violations, n as total, round((n - v) / n * 100, 6) as score from t union all select 'consistency', v, n, round((n - v) / n * 100, 6) from t union all select 'freshness', 0, 1, 100.0 union all select 'uniqueness', v, (select sum(k) from (select count(*) as k from customer)), round(((select count(*) from customer) - v) / (select count(*) from customer) * 100, 6) from u")
def q1_quality_rules(spark, d):
    rows = table(spark, d, "customer").withColumn("positive", F.when(c("c_acctbal") > 0, 1))
    rules = [G.completeness(rows, "positive"), G.consistency(rows, "positive"), G.freshness(rows), G.uniqueness(rows, "c_nationkey")]
    return G.union_of(rules).select("rule", "violations", "total", F.round("score", 6).alias("score"))


@query("select doc_id as id, regexp_matches(text, '@') and contains(text, '.') and length(text) > 5 as email from documents")
def sa3_pii_value(spark, d):
    return table(spark, d, "documents").select(c("doc_id").alias("id"), G.looks_like_email(c("text")).alias("email"))


@query("select c_custkey as id, left(e, 2) || '**@***.com' as masked from (select c_custkey, c_name || '@shop.example.com' as e from customer)")
def sa4_mask_email(spark, d):
    return table(spark, d, "customer").select(c("c_custkey").alias("id"), S.masked_email(F.concat("c_name", F.lit("@shop.example.com"))).alias("masked"))


@query("select 'p_size' as \"column\", count(distinct p_size) as n_distinct, count(distinct p_size) between 2 and 20 as ambiguous from part union all select 'n_regionkey', count(distinct n_regionkey), count(distinct n_regionkey) between 2 and 20 from nation")
def sa7_ambiguous(spark, d):
    return G.ambiguous_codes(table(spark, d, "part"), "p_size").unionByName(G.ambiguous_codes(table(spark, d, "nation"), "n_regionkey"))


@query("select 'Nation' as label, n_nationkey as id from nation where contains(n_name, '1') or contains(n_nationkey::varchar, '1') or contains(n_regionkey::varchar, '1') union all select 'Region', r_regionkey from region where contains(r_name, '1') or contains(r_regionkey::varchar, '1') order by label, id limit 100")
def x1_search(spark, d):
    return retail_graph(spark, d).search("1", ("Nation", "Region"))


@query("select 'IN_NATION' as kind, 'incoming' as direction, c_custkey as id from customer where c_nationkey = 3 union select 'BASED_IN', 'incoming', s_suppkey from supplier where s_nationkey = 3 union select 'IN_REGION', 'outgoing', n_regionkey from nation where n_nationkey = 3 order by kind, direction, id limit 200")
def x2_expand(spark, d):
    return retail_graph(spark, d).neighbours("Nation", 3)


@query("select 'Customer' as label, count(*) as n from customer union all select 'Nation', count(*) from nation union all select 'Order', count(*) from orders union all select 'Part', count(*) from part union all select 'Region', count(*) from region union all select 'Supplier', count(*) from supplier union all select 'Turn', count(*) from conversations")
def x3_labels(spark, d):
    return retail_graph(spark, d).label_counts()


@query("select 'Order' as source, 'CONTAINS' as kind, 'Part' as target, count(*) as n from lineitem union all select 'Customer', 'PLACED', 'Order', count(*) from orders union all select 'Customer', 'IN_NATION', 'Nation', count(*) from customer union all select 'Supplier', 'BASED_IN', 'Nation', count(*) from supplier union all select 'Nation', 'IN_REGION', 'Region', count(*) from nation union all select 'Part', 'SUPPLIED_BY', 'Supplier', count(*) from (select distinct l_partkey, l_suppkey from lineitem) union all select 'Turn', 'NEXT', 'Turn', count(*) from (select distinct conv_id * 1000 + turn as k from conversations where conv_id * 1000 + turn + 1 in (select conv_id * 1000 + turn from conversations))")
def x4_patterns(spark, d):
    return retail_graph(spark, d).relationship_patterns()


@query("with q as (select embedding from embeddings where vec_id = 0) select vec_id as id, round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 5) as score from embeddings e, q order by list_cosine_similarity(e.embedding::double[], q.embedding::double[]) desc, vec_id limit 10")
def v2_cosine_topk(spark, d):
    rows = table(spark, d, "embeddings")
    asked = rows.where("vec_id = 0").select(c("embedding").alias("q"))
    scored = rows.join(F.broadcast(asked.limit(1))).select(c("vec_id").alias("id"), S.cosine(c("embedding"), c("q")).alias("score"))
    return scored.orderBy(S.descending(c("score")), "id").limit(10).select("id", F.round("score", 5).alias("score"))


@query("select doc_id as id from documents where text ilike '%licensed under%' order by doc_id desc limit 50")
def v4_pattern(spark, d):
    pattern = "%" + S.like_escaped("Licensed under") + "%"
    return table(spark, d, "documents").where(c("text").ilike(pattern)).select(c("doc_id").alias("id")).orderBy(F.desc("id")).limit(50)


@query("select o_orderkey as placed from orders join customer on c_custkey = o_custkey where c_mktsegment = 'MACHINERY'")
def se1_tenant(spark, d):
    g = retail_graph(spark, d).secured("c_mktsegment", "MACHINERY")
    return g.edges_by_type["PLACED"].rows.select(c("dst").alias("placed"))


@query("select c_custkey, '***' as c_name, c_nationkey, c_mktsegment from customer")
def se6_mask(spark, d):
    return G.mask(table(spark, d, "customer"), ["c_name", "c_acctbal"], denied=("c_acctbal",))


@query("select 'added_column' as col, 'added' as change union all select 'gone', 'removed' union all select 'n_nationkey', 'widened' union all select 'n_name', 'breaking'")
def df5_drift(spark, d):
    now = dict(table(spark, d, "nation").dtypes)
    was = {k: v for k, v in now.items()} | {"gone": "int"}
    found = G.drift(was, now | {"added_column": "int", "n_nationkey": "bigint", "n_name": "int"})
    return spark.createDataFrame(found, "col string, change string")


@query("select coalesce(a.s, b.s) as label, case when a.s is null then 'orphan' when b.s is null then 'missing' else 'matched' end as state from (select distinct c_nationkey as s from customer where c_nationkey < 20) a full join (select distinct s_nationkey as s from supplier where s_nationkey > 3) b on a.s = b.s")
def df6_audit(spark, d):
    return G.audit(table(spark, d, "customer").where("c_nationkey < 20").select(c("c_nationkey").alias("label")), table(spark, d, "supplier").where("s_nationkey > 3").select(c("s_nationkey").alias("label")))


@query("with s as (select min(o_totalprice) as lo, max(o_totalprice) as hi, least(20, ceil(sqrt(count(*)))) as b from orders) select least(floor((o_totalprice - lo) / (hi - lo) * b), b - 1)::bigint as bin, count(*) as n from orders, s group by 1")
def b1_histogram(spark, d):
    return G.histogram(table(spark, d, "orders"), "o_totalprice")


@query("select o_orderstatus, count(*) filter (where o_orderpriority = '1-URGENT') as \"1-URGENT\", count(*) filter (where o_orderpriority = '2-HIGH') as \"2-HIGH\" from orders group by 1")
def b2_heatmap(spark, d):
    rows = G.heatmap(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority", F.count(F.lit(1)), ["1-URGENT", "2-HIGH"])
    return rows.na.fill(0)


@query("select event_type as type, count(*) as n, round(sum(value), 4) as total from events where ts >= timestamp '1970-01-01' group by 1")
def t1_usage(spark, d):
    return table(spark, d, "events").where(c("ts") >= F.lit("1970-01-01").cast("timestamp_ntz")).groupBy(c("event_type").alias("type")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("select user_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k = 1")
def t3_dashboard(spark, d):
    return L.latest(table(spark, d, "events"), ["user_id"], F.struct("ts", "event_id")).select("user_id", "event_type")


@query("select count(*) = count(distinct c_custkey) as is_key from customer")
def s13_key_inference(spark, d):
    return readers.is_key(table(spark, d, "customer"), "c_custkey")


@query("select 'a' as \"column\", 'int' as type union all select 'b', 'float' union all select 'e', 'string' union all select 'f', 'bool'")
def s12_type_inference(spark, d):
    text = table(spark, d, "part").select(c("p_size").cast("string").alias("a"), c("p_retailprice").cast("string").alias("b"), c("p_name").alias("e"), F.when(c("p_size") > 3, "true").otherwise("False").alias("f"))
    return readers.inferred_types(text)


@query("select user_id, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k = 1")
def st1_available_now(spark, d):
    folder = (spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="spark-stream-")).rstrip("/") + f"/stream-{uuid.uuid4().hex}"
    events = table(spark, d, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("at"))
    events.repartition(8).write.mode("overwrite").parquet(f"{folder}/in")
    target = BucketTable(spark, f"{folder}/out", events.schema, ["user_id"], 16)
    target.consume(incremental.read_stream(spark, f"{folder}/in", events.schema, files_a_batch=3), f"{folder}/mark", order="at").awaitTermination()
    return target.read().select("user_id", "event_id")
