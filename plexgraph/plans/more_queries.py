"""More queries over the driver's tables: functions, aggregates, orders, mutations, profiles, source rules, vectors and stored knowledge."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plexgraph.functions import scalar as S
from plexgraph.operators import analytics as A
from plexgraph.operators import governance as G
from plexgraph.operators import knowledge as K
from plexgraph.operators import loading as L
from plexgraph.operators import schemas as M
from plexgraph.operators.quantiles import quantile
from plexgraph.plans.queries import c, query
from plexgraph.plans.tables import retail_graph, table
from plexgraph.sources import readers


@query("select o_orderkey as id, o_totalprice > 100000 as gt, o_totalprice >= 100000 as ge, o_totalprice < 100000 as lt, o_totalprice <= 100000 as le, o_orderstatus = 'O' as eq, o_orderstatus <> 'O' as ne from orders")
def f03_comparisons(spark, d):
    p, s = c("o_totalprice"), c("o_orderstatus")
    return table(spark, d, "orders").select(c("o_orderkey").alias("id"), (p > 100000).alias("gt"), (p >= 100000).alias("ge"), (p < 100000).alias("lt"), (p <= 100000).alias("le"), (s == "O").alias("eq"), (s != "O").alias("ne"))


@query("select r_regionkey as id, 1 as whole, 2.5 as part, 'x' as text, true as yes, null::varchar as none, date '2024-02-29' as day, r_name as name from region")
def f01_literals(spark, d):
    return table(spark, d, "region").select(c("r_regionkey").alias("id"), F.lit(1).alias("whole"), F.lit(2.5).alias("part"), F.lit("x").alias("text"), F.lit(True).alias("yes"), F.lit(None).cast("string").alias("none"), F.lit("2024-02-29").cast("date").alias("day"), c("r_name").alias("name"))


@query("select c_custkey as id from customer where not (c_acctbal > 0 or c_nationkey is null)")
def f05_not(spark, d):
    return table(spark, d, "customer").where(~((c("c_acctbal") > 0) | c("c_nationkey").isNull())).select(c("c_custkey").alias("id"))


@query("select doc_id as id, lang is null as no_lang, text is not null as has_text from documents")
def f07_null_tests(spark, d):
    return table(spark, d, "documents").select(c("doc_id").alias("id"), c("lang").isNull().alias("no_lang"), c("text").isNotNull().alias("has_text"))


@query("select doc_id as id, regexp_full_match(coalesce(source, '') || chr(10), '(?s)src1\\d?') as a, regexp_full_match(coalesce(source, '') || chr(10) || 'x', '(?s)src1.*') as b from documents")
def f09_whole_regex(spark, d):
    source = F.coalesce("source", F.lit(""))
    return table(spark, d, "documents").select(c("doc_id").alias("id"), S.whole_match(F.concat(source, F.lit("\n")), r"src1\d?").alias("a"), S.whole_match(F.concat(source, F.lit("\nx")), "src1.*").alias("b"))


@query("select o_orderkey as id, case o_orderstatus when 'O' then 'open' when 'F' then 'done' else 'other' end as state from orders")
def f11_simple_case(spark, d):
    return table(spark, d, "orders").select(c("o_orderkey").alias("id"), S.chosen(c("o_orderstatus"), [("O", "open"), ("F", "done")], "other").alias("state"))


@query("select c_custkey as id, upper(c_name) as u, lower(c_mktsegment) as l, left(c_name, 4) as h, length(c_name) as n, round(c_acctbal, 1) as r, abs(c_acctbal) as a, sha256(c_name) as s from customer")
def f12_functions(spark, d):
    call = S.call
    return table(spark, d, "customer").select(c("c_custkey").alias("id"), call("toUpper", c("c_name")).alias("u"), call("toLower", c("c_mktsegment")).alias("l"), call("left", c("c_name"), F.lit(4)).alias("h"), call("length", c("c_name")).alias("n"), call("round", c("c_acctbal"), F.lit(1)).alias("r"), call("abs", c("c_acctbal")).alias("a"), call("sha256", c("c_name")).alias("s"))


@query("with o as (select o_custkey as id, list_sort(list(o_totalprice)) as p from orders group by 1) select id, len(p) as n, len(list_filter(p, lambda x: x > 200000)) > 0 as any_large, array_to_string(list_transform(list_filter(p, lambda x: x > 100000)[:2], lambda x: round(x)::bigint), ',') as two, p[1] as first, p[-1] as last, p[3] as third, list_contains(p, p[1]) as has from o")
def fn_lists(spark, d):
    rows = table(spark, d, "orders").groupBy(c("o_custkey").alias("id")).agg(S.collected(c("o_totalprice")).alias("p"))
    p = c("p")
    two = S.comprehension(p, lambda x: x > 100000, lambda x: F.round(x).cast("long"), 2)
    return rows.select("id", S.size_of(p, "array").alias("n"), S.any_of(p, lambda x: x > 200000).alias("any_large"), F.array_join(two, ",").alias("two"), S.at(p, 0).alias("first"), S.at(p, -1).alias("last"), S.at(p, 2).alias("third"), F.array_contains(p, S.at(p, 0)).alias("has"))


@query("select event_id as id, props ->> '$.k' as k, json_extract_string('{\"a\": {\"b\": ' || event_id || '}}', '$.a.b') as b, json_array_length('[' || event_id || ', 2]') as n from events")
def fn_json(spark, d):
    made = F.concat(F.lit('{"a": {"b": '), c("event_id").cast("string"), F.lit("}}"))
    listed = F.concat(F.lit("["), c("event_id").cast("string"), F.lit(", 2]"))
    return table(spark, d, "events").select(c("event_id").alias("id"), S.json_text(c("props"), "k").alias("k"), S.json_text(made, "a.b").alias("b"), F.json_array_length(listed).alias("n"))


@query("select source, round(avg(length(text)), 4) as mean_length, min(left(text, 20)) as first_text from documents group by 1")
def fn_text_lengths(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.round(F.avg(F.length("text")), 4).alias("mean_length"), F.min(F.left("text", F.lit(20))).alias("first_text"))


@query("select p_partkey as id, upper(p_brand) || '-' || p_size as code, case when p_size > 25 then 'big' else 'small' end as kind from part")
def k_custom(spark, d):
    columns = ["p_brand", "p_size"]
    return table(spark, d, "part").select(c("p_partkey").alias("id"), S.custom("concat(upper(p_brand), '-', p_size)", columns).alias("code"), S.custom("case when p_size > 25 then 'big' else 'small' end", columns).alias("kind"))


@query("select p_partkey as id, (p_size > 10)::varchar = 'true' as b, null::boolean as bad, timestamp '2024-01-02 03:04:05' as at from part")
def k_bool_datetime(spark, d):
    t = S.transform
    return table(spark, d, "part").select(c("p_partkey").alias("id"), t((c("p_size") > 10).cast("string"), "to_bool").alias("b"), t(c("p_name"), "to_bool").alias("bad"), t(F.lit("02/01/2024 03:04:05"), "to_datetime", "%d/%m/%Y %H:%M:%S").cast("timestamp_ntz").alias("at"))


@query("select o_custkey as id, any_value(c_name) as name, count(*) as n from orders join customer on c_custkey = o_custkey group by 1")
def a03_group_by_node(spark, d):
    g = retail_graph(spark, d)
    rows = g.expand(g.scan("c", "Customer"), "c", "PLACED", "o", bare=True)
    return rows.groupBy("c.id").agg(F.first("c").alias("c"), F.count(F.lit(1)).alias("n")).select("id", c("c.c_name").alias("name"), "n")


@query("select o_orderstatus as status, round(avg(o_totalprice), 4) as mean, min(o_totalprice) as low, max(o_totalprice) as high from orders group by 1")
def a06_avg_min_max(spark, d):
    p = c("o_totalprice")
    return table(spark, d, "orders").groupBy(c("o_orderstatus").alias("status")).agg(F.round(F.avg(p), 4).alias("mean"), F.min(p).alias("low"), F.max(p).alias("high"))


@query("select n_regionkey as region, round(coalesce(stddev_samp(n_nationkey), case when count(*) > 0 then 0 end), 6) as spread, quantile_cont(n_nationkey, 0.9) as upper from nation group by 1")
def a09_spread_percentile(spark, d):
    k = c("n_nationkey")
    return table(spark, d, "nation").groupBy(c("n_regionkey").alias("region")).agg(F.round(S.spread(k), 6).alias("spread"), F.percentile(k, 0.9).alias("upper"))


@query("select l_returnflag as flag, count(distinct l_suppkey) as n, sum(distinct l_linenumber) as s, array_to_string(list_sort(list(distinct l_linenumber)), ',') as all from lineitem group by 1")
def a11_distinct(spark, d):
    k = c("l_linenumber")
    return table(spark, d, "lineitem").groupBy(c("l_returnflag").alias("flag")).agg(F.count_distinct("l_suppkey").alias("n"), F.sum_distinct(k).alias("s"), F.array_join(S.collected(k, distinct=True), ",").alias("all"))


@query("with s as (select ts::date as day, round(sum(value), 4) as value from events group by 1) select day, row_number() over (order by day) - 1 as i, round(coalesce((value / lag(value) over (order by day) - 1) * 100, 0), 4) as change from s")
def w02_change_and_index(spark, d):
    days = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 4).alias("value"))
    return A.temporal(days, "day", "value").select("day", c("index").alias("i"), F.round("pct_change", 4).alias("change"))


@query("select l_partkey as id, round(sum(l_quantity), 2) as score from lineitem group by 1 order by score desc, id limit 20")
def w05_top_scores(spark, d):
    return A.top_ranks(table(spark, d, "lineitem").groupBy(c("l_partkey").alias("id")).agg(F.sum("l_quantity").alias("score")))


@query("select id, balance, row_number() over (order by balance desc nulls first, id) as k from (select c_custkey as id, case when c_custkey % 3 > 0 then c_acctbal end as balance from customer) order by k limit 50")
def o02_null_order(spark, d):
    rows = table(spark, d, "customer").select(c("c_custkey").alias("id"), F.when(c("c_custkey") % 3 > 0, c("c_acctbal")).alias("balance"))
    return rows.orderBy(S.descending(c("balance")), "id").limit(50).withColumn("k", F.row_number().over(Window.orderBy(S.descending(c("balance")), "id")))


@query("select o_orderkey as id from orders order by case when o_orderpriority = '1-URGENT' then 0 when o_orderstatus = 'O' then 1 else 2 end, o_orderdate desc, o_orderkey limit 1")
def o08_priority_pick(spark, d):
    rank = F.when(c("o_orderpriority") == "1-URGENT", 0).when(c("o_orderstatus") == "O", 1).otherwise(2)
    return table(spark, d, "orders").orderBy(rank, F.desc("o_orderdate"), "o_orderkey").limit(1).select(c("o_orderkey").alias("id"))


@query("select * from (select c_custkey as id, case when c_custkey % 2 = 0 then c_acctbal end as balance from customer order by id limit 200) order by balance nulls last, id")
def o09_table_sort(spark, d):
    rows = table(spark, d, "customer").select(c("c_custkey").alias("id"), F.when(c("c_custkey") % 2 == 0, c("c_acctbal")).alias("balance"))
    return rows.orderBy("id").limit(200).orderBy(c("balance").asc_nulls_last(), "id")


@query("select * from ((select 'order' as kind, o_orderkey as id from orders order by o_totalprice desc, id limit 5) union all (select 'customer', c_custkey from customer order by c_acctbal, c_custkey limit 7)) order by kind, id limit 9")
def u03_branch_modifiers(spark, d):
    orders = table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5).select(F.lit("order").alias("kind"), c("o_orderkey").alias("id"))
    customers = table(spark, d, "customer").orderBy("c_acctbal", "c_custkey").limit(7).select(F.lit("customer").alias("kind"), c("c_custkey").alias("id"))
    return orders.unionByName(customers).orderBy("kind", "id").limit(9)


@query("select o_orderstatus as status, count(*) as n from (select * from orders order by o_totalprice desc, o_orderkey limit 100) group by 1")
def c03_aggregate_of_limited(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).groupBy(c("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("select distinct c_custkey as id from customer where list_has_any([c_mktsegment, c_nationkey::varchar], ['BUILDING', '3'])")
def j_array_overlap(spark, d):
    values = F.array("c_mktsegment", c("c_nationkey").cast("string"))
    return table(spark, d, "customer").where(F.arrays_overlap(values, F.array(F.lit("BUILDING"), F.lit("3")))).select(c("c_custkey").alias("id"))


@query("select c_custkey as id from customer where c_custkey not in (select o_custkey from orders join lineitem on l_orderkey = o_orderkey where l_quantity > 49)")
def j_anti_two_hops(spark, d):
    g = retail_graph(spark, d)
    rows = g.expand(g.expand(g.scan("c", "Customer"), "c", "PLACED", "o", bare=True), "o", "CONTAINS", "p", edge="l", bare=True).where("l.quantity > 49")
    return g.scan("c", "Customer").join(rows.select(c("c.id").alias("found")), c("c.id") == c("found"), "left_anti").select("c.id")


@query("with recursive e as (select distinct conv_id * 1000 + turn as a, conv_id * 1000 + turn + 1 as b from conversations where conv_id * 1000 + turn + 1 in (select conv_id * 1000 + turn from conversations)), w as (select distinct conv_id * 1000 + turn as s, conv_id * 1000 + turn as t, 0 as hops from conversations union all select s, b, hops + 1 from w join e on t = a) select s as start_id, t as end_id, hops from w")
def p08_unbounded_range(spark, d):
    g = retail_graph(spark, d)
    return g.trails("NEXT", g.nodes("Turn").select("id").distinct(), 0, None).select(c("start").alias("start_id"), c("end").alias("end_id"), "hops")


@query("select n_nationkey as id from nation where n_nationkey in (select s_nationkey from supplier where s_acctbal > 9000)")
def p12_exists_both(spark, d):
    g = retail_graph(spark, d)
    return g.exists(g.scan("n", "Nation"), "n", "BASED_IN", "Supplier", "both", c("x.s_acctbal") > 9000).select("n.id")


_CHAINS = "with recursive e as (select distinct conv_id * 1000 + turn as a, conv_id * 1000 + turn + 1 as b from conversations where conv_id * 1000 + turn + 1 in (select conv_id * 1000 + turn from conversations)), w as (select a as s, b as t, 1 as hops from e where a in (select min(conv_id * 1000 + turn) from conversations group by conv_id) union all select s, b, hops + 1 from w join e on t = a)"
_LASTS = "(select max(conv_id * 1000 + turn) from conversations group by conv_id)"


def _ends(spark, d):
    turns = retail_graph(spark, d).nodes("Turn").groupBy("conv_id").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    return turns.select(c("first").alias("id")), turns.select(c("last").alias("id"))


@query(f"{_CHAINS} select s as start_id, t as end_id, hops from w where t in {_LASTS}")
def pf1_shortest_to_ends(spark, d):
    first, last = _ends(spark, d)
    return retail_graph(spark, d).shortest(("NEXT",), first, last).select(c("start").alias("start_id"), c("end").alias("end_id"), "hops")


@query(f"{_CHAINS} select s as start_id, t as end_id, hops from w where t in {_LASTS}")
def pf3_all_paths(spark, d):
    first, last = _ends(spark, d)
    return retail_graph(spark, d).all_paths("NEXT", first, last).select(c("start").alias("start_id"), c("end").alias("end_id"), "hops")


@query("select 'PLACED' as kind, o_orderkey as dst from orders join customer on c_custkey = o_custkey where c_mktsegment = 'BUILDING'")
def ga6_scope(spark, d):
    g = retail_graph(spark, d)
    return g.scope(("Customer", "Order"), where={"Customer": c("c_mktsegment") == "BUILDING"}).select("kind", "dst")


@query("select o_orderkey as id from orders, (select avg(o_totalprice) as m, stddev_pop(o_totalprice) as sd, quantile_cont(o_totalprice, 0.25) as q1, quantile_cont(o_totalprice, 0.75) as q3 from orders) where abs((o_totalprice - m) / sd) > 1.5 or o_totalprice < q1 - 0.5 * (q3 - q1) or o_totalprice > q3 + 0.5 * (q3 - q1)")
def r7_recipe(spark, d):
    return A.run_recipe("anomalies", table(spark, d, "orders"), value="o_totalprice", z=1.5, fence=0.5).select(c("o_orderkey").alias("id"))


def _halves(spark, d):
    rows = table(spark, d, "customer").select(c("c_custkey").alias("id"), c("c_name").alias("name"))
    return rows.where("id % 2 = 0"), rows.where("id % 3 = 0").select("id", F.upper("name").alias("name"))


_H = "with o as (select c_custkey as id, c_name as name from customer where c_custkey % 2 = 0), n as (select c_custkey as id, upper(c_name) as name from customer where c_custkey % 3 = 0)"


@query(_H + " select * from o union all select * from n where id not in (select id from o)")
def l03_error_without_clash(spark, d):
    old, new = _halves(spark, d)
    return L.upsert(old, new.join(old, "id", "left_anti"), ["id"], "error")


@query("select o_custkey as id, max(o_orderkey) as last_order from orders group by 1")
def l07_duplicates_in_a_batch(spark, d):
    new = table(spark, d, "orders").select(c("o_custkey").alias("id"), c("o_orderkey").alias("last_order"))
    return L.upsert(new.where("false"), new, ["id"], order=c("last_order"))


@query("select case when o_custkey % 2 = 0 then o_custkey + 1 else o_custkey end as src, o_orderkey as dst from orders where o_orderkey % 2 = 0 union select o_custkey, o_orderkey from orders where o_orderkey % 3 = 0 and o_custkey % 2 = 1")
def l05_edges_over_old(spark, d):
    edges = table(spark, d, "orders").select(c("o_custkey").alias("src"), c("o_orderkey").alias("dst"))
    old = edges.where("dst % 2 = 0").select(F.when(c("src") % 2 == 0, c("src") + 1).otherwise(c("src")).alias("src"), "dst")
    nodes = edges.select(c("src").alias("id")).distinct()
    return L.upsert_edges(old, edges.where("dst % 3 = 0"), nodes.where("id % 2 = 1"), edges.select(c("dst").alias("id")))


@query("select 'events' as \"table\", '10' as watermark, 'number' as kind, 3 + (select count(*) from region) as record_count")
def l10_checkpoint(spark, d):
    old = spark.createDataFrame([("events", "9", "number", 3)], "table string, watermark string, kind string, record_count long")
    return L.checkpointed(old, table(spark, d, "region").select((c("r_regionkey") + 6).alias("k")), "events", "k")


@query("select 'Customer' as graph_label, 'node' as element, count(*) as record_count, 'partial' as status, 'a,b,c' as errors from customer")
def l11_lineage(spark, d):
    counts = table(spark, d, "customer").agg(F.count(F.lit(1)).alias("record_count"))
    return L.lineage(counts, "Customer", "node", ["a", "b", "c", "d"]).withColumn("errors", F.array_join("errors", ","))


@query(_H + " select 'update' as conflict, count(*) filter (where id not in (select id from o)) as created, count(*) filter (where id in (select id from o)) as updated, 0 as \"left\" from n")
def l12_dry_run(spark, d):
    return L.dry_run(*_halves(spark, d), ["id"])


@query("select p_partkey as id, 'size' as errors from part where p_size > 40")
def k3_load_errors(spark, d):
    rows = table(spark, d, "part").select(c("p_partkey").cast("string").alias("id"), F.when(c("p_size") > 40, "big").otherwise(c("p_size").cast("string")).alias("size"))
    return L.load_batch(rows, {"id": "long", "size": "int"})[1].select(c("id").cast("long").alias("id"), F.array_join("errors", ",").alias("errors"))


@query("select o_custkey as src, o_orderkey as dst from orders union all select c_custkey, 1000000 + c_custkey from customer where c_acctbal < 0")
def m2_create_edges(spark, d):
    g = retail_graph(spark, d)
    edges = g.edges("PLACED").select("src", "dst")
    poor = g.nodes("Customer").where("c_acctbal < 0").select(c("id").alias("src"), (c("id") + 1000000).alias("dst"))
    nodes = g.nodes("Customer").select("id").union(poor.select("dst"))
    return L.create_edges(edges, poor.union(spark.createDataFrame([(-5, 1)], "src long, dst long")), nodes)


@query("select c_custkey as id, case when c_custkey % 10 = 0 then 'seen' else c_mktsegment end as segment from customer union all select -1, 'new'")
def m3_merge_nodes(spark, d):
    rows = table(spark, d, "customer").select(c("c_custkey").alias("id"), c("c_mktsegment").alias("segment"))
    wanted = rows.where("id % 10 = 0").select("id").union(spark.createDataFrame([(-1,), (-1,)], "id long"))
    return L.merge_nodes(rows, wanted, ["id"], {"segment": F.lit("new")}, {"segment": F.lit("seen")})


@query("select o_custkey as src, o_orderkey as dst from orders union select c_custkey, 1 from customer where c_custkey < 4")
def m4_merge_edges(spark, d):
    g = retail_graph(spark, d)
    edges = g.edges("PLACED").select("src", "dst")
    some = g.nodes("Customer").where("id < 4").select(c("id").alias("src"), F.lit(1).cast("long").alias("dst"))
    nodes = g.nodes("Customer").select("id").union(g.nodes("Order").select("id"))
    return L.merge_edges(edges, some.union(edges), nodes)


@query("select c_custkey as id, case when c_acctbal < 0 then 0 else c_acctbal end as balance from customer")
def m5_set_property(spark, d):
    rows = table(spark, d, "customer").select(c("c_custkey").alias("id"), c("c_acctbal").alias("balance"))
    return L.set_property(rows, "balance", F.lit(0.0), c("balance") < 0)


@query("select 'Customer' as label, count(*) filter (where c_acctbal >= 0) as n from customer union all select 'Unlabelled', count(*) filter (where c_acctbal < 0) from customer")
def m8_remove_label(spark, d):
    rows = table(spark, d, "customer")
    keep, gone = L.remove_label(rows, rows.where("false"), c("c_acctbal") < 0)
    return keep.select(F.lit("Customer").alias("label")).union(gone.select(F.lit("Unlabelled"))).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("select count(*) + 1 as n, count(*) filter (where n_regionkey = 1) as renamed from nation")
def m9_mutations_in_order(spark, d):
    rows = table(spark, d, "nation").select(c("n_nationkey").cast("long").alias("id"), c("n_name").alias("name"), c("n_regionkey").alias("region"))
    done = L.mutate({"n": rows}, ("n", lambda t: L.set_property(t["n"], "name", F.lit("?"), c("region") == 1)), ("n", lambda t: L.create(t["n"], spark.createDataFrame([(99, "new")], "id long, name string"))))
    return done["n"].agg(F.count(F.lit(1)).alias("n"), F.count_if(c("name") == "?").alias("renamed"))


@query("select c_custkey as id, 'tenant-1' as tenant from customer")
def se2_write_ownership(spark, d):
    return L.owned(table(spark, d, "customer").select(c("c_custkey").alias("id"), F.lit("other").alias("tenant")), "tenant", "tenant-1")


@query("select 'exists c_name' as \"constraint\", count(*) filter (where c_name is null) as violations from customer union all select 'unique c_nationkey', coalesce(sum(n) filter (where n > 1), 0) from (select count(*) as n from customer where c_nationkey is not null group by c_nationkey) union all select 'key c_custkey', 0")
def d1_constraints(spark, d):
    return M.violations(table(spark, d, "customer"), unique=("c_nationkey",), exists=("c_name",), key=("c_custkey",))


@query("select 'o_orderpriority' as \"column\", count(*) filter (where o_orderpriority is null) as n_null, count(distinct o_orderpriority) as n_distinct, min(o_orderpriority) as lowest, max(o_orderpriority) as highest, count(distinct o_orderpriority) <= 30 as sampled from orders union all select 'o_totalprice', count(*) filter (where o_totalprice is null), null, null, null, false from orders")
def pr6_column_statistics(spark, d):
    rows = G.column_statistics(table(spark, d, "orders"), ["o_orderpriority", "o_totalprice"])
    price = c("column") == "o_totalprice"
    return rows.select("column", "n_null", *[F.when(~price, c(x)).alias(x) for x in ("n_distinct", "lowest", "highest")], "sampled")


@query("select distinct left(source, 200) as value from documents where source is not null order by value")
def pr7_sample_policy(spark, d):
    return G.sampled_values(table(spark, d, "documents"), "source")


@query("select 'n_name' as \"column\", 'from ' || min(n_name) || ' to ' || max(n_name) || ', ' || count(distinct n_name) || ' values' as text from nation union all select 'one', 'always 1'")
def pr11_enrichment(spark, d):
    rows = table(spark, d, "nation").select("n_name", F.lit("1").alias("one"))
    return G.enrichment(G.column_statistics(rows))


@query("select 'custom' as rule, count(*) filter (where o_totalprice < 1000) as violations, count(*) as total, round((count(*) - count(*) filter (where o_totalprice < 1000)) / count(*) * 100, 6) as score, null::varchar as error from orders union all select 'broken', null, null, null, 'AnalysisException'")
def q7_rules_with_failures(spark, d):
    orders = table(spark, d, "orders")
    rules = {"custom": lambda: G.custom_rule(orders.agg(F.count_if(c("o_totalprice") < 1000).alias("violations"), F.count(F.lit(1)).alias("total"))), "broken": lambda: G.completeness(orders, "no_such_column")}
    return G.run_rules(spark, rules).select("rule", "violations", "total", F.round("score", 6).alias("score"), "error")


@query("select * from (values ('audit_x', 'audit'), ('y_tmp', 'temporary'), ('none', 'empty')) as t(\"table\", reason)")
def sa8_exclusions(spark, d):
    return spark.createDataFrame(M.exclusions({"audit_x": 1, "y_tmp": 2, "none": 0, "orders": table(spark, d, "orders").count()}), "table string, reason string")


@query("with t as (select distinct conv_id * 1000 + turn as k from conversations) select (select count(*) from region) + (select count(*) from nation) + (select count(*) from customer) + (select count(*) from supplier) + (select count(*) from part) + (select count(*) from orders) + (select count(*) from conversations) as nodes, (select count(*) from nation) + (select count(*) from customer) + (select count(*) from supplier) + (select count(*) from orders) + (select count(*) from lineitem) + (select count(*) from (select distinct l_partkey, l_suppkey from lineitem)) + (select count(*) from t a join t b on b.k = a.k + 1) as edges")
def x5_totals(spark, d):
    return retail_graph(spark, d).totals()


@query("select 'id' as property, 'bigint' as type, true as mandatory union all select 'n_name', 'string', true union all select 'n_regionkey', 'int', true")
def x6_properties(spark, d):
    return retail_graph(spark, d).properties("Nation")


@query("select vec_id as id, case when vec_id % 2 = 0 then 1 else 0 end as fresh from embeddings")
def v1_upsert_vectors(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", F.lit(0).alias("fresh"))
    size = table(spark, d, "embeddings").select(F.size("embedding").alias("n")).first().n
    new = K.upsert_vectors(rows, rows.where("vec_id % 2 = 0").withColumn("fresh", F.lit(1)), "vec_id", "embedding", size)
    return new.select(c("vec_id").alias("id"), "fresh")


@query("with q as (select embedding from embeddings where vec_id = 0) select vec_id as id, round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 5) as score from embeddings e, q where label = 1 order by list_cosine_similarity(e.embedding::double[], q.embedding::double[]) desc, vec_id limit 10")
def v3_filtered_topk(spark, d):
    rows = table(spark, d, "embeddings")
    asked = rows.where("vec_id = 0").select(c("embedding").alias("q"))
    return K.top_similar(rows, "embedding", asked, 10, "vec_id", {"label": 1}).select(c("vec_id").alias("id"), F.round("score", 5).alias("score"))


@query("select user_id, max(ts) as last_used from events group by 1 having max(ts) >= (select quantile_disc(ts, 0.5) from events)")
def v5_retention(spark, d):
    events = table(spark, d, "events")
    mark = quantile(events, "ts", 0.5)
    used = events.groupBy("user_id").agg(F.max("ts").alias("last_used"))
    return K.retained(used, "last_used", mark) if mark else used


def _entries(spark, d):
    """Documents as knowledge entries."""
    status = F.when(c("doc_id") % 3 == 0, "approved").when(c("doc_id") % 3 == 1, "draft").otherwise("deprecated")
    return table(spark, d, "documents").select(
        c("doc_id").alias("id"), F.coalesce("lang", F.lit("none")).alias("ontology"), status.alias("status"), F.lit(1).alias("version_min"), F.when(c("doc_id") % 2 == 0, 3).alias("version_max"),
        F.array(F.coalesce("source", F.lit("none"))).alias("labels"), ((c("doc_id") % 100) / 100).alias("confidence"), F.date_add(F.lit("2024-01-01").cast("date"), (c("doc_id") % 60).cast("int")).cast("timestamp_ntz").alias("updated_at"),
    )


_ENTRIES = "with k as (select doc_id as id, coalesce(lang, 'none') as ontology, case doc_id % 3 when 0 then 'approved' when 1 then 'draft' else 'deprecated' end as status, 1 as version_min, case when doc_id % 2 = 0 then 3 end as version_max, coalesce(source, 'none') as label, (doc_id % 100) / 100 as confidence, timestamp '2024-01-01' + to_days((doc_id % 60)::int) as updated_at from documents)"


@query(_ENTRIES + " select id, confidence from k where ontology = 'en' and status = 'approved' and version_min <= 4 and (version_max is null or version_max >= 4) and label in ('src0', 'src1') order by confidence desc, id limit 20")
def v7_knowledge_lookup(spark, d):
    return K.lookup(_entries(spark, d), "en", 4, ["src0", "src1"], 20).select("id", "confidence")


@query(_ENTRIES + " select status, ontology, count(*) as n from k group by 1, 2")
def t4_knowledge_counts(spark, d):
    return K.counts_by(_entries(spark, d), "status", "ontology")


@query(_ENTRIES + " select id, case when ontology = 'en' and status = 'approved' and label in ('src0', 'src1') then 'stale' else status end as status, case when ontology = 'en' and status = 'approved' and label in ('src0', 'src1') then confidence * 0.5 else confidence end as confidence from k")
def t5_staleness(spark, d):
    return K.stale(_entries(spark, d), "en", ["src0", "src1"]).select("id", "status", "confidence")


@query(_ENTRIES + ", l as (select id, case when confidence < 0.1 and status <> 'deprecated' then 'deprecated' else status end as status, case when confidence < 0.1 and status <> 'deprecated' then timestamp '2024-03-01' else updated_at end as updated_at from k) select * from l where status <> 'deprecated' or updated_at >= timestamp '2024-03-01' - to_days(30)")
def t6_deprecation(spark, d):
    return K.cleaned(_entries(spark, d), F.lit("2024-03-01").cast("timestamp_ntz"), 30).select("id", "status", "updated_at")


@query("select o_orderstatus as graph_label, 'node' as element, count(*) as sources, sum(o_custkey) as records, max(o_orderdate) as last_loaded from orders where o_orderpriority <> '1-URGENT' group by 1")
def t2_lineage_summary(spark, d):
    loads = table(spark, d, "orders").select(c("o_orderstatus").alias("graph_label"), F.lit("node").alias("element"), c("o_custkey").alias("record_count"), c("o_orderdate").alias("completed_at"), F.when(c("o_orderpriority") == "1-URGENT", "running").otherwise("completed").alias("status"))
    return K.lineage_summary(loads)


@query("select c_custkey, c_nationkey from customer")
def se5_deny(spark, d):
    return G.deny(table(spark, d, "customer"), ["c_name", "c_acctbal", "c_mktsegment"])


@query("select r_regionkey as id, '***' as a, null::varchar as b, r_name as e from region")
def se7_map_masking(spark, d):
    rows = table(spark, d, "region").select(c("r_regionkey").alias("id"), F.create_map(F.lit("a"), c("r_name"), F.lit("b"), c("r_name"), F.lit("e"), c("r_name")).alias("m"))
    masked = G.masked_map(rows, "m", ["a", "b"], ["b"])
    return masked.select("id", *[F.try_element_at("m", F.lit(k)).alias(k) for k in "abe"])


_STEPS = ({"p_size": "int", "p_brand": "string", "p_type": "string", "p_name": "string"}, {"p_size": "string", "p_brand": "double", "p_name": "date", "stock": "bigint"})


@query("select p_partkey as id, p_size::varchar as p_size, null::double as p_brand, p_name, 7::bigint as stock from part")
def df4_data_migration(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_size", "p_brand", "p_type", "p_name")
    return M.migrated(rows, M.migration_plan(*_STEPS, {"stock": 7})[0], {"p_partkey": "id"})


@query("select sha256('n_name:string;n_nationkey:int;n_regionkey:int') as checksum")
def df5_checksum(spark, d):
    return spark.createDataFrame([(G.schema_checksum(dict(table(spark, d, "nation").dtypes)),)], "checksum string")


@query("select floor(count(*) filter (where a.s is not null and b.s is not null) * 100 / count(*))::bigint as sync_percent from (select distinct c_nationkey as s from customer where c_nationkey < 20) a full join (select distinct s_nationkey as s from supplier where s_nationkey > 3) b on a.s = b.s")
def df6_sync_percent(spark, d):
    states = G.audit(table(spark, d, "customer").where("c_nationkey < 20").select(c("c_nationkey").alias("label")), table(spark, d, "supplier").where("s_nationkey > 3").select(c("s_nationkey").alias("label")))
    return G.synchronous(states)


@query("select o_orderstatus, arg_max(o_totalprice, struct_pack(a := o_orderdate, b := o_orderkey)) filter (where o_orderpriority = '1-URGENT') as \"1-URGENT\", arg_max(o_totalprice, struct_pack(a := o_orderdate, b := o_orderkey)) filter (where o_orderpriority = '2-HIGH') as \"2-HIGH\" from orders group by 1")
def b2_heatmap_last(spark, d):
    return G.heatmap(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority", G.last_cell("o_totalprice", F.struct("o_orderdate", "o_orderkey")), ["1-URGENT", "2-HIGH"])


@query("select coalesce(lang, '') as name, n_chars::double as value from documents")
def b3_name_values(spark, d):
    return G.name_values(table(spark, d, "documents"), "lang", "n_chars")


@query("select event_type as stage, count(*)::double as value from events group by 1 order by value desc, stage")
def b4_funnel(spark, d):
    return G.funnel(table(spark, d, "events").groupBy(c("event_type").alias("stage")).agg(F.count(F.lit(1)).alias("user_count")))


@query("select o_orderdate as \"at\", o_orderstatus as label from orders")
def b5_timeline(spark, d):
    return G.timeline(table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus"))


@query("select c_custkey as id, case when c_acctbal >= 9000 then 'critical' when c_acctbal >= 5000 then 'warning' else 'normal' end as above, case when c_acctbal <= 0 then 'critical' else 'normal' end as below from customer")
def b6_kpi(spark, d):
    b = c("c_acctbal")
    return table(spark, d, "customer").select(c("c_custkey").alias("id"), G.level(b, 5000, 9000).alias("above"), G.level(b, critical=0, above=False).alias("below"))


@query("select * from (values ('n_nationkey', 'int'), ('n_name', 'string'), ('n_regionkey', 'int')) as t(\"column\", type)")
def s15_describe(spark, d):
    return spark.createDataFrame([x[:2] for x in M.described(table(spark, d, "nation"))], "column string, type string")


@query("select 'orders' as \"table\", count(*) as n from orders union all select 'part', count(*) from part")
def s20_row_counts(spark, d):
    return readers.row_counts({n: table(spark, d, n) for n in ("orders", "part")})


@query("select * from (values ('IN_REGION', 'Nation', 'Region'), ('PLACED', 'Customer', 'Order')) as t(kind, source, target)")
def s26_schema_of_graph(spark, d):
    edges = M.schema_of(retail_graph(spark, d))["edges"]
    return spark.createDataFrame([(k, *edges[k]) for k in ("IN_REGION", "PLACED")], "kind string, source string, target string")


@query("select n_name as name, count(*) as n from nation join customer on c_nationkey = n_nationkey group by 1")
def api_sql_over_views(spark, d):
    g = retail_graph(spark, d)
    return spark.sql("select n.n_name as name, count(*) as n from {nations} n join {lives} e on e.dst = n.id group by 1", nations=g.nodes("Nation"), lives=g.edges("IN_NATION"))
