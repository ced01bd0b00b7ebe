"""Graph algorithms over graphs of the tables that branch and merge, beside SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plexgraph.functions.registry import Functions
from plexgraph.operators import analytics as A
from plexgraph.operators import communities as C
from plexgraph.operators import paths as P
from plexgraph.operators import trigrams
from plexgraph.operators.graph import PropertyGraph
from plexgraph.operators.rounds import shared_folder
from plexgraph.operators.vector_index import VectorIndex
from plexgraph.plans.queries import query
from plexgraph.plans.tables import co_bought, retail_graph, table

c = F.col


@query()
def ga2_louvain(spark, d):
    """Communities of parts by their co-purchases, with the modularity that they reach."""
    return C.louvain(co_bought(spark, d, repeated=True), once=True).select("id", "community", F.size("levels").alias("levels"), F.round("modularity", 6).alias("modularity"))


_BOUGHT = "l as (select distinct l_orderkey as o, l_partkey as p from lineitem), e as (select distinct a.p as src, b.p as dst from l a join l b on a.o = b.o and a.p < b.p), s as (select src, dst from e union all select dst, src from e)"


@query(f"with {_BOUGHT}, x as (select p.p_brand as brand, q.p_brand = p.p_brand as same from s join part p on p.p_partkey = src join part q on q.p_partkey = dst), b as (select brand, count(*)::double as total, count(*) filter (where same)::double as inside from x group by 1) select round(sum(inside) / sum(total) - sum(total * total) / (sum(total) * sum(total)), 9) as modularity, count(*) as communities from b")
def ga2_modularity_of_brands(spark, d):
    """How well the parts' brands divide their co-purchases."""
    labels = table(spark, d, "part").select(c("p_partkey").alias("id"), c("p_brand").alias("community"))
    links = C.adjacency(co_bought(spark, d))
    brands = links.select(c("src").alias("id")).distinct().join(labels, "id").agg(F.count_distinct("community").alias("communities"))  # one row
    return C.modularity(links, labels).select(F.round("modularity", 9).alias("modularity")).crossJoin(brands)


_KINDS = {"nation": 0, "customer": 10**9, "order": 2 * 10**9, "part": 3 * 10**9, "supplier": 4 * 10**9}


def _trade(spark, d):
    """Weighted edges nation -> customer -> order -> part -> supplier: an acyclic graph in which many ways meet in a part and in a supplier."""
    at = lambda kind, key: (F.lit(_KINDS[kind]).cast("long") + c(key)).alias("src" if kind != end else "dst")
    parts = []
    whole = lambda x: F.round(F.abs(c(x))).cast("double").alias("weight")
    lines = table(spark, d, "lineitem")
    for start, key, end, other, weight, rows in (
        ("nation", "c_nationkey", "customer", "c_custkey", "c_acctbal", table(spark, d, "customer")),
        ("customer", "o_custkey", "order", "o_orderkey", "o_totalprice", table(spark, d, "orders")),
        ("order", "l_orderkey", "part", "l_partkey", "l_quantity", lines),
        ("part", "l_partkey", "supplier", "l_suppkey", "l_quantity", lines),
    ):
        parts.append(rows.select(at(start, key), at(end, other), whole(weight)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


_WAYS = """with w1 as (select c_nationkey as n, 1000000000 + c_custkey as c, round(abs(c_acctbal)) as w from customer where c_nationkey = 0),
w2 as (select 1000000000 + o_custkey as c, 2000000000 + o_orderkey as o, min(round(abs(o_totalprice))) as w from orders group by 1, 2),
w3 as (select 2000000000 + l_orderkey as o, 3000000000 + l_partkey as p, min(round(l_quantity)) as w from lineitem group by 1, 2),
w4 as (select 3000000000 + l_partkey as p, 4000000000 + l_suppkey as s, min(round(l_quantity)) as w from lineitem group by 1, 2),
customers as (select c as id, w as cost, [n, c] as path, [0.0, w] as costs from w1),
orders_ as (select o as id, cost + w2.w as cost, path || [o] as path, costs || [cost + w2.w] as costs from customers join w2 on c = id),
parts as (select p as id, cost + w3.w as cost, path || [p] as path, costs || [cost + w3.w] as costs from orders_ join w3 on o = id),
suppliers as (select s as id, cost + w4.w as cost, path || [s] as path, costs || [cost + w4.w] as costs from (select * from parts qualify row_number() over (partition by id order by cost, path) = 1) join w4 on p = id),
ways as (from customers union all from orders_ union all from parts union all from suppliers),
best as (select * from ways qualify row_number() over (partition by id order by cost, path) = 1)"""


@query(_WAYS + " select id, cost, array_to_string(list_transform(path, lambda x: x::bigint), ',') as path from best union all select 0, 0.0, '0'")
def ga4_least_costs(spark, d):
    """Least costs from nation 0 to all that its trade reaches."""
    return P.least_costs(_trade(spark, d), 0, delta=250_000.0).select("id", "cost", F.array_join(c("path").cast("array<string>"), ",").alias("path"))


@query(_WAYS + " select 0::bigint as source, id as target, cost as total_cost, array_to_string(list_transform(path, lambda x: x::bigint), ',') as node_ids, array_to_string(list_transform(costs, lambda x: x::bigint), ',') as costs from best where id = (select max(id) from suppliers)")
def ga4_point_to_point(spark, d):
    """The least costly way from nation 0 to the last supplier that its trade reaches."""
    lines, orders, buyers = table(spark, d, "lineitem"), table(spark, d, "orders"), table(spark, d, "customer").where("c_nationkey = 0")
    bought = lines.join(orders.join(buyers, c("o_custkey") == c("c_custkey"), "left_semi"), c("l_orderkey") == c("o_orderkey"), "left_semi").select("l_partkey")
    last = lines.join(bought, "l_partkey", "left_semi").agg(F.max("l_suppkey")).first()[0]
    rows = P.least_cost_path(_trade(spark, d), 0, _KINDS["supplier"] + (last or 0), delta=250_000.0)
    text = lambda x, kind: F.array_join(c(x).cast(kind).cast("array<string>"), ",").alias(x)
    return rows.select(c("source").cast("long"), "target", "total_cost", text("node_ids", "array<long>"), text("costs", "array<long>"))


def _supplies(spark, d):
    """Edges from a supplier (its negative key) to the parts of its lines of more than 45 pieces."""
    return table(spark, d, "lineitem").where("l_quantity > 45").select((-c("l_suppkey").cast("long")).alias("src"), c("l_partkey").cast("long").alias("dst"))


_REACH = """with recursive l as (select distinct -l_suppkey::bigint as src, l_partkey::bigint as dst from lineitem where l_quantity > 45),
e as (select src, dst from l union select dst, src from l), ends as (select min(src) as a, max(dst) as b from l),
w(id, hops) as (select a, 0 from ends union select dst, hops + 1 from w join e on src = id where hops < 6),
dist as (select id, min(hops) as hops from w group by id),
back as (select d.id, min(e.src) as parent from dist d join e on e.dst = d.id join dist x on x.id = e.src and x.hops = d.hops - 1 group by d.id),
way(id, k) as (select b, 0 from ends where b in (select id from dist) union all select parent, k + 1 from way join back using (id)),
path as (select array_to_string(list(id order by k desc), ',') as path, count(*) - 1 as path_length from way)"""


@query(_REACH + " select hops as depth, count(*) as n, (select count(*) from dist) as total_reachable, (select count(distinct src) from e) as total_nodes, round((select count(*) from dist) * 100.0 / (select count(distinct src) from e), 1) as reachability_pct, (select path_length >= 0 from path) as path_found, coalesce((select path from path), '') as path, (select path_length from path) as path_length from dist group by hops")
def r3_path_and_reach(spark, d):
    """How far suppliers and parts lie from a supplier, over edges in either direction, and the path to the last part."""
    edges = _supplies(spark, d)
    first, last = edges.agg(F.min("src"), F.max("dst")).first()
    return P.reachability(edges, first, last).withColumn("path", F.array_join(c("path").cast("array<string>"), ",")).withColumn("path_length", c("path_length").cast("long"))


@query("select community, count(*) as size, array_to_string(list_sort(list(id))[:10], ',') as members from (select c_custkey as id, n_name as community from customer join nation on n_nationkey = c_nationkey) group by community having count(*) >= 3")
def r2_community_sizes(spark, d):
    """Sizes and first members of the communities that customers' nations are."""
    nations = table(spark, d, "nation").select("n_nationkey", "n_name")
    labels = table(spark, d, "customer").join(nations, c("c_nationkey") == c("n_nationkey")).select(c("c_custkey").alias("id"), c("n_name").alias("community"))
    return A.communities(labels).withColumn("members", F.array_join(c("members").cast("array<string>"), ","))


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("select 'Customer' as label, c_custkey as id from customer where contains(c_name, 'BUILD') or contains(c_mktsegment, 'BUILD') or contains(c_custkey::varchar, 'BUILD') union all select 'Part', p_partkey from part where contains(p_name, 'BUILD') or contains(p_brand, 'BUILD') or contains(p_type, 'BUILD') order by label, id limit 100")
def x1_trigram_search(spark, d):
    """A search of customers and parts by a stored index of their trigrams."""
    index = trigrams.TrigramIndex(spark, _folder(spark, "trigrams"), 16).build(retail_graph(spark, d), ("Customer", "Part"))
    return index.search("BUILD")


_ASKED = "with q as (select embedding from embeddings where vec_id = 0) select vec_id as id, round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 5) as score from embeddings e, q"


@query(f"{_ASKED} where label <> 3 order by list_cosine_similarity(e.embedding::double[], q.embedding::double[]) desc, vec_id limit 25")
def v3_pruned_topk(spark, d):
    """The vectors most like one, of those with another label than 3, from parts by centroid that are read by their bounds."""
    rows = table(spark, d, "embeddings")
    asked = rows.where("vec_id = 0").select("embedding").first()
    index = VectorIndex(spark, _folder(spark, "vectors"), "vec_id", "embedding").build(rows)
    found, _ = index.search(list(asked["embedding"]), 25, c("label") != 3)
    return found.select(c("vec_id").alias("id"), F.round("score", 5).alias("score"))


#: Functions that a user of the retail graph declares.
OWN = Functions()


@OWN.scalar("segment_code", ("string", "long"), "string")
def _segment_code(segment, nation):
    import pyarrow as pa
    import pyarrow.compute as pc

    return pc.binary_join_element_wise(pc.utf8_slice_codeunits(segment, 0, 2), pc.cast(nation, pa.string()), "/")


@OWN.table("name_parts", ("string",), "position int, part string")
def _name_parts(name):
    for k, part in enumerate((name or "").split(" ")):
        yield k, part


@query("select c_custkey as id, left(c_mktsegment, 2) || '/' || c_nationkey as code, upper(c_name) as name from customer")
def ud5_scalar_function(spark, d):
    """A scalar function of the user's beside one of the library's, called by name."""
    rows = table(spark, d, "customer")
    return rows.select(c("c_custkey").alias("id"), OWN.call("segment_code", "c_mktsegment", "c_nationkey").alias("code"), OWN.call("toUpper", "c_name").alias("name"))


@query("select part, count(*) as n from (select unnest(string_split(p_name, ' ')) as part from part) group by part")
def ud5_table_function(spark, d):
    """A table function of the user's, called from SQL."""
    OWN.install(spark)
    table(spark, d, "part").createOrReplaceTempView("parts_of_ud5")
    return spark.sql("select part, count(*) as n from parts_of_ud5, lateral name_parts(p_name) group by part")


def _nation_trade(spark, d):
    """Nations, and which of them sell to which in more lines than is usual: a directed graph with cycles and many ways between two nodes."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "supplier"), c("l_suppkey") == c("s_suppkey")).join(table(spark, d, "orders"), c("l_orderkey") == c("o_orderkey")).join(table(spark, d, "customer"), c("o_custkey") == c("c_custkey"))
    pairs = lines.where("s_nationkey <> c_nationkey").groupBy(c("s_nationkey").cast("long").alias("src"), c("c_nationkey").cast("long").alias("dst")).agg(F.count(F.lit(1)).alias("n"))
    usual = pairs.agg((F.avg("n") * 1.15).alias("usual"))  # one row
    edges = pairs.crossJoin(F.broadcast(usual)).where("n > usual").select("src", "dst")
    graph = PropertyGraph().with_nodes("Nation", table(spark, d, "nation"), "n_nationkey")
    return graph.with_edges("SELLS", edges, "Nation", "Nation", c("src"), c("dst"), c("src") * 100 + c("dst"))


_SELLS = """with recursive tr as (select s_nationkey::bigint as src, c_nationkey::bigint as dst, count(*) as n from lineitem join supplier on s_suppkey = l_suppkey join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey where s_nationkey <> c_nationkey group by 1, 2),
e as (select src, dst from tr where n > (select avg(n) * 1.15 from tr)),
r(s, t, h) as (select n_nationkey::bigint, n_nationkey::bigint, 0 from nation union select s, dst, h + 1 from r join e on t = src where h < 25),
dist as (select s, t, min(h) as h from r group by 1, 2),
p(s, t, h, path) as (select n_nationkey::bigint, n_nationkey::bigint, 0, [n_nationkey::bigint] from nation union all select p.s, e.dst, p.h + 1, p.path || [e.dst] from p join e on e.src = p.t join dist on dist.s = p.s and dist.t = e.dst and dist.h = p.h + 1)"""


def _as_rows(rows):
    return rows.select(c("start").alias("start_id"), c("end").alias("end_id"), "hops", F.array_join(c("path").cast("array<string>"), ",").alias("path"))


@query(_SELLS + " select s as start_id, t as end_id, h as hops, array_to_string(path, ',') as path from p where h > 0 qualify row_number() over (partition by s, t order by path) = 1")
def pf1_shortest_of_trade(spark, d):
    """The least shortest path between any two nations that trade leads from and to."""
    g = _nation_trade(spark, d)
    return _as_rows(g.shortest(("SELLS",), g.nodes("Nation")))


@query(_SELLS + " select s as start_id, t as end_id, h as hops, array_to_string(path, ',') as path from p where h > 0 and t % 5 = 0 and s <> t")
def pf2_all_shortest_of_trade(spark, d):
    """All shortest paths from each nation to every fifth."""
    g = _nation_trade(spark, d)
    return _as_rows(g.shortest(("SELLS",), g.nodes("Nation"), g.nodes("Nation").where("id % 5 = 0"), every=True))


@query(_SELLS + ", w(s, t, h, es) as (select src, dst, 1, [src * 100 + dst] from e where src % 4 = 1 union all select s, dst, h + 1, es || [src * 100 + dst] from w join e on t = src where h < 3 and not list_contains(es, src * 100 + dst)) select s as start_id, t as end_id, h as hops, array_to_string(es, ',') as edges from w where t % 3 = 0")
def pf3_all_paths_of_trade(spark, d):
    """All paths of at most three edges, none of them twice, between some nations."""
    g = _nation_trade(spark, d)
    rows = g.all_paths("SELLS", g.nodes("Nation").where("id % 4 = 1"), g.nodes("Nation").where("id % 3 = 0"), most=3)
    return rows.select(c("start").alias("start_id"), c("end").alias("end_id"), "hops", F.array_join("edges", ",").alias("edges"))


@query(_SELLS + ", n as (select s, t, h, count(*)::double as n from p group by 1, 2, 3) select v.t as id, round(coalesce((select sum(a.n * b.n / c.n) from n a join n b on b.s = a.t join n c on c.s = a.s and c.t = b.t and c.h = a.h + b.h where a.t = v.t and a.h > 0 and b.h > 0), 0), 6) as score from (select distinct t from n where h > 0) v")
def ga3_betweenness_of_trade(spark, d):
    """Betweenness of the nations, by all shortest paths between all others."""
    g = _nation_trade(spark, d)
    return A.betweenness(g.edges("SELLS").select("src", "dst"), g.nodes("Nation").select("id")).select("id", F.round("score", 6).alias("score"))


@query("select 'Nation' as label, 'id,n_name,n_regionkey' as keys, count(*) as n, sum(n_nationkey) as ids from nation union all select 'Region', 'id,r_name', count(*), sum(r_regionkey) from region union all select 'Supplier', 'id,s_acctbal,s_name,s_nationkey', count(*), sum(s_suppkey) from supplier")
def fn_labels_keys(spark, d):
    """labels(n) and keys(n) of nodes, with what lies behind elementId(n)."""
    nodes = retail_graph(spark, d).all_nodes().where(c("label").isin("Nation", "Region", "Supplier"))
    return nodes.groupBy("label", F.array_join(F.array_sort(F.json_object_keys("properties")), ",").alias("keys")).agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query("select 'IN_NATION' as kind, c_custkey::varchar as element_id, c_custkey as src, c_nationkey::bigint as dst from customer union all select 'IN_REGION', n_nationkey::varchar, n_nationkey, n_regionkey from nation")
def fn_type_element_id(spark, d):
    """type(r), elementId(r) and the ends of edges."""
    return retail_graph(spark, d).edges("IN_NATION", "IN_REGION").select("kind", c("eid").alias("element_id"), "src", "dst")


@query("select n_nationkey as id, to_json({'id': n_nationkey, 'n_name': n_name, 'n_regionkey': n_regionkey})::varchar as properties from nation")
def j5_all_properties(spark, d):
    """All properties of nodes as one value."""
    return retail_graph(spark, d).all_nodes().where("label = 'Nation'").select("id", "properties")


def _live_schema_sql() -> str:
    known = {
        ("Nation", "nation"): {"n_nationkey": "bigint", "n_name": "string", "n_regionkey": "int"},
        ("Supplier", "supplier"): {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int", "s_acctbal": "double"},
        ("Part", "part"): {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": "double"},
    }
    parts = []
    for (label, name), columns in known.items():
        for k, (column, kind) in enumerate(columns.items()):
            parts.append(f"select '{label}' as label, '{column if k else 'id'}' as property, '{kind}' as type, count(*) = count({column}) as mandatory, count(*) as nodes from {name}")
    return " union all ".join(parts)


@query(_live_schema_sql())
def s26_live_schema(spark, d):
    """The properties of some labels of the graph, which of them every node has, and how many nodes there are."""
    graph = retail_graph(spark, d)
    counts = graph.label_counts().withColumnRenamed("n", "nodes")
    parts = [graph.properties(label).withColumn("label", F.lit(label)) for label in ("Nation", "Supplier", "Part")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).join(counts, "label").select("label", "property", "type", "mandatory", "nodes")
