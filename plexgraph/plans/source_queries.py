"""What can be learned of sources by their data, beside SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from plexgraph.functions import scalar as S
from plexgraph.operators import bounded
from plexgraph.operators import quantiles as Q
from plexgraph.plans.queries import query
from plexgraph.plans.tables import table
from plexgraph.sources import documents, inclusion, readers

c = F.col

KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id"}
WHOLE = {
    "region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"], "customer": ["c_custkey", "c_nationkey"], "supplier": ["s_suppkey", "s_nationkey"],
    "part": ["p_partkey", "p_size"], "orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], "events": ["event_id", "user_id"],
}


def _star(spark, d):
    return {name: table(spark, d, name) for name in WHOLE}


def _inclusions_sql() -> str:
    """One anti-join for each pair of whole-number columns."""
    parts = []
    for t, columns in WHOLE.items():
        for a in columns:
            for u, others in WHOLE.items():
                for b in others:
                    if (t, a) != (u, b):
                        parts.append(f"select '{t}' as \"table\", '{a}' as \"column\", '{u}' as in_table, '{b}' as in_column, (select count(distinct {a}) from {t}) as n_values, (select count(distinct {b}) from {u}) as in_values, (select count(distinct {b}) = count(*) from {u}) as in_is_key where not exists (from {t} where {a} is not null and {a} not in (select {b} from {u} where {b} is not null))")
    return " union all ".join(parts)


@query(_inclusions_sql())
def sa1_inclusions(spark, d):
    """All pairs of whole-number columns of which one's values lie within the other's."""
    return inclusion.inclusions(_star(spark, d), kinds=("number",)).select("table", "column", "in_table", "in_column", "n_values", "in_values", "in_is_key")


def _foreign_keys_sql() -> str:
    parts = []
    for t, columns in WHOLE.items():
        for a in columns:
            for u, b in KEYS.items():
                if t != u and a.split("_")[-1] == b.split("_")[-1] and a.split("_")[-1] != "id":
                    parts.append(f"select '{t}' as \"table\", '{a}' as \"column\", '{u}' as in_table, '{b}' as in_column, (select count(distinct {a}) from {t}) as n_values, round((select count(distinct {a}) from {t} where {a} in (select {b} from {u})) / (select count(*) from {u}), 6) as coverage where not exists (from {t} left join {u} on {a} = {b} where {a} is not null and {b} is null)")
    return " union all ".join(parts)


@query(_foreign_keys_sql())
def sa1_foreign_keys(spark, d):
    """The foreign keys of the tables, found by their values and names."""
    return inclusion.foreign_keys(inclusion.inclusions(_star(spark, d)))


def _order_documents(spark, d):
    """Orders as JSON documents with their buyer and lines: a status only where it is O, a total that is a text in every tenth, a buyer's balance only where it is positive."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(c("l_linenumber").alias("number"), c("l_partkey").alias("part"), c("l_quantity").cast("int").alias("pieces"), F.when(c("l_tax") > 0.05, c("l_tax")).alias("tax")))).alias("lines"))
    buyer = table(spark, d, "customer").select(c("c_custkey").alias("o_custkey"), F.struct(c("c_name").alias("name"), F.when(c("c_acctbal") > 0, c("c_acctbal")).alias("balance"), F.struct(c("c_nationkey").alias("nation")).alias("home")).alias("buyer"))
    rows = table(spark, d, "orders").join(buyer, "o_custkey", "left").join(lines, c("l_orderkey") == c("o_orderkey"), "left")
    as_text = F.to_json(F.struct(c("o_orderkey").alias("_id"), F.when(c("o_orderstatus") == "O", c("o_orderstatus")).alias("status"), F.when(c("o_orderkey") % 10 == 0, "none").alias("note"), c("o_orderkey").alias("total"), "buyer", "lines"))
    mixed = F.when(c("o_orderkey") % 10 == 0, F.regexp_replace(as_text, '"total":(\\d+)', '"total":"$1"')).otherwise(as_text)
    return documents.as_documents(rows.select(mixed.alias("value")))


_ORDERS = """with o as (select o_orderkey as k, o_orderstatus as s, c_custkey as b, c_acctbal as a from orders left join customer on c_custkey = o_custkey),
l as (select lineitem.* from lineitem join orders on o_orderkey = l_orderkey)"""


@query(_ORDERS + """, t as (select 'orders' as "table", '_id' as field, 'int' as type, count(*) as n, count(*) as documents from o
union all select 'orders', 'status', 'string', count(*) filter (where s = 'O'), count(*) from o
union all select 'orders', 'note', 'string', count(*) filter (where k % 10 = 0), count(*) from o
union all select 'orders', 'total', 'string', count(*), count(*) from o
union all select 'orders_buyer', 'name', 'string', count(*), count(*) from o where b is not null
union all select 'orders_buyer', 'balance', 'double', count(*) filter (where a > 0), count(*) from o where b is not null
union all select 'orders_buyer_home', 'nation', 'int', count(*), count(*) from o where b is not null
union all select 'orders_lines', 'number', 'int', count(*), count(*) from l
union all select 'orders_lines', 'part', 'int', count(*), count(*) from l
union all select 'orders_lines', 'pieces', 'int', count(*), count(*) from l
union all select 'orders_lines', 'tax', 'double', count(*) filter (where l_tax > 0.05), count(*) from l)
select "table", field, type, n < documents as nullable, n, documents from t where n > 0""")
def s7_document_types(spark, d):
    """Tables, fields and types of orders as documents."""
    return documents.field_types(_order_documents(spark, d), "orders")


@query("select o_orderkey as orders_id, l_linenumber::bigint as number, l_partkey as part, l_quantity::int::bigint as pieces, case when l_tax > 0.05 then l_tax end as tax from lineitem join orders on o_orderkey = l_orderkey")
def s11_document_tables(spark, d):
    """The lines within orders as documents, as a typed table."""
    docs = _order_documents(spark, d)
    return documents.document_tables(docs, "orders", documents.field_types(docs, "orders").collect())["orders_lines"]


@query("""select 'events' as "table", 'k' as field, count(*) as documents, count(*) - count(props ->> '$.k') as null_count, count(distinct props ->> '$.k') as distinct_count, min(props ->> '$.k') as min, max(props ->> '$.k') as max, case when count(distinct props ->> '$.k') <= 200 then array_to_string(list_sort(list(distinct props ->> '$.k')), ',') else '' end as values from events where json_type(try_cast(props as json)) = 'OBJECT'""")
def pr10_document_profile(spark, d):
    """A profile of the events' properties."""
    rows = documents.profile(documents.as_documents(table(spark, d, "events"), "props"), "events", 200)
    return rows.withColumn("values", F.array_join("values", ","))


@query("""with t as (select 'o_custkey' as "column", count(*) as n, count(*) - count(o_custkey) as n_null, min(o_custkey)::double as low, max(o_custkey)::double as high, count(distinct o_custkey) as exact from orders
union all select 'o_totalprice', count(*), count(*) - count(o_totalprice), min(o_totalprice), max(o_totalprice), count(distinct o_totalprice) from orders
union all select 'o_orderpriority', count(*), count(*) - count(o_orderpriority), null, null, count(distinct o_orderpriority) from orders)
select *, true as distinct_within, case when low is not null then true end as quantiles_within from t""")
def pr8_sketches(spark, d):
    """Sketches of the orders' columns, made by status and merged: their counts, and whether their estimates keep the stated errors."""
    orders = table(spark, d, "orders").select("o_orderstatus", "o_custkey", "o_totalprice", "o_orderpriority")
    found = Q.estimates(Q.merged(Q.sketches(orders, ["o_orderstatus"])), (0.1, 0.5, 0.9))
    parts = []
    for name in ("o_custkey", "o_totalprice", "o_orderpriority"):
        one = found.where(c("column") == name)  # one row
        joined = orders.select(c(name).alias("value")).crossJoin(F.broadcast(one))
        number = name != "o_orderpriority"
        exact = F.count_distinct("value").alias("exact")
        # the share of values up to an estimated quantile, and below it, hold the rank asked for between them
        ranks = [(F.avg((c("value") < F.element_at("quantiles", k)).cast("double")) - Q.RANK_ERROR <= r) & (F.avg((c("value") <= F.element_at("quantiles", k)).cast("double")) + Q.RANK_ERROR >= r) for k, r in ((1, 0.1), (2, 0.5), (3, 0.9))] if number else []
        all_ranks = ranks[0] & ranks[1] & ranks[2] if ranks else F.lit(None).cast("boolean")
        end = (lambda x: F.first(c(x).try_cast("double"))) if number else (lambda x: F.lit(None).cast("double"))
        checked = joined.agg(F.first("n").alias("n"), F.first("n_null").alias("n_null"), end("low").alias("low"), end("high").alias("high"), exact, F.first("n_distinct").alias("n_distinct"), all_ranks.alias("quantiles_within"))
        parts.append(checked.select(F.lit(name).alias("column"), "n", "n_null", "low", "high", "exact", Q.within(c("n_distinct"), c("exact"), 3 * Q.DISTINCT_ERROR).alias("distinct_within"), "quantiles_within"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("select 'nation' as \"table\", 'n_name' as \"column\", count(*) as n, count(*) - count(n_name) as n_null, count(distinct n_name) as n_distinct, 'done' as status from nation union all select 'customer', 'c_mktsegment', count(*), count(*) - count(c_mktsegment), count(distinct c_mktsegment), 'done' from customer union all select 'broken', null, null, null, null, 'failed'")
def pr4_bounded_profiles(spark, d):
    """Profiles of three tables within a time for each, one of which fails and leaves the others whole."""
    broken = table(spark, d, "orders").select(F.when(c("o_orderkey") >= 0, F.raise_error(F.lit("a value that can't be read"))).cast("string").alias("x"))
    tables = {"nation": table(spark, d, "nation").select("n_name"), "broken": broken, "customer": table(spark, d, "customer").select("c_mktsegment")}
    rows, outcomes = bounded.profiles(spark, tables, timeout=300.0)
    return outcomes.join(rows, "table", "left").select("table", "column", "n", "n_null", "n_distinct", "status")


@query("with t as (select o_orderkey as id, o_orderdate::timestamp as t0, o_orderkey % 4 as y, o_orderkey % 14 as m, o_orderkey % 3 as w, o_orderkey % 40 as dd, o_orderkey % 30 as h, o_orderkey % 90 as s from orders) select id, t0 + to_months((12 * y + m)::int) + to_days((7 * w + dd)::int) + to_hours(h) + to_seconds(s) as later, t0 - to_months((12 * y + m)::int) - to_days((7 * w + dd)::int) - to_hours(h) - to_seconds(s) as earlier, case when id % 2 = 0 then ((7 * w + dd) * 86400 + h * 3600 + s)::double end as seconds from t")
def fn_durations(spark, d):
    """Order dates later and earlier by durations of the orders' own keys, and durations without years and months in seconds."""
    key = c("o_orderkey")
    piece = lambda n, letter: F.concat((key % n).cast("string"), F.lit(letter))
    rest = F.concat(piece(3, "W"), piece(40, "D"), F.lit("T"), piece(30, "H"), F.lit("0M"), piece(90, "S"))
    whole, short = F.concat(F.lit("P"), piece(4, "Y"), piece(14, "M"), rest), F.when(key % 2 == 0, F.concat(F.lit("P"), rest)).otherwise(F.concat(F.lit("P1Y"), rest))
    at = c("o_orderdate")
    return table(spark, d, "orders").select(key.alias("id"), S.plus_duration(at, whole).alias("later"), S.plus_duration(at, whole, -1).alias("earlier"), S.duration(short).alias("seconds"))


@query("""with t as (select event_id::varchar as id, event_type as kind, value::varchar as value, props as props, case when event_id % 7 = 0 then 'x' else props end as mixed, case when event_id < 0 then props end as none from events),
m as (select 'id' as "column", id as v from t union all select 'kind', kind from t union all select 'value', value from t union all select 'props', props from t union all select 'mixed', mixed from t union all select 'none', none from t)
select "column", case when count(v) = 0 then 'string' when count(*) filter (where v is not null and lower(v) not in ('true', 'false')) = 0 then 'bool'
  when count(*) filter (where v is not null and (try_cast(v as bigint) is null or contains(v, '.'))) = 0 then 'int' when count(*) filter (where v is not null and try_cast(v as double) is null) = 0 then 'float'
  when count(*) filter (where v is not null and json_type(try_cast(v as json)) not in ('OBJECT', 'ARRAY') or v is not null and try_cast(v as json) is null) = 0 then 'json' else 'string' end as type from m group by 1""")
def s12_types_with_json(spark, d):
    """The types of the events' columns as text, of JSON, of a mix of JSON and words, and of a column without values."""
    rows = table(spark, d, "events").select(c("event_id").cast("string").alias("id"), c("event_type").alias("kind"), c("value").cast("string").alias("value"), "props", F.when(c("event_id") % 7 == 0, "x").otherwise(c("props")).alias("mixed"), F.when(c("event_id") < 0, c("props")).alias("none"))
    return readers.inferred_types(rows)
