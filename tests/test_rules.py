"""Rules over names, schemas and typed-in profiles, which read no table, beside what they must give."""

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from plexgraph.functions import scalar as S
from plexgraph.operators import analytics as A
from plexgraph.operators import governance as G
from plexgraph.operators import knowledge as K
from plexgraph.operators import loading as L
from plexgraph.operators import schemas as M
from plexgraph.operators.graph import hop_range
from plexgraph.plans.tables import table

RULES, WANTED = {}, {}
c = F.col


def rule(sql):
    def keep(f):
        RULES[f.__name__], WANTED[f.__name__] = f, sql
        return f

    return keep


_WAS = {"nodes": {"A": {"p": "int", "q": "string"}, "B": {}}, "edges": {"L": ("A", "B")}}
_NOW = {"nodes": {"A": {"p": "bigint", "r": "string"}, "C": {}}, "edges": {"L": ("A", "C")}}


_STEPS = ({"p_size": "int", "p_brand": "string", "p_type": "string", "p_name": "string"}, {"p_size": "string", "p_brand": "double", "p_name": "date", "stock": "bigint"})


@rule("select s as text, seconds::double as seconds from (values ('P1DT2H', 93600.0), ('PT1.5S', 1.5), ('PT3M', 180.0), ('P', null), ('x', null)) as t(s, seconds)")
def fn_duration(spark, d):
    rows = spark.createDataFrame([(x,) for x in ("P1DT2H", "PT1.5S", "PT3M", "P", "x")], "text string")
    return rows.select("text", S.duration(c("text")).alias("seconds"))


@rule("select a, b, low, high from (values (null, 12, null, null), (5, 2, 2, 5), (1, 1, null, null), (0, 3, 0, 3), (3, null, 3, null), (null, 0, 1, 0), (0, null, null, null)) as t(a, b, low, high)")
def p08_hop_ranges(spark, d):
    asked = [(None, 12), (5, 2), (1, 1), (0, 3), (3, None), (None, 0), (0, None)]
    return spark.createDataFrame([(a, b, *(hop_range(a, b) or (None, None))) for a, b in asked], "a int, b int, low int, high int")


@rule("select 'a' as community, 3 as size, '1,2,3' as members union all select 'b', 4, '4,5'")
def r2_community_sizes(spark, d):
    labels = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b"), (5, "b"), (6, "b"), (7, "b"), (8, "z")], "id long, community string")
    rows = A.communities(labels)
    return rows.select("community", c("size").cast("int").alias("size"), F.array_join(F.when(c("size") > 3, F.slice("members", 1, 2)).otherwise(c("members")), ",").alias("members"))


@rule("select row_number() over () as position, s as step from (values ('nations'), ('customers'), ('orders')) as t(s)")
def l06_step_order(spark, d):
    order = L.step_order({"orders": ["customers"], "customers": ["nations"], "nations": []})
    return spark.createDataFrame([(k + 1, s) for k, s in enumerate(order)], "position long, step string")


@rule("select * from (values (1, 'code'), (2, 'Email'), (3, 'note'), (4, 'amount')) as t(position, \"column\")")
def d3_index_candidates(spark, d):
    columns = [("amount", "double", False), ("note", "string", False), ("code", "int", False), ("hidden", "string", True), ("Email", "string", False), ("id", "bigint", False)]
    return spark.createDataFrame([(k + 1, x) for k, x in enumerate(M.index_candidates(columns, covered=("id",)))], "position int, column string")


@rule("select * from (values ('L has an unknown end X'), ('N has no property q'), ('bad name ''a b''')) as t(fault)")
def d5_invalid_schema(spark, d):
    faults = M.invalid({"nodes": {"N": {"a b": "int"}}, "edges": {"L": ("N", "X")}, "unique": {"N": ["q"]}})
    return spark.createDataFrame([(f,) for f in faults], "fault string")


@rule("select * from (values ('orders', 'customer_id', 'customers'), ('products', 'category_id', 'categories')) as t(\"table\", \"column\", refers_to)")
def sa1_implied_keys(spark, d):
    names = {"orders": ["id", "customer_id"], "customers": ["id"], "categories": ["id"], "products": ["category_id"]}
    return spark.createDataFrame(G.implied_keys(names), "table string, column string, refers_to string")


@rule("select * from (values ('a', '[MASKED],[MASKED]'), ('b', ''), ('e', 'x')) as t(\"column\", \"values\")")
def sa5_decisions(spark, d):
    samples = spark.createDataFrame([("a", ["1", "2"]), ("b", ["3"]), ("e", ["x"])], "column string, values array<string>")
    return G.decided(samples, [("a", "allow"), ("b", "exclude"), ("a", "mask")]).withColumn("values", F.array_join("values", ","))


@rule("select * from (values ('user_email', 'email', 'confidential'), ('zip', 'address', 'confidential'), ('dob', 'birth_date', 'restricted'), ('mail', 'other', 'internal'), ('name_email', 'email', 'confidential')) as t(\"column\", kind, class)")
def sa6_classification(spark, d):
    return spark.createDataFrame([(x, k, G.classification(k)) for x, k in G.pii_kinds(["user_email", "zip", "dob", "mail", "total", "name_email"])], "column string, kind string, class string")


@rule("select * from (values (0, 'nation'), (0, 'region'), (0, 'customer'), (1, 'part')) as t(cluster, \"table\")")
def sa9_clusters(spark, d):
    groups = M.clusters(["customer", "nation", "region", "part"], [("customer", "nation"), ("nation", "region")])
    return spark.createDataFrame([(k, t) for k, g in enumerate(groups) for t in g], "cluster int, table string")


@rule("select * from (values ('small_sample', 'A', null), ('sparse_property', 'B', 'p'), ('single_value_bias', 'B', 'q'), ('numeric_enum_code', 'B', 'r'), ('opaque_enum', 'B', 's')) as t(\"check\", label, property)")
def oq_data_checks(spark, d):
    schema = "label string, property string, n long, n_null long, n_distinct long, numeric boolean, short boolean, first boolean"
    rows = [("A", "p", 3, 0, 3, False, False, True), ("B", "p", 100, 90, 9, False, False, True), ("B", "q", 100, 0, 1, False, False, False), ("B", "r", 100, 0, 5, True, False, False), ("B", "s", 100, 0, 4, False, True, False)]
    return M.quality_of_data(spark.createDataFrame(rows, schema))


@rule("select * from (values ('missing_description', 'B'), ('orphan_node', 'B'), ('self_referential_edge', 'L'), ('self_referential_edge', 'M'), ('duplicate_edge', 'M'), ('property_type_inconsistency', 'p'), ('unmapped_source_table', 'x'), ('unmapped_source_column', 'a.q'), ('missing_foreign_key_edge', 'a -> b')) as t(\"check\", what)")
def oq_schema_checks(spark, d):
    schema = {"nodes": {"A": {"p": "int"}, "B": {"p": "string"}}, "edges": {"L": ("A", "A"), "M": ("A", "A")}, "descriptions": {"A": "a", "L": "l", "M": "m"}}
    found = M.quality_of_schema(schema, {"a": ["id", "p", "q"], "x": ["y"]}, (("a", "b"),))
    return spark.createDataFrame(found, "check string, what string")


@rule("select * from (values (1, 'Order'), (2, 'Customer'), (3, 'Part'), (4, 'Nation'), (5, 'Supplier')) as t(position, label)")
def v6_schema_retrieval(spark, d):
    hits = spark.createDataFrame([("Order", 0.9), ("Region", 0.1)], "label string, score double")
    links = spark.createDataFrame([("Customer", "Order"), ("Order", "Part"), ("Part", "Supplier"), ("Customer", "Nation"), ("Nation", "Region")], "a string, b string")
    return spark.createDataFrame([(k + 1, x) for k, x in enumerate(K.retrieved_labels(hits, links, most=5))], "position int, label string")


@rule("select * from (values (1, 'u1', 9), (2, 'analyst', 5)) as t(position, subject, priority)")
def se8_policies(spark, d):
    rows = [("role", "analyst", True, 5), ("user", "u1", True, 9), ("user", "u2", True, 9), ("role", "analyst", False, 8)]
    found = G.effective_policies(spark.createDataFrame(rows, "subject_kind string, subject string, active boolean, priority int"), "analyst", "editor", "u1")
    return found.select(F.row_number().over(Window.orderBy(F.desc("priority"))).alias("position"), "subject", "priority")


@rule("select * from (values ('node_added', 'C'), ('node_removed', 'B'), ('edge_modified', 'L'), ('property_added', 'A.r'), ('property_removed', 'A.q'), ('property_modified', 'A.p')) as t(change, what)")
def df1_schema_difference(spark, d):
    return spark.createDataFrame(M.difference(_WAS, _NOW), "change string, what string")


@rule("select * from (values ('A'), ('B'), ('L')) as t(label)")
def df2_breaking_labels(spark, d):
    return spark.createDataFrame([(x,) for x in M.breaking_labels(M.difference(_WAS, _NOW))], "label string")


@rule("select * from (values ('add', 'stock'), ('cast', 'p_size'), ('cast', 'p_brand'), ('drop', 'p_type'), ('warning', 'p_name: string can''t become date')) as t(step, what)")
def df3_migration_plan(spark, d):
    steps, warnings = M.migration_plan(*_STEPS)
    return spark.createDataFrame([s[:2] for s in steps] + [("warning", w) for w in warnings], "step string, what string")


@rule("select * from (values ('a', 'double'), ('b', 'string'), ('e', 'json'), ('f', 'int')) as t(field, type)")
def s7_merged_types(spark, d):
    found = M.merged_fields([{"a": "int", "b": "int", "e": "json", "f": None}, {"a": "double", "b": "string", "e": "int", "f": "int"}])
    return spark.createDataFrame(sorted(found.items()), "field string, type string")


@rule("select * from (values ('orders', 'customerId', 'customers'), ('items', 'order_id', 'orders')) as t(\"table\", \"column\", refers_to)")
def s8_reference_columns(spark, d):
    return spark.createDataFrame(M.reference_columns({"orders": ["customerId"], "customers": ["id"], "items": ["order_id", "grid"]}), "table string, column string, refers_to string")


@rule("select 3 as lines, 'CREATE TABLE B (id BIGINT NOT NULL);' as second, true as diagram")
def k5_exports(spark, d):
    schema = {"nodes": {"A": {"p": "int"}, "B": {}}, "edges": {"L": ("A", "B")}}
    ddl = M.table_ddl(schema).split("\n")
    return spark.createDataFrame([(len(ddl), ddl[1], "A }o--o{ B : L" in M.mermaid(schema))], "lines int, second string, diagram boolean")


@rule("select 2 as tables, 5 as columns, (select count(*) from region) + (select count(*) from nation) as rows, 'normal' as size, 'n_name,r_name' as personal")
def sa11_report(spark, d):
    found = M.report({n: table(spark, d, n) for n in ("region", "nation")})
    personal = ",".join(sorted(x for _, x, _ in found["personal"]))
    return spark.createDataFrame([(found["tables"], found["columns"], found["rows"], found["size"], personal)], "tables int, columns int, rows long, size string, personal string")


@pytest.mark.parametrize("name", sorted(RULES))
def test_rule(spark, name):
    d = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for t in ("region", "nation"):
        duck.sql(f"create view {t} as from '{d}/{t}.parquet'")
    df, want = RULES[name](spark, d), duck.sql(WANTED[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    text = lambda rows: sorted(tuple(str(x) for x in r) for r in rows)
    assert text([r[x] for x in columns] for r in df.collect()) == text(duck.sql(f"select {', '.join(chr(34) + x + chr(34) for x in columns)} from ({WANTED[name]})").fetchall())
