"""Pattern operators, algorithms and loads on micro-graphs."""

import pytest
from pyspark.sql import functions as F

from plexgraph.functions import scalar
from plexgraph.operators import analytics, governance, loading, paths
from plexgraph.operators.graph import PropertyGraph
from plexgraph.sources import readers


def graph_of(spark, pairs, nodes=None):
    ids = nodes or sorted({x for p in pairs for x in p})
    rows = spark.createDataFrame([(i, f"n{i}") for i in ids], "k long, name string")
    edges = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "e long, a long, b long")
    return PropertyGraph().with_nodes("N", rows, "k").with_edges("E", edges, "N", "N", F.col("a"), F.col("b"), F.col("e"))


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_trails_do_not_repeat_an_edge(spark):
    g = graph_of(spark, [(1, 2), (2, 3), (3, 1)])
    found = rows_of(g.trails("E", spark.createDataFrame([(1,)], "id long"), 1, 5), "end", "hops")
    assert found == [(1, 3), (2, 1), (3, 2)]


def test_shortest_and_all_shortest_on_a_diamond(spark):
    g = graph_of(spark, [(1, 2), (1, 3), (2, 4), (3, 4)])
    start = spark.createDataFrame([(1,)], "id long")
    one = {r.end: (r.hops, r.path) for r in g.shortest(("E",), start).collect()}
    assert one[4] == (2, [1, 2, 4])
    every = [r.path for r in g.shortest(("E",), start, every=True).where("end = 4").collect()]
    assert sorted(every) == [[1, 2, 4], [1, 3, 4]]


def test_undirected_self_loop_counts_once_and_parallel_edges_twice(spark):
    g = graph_of(spark, [(1, 2), (1, 2), (3, 3)])
    steps = g.expand(g.scan("a", "N"), "a", "E", "b", "N", "both").select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    assert rows_of(steps, "a", "b") == [(1, 2), (1, 2), (2, 1), (2, 1), (3, 3)]


def test_optional_filter_is_part_of_the_join(spark):
    g = graph_of(spark, [(1, 2)], [1, 2, 3])
    out = g.expand(g.scan("a", "N"), "a", "E", "b", where=F.col("b.name") == "none", optional=True)
    assert rows_of(out.select(F.col("a.id").alias("a"), F.col("b.id").isNull().alias("none")), "a", "none") == [(1, True), (2, True), (3, True)]


def test_unknown_names_are_errors(spark):
    g = graph_of(spark, [(1, 2)])
    with pytest.raises(ValueError):
        g.nodes("X")
    with pytest.raises(ValueError):
        g.edges("X")


def test_least_costs_prefers_the_cheaper_way(spark):
    edges = spark.createDataFrame([(1, 2, 5.0), (1, 3, 1.0), (3, 2, 1.0)], "src long, dst long, weight double")
    assert {r.id: (r.cost, r.path) for r in paths.least_costs(edges, 1).collect()} == {1: (0.0, [1]), 2: (2.0, [1, 3, 2]), 3: (1.0, [1, 3])}


def test_betweenness_of_a_chain(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src long, dst long")
    scores = {r.id: r.score for r in analytics.betweenness(edges, spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "id long")).collect()}
    assert scores[2] == 2.0 and scores[3] == 2.0 and scores.get(4) == 0.0


def test_label_propagation_splits_two_triangles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (7, 8), (8, 9), (7, 9)], "src long, dst long")
    labels = {r.id: r.community for r in analytics.label_propagation(edges).collect()}
    assert len({labels[i] for i in (1, 2, 3)}) == 1 and labels[1] != labels[7]


def test_pagerank_leaves_out_a_sink(spark):
    ranks = {r.id: r.score for r in analytics.pagerank(spark.createDataFrame([(1, 2)], "src long, dst long"), rounds=2).collect()}
    assert ranks[1] == pytest.approx(0.075) and ranks[2] == pytest.approx(0.075 + 0.85 * 0.075)


def test_upsert_error_fails_on_a_known_key(spark):
    old, new = spark.createDataFrame([(1, "a")], "id int, v string"), spark.createDataFrame([(1, "b")], "id int, v string")
    with pytest.raises(Exception, match="exists already"):
        loading.upsert(old, new, ["id"], "error").collect()
    assert loading.upsert_counts(old, new, ["id"]).first() == (0, 1)


def test_delete_needs_detach(spark):
    g = graph_of(spark, [(1, 2)])
    rows = g.edges_by_type["E"].rows
    with pytest.raises(ValueError):
        loading.delete(g.nodes("N"), rows, F.col("id") == 1)
    nodes, edges = loading.delete(g.nodes("N"), rows, F.col("id") == 1, detach=True)
    assert nodes.count() == 1 and edges.count() == 0


def test_empty_aggregates_and_regex(spark):
    row = spark.createDataFrame([(5.0,)], "v double").agg(scalar.spread(F.col("v")).alias("s"), scalar.total(F.col("v")).alias("t")).first()
    assert row == (0.0, 5.0)
    assert spark.range(1).select(scalar.whole_match(F.lit("abc"), "b")).first()[0] is False


def test_nested_json_becomes_child_tables(spark):
    rows = spark.read.json(spark.sparkContext.parallelize(['{"id": 1, "meta": {"tier": "x"}, "items": [{"sku": "a"}, {"sku": "b"}]}']))
    tables = readers.nested_tables(rows, "records")
    assert set(tables) == {"records", "records_meta", "records_items"}
    assert rows_of(tables["records_items"], "records_id", "sku") == [(1, "a"), (1, "b")]


def test_implied_keys_and_pii_names():
    assert governance.implied_keys({"orders": ["id", "customer_id"], "customers": ["id"], "categories": ["id"], "products": ["category_id"]}) == [("orders", "customer_id", "customers"), ("products", "category_id", "categories")]
    assert governance.pii_columns(["user_email", "total"]) == ["user_email"]
    assert governance.drift({"a": "int", "b": "string"}, {"a": "double", "c": "int"}) == [("c", "added"), ("b", "removed"), ("a", "widened")]


def test_least_costs_goes_to_the_end_and_refuses_negative_weights(spark):
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(24)], "src long, dst long, weight double")
    assert paths.least_costs(chain, 0).count() == 25
    with pytest.raises(ValueError):
        paths.least_costs(chain.selectExpr("src", "dst", "-weight as weight"), 0)


def test_similarity_in_both_directions(spark):
    edges = spark.createDataFrame([(1, 3), (3, 2)], "src long, dst long")
    assert analytics.similarity(edges).count() == 0
    assert rows_of(analytics.similarity(edges, undirected=True), "a", "b", "jaccard") == [(1, 2, 1.0)]


def test_betweenness_and_paths_of_no_edges(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert analytics.betweenness(none, spark.createDataFrame([(1,)], "id long")).count() == 0
    g = graph_of(spark, [(1, 2)])
    assert g.shortest(("E",), spark.createDataFrame([(2,)], "id long")).count() == 0


def test_whole_match_and_duplicate_keys(spark):
    row = spark.range(1).select(scalar.whole_match(F.lit("abc\n"), "abc"), scalar.whole_match(F.lit("a\nc"), "a.c")).first()
    assert tuple(row) == (False, True)
    old = spark.createDataFrame([(1, "a"), (2, "x")], "id int, v string")
    new = spark.createDataFrame([(1, "c"), (1, "b"), (3, "x"), (3, "y"), (None, "n")], "id int, v string")
    assert sorted(map(tuple, loading.upsert(old, new, ["id"]).where("id is not null").collect())) == [(1, "c"), (2, "x"), (3, "y")]
    assert loading.upsert(old, new, ["id"], "skip").where("id = 3").count() == 1 and loading.upsert(old, new, ["id"]).where("id is null").count() == 1
