"""Trigram search, pruned vectors, user functions and bounded work against plain versions."""

import random
import time

import duckdb
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from plexgraph.functions.registry import Functions
from plexgraph.functions.scalar import cosine
from plexgraph.operators import bounded, trigrams
from plexgraph.operators.graph import PropertyGraph
from plexgraph.operators.vector_index import VectorIndex
from plexgraph.plans.tables import retail_graph

SF = "/root/testdata/sf0.001"


def test_trigram_search_equals_the_scan(spark, tmp_path):
    graph = retail_graph(spark, SF)
    graph = PropertyGraph({k: graph.nodes_by_label[k] for k in ("Nation", "Customer", "Part")})
    index = trigrams.TrigramIndex(spark, str(tmp_path / "i"), 8).build(graph)
    for text in ("BUILDING", "00000001", "Customer#0000000", "not there at all", "1", "AB", "*", "#00", "-1"):
        assert [tuple(r) for r in index.search(text, limit=500).collect()] == [tuple(r) for r in graph.search(text, limit=500).collect()], text
    assert {r.label for r in index.search("000", ("Part",)).collect()} <= {"Part"}
    candidates = index.candidates("BUILDING").count()
    assert candidates == graph.search("BUILDING", limit=10**6).count() < graph.search("*", limit=10**6).count()
    plan = index.postings(["BUI", "DIN"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "In(gram" in plan


def test_pruned_vectors_equal_the_scan_and_read_less(spark, tmp_path):
    dice = random.Random(1)
    centres = [[dice.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    rows = [(k, [x + dice.gauss(0, 0.05) for x in centres[k % 12]], k % 5) for k in range(900)] + [(900 + k, [0.0] * 8, 1) for k in range(3)] + [(950, rows_ := centres[3], 1), (951, rows_, 1)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int")
    index = VectorIndex(spark, str(tmp_path / "v"), "id", "v").build(df)
    for asked, where in ((centres[3], None), (centres[0], F.col("label") == 2), ([1.0] * 8, None), ([0.0] * 8, None), (centres[5], F.col("label") == 99)):
        q = F.array(*[F.lit(float(x)) for x in asked])
        scan = (df if where is None else df.where(where)).select("id", cosine(F.col("v"), q).alias("score")).where("score is not null").orderBy(F.desc("score"), "id").limit(7)
        found, read = index.search(asked, 7, where)
        assert [tuple(r) for r in found.collect()] == [tuple(r) for r in scan.collect()]
        assert read <= 905 and (asked is not centres[3] or read < 300)
    assert VectorIndex(spark, str(tmp_path / "e"), "id", "v").build(df.where("false")).search([1.0], 3)[0].count() == 0


def test_functions_of_a_user(spark):
    functions = Functions()

    @functions.scalar("shout", ("string",), "string")
    def shout(texts):
        return pc.binary_join_element_wise(pc.utf8_upper(texts), "!", "")

    @functions.table("parts_of", ("string", "string"), "position int, part string")
    def parts_of(text, mark):
        for k, part in enumerate((text or "").split(mark)):
            yield k, part

    df = spark.createDataFrame([(1, "a-b"), (2, "c"), (3, None)], "id int, t string")
    assert [r[0] for r in df.orderBy("id").select(functions.call("shout", "t")).collect()] == ["A-B!", "C!", None]
    assert df.select(functions.call("toUpper", "t")).first()[0] == "A-B" and df.select(functions.call("shout", F.col("id"))).first()[0] == "1!"
    assert sorted(map(tuple, functions.rows(df, "parts_of", "t", F.lit("-"), keep=("id",)).collect())) == [(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (3, 0, "")]
    functions.install(spark)
    df.createOrReplaceTempView("texts_of_a_test")
    assert sorted(map(tuple, spark.sql("select id, shout(part) from texts_of_a_test, lateral parts_of(t, '-') where id < 3").collect())) == [(1, "A!"), (1, "B!"), (2, "C!")]
    for bad, message in ((lambda: functions.call("none", "t"), "no function"), (lambda: functions.call("shout", "t", "t"), "takes 1"), (lambda: functions.call("parts_of", "t", "t"), "no function"), (lambda: functions.scalar("abs", (), "int")(abs), "already")):
        with pytest.raises(ValueError, match=message):
            bad()


def test_a_failing_and_a_slow_table_leave_the_others(spark):
    good = spark.read.parquet(f"{SF}/nation.parquet")
    slow = spark.range(0, 1, 1, 1).select(F.udf(lambda x: time.sleep(60) or x, "long")("id").alias("id"))
    bad = spark.range(5).select(F.raise_error(F.lit("broken table")).cast("string").alias("x"))
    began = time.monotonic()
    rows, outcomes = bounded.profiles(spark, {"a": good, "slow": slow, "bad": bad, "z": good.select("n_name")}, timeout=9.0)
    assert time.monotonic() - began < 45
    assert [(r.table, r.status) for r in outcomes.orderBy("position").collect()] == [("a", "done"), ("slow", "late"), ("bad", "failed"), ("z", "done")]
    errors = {r.table: r.error for r in outcomes.collect()}
    assert "broken table" in errors["bad"] and errors["slow"] == "longer than 9 s" and errors["a"] is None
    got = {(r.table, r.column): (r.n, r.n_distinct) for r in rows.collect()}
    assert got == {("a", "n_nationkey"): (25, 25), ("a", "n_name"): (25, duckdb.sql(f"select count(distinct n_name) from '{SF}/nation.parquet'").fetchall()[0][0]), ("a", "n_regionkey"): (25, 5), ("z", "n_name"): (25, got["z", "n_name"][1])}
    assert not spark.sparkContext.getJobTags()
