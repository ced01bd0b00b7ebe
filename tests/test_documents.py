"""Merged types, child tables and profiles of documents against a plain version over parsed JSON."""

import json

from pyspark.sql import functions as F

from plexgraph.sources import documents as D

DOCS = [
    {"_id": 1, "a": 1, "tags": ["x", "y"], "home": {"city": "A", "geo": {"lat": 1.5}}, "items": [{"n": 1}, {"n": 2.5, "q": True}, 7]},
    {"_id": 2, "a": 2.25, "home": {"city": None}, "items": [], "odd": 3},
    {"_id": 3, "a": None, "home": "none", "odd": "three", "only": None},
    {"_id": 4, "home": {"city": "B", "geo": {"lat": 2}}, "items": [{"n": 4, "deep": [{"z": "q"}]}], "odd": True, "it's": 1},
]
TEXTS = [json.dumps(x) for x in DOCS] + ["[1, 2]", "not json", "7", None, ""]


def kind(v):
    return {bool: "bool", int: "int", float: "double", str: "string", list: "array", type(None): "null"}[type(v)]


def plain_types(docs, table, out=None):
    out = {} if out is None else out
    seen, nested = {}, {}
    for doc in docs:
        for key, v in doc.items():
            if isinstance(v, dict):
                nested.setdefault(key, []).append(v)
            elif isinstance(v, list) and any(isinstance(x, dict) for x in v):
                nested.setdefault(key, []).extend(x for x in v if isinstance(x, dict))
            else:
                seen.setdefault(key, []).append(kind(v))
    for key, kinds in seen.items():
        known = [k for k in kinds if k != "null"]
        merged = set(known)
        out[table, key] = ("string" if not merged else merged.pop() if len(merged) == 1 else "double" if merged == {"int", "double"} else "string", len(known) < len(docs), len(known), len(docs))
    for key, children in nested.items():
        plain_types(children, f"{table}_{key}", out)
    return out


def documents(spark):
    return D.as_documents(spark.createDataFrame([(t,) for t in TEXTS], "value string"))


def test_types_equal_the_plain_version(spark):
    rows = D.field_types(documents(spark), "t").collect()
    assert {(r.table, r.field): (r.type, r.nullable, r.n, r.documents) for r in rows} == plain_types(DOCS, "t")
    assert D.field_types(documents(spark).where("false"), "t").count() == 0


def test_tables_of_nested_parts(spark):
    docs = documents(spark)
    out = D.document_tables(docs, "t", D.field_types(docs, "t").collect())
    assert set(out) == {"t", "t_home", "t_home_geo", "t_items", "t_items_deep"}
    got = {name: sorted(map(tuple, df.collect()), key=str) for name, df in out.items()}
    assert out["t_items"].columns == ["t_id", "n", "q"] and got["t_items"] == [(1, 1.0, None), (1, 2.5, True), (4, 4.0, None)]
    assert got["t_home"] == [(1, "A"), (2, None), (4, "B")] and got["t_home_geo"] == [(1, 1.5), (4, 2.0)] and got["t_items_deep"] == [(4, "q")]
    top = {r["_id"]: r for r in out["t"].collect()}
    assert top[3]["home"] == "none" and top[2]["odd"] == "3" and top[4]["odd"] == "true" and top[1]["a"] == 1.0 and top[1]["tags"] == '["x","y"]' and top[4]["it's"] == 1


def test_profile(spark):
    rows = {r.field: r for r in D.profile(documents(spark), "t", 3).collect()}
    a = rows["a"]
    assert (a.documents, a.null_count, a.distinct_count, a.min, a.max, a["values"]) == (4, 2, 2, "1", "2.25", ["1", "2.25"])
    assert rows["_id"]["values"] == [] and rows["odd"].distinct_count == 3 and rows["it's"].null_count == 3


def test_samples_are_seeded_and_of_about_n_rows(spark):
    rows = spark.range(20000).select(F.concat(F.lit('{"k": '), "id", F.lit("}")).alias("value"))
    one = {r.value for r in D.sampled(rows, 1000, 3).collect()}
    assert 850 < len(one) < 1150 and one == {r.value for r in D.sampled(rows.repartition(7), 1000, 3).collect()}
    assert one != {r.value for r in D.sampled(rows, 1000, 4).collect()} and D.sampled(rows, 20000).count() == 20000
    assert "Exchange" not in D.sampled(rows, 10, total=20000)._jdf.queryExecution().executedPlan().toString()
