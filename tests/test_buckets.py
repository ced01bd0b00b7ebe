"""The bucketed table against a dictionary, its files, and what a repeated batch does."""

import os

import pytest
from pyspark.sql import functions as F

from plexgraph.streaming import buckets as B
from plexgraph.streaming.incremental import read_stream

SCHEMA = "k long, v string, t long"


@pytest.fixture
def store(spark, tmp_path):
    return B.BucketTable(spark, str(tmp_path / "t"), spark.createDataFrame([], SCHEMA).schema, ["k"], 8)


def held(table, version=None):
    return sorted(map(tuple, table.read(version).collect()), key=str)


def files(table):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{table.folder}/data") for f in names if f.endswith(".parquet")}


def test_batches_rewrite_only_what_they_touch(spark, store):
    assert held(store) == [] and store.version() is None
    rows = [(k, f"a{k}", 1) for k in range(200)]
    assert store.upsert(spark.createDataFrame(rows, SCHEMA)) == list(range(8))
    before = files(store)
    touched = store.upsert(spark.createDataFrame([(5, "new", 2), (1000, "added", 2)], SCHEMA))
    assert 1 <= len(touched) <= 2 and {p: t for p, t in files(store).items() if p in before} == before
    assert held(store) == sorted([*[r for r in rows if r[0] != 5], (5, "new", 2), (1000, "added", 2)], key=str)
    assert held(store, 0) == sorted(rows, key=str)
    writes = [store.manifest(v)["writes"] for v in (0, 1)]
    assert {int(k) for k in writes[0] if writes[0][k] != writes[1][k]} == set(touched)
    again = B.BucketTable(spark, store.folder, store.schema, ["k"], 99)
    assert again.buckets == 8 and held(again) == held(store)


def test_conflicts_orders_and_null_keys(spark, store):
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    store.upsert(frame([(1, "a", 5), (2, None, 5), (None, "n", 1)]))
    store.upsert(frame([(1, "old", 3), (2, "new", 7), (2, "newer", 8)]), order="t")
    assert held(store) == sorted([(1, "a", 5), (2, "newer", 8), (None, "n", 1)], key=str)
    store.upsert(frame([(1, None, 9), (3, "c", 1), (None, "m", 1)]), conflict="merge_non_null")
    assert held(store) == sorted([(1, "a", 9), (2, "newer", 8), (3, "c", 1), (None, "n", 1), (None, "m", 1)], key=str)
    with pytest.raises(Exception, match="exists already"):
        store.upsert(frame([(3, "d", 1)]), conflict="error")
    assert store.version() == 2 and (3, "c", 1) in held(store)
    assert store.upsert(frame([])) == []


def test_a_repeated_batch_changes_nothing_and_writers_clash_openly(spark, store):
    batch = spark.createDataFrame([(1, "a", 1)], SCHEMA)
    assert store.upsert(batch, stream="s", number=0) and store.upsert(batch, stream="s", number=0) == []
    version = store.version()
    assert store.upsert(batch, stream="other", number=0) and store.version() == version + 1
    with pytest.raises(B.Conflict):
        store._commit(store.version(), store.manifest())
    assert store.vacuum(1) >= 1 and held(store) == [(1, "a", 1)]


def test_a_stream_of_files_is_brought_in_once(spark, store, tmp_path):
    source = str(tmp_path / "in")
    batches = [[(k, f"b{n}", n) for k in range(n, 40, n + 1)] for n in range(4)]
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: read_stream(spark, source, store.schema, 1)
    store.consume(stream(), str(tmp_path / "mark"), order="t").awaitTermination()
    want = {}
    for rows in batches:
        for r in rows:
            want[r[0]] = max(want.get(r[0], r), r, key=lambda x: x[2])
    assert held(store) == sorted(want.values(), key=str) and store.manifest()["batches"] == {"stream": 3}
    version = store.version()
    store.consume(stream(), str(tmp_path / "mark"), order="t").awaitTermination()
    store.consume(stream(), str(tmp_path / "lost mark"), order="t").awaitTermination()  # a lost checkpoint repeats batches
    assert store.version() == version
    spark.createDataFrame([(7, "late", 99)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    before = files(store)
    store.consume(stream(), str(tmp_path / "mark"), order="t").awaitTermination()
    assert len(set(files(store)) - set(before)) == 1 and (7, "late", 99) in held(store)
