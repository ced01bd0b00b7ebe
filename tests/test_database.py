"""The database source against files of SQLite and DuckDB that are filled from the tables."""

import sqlite3

import duckdb
import pytest
from pyspark.sql import functions as F

from plexgraph.sources import database as D

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def shop(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db") / "shop.db")
    db = sqlite3.connect(path)
    db.executescript("""create table nation (n_nationkey integer primary key, n_name text not null, n_regionkey int);
        create table customer (c_custkey integer primary key, c_name text, c_nationkey int references nation, c_acctbal double);
        create table orders (o_orderkey integer primary key, o_custkey int references customer (c_custkey), o_totalprice double, o_orderdate timestamp);
        create table odd (id int, n smallint, flag boolean, day date, price decimal(10, 2), note text)""")
    for table, columns in (("nation", "*"), ("customer", "c_custkey, c_name, c_nationkey, c_acctbal"), ("orders", "o_orderkey, o_custkey, o_totalprice, o_orderdate::varchar")):
        rows = duckdb.sql(f"select {columns} from '{SF}/{table}.parquet'").fetchall()
        db.executemany(f"insert into {table} values ({', '.join('?' * len(rows[0]))})", rows)
    db.executemany("insert into odd values (?, ?, ?, ?, ?, ?)", [(1, 7, 1, "2024-02-29", "1.50", "a"), (2, 70000, "maybe", "soon", "x", None), (None, 3.5, 0, None, 2, b"\xff"), (9, None, "true", "2024-01-01", 3.25, "b")])
    db.commit()
    db.close()
    return path


def test_tables_equal_their_source(spark, shop):
    want = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice", F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"))
    got = D.read_table(spark, "sqlite3", shop, "orders", "o_orderkey", parts=5)
    assert got.rdd.getNumPartitions() == 6 and got.dtypes == want.dtypes
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    assert D.read_table(spark, "sqlite3", shop, "nation").count() == 25


def test_filters_reach_the_database(spark, shop):
    D.register(spark)
    df = D.read_table(spark, "sqlite3", shop, "customer", "c_custkey", parts=4)
    n = df.where("c_nationkey in (1, 2) and c_acctbal > 0 and not c_custkey = 5 and c_name >= 'C'").count()
    assert n == duckdb.sql(f"select count(*) from '{SF}/customer.parquet' where c_nationkey in (1, 2) and c_acctbal > 0 and c_custkey <> 5").fetchall()[0][0]
    reader = D.TableReader({"module": "sqlite3", "database": shop, "table": "customer", "column": "c_custkey", "parts": "3"}, df.schema)
    left = list(reader.pushFilters([D.S.GreaterThan(("c_custkey",), 100), D.S.In(("c_nationkey",), (1, 2)), D.S.Not(D.S.EqualTo(("c_name",), "x")), D.S.StringContains(("c_name",), "1"), D.S.IsNull(("c_name",))]))
    assert [type(f) for f in left] == [D.S.StringContains, D.S.IsNull]
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert sum(b.num_rows for b in batches) == duckdb.sql(f"select count(*) from '{SF}/customer.parquet' where c_custkey > 100 and c_nationkey in (1, 2)").fetchall()[0][0]
    after = df.where("c_custkey > 120")  # an incremental fetch
    assert after.agg(F.min("c_custkey")).first()[0] == 121


def test_values_that_do_not_decode(spark, shop):
    rows = {r.id: r for r in D.read_table(spark, "sqlite3", shop, "odd", "id", parts=2, errors=True).collect()}
    assert len(rows) == 4 and rows[1]._errors == [] and str(rows[1].price) == "1.500000000" and rows[1].flag is True
    assert rows[2]._errors == ["n: 70000", "flag: maybe", "day: soon", "price: x"] and rows[2].n is None
    assert len(rows[None]._errors) == 2 and rows[None]._errors[0] == "n: 3.5" and rows[9].flag is True
    assert {r.id for r in D.read_table(spark, "sqlite3", shop, "odd", errors=True).where("n is null").collect()} == {2, 9, None}
    with pytest.raises(Exception, match="70000"):
        D.read_table(spark, "sqlite3", shop, "odd", "id").collect()


def test_catalogue_and_keys(shop, tmp_path):
    options = {"module": "sqlite3", "database": shop}
    assert D.catalogue(options)[:2] == [("customer", "c_custkey", "INTEGER", False), ("customer", "c_name", "TEXT", True)]
    assert D.keys(options) == [("customer", "c_custkey", "primary", None, None), ("nation", "n_nationkey", "primary", None, None), ("orders", "o_orderkey", "primary", None, None), ("customer", "c_nationkey", "foreign", "nation", "n_nationkey"), ("orders", "o_custkey", "foreign", "customer", "c_custkey")]
    path = str(tmp_path / "shop.duckdb")
    db = duckdb.connect(path)
    db.execute("create table a (id bigint primary key, day date); create table b (k int, a_id bigint references a (id)); insert into a values (1, '2024-01-01'), (2, null); insert into b values (1, 2)")
    db.close()
    options = {"module": "duckdb", "database": path}
    assert ("b", "a_id", "foreign", "a", "id") in D.keys(options) and ("a", "id", "primary", None, None) in D.keys(options)
    assert D.catalogue(options)[1] == ("a", "day", "DATE", True)


def test_tables_of_duckdb(spark, tmp_path):
    path = str(tmp_path / "x.duckdb")
    db = duckdb.connect(path)
    db.execute("create table t as select range as id, range % 3 = 0 as flag, 'v' || range as v from range(50)")
    db.close()
    assert D.read_table(spark, "duckdb", path, "t").where("id >= 10").agg(F.count("*"), F.count_if("flag"), F.max("v")).first() == (40, 13, "v49")
    with pytest.raises(Exception, match="no table"):
        D.read_table(spark, "duckdb", path, "missing")
