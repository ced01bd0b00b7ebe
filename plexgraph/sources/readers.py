"""Tables from files and databases, and what can be inferred of their schemas."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = {"parquet": ("parquet", {}), "csv": ("csv", {"header": True}), "tsv": ("csv", {"header": True, "sep": "\t"}), "json": ("json", {"multiLine": True}), "jsonl": ("json", {}), "ndjson": ("json", {}), "orc": ("orc", {})}
DATABASES = ("postgresql", "mysql")


def read(spark: SparkSession, kind: str, path: str, schema=None, **options) -> DataFrame:
    """A table of a file format; fields of CSV are trimmed and empty ones null."""
    name, defaults = FORMATS[kind]
    if name == "csv":
        defaults = defaults | {"ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True, "nullValue": "", "inferSchema": schema is None}
    reader = spark.read.options(**(defaults | options))
    return (reader.schema(schema) if schema else reader).format(name).load(path)


def read_table(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple | None = None, parts: int = 8, **options) -> DataFrame:
    """A database table over JDBC, read in ranges of a column instead of pages."""
    if url.split(":")[1] not in DATABASES:
        raise ValueError(f"{url} is none of {DATABASES}")
    split = {"partitionColumn": column, "lowerBound": bounds[0], "upperBound": bounds[1], "numPartitions": parts} if column and bounds else {}
    return spark.read.format("jdbc").options(url=url, dbtable=table, **split, **options).load()


def nested_tables(rows: DataFrame, name: str) -> dict[str, DataFrame]:
    """The table and child tables of its structs and arrays of structs, which keep the parent's id as {name}_id."""
    plain, children = [], {}
    key = [F.col("id").alias(f"{name}_id")] if "id" in rows.columns else []
    for f in rows.schema.fields:
        if isinstance(f.dataType, T.StructType):
            children |= nested_tables(rows.select(*key, f"`{f.name}`.*"), f"{name}_{f.name}")
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            children |= nested_tables(rows.select(*key, F.explode(f"`{f.name}`").alias("item")).select(*[k for k in ([f"{name}_id"] if key else [])], "item.*"), f"{name}_{f.name}")
        else:
            plain.append(F.col(f"`{f.name}`"))
    return {name: rows.select(*plain)} | children


def is_key(rows: DataFrame, column: str = "id") -> DataFrame:
    """One row: whether the column is unique and never null."""
    return rows.agg((F.count(F.lit(1)) == F.count_distinct(column)).alias("is_key"))


def inferred_types(rows: DataFrame) -> DataFrame:
    """(column, type) of text columns: the first of bool, int, float, json (an object or a list) that all values have, else string.

    A column without values is a string.
    """
    parts = []
    for c in rows.columns:
        value = F.col(c)
        fits = lambda kind, v=value: F.count_if(v.isNotNull() & v.try_cast(kind).isNull()) == 0
        nested = F.ltrim(value).substr(1, 1).isin("{", "[") & F.try_parse_json(value).isNotNull()
        named = F.when(F.count(value) == 0, "string").when(F.count_if(value.isNotNull() & ~F.lower(value).isin("true", "false")) == 0, "bool").when(fits("long"), "int").when(fits("double"), "float").when(F.count_if(value.isNotNull() & ~nested) == 0, "json").otherwise("string")
        parts.append(F.struct(F.lit(c).alias("column"), named.alias("type")))
    return rows.agg(F.array(*parts).alias("p")).select(F.inline("p"))


def declared(spark: SparkSession, spec: dict) -> DataFrame:
    """A source by its declaration: {kind, path or url and table, delimiter, header, root}; an unknown kind is read as CSV.

    root is the field of a JSON document whose list holds the rows.
    """
    kind = spec.get("kind", "csv")
    if kind == "table":
        return read_table(spark, spec["url"], spec["table"])
    if kind == "json":
        rows = read(spark, "json", spec["path"])
        return rows.select(F.explode(F.col(spec["root"])).alias("row")).select("row.*") if spec.get("root") else rows
    if kind in FORMATS and kind != "csv":
        return read(spark, kind, spec["path"])
    return read(spark, "csv", spec["path"], sep=spec.get("delimiter", ","), header=spec.get("header", True))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n) in one job."""
    rows = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, rows)


def each_table(names: list[str], of, at_once: int = 8) -> list:
    """of(name) for each table, some jobs at a time, in the order of names; an error is raised after the others are done."""
    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(of, names))


#: Queries for a database's columns, its keys, and what foreign keys refer to; the last differs by database.
CATALOGUE = {
    "columns": "select table_name, column_name, data_type, is_nullable from information_schema.columns where table_schema = '{schema}'",
    "keys": "select k.table_name, k.column_name, c.constraint_type from information_schema.key_column_usage k join information_schema.table_constraints c on c.constraint_name = k.constraint_name and c.table_schema = k.table_schema and c.table_name = k.table_name where k.table_schema = '{schema}'",
    "references postgresql": "select k.table_name, k.column_name, u.table_name as in_table, u.column_name as in_column from information_schema.key_column_usage k join information_schema.referential_constraints r on r.constraint_name = k.constraint_name and r.constraint_schema = k.constraint_schema join information_schema.key_column_usage u on u.constraint_name = r.unique_constraint_name and u.constraint_schema = r.unique_constraint_schema and u.ordinal_position = k.position_in_unique_constraint where k.table_schema = '{schema}'",
    "references mysql": "select table_name, column_name, referenced_table_name as in_table, referenced_column_name as in_column from information_schema.key_column_usage where referenced_table_name is not null and table_schema = '{schema}'",
}


def catalogue(spark: SparkSession, url: str, what: str, schema: str = "public", **options) -> DataFrame:
    """The columns, keys or references of a database's tables, read over JDBC; references have the table and column that a foreign key refers to."""
    kind = url.split(":")[1]
    if kind not in DATABASES or not schema.isidentifier():
        raise ValueError(f"{url} is none of {DATABASES}, or {schema} no name")
    what = f"references {kind}" if what == "references" else what
    return spark.read.format("jdbc").options(url=url, query=CATALOGUE[what].format(schema=schema), **options).load()


def sampled_documents(rows: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """n documents in random order: a sampling operator."""
    return rows.orderBy(F.rand(seed)).limit(n)
