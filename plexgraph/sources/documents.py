"""Collections of JSON documents: a seeded sample, the types of their fields, tables of their nested parts, and a profile.

Documents are VARIANT values. Each level of nesting is one pass: the fields of all
documents of a level become rows, and what is an object or an array with objects goes
to the next level as documents of a child table, named {table}_{field}. Only counts by
table, field and type reach the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexgraph.operators.rounds import Rounds

#: Types of VARIANT values by what they are called here; objects and arrays are looked into.
NAMES = {"BIGINT": "int", "DOUBLE": "double", "FLOAT": "double", "STRING": "string", "BOOLEAN": "bool", "VOID": "null", "DATE": "date", "TIMESTAMP": "date", "TIMESTAMP_NTZ": "date"}
#: How a named type is read.
READ = {"int": "bigint", "double": "double", "string": "string", "bool": "boolean", "date": "timestamp", "array": "string"}
#: Levels of nesting that are looked at; deeper documents are an error.
MOST_LEVELS = 64
#: Fields of more values have none listed in a profile.
MOST_VALUES = 30


def as_documents(rows: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc, columns to keep) of JSON texts; what is no JSON object, or null, is left out."""
    doc = F.try_parse_json(F.col(f"`{column}`"))
    return rows.select(doc.alias("doc"), *[F.col(f"`{c}`") for c in keep]).where(F.schema_of_variant("doc").startswith("OBJECT"))


def sampled(rows: DataFrame, n: int, seed: int = 1, total: int | None = None) -> DataFrame:
    """About n of the rows, in one pass without a sort: those whose hash with the seed is below a share of all hashes.

    The share is n of `total` rows (counted where it isn't given, which for Parquet reads footers only). The same rows
    give the same sample however they are dealt, and equal rows go together; all rows come if there are n at most.
    """
    total = rows.count() if total is None else total
    if total <= n:
        return rows
    whole = F.xxhash64(F.to_json(F.struct("*")), F.lit(seed))
    return rows.where(F.pmod(whole, F.lit(1 << 40)) < int(n / total * (1 << 40)))


def _type(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    named = reduce(lambda when, x: when.when(kind == x[0], x[1]), list(NAMES.items())[1:], F.when(kind == "BIGINT", "int"))
    return named.when(kind.startswith("DECIMAL"), "double").when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").otherwise("string")


def _fields(level: DataFrame) -> DataFrame:
    """(table, field, value, type) of the fields of the documents of a level (table, doc)."""
    spark = level.sparkSession
    each = level.alias("d").lateralJoin(spark.tvf.variant_explode(F.col("d.doc").outer()))
    return each.select("table", F.col("key").alias("field"), "value", _type(F.col("value")).alias("type"))


def _items(fields: DataFrame) -> DataFrame:
    """(table, field, value) of the objects within the array fields."""
    spark = fields.sparkSession
    arrays = fields.where("type = 'array'").select("table", "field", F.col("value").alias("list"))
    items = arrays.alias("a").lateralJoin(spark.tvf.variant_explode(F.col("a.list").outer()))
    return items.select("table", "field", "value").where(_type(F.col("value")) == "object")


def _with_objects(value: Column) -> Column:
    """Whether a value is an array with an object in it."""
    items = F.try_variant_get(value, "$", "array<variant>")
    return F.coalesce(F.exists(items, lambda x: F.schema_of_variant(x).startswith("OBJECT")), F.lit(False))


def field_types(docs: DataFrame, table: str) -> DataFrame:
    """(table, field, type, nullable, n, documents) of documents (doc) and of the child tables within them.

    n of the table's documents have a value that isn't null; nullable says that some have none. Nulls leave the type to the
    others (string if there are none), whole and other numbers together are double, and other mixes string. An array without
    objects is of type array. Objects, and arrays with an object, make no field but a child table; a field that holds
    objects in some documents and values in others is both.
    """
    rounds = Rounds(docs)
    level, counts = docs.select(F.lit(table).alias("table"), "doc"), []
    for k in range(MOST_LEVELS + 1):
        if k == MOST_LEVELS:
            raise ValueError(f"documents are nested deeper than {MOST_LEVELS} levels")
        level = rounds.keep(f"level {k}", level)
        fields = _fields(level).withColumn("type", F.when((F.col("type") == "array") & _with_objects(F.col("value")), "objects").otherwise(F.col("type")))
        plain = fields.where("type not in ('object', 'objects')").groupBy("table", "field", "type").agg(F.count(F.lit(1)).alias("n"))
        counts.append(rounds.keep(f"counts {k}", plain.join(level.groupBy("table").agg(F.count(F.lit(1)).alias("documents")), "table")))
        nested = fields.where("type = 'object'").select("table", "field", "value").unionByName(_items(fields.where("type = 'objects'").withColumn("type", F.lit("array"))))
        level = nested.select(F.concat_ws("_", "table", "field").alias("table"), F.col("value").alias("doc"))
        if not level.limit(1).count():
            break
    rows = reduce(DataFrame.unionByName, counts)
    kinds = F.array_sort(F.collect_set(F.when(F.col("type") != "null", F.col("type"))))
    merged = F.when(F.size("kinds") == 0, "string").when(F.size("kinds") == 1, F.col("kinds")[0]).when(F.col("kinds") == F.array(F.lit("double"), F.lit("int")), "double").otherwise("string")
    known = F.coalesce(F.sum(F.when(F.col("type") != "null", F.col("n"))), F.lit(0))
    each = rows.groupBy("table", "field").agg(kinds.alias("kinds"), known.alias("n"), F.max("documents").alias("documents"))
    return each.select("table", "field", merged.alias("type"), (F.col("n") < F.col("documents")).alias("nullable"), "n", "documents")


def _path(field: str) -> str:
    """A field as a path; a name with both kinds of quotes can't be one."""
    return f'$["{field}"]' if "'" in field else f"$['{field}']"


def document_tables(docs: DataFrame, table: str, types: list, key: str = "_id") -> dict[str, DataFrame]:
    """The documents (doc) as a table with the typed fields of field_types (its rows), and a table of each nested part.

    A nested table has its parent's key, where the top has a field of that name, as {table}_{key}. Values that a field's
    type can't hold become null, numbers and truth values read as string keep their JSON form.
    """
    fields: dict[str, list[tuple[str, str]]] = {}
    for r in types:
        fields.setdefault(r["table"], []).append((r["field"], r["type"]))
    own = dict(fields.get(table, [])).get(key)
    parent = f"{table}_{key}".replace("__", "_")
    out: dict[str, DataFrame] = {}
    levels = {table: docs.select("doc", *([F.try_variant_get("doc", _path(key), READ[own]).alias(parent)] if own else []))}
    for name in sorted({*fields, table}, key=len):  # a parent's name is shorter than its children's
        if name not in levels:
            above = max((x for x in levels if name.startswith(f"{x}_")), key=len)
            within = _path(name[len(above) + 1 :])
            one, many = F.try_variant_get("doc", within, "variant"), F.try_variant_get("doc", within, "array<variant>")
            parts = F.when(F.schema_of_variant(one).startswith("OBJECT"), F.array(one)).otherwise(many)
            rows = levels[above].select(F.explode(parts).alias("doc"), *([parent] if own else []))
            levels[name] = rows.where(F.schema_of_variant("doc").startswith("OBJECT"))
        columns = [F.try_variant_get("doc", _path(f), READ[kind]).alias(f) for f, kind in sorted(fields.get(name, []))]
        out[name] = levels[name].select(*([parent] if own and name != table else []), *columns)
    return out


def profile(docs: DataFrame, table: str, most_values: int = MOST_VALUES) -> DataFrame:
    """(table, field, documents, null_count, distinct_count, min, max, values) of the top fields of documents, values as text.

    A field that a document lacks is null there. values are listed, in order, if there are most_values at most.
    """
    level = docs.select(F.lit(table).alias("table"), "doc")
    total = level.agg(F.count(F.lit(1)).alias("documents"))  # one row
    each = _fields(level).where("type not in ('object', 'null')").select("table", "field", F.try_variant_get("value", "$", "string").alias("value")).groupBy("table", "field", "value").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("table", "field").orderBy("value"))
    few = F.array_sort(F.collect_list(F.when(F.col("rank") <= most_values, F.col("value"))))
    stats = each.withColumn("rank", rank).groupBy("table", "field").agg(F.sum("n").alias("known"), F.count(F.lit(1)).alias("distinct_count"), F.min("value").alias("min"), F.max("value").alias("max"), few.alias("few"))
    values = F.when(F.col("distinct_count") <= most_values, F.col("few")).otherwise(F.array().cast("array<string>"))
    return stats.crossJoin(F.broadcast(total)).select("table", "field", "documents", (F.col("documents") - F.col("known")).alias("null_count"), "distinct_count", "min", "max", values.alias("values"))
