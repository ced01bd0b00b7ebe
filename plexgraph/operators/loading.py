"""Upserts, incremental loads and mutations as joins that give a new table."""

from __future__ import annotations

from functools import reduce
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def latest(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc_nulls_last()))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], conflict: str = "update", order: Column | None = None) -> DataFrame:
    """old with new rows by key. conflict: update, skip, merge_non_null, or error, which fails on a key that exists.

    Of new rows with one key the last by `order` counts, without it the one of the
    greatest values. Rows with a null in their key match nothing and are added as they are.
    """
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    plain = [f.name for f in new.schema.fields if f.name in old.columns and "map<" not in f.dataType.simpleString()]
    loose = new.where(~known).select(*old.columns)
    new = latest(new.where(known), keys, order if order is not None else F.struct(*plain)).select(*old.columns)
    return _upserted(old, new, keys, conflict).unionByName(loose)


def _upserted(old: DataFrame, new: DataFrame, keys: list[str], conflict: str) -> DataFrame:
    if conflict == "skip":
        return old.unionByName(new.join(old.select(keys), keys, "left_anti").select(old.columns))
    if conflict == "error":
        clash = F.assert_true(F.col("__old").isNull(), F.lit("a key of the load exists already"))
        checked = new.join(old.select(*keys, F.lit(1).alias("__old")), keys, "left").where(clash.isNull())
        return old.unionByName(checked.select(old.columns))
    a, b = old.withColumn("__old", F.lit(True)).alias("a"), new.withColumn("__new", F.lit(True)).alias("b")
    joined = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], "full")
    columns = []
    for c in old.columns:
        was, now = F.col(f"a.{c}"), F.col(f"b.{c}")
        if c in keys or conflict == "merge_non_null":
            columns.append(F.coalesce(now, was).alias(c))
        else:
            columns.append(F.when(F.col("__new"), now).otherwise(was).alias(c))
    return joined.select(*columns)


def upsert_counts(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows created and updated."""
    joined = new.select(keys).join(old.select(*keys, F.lit(1).alias("__old")), keys, "left")
    return joined.agg(F.count_if(F.col("__old").isNull()).alias("created"), F.count("__old").alias("updated"))


def upsert_edges(old: DataFrame, new: DataFrame, sources: DataFrame, targets: DataFrame, conflict: str = "update") -> DataFrame:
    """Edges (src, dst, ...) with new ones whose ends exist as id."""
    both = new.join(sources.select(F.col("id").alias("src")), "src", "left_semi").join(targets.select(F.col("id").alias("dst")), "dst", "left_semi")
    return upsert(old, both.select(old.columns), ["src", "dst"], conflict)


def increment(source: DataFrame, column: str, after) -> DataFrame:
    """Rows beyond a watermark of the column's own type."""
    return source.where(F.col(column) > F.lit(after))


def checkpointed(checkpoints: DataFrame, loaded: DataFrame, table: str, column: str) -> DataFrame:
    """Checkpoints (table, watermark, kind, record_count) with the highest watermark and the sum of counts.

    A watermark is kept as text beside its kind (number, time or text), and compared by its kind.
    """
    of = loaded.schema[column].dataType
    kind = "number" if isinstance(of, T.NumericType) else "time" if isinstance(of, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "text"
    now = loaded.agg(F.max(F.col(column)).cast("string").alias("watermark"), F.count(F.lit(1)).alias("record_count"))
    rows = checkpoints.unionByName(now.select(F.lit(table).alias("table"), "watermark", F.lit(kind).alias("kind"), "record_count"))
    number = F.when(F.col("kind") == "number", F.col("watermark").try_cast("decimal(38,9)"))
    time = F.when(F.col("kind") == "time", F.col("watermark").try_cast("timestamp_ntz"))
    highest = F.max(F.when(F.col("watermark").isNotNull(), F.struct(number.alias("number"), time.alias("time"), "watermark", "kind")))
    rows = rows.groupBy("table").agg(highest.alias("top"), F.max("kind").alias("kind"), F.sum("record_count").alias("record_count"))
    return rows.select("table", "top.watermark", "kind", "record_count")


def load_batch(rows: DataFrame, types: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rows in their declared types, rows that don't fit with the names of the columns at fault in `errors`)."""
    faults = F.filter(F.array(*[F.when(F.col(c).isNotNull() & F.col(c).try_cast(kind).isNull(), F.lit(c)) for c, kind in types.items()]), lambda x: x.isNotNull())
    checked = rows.withColumn("errors", faults)
    return checked.where(F.size("errors") == 0).select(*[F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in rows.columns]), checked.where(F.size("errors") > 0)


def step_order(steps: dict[str, list[str]]) -> list[str]:
    """Names of load steps, each after those that it depends on; fails on a circle or an unknown name."""
    return list(TopologicalSorter(steps).static_order()) if not {d for ds in steps.values() for d in ds} - steps.keys() else _unknown(steps)


def _unknown(steps: dict[str, list[str]]) -> list[str]:
    raise ValueError(f"steps depend on unknown ones: {sorted({d for ds in steps.values() for d in ds} - steps.keys())}")


def lineage(counts: DataFrame, label: str, kind: str, errors: list[str] | None = None) -> DataFrame:
    """One lineage row for a load: counts is one row with record_count; partial where there were errors, of which three are kept."""
    errors = errors or []
    return counts.select(F.lit(label).alias("graph_label"), F.lit(kind).alias("element"), "record_count", F.lit("partial" if errors else "completed").alias("status"), F.array(*[F.lit(e) for e in errors[:3]]).cast("array<string>").alias("errors"))


def dry_run(old: DataFrame, new: DataFrame, keys: list[str], conflict: str = "update") -> DataFrame:
    """One row: what an upsert would create, update and leave, without writing."""
    counts = upsert_counts(old, new, keys)
    changes = F.lit(0).cast("long") if conflict == "skip" else F.col("updated")
    return counts.select(F.lit(conflict).alias("conflict"), "created", changes.alias("updated"), (F.col("updated") - changes).alias("left"))


def create_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges (src, dst, ...) with new ones; both ends must be nodes (id), other rows give nothing."""
    found = new.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    return edges.unionByName(found.select(edges.columns), allowMissingColumns=True)


def merge_nodes(rows: DataFrame, new: DataFrame, keys: list[str], on_create: dict[str, Column], on_match: dict[str, Column]) -> DataFrame:
    """rows in which each key of new exists: on_match sets columns of the rows that were there, on_create those of added ones.

    A key with a null in it can be matched by nothing and is left out, so that a repeated call adds nothing.
    """
    wanted = new.select(*keys).dropna().distinct()
    there = rows.join(wanted.withColumn("__hit", F.lit(True)), keys, "left")
    there = there.select(*[F.when(F.col("__hit"), on_match[c]).otherwise(F.col(c)).alias(c) if c in on_match else F.col(c) for c in rows.columns])
    added = wanted.join(rows.select(*keys), keys, "left_anti")
    types = dict(rows.dtypes)
    return there.unionByName(added.select(*[F.col(c) if c in keys else on_create.get(c, F.lit(None)).cast(types[c]).alias(c) for c in rows.columns]))


def merge_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame, match: list[str] | None = None) -> DataFrame:
    """edges with those of new that aren't there yet, by ends and the columns of match; rows whose ends aren't nodes give nothing."""
    keys = ["src", "dst", *(match or [])]
    return create_edges(edges, new.dropDuplicates(keys).join(edges.select(*keys), keys, "left_anti"), nodes)


def remove_label(rows: DataFrame, others: DataFrame, where: Column) -> tuple[DataFrame, DataFrame]:
    """(nodes that keep the label, others with those that lose it)."""
    keeps = ~F.coalesce(where, F.lit(False))
    return rows.where(keeps), others.unionByName(rows.where(~keeps), allowMissingColumns=True)


def mutate(tables: dict[str, DataFrame], *steps) -> dict[str, DataFrame]:
    """tables after steps (name, function of the tables) in their order; each step's result takes the table's place."""
    for name, step in steps:
        tables = tables | {name: step(tables)}
    return tables


def owned(new: DataFrame, column: str, owner) -> DataFrame:
    """Rows to write with the tenant that owns them, whatever they came with."""
    return new.withColumn(column, F.lit(owner))


def create(rows: DataFrame, new: DataFrame) -> DataFrame:
    return rows.unionByName(new, allowMissingColumns=True)


def set_property(rows: DataFrame, name: str, value: Column, where: Column) -> DataFrame:
    return rows.withColumn(name, F.when(where, value).otherwise(F.col(name)) if name in rows.columns else F.when(where, value))


def remove_property(rows: DataFrame, name: str, where: Column) -> DataFrame:
    return set_property(rows, name, F.lit(None), where)


def delete(nodes: DataFrame, edges: DataFrame, where: Column, detach: bool = False, ends: tuple[str, ...] = ("src", "dst")) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without the chosen nodes, which may be at these ends of the edges; without detach it fails if one still has an edge."""
    gone = nodes.where(where).select(F.col("id").alias("__gone"))
    left = edges
    for end in ends:
        if not detach and edges.join(gone, F.col(end) == F.col("__gone"), "left_semi").limit(1).count():
            raise ValueError("a node to delete still has edges")
        left = left.join(gone, F.col(end) == F.col("__gone"), "left_anti")
    return nodes.join(gone, F.col("id") == F.col("__gone"), "left_anti"), left
