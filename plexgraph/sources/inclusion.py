"""Which columns' values lie within another column's: inclusion dependencies and foreign keys, by the data.

All columns of all tables are looked at together. Each table is read once, its columns
become rows of (kind, value, column), and one aggregation by value joins the columns
that hold it as bits of a mask, which Spark combines before it shuffles. Distinct masks
with their numbers of values are few, and each pair of columns is counted from them: a
lies within b if as many values have both bits as have a's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of a mask column; the sign stays free.
BITS = 63
#: Texts of more characters are compared by their SHA-256.
LONG_TEXT = 64


def _kind(kind: T.DataType) -> str | None:
    """Columns of one kind are compared; measures (float, double) and nested columns aren't keys."""
    if isinstance(kind, T.IntegralType) or isinstance(kind, T.DecimalType) and kind.scale == 0:
        return "number"
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return "text"
    return "time" if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else None


def _value(column: Column, kind: str) -> Column:
    text = column.cast("timestamp").cast("string") if kind == "time" else column.cast("string")
    return F.when(F.length(text) > LONG_TEXT, F.sha2(text, 256)).otherwise(text) if kind == "text" else text


def column_masks(tables: dict[str, DataFrame], kinds: tuple[str, ...] = ("number", "text", "time")) -> tuple[list[tuple[str, str]], DataFrame]:
    """The columns in order, as (table, column), and (m0, m1, ..., n): how many values are in exactly the columns of the bits."""
    named = [(t, f.name, _kind(f.dataType)) for t, df in tables.items() for f in df.schema.fields if _kind(f.dataType) in kinds]
    place = {(t, name): k for k, (t, name, _) in enumerate(named)}
    masks = range(-(-len(named) // BITS))
    parts = []
    for t, df in tables.items():
        each = [(place[t, name], name, kind) for table, name, kind in named if table == t]
        if each:
            cells = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), _value(F.col(f"`{name}`"), kind).alias("value")) for k, name, kind in each])
            parts.append(df.select(F.inline(cells)))
    if not parts:
        raise ValueError("no table has a column that can be compared")
    cells = reduce(DataFrame.unionByName, parts).where("value is not null")
    bit = lambda m: F.when(F.floor(F.col("k") / BITS) == m, F.expr(f"shiftleft(1L, k % {BITS})")).otherwise(F.lit(0).cast("long"))
    values = cells.groupBy("kind", "value").agg(*[F.bit_or(bit(m)).alias(f"m{m}") for m in masks])
    return [(t, c) for t, c, _ in named], values.groupBy(*[f"m{m}" for m in masks]).agg(F.count(F.lit(1)).alias("n"))


def inclusions(tables: dict[str, DataFrame], least: float = 1.0, kinds: tuple[str, ...] = ("number", "text", "time")) -> DataFrame:
    """(table, column, in_table, in_column, n_values, n_found, share, in_values, in_is_key) of pairs of columns whose share is `least` at least.

    n_values are the distinct values of the column and n_found those that the other column has too. in_is_key says whether
    that column is unique and never null. Nulls are no values; a column without values isn't listed.
    """
    columns, masks = column_masks(tables, kinds)
    bits = F.array(*[F.when(F.expr(f"shiftright(m{k // BITS}, {k % BITS}) & 1") == 1, F.lit(k)) for k in range(len(columns))])
    sets = masks.select(F.array_compact(bits).alias("held"), "n")
    pairs = sets.select("held", "n", F.explode("held").alias("a")).select("n", "a", F.explode("held").alias("b")).groupBy("a", "b").agg(F.sum("n").alias("n"))
    own = pairs.where("a = b").select("a", F.col("n").alias("n_values"))
    rows = [df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.col(f"`{c}`")).alias(c) for t2, c in columns if t2 == t]) for t, df in tables.items()]
    counts = [r.select(F.inline(F.array(*[F.struct(F.lit(columns.index((t, c))).alias("b"), F.col("rows"), F.col(f"`{c}`").alias("known")) for t2, c in columns if t2 == t]))) for (t, _), r in zip(tables.items(), rows, strict=True) if any(t2 == t for t2, _ in columns)]
    sizes = reduce(DataFrame.unionByName, counts).join(own.select(F.col("a").alias("b"), F.col("n_values").alias("in_values")), "b")
    found = pairs.where("a <> b").join(own, "a").join(sizes, "b")
    name = lambda k, part: F.element_at(F.array(*[F.lit(c[part]) for c in columns]), F.col(k) + 1)
    share = F.col("n") / F.col("n_values")
    key = (F.col("in_values") == F.col("rows")) & (F.col("known") == F.col("rows"))
    return found.where(share >= least).select(name("a", 0).alias("table"), name("a", 1).alias("column"), name("b", 0).alias("in_table"), name("b", 1).alias("in_column"), "n_values", F.col("n").alias("n_found"), share.alias("share"), "in_values", key.alias("in_is_key"))


def _named_alike(column: Column, in_table: Column, in_column: Column) -> Column:
    """Whether a name says what it refers to: the key's name but for the tables' prefixes, or `{table}_id` for a table in one or many."""
    last = lambda x: F.lower(F.regexp_extract(x, "[^_]*$", 0))
    stem, whole = F.regexp_extract(F.lower(column), "^(.+)_id$", 1), F.lower(in_table)
    plural = (whole == stem) | (whole == F.concat(stem, F.lit("s"))) | (whole == F.concat(stem, F.lit("es"))) | (whole == F.concat(F.regexp_replace(stem, "y$", ""), F.lit("ies")))
    prefixed = F.lower(in_column) != last(in_column)
    return (prefixed & (last(column) == last(in_column)) & (last(column) != "id")) | ((stem != "") & plural)


def foreign_keys(found: DataFrame) -> DataFrame:
    """(table, column, in_table, in_column, n_values, coverage) of inclusions that are foreign keys: all values lie within the key of another table, which the name says too."""
    return found.where((F.col("share") == 1) & F.col("in_is_key") & (F.col("table") != F.col("in_table")) & _named_alike(F.col("column"), F.col("in_table"), F.col("in_column"))).select("table", "column", "in_table", "in_column", "n_values", F.round(F.col("n_found") / F.col("in_values"), 6).alias("coverage"))
