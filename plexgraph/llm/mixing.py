"""Mixing of sources to target weights along a time-varying curriculum, in DataFrame functions only.

Sources in order of code point, null last, have the shares of `shares` in turn.
All targets together are `total` times all sizes; no target is above `cap` times
its source's size, and what is over goes to the others by share (the level is
found in closed form from sums over the sources in order of cap / share).

A source's documents stand in the order of a hash of their ids. It is gone
through in passes; in the last pass, those whose middle lies within the rest of
the target are taken. The weight of a source at time t of the curriculum is
target * (1 + a * (2 t - 1)) with a slope a of `slopes`; its integral is inverted
at the words demanded so far, which gives each taken copy its position in [0, 1].

Cases: null texts have size 0, and documents of size 0 are never short of their
target but take 0 words. Repeated rows are rows like others, and rows without an id
stand by a hash of their text. If all
sizes are 0 the targets are 0. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SHARES = (3, 1, 2)
TOTAL, CAP = 1.5, 2.0
SLOPES = (-0.5, 0.0, 0.5)
#: Hexadecimal digits of the hash: a source's sizes are summed in 16 ** RANGE_DIGITS ranges, and those sums are chained.
RANGE_DIGITS = 3


def _in_turn(values: tuple, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (index % len(values) + 1).cast("int"))


def source_targets(sizes: DataFrame, shares: tuple = SHARES, total: float = TOTAL, cap: float = CAP, slopes: tuple = SLOPES) -> DataFrame:
    """(source, source_size, target, slope) from rows (source, size)."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    index = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    sources = sources.withColumn("index", index).withColumn("share", _in_turn(shares, F.col("index")))
    sources = sources.withColumn("most", cap * F.col("source_size"))
    every, before = Window.partitionBy(), Window.orderBy(F.col("most") / F.col("share"), "index").rowsBetween(Window.unboundedPreceding, -1)
    level = (total * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("share").over(every) - F.coalesce(F.sum("share").over(before), F.lit(0.0)))
    sources = sources.withColumn("level", level)
    sources = sources.withColumn("level", F.max(F.when(F.col("level") <= F.col("most") / F.col("share"), F.col("level"))).over(every))
    target = F.least(F.col("share") * F.coalesce("level", F.lit(0.0)), "most")
    return sources.select("source", "source_size", target.alias("target"), _in_turn(slopes, F.col("index")).alias("slope"))


def mix(docs: DataFrame, shares: tuple = SHARES, total: float = TOTAL, cap: float = CAP, slopes: tuple = SLOPES, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc, size, source_size, target, copies, taken, positions): doc is the row as a struct, positions one of each copy."""
    rows = docs.select(
        F.struct("*").alias("doc"),
        F.col(f"`{source}`").alias("source"),
        F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.col(f"`{text}`"), F.lit("")).cast("binary")).alias("order"),
        F.col(f"`{doc_id}`").alias("id"),
    ).withColumn("range", F.substring("order", 1, RANGE_DIGITS))
    targets = source_targets(rows.select("source", "size"), shares, total, cap, slopes)
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("sum"))
    ahead = F.coalesce(F.sum("sum").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("ahead", ahead).join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of", "sum")
    within = Window.partitionBy("source", "range").orderBy("order", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("within", F.sum("size").over(within))
    sums = sums.select(F.col("source").alias("of"), F.col("range").alias("in"), "ahead", "source_size", "target", "slope")
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("in")))
    middle = F.col("ahead") + F.col("within") - F.col("size") / 2
    passes = F.coalesce(F.expr("floor(try_divide(target, source_size))"), F.lit(0))
    rows = rows.withColumn("middle", middle).withColumn("passes", passes)
    more = (F.col("middle") <= F.col("target") - F.col("passes") * F.col("source_size")) & (F.col("size") > 0)
    rows = rows.withColumn("copies", (F.col("passes") + more.cast("int")).cast("int"))
    demand = lambda turn: F.least((turn * F.col("source_size") + F.col("middle")) / F.col("target"), F.lit(1.0))
    a = F.col("slope")
    invert = lambda q: F.when(a == 0, q).otherwise((a - 1 + F.sqrt((1 - a) * (1 - a) + 4 * a * q)) / (2 * a))
    positions = F.when((F.col("copies") > 0) & (F.col("target") > 0), F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda turn: invert(demand(turn)))).otherwise(F.array().cast("array<double>"))
    return rows.select("doc", "id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), positions.alias("positions"))


def curriculum(docs: DataFrame, **options) -> DataFrame:
    """The taken copies with the columns of docs, sorted by position over range partitions."""
    copies = mix(docs, **options).select("doc", "id", F.explode("positions").alias("position"))
    return copies.orderBy("position", "id").select("doc.*")
