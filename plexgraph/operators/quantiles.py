"""Exact quantiles by narrowing, and mergeable sketches of columns that are kept and brought up to date."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: So many values may be sorted in one place.
FEW = 10_000
#: Share of the values that a narrowed range spans, twice; the sketch of a quantile is more exact than that.
MARGIN = 2e-4


def quantile(rows: DataFrame, column: str, p: float):
    """The least value of a column that at least a share p of its values don't exceed, or None without values.

    Exact, without gathering the column: sketches give a range around the quantile, the values below it are counted, and the
    next pass looks within it alone, until FEW values are left. Each pass narrows some thousandfold.
    """
    values = rows.where(F.col(column).isNotNull()).select(F.col(column).alias("v"))
    n = values.count()
    if not n:
        return None
    rank, m = max(-int(-(p * n) // 1), 1), n
    while m > FEW:
        q = rank / m
        low, high = values.agg(F.percentile_approx("v", [max(q - MARGIN, 0.0), min(q + MARGIN, 1.0)], 10_000)).first()[0]
        below, upto = values.agg(F.count_if(F.col("v") < F.lit(low)), F.count_if(F.col("v") <= F.lit(high))).first()
        if rank <= below:
            values, m = values.where(F.col("v") < F.lit(low)), below
        elif rank > upto:
            values, m, rank = values.where(F.col("v") > F.lit(high)), m - upto, rank - upto
        elif low == high:
            return low
        else:
            values, rank = values.where(F.col("v").between(F.lit(low), F.lit(high))), rank - below
            if upto - below == m:  # the range spans all: both ends are frequent values
                ends = values.agg(F.count_if(F.col("v") == F.lit(low)), F.count_if(F.col("v") == F.lit(high))).first()
                if rank <= ends[0]:
                    return low
                if rank > m - ends[1]:
                    return high
                values, rank = values.where((F.col("v") > F.lit(low)) & (F.col("v") < F.lit(high))), rank - ends[0]
                m = m - ends[0] - ends[1]
                continue
            m = upto - below
    return sorted(r["v"] for r in values.collect())[rank - 1]


#: Relative standard error of a distinct count by a sketch of 2^LOG_K buckets, and rank error of a quantile by K (fixed by the sketches).
LOG_K, K = 12, 400
DISTINCT_ERROR, RANK_ERROR = 1.04 / 2 ** (LOG_K / 2), 2.446 / K**0.9433


def _measured(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def sketches(rows: DataFrame, by: list[str] = (), columns: list[str] | None = None) -> DataFrame:
    """(by..., column, n, n_null, low, high, distinct_sketch, quantile_sketch) of columns, for each part of the rows by some columns.

    The sketches are of bounded size whatever the rows; texts and other types have no quantile sketch, and low and high are
    those of the text form. A table of them is what `merged` takes, so a new part costs only its own rows.
    """
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    columns = [c for c in columns or rows.columns if c not in by]
    parts = []
    for c in columns:
        value, text = F.col(f"`{c}`"), F.col(f"`{c}`").cast("string")
        quantiles = F.kll_sketch_agg_double(value.cast("double"), F.lit(K)) if _measured(kinds[c]) else F.lit(None).cast("binary")
        extreme = value if _measured(kinds[c]) else text
        parts.append(F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("n"), F.count_if(value.isNull()).alias("n_null"), F.min(extreme).cast("string").alias("low"), F.max(extreme).cast("string").alias("high"), F.hll_sketch_agg(text, F.lit(LOG_K)).alias("distinct_sketch"), quantiles.alias("quantile_sketch")))
    each = rows.groupBy(*by).agg(F.array(*parts).alias("parts"))
    return each.select(*by, F.inline("parts"))


def merged(kept: DataFrame, by: list[str] = ()) -> DataFrame:
    """Sketches of several parts as those of their union, for each value of some columns."""
    number = lambda c: F.col(c).try_cast("double")
    numeric = F.max(F.col("quantile_sketch").isNotNull())
    low = F.when(numeric, F.min_by("low", number("low"))).otherwise(F.min("low"))
    high = F.when(numeric, F.max_by("high", number("high"))).otherwise(F.max("high"))
    return kept.groupBy(*by, "column").agg(F.sum("n").alias("n"), F.sum("n_null").alias("n_null"), low.alias("low"), high.alias("high"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.when(numeric, F.kll_merge_agg_double("quantile_sketch", F.lit(K))).alias("quantile_sketch"))


def estimates(kept: DataFrame, ranks: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(..., column, n, n_null, low, high, n_distinct, quantiles) of sketches.

    n_distinct is within three times DISTINCT_ERROR of the true number in 99.7 of 100 cases; a quantile's rank is within
    RANK_ERROR of the one asked for in 99 of 100 cases. quantiles is null where a column has no number.
    """
    some = F.col("quantile_sketch").isNotNull() & (F.col("n") > F.col("n_null"))
    quantiles = F.when(some, F.kll_sketch_get_quantile_double("quantile_sketch", F.array(*[F.lit(float(r)) for r in ranks])))
    others = [c for c in kept.columns if c not in ("distinct_sketch", "quantile_sketch")]
    return kept.select(*others, F.hll_sketch_estimate("distinct_sketch").alias("n_distinct"), quantiles.alias("quantiles"))


def file_rows(spark, paths: dict[str, str]) -> DataFrame:
    """(table, n) of Parquet tables from their footers alone: a count that reads no column."""
    parts = [spark.read.parquet(path).select(F.lit(name).alias("table")).groupBy("table").agg(F.count(F.lit(1)).alias("n")) for name, path in paths.items()]
    return reduce(DataFrame.unionByName, parts)


def within(estimate: Column, exact: Column, error: float) -> Column:
    """Whether an estimate is within a relative error of the exact number."""
    return F.abs(estimate - exact) <= F.greatest(exact * error, F.lit(1.0))
