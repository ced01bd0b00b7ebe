"""Scalar and aggregate expressions with graph-query semantics, as Spark columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_match(text: Column, pattern: str) -> Column:
    """Whether the whole string matches, unlike rlike, which looks anywhere; a dot is any character."""
    return text.rlike(rf"(?s)\A(?:{pattern})\z")


def one_of(value: Column, values: list) -> Column:
    return value.isin(*values) if values else F.lit(False)


def either_not_both(a: Column, b: Column) -> Column:
    return a != b


def total(value: Column) -> Column:
    """A sum that is 0 over nothing."""
    return F.coalesce(F.sum(value), F.lit(0))


def spread(value: Column) -> Column:
    """Sample standard deviation, 0 for a single value."""
    return F.coalesce(F.stddev_samp(value), F.when(F.count(value) > 0, F.lit(0.0)))


def collected(value: Column, distinct: bool = False) -> Column:
    """Values in sorted order, so that the result doesn't depend on how rows were dealt."""
    return F.sort_array(F.collect_set(value) if distinct else F.collect_list(value))


def ascending(value: Column) -> Column:
    """Nulls are the largest."""
    return value.asc_nulls_last()


def descending(value: Column) -> Column:
    return value.desc_nulls_first()


def to_integer(value: Column) -> Column:
    return value.try_cast("long")


def to_float(value: Column) -> Column:
    return value.try_cast("double")


def like_escaped(text: str) -> str:
    """A literal for ILIKE."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


#: strptime directives and their Spark letters.
DATE_PARTS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss"}


def spark_format(pattern: str) -> str:
    for part, letters in DATE_PARTS.items():
        pattern = pattern.replace(part, letters)
    return pattern


def transform(value: Column, kind: str, *options) -> Column:
    """A load transform of a column; what can't be converted becomes null."""
    if kind == "to_date":
        return F.to_date(F.try_to_timestamp(value, F.lit(spark_format(options[0]))))
    if kind == "to_datetime":
        return F.try_to_timestamp(value, F.lit(spark_format(options[0])))
    if kind == "split":
        parts = F.split_part(value, F.lit(options[0]), F.lit(options[1] + 1))
        return F.when(parts != "", parts)
    plain = {
        "to_string": lambda: value.cast("string"),
        "to_int": lambda: to_integer(value),
        "to_float": lambda: to_float(value),
        "to_bool": lambda: value.try_cast("boolean"),
        "trim": lambda: F.trim(value),
        "to_lower": lambda: F.lower(value),
        "to_upper": lambda: F.upper(value),
    }
    return plain[kind]()


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; null where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def masked_email(value: Column) -> Column:
    """Two characters of the name, and the last part of the domain."""
    return F.concat(F.substring(value, 1, 2), F.lit("**@***."), F.substring_index(value, ".", -1))


def size_of(value: Column, kind: str) -> Column:
    """The length of a string or the number of elements of a list, by the column's type name; null of null."""
    return F.when(value.isNotNull(), F.size(value) if kind.startswith(("array", "map")) else F.length(value))


def any_of(values: Column, test) -> Column:
    return F.exists(values, test)


def comprehension(values: Column, where=None, to=None, most: int | None = None) -> Column:
    """[x in values where ... | to(x)][..most]"""
    out = F.filter(values, where) if where else values
    out = F.transform(out, to) if to else out
    return F.slice(out, 1, most) if most is not None else out


def at(values: Column, index: int) -> Column:
    """The element of an index from 0, or from the end if it is negative; null beyond."""
    return F.get(values, F.lit(index) if index >= 0 else F.size(values) + index)


def chosen(value: Column, cases: list[tuple], default=None) -> Column:
    """The simple form of CASE: the first result whose value is equal."""
    out = F.when(value == F.lit(cases[0][0]), F.lit(cases[0][1]))
    for known, result in cases[1:]:
        out = out.when(value == F.lit(known), F.lit(result))
    return out.otherwise(F.lit(default))


def duration(text: Column) -> Column:
    """Seconds of a duration PnWnDTnHnMnS without years and months, whose lengths vary; null if it is none or has those."""
    part = lambda letter, seconds: F.coalesce(F.nullif(F.regexp_extract(text, rf"(\d+(?:\.\d+)?){letter}", 1), F.lit("")).try_cast("double"), F.lit(0.0)) * seconds
    return F.when(text.rlike(r"\AP(?=.)(\d+W)?(\d+D)?(T(?=\d)(\d+H)?(\d+M)?(\d+(\.\d+)?S)?)?\z"), part("W", 604800) + part("D", 86400) + part("H", 3600) + part("M", 60) + part("S", 1))


def plus_duration(at: Column, text: Column, sign: int = 1) -> Column:
    """A date or time later by a duration PnYnMnWnDTnHnMnS (sign -1: earlier), by the calendar; null if it is no duration.

    Years and months come first, with the last day of a shorter month, then weeks and days, then hours, minutes and seconds.
    """
    fits = text.rlike(r"\AP(?=.)(\d+Y)?(\d+M)?(\d+W)?(\d+D)?(T(?=\d)(\d+H)?(\d+M)?(\d+(\.\d+)?S)?)?\z")
    days, clock = F.regexp_extract(text, "^P([^T]*)", 1), F.regexp_extract(text, "T(.*)$", 1)
    part = lambda of, letter, kind="int": F.coalesce(F.nullif(F.regexp_extract(of, rf"(\d+(?:\.\d+)?){letter}", 1), F.lit("")).try_cast(kind), F.lit(0).cast(kind)) * sign
    months = F.make_ym_interval(part(days, "Y"), part(days, "M"))
    rest = F.make_dt_interval(part(days, "W") * 7 + part(days, "D"), part(clock, "H"), part(clock, "M"), part(clock, "S", "decimal(18,6)"))
    return F.when(fits, at.cast("timestamp_ntz") + months + rest)


def json_text(value: Column, path: str) -> Column:
    return F.get_json_object(value, f"$.{path}")


#: Functions that a query may call by name.
FUNCTIONS = {
    "toUpper": F.upper, "toLower": F.lower, "trim": F.trim, "toString": lambda x: x.cast("string"), "toInteger": to_integer, "toFloat": to_float,
    "coalesce": F.coalesce, "abs": F.abs, "round": F.round, "left": F.left, "length": F.length, "date": lambda x: F.to_date(x), "sha256": lambda x: F.sha2(x, 256),
}


def call(name: str, *arguments: Column) -> Column:
    """A function of the list by name; fails on others."""
    if name not in FUNCTIONS:
        raise ValueError(f"no function {name}; there are {sorted(FUNCTIONS)}")
    return FUNCTIONS[name](*arguments)


def custom(expression: str, columns: list[str]) -> Column:
    """A custom transform in SQL over the given columns and functions of Spark without subqueries."""
    if any(word in expression.lower().split() for word in ("select", "from", ";")):
        raise ValueError("a transform is one expression")
    names = set(re.findall(r"[A-Za-z_]\w*(?!\w*\s*\()", re.sub(r"'[^']*'", "", expression))) - {"case", "when", "then", "else", "end", "and", "or", "not", "is", "null", "true", "false", "in", "like", "as", "between"}
    if names - set(columns):
        raise ValueError(f"unknown columns {sorted(names - set(columns))}")
    return F.expr(expression)
