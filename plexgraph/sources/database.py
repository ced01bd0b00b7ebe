"""Database tables as a Spark data source in Python, for databases that a DB-API module reaches but no JDBC driver is at hand.

`register(spark)` adds the format `dbapi`:

    spark.read.format("dbapi").options(module="sqlite3", database="/shared/shop.db", table="orders",
        column="id", parts="16").load().where("id > 100")

A table is read in ranges of a column, one Spark partition each, with one more for nulls. Comparisons with constants, lists
and null tests go into the database's own query, so only rows that pass are fetched; Spark tests what a database can't be
asked. Rows come as Arrow batches of `fetch` rows, never a table at once. A value that its column's type can't hold becomes
null, and `_errors` lists it as `column: value` where the option errors is true; else it is an error of the read.
"""

from __future__ import annotations

import datetime
import decimal
import importlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as S
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Spark types of a declared type, by the words it begins with.
DECLARED = (
    ("tinyint", T.ByteType()), ("smallint", T.ShortType()), ("bigint", T.LongType()), ("hugeint", T.DecimalType(38, 0)), ("integer", T.LongType()), ("int", T.LongType()), ("serial", T.LongType()),
    ("double", T.DoubleType()), ("float", T.DoubleType()), ("real", T.DoubleType()), ("decimal", T.DecimalType(38, 9)), ("numeric", T.DecimalType(38, 9)), ("bool", T.BooleanType()),
    ("timestamp", T.TimestampNTZType()), ("datetime", T.TimestampNTZType()), ("date", T.DateType()), ("blob", T.BinaryType()), ("bytea", T.BinaryType()),
)
ERRORS = "_errors"


def _connect(options):
    module = importlib.import_module(options["module"])
    return module.connect(options["database"], **({"read_only": True} if options["module"] == "duckdb" else {}))


def _rows(options, sql: str, parameters=()) -> list[tuple]:
    connection = _connect(options)
    try:
        return connection.cursor().execute(sql, parameters).fetchall()
    finally:
        connection.close()


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def spark_type(declared: str) -> T.DataType:
    """The type of a column by its declaration; what isn't known is text."""
    low = (declared or "").lower()
    return next((kind for word, kind in DECLARED if low.startswith(word)), T.StringType())


def catalogue(options) -> list[tuple[str, str, str, bool]]:
    """(table, column, declared type, nullable) of all tables, in order."""
    if options["module"] == "sqlite3":
        return [(t, c, kind, not (needed or key)) for t, c, kind, needed, key in _rows(options, "select m.name, p.name, p.type, p.\"notnull\", p.pk from sqlite_master m, pragma_table_info(m.name) p where m.type in ('table', 'view') order by m.name, p.cid")]
    return [(t, c, kind, yes == "YES") for t, c, kind, yes in _rows(options, "select table_name, column_name, data_type, is_nullable from information_schema.columns where table_schema not in ('information_schema', 'pg_catalog') order by table_name, ordinal_position")]


def keys(options) -> list[tuple[str, str, str, str | None, str | None]]:
    """(table, column, primary or foreign, table and column that it refers to) of all keys."""
    if options["module"] == "sqlite3":
        own = [(t, c, "primary", None, None) for t, c in _rows(options, "select m.name, p.name from sqlite_master m, pragma_table_info(m.name) p where m.type = 'table' and p.pk > 0 order by m.name, p.pk")]
        first = {t: c for t, c, *_ in reversed(own)}
        refer = _rows(options, 'select m.name, f."from", f."table", f."to" from sqlite_master m, pragma_foreign_key_list(m.name) f order by m.name, f.id, f.seq')
        return own + [(t, c, "foreign", u, d or first.get(u)) for t, c, u, d in refer]
    found = _rows(options, "select table_name, constraint_type, constraint_column_names, referenced_table, referenced_column_names from duckdb_constraints() where constraint_type in ('PRIMARY KEY', 'FOREIGN KEY') order by table_name, constraint_index")
    return [(t, c, kind.split()[0].lower(), u or None, d) for t, kind, names, u, others in found for c, d in zip(names, others or [None] * len(names), strict=True)]


@dataclass
class Range(S.InputPartition):
    """A part of a table: a condition and its parameters."""

    condition: str
    parameters: tuple


class TableReader(S.DataSourceReader):
    COMPARED = {S.EqualTo: "=", S.GreaterThan: ">", S.GreaterThanOrEqual: ">=", S.LessThan: "<", S.LessThanOrEqual: "<="}

    def __init__(self, options: dict, schema: T.StructType):
        self.options, self.schema = options, schema
        self.errors = ERRORS in schema.names
        self.columns = [f for f in schema.fields if f.name != ERRORS]
        self.where: list[tuple[str, tuple]] = []

    def _asked(self, f) -> tuple[str, tuple] | None:
        """A filter as a condition of the database, if it can be one."""
        if isinstance(f, S.Not):
            inner = self._asked(f.child)
            return (f"not ({inner[0]})", inner[1]) if inner else None
        kinds = {x.name: x.dataType for x in self.columns}
        if not getattr(f, "attribute", None) or len(f.attribute) != 1 or f.attribute[0] not in kinds:
            return None
        name = f.attribute[0]
        if isinstance(f, (S.IsNull, S.IsNotNull)):
            # a value that can't be decoded is null in Spark, though not in the database
            return (f"{_quoted(name)} is not null", ()) if isinstance(f, S.IsNotNull) else None
        values = tuple(f.value) if isinstance(f, S.In) else (getattr(f, "value", None),)
        plain = (int, float, str) if isinstance(kinds[name], (T.StringType, T.NumericType)) else ()
        if not values or not all(isinstance(v, plain) and not isinstance(v, bool) for v in values):
            return None
        if isinstance(f, S.In):
            return f"{_quoted(name)} in ({', '.join('?' * len(values))})", values
        sign = self.COMPARED.get(type(f))
        return (f"{_quoted(name)} {sign} ?", values) if sign else None

    def pushFilters(self, filters):
        """Takes what the database can test; Spark tests it again only where a value may not decode."""
        for f in filters:
            asked = self._asked(f)
            if asked:
                self.where.append(asked)
            if not asked or self.errors:
                yield f

    def _sql(self, what: str, more: str = "") -> tuple[str, tuple]:
        conditions = [f"({c})" for c, _ in self.where] + ([f"({more})"] if more else [])
        tail = " where " + " and ".join(conditions) if conditions else ""
        return f"select {what} from {_quoted(self.options['table'])}{tail}", tuple(v for _, values in self.where for v in values)

    def partitions(self):
        column, parts = self.options.get("column"), int(self.options.get("parts", 8))
        if not column:
            return [Range("", ())]
        name = _quoted(column)
        low, high = _rows(self.options, *self._sql(f"min({name}), max({name})"))[0]
        if low is None:
            return [Range(f"{name} is null", ())]
        if not isinstance(low, int) or not isinstance(high, int):
            raise ValueError(f"ranges need whole numbers, {column} has {low!r} to {high!r}")
        width = max(-(-(high - low + 1) // parts), 1)
        ranges = [Range(f"{name} >= ? and {name} < ?", (a, a + width)) for a in range(low, high + 1, width)]
        return [*ranges, Range(f"{name} is null", ())]

    def read(self, partition):
        schema = to_arrow_schema(self.schema)
        connection = _connect(self.options)
        try:
            sql, parameters = self._sql(", ".join(_quoted(f.name) for f in self.columns), partition.condition)
            cursor = connection.cursor().execute(sql, parameters + partition.parameters)
            while rows := cursor.fetchmany(int(self.options.get("fetch", 10_000))):
                yield self._batch(rows, schema)
        finally:
            connection.close()

    def _batch(self, rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        wrong: list[list[str]] = [[] for _ in rows]
        columns = []
        for k, f in enumerate(self.columns):
            values = []
            for row, faults in zip(rows, wrong, strict=True):
                try:
                    values.append(None if row[k] is None else decoded(row[k], f.dataType))
                except (ValueError, TypeError, ArithmeticError, OverflowError) as fault:
                    if not self.errors:
                        raise ValueError(f"{f.name} holds {row[k]!r}, which is no {f.dataType.simpleString()}") from fault
                    values.append(None)
                    faults.append(f"{f.name}: {row[k]}")
            columns.append(pa.array(values, schema.field(f.name).type))
        if self.errors:
            columns.append(pa.array(wrong, schema.field(ERRORS).type))
        return pa.RecordBatch.from_arrays(columns, schema=pa.schema([schema.field(f.name) for f in self.columns] + ([schema.field(ERRORS)] if self.errors else [])))


LIMITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def decoded(value, kind: T.DataType):
    """A database's value as one of a Spark type; an error where it isn't one."""
    if isinstance(kind, T.IntegralType):
        if isinstance(value, float) and value != int(value) or isinstance(value, (bytes, bool)):
            raise ValueError
        number = int(value)
        if not -(1 << LIMITS[type(kind)] - 1) <= number < 1 << LIMITS[type(kind)] - 1:
            raise OverflowError
        return number
    if isinstance(kind, T.DoubleType):
        return float(value)
    if isinstance(kind, T.DecimalType):
        return decimal.Decimal(str(value)).quantize(decimal.Decimal(1).scaleb(-kind.scale), context=decimal.Context(prec=kind.precision))
    if isinstance(kind, T.BooleanType):
        known = {0: False, 1: True, "0": False, "1": True, "false": False, "true": True, "f": False, "t": True}
        low = value.lower() if isinstance(value, str) else value
        if low not in known:
            raise ValueError
        return known[low]
    if isinstance(kind, T.DateType):
        return value.date() if isinstance(value, datetime.datetime) else value if isinstance(value, datetime.date) else datetime.date.fromisoformat(value)
    if isinstance(kind, T.TimestampNTZType):
        return value.replace(tzinfo=None) if isinstance(value, datetime.datetime) else datetime.datetime.fromisoformat(value).replace(tzinfo=None)
    if isinstance(kind, T.BinaryType):
        return value if isinstance(value, bytes) else str(value).encode()
    return value.decode() if isinstance(value, bytes) else str(value)


class DatabaseSource(S.DataSource):
    """Options: module, database, table; column and parts for ranges; fetch; errors."""

    @classmethod
    def name(cls):
        return "dbapi"

    def schema(self):
        options = dict(self.options)
        fields = [T.StructField(c, spark_type(kind)) for t, c, kind, _ in catalogue(options) if t == options["table"]]
        if not fields:
            raise ValueError(f"no table {options['table']}")
        return T.StructType(fields + ([T.StructField(ERRORS, T.ArrayType(T.StringType()))] if options.get("errors") == "true" else []))

    def reader(self, schema):
        return TableReader(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    """Adds the format dbapi to a session, with filters that reach the database."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DatabaseSource)


def read_table(spark: SparkSession, module: str, database: str, table: str, column: str | None = None, parts: int = 8, errors: bool = False) -> DataFrame:
    """A table of a database file that all executors can reach."""
    register(spark)
    options = {"module": module, "database": database, "table": table, "parts": str(parts), "errors": str(errors).lower()} | ({"column": column} if column else {})
    return spark.read.format("dbapi").options(**options).load()
