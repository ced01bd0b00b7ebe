"""Functions of a user's own, which queries call by name: from columns and from SQL alike.

A scalar function takes and gives Arrow arrays, a batch at a time; a table function gives
rows for a row. Both state their types, and arguments are cast to them or are an error.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plexgraph.functions import scalar


@dataclass(frozen=True)
class Function:
    name: str
    takes: tuple[str, ...]
    returns: str
    run: Callable
    table: bool = False


@dataclass
class Functions:
    known: dict[str, Function] = field(default_factory=dict)

    def _add(self, function: Function) -> None:
        if not function.name.isidentifier():
            raise ValueError(f"{function.name!r} is no name")
        if function.name in self.known or function.name in scalar.FUNCTIONS:
            raise ValueError(f"there is a function {function.name} already")
        self.known[function.name] = function

    def scalar(self, name: str, takes: tuple[str, ...], returns: str):
        """Declares a function of Arrow arrays that gives an array of as many values."""

        def keep(run):
            self._add(Function(name, takes, returns, run))
            return run

        return keep

    def table(self, name: str, takes: tuple[str, ...], returns: str):
        """Declares a generator of tuples, called once a row; returns is the rows' schema."""

        def keep(run):
            self._add(Function(name, takes, returns, run, table=True))
            return run

        return keep

    def _typed(self, name: str, arguments: tuple, table: bool) -> tuple[Function, list[Column]]:
        function = self.known.get(name)
        if function is None or function.table != table:
            raise ValueError(f"no {'table ' if table else ''}function {name}; there are {sorted(n for n, f in self.known.items() if f.table == table)}")
        if len(arguments) != len(function.takes):
            raise ValueError(f"{name} takes {len(function.takes)} arguments ({', '.join(function.takes)}), not {len(arguments)}")
        return function, [(F.col(a) if isinstance(a, str) else a).cast(kind) for a, kind in zip(arguments, function.takes, strict=True)]

    def call(self, name: str, *arguments: Column | str) -> Column:
        """A function by name: one of the user's, or of `scalar.FUNCTIONS`."""
        if name in scalar.FUNCTIONS:
            return scalar.call(name, *[F.col(a) if isinstance(a, str) else a for a in arguments])
        function, columns = self._typed(name, arguments, table=False)
        return F.arrow_udf(function.run, function.returns)(*columns)

    def rows(self, df: DataFrame, name: str, *arguments: Column | str, keep: tuple[str, ...] = ()) -> DataFrame:
        """The columns to keep of each row beside the rows that a table function gives for it."""
        function, columns = self._typed(name, arguments, table=True)
        given = df.select(*keep, *[c.alias(f"__a{k}") for k, c in enumerate(columns)]).alias("d")
        joined = given.lateralJoin(_udtf(function)(*[F.col(f"d.__a{k}").outer() for k in range(len(columns))]))
        return joined.drop(*[f"__a{k}" for k in range(len(columns))])

    def install(self, spark: SparkSession) -> None:
        """Makes all functions known to the session's SQL."""
        for f in self.known.values():
            if f.table:
                spark.udtf.register(f.name, _udtf(f))
            else:
                spark.udf.register(f.name, F.arrow_udf(f.run, f.returns))


def _udtf(function: Function):
    class Rows:
        def eval(self, *arguments):
            yield from function.run(*arguments)

    return F.udtf(Rows, returnType=function.returns)
