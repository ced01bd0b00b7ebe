"""Graphs in blocks of nodes, as packed arrays: rounds of messages pass a value once to each block that needs it, not once a link."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plexgraph.operators.rounds import Rounds

#: Rows that blocks exchange: data is an array's bytes, value a number, other the block that it comes from or goes to.
SCHEMA = "block int, kind string, other int, data binary, value double"
#: Links of a block: so many while there are few blocks, and more of them in larger graphs.
LEAST_LINKS, MOST_LINKS, FEW_BLOCKS = 250_000, 2_000_000, 64
_U = np.uint64


def rotated(x: np.ndarray, n: int) -> np.ndarray:
    return (x << _U(n)) | (x >> _U(64 - n))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> _U(29))) * _U(0x165667B19E3779F9)
    return x ^ (x >> _U(32))


def xxhash64(ids: np.ndarray, k: int | None = None) -> np.ndarray:
    """F.xxhash64 of longs, or of longs and an int of 0 or more."""
    one, two, three, four, five = (_U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    with np.errstate(over="ignore"):
        h = (_U(42) + five + _U(8)) ^ (rotated(ids.astype(np.int64).view(_U) * two, 31) * one)
        h = _mixed(rotated(h, 27) * one + four)
        if k is not None:
            h = (h + five + _U(4)) ^ (_U(k) * one)
            h = _mixed(rotated(h, 23) * two + three)
    return h.view(np.int64)


class Block:
    """What one task has of a block: its rows by kind."""

    def __init__(self, number: int, table: pa.Table):
        self.number, self.found = number, {}
        data = (None if x is None else x.as_buffer() for x in table.column("data"))
        for kind, other, value, buffer in sorted(zip(table.column("kind").to_pylist(), table.column("other").to_pylist(), table.column("value").to_pylist(), data), key=lambda r: (r[0], r[1])):
            self.found.setdefault(kind, []).append((other, value, buffer))

    def many(self, kind: str) -> list[tuple]:
        """(other, value, bytes) of the rows of a kind, by other."""
        return self.found.get(kind, [])

    def one(self, kind: str, dtype) -> np.ndarray:
        return np.frombuffer(self.found[kind][0][2], dtype)

    def value(self, kind: str) -> float:
        return self.found[kind][0][1]

    def row(self, kind: str, data: np.ndarray | bytes = b"", other: int = 0, value: float = 0.0, to: int | None = None) -> tuple:
        """A row of this block, or to another."""
        return (self.number if to is None else to, kind, other, data.tobytes() if isinstance(data, np.ndarray) else data, float(value))


def _table(rows: Iterable[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * 5
    kinds = (pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.float64())
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["block", "kind", "other", "data", "value"])


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the runs of values that begin at starts."""
    return np.add.reduceat(values, starts) if len(starts) else np.zeros(0)


def runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)


def merged(key: np.ndarray, other: np.ndarray, weight: np.ndarray | None, once: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links by key and other; weights of repeated ones add up (1 each, if there is no weight), or with once they weigh 1."""
    low, span = int(other.min()), int(other.max()) - int(other.min()) + 1
    if (int(key.max()) - int(key.min()) + 1) * span < 2**62:  # both in one long, which sorts faster
        both, start = (key - key.min()) * span + (other - low), int(key.min())
        order = None if weight is None or once else np.argsort(both, kind="stable")
        both = np.sort(both) if order is None else both[order]
        first = runs(both)
        key, other = np.divmod(both[first], span)
        key, other, n = key + start, other + low, len(both)
    else:
        order = np.lexsort((other, key))
        key, other, n = key[order], other[order], len(key)
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (other[1:] != other[:-1])])
        key, other = key[first], other[first]
    if once:
        return key, other, np.ones(len(key))
    return key, other, np.diff(np.r_[first, n]).astype(np.float64) if weight is None else np.add.reduceat(weight[order], first)


def packed(batches: Iterator[pa.RecordBatch], once: bool) -> Iterator[pa.RecordBatch]:
    """A range of nodes (key, other, perhaps weight) with all its links as one block."""
    parts = [tuple(c.to_numpy() for c in b.columns) for b in batches if b.num_rows]
    if not parts:
        return
    columns = [np.concatenate(x) for x in zip(*parts)]
    del parts
    key, other, weight = merged(*columns[:2], columns[2] if len(columns) > 2 else None, once)
    del columns
    begins = runs(key)
    ghosts, links = np.unique(other, return_inverse=True)
    loops = np.where(key == other, weight, 0.0)
    block = Block(TaskContext.get().partitionId(), _table([]))
    rows = [
        block.row("start", key[:1]),
        block.row("keys", key[begins]),
        block.row("begins", np.r_[begins, len(key)].astype(np.int64)),
        block.row("key weights", np.add.reduceat(weight, begins)),
        block.row("key loops", np.add.reduceat(loops, begins)),
        block.row("links", links.astype(np.int32), value=len(ghosts)),
        block.row("ghosts", ghosts),
        block.row("ghost links", np.bincount(links, minlength=len(ghosts)).astype(np.float64)),
        block.row("sum", np.array([weight.sum(), weight.min()])),
    ]
    if (weight != 1).any():
        rows.append(block.row("weights", weight))
    yield from _table(rows).to_batches()


def integral(edges: DataFrame) -> bool:
    return all(isinstance(edges.schema[c].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)) for c in ("src", "dst"))


class Numbered:
    """Edges whose ids are longs: they stay as they are, or get numbers in the order of the ids."""

    def __init__(self, rounds: Rounds, edges: DataFrame):
        self.kind, self.names = edges.schema["src"].dataType, None
        if integral(edges):
            self.edges = edges.withColumns({c: F.col(c).cast("long") for c in ("src", "dst")})
            return
        edges = rounds.keep("unnumbered", edges)
        ids = edges.select(F.col("src").alias("name")).union(edges.select("dst")).distinct()
        ordered = ids.repartitionByRange(max(1, rounds.spark.sparkContext.defaultParallelism), "name").sortWithinPartitions("name")
        self.names = rounds.keep("names", ordered.select("name", F.monotonically_increasing_id().alias("number")))
        for end in ("src", "dst"):
            edges = edges.join(self.names.select(F.col("name").alias(end), F.col("number").alias(f"{end}_n")), end)
        self.edges = edges.drop("src", "dst").withColumnsRenamed({"src_n": "src", "dst_n": "dst"})

    def named(self, rows: DataFrame, *columns: str) -> DataFrame:
        """rows with their ids again instead of numbers."""
        if self.names is None:
            return rows.withColumns({c: F.col(c).cast(self.kind) for c in columns})
        order = rows.columns
        for c in columns:
            rows = rows.withColumnRenamed(c, "number").join(self.names, "number").drop("number").withColumnRenamed("name", c)
        return rows.select(*order)


class Blocks:
    """A graph of links (key, other, perhaps weight) between longs: each block has a range of nodes and the links of which they are the key.

    Ids near one another lie in one block, so that where neighbours have near ids few values leave it. A node's value goes
    once to each block that has a link to it; in links it is the place among the block's ghosts, the other ends of its links.
    """

    def __init__(self, rounds: Rounds, links: DataFrame, name: str, once: bool = False):
        """links must be a table that was kept: it is read twice. Weights of repeated links add up (1 each, if there are none), or with once they weigh 1."""
        self.rounds, self.name, self.spark = rounds, name, links.sparkSession
        n = links.count()
        most = max(-(-n // MOST_LINKS), min(-(-n // LEAST_LINKS), FEW_BLOCKS), 1)
        dealt = links.select("key", "other", *(["weight"] if "weight" in links.columns else [])).repartitionByRange(most, "key")
        arrays = rounds.keep(f"{name} arrays", dealt.mapInArrow(lambda batches: packed(batches, once), SCHEMA), by="kind")
        found = arrays.where("kind in ('start', 'sum')").orderBy("block").collect()
        self.starts = np.array([np.frombuffer(r.data, np.int64)[0] for r in found if r.kind == "start"], np.int64)
        self.blocks = np.array([r.block for r in found if r.kind == "start"], np.int32)
        totals = [np.frombuffer(r.data) for r in found if r.kind == "sum"]
        self.weight, self.least = float(sum(t[0] for t in totals)), min((float(t[1]) for t in totals), default=None)
        wants = arrays.where("kind in ('ghosts', 'ghost links')").groupBy("block").applyInArrow(self._task(self._wants), SCHEMA)
        keys = arrays.where("kind in ('keys', 'begins', 'key weights', 'key loops')").select(*wants.columns)
        self.nodes = rounds.keep(f"{name} nodes", self.apply(_owned, keys, wants), by="kind")
        self.arrays = arrays
        self.n = int(self.nodes.where("kind = 'ids'").agg(F.coalesce(F.sum("value"), F.lit(0.0))).first()[0])

    def owners(self, ids: np.ndarray) -> np.ndarray:
        """Which block each id belongs to, ascending where ids are."""
        return self.blocks[np.maximum(np.searchsorted(self.starts, ids, "right") - 1, 0)]

    def split(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """(owner, from, to) of the runs of ascending ids."""
        if not len(ids):
            return []
        owners = self.owners(ids)
        begins = runs(owners)
        return list(zip(owners[begins].tolist(), begins.tolist(), [*begins[1:].tolist(), len(ids)]))

    def plain(self) -> Blocks:
        """Itself for tasks, without Spark's objects."""
        plain = object.__new__(Blocks)
        plain.starts, plain.blocks = self.starts, self.blocks
        return plain

    @property
    def _wants(self):
        plain = self.plain()

        def step(b: Block):
            ghosts, links = b.one("ghosts", np.int64), b.one("ghost links", np.float64)
            for owner, lo, hi in plain.split(ghosts):
                yield b.row("want", ghosts[lo:hi].tobytes() + links[lo:hi].tobytes(), b.number, lo, owner)

        return step

    def _task(self, step: Callable) -> Callable:
        def task(key, table):
            return _table(step(Block(key[0].as_py(), table)))

        return task

    def apply(self, step: Callable[[Block], Iterable[tuple]], *tables: DataFrame) -> DataFrame:
        """The rows that step makes of each block's rows in the tables."""
        columns = ["block", "kind", "other", "data", "value"]
        rows = reduce(DataFrame.unionByName, [t.select(*columns) for t in tables])
        return rows.groupBy("block").applyInArrow(self._task(step), SCHEMA)

    def rows(self, step: Callable[[Block], dict], schema: str, *tables: DataFrame) -> DataFrame:
        """Rows of the named columns that step gives as arrays for each block."""
        table = reduce(DataFrame.unionByName, [t.select("block", "kind", "other", "data", "value") for t in tables])
        return table.groupBy("block").applyInArrow(lambda key, rows: pa.table(step(Block(key[0].as_py(), rows))), schema)

    def node_arrays(self, *kinds: str) -> DataFrame:
        return self.nodes.where(F.col("kind").isin(*kinds))

    def link_arrays(self, *kinds: str) -> DataFrame:
        return self.arrays.where(F.col("kind").isin(*kinds))

    def release(self) -> None:
        self.rounds.release(f"{self.name} ")


def _owned(b: Block):
    """A block's nodes: the keys of its links, and what other blocks want of its range; and which of them go where."""
    keys, begins = b.one("keys", np.int64), b.one("begins", np.int64)
    wants = [(to, lo, np.frombuffer(x, np.int64, len(x) // 16), np.frombuffer(x, np.float64, len(x) // 16, len(x) // 2)) for to, lo, x in b.many("want")]
    ids = np.unique(np.concatenate([keys, *[w[2] for w in wants]]))
    at = np.searchsorted(ids, keys)
    number, weight, loop, degree = np.zeros(len(ids), np.int64), np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids))
    number[at], weight[at], loop[at] = np.diff(begins), b.one("key weights", np.float64), b.one("key loops", np.float64)
    for to, lo, wanted, links in wants:
        here = np.searchsorted(ids, wanted)
        degree[here] += links
        yield b.row("need", here.astype(np.int32), to, lo)
    yield b.row("ids", ids, value=len(ids))
    yield b.row("begins", np.r_[0, np.cumsum(number)])
    yield b.row("weight", weight)
    yield b.row("loop", loop)
    yield b.row("degree", degree)


def sent(b: Block, kind: str, *values: np.ndarray) -> Iterator[tuple]:
    """Values of a block's nodes to all blocks that need them."""
    for to, lo, need in b.many("need"):
        at = np.frombuffer(need, np.int32)
        yield b.row(kind, b"".join(v[at].tobytes() for v in values), b.number, lo, to)


def received(b: Block, kind: str, *dtypes) -> list[np.ndarray]:
    """The values of a block's ghosts, as sent."""
    n, each = int(b.value("links")), sum(np.dtype(t).itemsize for t in dtypes)
    out = [np.zeros(n, t) for t in dtypes]
    for _, lo, data in b.many(kind):
        size, at, lo = len(data) // each, 0, int(lo)
        for values in out:
            values[lo : lo + size] = np.frombuffer(data, values.dtype, size, at)
            at += size * values.itemsize
    return out
