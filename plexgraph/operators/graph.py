"""A property graph over DataFrames, and pattern operators that join its views.

A binding table has one struct column for each variable. Expansions are
equi-joins on ids; Catalyst chooses their order and kind.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexgraph.operators.rounds import Rounds


@dataclass(frozen=True)
class EdgeView:
    """Rows (eid, src, dst, properties) between nodes of two labels."""

    rows: DataFrame
    source: str
    target: str


@dataclass(frozen=True)
class PropertyGraph:
    nodes_by_label: dict[str, DataFrame] = field(default_factory=dict)
    edges_by_type: dict[str, EdgeView] = field(default_factory=dict)

    def with_nodes(self, label: str, rows: DataFrame, key: str) -> PropertyGraph:
        """A graph with a node table, whose key becomes the column id."""
        view = rows.select(F.col(key).cast("long").alias("id"), *[c for c in rows.columns if c != key])
        return replace(self, nodes_by_label=self.nodes_by_label | {label: view})

    def with_edges(self, kind: str, rows: DataFrame, source: str, target: str, src: Column, dst: Column, eid: Column, *properties) -> PropertyGraph:
        view = rows.select(eid.alias("eid"), src.cast("long").alias("src"), dst.cast("long").alias("dst"), *properties)
        return replace(self, edges_by_type=self.edges_by_type | {kind: EdgeView(view, source, target)})

    def nodes(self, label: str) -> DataFrame:
        if label not in self.nodes_by_label:
            raise ValueError(f"no node label {label}; there are {sorted(self.nodes_by_label)}")
        return self.nodes_by_label[label]

    def edges(self, *kinds: str) -> DataFrame:
        """The edges of some types, or of all, as (kind, eid, src, dst)."""
        unknown = set(kinds) - set(self.edges_by_type)
        if unknown:
            raise ValueError(f"no edge types {sorted(unknown)}; there are {sorted(self.edges_by_type)}")
        parts = [self.edges_by_type[k].rows.select(F.lit(k).alias("kind"), F.col("eid").cast("string").alias("eid"), "src", "dst") for k in kinds or self.edges_by_type]
        return reduce(DataFrame.unionByName, parts)

    def all_nodes(self) -> DataFrame:
        """(label, id, properties as JSON) of every node."""
        parts = [df.select(F.lit(label).alias("label"), "id", F.to_json(F.struct("*")).alias("properties")) for label, df in self.nodes_by_label.items()]
        return reduce(DataFrame.unionByName, parts)

    def secured(self, column: str, value) -> PropertyGraph:
        """Only nodes of one tenant, where they have the column, and edges whose ends are left."""
        nodes = {label: df.where(F.col(column) == value) if column in df.columns else df for label, df in self.nodes_by_label.items()}
        edges = {}
        for kind, view in self.edges_by_type.items():
            rows = view.rows
            for end, label in (("src", view.source), ("dst", view.target)):
                if column in self.nodes_by_label[label].columns:
                    rows = rows.join(nodes[label].select(F.col("id").alias(end)), end, "left_semi")
            edges[kind] = replace(view, rows=rows.select(view.rows.columns))
        return PropertyGraph(nodes, edges)

    def scan(self, variable: str, label: str, **equal) -> DataFrame:
        """Bindings of one node pattern with equal properties."""
        rows = self.nodes(label)
        for name, value in equal.items():
            rows = rows.where(F.col(name) == value)
        return rows.select(F.struct("*").alias(variable))

    def _steps(self, kind: str, direction: str) -> DataFrame:
        """(from, to, edge) along the direction; with `both`, a self-loop is one step."""
        rows = self.edges_by_type[kind].rows
        out = rows.select(F.col("src").alias("from"), F.col("dst").alias("to"), F.struct("*").alias("edge"))
        back = rows.select(F.col("dst").alias("from"), F.col("src").alias("to"), F.struct("*").alias("edge"))
        if direction == "both":
            return out.unionByName(back.where(F.col("from") != F.col("to")))
        return out if direction == "out" else back

    def _oriented(self, kind: str, direction: str, label: str | None) -> str:
        """The direction of a step; an undirected one between two labels goes the way that the end's label says."""
        if kind not in self.edges_by_type:
            raise ValueError(f"no edge type {kind}; there are {sorted(self.edges_by_type)}")
        view = self.edges_by_type[kind]
        if direction != "both" or view.source == view.target:
            return direction
        if label not in (view.source, view.target):
            raise ValueError(f"an undirected {kind} needs the label of its end, {view.source} or {view.target}")
        return "out" if label == view.target else "in"

    def expand(self, bindings: DataFrame, start: str, kind: str, end: str, label: str | None = None, direction: str = "out", edge: str | None = None, where: Column | None = None, optional: bool = False, bare: bool = False) -> DataFrame:
        """Bindings with a step from `start`; a bound `end` closes a cycle. With optional, `where` belongs to the join.

        With bare, `end` has its id alone and no node table is read: for edges whose ends are known to exist.
        """
        direction = self._oriented(kind, direction, label) if end not in bindings.columns else direction
        steps = self._steps(kind, direction)
        view = self.edges_by_type[kind]
        if end in bindings.columns:
            joined = bindings.join(steps, (F.col(f"{start}.id") == F.col("from")) & (F.col(f"{end}.id") == F.col("to")))
            return joined.select(*bindings.columns, *([F.col("edge").alias(edge)] if edge else []))
        label = label or (view.target if direction == "out" else view.source)
        far = steps.withColumn(end, F.struct(F.col("to").alias("id"))) if bare else steps.join(self.scan(end, label), F.col("to") == F.col(f"{end}.id"))
        if edge:
            far = far.withColumnRenamed("edge", edge)
        on = F.col(f"{start}.id") == F.col("from")
        if where is not None and optional:
            on = on & where
        joined = bindings.join(far, on, "left" if optional else "inner")
        if where is not None and not optional:
            joined = joined.where(where)
        return joined.select(*bindings.columns, end, *([edge] if edge else []))

    def exists(self, bindings: DataFrame, start: str, kind: str, label: str | None = None, direction: str = "out", where: Column | None = None, negate: bool = False) -> DataFrame:
        """Bindings for which a step to a node `x` exists, or doesn't."""
        direction = self._oriented(kind, direction, label)
        steps = self.expand(self.scan("s", self.edges_by_type[kind].target if direction == "in" else self.edges_by_type[kind].source), "s", kind, "x", label, direction, edge="r", where=where)
        found = steps.select(F.col("s.id").alias("found")).distinct()
        return bindings.join(found, F.col(f"{start}.id") == F.col("found"), "left_anti" if negate else "left_semi")

    def trails(self, kinds: str | tuple[str, ...], start: DataFrame, least: int = 1, most: int | None = 3, direction: str = "out") -> DataFrame:
        """(start, end, hops, edges) of the paths of least..most edges without a repeated edge, from start ids (id); without most, of any length."""
        kinds = (kinds,) if isinstance(kinds, str) else kinds
        named = lambda kind: F.concat_ws(":", F.lit(kind), "edge.eid") if len(kinds) > 1 else F.col("edge.eid").cast("string")
        steps = reduce(DataFrame.unionByName, [self._steps(kind, direction).select("from", "to", named(kind).alias("eid")) for kind in kinds])
        level = start.select(F.col("id").alias("start"), F.col("id").alias("end"), F.array().cast("array<string>").alias("edges"))
        found = [level.select("start", "end", F.lit(0).alias("hops"), "edges")] if least == 0 else []
        hops, rounds = 0, Rounds(steps)
        while most is None or hops < most:
            hops += 1
            level = level.join(steps, F.col("end") == F.col("from")).where(~F.array_contains("edges", F.col("eid")))
            level = level.select("start", F.col("to").alias("end"), F.array_append("edges", F.col("eid")).alias("edges"))
            if most is None:
                level = rounds.keep(f"level {hops}", level)
                if not level.limit(1).count():
                    break
            if hops >= least:
                found.append(level.select("start", "end", F.lit(hops).alias("hops"), "edges"))
        return reduce(DataFrame.unionByName, found) if found else level.select("start", "end", F.lit(0).alias("hops"), "edges").where("false")

    def all_paths(self, kinds: str | tuple[str, ...], start: DataFrame, end: DataFrame, most: int | None = None, direction: str = "out") -> DataFrame:
        """The trails from start ids to end ids (id)."""
        return self.trails(kinds, start, 1, most, direction).join(end.select(F.col("id").alias("end")).distinct(), "end", "left_semi").select("start", "end", "hops", "edges")

    def shortest(self, kinds: tuple[str, ...], start: DataFrame, end: DataFrame | None = None, most: int | None = None, both: bool = False, every: bool = False) -> DataFrame:
        """(start, end, hops, path) from start ids to end ids (id), or to all: one shortest path of least node order, or all of them.

        The search ends when every pair of start and end is found, nothing new is reached, or after `most` steps. What is
        reached is appended to one table, whose pairs the next step is held against. A node is there at once from itself, so
        a way around a cycle back to it is no path, and a start that is an end too has no row of its own.
        """
        edges = self.edges(*kinds).select("src", "dst")
        if both:
            edges = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        rounds = Rounds(edges)
        edges = rounds.keep("edges", edges.distinct())
        first = start.select(F.col("id").alias("start"), F.col("id").alias("end"), F.lit(0).alias("hops"), F.array("id").alias("path")).distinct()
        frontier, hops, schema = rounds.append("reached", first), 0, first.schema
        wanted = None if end is None else rounds.keep("wanted", end.select(F.col("id").alias("end")).distinct())
        n_wanted = None if wanted is None else wanted.count()
        while most is None or hops < most:
            hops += 1
            seen = rounds.appended("reached", schema).select("start", "end")
            step = frontier.join(edges, F.col("end") == F.col("src")).select("start", F.col("dst").alias("end"), F.lit(hops).alias("hops"), F.array_append("path", F.col("dst")).alias("path"))
            step = step.join(seen, ["start", "end"], "left_anti")
            step = step.distinct() if every else step.groupBy("start", "end").agg(F.min("hops").alias("hops"), F.min("path").alias("path"))
            frontier = rounds.append("reached", step.select("start", "end", "hops", "path"))
            if not frontier.limit(1).count():
                break
            if wanted is not None:  # a start that has all its ends goes no further
                found = rounds.appended("reached", schema).join(wanted, "end", "left_semi").groupBy("start").agg(F.count_distinct("end").alias("n")).where(F.col("n") == n_wanted)
                frontier = frontier.join(found, "start", "left_anti")
                if not frontier.limit(1).count():
                    break
        rows = rounds.appended("reached", schema).where("hops > 0")
        return rows if wanted is None else rows.join(wanted, "end", "left_semi").select("start", "end", "hops", "path")

    def scope(self, labels: tuple[str, ...] = (), kinds: tuple[str, ...] = (), where: dict[str, Column] | None = None) -> DataFrame:
        """(kind, eid, src, dst) of an analysis: edges of some types whose ends have some labels and conditions by label."""
        parts = []
        for kind in kinds or self.edges_by_type:
            view = self.edges_by_type[kind]
            if labels and not {view.source, view.target} <= set(labels):
                continue
            rows = self.edges(kind)
            for end, label in (("src", view.source), ("dst", view.target)):
                if where and label in where:
                    rows = rows.join(self.nodes(label).where(where[label]).select(F.col("id").alias(end)), end, "left_semi")
            parts.append(rows.select("kind", "eid", "src", "dst"))
        if not parts:
            raise ValueError("no edge type is in the scope")
        return reduce(DataFrame.unionByName, parts)

    def search(self, text: str, labels: tuple[str, ...] = (), limit: int = 100) -> DataFrame:
        """(label, id) of nodes with the text in any property."""
        parts = []
        for label in labels or self.nodes_by_label:
            rows = self.nodes(label)
            hit = reduce(lambda a, b: a | b, [F.coalesce(F.col(c).cast("string").contains(text), F.lit(False)) for c in rows.columns])
            parts.append(rows.where(hit if text != "*" else F.lit(True)).select(F.lit(label).alias("label"), "id"))
        return reduce(DataFrame.unionByName, parts).orderBy("label", "id").limit(limit)

    def neighbours(self, label: str, node: int, limit: int = 200) -> DataFrame:
        """(kind, direction, id) of the nodes one step away."""
        parts = []
        for kind, view in self.edges_by_type.items():
            for here, there, direction, own in (("src", "dst", "outgoing", view.source), ("dst", "src", "incoming", view.target)):
                if own == label:
                    parts.append(view.rows.where(F.col(here) == node).select(F.lit(kind).alias("kind"), F.lit(direction).alias("direction"), F.col(there).alias("id")))
        if not parts:
            return self.nodes(label).where("false").select(F.lit("").alias("kind"), F.lit("").alias("direction"), "id")
        return reduce(DataFrame.unionByName, parts).distinct().orderBy("kind", "direction", "id").limit(limit)

    def label_counts(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(label).alias("label"), "n") for label, df in self.nodes_by_label.items()])

    def relationship_patterns(self, limit: int = 50) -> DataFrame:
        parts = [v.rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(v.source).alias("source"), F.lit(k).alias("kind"), F.lit(v.target).alias("target"), "n") for k, v in self.edges_by_type.items()]
        return reduce(DataFrame.unionByName, parts).orderBy(F.desc("n"), "kind").limit(limit)

    def totals(self) -> DataFrame:
        """One row: nodes and edges of the graph."""
        count = lambda tables: reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")) for df in tables]).agg(F.sum("n").alias("n"))
        edges = count([v.rows for v in self.edges_by_type.values()])
        return count(self.nodes_by_label.values()).select(F.col("n").alias("nodes")).crossJoin(edges.select(F.col("n").alias("edges")))  # one row each

    def properties(self, label: str) -> DataFrame:
        """(property, type, mandatory) of a label: a property is mandatory if no node lacks it."""
        rows = self.nodes(label)
        parts = [F.struct(F.lit(n).alias("property"), F.lit(t).alias("type"), (F.count(F.col(n)) == F.count(F.lit(1))).alias("mandatory")) for n, t in rows.dtypes]
        return rows.agg(F.array(*parts).alias("p")).select(F.inline("p"))


def hop_range(least: int | None, most: int | None) -> tuple[int, int | None] | None:
    """A normal range of hops, without an end if most is None, or None for a single step.

    Bounds over ten count as absent, and swapped ones are put in order; without a lower bound one hop is the least.
    """
    least, most = (None if x is not None and x > 10 else x for x in (least, most))
    if least is not None and most is not None and least > most:
        least, most = most, least
    if (least, most) in ((0, 0), (1, 1), (None, None), (0, None)):
        return None
    return least if least is not None else 1, most
