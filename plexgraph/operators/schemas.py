"""Rules over schemas and profiles: sources, constraints, ontology quality, differences and migrations.

A schema of a graph is a dict {"nodes": {label: {property: type}}, "edges": {kind:
(source, target)}, "descriptions": {label or kind: text}, "unique": {label: [property]}}.
"""

from __future__ import annotations

from functools import reduce
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Name parts of tables to leave out (fixed values).
AUDIT = (("audit_", "log_", "history_"), ("_audit", "_log", "_history", "_logs"))
TEMPORARY = (("tmp_", "temp_", "bak_"), ("_old", "_backup", "_bak", "_tmp", "_temp"))
#: Tables from which a source is large, and very large.
LARGE, VERY_LARGE = 50, 100


def schema_of(graph) -> dict:
    """The schema of a live graph."""
    return {
        "nodes": {label: {c: t for c, t in df.dtypes if c != "id"} for label, df in graph.nodes_by_label.items()},
        "edges": {kind: (v.source, v.target) for kind, v in graph.edges_by_type.items() if {v.source, v.target} <= graph.nodes_by_label.keys()},
    }


def described(rows: DataFrame) -> list[tuple[str, str, bool]]:
    """(name, type, nullable) of the columns of a table."""
    return [(f.name, f.dataType.simpleString(), f.nullable) for f in rows.schema.fields]


def exclusions(tables: dict[str, int]) -> list[tuple[str, str]]:
    """(table, audit, temporary or empty) of tables {name: rows} that are better left out."""
    found = []
    for name, rows in tables.items():
        low = name.lower()
        for reason, (heads, tails) in (("audit", AUDIT), ("temporary", TEMPORARY)):
            if low.startswith(heads) or low.endswith(tails):
                found.append((name, reason))
                break
        else:
            found += [(name, "empty")] if rows == 0 else []
    return found


def size_class(tables: int) -> str:
    return "very_large" if tables >= VERY_LARGE else "large" if tables >= LARGE else "normal"


def clusters(tables: list[str], references: list[tuple[str, str]], most: int = 10) -> list[list[str]]:
    """Groups of tables joined by references (from, to), each split breadth first into groups of at most `most`, in order of dependence."""
    near = {t: set() for t in tables}
    for a, b in references:
        near[a].add(b)
        near[b].add(a)
    groups, left = [], set(tables)
    while left:
        frontier, group = [min(left)], []
        while frontier:
            table = frontier.pop(0)
            if table in left:
                left.discard(table)
                group.append(table)
                frontier += sorted(near[table] & left)
        groups += [group[k : k + most] for k in range(0, len(group), most)]
    return [_levels(g, references) for g in groups]


def _levels(group: list[str], references: list[tuple[str, str]]) -> list[str]:
    needs = {t: {b for a, b in references if a == t and b in group and b != t} for t in group}
    try:
        return list(TopologicalSorter(needs).static_order())
    except CycleError:
        return sorted(group)


def reference_columns(columns: dict[str, list[str]]) -> list[tuple[str, str, str]]:
    """(table, column, table it refers to) of columns x_id or xId for a table x or xs."""
    found = []
    for table, names in columns.items():
        for name in names:
            stem = name[:-3] if name.endswith("_id") else name[:-2] if name.endswith("Id") else ""
            found += [(table, name, t) for t in columns if stem and t.lower() in (stem.lower(), stem.lower() + "s")][:1]
    return found


def merged_type(a: str | None, b: str | None) -> str | None:
    """The type of a field that has two: nulls give way, numbers become double, anything with json is json, other mixes string."""
    if a is None or b is None or a == b:
        return a or b
    if "json" in (a, b):
        return "json"
    return "double" if {a, b} <= {"int", "bigint", "long", "float", "double", "decimal"} else "string"


def merged_fields(documents: list[dict[str, str | None]]) -> dict[str, str | None]:
    """Field types of sampled documents, merged."""
    fields: dict[str, str | None] = {}
    for document in documents:
        for name, kind in document.items():
            fields[name] = merged_type(fields.get(name), kind)
    return fields


def violations(rows: DataFrame, unique: tuple[str, ...] = (), exists: tuple[str, ...] = (), key: tuple[str, ...] = ()) -> DataFrame:
    """(constraint, violations): repeated values of unique columns, missing values, and keys that are missing or repeated."""
    parts = []
    for c in exists:
        parts.append(rows.agg(F.count_if(F.col(c).isNull()).alias("violations")).select(F.lit(f"exists {c}").alias("constraint"), "violations"))
    for names, label in [((c,), f"unique {c}") for c in unique] + ([(key, f"key {', '.join(key)}")] if key else []):
        lacks = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in names])
        repeated = rows.where(~lacks).groupBy(*names).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("repeated"))
        missing = rows.agg((F.count_if(lacks) if names == key else F.lit(0).cast("long")).alias("missing"))
        parts.append(repeated.crossJoin(missing).select(F.lit(label).alias("constraint"), (F.col("repeated") + F.col("missing")).alias("violations")))  # one row each
    return reduce(DataFrame.unionByName, parts)


#: Names of columns that are looked up most (fixed values).
LOOKED_UP = ("id", "code", "name", "email")


def index_candidates(columns: list[tuple[str, str, bool]], covered: tuple[str, ...] = (), most: int = 20) -> list[str]:
    """Columns (name, type, nullable) worth clustering by: never null and not covered; by name first, then texts and whole numbers."""
    left = [c for c in columns if not c[2] and c[0] not in covered]
    rank = lambda c: 0 if c[0].lower() in LOOKED_UP else 1 if c[1] in ("string", "int", "bigint") else 2
    return [c[0] for c in sorted(left, key=rank)][:most]


def invalid(schema: dict) -> list[str]:
    """What is wrong with a schema: bad names, unknown ends of edges, unique properties that don't exist."""
    found = [f"bad name {n!r}" for n in [*schema["nodes"], *schema["edges"], *[p for ps in schema["nodes"].values() for p in ps]] if not str(n).isidentifier()]
    found += [f"{kind} has an unknown end {end}" for kind, ends in schema["edges"].items() for end in ends if end not in schema["nodes"]]
    return found + [f"{label} has no property {p}" for label, ps in schema.get("unique", {}).items() for p in ps if p not in schema["nodes"].get(label, {})]


def quality_of_data(profile: DataFrame, few: int = 5, sparse: float = 0.8) -> DataFrame:
    """(check, label, property) from profile rows (label, property, n, n_null, n_distinct, numeric, short)."""
    checks = {
        "small_sample": (F.col("n") < few) & (F.col("first")),
        "opaque_enum": F.col("short") & F.col("n_distinct").between(2, 20),
        "numeric_enum_code": F.col("numeric") & F.col("n_distinct").between(2, 20),
        "sparse_property": (F.col("n") > 10) & (F.col("n_null") > sparse * F.col("n")),
        "single_value_bias": (F.col("n") > 1) & (F.col("n_distinct") == 1),
    }
    parts = [profile.where(test).select(F.lit(name).alias("check"), "label", F.when(F.lit(name == "small_sample"), None).otherwise(F.col("property")).alias("property")) for name, test in checks.items()]
    return reduce(DataFrame.unionByName, parts)


def quality_of_schema(schema: dict, tables: dict[str, list[str]] | None = None, references: tuple = (), hub: int = 8, shared: int = 3) -> list[tuple[str, str]]:
    """(check, what) of the structure: tables, columns and references of the source that aren't mapped, and what looks wrong in the schema."""
    nodes, edges, told = schema["nodes"], schema["edges"], schema.get("descriptions", {})
    ends = [e for pair in edges.values() for e in set(pair)]
    found = [("missing_description", n) for n in [*nodes, *edges] if not told.get(n)]
    found += [("orphan_node", n) for n in nodes if n not in ends]
    found += [("hub_node", n) for n in nodes if ends.count(n) > hub]
    found += [("self_referential_edge", k) for k, (a, b) in edges.items() if a == b]
    pairs = list(edges.values())
    found += [("duplicate_edge", k) for i, (k, pair) in enumerate(edges.items()) if pair in pairs[:i]]
    names = sorted({p for ps in nodes.values() for p in ps})
    kinds = {p: {ps[p] for ps in nodes.values() if p in ps} for p in names}
    found += [("property_type_inconsistency", p) for p in names if len(kinds[p]) > 1]
    found += [("overloaded_property", p) for p in names if sum(p in ps for ps in nodes.values()) > shared]
    mapped = {n.lower() for n in nodes}
    for table, columns in (tables or {}).items():
        if table.lower() not in mapped:
            found.append(("unmapped_source_table", table))
        else:
            own = next(ps for n, ps in nodes.items() if n.lower() == table.lower())
            found += [("unmapped_source_column", f"{table}.{c}") for c in columns if c not in own and c != "id"]
    known = {(a.lower(), b.lower()) for a, b in pairs} | {(b.lower(), a.lower()) for a, b in pairs}
    found += [("missing_foreign_key_edge", f"{a} -> {b}") for a, b in references if {a.lower(), b.lower()} <= mapped and (a.lower(), b.lower()) not in known]
    return found


def difference(was: dict, now: dict) -> list[tuple[str, str]]:
    """(change, what) between two schemas: nodes, edges and properties added, removed or modified."""
    found = []
    for name in ("nodes", "edges"):
        found += [(f"{name[:-1]}_added", x) for x in sorted(now[name].keys() - was[name].keys())]
        found += [(f"{name[:-1]}_removed", x) for x in sorted(was[name].keys() - now[name].keys())]
    found += [("edge_modified", k) for k in sorted(was["edges"].keys() & now["edges"].keys()) if was["edges"][k] != now["edges"][k]]
    for label in sorted(was["nodes"].keys() & now["nodes"].keys()):
        a, b = was["nodes"][label], now["nodes"][label]
        found += [("property_added", f"{label}.{p}") for p in sorted(b.keys() - a.keys())] + [("property_removed", f"{label}.{p}") for p in sorted(a.keys() - b.keys())]
        found += [("property_modified", f"{label}.{p}") for p in sorted(a.keys() & b.keys()) if a[p] != b[p]]
    return found


#: Changes after which old queries fail.
BREAKING = ("node_removed", "edge_removed", "edge_modified", "property_removed", "property_modified")


def breaking_labels(changes: list[tuple[str, str]]) -> list[str]:
    """Labels and types that a breaking change touches."""
    return sorted({what.split(".")[0] for change, what in changes if change in BREAKING})


#: Changes of type that keep what can be kept.
CASTS = {("string", "bigint"), ("string", "int"), ("string", "double"), ("bigint", "string"), ("int", "string"), ("double", "string"), ("int", "double"), ("bigint", "double"), ("int", "bigint")}


def migration_plan(was: dict[str, str], now: dict[str, str], defaults: dict | None = None) -> tuple[list[tuple], list[str]]:
    """(steps, warnings) that bring a table from one schema to another: add with a default, cast and drop."""
    steps = [("add", c, now[c], (defaults or {}).get(c)) for c in now if c not in was]
    steps += [("cast", c, now[c], None) for c in now if c in was and was[c] != now[c] and (was[c], now[c]) in CASTS]
    warnings = [f"{c}: {was[c]} can't become {now[c]}" for c in now if c in was and was[c] != now[c] and (was[c], now[c]) not in CASTS]
    return steps + [("drop", c, was[c], None) for c in was if c not in now], warnings


def migrated(rows: DataFrame, steps: list[tuple], renamed: dict[str, str] | None = None) -> DataFrame:
    """A table after renames and the steps of a plan; what can't be cast becomes null."""
    for old, new in (renamed or {}).items():
        rows = rows.withColumnRenamed(old, new)
    for step, column, kind, default in steps:
        if step == "drop":
            rows = rows.drop(column)
        elif step == "cast":
            rows = rows.withColumn(column, F.col(column).try_cast(kind))
        else:
            present = F.coalesce(F.col(column), F.lit(default)) if column in rows.columns else F.lit(default)
            rows = rows.withColumn(column, present.cast(kind))
    return rows


def table_ddl(schema: dict) -> str:
    """CREATE TABLE statements, one a label and one a type of edge."""
    lines = [f"CREATE TABLE {label} (id BIGINT NOT NULL{''.join(f', {p} {t.upper()}' for p, t in ps.items())});" for label, ps in schema["nodes"].items()]
    return "\n".join(lines + [f"CREATE TABLE {kind} (src BIGINT NOT NULL, dst BIGINT NOT NULL);" for kind in schema["edges"]])


def mermaid(schema: dict) -> str:
    """An entity diagram."""
    lines = ["erDiagram"] + [f"    {a} }}o--o{{ {b} : {kind}" for kind, (a, b) in schema["edges"].items()]
    for label, ps in schema["nodes"].items():
        lines += [f"    {label} {{", *[f"        {t} {p}" for p, t in ps.items()], "    }"]
    return "\n".join(lines)


def report(tables: dict[str, DataFrame]) -> dict:
    """Totals of a source and the hints of all rules over names: one job that counts rows."""
    from plexgraph.operators.governance import implied_keys, pii_kinds

    counts = {name: df.count() for name, df in tables.items()}
    columns = {name: df.columns for name, df in tables.items()}
    return {
        "tables": len(tables), "columns": sum(map(len, columns.values())), "rows": sum(counts.values()), "size": size_class(len(tables)),
        "keys": implied_keys(columns), "exclusions": exclusions(counts), "personal": [(t, c, k) for t in tables for c, k in pii_kinds(columns[t])],
    }
