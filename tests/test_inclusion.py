"""Inclusion dependencies against sets in Python."""

import datetime
import itertools

from plexgraph.sources import inclusion


def test_pairs_equal_sets(spark):
    day = datetime.date(2024, 1, 2)
    data = {
        "users": ([(1, "ann", day), (2, "bob", None), (3, None, day)], "id long, name string, born date"),
        "orders": ([(10, 1, "bob", 1.0), (11, 1, "ann", 2.0), (12, None, "bob", 1.0), (13, 3, "x" * 200, 1.0)], "id int, user_id int, who string, price double"),
        "categories": ([("x" * 200,), ("bob",), ("ann",)], "name string"),
        "empty": ([], "id long, category_id long"),
    }
    tables = {t: spark.createDataFrame(rows, schema) for t, (rows, schema) in data.items()}
    kind = {"id": "n", "user_id": "n", "category_id": "n", "name": "s", "who": "s", "born": "t"}
    sets = {(t, name): {r[k] for r in rows} - {None} for t, (rows, schema) in data.items() for k, name in enumerate(x.split()[0] for x in schema.split(", ")) if name in kind}
    want = {(*a, *b, len(sets[a]), len(sets[b])) for a, b in itertools.permutations(sets, 2) if kind[a[1]] == kind[b[1]] and sets[a] and sets[a] <= sets[b]}
    rows = inclusion.inclusions(tables).collect()
    assert {(r.table, r.column, r.in_table, r.in_column, r.n_values, r.in_values) for r in rows} == want
    assert {(r.in_table, r.in_column): r.in_is_key for r in rows} == {("users", "id"): True, ("categories", "name"): True, ("orders", "who"): False}
    keys = [tuple(r)[:4] for r in inclusion.foreign_keys(inclusion.inclusions(tables)).collect()]
    assert keys == [("orders", "user_id", "users", "id")]
    part = {(r.table, r.column, r.in_table, r.in_column): r.share for r in inclusion.inclusions(tables, least=0.5).collect()}
    assert part["categories", "name", "users", "name"] == 2 / 3


def test_more_columns_than_a_mask_has_bits(spark):
    names = [f"c{k}" for k in range(130)]
    df = spark.createDataFrame([tuple(range(130)), tuple(range(1, 131))], ", ".join(f"{n} int" for n in names))
    found = {(r.column, r.in_column) for r in inclusion.inclusions({"t": df, "one": df.select("c128").limit(1)}).where("in_table = 't' and table = 'one'").collect()}
    assert found in ({("c128", "c128"), ("c128", "c127")}, {("c128", "c128"), ("c128", "c129")})  # the row with 128 or with 129
