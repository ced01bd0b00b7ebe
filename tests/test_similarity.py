"""Similar nodes by ranges against all pairs."""

import itertools
import random

import pytest

from plexgraph.operators import analytics as A


@pytest.mark.parametrize("undirected", [False, True])
def test_pairs_equal_all_pairs_and_none_is_shuffled(spark, monkeypatch, undirected):
    monkeypatch.setattr(A, "RANGE_EDGES", 30, raising=False)
    dice = random.Random(7)
    edges = {(dice.randrange(25), dice.randrange(18)) for _ in range(160)}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        if undirected:
            near.setdefault(b, set()).add(a)
    expected = {}
    for a, b in itertools.combinations(sorted(near), 2):
        both, d = len(near[a] & near[b]), (len(near[a]), len(near[b]))
        if both and round(both / (sum(d) - both), 4) >= 0.1:
            expected[a, b] = (both, round(both / (sum(d) - both), 4), round(both / (d[0] * d[1]) ** 0.5, 4))
    rows = A.similarity(spark.createDataFrame([*edges, *list(edges)[:9], (None, 1), (1, None)], "src long, dst long"), 0.1, undirected)
    assert {(r.a, r.b): (r.shared, r.jaccard, r.cosine) for r in rows.collect()} == expected
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1  # the lists alone
    assert A.similarity(rows.where("false").selectExpr("a as src", "b as dst")).count() == 0
