"""Exact quantiles and sketches against sorted lists and sets."""

import random

import pytest
from pyspark.sql import functions as F

from plexgraph.operators import quantiles as Q


@pytest.mark.parametrize("few", [5, 10_000])
def test_quantiles_are_exact(spark, monkeypatch, few):
    monkeypatch.setattr(Q, "FEW", few)
    dice = random.Random(2)
    for values in ([dice.gauss(0, 1) for _ in range(700)], [float(dice.randrange(4)) for _ in range(500)], [1.0] * 40, [3.0]):
        df = spark.createDataFrame([(v,) for v in [*values, None]], "x double")
        for p in (0.0, 0.3, 0.5, 0.9, 1.0):
            assert Q.quantile(df, "x", p) == sorted(values)[max(-int(-(p * len(values)) // 1), 1) - 1]
    assert Q.quantile(spark.createDataFrame([(None,)], "x double"), "x", 0.5) is None


def test_sketches_of_parts_merge_to_those_of_the_whole(spark):
    rows = spark.range(30000).select((F.col("id") % 3).alias("day"), (F.col("id") % 5000).alias("user"), (F.col("id") / 7).alias("value"), F.when(F.col("id") % 10 > 0, F.concat(F.lit("u"), F.col("id") % 700)).alias("name"))
    kept = Q.sketches(rows.where("day < 2"), ["day"]).unionByName(Q.sketches(rows.where("day = 2"), ["day"]))  # the last day comes later
    found = {r["column"]: r for r in Q.estimates(Q.merged(kept)).collect()}
    exact = {"user": 5000, "value": 30000, "name": 630}
    for name, n in exact.items():
        assert found[name]["n"] == 30000 and abs(found[name]["n_distinct"] - n) <= 3 * Q.DISTINCT_ERROR * n
    assert found["name"]["n_null"] == 3000 and found["name"]["quantiles"] is None and found["name"]["low"] == "u1"
    assert (found["user"]["low"], found["user"]["high"]) == ("0", "4999")
    for share, value in zip((0.25, 0.5, 0.75), found["value"]["quantiles"], strict=True):
        assert abs(value * 7 / 30000 - share) <= Q.RANK_ERROR + 1e-4
    assert Q.merged(kept, ["day"]).count() == 9
    empty = Q.estimates(Q.sketches(rows.where("false"))).collect()
    assert all(r["n"] == 0 and r["n_distinct"] == 0 and r["quantiles"] is None for r in empty)
