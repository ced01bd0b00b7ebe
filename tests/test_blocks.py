"""Rounds over graphs in many small blocks against plain sums and votes."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plexgraph.operators import analytics as A
from plexgraph.operators import blocks
from plexgraph.operators import communities as C
from plexgraph.operators.rounds import Rounds


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "LEAST_LINKS", 40)
    monkeypatch.setattr(blocks, "MOST_LINKS", 40)


def random_edges(seed, n=70, m=260):
    dice = random.Random(seed)
    return [(dice.randrange(n) - 20, dice.randrange(n) - 20) for _ in range(m)]


def plain_labels(spark, edges, rounds=20):
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    odd = {r.id: r.odd for r in spark.createDataFrame([(n,) for n in near], "id long").select("id", F.pmod(F.xxhash64("id"), F.lit(2)).alias("odd")).collect()}
    label, still = {n: n for n in near}, 0
    for k in range(2 * rounds):
        votes = {n: Counter(label[m] for m in near[n]) for n in near}
        new = {n: max(votes[n], key=lambda c: (votes[n][c], c == label[n], -c)) if odd[n] == k % 2 else label[n] for n in near}
        label, still = new, still + 1 if new == label else 0
        if still == 2:
            break
    return label


@pytest.mark.parametrize("seed", [1, 2])
def test_labels_equal_plain_votes(spark, small_blocks, seed):
    edges = random_edges(seed) + [(500, 501), (501, 500), (502, 502)]
    df = spark.createDataFrame([*edges, (None, 3)], "src long, dst long")
    assert {r.id: r.community for r in A.label_propagation(df).collect()} == plain_labels(spark, edges)
    assert A.label_propagation(df.where("false")).count() == 0


def test_rounds_write_values_of_blocks_and_not_of_links(spark, small_blocks, monkeypatch):
    kept, keep = Counter(), Rounds.keep

    def counted(self, name, df, by=None):
        out = keep(self, name, df, by)
        kept[name] = max(kept[name], out.count())
        return out

    monkeypatch.setattr(Rounds, "keep", counted)
    edges = [(a, b) for a in range(60) for b in range(a)]  # 3,540 links both ways
    rows = A.label_propagation(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert len(rows) == 60 and len({r.community for r in rows}) == 1
    assert kept["labels"] < 60 * 60  # rows of blocks and of the arrays between them


def test_names_that_are_no_longs(spark, small_blocks):
    edges = random_edges(3)
    name = {n: f"n{n + 100:04}" for e in edges for n in e}  # in the order of the numbers
    rows = A.label_propagation(spark.createDataFrame([(name[a], name[b]) for a, b in edges], "src string, dst string")).collect()
    assert {r.id for r in rows} == {name[n] for e in edges if e[0] != e[1] for n in e} >= {r.community for r in rows}
    ranks = A.pagerank(spark.createDataFrame([(name[a], name[b]) for a, b in edges], "src string, dst string")).collect()
    assert {r.id: r.score for r in ranks} == pytest.approx({name[n]: x for n, x in plain_ranks(edges).items()})


def plain_ranks(edges, rounds=30, damping=0.85):
    edges = set(edges)
    nodes, out = {n for e in edges for n in e}, Counter(a for a, _ in edges)
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(rounds):
        got = Counter()
        for a, b in edges:
            got[b] += rank[a] / out[a]
        rank = {n: (1 - damping) / len(nodes) + damping * got[n] for n in nodes}
    return rank


@pytest.mark.parametrize("rounds", [1, 30])
def test_ranks_equal_plain_sums(spark, small_blocks, rounds):
    edges = random_edges(4) + [(900, 1), (1, 901), (902, 902)]  # one with links out alone, one with links in alone
    df = spark.createDataFrame(edges + edges[:50], "src long, dst long")
    assert {r.id: r.score for r in A.pagerank(df, rounds=rounds).collect()} == pytest.approx(plain_ranks(edges, rounds))
    assert A.pagerank(df.where("false")).count() == 0


def test_hashes_are_those_of_spark(spark):
    import numpy as np

    ids = [0, 1, -1, 2**40 + 7, -(2**63), 2**63 - 1]
    rows = spark.createDataFrame([(i,) for i in ids], "id long").select(F.xxhash64("id").alias("a"), F.xxhash64("id", F.lit(11)).alias("b")).collect()
    assert blocks.xxhash64(np.array(ids)).tolist() == [r.a for r in rows]
    assert blocks.xxhash64(np.array(ids), 11).tolist() == [r.b for r in rows]


def test_louvain_is_the_same_in_many_blocks_and_names_moves_as_sums_do(spark, monkeypatch):
    edges = [(a, b, float(1 + (a * b) % 3)) for a, b in random_edges(5, 40, 120)]
    df = spark.createDataFrame([*edges, (None, 1, 1.0)], "src long, dst long, weight double")
    few = {r.id: (r.community, r.levels, round(r.modularity, 9)) for r in C.louvain(df, most_rounds=4, most_levels=3).collect()}
    monkeypatch.setattr(blocks, "LEAST_LINKS", 40)
    monkeypatch.setattr(blocks, "MOST_LINKS", 40)
    assert {r.id: (r.community, r.levels, round(r.modularity, 9)) for r in C.louvain(df, most_rounds=4, most_levels=3).collect()} == few
    # the first round's best moves, and the modularity of single nodes, beside the joins of best_moves
    links = C.adjacency(df)
    m2 = links.agg(F.sum("weight")).first()[0]
    loops = links.where("src = dst").select(F.col("src").alias("id"), F.col("weight").alias("loop"))
    labels = links.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("k")).join(loops, "id", "left").select("id", "k", F.col("id").alias("community"), F.coalesce("loop", F.lit(0.0)).alias("loop"))
    moves = C.best_moves(links, labels, m2).cache()
    rounds = Rounds(df)
    graph = blocks.Blocks(rounds, rounds.keep("links", links.select(F.col("src").alias("key"), F.col("dst").alias("other"), "weight")), "graph")
    assert len(graph.starts) > 2
    state, quality, gain, first = C._state(rounds, "moves", graph, C._spread(graph, None, None, 0, None), m2, 1.0)
    rows = graph.rows(lambda b: {"id": b.one("ids", "int64"), "best": b.one("best", "int64"), "gain": b.one("gain", "float64")}, "id long, best long, gain double", graph.node_arrays("ids"), state).collect()
    assert {r.id: r.best for r in rows} == {r.id: r.best for r in moves.collect()}
    assert {r.id: r.gain for r in rows} == pytest.approx({r.id: r.gain for r in moves.collect()})
    assert quality == pytest.approx(C._quality(moves, m2, 1.0)) and gain == max(r.gain for r in rows)


def test_louvain_with_repeats_once_and_names(spark):
    edges = [(a, b) for k in (0, 10) for a in range(k, k + 5) for b in range(k, a)] + [(0, 10)]
    df = spark.createDataFrame([(f"n{a:02}", f"n{b:02}") for a, b in edges + 30 * [(0, 10)]], "src string, dst string")
    rows = {r.id: r for r in C.louvain(df, once=True).collect()}
    assert {n: r.community for n, r in rows.items()} == {f"n{n:02}": "n00" if n < 10 else "n10" for n in (*range(5), *range(10, 15))}
    assert all(r.levels[-1] == r.community for r in rows.values())
