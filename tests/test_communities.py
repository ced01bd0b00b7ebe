"""Louvain's moves and levels against sums over all pairs of nodes."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from plexgraph.operators import analytics as A
from plexgraph.operators import communities as C
from plexgraph.plans.tables import co_bought


def plain_modularity(edges, label, resolution=1.0):
    weight, nodes = {}, set()
    for a, b, w in edges:
        weight[a, b] = weight.get((a, b), 0) + w
        weight[b, a] = weight.get((b, a), 0) + w
        nodes |= {a, b}
    m2 = sum(weight.values())
    k = {n: sum(w for (a, _), w in weight.items() if a == n) for n in nodes}
    return sum(weight.get((a, b), 0) / m2 - resolution * k[a] * k[b] / m2**2 for a in nodes for b in nodes if label[a] == label[b])


def cliques(sizes, bridges):
    edges, first = [], []
    n = 0
    for size in sizes:
        first.append(n)
        edges += [(a, b, 1.0) for a, b in itertools.combinations(range(n, n + size), 2)]
        n += size
    return edges + [(first[a], first[b] + 1, 1.0) for a, b in bridges]


def random_graph(seed, n=14, p=0.3):
    dice = random.Random(seed)
    return [(a, b, float(dice.randint(1, 4))) for a in range(n) for b in range(a, n) if dice.random() < p]


def frame(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long, weight double")


@pytest.mark.parametrize("seed", [1])
def test_gains_are_differences_of_modularity(spark, seed):
    edges, dice = random_graph(seed), random.Random(seed)
    links = C.adjacency(frame(spark, edges))
    degree = {r.src: r.k for r in links.groupBy("src").agg(F.sum("weight").alias("k")).collect()}
    loops = {r.src: r.weight for r in links.where("src = dst").collect()}
    label = {n: dice.randrange(5) for n in degree}
    labels = spark.createDataFrame([(n, degree[n], label[n], loops.get(n, 0.0)) for n in label], "id long, k double, community long, loop double")
    now = plain_modularity(edges, label)
    assert C.modularity(links, labels.select("id", "community")).first()[0] == pytest.approx(now)
    moves = C.best_moves(links, labels, sum(degree.values())).cache()
    assert C._quality(moves, sum(degree.values()), 1.0) == pytest.approx(now)
    size = {c: list(label.values()).count(c) for c in label.values()}
    for m in moves.collect():
        near = {label[m.id]} | {label[b] for a, b, _ in edges if a == m.id} | {label[a] for a, b, _ in edges if b == m.id}
        gains = {c: plain_modularity(edges, label | {m.id: c}) - now for c in near if c == label[m.id] or size[label[m.id]] > 1 or size[c] > 1 or c < label[m.id]}
        assert m.gain == pytest.approx(max(gains.values()), abs=1e-9)
        assert gains[m.best] == pytest.approx(m.gain, abs=1e-9)


def test_it_finds_cliques_and_a_level_above(spark):
    edges = cliques([6, 5, 7, 4], [(0, 1), (1, 2), (2, 3)])
    rows = C.louvain(frame(spark, edges)).collect()
    label = {r.id: r.community for r in rows}
    assert sorted(set(label.values())) == [0, 6, 11, 18] and all(label[n] == max(c for c in (0, 6, 11, 18) if c <= n) for n in label)
    assert rows[0].modularity == pytest.approx(plain_modularity(edges, label)) and all(r.levels[-1] == r.community for r in rows)
    # two dozen rings of cliques: on the coarse graph neighbouring cliques join
    edges = cliques([3] * 24, [(k, (k + 1) % 24) for k in range(24)])
    rows = C.louvain(frame(spark, edges)).collect()
    assert any(len(r.levels) > 1 for r in rows)
    levels = [plain_modularity(edges, {r.id: r.levels[k] for r in rows}) for k in range(len(rows[0].levels))]
    assert levels == sorted(levels) and levels[-1] == pytest.approx(rows[0].modularity)


@pytest.mark.parametrize("seed", [3])
def test_random_graphs_end_where_no_single_merge_gains(spark, seed):
    edges = random_graph(seed, 16, 0.2)
    rows = C.louvain(frame(spark, edges), tolerance=0.0, most_rounds=40, least_gain=1e-9).collect()
    label = {r.id: r.community for r in rows}
    reached = plain_modularity(edges, label)
    assert rows[0].modularity == pytest.approx(reached) and reached >= plain_modularity(edges, {n: n for n in label})
    for a, b in itertools.combinations(sorted(set(label.values())), 2):
        assert plain_modularity(edges, {n: a if c == b else c for n, c in label.items()}) <= reached + 1e-9


def test_odd_graphs(spark):
    assert C.louvain(frame(spark, [])).count() == 0
    assert [(r.id, r.community) for r in C.louvain(frame(spark, [(5, 5, 2.0)])).collect()] == [(5, 5)]
    rows = C.louvain(frame(spark, [(1, 2, 1.0), (1, 2, 1.0), (2, 1, None), (3, 4, 0.0), (None, 1, 1.0)])).collect()
    label = {r.id: r.community for r in rows}
    assert label[1] == label[2] == 1 and set(label) == {1, 2, 3, 4}
    with pytest.raises(ValueError, match="weights"):
        C.louvain(frame(spark, [(1, 2, -1.0)]))
    assert C.louvain(frame(spark, [(1, 2, 1.0)]).drop("weight")).first().community == 1


def test_co_purchases_have_no_less_modularity_than_by_label_propagation(spark):
    edges = co_bought(spark, "/root/testdata/sf0.001").cache()
    links = C.adjacency(edges)
    rows = C.louvain(edges).cache()
    by_votes = C.modularity(links, A.label_propagation(edges)).first()[0]
    reached = C.modularity(links, rows.select("id", "community")).first()[0]
    assert reached == pytest.approx(rows.first().modularity) and reached >= by_votes
