"""Graph algorithms and analytic recipes as rounds of joins, windows and aggregates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plexgraph.operators.blocks import Block, Blocks, Numbered, received, runs, sent, sums, xxhash64
from plexgraph.operators.rounds import Rounds

#: Edges whose nodes make a range of similarity().
RANGE_EDGES = 200_000


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 30) -> DataFrame:
    """(id, score) of the nodes of edges (src, dst): repeated edges count once, a sink's rank isn't dealt out.

    Blocks have the links to their nodes. In a round a node's share goes once to each block with a link from it, as packed
    arrays. Each round is kept as a table, and the one before goes. Edges with a null end are left out.
    """
    kept = Rounds(edges)
    numbered = Numbered(kept, edges.select("src", "dst").where("src is not null and dst is not null"))
    links = kept.keep("links", numbered.edges.select(F.col("dst").alias("key"), F.col("src").alias("other")))
    graph = Blocks(kept, links, "graph", once=True)
    kept.release("links")
    n = max(graph.n, 1)

    def shares(b: Block, score: np.ndarray):
        yield from sent(b, "share", score / np.maximum(b.one("degree", np.float64), 1))

    def start(b: Block):
        return shares(b, np.full(len(b.one("degree", np.float64)), 1 / n))

    def round_(last: bool):
        def step(b: Block):
            (share,) = received(b, "share", np.float64)
            begins = b.one("begins", np.int64)
            some = np.flatnonzero(np.diff(begins))
            score = np.full(len(begins) - 1, (1 - damping) / n)
            score[some] += damping * sums(share[b.one("links", np.int32)], begins[some])
            if last:
                yield b.row("score", score)
            else:
                yield from shares(b, score)

        return step

    if not rounds:
        return numbered.named(graph.rows(lambda b: {"id": b.one("ids", np.int64), "score": np.full(len(b.one("ids", np.int64)), 1 / n)}, "id long, score double", graph.node_arrays("ids")), "id")
    messages = kept.keep("messages", graph.apply(start, graph.node_arrays("need", "degree")))
    for k in range(rounds):
        messages = kept.keep("messages", graph.apply(round_(k == rounds - 1), graph.node_arrays("begins", "need", "degree"), graph.link_arrays("links"), messages))
    ranks = graph.rows(lambda b: {"id": b.one("ids", np.int64), "score": b.one("score", np.float64)}, "id long, score double", graph.node_arrays("ids"), messages)
    ranks = kept.keep("ranks", numbered.named(ranks, "id"))
    graph.release()
    return ranks


def top_ranks(ranks: DataFrame, k: int = 20) -> DataFrame:
    """The k nodes of highest score, rounded to six places."""
    return ranks.select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def label_propagation(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """(id, community): the most frequent label around a node wins, its own and then the least of equal ones.

    In each round only every second node by its hash moves, so that two labellings can't swing to and fro. Labels go as packed
    arrays to the blocks that need them, in later rounds those alone that have changed; a node votes only if one around it has.
    """
    kept = Rounds(edges)
    numbered = Numbered(kept, edges.select("src", "dst").where("src <> dst"))
    kept_edges = kept.keep("edges", numbered.edges)
    both = kept_edges.select(F.col("src").alias("key"), F.col("dst").alias("other"))
    graph = Blocks(kept, both.union(both.select("other", "key")), "graph", once=True)
    kept.release("edges")

    def vote(k: int):
        def step(b: Block):
            ids, begins, links = b.one("ids", np.int64), b.one("begins", np.int64), b.one("links", np.int32)
            if k == 0:
                label, ghost, stale = ids.copy(), b.one("ghosts", np.int64), np.ones(len(ids), bool)
            else:
                label, ghost, stale = b.one("label", np.int64).copy(), b.one("ghost", np.int64).copy(), b.one("stale", bool).copy()
                touched = np.zeros(len(ghost), bool)
                for _, _, data in b.many("changed"):
                    at = np.frombuffer(data, np.int32, len(data) // 12)
                    ghost[at], touched[at] = np.frombuffer(data[4 * len(at) :], np.int64), True
                if touched.any():
                    stale[np.searchsorted(begins, np.flatnonzero(touched[links]), "right") - 1] = True
            goes = np.flatnonzero(stale & (xxhash64(ids) % 2 == k % 2))
            stale[goes] = False
            won = _most_frequent(begins, links, ghost, label, goes)
            moved = np.zeros(len(ids), bool)
            moved[goes] = won != label[goes]
            label[goes] = won
            yield b.row("label", label)
            yield b.row("ghost", ghost)
            yield b.row("stale", stale)
            yield from (b.row("moved", value=value) for _, value, _ in b.many("moved"))
            if moved.any():
                yield b.row("moved", value=moved.sum())
                for to, lo, need in b.many("need"):
                    need = np.frombuffer(need, np.int32)
                    if len(at := np.flatnonzero(moved[need])):
                        yield b.row("changed", (at + int(lo)).astype(np.int32).tobytes() + label[need[at]].tobytes(), b.number, 0.0, to)

        return step

    state = None
    for k in range(0, 2 * rounds, 2):  # both halves of the nodes in one job
        before = graph.link_arrays("ghosts") if state is None else state
        for half in (k, k + 1):
            before = graph.apply(vote(half), graph.node_arrays("ids", "begins", "need"), graph.link_arrays("links"), before)
        state = kept.keep("labels", before, by="kind")
        moved = state.where("kind = 'moved'").agg(F.sum("value")).first()[0]
        state = state.where("kind <> 'moved'")
        if not moved:
            break
    label = (lambda b: b.one("ids", np.int64)) if state is None else (lambda b: b.one("label", np.int64))
    rows = graph.rows(lambda b: {"id": b.one("ids", np.int64), "community": label(b)}, "id long, community long", graph.node_arrays("ids"), *([] if state is None else [state.where("kind = 'label'")]))
    labels = kept.keep("result", numbered.named(rows, "id", "community"))
    kept.release("labels")
    graph.release()
    return labels


def _most_frequent(begins: np.ndarray, links: np.ndarray, ghost: np.ndarray, label: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The label that most links of each of the nodes lead to, its own and then the least of equal ones; a node without links keeps its own."""
    out, number = label[nodes], np.diff(begins)[nodes]
    if not number.sum():
        return out
    labels, code = np.unique(ghost, return_inverse=True)
    row = np.repeat(np.arange(len(nodes)), number)
    at = np.arange(len(row)) + np.repeat(begins[nodes] - (np.cumsum(number) - number), number)
    pairs = np.sort(row * len(labels) + code[links[at]])
    first = runs(pairs)
    row, code = np.divmod(pairs[first], len(labels))
    votes = 2 * np.diff(np.r_[first, len(pairs)]) + (labels[code] == out[row])
    begin = runs(row)
    best = np.maximum.reduceat(votes, begin)
    ties = np.flatnonzero(votes == np.repeat(best, np.diff(np.r_[begin, len(row)])))
    ties = ties[runs(row[ties])]  # labels ascend within a row
    out[row[ties]] = labels[code[ties]]
    return out


def communities(labels: DataFrame, least: int = 3, members: int = 10) -> DataFrame:
    """(community, size, members) of communities of at least so many nodes, with the first of their ids."""
    rank = F.row_number().over(Window.partitionBy("community").orderBy("id"))
    rows = labels.withColumn("k", rank).groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.sort_array(F.collect_list(F.when(F.col("k") <= members, F.col("id")))).alias("members"))
    return rows.where(F.col("size") >= least)


def betweenness(edges: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """(id, score) of the nodes reached from the source ids (id): Brandes' sums, levels forward and back as joins keyed by source.

    Paths of any length count, or those of at most `most` edges.
    """
    kept = Rounds(edges)
    edges = kept.keep("edges", edges.select("src", "dst").distinct())
    level = sources.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(1.0).alias("paths"))
    levels, seen = [level], level.select("s", "v")
    while most is None or len(levels) <= most:
        step = level.join(edges, level.v == edges.src).groupBy("s", F.col("dst").alias("v")).agg(F.sum("paths").alias("paths"))
        level = kept.keep(f"level {len(levels)}", step.join(seen, ["s", "v"], "left_anti"))
        if not level.limit(1).count():
            break
        levels.append(level)
        seen = seen.union(level.select("s", "v"))
    scores, below = [], None
    for k in range(len(levels) - 1, 0, -1):
        here = levels[k].withColumn("load", F.lit(0.0)) if below is None else levels[k].join(below, ["s", "v"], "left").withColumn("load", F.coalesce("load", F.lit(0.0)))
        scores.append(here.select("v", "load"))
        up = here.join(edges, here.v == edges.dst).select("s", F.col("src").alias("u"), "paths", "load")
        parents = levels[k - 1].select("s", F.col("v").alias("u"), F.col("paths").alias("up"))
        below = kept.keep(f"below {k}", up.join(parents, ["s", "u"]).groupBy("s", F.col("u").alias("v")).agg(F.sum(F.col("up") / F.col("paths") * (1 + F.col("load"))).alias("load")))
    if not scores:
        return sources.where("false").select("id", F.lit(0.0).alias("score"))
    total = scores[0]
    for more in scores[1:]:
        total = total.union(more)
    return total.groupBy(F.col("v").alias("id")).agg(F.sum("load").alias("score"))


def similarity(edges: DataFrame, least: float = 0.1, undirected: bool = False) -> DataFrame:
    """(a, b, shared, jaccard, cosine) of nodes src that share neighbours dst, or neighbours of either direction.

    All pairs of the nodes around a neighbour are counted, which grows with the square of its degree. Nodes lie in ranges of
    their ids. A neighbour's list of nodes goes to the ranges that have some of them, and there all pairs with these as the
    lesser end are made and counted, so that no pair is shuffled.
    """
    kept = Rounds(edges)
    edges = edges.select("src", "dst").where("src is not null and dst is not null")
    edges = (edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) if undirected else edges).repartition("dst").distinct()
    edges = kept.keep("edges", edges)
    degree = kept.keep("degree", edges.groupBy("src").agg(F.count(F.lit(1)).alias("d")))
    ranges = max(1, -(-edges.count() // RANGE_EDGES))
    ranged = kept.keep("ranged", degree.repartitionByRange(ranges, "src").select("src", "d", F.spark_partition_id().alias("range")))
    around = edges.join(ranged, "src").groupBy("dst").agg(F.sort_array(F.collect_list(F.struct("src", "d", "range"))).alias("nodes"))
    # ranges ascend with ids: from a range's first node on, all others are possible greater ends
    each = around.select("nodes", F.explode(F.array_distinct("nodes.range")).alias("range"))
    each = each.select("range", F.expr("slice(nodes, array_position(nodes.range, range), size(nodes))").alias("nodes")).where(F.size("nodes") > 1)
    lists = kept.keep("lists", each.select("range", F.expr("transform(nodes, x -> struct(x.src, x.d))").alias("nodes"), F.expr("least(size(filter(nodes, x -> x.range = range)), size(nodes) - 1)").alias("lesser")))
    dealt = lists.repartition(ranges, "range").select("range", "nodes", F.explode(F.expr("sequence(1, lesser)")).alias("k"))
    pairs = dealt.select("range", F.expr("nodes[k - 1]").alias("x"), F.explode(F.expr("slice(nodes, k + 1, size(nodes))")).alias("y"))
    shared = pairs.groupBy("range", F.col("x.src").alias("a"), F.col("y.src").alias("b"), F.col("x.d").alias("da"), F.col("y.d").alias("db")).agg(F.count(F.lit(1)).alias("shared"))
    rows = shared.select("a", "b", "shared", F.round(F.col("shared") / (F.col("da") + F.col("db") - F.col("shared")), 4).alias("jaccard"), F.round(F.col("shared") / F.sqrt(F.col("da") * F.col("db")), 4).alias("cosine"))
    return rows.where(F.col("jaccard") >= least)


def reach(distances: DataFrame) -> DataFrame:
    """(hops, n) of a table of shortest paths."""
    return distances.groupBy("hops").agg(F.count(F.lit(1)).alias("n"))


def reachability(distances: DataFrame, nodes: DataFrame) -> DataFrame:
    """(hops, n, percent): how many nodes lie at each distance, and their share of all nodes."""
    total = nodes.agg(F.count(F.lit(1)).alias("total"))  # one row
    return reach(distances).crossJoin(F.broadcast(total)).select("hops", "n", F.round(F.col("n") * 100 / F.col("total"), 2).alias("percent"))


def anomalies(rows: DataFrame, value: str, z: float = 2.5, fence: float = 1.5) -> DataFrame:
    """rows with z_score, by_z, by_iqr and side (high, low) where a value is out of bounds by either rule."""
    stats = rows.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    joined = rows.crossJoin(F.broadcast(stats))  # one row of statistics
    score = F.try_divide(F.col(value) - F.col("mean"), F.col("sd"))
    low, high = F.col("q")[0] - fence * (F.col("q")[1] - F.col("q")[0]), F.col("q")[1] + fence * (F.col("q")[1] - F.col("q")[0])
    out = joined.select(*rows.columns, score.alias("z_score"), (F.abs(score) > z).alias("by_z"), ((F.col(value) < low) | (F.col(value) > high)).alias("by_iqr"), F.when(F.col(value) > F.col("mean"), "high").otherwise("low").alias("side"))
    return out.where("by_z or by_iqr")


def temporal(rows: DataFrame, day: str, value: str, window: int = 7) -> DataFrame:
    """(day, value, moving_avg, pct_change, index) of a series of one row a day, which must be aggregated before."""
    order = Window.orderBy(day)
    change = (F.col(value) / F.lag(value).over(order) - 1) * 100
    return rows.select(day, value, F.avg(value).over(order.rowsBetween(1 - window, 0)).alias("moving_avg"), F.coalesce(change, F.lit(0.0)).alias("pct_change"), (F.row_number().over(order) - 1).alias("index"))


def trend(series: DataFrame, value: str) -> DataFrame:
    """One row: slope over the index, its name, lowest, highest, mean."""
    slope = F.regr_slope(F.col(value), F.col("index").cast("double"))
    name = F.when(F.count(value) < 2, "insufficient_data").when(slope > 0, "increasing").when(slope < 0, "decreasing").otherwise("flat")
    return series.agg(slope.alias("slope"), name.alias("trend"), F.min(value).alias("lowest"), F.max(value).alias("highest"), F.avg(value).alias("mean"))


#: Analyses by name: their function, and the types of the parameters that may be set.
RECIPES = {
    "pagerank": (pagerank, {"damping": float, "rounds": int}),
    "communities": (label_propagation, {"rounds": int}),
    "similarity": (similarity, {"least": float, "undirected": bool}),
    "anomalies": (anomalies, {"value": str, "z": float, "fence": float}),
    "temporal": (temporal, {"day": str, "value": str, "window": int}),
}


def run_recipe(name: str, rows: DataFrame, **parameters) -> DataFrame:
    """A recipe with typed parameters; unknown names and parameters, and values of another type, are errors."""
    if name not in RECIPES:
        raise ValueError(f"no recipe {name}; there are {sorted(RECIPES)}")
    function, types = RECIPES[name]
    for key, value in parameters.items():
        if key not in types or not isinstance(value, (int, float) if types[key] is float else types[key]):
            raise ValueError(f"{name} takes {types}, not {key}={value!r}")
    return function(rows, **parameters)
