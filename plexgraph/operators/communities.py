"""Communities by modularity: moves of single nodes, level by level on coarser graphs."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plexgraph.operators.blocks import Block, Blocks, Numbered, received, runs, sent, sums, xxhash64
from plexgraph.operators.rounds import Rounds

#: Decimals to which gains are compared, so that sums in another order choose the same move.
EXACT = 12


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, dst, weight) of an undirected graph both ways; repeated edges add up, a loop counts twice, a column weight is optional.

    Rows with a null end are left out; a null weight is 0.
    """
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(0.0)) if "weight" in edges.columns else F.lit(1.0)
    rows = edges.where("src is not null and dst is not null").select("src", "dst", weight.alias("weight"))
    both = rows.unionByName(rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return both.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def modularity(links: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row (modularity) of labels (id, community) over an adjacency: inner weight's share, less what chance would give."""
    ends = lambda end: labels.select(F.col("id").alias(end), F.col("community").alias(f"{end}_in"))
    inside = F.sum(F.when(F.col("src_in") == F.col("dst_in"), F.col("weight")).otherwise(0.0))
    each = links.join(ends("src"), "src").join(ends("dst"), "dst").groupBy("src_in").agg(inside.alias("inside"), F.sum("weight").alias("total"))
    whole = each.agg(F.sum("inside").alias("inside"), F.sum("total").alias("m2"), F.sum(F.col("total") * F.col("total")).alias("squares"))
    return whole.select(F.coalesce(F.try_divide("inside", "m2") - resolution * F.try_divide("squares", F.col("m2") * F.col("m2")), F.lit(0.0)).alias("modularity"))


def best_moves(links: DataFrame, labels: DataFrame, m2: float, resolution: float = 1.0) -> DataFrame:
    """(id, k, community, own_weight, loop, total, best, gain) of each node: where it gains most modularity, and how much.

    labels are (id, k, community, loop) with k the node's degree. The gain of a move of node i into community C is
    2 (w(i, C) - w(i, own)) / m2 - 2 resolution k (total(C) - total(own without i)) / m2^2. Of equal gains the node's own
    community wins, then the least. A node alone in its community goes to another such one only if that has a lesser name,
    as else two of them would change places.
    """
    sizes = labels.groupBy("community").agg(F.sum("k").alias("total"), F.count(F.lit(1)).alias("size"))
    around = links.where("src <> dst").join(labels.select(F.col("id").alias("dst"), "community"), "dst").groupBy(F.col("src").alias("id"), "community").agg(F.sum("weight").alias("w"))
    around = around.unionByName(labels.select("id", "community", F.lit(0.0).alias("w"))).groupBy("id", "community").agg(F.sum("w").alias("w"))
    options = around.join(sizes, "community").join(labels.select("id", "k", "loop", F.col("community").alias("own")), "id")
    here = F.col("community") == F.col("own")
    alone = Window.partitionBy("id")
    options = options.withColumn("without", F.when(here, F.col("total") - F.col("k")).otherwise(F.col("total"))).withColumn("here", here)
    value = (F.col("w") - resolution * F.col("k") * F.col("without") / m2) * (2 / m2)
    options = options.withColumn("value", F.round(value, EXACT)).withColumn("own_size", F.max(F.when(F.col("here"), F.col("size"))).over(alone))
    allowed = F.col("here") | (F.col("own_size") > 1) | (F.col("size") > 1) | (F.col("community") < F.col("own"))
    # a struct's max decides: the value, then the own community, then the least name
    rank = F.row_number().over(alone.orderBy(F.desc("value"), F.desc("here"), "community"))
    own = lambda c: F.max(F.when(F.col("here"), F.col(c))).over(alone)
    rows = options.withColumns({"own_weight": own("w"), "own_value": own("value"), "own_total": own("total")}).where(allowed).withColumn("rank", rank).where("rank = 1")
    return rows.select("id", "k", F.col("own").alias("community"), "own_weight", "loop", F.col("own_total").alias("total"), F.col("community").alias("best"), (F.col("value") - F.col("own_value")).alias("gain"))


def _quality(moves: DataFrame, m2: float, resolution: float) -> float:
    """The modularity of the labels that best_moves was given."""
    each = moves.groupBy("community").agg(F.sum(F.col("own_weight") + F.col("loop")).alias("inside"), F.sum("k").alias("total"))
    inside, squares = each.agg(F.sum("inside"), F.sum(F.col("total") * F.col("total"))).first()
    return inside / m2 - resolution * squares / (m2 * m2)


def _moved(share: int | None, k: int, first: int | None):
    """Step: labels after a round's moves, summed up for the communities' blocks.

    The nodes that gain go by their hash, one in share of them (0: none); without a share first goes alone. Without first each node begins alone.
    """

    def of(owners: Blocks):
        def step(b: Block):
            ids, weight = b.one("ids", np.int64), b.one("weight", np.float64)
            label = ids
            if first is not None:
                best, gain = b.one("best", np.int64), b.one("gain", np.float64)
                goes = ids == first if share is None else (gain > 0) & (xxhash64(ids, k) % share == 0) if share else np.zeros(len(ids), bool)
                label = np.where(goes, best, b.one("label", np.int64))
            named, at = np.unique(label, return_inverse=True)
            total, size = np.bincount(at, weight, len(named)), np.bincount(at, minlength=len(named))
            for owner, lo, hi in owners.split(named):
                yield b.row("part", named[lo:hi].tobytes() + total[lo:hi].tobytes() + size[lo:hi].astype(np.int64).tobytes(), b.number, 0.0, owner)
            yield b.row("label", label)

        return step

    return of


def _totals(b: Block):
    """Step: whole totals of the communities of a block's range, told to the blocks that have members of them."""
    parts = [(who, *(np.frombuffer(x, dtype, len(x) // 24, at * (len(x) // 24)) for dtype, at in ((np.int64, 0), (np.float64, 8), (np.int64, 16)))) for who, _, x in b.many("part")]
    if parts:
        named, at = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
        total, size = np.bincount(at, np.concatenate([p[2] for p in parts])), np.bincount(at, np.concatenate([p[3] for p in parts]))
        for who, names, _, _ in parts:
            here = np.searchsorted(named, names)
            yield b.row("total", total[here].tobytes() + (size[here] > 1).tobytes(), b.number, 0.0, who)
    for _, _, x in b.many("label"):
        yield b.row("label", bytes(x))


def _told(b: Block):
    """Step: each node's community, its total and whether it has more members, to the blocks that link to the node."""
    label = b.one("label", np.int64)
    _, at = np.unique(label, return_inverse=True)
    totals = [(np.frombuffer(x, np.float64, len(x) // 9), np.frombuffer(x, bool, len(x) // 9, 8 * (len(x) // 9))) for _, _, x in b.many("total")]
    total, many = (np.concatenate(x)[at] for x in zip(*totals))
    yield from sent(b, "community", label, total, many)
    yield b.row("label", label)
    yield b.row("own total", total)
    yield b.row("many", many)


def _best(m2: float, resolution: float):
    """Step: the best move of each node, as best_moves has it, and sums for the modularity of the labels."""

    def step(b: Block):
        ids, begins, weight, loop, label, total, many = (b.one(name, dtype) for name, dtype in (("ids", np.int64), ("begins", np.int64), ("weight", np.float64), ("loop", np.float64), ("label", np.int64), ("own total", np.float64), ("many", bool)))
        row, code, w, named, totals, some = _around(b)
        there = named[code]
        here = there == label[row]
        own = np.zeros(len(ids))
        own[row[here]] = w[here]
        worth = lambda w, k, without: np.round((w - resolution * k * without / m2) * (2 / m2), EXACT)
        stays = worth(own, weight, total - weight)
        allowed = ~here & (many[row] | some[code] | (there < label[row]))
        row, there, value = row[allowed], there[allowed], worth(w[allowed], weight[row[allowed]], totals[code[allowed]])
        best, gain = label.copy(), np.zeros(len(ids))
        if len(row):
            begin = runs(row)
            most = np.maximum.reduceat(value, begin)
            ties = np.flatnonzero(value == np.repeat(most, np.diff(np.r_[begin, len(row)])))
            ties = ties[runs(row[ties])]  # names ascend within a row
            better = value[ties] > stays[row[ties]]
            at = row[ties[better]]
            best[at], gain[at] = there[ties[better]], value[ties[better]] - stays[at]
        yield b.row("label", label)
        yield b.row("best", best)
        yield b.row("gain", gain)
        top = int(np.argmax(gain))  # of equal gains the least id
        yield b.row("sums", np.array([(own + loop).sum(), (weight * total).sum(), gain[top]]).tobytes() + ids[top : top + 1].tobytes())

    return step


def _around(b: Block, loops: bool = False) -> tuple[np.ndarray, ...]:
    """(row, code, weight) of the communities around each node, by row and name; the names, totals and sizes above 1 by code."""
    begins, links = b.one("begins", np.int64), b.one("links", np.int32)
    ghost, total, many = received(b, "community", np.int64, np.float64, bool)
    named, first, code = np.unique(ghost, return_index=True, return_inverse=True)
    row = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    w = b.one("weights", np.float64) if b.many("weights") else np.ones(len(links))
    if not loops:
        apart = b.one("ghosts", np.int64)[links] != b.one("ids", np.int64)[row]
        row, links, w = row[apart], links[apart], w[apart]
    pairs = row * len(named) + code[links]
    order = np.argsort(pairs, kind="stable")
    pairs = pairs[order]
    begin = runs(pairs)
    row, code = np.divmod(pairs[begin], max(len(named), 1))
    return row, code, sums(w[order], begin), named, total[first], many[first]


def _spread(graph: Blocks, state: DataFrame | None, share: int | None, k: int, first: int | None) -> DataFrame:
    """The labels after a round's moves, with their totals, where the links need them."""
    plain = graph.plain()
    parts = graph.apply(_moved(share, k, first)(plain), graph.node_arrays("ids", "weight"), *([] if first is None else [state.where("kind in ('label', 'best', 'gain')")]))
    return graph.apply(_told, graph.node_arrays("need"), graph.apply(_totals, parts))


def _state(rounds: Rounds, name: str, graph: Blocks, told: DataFrame, m2: float, resolution: float) -> tuple[DataFrame, float, float, int]:
    """(state, modularity, most gain, its node) of labels."""
    rows = graph.apply(_best(m2, resolution), graph.node_arrays("ids", "begins", "weight", "loop"), graph.link_arrays("links", "ghosts", "weights"), told)
    state = rounds.keep(name, rows, by="kind")
    each = [(*np.frombuffer(r.data, np.float64, 3).tolist(), int(np.frombuffer(r.data, np.int64, 1, 24)[0])) for r in state.where("kind = 'sums'").select("data").collect()]  # one row a block
    inside, squares = math.fsum(e[0] for e in each), math.fsum(e[1] for e in each)
    gain, least = min(((-e[2], e[3]) for e in each))
    return state, inside / m2 - resolution * squares / (m2 * m2), -gain, least


def _level(rounds: Rounds, graph: Blocks, m2: float, resolution: float, tolerance: float, most: int) -> tuple[DataFrame, float, bool]:
    """Moves on one graph: (state with the labels, modularity, whether any node moved). Modularity never falls.

    In a round every second of the nodes that gain moves, by their hash. If together they don't gain more than tolerance,
    the round is taken back and fewer nodes move, at last the one that gains most: its gain is certain.
    """
    state, quality, gain, first = _state(rounds, "moves", graph, _spread(graph, None, None, 0, None), m2, resolution)
    shares, tried, moved = (2, 4, 16, None), 0, False
    for k in range(most):
        if gain <= 0:
            break
        share = shares[tried]
        trial, reached, next_gain, next_first = _state(rounds, "trial", graph, _spread(graph, state, share, k, first), m2, resolution)
        if reached - quality > tolerance:
            rounds.rename("trial", "moves")
            state, quality, gain, first, moved, tried = trial, reached, next_gain, next_first, True, 0
        elif share is None:
            break
        else:
            tried += 1
    return state, quality, moved


def _coarse(b: Block) -> dict:
    """A block's links as links between the communities of their ends."""
    row, code, w, named, _, _ = _around(b, loops=True)
    mine, at = np.unique(b.one("label", np.int64), return_inverse=True)
    pairs, at = np.unique(at[row] * len(named) + code, return_inverse=True)
    key, other = np.divmod(pairs, max(len(named), 1))
    return {"key": mine[key], "other": named[other], "weight": np.bincount(at, w, len(pairs))}


def louvain(edges: DataFrame, resolution: float = 1.0, tolerance: float = 1e-4, most_rounds: int = 12, most_levels: int = 10, least_gain: float = 1e-4, once: bool = False) -> DataFrame:
    """(id, community, levels, modularity) of the nodes of undirected edges (src, dst, weight optional).

    Each level starts from single nodes, moves them while modularity rises by more than tolerance a round, and makes every
    community one node of the next level's graph, until a level adds less than least_gain. community is the least id of its
    members; levels are a node's communities from the first level on, named alike; modularity is that of the whole result.
    A node with loops alone is a community of its own; an empty table gives no rows. Negative weights are an error.
    Repeated edges add up; with once they count once, and weights are left out.

    Links lie in blocks as packed arrays. In a round a node's community, with its total, goes once to each block with a link
    to the node, and totals meet in the block that has the community's name in its range.
    """
    rounds = Rounds(edges)
    weight = [] if once or "weight" not in edges.columns else [F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight")]
    numbered = Numbered(rounds, edges.where("src is not null and dst is not null").select("src", "dst", *weight))
    kind = edges.schema["src"].dataType.simpleString()
    rows = rounds.keep("links", numbered.edges)
    links = lambda key, other: rows.select(F.col(key).alias("key"), F.col(other).alias("other"), *(["weight"] if weight else []))
    graph = Blocks(rounds, links("src", "dst").union(links("dst", "src")), "level 0", once)
    rounds.release("links")
    m2 = graph.weight
    if graph.least is not None and graph.least < 0:
        raise ValueError("modularity needs weights of 0 or more")
    ids = graph.rows(lambda b: {"id": b.one("ids", np.int64), "community": b.one("ids", np.int64)}, "id long, community long", graph.node_arrays("ids"))
    assigned = rounds.keep("assigned", ids.withColumn("levels", F.array().cast("array<long>")))
    quality = None if m2 else 0.0
    for level in range(most_levels if m2 else 0):
        state, reached, moved = _level(rounds, graph, m2, resolution, tolerance, most_rounds)
        if not moved or (quality is not None and reached - quality < least_gain):
            quality = reached if quality is None else quality
            break
        quality = reached
        up = graph.rows(lambda b: {"community": b.one("ids", np.int64), "up": b.one("label", np.int64)}, "community long, up long", graph.node_arrays("ids"), state.where("kind = 'label'"))
        joined = assigned.join(up, "community").withColumn("least", F.min("id").over(Window.partitionBy("up")))
        assigned = rounds.keep("assigned", joined.select("id", F.col("up").alias("community"), F.array_append("levels", F.col("least")).alias("levels")))
        told = _spread(graph, state, 0, 0, 0)  # once more, without moves
        coarse = graph.rows(_coarse, "key long, other long, weight double", graph.node_arrays("begins", "ids"), graph.link_arrays("links", "ghosts", "weights"), told)
        coarse = rounds.keep("links", coarse)
        graph.release()
        graph = Blocks(rounds, coarse, f"level {level + 1}")
        rounds.release("links")
    graph.release()
    named = numbered.named(assigned.select("id", F.coalesce(F.try_element_at("levels", F.lit(-1)), F.col("id")).alias("community"), "levels"), "id", "community")
    if numbered.names is None:
        named = named.withColumn("levels", F.col("levels").cast(f"array<{kind}>"))
    else:  # levels are numbers still
        each = named.select("id", F.posexplode("levels").alias("at", "number")).join(numbered.names, "number").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("l"))
        named = named.drop("levels").join(each.select("id", F.col("l.name").alias("levels")), "id", "left").withColumn("levels", F.coalesce("levels", F.array().cast(f"array<{kind}>")))
    return named.select("id", "community", "levels", F.lit(quality).alias("modularity"))
