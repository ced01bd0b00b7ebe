"""Near-duplicate documents by improved consistent weighted sampling.

A document is the weighted set of its runs of five words: the weight of a run is
how often it occurs times the logarithm of 1 + N / documents with it. Document
frequencies are exact for all runs in SHARE of the N documents or more, and every
rarer run counts as being in that share. So the table of frequencies has at most
(mean runs of a document) / SHARE entries, however large the corpus is. Such a run
is in SHARE of the documents of some chunk at least, so that a first pass over chunks
finds what can be one, and a second pass counts those everywhere.

Improved consistent weighted sampling (Ioffe, 2010) draws BANDS x ROWS samples of
each set; two sets agree in a sample with the probability of their weighted
Jaccard similarity. Documents that agree in all rows of a band are candidates.
In a bucket of at most PAIRED texts all pairs are compared. The texts of larger
buckets are joined by prefixes, which loses nothing: with the runs of a text from
rare to common, two texts of similarity t share one of the first runs that weigh
more than 1 - t of either. Where more than PAIRED texts share such a run, all are
compared with one of them as a leader, and those that aren't similar to it with
a next, LEADERS in all; the second is the lightest, the most similar to those that
have nothing rarer in common. Then all the run's texts that the links so far leave
in different components are compared, in blocks that hold the runs of their texts:
sums of weights in a small hashed sketch bound the similarity from above and rule
most pairs out, the rest are compared run by run, and only links leave the task. So
each link that is left out is between texts of one class.
Pairs whose weighted Jaccard similarity is at least `threshold` are
links; classes are the connected components.

Cases: equal texts are one text before anything is compared, and always one
class. A text of fewer than five words has one run, of all its words. Documents
without a word (null and empty texts too) are each a class of their own.
A null doc_id takes part; a class whose doc_ids are all null has a null class_id.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexgraph.llm.components import components
from plexgraph.llm.runtime import discard, stored, text_keys
from plexgraph.llm.textvec import blocks, gram_hashes, mix64, span_hashes, string_bytes, words

RUN = 5
BANDS, ROWS = 14, 3
THRESHOLD = 0.8
#: Runs in this share of the documents or more have their own document frequency.
SHARE = 0.001
#: Runs of a chunk of documents that are counted at once, and candidates that are broadcast; more of them are joined.
CHUNK, BROADCAST = 1 << 21, 1 << 20
#: Rows of a batch of runs and counts.
SLICE = 1 << 18
#: The share of a task's documents is this many documents at least, unless the corpus has fewer.
CHUNK_LEAST = 8
#: Entries of the table that orders the runs of crowded texts from rare to common.
TABLE = 1 << 16
PAIRED = 32
LEADERS = 5
#: Texts of a crowded prefix run, and runs of theirs, that are dealt to one task to be compared with as many others.
BLOCK, BLOCK_RUNS = 2048, 1 << 21
#: Entries of the sketch that rules out pairs of crowded prefix runs.
SKETCH = 128
#: What rounding may take from a similarity.
SLACK = 1e-12

_TABLES: dict[str, np.ndarray] = {}


def _draws() -> dict[str, np.ndarray]:
    """Fixed tables of the random variables: r and c of Gamma(2, 1), the latter as logarithm, and a uniform shift."""
    if not _TABLES:
        rng = np.random.default_rng(20100101)
        r = rng.gamma(2.0, 1.0, 1 << 16) + 1e-6
        _TABLES.update(r=r.astype(np.float32), inverse=(1 / r).astype(np.float32), log_c=np.log(rng.gamma(2.0, 1.0, 1 << 16) + 1e-9).astype(np.float32), shift=rng.random(1 << 16).astype(np.float32))
        _TABLES["odd"] = rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return _TABLES


class Weights:
    """The weight of runs: a table of the common ones, sorted, and one weight for the rest."""

    def __init__(self, runs: np.ndarray, frequencies: np.ndarray, documents: float, share: float = SHARE):
        order = np.argsort(runs)
        self.runs, self.logs = runs[order], np.log(1 + documents / frequencies[order])
        self.rest = float(np.log(1 + 1 / share))

    def of(self, run: np.ndarray) -> np.ndarray:
        if not len(self.runs):
            return np.full(len(run), self.rest)
        at = np.minimum(np.searchsorted(self.runs, run), len(self.runs) - 1)
        return np.where(self.runs[at] == run, self.logs[at], self.rest)


def weighted_runs(data: np.ndarray, offsets: np.ndarray, weights: Weights | None):
    """(run, row, weight) of the distinct runs of each row, sorted by row and run; weight is the count where weights is None."""
    start, end, row = words(data, offsets)
    runs, rows = gram_hashes(span_hashes(data, start, end), row, RUN)
    key = np.sort((rows.astype(np.uint64) << np.uint64(52)) | (runs >> np.uint64(12)))
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.r_[first, len(key)])
    key = key[first]
    row, run = (key >> np.uint64(52)).astype(np.int64), key & np.uint64((1 << 52) - 1)
    return run, row, count if weights is None else count * weights.of(run)


def _chunks(batches):
    """(runs of all documents, sorted, number of documents) of chunks of about CHUNK runs; what is left at the end joins the last chunk.

    On its own a small rest would report runs of one document, as those are in a share of it.
    A document has a run once, so that repeats count documents; only whole chunks are sorted, in place.
    """
    held, size, rows, last, documents = [], 0, 0, None, 0
    for batch in batches:
        data, offsets = string_bytes(batch.column(0))
        for a, b in blocks(offsets):
            held.append(weighted_runs(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], None)[0])
            size, rows = size + len(held[-1]), rows + b - a
            if size >= CHUNK:
                if last is not None:
                    yield last, documents
                last = None  # let go before the next one is put together
                last, documents = _sorted(held), rows
                size, rows = 0, 0
    if rows:
        held += [] if last is None else [last]
        last, documents = None, rows + documents
        last = _sorted(held)
    if last is not None:
        yield last, documents


def _sorted(held: list) -> np.ndarray:
    """What is held, in one sorted array; the list is emptied."""
    runs = np.concatenate(held)
    held.clear()
    runs.sort()
    return runs


def _often(runs: np.ndarray, least: int):
    """(run, n) in slices: the sorted runs that occur n times, least at least."""
    size = max(0, len(runs) - least + 1)
    begins = runs[:size] == runs[least - 1 : least - 1 + size]
    begins[1:] &= runs[1:size] != runs[:size][:-1]
    begins = np.flatnonzero(begins)
    for k in range(0, len(begins), SLICE):
        run = runs[begins[k : k + SLICE]]
        yield run, np.searchsorted(runs, run, "right") - begins[k : k + SLICE]


def _reports(share: float):
    """(run, n, slack): runs in a share of a chunk's documents at least; the slack is what a run that isn't reported can have. Run -1 has the documents and slack of a chunk."""

    def rows(batches):
        for runs, documents in _chunks(batches):
            least = max(1, int(share * documents))
            for run, n in chain(_often(runs, least), [(np.array([-1]), np.array([documents]))]):
                yield pa.RecordBatch.from_arrays([pa.array(run.astype(np.int64)), pa.array(n), pa.array(np.full(len(run), least - 1))], ["run", "n", "slack"])
            del runs

    return rows


def _frequencies(candidates):
    """(run, n) of the candidates, or of all runs."""

    def rows(batches):
        for runs, _ in _chunks(batches):
            for run, n in _often(runs, 1) if candidates is None else _found(runs, candidates.value):
                yield pa.RecordBatch.from_arrays([pa.array(run.astype(np.int64)), pa.array(n)], ["run", "n"])
            del runs

    return rows


def _found(runs: np.ndarray, known: np.ndarray):
    """(run, n) in slices: the known runs that occur n times in the sorted ones."""
    for k in range(0, len(known), SLICE):
        run = known[k : k + SLICE]
        n = np.searchsorted(runs, run, "right") - np.searchsorted(runs, run)
        yield run[n > 0], n[n > 0]


def run_weights(texts: DataFrame, share: float = SHARE) -> Weights:
    """Weights from all rows of a one-column DataFrame."""
    # few documents in many partitions: read together, so that a chunk's share is several documents
    texts = texts.coalesce(max(1, int(texts.count() * share / CHUNK_LEAST)))
    reports = stored(texts.mapInArrow(_reports(share), "run long, n long, slack long"), "reports")
    documents, slack = reports.where("run = -1").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("slack"), F.lit(0))).first()
    least = share * documents
    possible = reports.where("run >= 0").groupBy("run").agg(F.sum(F.col("n") - F.col("slack")).alias("over")).where(F.col("over") + slack >= least).select("run")
    possible = stored(possible, "candidates")
    discard(reports)
    count = possible.count()
    if not count:
        return Weights(np.zeros(0, np.uint64), np.zeros(0), 0, share)
    if count <= BROADCAST:
        known = np.sort(possible.toArrow().column("run").to_numpy()).view(np.uint64)
        found = texts.mapInArrow(_frequencies(texts.sparkSession.sparkContext.broadcast(known)), "run long, n long")
    else:
        found = texts.mapInArrow(_frequencies(None), "run long, n long").join(possible, "run", "left_semi")
    common = found.groupBy("run").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toArrow()  # mean runs of a document / share rows at most
    discard(possible)
    return Weights(common.column("run").to_numpy().view(np.uint64), common.column("n").to_numpy(), documents, share)


def _entries(batches):
    total = np.zeros(TABLE, np.int64)
    for batch in batches:
        data, offsets = string_bytes(batch.column(0))
        for a, b in blocks(offsets):
            run, _, _ = weighted_runs(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], None)
            total += np.bincount((run & np.uint64(TABLE - 1)).astype(np.int64), minlength=TABLE)
    full = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(total[full])], ["entry", "n"])


def _table_counts(texts: DataFrame) -> np.ndarray:
    """Documents with a run of each entry of the table, of a one-column DataFrame."""
    counts = texts.mapInArrow(_entries, "entry int, n long").groupBy("entry").agg(F.sum("n").alias("n")).toArrow()  # TABLE rows at most
    table = np.zeros(TABLE)
    table[counts.column("entry").to_numpy()] = counts.column("n").to_numpy()
    return table


def _prefixes(weights: Weights, counts: np.ndarray, threshold: float):
    """The runs of each text from the rarest on, until they weigh more than 1 - threshold of it; its weight, that of the runs of each entry of a sketch, and all runs with their counts."""

    def prefix(text: pa.Array) -> pa.Array:
        data, offsets = string_bytes(text)
        out, sums, sketches, every, number = [], [], [], [], []
        for i in range(len(text)):
            run, _, count = weighted_runs(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]), None)
            weight = count * weights.of(run)
            every.append(run.tobytes())
            number.append(count.astype(np.int32).tobytes())
            order = np.lexsort((run, counts[(run & np.uint64(TABLE - 1)).astype(np.int64)]))
            total = np.cumsum(weight[order])
            first = int(np.searchsorted(total, (1 - threshold) * total[-1] * (1 + 1e-9), "right")) + 1 if len(total) else 0
            out.append(run[order[:first]].view(np.int64))
            sums.append(float(total[-1]) if len(total) else 0.0)
            # rounded up, so that sums of minima stay bounds; what is too large becomes infinite
            sketch = np.bincount(((run >> np.uint64(20)) & np.uint64(SKETCH - 1)).astype(np.int64), weight, SKETCH) * 1.001
            with np.errstate(over="ignore"):
                sketches.append(sketch.astype(np.float16).tobytes())
        return pa.StructArray.from_arrays([pa.array(out, pa.list_(pa.int64())), pa.array(sums), pa.array(sketches, pa.binary()), pa.array(every, pa.binary()), pa.array(number, pa.binary())], ["runs", "weight", "sketch", "every", "number"])

    return F.arrow_udf(prefix, "struct<runs: array<bigint>, weight: double, sketch: binary, every: binary, number: binary>")


def signatures(data: np.ndarray, offsets: np.ndarray, weights: Weights) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have a word, their band hashes)."""
    run, row, weight = weighted_runs(data, offsets, weights)
    if not len(run):
        return row, np.zeros((0, BANDS), np.uint64)
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    size = np.diff(np.r_[first, len(row)])
    log_weight = np.log(weight).astype(np.float32)
    base, t = mix64(run), _draws()
    bands = np.zeros((len(first), BANDS), np.uint64)
    for k in range(BANDS * ROWS):
        m = base * t["odd"][k]
        m ^= m >> np.uint64(29)
        i = (m & np.uint64(0xFFFF)).astype(np.intp)
        r = t["r"][i]
        shift = t["shift"][((m >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.intp)]
        step = np.floor(log_weight * t["inverse"][i] + shift)
        score = t["log_c"][(m >> np.uint64(48)).astype(np.intp)] - r * (step - shift) - r
        least = np.minimum.reduceat(score, first)
        at = np.flatnonzero(score == np.repeat(least, size))[::-1]
        chosen = np.empty(len(first), np.int64)
        chosen[np.searchsorted(first, at, "right") - 1] = at  # the first of equal ones
        sample = mix64(run[chosen] * np.uint64(0x9E3779B97F4A7C15) + step[chosen].astype(np.int64).view(np.uint64))
        bands[:, k // ROWS] = mix64(bands[:, k // ROWS] + sample + np.uint64(k + 1))
    return row[first], bands


def _band_column(weights: Weights):
    def bands(text: pa.Array) -> pa.Array:
        data, offsets = string_bytes(text)
        full, values = np.zeros(len(text), bool), []
        for a, b in blocks(offsets):
            row, band = signatures(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], weights)
            full[a + row] = True
            values.append(band.ravel())
        ends = np.r_[0, np.cumsum(full * BANDS)].astype(np.int32)
        flat = np.concatenate(values).view(np.int64) if values else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))

    return F.arrow_udf(bands, "array<bigint>")


def _similarity_column(weights: Weights):
    def similarity(left: pa.Array, right: pa.Array) -> pa.Array:
        out, known, held = np.zeros(len(left)), {}, 0
        sides = [string_bytes(left), string_bytes(right)]
        for i in range(len(left)):
            pair = []
            for data, at in sides:
                text = data[at[i] : at[i + 1]]
                name = text.tobytes()
                if name not in known:  # most texts come again, so their runs are kept, about a million at most
                    run, _, weight = weighted_runs(text, np.array([0, len(text)]), weights)
                    if held > 1 << 20:
                        known, held = {}, 0
                    known[name], held = (run, weight, weight.sum()), held + len(run)
                pair.append(known[name])
            (ra, wa, sa), (rb, wb, sb) = pair
            if len(ra) and len(rb):
                at_a = np.minimum(np.searchsorted(ra, rb), len(ra) - 1)
                shared = np.minimum(wa[at_a], wb)[ra[at_a] == rb].sum()
                out[i] = shared / (sa + sb - shared)
        return pa.array(out)

    return F.arrow_udf(similarity, "double")


def _linked(pairs: DataFrame, texts: DataFrame, similarity, threshold: float) -> DataFrame:
    """The pairs (a, b) that are similar."""
    a = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    with_texts = pairs.select("a", "b").distinct().join(a, "a").join(b, "b")
    return stored(with_texts.where(similarity("text_a", "text_b") >= threshold - SLACK).select("a", "b"), "edges")


def _sized(members: DataFrame, order=None) -> DataFrame:
    """Members with n and leader, the size and first node of their bucket, without buckets of one."""
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node") if order is None else order).alias("least")).where("n > 1")
    return stored(members.join(sizes.select("key", "n", F.col("least.node").alias("leader")), "key"), "rows")


def _pairs_of_small(rows: DataFrame) -> DataFrame:
    small = rows.where(F.col("n") <= PAIRED).select("key", "node")
    return small.select("key", F.col("node").alias("a")).join(small.select("key", F.col("node").alias("b")), "key").where("a < b").select("a", "b")


def _similar(weights: Weights, threshold: float):
    """Links between the two blocks of a group (within it, if it is one) whose ends aren't in one component yet."""

    def links(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        side = group.column("own").to_numpy() == group.column("j").to_numpy()[0]
        label, weight = group.column("label").to_numpy().copy(), group.column("weight").to_numpy()
        sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.float16).reshape(-1, SKETCH).astype(np.float32)
        every, number = group.column("every").to_pylist(), group.column("number").to_pylist()
        size = np.array([len(x) // 4 for x in number])
        start = np.r_[0, np.cumsum(size)]
        kinds, run = np.unique(np.frombuffer(b"".join(every), np.uint64), return_inverse=True)
        own = np.frombuffer(b"".join(number), np.int32) * weights.of(kinds)[run]
        one = group.column("i")[0].as_py() == group.column("j")[0].as_py()
        left, right = np.flatnonzero(side if one else ~side), np.flatnonzero(side)
        columns, held, found = np.ascontiguousarray(sketch[right].T), np.zeros(len(kinds)), []
        for x in left:
            other = np.flatnonzero((label[right] != label[x]) & (right > x if one else True))
            if not len(other):
                continue
            most = np.zeros(len(other), np.float32)
            for entry in range(SKETCH):
                most += np.minimum(columns[entry, other], sketch[x, entry])
            y = right[other]
            most = np.minimum(np.minimum(most * 1.0001, weight[y]), weight[x])
            y = y[most * (1 + threshold) >= threshold * (weight[y] + weight[x]) * (1 - 1e-6)]
            if not len(y):
                continue
            held[run[start[x] : start[x + 1]]] = own[start[x] : start[x + 1]]
            first = np.r_[0, np.cumsum(size[y])[:-1]]
            at = np.repeat(start[y] - first, size[y]) + np.arange(size[y].sum())
            shared = np.add.reduceat(np.minimum(held[run[at]], own[at]), first)
            held[run[start[x] : start[x + 1]]] = 0
            for z in y[shared / (weight[x] + weight[y] - shared) >= threshold - SLACK]:
                if label[z] != label[x]:
                    found.append((x, z))
                    label[label == label[z]] = label[x]
        x, y = (pa.array([f[k] for f in found], pa.int64()) for k in (0, 1))
        return pa.table({"one": group.column("node_id").take(x), "other": group.column("node_id").take(y)})

    return links


def _links_across(prefixes: DataFrame, sketches: DataFrame, labels: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """Links (a, b) of texts of a crowded prefix run that are in different components so far.

    A run's texts are dealt to blocks of about BLOCK texts or BLOCK_RUNS runs, and each pair of blocks is a group of its own.
    """
    named = F.struct(F.xxhash64("label").alias("label"), "weight", "sketch", "every", "number")
    texts = sketches.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).select("node", named.alias("of"), F.length("every").alias("bytes"))
    texts = stored(texts, "labelled")
    # only runs that are crowded: in the others all pairs were compared
    many = prefixes.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > PAIRED).select("key")
    rows = prefixes.join(many, "key").join(texts.select("node", "of.label", "bytes"), "node")
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.min("label").alias("low"), F.max("label").alias("high")).where((F.col("n") > PAIRED) & (F.col("low") != F.col("high")))
    blocks_of = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("bytes") / (8 * BLOCK_RUNS))).cast("int")
    rows = rows.drop("bytes").join(sizes.select("key", blocks_of.alias("blocks")), "key").withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    rows = rows.select("key", "node", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.join(texts.drop("bytes"), "node").select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", F.col("node").alias("node_id"), "of.*")
    found = rows.groupBy("key", "i", "j").applyInArrow(_similar(weights, threshold), "one struct<k1: bigint, k2: bigint>, other struct<k1: bigint, k2: bigint>")
    found = stored(found.select(F.least("one", "other").alias("a"), F.greatest("one", "other").alias("b")).distinct(), "across")
    discard(texts)
    return found


def _links(members: DataFrame, texts: DataFrame, weights: Weights, threshold: float) -> list[DataFrame]:
    """Tables of links (a, b) among the members (key, node) of each bucket."""
    similarity = _similarity_column(weights)
    rows = _sized(members)
    edges = [_linked(_pairs_of_small(rows), texts, similarity, threshold)]
    large = rows.where(F.col("n") > PAIRED).select("node").distinct()
    if not large.limit(1).count():
        return edges
    crowded = stored(texts.join(large, "node"), "crowded")
    discard(rows)
    prefix = _prefixes(weights, _table_counts(crowded.select("text")), threshold)
    # dealt out evenly: the small files of the join before are few for so much work
    dealt = crowded.repartition("node").select("node", prefix("text").alias("prefix"))
    sketches = stored(dealt.select("node", "prefix.*"), "sketches")
    members = prefixes = stored(sketches.select(F.explode("runs").alias("key"), "node", "weight"), "prefixes")
    for turn in range(LEADERS):
        rows = _sized(members, F.struct("weight", "node") if turn == 1 else F.struct("node"))
        star = rows.where((F.col("n") > PAIRED) & (F.col("node") != F.col("leader"))).select("key", F.col("leader").alias("a"), F.col("node").alias("b"), "weight")
        edges.append(_linked(_pairs_of_small(rows).unionByName(star.select("a", "b")), crowded, similarity, threshold))
        members = stored(star.join(edges[-1], ["a", "b"], "left_anti").select("key", F.col("b").alias("node"), "weight"), "members")
        discard(rows)
        if not members.limit(1).count():
            break
    edges.append(_links_across(prefixes.select("key", "node"), sketches.drop("runs"), components(_union(edges)), weights, threshold))
    discard(crowded, sketches, prefixes)
    return edges


def _union(tables: list[DataFrame]) -> DataFrame:
    rows = tables[0]
    for more in tables[1:]:
        rows = rows.unionByName(more)
    return rows


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with class_id (least doc_id of its class), class_size and representative (true for one row of each class)."""
    column = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # stored, so that a row keeps its number on each reading
    numbered = stored(docs.select(F.struct("*").alias("doc"), *text_keys(column), F.monotonically_increasing_id().alias("row")), "numbered")
    column = F.coalesce(F.col(f"doc.`{text}`"), F.lit(""))
    keyed = numbered.select("k1", "k2", "row", column.alias("text"), F.col(f"doc.`{doc_id}`").alias("id"))
    weights = run_weights(keyed.select("text"))
    nodes = keyed.select("k1", "k2", "row", "id", _band_column(weights)("text").alias("bands"))
    nodes = nodes.groupBy("k1", "k2").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("least"), F.min("row").alias("row"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"))
    nodes = stored(nodes.select(F.struct("k1", "k2").alias("node"), "least", "row", "n", "bands"), "nodes")
    members = nodes.select(F.explode("bands").alias("key"), "node")
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    members = stored(members.join(shared.drop("m"), "key"), "buckets")
    wanted = members.select("node").distinct().join(nodes.select("node", "row"), "node").select("node.k1", "node.k2", "row")
    texts = stored(keyed.select("k1", "k2", "row", "text").join(wanted, ["k1", "k2", "row"]).select(F.struct("k1", "k2").alias("node"), "text"), "texts")
    edges = _links(members, texts, weights, threshold)
    discard(members)
    labels = components(_union(edges))
    discard(texts, *edges)
    # a node without a word stands for documents that are classes of their own
    member = nodes.join(labels, "node", "left").select("node", "least", "n", (F.size("bands") > 0).alias("worded"), F.coalesce("label", "node").alias("label"))
    classes = member.where("worded").groupBy("label").agg(F.min("least").alias("first"), F.sum("n").alias("size"))
    member = stored(member.join(classes, "label", "left").select("node.k1", "node.k2", "first", "size"), "classes")
    discard(nodes)
    rows = numbered.join(member, ["k1", "k2"], "left")
    low = {"class_id", "class_size", "representative"}
    return rows.select(
        *[F.col(f"doc.`{c}`") for c in docs.columns if c.lower() not in low],
        F.when(F.col("first").isNull(), F.col(f"doc.`{doc_id}`")).otherwise(F.col("first.id")).alias("class_id"),
        F.coalesce("size", F.lit(1).cast("long")).alias("class_size"),
        (F.col("first").isNull() | (F.col("first.row") == F.col("row"))).alias("representative"),
    )
