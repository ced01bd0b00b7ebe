"""Hard negatives by a full sort of each anchor's scores.

Vectors become whole numbers, floor(scale * x), and a score is the inner product of
two of them. A block of rows is scored against a chunk of anchors, and each anchor's
scores are sorted whole, higher first and equal ones by id (lexsort). Of the sorted
block, an anchor takes its first rows of the same label, and blocks are merged to its
positives. In a second pass the same sorted blocks are read from the place that a
binary search finds for each positive's upper limit: the first rows of other labels,
down to the lower limit. Merged over the blocks, these are the negatives.

A chunk holds CHUNK_VALUES components of anchors at most on the average and is
broadcast; chunks follow each other, and each is one job over all rows. A task gets
about SCORES_A_TASK scores, in blocks of at most BLOCK_ROWS rows; a block hands on no
more than a few rows an anchor. So memory is bounded for any number of rows and
anchors, while the work is their product.

Cases: rows with a null label, a null vector, or a null or non-finite component take
no part. A null id is no anchor, and of equal scores it comes last; rows of equal ids
are rows of their own, ordered by where they lie. Vectors of other lengths than the
anchor's have no score with it; empty vectors score 0. Components and scores stay
within a long: what is beyond counts as its end. Columns beside the three are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexgraph.llm.runtime import shared_folder, stored

POSITIVES, NEGATIVES = 5, 3
SCALE = 256
#: Least and greatest score of a negative, as hundredths of the positive's.
LOW, HIGH = 50, 95
CHUNK_VALUES = 4_000_000
SCORES_A_TASK, MOST_TASKS = 8_000_000, 20_000
BLOCK_ROWS, BLOCK_SCORES = 8192, 1 << 20
_MIN, _MAX = -(1 << 63), (1 << 63) - 1
_CANDIDATES = "anchor long, row long, id long, score long"
_FOUND = "anchor long, positive long, id long, row long, score long"


def prepared(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str | Column = "label", scale: int = SCALE) -> DataFrame:
    """(row, id, label, vector) of the rows that take part, with whole components; stored, so that row names a row for good."""
    named = rows.select(F.col(id).cast("long").alias("id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = named.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & ~odd)
    return stored(whole.select(F.monotonically_increasing_id().alias("row"), "id", "label", F.transform("vector", lambda x: F.floor(x * scale)).alias("vector")), "vectors")


def _matrices(batch: pa.RecordBatch):
    """(row numbers in the batch, matrix) of the vectors of each length."""
    lists = batch.column("vector")
    values = lists.flatten().to_numpy(zero_copy_only=False)
    size = np.asarray(lists.value_lengths())
    start = np.cumsum(size) - size
    for d in np.unique(size):
        here = np.flatnonzero(size == d)
        yield int(d), here, values[start[here][:, None] + np.arange(d)]


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two matrices of whole numbers, kept within a long."""
    d = a.shape[1]
    most = lambda x: max(int(x.max()), -int(x.min())) if x.size else 0
    if most(a) * most(b) * d < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)  # exact: no sum leaves the whole numbers of a double
    exact = a.astype(object) @ b.T.astype(object)
    return np.vectorize(lambda x: min(max(x, _MIN), _MAX), otypes=[np.int64])(exact)


def by_score_and_id(score: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The order of an anchor's scores: higher first, equal ones by place, which is the order of ids."""
    return np.lexsort((place, ~score))


class Anchors:
    """A chunk of anchors by the length of their vectors, and for the second pass the limits of their positives."""

    def __init__(self, table: pa.Table, positives: pa.Table | None = None):
        self.groups = {}
        table = table.combine_chunks()
        limits: dict[int, list] = {}
        if positives is not None:
            for anchor, row, score in zip(*(positives.column(c).to_pylist() for c in ("anchor", "row", "score")), strict=True):
                limits.setdefault(anchor, []).append((row, -(-LOW * score // 100), HIGH * score // 100))
        for batch in table.to_batches():
            for d, here, matrix in _matrices(batch):
                row, label = batch.column("row").to_numpy()[here], batch.column("label").to_numpy()[here]
                self.groups.setdefault(d, []).append((row, label, matrix, [limits.get(int(r), []) for r in row]))


def _blocks(batches):
    """(length, row, id, null id, label, matrix) of at most BLOCK_ROWS rows in the order of their ids."""
    for batch in batches:
        for first in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(first, BLOCK_ROWS)
            ids = part.column("id")
            null, known = np.asarray(ids.is_null()), ids.fill_null(0).to_numpy()
            row, label = part.column("row").to_numpy(), part.column("label").to_numpy()
            for d, here, matrix in _matrices(part):
                order = np.lexsort((row[here], known[here], null[here]))
                here, matrix = here[order], matrix[order]
                yield d, row[here], known[here], null[here], label[here], matrix


def _positives_of(shared, most: int):
    """Candidates for positives: an anchor's first rows of its label in each block."""

    def run(batches):
        for d, row, ids, null, label, matrix in _blocks(batches):
            for a_row, a_label, a_matrix, _ in shared.value.groups.get(d, ()):
                found = []
                for value in np.intersect1d(a_label, label):
                    rows, own = np.flatnonzero(label == value), np.flatnonzero(a_label == value)
                    for k in range(0, len(own), step := max(1, BLOCK_SCORES // len(rows))):
                        part = own[k : k + step]
                        for a, score in zip(part, scores(a_matrix[part], matrix[rows]), strict=True):
                            first = by_score_and_id(score, rows)[: most + 1]
                            first = first[row[rows[first]] != a_row[a]][:most]
                            found.append((np.full(len(first), a_row[a]), rows[first], score[first]))
                yield from _batch(found, row, ids, null, ["anchor"])

    return run


def _negatives_of(shared, most: int):
    """Candidates for negatives: of the sorted rows of other labels, the first ones from each positive's upper limit down to its lower."""

    def run(batches):
        for d, row, ids, null, label, matrix in _blocks(batches):
            place = np.arange(len(row))
            for a_row, a_label, a_matrix, a_limits in shared.value.groups.get(d, ()):
                found = []
                for k in range(0, len(a_row), step := max(1, BLOCK_SCORES // len(row))):
                    for a, score in enumerate(scores(a_matrix[k : k + step], matrix), k):
                        if not a_limits[a]:
                            continue
                        order = by_score_and_id(score, place)
                        order = order[label[order] != a_label[a]]
                        falling = ~score[order]
                        for positive, low, high in a_limits[a]:
                            if low > high:
                                continue
                            at = np.searchsorted(falling, ~np.int64(high))
                            first = order[at : at + most]
                            first = first[score[first] >= low]
                            found.append((np.full(len(first), a_row[a]), np.full(len(first), positive), first, score[first]))
                yield from _batch(found, row, ids, null, ["anchor", "positive"])

    return run


def _batch(found: list, row: np.ndarray, ids: np.ndarray, null: np.ndarray, keys: list[str]):
    if not found:
        return
    *named, at, score = (np.concatenate(x) for x in zip(*found, strict=True))
    columns = dict(zip(keys, map(pa.array, named), strict=True))
    columns |= {"row": pa.array(row[at]), "id": pa.array(ids[at], mask=null[at]), "score": pa.array(score)}
    order = (_CANDIDATES if len(keys) == 1 else _FOUND).replace(" long", "").split(", ")
    yield pa.RecordBatch.from_arrays([columns[c] for c in order], order)


def _first(candidates: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The first rows of each key over all blocks, with their rank."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, **columns) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows for which `anchors`, a condition on id, holds.

    columns: id, vector, label and scale, as prepared() takes them.
    """
    spark = rows.sparkSession
    table = prepared(rows, **columns)
    chosen = table.where(anchors & F.col("id").isNotNull())
    values, n_anchors = chosen.agg(F.coalesce(F.sum(F.size("vector") + 4), F.lit(0)), F.count(F.lit(1))).first()
    n_rows = table.count()
    chunks = max(1, -(-values // CHUNK_VALUES))
    tasks = min(MOST_TASKS, max(1, n_rows * n_anchors // chunks // SCORES_A_TASK))
    dealt = table.repartition(tasks, "row")
    out = f"{shared_folder(spark)}/plexgraph/hard-negatives-{uuid.uuid4().hex}"
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(out)
    for k in range(chunks):
        part = chosen.where(F.pmod(F.xxhash64("row"), F.lit(chunks)) == k)
        held = part.select("row", "label", "vector").toArrow()
        first = spark.sparkContext.broadcast(Anchors(held))
        best = stored(_first(dealt.mapInArrow(_positives_of(first, positives), _CANDIDATES), ["anchor"], positives), "positives")
        second = spark.sparkContext.broadcast(Anchors(held, best.select("anchor", "row", "score").toArrow()))
        found = _first(dealt.mapInArrow(_negatives_of(second, negatives), _FOUND), ["anchor", "positive"], negatives)
        named = best.select("anchor", F.col("row").alias("positive"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        result = found.join(named, ["anchor", "positive"]).join(part.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
        result.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(out)
        first.unpersist()
        second.unpersist()
    return spark.read.schema(schema).parquet(out)
