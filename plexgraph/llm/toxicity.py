"""Toxicity by class-conditional Kneser-Ney models.

An expression is a word, read byte by byte: a symbol is a byte or the word's end, and
its context the ORDER - 1 symbols before it, padded where the word begins. One model of
toxic and one of ordinary documents are interpolated Kneser-Ney models whose backoff
counts they share. With c_k the counts of a symbol in its context in class k, c those of
both classes, types(...) the distinct symbols of a context, and shorter(v) a context
without its first symbol:

  p_k(s | v)   = (max(c_k(v s) - D_k, 0) + D_k types_k(v) both(s | v)) / c_k(v)
  both(s | v)  = (max(c(v s) - D, 0) + D types(v) lower(s | shorter(v))) / c(v)
  lower(s | v) = the same over continuation counts (in how many longer contexts v s is
                 seen), down to no context, and last the same for all 257 symbols

A level's discount follows from its counts of counts, n1 / (n1 + 2 n2), and lies between
0 and 1 (0.75 where either is missing). So a symbol that a class hasn't seen in a
context has what the class's discounts leave, dealt out as both classes together use
it, and a context that a class has never seen tells nothing. A text's features are the
difference of the two log-likelihoods divided by the number of its words, and the
difference of its most toxic word; a logistic function of both, with weights of 0 or
more, is the score.

The models are fitted on a bounded sample: of either class the TRAIN_DOCS / 2 labelled
documents least by the hash of their id, each third of which calibrates; of the others
those whose bytes come to TRAIN_BYTES a class, none longer than an eighth of that. Tasks
count the words; a model has at most one entry a byte of the sample, and is broadcast
under that bound. Calibration weighs the classes by their shares of all labelled rows.
Scoring covers every whole text; each distinct word of a block is scored once.

Cases: a null or empty text, or one without words, has the features 0. Documents of
null id or null label aren't learned from but scored; a doc_id with both labels, or
on several documents, is learned from as often as it occurs. If a class has no
labelled document, every score is the share of toxic documents in the sample
(0 without any).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexgraph.llm.runtime import replaced, stored
from plexgraph.llm.textvec import LOWER, PLAIN_CHAR, blocks, mix64, span_hashes, string_bytes, words

TRAIN_DOCS = 6000
TRAIN_BYTES = 6_000_000
#: Symbols of a context and the one that follows it.
ORDER = 10
END, START, SYMBOLS = 256, 257, 257

_STEP = 0x9E3779B97F4A7C15


def held_out(doc_id: str = "doc_id", parts: int = 5, part: int = 0) -> Column:
    """Whether crc32 of the id as text leaves this remainder (a null id: as the text is empty)."""
    return F.crc32(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).cast("binary")) % parts == part


def _symbols(data: np.ndarray, start: np.ndarray, end: np.ndarray):
    """(symbol, word) of the bytes of some words and of their ends."""
    size = end - start + 1
    word = np.repeat(np.arange(len(start)), size)
    place = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
    last = place == size[word] - 1
    symbol = np.full(len(word), END, np.int64)
    symbol[~last] = data[(start[word] + place)[~last]]
    return symbol, word, place


def _contexts(symbol: np.ndarray, place: np.ndarray, orders, at: np.ndarray | None = None) -> dict[int, np.ndarray]:
    """Of each symbol, or of those at some places, the hash of its context, for models of these orders."""
    at = np.arange(len(symbol)) if at is None else at
    total, out = np.zeros(len(at), np.uint64), {}
    for k in range(1, max(orders) + 1):
        if k > 1:
            before = np.full(len(at), START, np.uint64)
            inside = np.flatnonzero(place[at] >= k - 1)
            before[inside] = symbol[at[inside] - (k - 1)]
            total = total + (before + np.uint64(1)) * np.uint64(pow(_STEP, k - 1, 1 << 64))
        if k in orders:
            out[k] = mix64(total + np.uint64(k))
    return out


def _grams(context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    return mix64(context * np.uint64(1_000_003) + symbol.astype(np.uint64))


def _places(sorted_keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted key, or len(sorted_keys)."""
    if not len(sorted_keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == wanted, at, len(sorted_keys))


class Level:
    """Absolutely discounted counts of symbols in contexts: what a context keeps for its symbols and what it leaves to the backoff."""

    def __init__(self, context: np.ndarray, count: np.ndarray):
        """context, count: of each distinct symbol in a context; one of count 0 isn't seen here."""
        seen = count > 0
        once, twice = int((count == 1).sum()), int((count == 2).sum())
        self.discount = once / (once + 2 * twice) if once and twice else 0.75
        self.contexts, self.at = np.unique(context, return_inverse=True)
        total = np.bincount(self.at, count, len(self.contexts))
        types = np.bincount(self.at[seen], minlength=len(self.contexts))
        self.total = np.maximum(total, 1)
        self.back = np.where(total > 0, self.discount * types / self.total, 1.0)

    def probability(self, count: np.ndarray, backoff: np.ndarray) -> np.ndarray:
        return np.maximum(count - self.discount, 0) / self.total[self.at] + self.back[self.at] * backoff


class Model:
    """Differences of log-likelihoods of the symbols seen in a context, and of contexts for the others, as sorted tables of hashes."""

    def __init__(self, word: pa.Array, toxic: np.ndarray, n: np.ndarray, order: int = ORDER):
        """n occurrences of each word in documents of a class."""
        self.order = order
        data, offsets = string_bytes(word)
        symbol, of, place = _symbols(data, offsets[:-1], offsets[1:])
        top = _contexts(symbol, place, (order,))[order]
        self.grams, first, at = np.unique(_grams(top, symbol), return_index=True, return_inverse=True)
        counts = [np.bincount(at, np.where(toxic[of] == k, n[of], 0), len(self.grams)) for k in (0, 1)]
        lower = self._lower(_contexts(symbol, place, range(1, order), first), symbol[first], order)
        context = top[first]
        shared = Level(context, counts[0] + counts[1])
        both = shared.probability(counts[0] + counts[1], lower)
        classes = [Level(context, c) for c in counts]
        self.contexts = shared.contexts
        ratio = lambda pair: (np.log(pair[1]) - np.log(pair[0])).astype(np.float32)
        self.gram_ratio = ratio([level.probability(c, both) for level, c in zip(classes, counts, strict=True)])
        self.context_ratio = np.r_[ratio([level.back for level in classes]), np.float32(0)]
        self.weights = np.zeros(3)

    @staticmethod
    def _lower(contexts: dict[int, np.ndarray], symbol: np.ndarray, order: int) -> np.ndarray:
        """The probability of each symbol by the models of continuation counts below an order, from the shortest context up."""
        chain = []
        for k in range(order - 1, 0, -1):  # the distinct symbols in shorter contexts, and how many longer ones have each
            _, first, at = np.unique(_grams(contexts[k], symbol), return_index=True, return_inverse=True)
            chain.append((at, np.bincount(at), contexts[k][first]))
            contexts, symbol = {j: v[first] for j, v in contexts.items() if j < k}, symbol[first]
        p = np.full(len(symbol), 1 / SYMBOLS)
        for at, count, context in reversed(chain):
            p = Level(context, count).probability(count, p)[at]
        return p

    def __getstate__(self) -> dict:
        """What scoring needs."""
        return {k: getattr(self, k) for k in ("order", "grams", "contexts", "gram_ratio", "context_ratio", "weights")}

    def word_ratios(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The difference of each word's log-likelihoods under the two models."""
        symbol, of, place = _symbols(data, start, end)
        context = _contexts(symbol, place, (self.order,))[self.order]
        at = _places(self.grams, _grams(context, symbol))
        ratio = np.r_[self.gram_ratio, np.float32(0)][at].astype(np.float64)
        new = np.flatnonzero(at == len(self.grams))
        ratio[new] = self.context_ratio[_places(self.contexts, context[new])]
        return np.bincount(of, ratio, len(start))

    def features(self, text: pa.Array) -> np.ndarray:
        """(difference of the log-likelihoods by the words, difference of the most toxic word) of each text."""
        data, offsets = string_bytes(text)
        out = np.zeros((len(text), 2))
        for a, b in blocks(offsets):
            part = LOWER[data[offsets[a] : offsets[b]]]
            start, end, row = words(part, offsets[a : b + 1] - offsets[a], PLAIN_CHAR)
            if not len(row):
                continue
            _, one, at = np.unique(span_hashes(part, start, end), return_index=True, return_inverse=True)
            ratio = self.word_ratios(part, start[one], end[one])[at]
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            out[a + row[first]] = np.stack([np.add.reduceat(ratio, first) / np.diff(np.r_[first, len(row)]), np.maximum.reduceat(ratio, first)], 1)
        return out

    def calibrate(self, features: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> None:
        """A logistic function of the features; a feature whose weight came out below 0 is left out."""
        used = [0, 1]
        while True:
            x = np.c_[features[:, used], np.ones(len(features))]
            w = np.zeros(x.shape[1])
            for _ in range(30):
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                slope = x.T @ (weight * (p - toxic)) + 1e-2 * np.r_[w[:-1], 0]
                bend = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
                w -= np.linalg.solve(bend, slope)
            kept = [k for k, v in zip(used, w, strict=False) if v >= 0]
            if kept == used:
                break
            used = kept
        self.weights = np.zeros(3)
        self.weights[[*used, 2]] = w

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.c_[features, np.ones(len(features))] @ self.weights, -30, 30)))


def _word_counts(batches):
    """(toxic, word) of each word of some texts."""
    for batch in batches:
        data, offsets = string_bytes(batch.column("text"))
        toxic = batch.column("toxic").to_numpy()
        for a, b in blocks(offsets):
            part = LOWER[data[offsets[a] : offsets[b]]]
            start, end, row = words(part, offsets[a : b + 1] - offsets[a], PLAIN_CHAR)
            size = end - start
            at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
            ends = pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int32).tobytes())
            word = pa.Array.from_buffers(pa.binary(), len(start), [None, ends, pa.py_buffer(part[at].tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(toxic[a + row].astype(np.int32)), word], ["toxic", "word"])


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> Model | float:
    """A model of docs (doc_id, text) and labels (doc_id, toxic), or the share of toxic rows where a class is missing.

    The sample is chosen among the labels alone, so that it can be broadcast to
    the documents (train_docs rows at most) and no text is shuffled.
    """
    labels = labels.where("doc_id is not null and toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    totals = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    alike = [labels.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs // 2) for label in (0, 1)]
    chosen = F.broadcast(alike[0].unionByName(alike[1]))
    found = docs.where("text is not null").select("doc_id", "text").join(chosen, "doc_id").withColumn("row", F.monotonically_increasing_id())
    rows = stored(found, "labelled")
    calibrates = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0
    sizes = rows.where(~calibrates).select("row", "doc_id", "toxic", F.octet_length("text").cast("long").alias("size")).where(F.col("size") <= train_bytes // 8)
    upto = F.sum("size").over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0))
    learned = sizes.withColumn("upto", upto).where(F.col("upto") <= train_bytes).select("row")  # of at most train_docs rows
    counts = rows.join(F.broadcast(learned), "row", "left_semi").select("text", "toxic").mapInArrow(_word_counts, "toxic int, word binary")
    table = counts.groupBy("toxic", "word").agg(F.count(F.lit(1)).alias("n")).toArrow().combine_chunks()  # of at most 2 * train_bytes
    toxic, n = table.column("toxic").to_numpy(), table.column("n").to_numpy()
    share = rows.agg(F.avg("toxic")).first()[0] or 0.0
    if not 0 < share < 1 or len(np.unique(toxic)) < 2:
        return float(share)
    model = Model(table.column("word").combine_chunks(), toxic, n)
    rest = rows.where(calibrates).select("toxic", "text")
    held = rest.select("toxic", _feature_column(rest.sparkSession.sparkContext.broadcast(model))("text").alias("x")).toArrow()
    if len(held):
        label = held.column("toxic").to_numpy()
        weights = np.array([totals[k] / sum(totals.values()) / max(np.mean(label == k), 1e-9) for k in (0, 1)])
        model.calibrate(np.array(held.column("x").to_pylist()), label, weights[label])
    return model


def _feature_column(model):
    def features(text: pa.Array) -> pa.Array:
        return pa.FixedSizeListArray.from_arrays(pa.array(model.value.features(text).ravel()), 2).cast(pa.list_(pa.float64()))

    return F.arrow_udf(features, "array<double>")


def score(docs: DataFrame, model: Model | float, text: str = "text", to: str = "score") -> DataFrame:
    """docs with the score of each text, 0 to 1."""
    if isinstance(model, float):
        return replaced(docs, {to: F.lit(model)})
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scores = F.arrow_udf(lambda texts: pa.array(shared.value.score(shared.value.features(texts))), "double")
    return replaced(docs, {to: scores(F.coalesce(F.col(f"`{text}`"), F.lit("")))})
