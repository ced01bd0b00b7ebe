"""Quality by a factorisation machine over hashed words, structure statistics and metadata.

A text is a sparse vector x: its words, lower-cased and hashed to WORD_BUCKETS entries,
with their counts scaled to length 1; and for each statistic of its structure, and for
its metadata n_chars, one of BINS entries by quantiles of the sample's distinct values. With a weight w_i
and a row v_i of FACTORS numbers for each entry,

  y(x) = w_0 + sum of w_i x_i + sum over pairs i < j of <v_i, v_j> x_i x_j

and the score is 1 / (1 + exp(-y)). The pairs are summed in linear time, since for each
factor f they come to ((sum of v_if x_i)^2 - sum of v_if^2 x_i^2) / 2.

The machine is fitted on a bounded sample: of either label the TRAIN_DOCS / 2 labelled
documents least by the hash of their id, weighed so that the labels keep their shares
of all labelled documents. Tasks turn the sample's texts into vectors of at most
WORD_BUCKETS entries, and these are fitted by Adam over small batches; each fifth
document is kept back, and the epoch that predicts those best stays. Scoring covers
every whole text, in blocks of a quarter of a megabyte.

Cases: a null or empty text has no words and statistics of 0, and is scored by its
bins. A null n_chars has a bin of its own value -1. Documents of null id or null label
aren't learned from but scored; a doc_id with both labels, or on several documents, is
learned from as often as it occurs. If a label has no document in the sample, every
score is the share of label 1 (0 without any). Extra columns stay; a column named like
the result is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexgraph.llm.runtime import replaced, stored
from plexgraph.llm.textvec import LOWER, PLAIN_CHAR, blocks, span_hashes, string_bytes, words

TRAIN_DOCS = 8000
WORD_BUCKETS, BINS, FACTORS = 4096, 16, 8
EPOCHS, BATCH, RATE, DECAY = 30, 256, 0.02, 1e-4
#: What a bin counts beside the words' length of 1.
BIN_VALUE = 0.5

DIGIT, UPPER, SYMBOL, POINT, HIGH = (np.zeros(256, bool) for _ in range(5))
DIGIT[48:58] = UPPER[65:91] = HIGH[128:] = True
SYMBOL[[ord(c) for c in "#*$%&|<>@^~_=+\\{}[]"]] = True
POINT[[ord(c) for c in ".,;:!?"]] = True
STATISTICS = ("bytes", "words", "lines", "word length", "symbols", "digits", "upper case", "points", "other bytes", "words seen before", "words as the one before", "longest run", "lines seen before", "line length", "n_chars")


def _counts(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each row are flagged."""
    total = np.r_[0, np.cumsum(flags)]
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(code: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """How many items of each row equal an earlier one of the row."""
    order = np.lexsort((code, row))
    again = np.r_[False, (code[order][1:] == code[order][:-1]) & (row[order][1:] == row[order][:-1])] if len(code) else np.zeros(0, bool)
    return np.bincount(row[order][again], minlength=n)


def vectors(text: pa.Array, n_chars: np.ndarray):
    """(statistics, word counts a row, hashed words, their values) of some texts; n_chars is -1 where it is null."""
    data, offsets = string_bytes(text)
    n, low = len(text), LOWER[data]
    start, end, row = words(low, offsets, PLAIN_CHAR)
    code = span_hashes(low, start, end)
    size = np.diff(offsets)
    n_words, per = np.bincount(row, minlength=n), np.maximum(size, 1)
    many = np.maximum(n_words, 1)
    same = np.r_[False, (code[1:] == code[:-1]) & (row[1:] == row[:-1])] if len(code) else np.zeros(0, bool)
    fresh = np.flatnonzero(~same)
    longest = np.zeros(n)
    np.maximum.at(longest, row[fresh], np.diff(np.r_[fresh, len(code)]))
    newline = np.zeros(256, bool)
    newline[:] = True
    newline[10] = False
    l_start, l_end, l_row = words(data, offsets, newline)
    n_lines = np.bincount(l_row, minlength=n)
    shares = [_counts(table[data], offsets) / per for table in (SYMBOL, DIGIT, UPPER, POINT, HIGH)]
    stats = [np.log1p(size), np.log1p(n_words), np.log1p(n_lines), np.bincount(row, end - start, n) / many, *shares, _repeats(code, row, n) / many]
    stats += [np.bincount(row[same], minlength=n) / many, np.log1p(longest), _repeats(span_hashes(data, l_start, l_end), l_row, n) / np.maximum(n_lines, 1), np.log1p(size / np.maximum(n_lines, 1))]
    stats.append(np.where(n_chars < 0, -1.0, np.log1p(np.maximum(n_chars, 0))))
    key, count = np.unique(row * WORD_BUCKETS + (code % np.uint64(WORD_BUCKETS)).astype(np.int64), return_counts=True)
    owner = key // WORD_BUCKETS
    length = np.sqrt(np.bincount(owner, count.astype(float) ** 2, n))
    return np.stack(stats, 1), np.bincount(owner, minlength=n), (key % WORD_BUCKETS).astype(np.int32), (count / length[owner]).astype(np.float32)


class Machine:
    """Entries: WORD_BUCKETS words, then BINS of each statistic."""

    def __init__(self, edges: np.ndarray, seed: int = 7):
        """edges: for each statistic the BINS - 1 values that part its bins."""
        entries = WORD_BUCKETS + BINS * len(edges)
        self.edges, self.bias, self.linear = edges, 0.0, np.zeros(entries)
        self.factors = np.random.default_rng(seed).normal(0, 0.02, (entries, FACTORS))

    def rows(self, stats: np.ndarray, n_words: np.ndarray, word: np.ndarray, value: np.ndarray):
        """(first place, entries, values) of each text's vector: a bin of each statistic, then the words."""
        n, m = stats.shape
        bins = np.stack([np.searchsorted(e, stats[:, k], "right") + WORD_BUCKETS + BINS * k for k, e in enumerate(self.edges)], 1)
        first = np.cumsum(n_words + m) - (n_words + m)
        entry, x = np.empty(len(word) + n * m, np.int64), np.full(len(word) + n * m, BIN_VALUE)
        own = np.zeros(len(entry), bool)
        own[(first[:, None] + np.arange(m)).ravel()] = True
        entry[own], entry[~own], x[~own] = bins.ravel(), word, value
        return first, entry, x

    def raw(self, first: np.ndarray, entry: np.ndarray, x: np.ndarray):
        """(y, sums of each factor) of each text, by the sum of squares identity."""
        part = self.factors[entry] * x[:, None]
        sums = np.add.reduceat(part, first)
        squares = np.add.reduceat((part * part).sum(1), first)
        return self.bias + np.add.reduceat(self.linear[entry] * x, first) + ((sums * sums).sum(1) - squares) / 2, sums

    def gradient(self, first, entry, x, label, weight):
        y, sums = self.raw(first, entry, x)
        off = weight * (1 / (1 + np.exp(-np.clip(y, -30, 30))) - label)
        size = np.diff(np.r_[first, len(entry)])
        each = np.repeat(off, size) * x
        entries = len(self.linear)
        bent = np.repeat(sums, size, 0) - self.factors[entry] * x[:, None]
        pairs = np.stack([np.bincount(entry, each * bent[:, f], entries) for f in range(FACTORS)], 1)
        return off.sum(), np.bincount(entry, each, entries), pairs

    def probability(self, *vector) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(*self.rows(*vector))[0], -30, 30))) if len(vector[0]) else np.zeros(0)

    def scores(self, text: pa.Array, n_chars: pa.Array) -> np.ndarray:
        _, offsets = string_bytes(text)
        chars, out = n_chars.fill_null(-1).to_numpy(), np.zeros(len(text))
        for a, b in blocks(offsets):
            out[a:b] = self.probability(*vectors(text.slice(a, b - a), chars[a:b]))
        return out


def _taken(ids: np.ndarray, at: np.ndarray, *columns):
    """Some texts of a sample in the form that Machine.rows takes."""
    stats, n_words, word, value = columns
    pick = np.repeat(at[ids], n_words[ids]) + np.arange(n_words[ids].sum()) - np.repeat(np.cumsum(n_words[ids]) - n_words[ids], n_words[ids])
    return stats[ids], n_words[ids], word[pick], value[pick]


def learn(stats: np.ndarray, n_words: np.ndarray, word: np.ndarray, value: np.ndarray, label: np.ndarray, weight: np.ndarray) -> Machine:
    """The machine of the epoch that predicts each fifth text best."""
    machine = Machine(np.stack([np.quantile(np.unique(x), np.arange(1, BINS) / BINS) for x in stats.T]))
    at, back, dice = np.cumsum(n_words) - n_words, np.arange(len(label)) % 5 == 0, np.random.default_rng(11)
    rest = np.flatnonzero(~back) if back.any() and not back.all() else np.arange(len(label))
    held = np.flatnonzero(back)
    share = np.average(label, weights=weight)
    machine.bias = float(np.log(share / (1 - share)))
    names, moved, step, best = ("bias", "linear", "factors"), {}, 0, (np.inf, None)
    for _ in range(EPOCHS):
        dice.shuffle(rest)
        for k in range(0, len(rest), BATCH):
            ids = rest[k : k + BATCH]
            vector = machine.rows(*_taken(ids, at, stats, n_words, word, value))
            step += 1
            for name, slope in zip(names, machine.gradient(*vector, label[ids], weight[ids]), strict=True):
                slope = slope / len(ids) + (DECAY * getattr(machine, name) if name != "bias" else 0)
                mean, square = moved.get(name, (0.0, 0.0))
                mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope * slope
                moved[name] = mean, square
                setattr(machine, name, getattr(machine, name) - RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8))
        p = np.clip(machine.probability(*_taken(held, at, stats, n_words, word, value)), 1e-9, 1 - 1e-9)
        loss = -np.average(np.where(label[held] == 1, np.log(p), np.log(1 - p)), weights=weight[held])
        if loss < best[0]:
            best = loss, {name: np.copy(getattr(machine, name)) for name in names}
    for name in names if best[1] else ():
        setattr(machine, name, best[1][name])
    return machine


def _inputs(docs: DataFrame, text: str, n_chars: str):
    """Text and metadata as columns; without a column n_chars it is counted."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return body, F.col(f"`{n_chars}`").cast("long") if n_chars in docs.columns else F.length(body).cast("long")


def _vector_rows(batches):
    for batch in batches:
        text, chars = batch.column("text"), batch.column("n_chars").fill_null(-1).to_numpy()
        for a, b in blocks(string_bytes(text)[1]):
            stats, n_words, word, value = vectors(text.slice(a, b - a), chars[a:b])
            at = pa.array(np.r_[0, np.cumsum(n_words)].astype(np.int32))
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, stats.size + 1, stats.shape[1]).astype(np.int32)), pa.array(stats.ravel())), pa.ListArray.from_arrays(at, pa.array(word)), pa.ListArray.from_arrays(at, pa.array(value))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("label").slice(a, b - a), *lists], ["doc_id", "label", "stats", "word", "value"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", n_chars: str = "n_chars", train_docs: int = TRAIN_DOCS) -> Machine | float:
    """A machine of docs (doc_id, text, n_chars) and labels (doc_id, label 0 or 1), or the share of label 1 where a label is missing."""
    labels = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label")).distinct()
    totals = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    chosen = F.broadcast(labels.where("label = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs // 2).unionByName(labels.where("label = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs // 2)))
    body, chars = _inputs(docs, text, n_chars)
    rows = docs.select("doc_id", body.alias("text"), chars.alias("n_chars")).join(chosen, "doc_id")
    sample = stored(rows.select("doc_id", "label", "text", "n_chars").mapInArrow(_vector_rows, "doc_id long, label int, stats array<double>, word array<int>, value array<float>"), "vectors-of-texts")
    table = sample.orderBy(F.xxhash64("doc_id"), "doc_id", "label", "stats").toArrow().combine_chunks()
    y = table.column("label").to_numpy()
    if len(np.unique(y)) < 2:
        return float(y.mean()) if len(y) else 0.0
    stats, word, value = (table.column(c).combine_chunks() for c in ("stats", "word", "value"))
    share = {k: totals[k] / sum(totals.values()) / np.mean(y == k) for k in (0, 1)}
    return learn(stats.flatten().to_numpy().reshape(len(y), -1), np.asarray(word.value_lengths()).astype(np.int64), word.flatten().to_numpy(), value.flatten().to_numpy(), y, np.where(y == 1, share[1], share[0]))


def score(docs: DataFrame, machine: Machine | float, text: str = "text", n_chars: str = "n_chars", to: str = "score") -> DataFrame:
    """docs with the score of each text, 0 to 1."""
    if isinstance(machine, float):
        return replaced(docs, {to: F.lit(machine)})
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    scores = F.arrow_udf(lambda texts, chars: pa.array(shared.value.scores(texts, chars)), "double")
    return replaced(docs, {to: scores(*_inputs(docs, text, n_chars))})
