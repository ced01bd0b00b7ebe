"""Masked pseudo-likelihood of texts under a bidirectional window network.

Each word is predicted from the two words before and the two after it: their
embeddings go through one hidden layer to a softmax over 32 classes and one over
the 32 entries of the class. The sum of the conditional log-probabilities is the
pseudo-log-likelihood of a text.

The TOP words most frequent in all documents have an entry of the network each;
the other words share VOCABULARY - TOP entries by their hash. Within a shared entry
a word has the probability of its count over that of the entry, counted over all
documents. Own counts are held for the most frequent TAIL * sqrt(words of the
corpus) words, so that this table grows with the input; the words beyond it, and
one unseen word, have equal parts of what is left of their entry. So the
probabilities of all words add up to 1.

The network is trained in numpy by ROUNDS rounds: from one common start each task
goes through all its documents, and Spark averages the tasks' parameters, weighted
by targets. Each word is a target in one of the rounds, which its place in the
document and the document's first word decide. How rows are dealt to tasks shapes
the averages, so reruns over other partitions differ a little.

Cases: a null or empty text, or one without words, has n_words 0, pll 0 and a
null mean_pll. Repeated rows count as often as they occur. An empty table leaves
the network at its start.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexgraph.llm.runtime import discard, stored
from plexgraph.llm.textvec import LOWER, PLAIN_CHAR, blocks, span_hashes, string_bytes, words

VOCABULARY, TOP = 1024, 960
CLASSES = 32
SIDE, WIDTH, HIDDEN = 2, 12, 32
#: Words with a count of their own: this many times the square root of all words.
TAIL = 8
ROUNDS = 2
RATE = 0.15
BATCH = 4096


def _hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = LOWER[data]
    start, end, row = words(data, offsets, PLAIN_CHAR)
    return span_hashes(data, start, end), row


def _word_counts(batches):
    for batch in batches:
        data, offsets = string_bytes(batch.column(0))
        for a, b in blocks(offsets, 1 << 22):
            code, n = np.unique(_hashed_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(n)], ["word", "n"])


class Vocabulary:
    """Which entry a word (a hash) has, and the logarithm of its share of it."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, totals: np.ndarray, types: np.ndarray, top: int = TOP):
        """words: the most frequent first; totals and types: occurrences and distinct words of the corpus by shared_entry."""
        entry = np.r_[np.arange(min(top, len(words))), TOP + shared_entry(words[top:])]
        totals, types = totals.astype(np.float64), types.astype(np.float64)
        np.subtract.at(totals, shared_entry(words[:top]), counts[:top])
        np.subtract.at(types, shared_entry(words), 1)
        rest = totals.copy()
        np.subtract.at(rest, shared_entry(words[top:]), counts[top:])
        share = np.zeros(len(words))
        share[top:] = np.log(counts[top:] / (totals[entry[top:] - TOP] + 1))
        self.rest = np.log((rest + 1) / (totals + 1) / (types + 1)).astype(np.float32)
        order = np.argsort(words, kind="stable")
        self.known, self.entry, self.share = words[order], entry[order], share[order].astype(np.float32)

    def find(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, logarithm of the share) of each word."""
        shared = shared_entry(code)
        if not len(self.known):
            return TOP + shared, self.rest[shared]
        at = np.minimum(np.searchsorted(self.known, code), len(self.known) - 1)
        is_known = self.known[at] == code
        return np.where(is_known, self.entry[at], TOP + shared), np.where(is_known, self.share[at], self.rest[shared])


def shared_entry(code: np.ndarray) -> np.ndarray:
    return (code & np.uint64(VOCABULARY - TOP - 1)).astype(np.int64)


def vocabulary(texts: DataFrame, top: int = TOP, tail: float = TAIL) -> Vocabulary:
    """From the words of all rows of a one-column DataFrame."""
    counts = texts.mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = stored(counts, "words")
    n = VOCABULARY - TOP
    sums = counts.groupBy(F.col("word").bitwiseAND(n - 1).alias("entry")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("types")).toArrow()  # n rows at most
    totals, types = np.zeros(n), np.zeros(n)
    at = sums.column("entry").to_numpy()
    totals[at], types[at] = sums.column("total").to_numpy(), sums.column("types").to_numpy()
    rows = counts.orderBy(F.desc("n"), "word").limit(top + int(tail * totals.sum() ** 0.5)).toArrow()
    discard(counts)
    return Vocabulary(rows.column("word").to_numpy().view(np.uint64), rows.column("n").to_numpy(), totals, types, top)


class Network:
    SHAPES = {"embed": (VOCABULARY + 1, WIDTH), "inner": (2 * SIDE * WIDTH, HIDDEN), "bias": (1, HIDDEN), "klass": (HIDDEN, CLASSES), "klass_bias": (1, CLASSES), "word": (CLASSES, HIDDEN, VOCABULARY // CLASSES), "word_bias": (CLASSES, VOCABULARY // CLASSES)}

    def __init__(self, words: Vocabulary, seed: int = 5):
        self.words = words
        rng = np.random.default_rng(seed)
        self.p = {n: (rng.normal(0, 0.1, s) if not n.endswith("bias") else np.zeros(s)).astype(np.float32) for n, s in self.SHAPES.items()}

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[n].ravel() for n in self.SHAPES])

    def take(self, values: np.ndarray) -> None:
        at = 0
        for n, s in self.SHAPES.items():
            self.p[n] = values[at : at + int(np.prod(s))].reshape(s).astype(np.float32)
            at += int(np.prod(s))

    def contexts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """(words, target entries, logarithms of their shares, entries of the words around, rows); VOCABULARY stands beyond the ends of a text."""
        code, row = _hashed_words(data, offsets)
        own, share = self.words.find(code)
        around = np.full((len(own), 2 * SIDE), VOCABULARY, np.int64)
        for j, d in enumerate((-2, -1, 1, 2)):
            if len(own) > abs(d):
                here, there = (slice(-d, None), slice(None, d)) if d < 0 else (slice(None, -d), slice(d, None))
                around[here, j] = np.where(row[here] == row[there], own[there], VOCABULARY)
        return code, own, share, around, row

    def log_probabilities(self, own: np.ndarray, around: np.ndarray) -> np.ndarray:
        out = np.empty(len(own), np.float32)
        for a in range(0, len(own), 8192):
            out[a : a + 8192] = self._forward(own[a : a + 8192], around[a : a + 8192])[0]
        return out

    def _forward(self, own, around):
        p = self.p
        x = p["embed"][around].reshape(len(own), -1)
        h = np.tanh(x @ p["inner"] + p["bias"])
        by_class = h @ p["klass"] + p["klass_bias"]
        by_class -= by_class.max(1, keepdims=True)
        np.exp(by_class, out=by_class)
        by_class /= by_class.sum(1, keepdims=True)
        klass, word = own % CLASSES, own // CLASSES
        order = np.argsort(klass.astype(np.uint8), kind="stable")
        cuts = np.searchsorted(klass[order], np.arange(CLASSES + 1))
        sorted_h, by_word = h[order], np.empty((len(own), VOCABULARY // CLASSES), np.float32)
        for c in range(CLASSES):
            if cuts[c] < cuts[c + 1]:
                np.matmul(sorted_h[cuts[c] : cuts[c + 1]], p["word"][c], out=by_word[cuts[c] : cuts[c + 1]])
        by_word += p["word_bias"][klass[order]]
        by_word -= by_word.max(1, keepdims=True)
        np.exp(by_word, out=by_word)
        by_word /= by_word.sum(1, keepdims=True)
        n = np.arange(len(own))
        logs = np.log(by_class[n, klass] + 1e-12)
        logs[order] += np.log(by_word[n, word[order]] + 1e-12)
        return logs, x, h, by_class, by_word, klass, word, order, cuts

    def learn(self, own: np.ndarray, around: np.ndarray, squares: dict) -> None:
        """One step of Adagrad on a batch of targets."""
        p, n = self.p, len(own)
        _, x, h, by_class, by_word, klass, word, order, cuts = self._forward(own, around)
        by_class[np.arange(n), klass] -= 1
        by_word[np.arange(n), word[order]] -= 1
        by_class /= n
        by_word /= n
        g = {"klass": h.T @ by_class, "klass_bias": by_class.sum(0, keepdims=True), "word": np.zeros_like(p["word"]), "word_bias": np.zeros_like(p["word_bias"])}
        back, sorted_h, sorted_back = by_class @ p["klass"].T, h[order], np.empty_like(h)
        for c in range(CLASSES):
            part = slice(cuts[c], cuts[c + 1])
            if cuts[c] < cuts[c + 1]:
                g["word"][c] = sorted_h[part].T @ by_word[part]
                g["word_bias"][c] = by_word[part].sum(0)
                sorted_back[part] = by_word[part] @ p["word"][c].T
        back[order] += sorted_back
        back *= 1 - h * h
        g["inner"], g["bias"] = x.T @ back, back.sum(0, keepdims=True)
        to_embed = (back @ p["inner"].T).reshape(-1, WIDTH)
        flat = around.ravel()
        g["embed"] = np.stack([np.bincount(flat, to_embed[:, j], VOCABULARY + 1) for j in range(WIDTH)], 1).astype(np.float32)
        for name, slope in g.items():
            squares[name] += slope * slope
            p[name] -= RATE * slope / (np.sqrt(squares[name]) + 1e-6)


def _targets(code: np.ndarray, row: np.ndarray, turn: int, rounds: int) -> np.ndarray:
    """Which words are targets in a round: each word in one of the rounds."""
    if not len(row):
        return np.zeros(0, bool)
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    size = np.diff(np.r_[first, len(row)])
    start = (code[first] % np.uint64(rounds)).astype(np.int64)
    place = np.arange(len(row)) - np.repeat(first - start, size)
    return place % rounds == turn


def _training(network, turn: int = 0, rounds: int = 1):
    def rows(batches):
        own_network = Network(network.value.words)
        own_network.take(network.value.flat())
        squares = {n: np.full(s, 1e-4, np.float32) for n, s in Network.SHAPES.items()}
        targets, held, size = 0, [], 0
        for batch in batches:
            data, offsets = string_bytes(batch.column(0))
            for a, b in blocks(offsets):
                code, own, _, around, row = own_network.contexts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                chosen = _targets(code, row, turn, rounds)
                held.append((own[chosen], around[chosen]))
                size += len(held[-1][0])
                if size >= BATCH:
                    own, around = (np.concatenate(x) for x in zip(*held))
                    whole = size - size % BATCH
                    for i in range(0, whole, BATCH):
                        own_network.learn(own[i : i + BATCH], around[i : i + BATCH], squares)
                    targets, held, size = targets + whole, [(own[whole:], around[whole:])], size - whole
        if size:
            own, around = (np.concatenate(x) for x in zip(*held))
            own_network.learn(own, around, squares)
            targets += size
        if targets:
            values = own_network.flat().astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values * targets), pa.array(np.full(len(values), float(targets)))], ["slot", "total", "weight"])

    return rows


def train(texts: DataFrame, rounds: int = ROUNDS, top: int = TOP) -> Network:
    """A network trained on all rows of a one-column DataFrame."""
    network = Network(vocabulary(texts, top))
    for turn in range(rounds):
        shared = texts.sparkSession.sparkContext.broadcast(network)
        means = texts.mapInArrow(_training(shared, turn, rounds), "slot int, total double, weight double").groupBy("slot").agg((F.sum("total") / F.sum("weight")).alias("value")).toArrow()
        if len(means):
            values = network.flat()
            values[means.column("slot").to_numpy()] = means.column("value").to_numpy()
            network.take(values)
    return network


def score(docs: DataFrame, network: Network, text: str = "text") -> DataFrame:
    """docs with n_words, pll and mean_pll of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def scores(texts: pa.Array) -> pa.Array:
        data, offsets = string_bytes(texts)
        total, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for a, b in blocks(offsets):
            _, own, share, around, row = shared.value.contexts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            total[a:b] = np.bincount(row, shared.value.log_probabilities(own, around) + share, b - a)
            n[a:b] = np.bincount(row, minlength=b - a)
        return pa.StructArray.from_arrays([pa.array(n), pa.array(total)], ["n", "total"])

    column = F.arrow_udf(scores, "struct<n: bigint, total: double>")(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    rows = docs.select(F.struct("*").alias("doc"), column.alias("scored"))
    kept = [F.col(f"doc.`{c}`") for c in docs.columns if c.lower() not in ("n_words", "pll", "mean_pll")]
    return rows.select(*kept, F.col("scored.n").alias("n_words"), F.col("scored.total").alias("pll"), F.expr("try_divide(scored.total, scored.n)").alias("mean_pll"))
