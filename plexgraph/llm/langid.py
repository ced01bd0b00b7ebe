"""Language of texts by a linear-chain conditional random field over words.

Each word has features of its prefixes and suffixes (1-3 bytes), its byte
trigrams and itself (the lexicon), hashed into FEATURES entries; neighbouring
words have learned transitions. Forward-backward gives each word the
probabilities of the languages, also where a text switches between them; the
language of a text is the one with the highest mean over its words, and that mean
is the score.

The field is trained by Adam on a bounded sample of whole texts: for each language
the TRAIN_DOCS documents least by the hash of their id. Chains for training put
runs of words of several languages together. Prediction reads whole texts, and
word_languages labels each word of a text.

Cases: a null text or one without a letter is `und` with score 0, and its list of
word labels is empty. Documents of null language or null id aren't learned from; of
an id that several documents have, all are. Without any labelled document, all
texts are `und`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plexgraph.llm.runtime import replaced
from plexgraph.llm.textvec import LOWER, blocks, mix64, span_hashes, string_bytes, words

FEATURES = 1 << 15
TRAIN_DOCS = 100
#: Parts in which the candidates of a language are ranked first.
PARTS = 64
PIECE = 32
#: Letters, and all bytes of other characters; apostrophes and the like end a word.
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def _word_features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, word) pairs of words given by spans of lower-case data."""
    size, n = end - start, np.arange(len(start))
    codes, who = [span_hashes(data, start, end)], [n]
    for k in (1, 2, 3):
        has = size >= k
        codes += [span_hashes(data, start[has], start[has] + k) + np.uint64(k), span_hashes(data, end[has] - k, end[has]) + np.uint64(16 + k)]
        who += [n[has], n[has]]
    grams = np.maximum(size - 2, 0)
    word = np.repeat(n, grams)
    at = np.repeat(start - np.r_[0, np.cumsum(grams)[:-1]], grams) + np.arange(grams.sum()) if len(n) else word
    codes.append(span_hashes(data, at, at + 3) + np.uint64(64))
    who.append(word)
    return (mix64(np.concatenate(codes)) & np.uint64(FEATURES - 1)).astype(np.int32), np.concatenate(who)


def _distinct_words(data: np.ndarray, offsets: np.ndarray):
    """(lower-case data, starts and ends of the distinct words, their number for each word, rows)."""
    data = LOWER[data]
    start, end, row = words(data, offsets, LETTER)
    _, first, number = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
    return data, start[first], end[first], number, row


class Field:
    def __init__(self, languages: list[str]):
        self.languages = languages
        k = len(languages)
        self.weights = np.zeros((FEATURES, k), np.float32)
        self.transitions = np.zeros((k, k), np.float32)

    def emissions(self, feature: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
        order = self.weights[feature]
        return np.stack([np.bincount(word, order[:, j], n) for j in range(len(self.languages))], 1)

    def marginals(self, scores: np.ndarray, row: np.ndarray, pairs: bool = False):
        """Probabilities of the languages for each word, by forward-backward along each row of words.

        With pairs also those of each two neighbours, which mean nothing where a row ends.
        """
        n, k = scores.shape
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        size = np.diff(np.r_[first, n])
        pieces = -(-size // PIECE)
        chain = np.repeat(np.arange(len(first)), pieces)  # the row of each piece of PIECE words
        nth = np.arange(len(chain)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = (first[chain] + nth * PIECE)[:, None] + np.arange(PIECE)
        real = at < (first + size)[chain][:, None]
        emit = np.exp(scores - scores.max(1, keepdims=True))[np.where(real, at, 0)]
        step = np.exp(self.transitions - self.transitions.max()).astype(np.float64)
        entry = np.ones((k, k)) / k  # what stands for a transition into the first word of a row
        # the product of each piece, then through the pieces of each row one after another
        product = np.broadcast_to(np.eye(k), (len(chain), k, k)).copy()
        for t in range(PIECE):
            moved = product @ step
            if t == 0:
                moved[nth == 0] = entry
            moved *= emit[:, t, None, :]
            moved /= moved.sum((1, 2), keepdims=True)
            product = np.where(real[:, t, None, None], moved, product)
        ahead, behind = np.ones((len(chain), k)) / k, np.ones((len(chain), k)) / k
        starts = np.cumsum(pieces) - pieces
        for t in range(1, int(pieces.max(initial=0))):
            on = np.flatnonzero(pieces > t)
            v = np.einsum("ij,ijk->ik", ahead[starts[on] + t - 1], product[starts[on] + t - 1])
            ahead[starts[on] + t] = v / v.sum(1, keepdims=True)
            last = starts[on] + pieces[on] - t
            v = np.einsum("ijk,ik->ij", product[last], behind[last])
            behind[last - 1] = v / v.sum(1, keepdims=True)
        out = np.empty((len(chain), PIECE, k))
        v = ahead
        for t in range(PIECE):
            moved = v @ step
            if t == 0:
                moved[nth == 0] = 1 / k
            moved = moved * emit[:, t]
            moved /= moved.sum(1, keepdims=True)
            v = np.where(real[:, t, None], moved, v)
            out[:, t] = v
        ahead, late, v = out.copy() if pairs else None, np.empty_like(out) if pairs else None, behind
        for t in range(PIECE - 1, -1, -1):
            out[:, t] *= v
            if pairs:
                late[:, t] = v * emit[:, t]
            moved = (v * emit[:, t]) @ step.T
            moved /= moved.sum(1, keepdims=True)
            v = np.where(real[:, t, None], moved, v)
        out /= out.sum(2, keepdims=True)
        if not pairs:
            return out[real]
        both = ahead[real][:-1, :, None] * step * late[real][1:, None, :]
        return out[real], both / both.sum((1, 2), keepdims=True)

    def fit(self, texts: list[str], labels: np.ndarray, epochs: int = 3, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        data, offsets = string_bytes(pa.array(texts))
        data, start, end, number, row = _distinct_words(data, offsets)
        feature, word = _word_features(data, start, end)
        order = np.argsort(word, kind="stable")
        feature, cuts = feature[order], np.searchsorted(word[order], np.arange(len(start) + 1))
        # runs of 3 to 20 words of one text, dealt to chains of eight runs
        runs = []
        for a, b in zip(np.searchsorted(row, np.unique(row)), np.searchsorted(row, np.unique(row), "right")):
            while a < b:
                runs.append((a, min(b, a + int(rng.integers(3, 21)))))
                a = runs[-1][1]
        k = len(self.languages)
        means = [[np.zeros_like(x) for x in (self.weights, self.transitions)] for _ in range(2)]
        step = 0
        for _ in range(epochs):
            turn = rng.permutation(len(runs))
            for a in range(0, len(turn), 256):
                part = turn[a : a + 256]
                at = np.concatenate([np.arange(*runs[i]) for i in part])
                chain = np.concatenate([np.full(runs[i][1] - runs[i][0], j // 8) for j, i in enumerate(part)])
                gold = labels[row[at]]
                used, local = np.unique(number[at], return_inverse=True)
                sizes = cuts[used + 1] - cuts[used]
                who = np.repeat(np.arange(len(used)), sizes)
                features = feature[np.repeat(cuts[used] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())]
                p, both = self.marginals(self.emissions(features, who, len(used))[local], chain, pairs=True)
                wrong = p.copy()
                wrong[np.arange(len(at)), gold] -= 1
                by_word = np.stack([np.bincount(local, wrong[:, j], len(used)) for j in range(k)], 1)
                slope = np.stack([np.bincount(features, by_word[who, j], FEATURES) for j in range(k)], 1) / len(at)
                same = chain[1:] == chain[:-1]
                seen = np.zeros((k, k))
                np.add.at(seen, (gold[:-1][same], gold[1:][same]), 1)
                slopes = [slope + 1e-6 * self.weights, (both[same].sum(0) - seen) / max(1, same.sum()) + 1e-4 * self.transitions]
                step += 1
                for j, (value, g) in enumerate(zip((self.weights, self.transitions), slopes)):
                    means[0][j] = 0.9 * means[0][j] + 0.1 * g
                    means[1][j] = 0.99 * means[1][j] + 0.01 * g * g
                    value -= (0.05 * (means[0][j] / (1 - 0.9**step)) / (np.sqrt(means[1][j] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def _word_marginals(self, text: pa.Array):
        """(first row, probabilities of the languages by word, row of each word) of each block of texts."""
        data, offsets = string_bytes(text)
        for a, b in blocks(offsets):
            low, start, end, number, row = _distinct_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            if len(row) and self.languages:
                yield a, self.marginals(self.emissions(*_word_features(low, start, end), len(start))[number], row), row

    def predict(self, text: pa.Array) -> tuple[list[str], np.ndarray]:
        names, scores = np.full(len(text), "und", object), np.zeros(len(text))
        for a, p, row in self._word_marginals(text):
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            mean = np.add.reduceat(p, first) / np.diff(np.r_[first, len(row)])[:, None]
            names[a + row[first]] = np.array(self.languages, object)[mean.argmax(1)]
            scores[a + row[first]] = np.minimum(mean.max(1), 1.0)
        return names.tolist(), scores

    def label(self, text: pa.Array) -> pa.Array:
        """The most probable language of each word of each text."""
        sizes, labels = np.zeros(len(text), np.int64), [np.zeros(0, np.int64)]
        for a, p, row in self._word_marginals(text):
            sizes[a : a + row[-1] + 1] = np.bincount(row)
            labels.append(p.argmax(1))
        names = pa.array(self.languages, pa.string()).take(pa.array(np.concatenate(labels)))
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), names)


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Field:
    """A field learned from rows (doc_id, text, lang).

    The sample is chosen by ids alone, train_docs of a language, so that it can be
    broadcast to the documents and no other text is moved.
    """
    rows = docs.where("doc_id is not null and text is not null and lang is not null").withColumn("h", F.xxhash64("doc_id"))
    ids = rows.select("lang", "h", "doc_id").distinct()
    for keys in (["lang", F.pmod("h", F.lit(PARTS))], ["lang"]):  # the first of each part, and of those the first of all
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("h", "doc_id"))
        ids = ids.withColumn("rank", rank).where(F.col("rank") <= train_docs).drop("rank")
    chosen = ids.drop("h")
    sample = rows.join(F.broadcast(chosen), ["lang", "doc_id"]).select("lang", "h", "text").toPandas().sort_values(["lang", "h", "text"])
    languages = sorted(sample["lang"].unique())
    field = Field(languages)
    if languages:
        field.fit(sample["text"].tolist(), np.searchsorted(languages, sample["lang"].to_numpy()))
    return field


def predict(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """docs with lang_pred and score of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def languages(texts: pa.Array) -> pa.Array:
        names, scores = shared.value.predict(texts)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores)], ["lang_pred", "score"])

    column = F.arrow_udf(languages, "struct<lang_pred: string, score: double>")(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    rows = docs.select(F.struct("*").alias("doc"), column.alias("language"))
    letter = F.coalesce(F.col(f"doc.`{text}`").rlike(r"\p{L}"), F.lit(False))
    kept = [F.col(f"doc.`{c}`") for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    return rows.select(*kept, F.when(letter, F.col("language.lang_pred")).otherwise("und").alias("lang_pred"), F.when(letter, F.col("language.score")).otherwise(0.0).alias("score"))


def word_languages(docs: DataFrame, field: Field, text: str = "text", to: str = "word_langs") -> DataFrame:
    """docs with the language of each word (run of letters and of signs beyond ASCII) of each text, array<string>: where a text switches, so do they."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    return replaced(docs, {to: F.arrow_udf(lambda texts: shared.value.label(texts), "array<string>")(F.coalesce(F.col(f"`{text}`"), F.lit("")))})
