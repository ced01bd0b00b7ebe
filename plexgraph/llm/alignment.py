"""Alignment of the tokens of two tokenizers by elementary intervals of bytes.

A text with a space before it is encoded by A, a byte-level BPE vocabulary, and the
text by B, a sentencepiece model that puts the space there itself. Both token rows
cover the same bytes. The union of the places where tokens of either end (union1d)
cuts the bytes into elementary intervals; a binary search (searchsorted) finds the
token of A and that of B that own an interval, so each interval is one overlap of two
tokens. An end that both share closes a group. All pairs of a token of A and one of B
of a group are links: the group's product is expanded.

A pair of ids counts in how many documents it is linked. The counts are a table of
Spark; they come back to the documents by a join, which is a broadcast only below
BROADCAST_PAIRS pairs. Blocks of about a quarter of a megabyte of texts are aligned
together, and products are expanded SLICE pairs at a time, equal ids of a large group
once; so a task's memory follows its longest text.

Cases: a null or empty text, or one whose bytes aren't those that the tokens of A and
of B put together (a model may normalise), has no tokens, zeros for counts and empty
lists. Strings of special tokens inside a text are plain text. Documents of equal or
null ids are documents of their own. Extra columns stay; those named like a result are
replaced.
"""

from __future__ import annotations

import json
from functools import cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plexgraph.llm.runtime import replaced
from plexgraph.llm.textvec import blocks, string_bytes

BROADCAST_PAIRS = 500_000
SLICE = 1 << 20
#: Groups of more pairs than this are expanded by distinct ids.
LARGE = 64
#: The splitting pattern of byte-level vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RESULT = {"n_a": T.LongType(), "n_b": T.LongType(), "n_groups": T.LongType(), "n_links": T.LongType(), "groups": T.StringType(), "pairs": T.ArrayType(T.LongType()), "links": T.ArrayType(T.LongType())}


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteLevel:
    """A byte-level BPE vocabulary file of the tokenizers library, whose ids follow its merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        split = spec["pre_tokenizer"]
        if spec["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split.get("use_regex", True):
            raise ValueError(f"{path} isn't a plain byte-level vocabulary")
        alphabet, vocabulary = byte_alphabet(), spec["model"]["vocab"]
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            if all(c in alphabet for c in token):
                self.bytes[i] = bytes(alphabet[c] for c in token)
        merges = [x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"]]
        if [vocabulary[a + b] for a, b in merges] != list(range(len(vocabulary) - len(merges), len(vocabulary))):
            raise ValueError(f"the ids of {path} don't follow its merges")
        if not {bytes([x]) for x in range(256)} <= set(self.bytes):
            raise ValueError(f"{path} lacks single bytes")  # with all of them the tokens' bytes are always the text's
        self.encoding = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={b: i for i, b in enumerate(self.bytes) if b}, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [self.encoding.encode_to_numpy(" " + text, disallowed_special=()) if text else np.zeros(0, np.uint32) for text in texts]


class Pieces:
    """A sentencepiece model."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(self.model.get_piece_size())
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i in n for p in [self.model.id_to_piece(i)]]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.uint32) for ids in self.model.encode(texts, num_threads=1)]


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        self.sides = ByteLevel(a_path), Pieces(b_path)
        self.sizes = [np.array([len(x) for x in side.bytes], np.int32) for side in self.sides]
        self.n_b = len(self.sides[1].bytes)
        # the text of an id with what follows it: A's ids end with a comma or a bar, B's with a comma or a semicolon
        self.printed = [f"{i}{mark}" for side, marks in zip(self.sides, (",|", ",;"), strict=True) for mark in marks for i in range(len(side.bytes))]
        self.first = np.array([0, len(self.sizes[0]), 2 * len(self.sizes[0]), 2 * len(self.sizes[0]) + self.n_b])

    def tokens(self, texts: list[str]) -> list[list[np.ndarray]]:
        """The ids of A and of B of each text, none where B's bytes aren't the text's; A has every byte and loses none."""
        out, known = [side.encode(texts) for side in self.sides], self.sides[1].bytes
        for k, text in enumerate(texts):
            if not text or b"".join(map(known.__getitem__, out[1][k].tolist())) != b" " + text.encode():
                out[0][k] = out[1][k] = np.zeros(0, np.uint32)
        return out

    def block(self, texts: list[str]) -> list[pa.Array]:
        """The result columns of some texts."""
        ids = self.tokens(texts)
        counts = [np.array([len(x) for x in side], np.int64) for side in ids]
        a, b = (np.concatenate(side).astype(np.int64) if side else np.zeros(0, np.int64) for side in ids)
        ends_a, ends_b = (np.cumsum(size[x], dtype=np.int64) for size, x in zip(self.sizes, (a, b), strict=True))
        cuts = np.union1d(ends_a, ends_b)
        owner_a, owner_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)  # of the interval that ends at a cut
        closes = (ends_a[owner_a] == cuts) & (ends_b[owner_b] == cuts) if len(cuts) else np.zeros(0, bool)
        group = np.cumsum(closes) - closes
        # a token belongs to the group of any of its intervals; the last one written is that of its end
        group_a, group_b = np.empty(len(a), np.int64), np.empty(len(b), np.int64)
        group_a[owner_a], group_b[owner_b] = group, group
        n_groups = int(closes.sum())
        in_a, in_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
        row_a = np.repeat(np.arange(len(texts)), counts[0])
        first_a, first_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        row = row_a[first_a] if n_groups else np.zeros(0, np.int64)
        n_links = np.zeros(len(texts), np.int64)
        np.add.at(n_links, row, in_a * in_b)
        keys, weights = self._products(a, b, in_a, in_b, first_a, first_b, row, group_a, group_b)
        pair_row, pairs = np.divmod(keys, len(self.sizes[0]) * self.n_b)
        at = np.searchsorted(pair_row, np.arange(len(texts) + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x)) for x in (pairs, weights)]
        printed = self._printed(a, b, group_a, group_b, in_a, in_b, counts)
        return [*map(pa.array, (counts[0], counts[1], np.bincount(row, minlength=len(texts)), n_links)), pa.array(printed, pa.string()), *lists]

    def _products(self, a, b, in_a, in_b, first_a, first_b, row, group_a, group_b):
        """(row and pair as one number, links of it), sorted."""
        pairs_of = lambda row, a, b: (row * len(self.sizes[0]) + a) * self.n_b + b
        total, large = in_a * in_b, in_a * in_b > LARGE
        plain, n = np.flatnonzero(~large), np.zeros(0, np.int64)
        keys = [np.zeros(0, np.int64)]
        for x, y, which in _expanded(in_a[plain], in_b[plain]):
            g = plain[which]
            keys.append(pairs_of(row[g], a[first_a[g] + x], b[first_b[g] + y]))
        keys, n = np.unique(np.concatenate(keys), return_counts=True)
        for g in np.flatnonzero(large):  # few: tokens of a run that don't end together for long
            ids_a, times_a = np.unique(a[first_a[g] : first_a[g] + in_a[g]], return_counts=True)
            ids_b, times_b = np.unique(b[first_b[g] : first_b[g] + in_b[g]], return_counts=True)
            for x, y, _ in _expanded(np.array([len(ids_a)]), np.array([len(ids_b)])):
                keys = np.r_[keys, pairs_of(row[g], ids_a[x], ids_b[y])]
                n = np.r_[n, times_a[x] * times_b[y]]
        if large.any():
            keys, at = np.unique(keys, return_inverse=True)
            n = _sums(at, n, len(keys))
        return keys, n

    def _printed(self, a, b, group_a, group_b, in_a, in_b, counts) -> list[str]:
        """The ids of each text's groups as text: A's, a bar, B's, and a semicolon between groups."""
        before_b, upto_a = np.cumsum(in_b) - in_b, np.cumsum(in_a)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        if len(a):
            last_a[upto_a - 1] = 1
            last_b[np.cumsum(in_b) - 1] = 1
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + before_b[group_a]] = a + self.first[last_a]
        codes[np.arange(len(b)) + upto_a[group_b]] = b + self.first[2 + last_b]
        out, k, codes = [], 0, codes.tolist()
        for n in (counts[0] + counts[1]).tolist():
            out.append("".join(map(self.printed.__getitem__, codes[k : k + n]))[:-1])
            k += n
        return out


def _sums(at: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    np.add.at(out, at, n)
    return out


def _expanded(na: np.ndarray, nb: np.ndarray):
    """(place in A, place in B, group) of all pairs of the groups' products, SLICE at a time."""
    stop = np.cumsum(na * nb)
    for low in range(0, int(stop[-1]) if len(stop) else 0, SLICE):
        at = np.arange(low, min(low + SLICE, int(stop[-1])))
        g = np.searchsorted(stop, at, "right")
        x, y = np.divmod(at - (stop - na * nb)[g], nb[g])
        yield x, y, g


@cache
def _aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def align(docs: DataFrame, text: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """docs with n_a, n_b, n_groups, n_links, groups as text (`a1,a2|b1;a3|b2,b3`), and the distinct pairs with their links.

    A pair is the number id of A * size of B + id of B.
    """
    a_path, b_path = paths or default_paths()
    low = set(RESULT)
    kept = [c for c in docs.columns if c.lower() not in low]
    ready = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    schema = T.StructType(ready.schema.fields[:-1] + [T.StructField(name, kind) for name, kind in RESULT.items()])

    def run(batches):
        aligner = _aligner(a_path, b_path)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for first, last in blocks(string_bytes(texts)[1]):
                part = batch.slice(first, last - first)
                columns = aligner.block(part.column(batch.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], [*batch.schema.names[:-1], *RESULT])

    return ready.mapInArrow(run, schema)


def pair_counts(aligned: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """(pair, n, best): how many documents hold a pair linked, and whether no other pair of its id of A is in more."""
    size = len(_aligner(*(paths or default_paths())).sizes[1])
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    highest = F.max("n").over(Window.partitionBy(F.floor(F.col("pair") / size)))
    return counts.select("pair", "n", (F.col("n") == highest).alias("best"))


def with_counts(aligned: DataFrame, counts: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """aligned with n_best and count_sum instead of pairs and links. Both tables should be stored.

    The counts are broadcast if there are few, and else joined by a shuffle, whose frequent pairs adaptive execution splits.
    """
    kept = [c for c in aligned.columns if c not in ("pairs", "links")]
    rows = aligned.withColumn("__row", F.monotonically_increasing_id())
    each = rows.select("__row", *kept, F.inline_outer(F.arrays_zip("pairs", "links"))).withColumnRenamed("pairs", "pair")
    few = counts.limit(broadcast_pairs + 1).count() <= broadcast_pairs
    joined = each.join(F.broadcast(counts) if few else counts.hint("merge"), "pair", "left")
    sums = joined.groupBy("__row", *kept).agg(
        F.coalesce(F.sum(F.when(F.col("best"), F.col("links"))), F.lit(0)).alias("n_best"), F.coalesce(F.sum(F.col("n") * F.col("links")), F.lit(0)).alias("count_sum"))
    return replaced(sums.drop("__row"), {c: F.col(c) for c in ("n_best", "count_sum")})
