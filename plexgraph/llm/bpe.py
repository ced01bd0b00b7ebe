"""Byte-pair encoding with forced boundaries, and decoding.

A pair of neighbouring bytes that is inside no vocabulary token can never be
merged over, so a word is cut there for certain. The fragments between such cuts
are encoded on their own, lowest merge first, and their ids are put together.

The vocabulary file is one of the `tokenizers` library with a BPE model, the
normalizers NFC, white space to a space and lower case, a splitting pattern of
words, single numbers and other runs, and the end-of-word suffix `</w>`. Tokens
of the file's added tokens are found in the raw text first.

Letters, numbers and lower case are those of Unicode 16, which the vocabulary's
pattern is defined by: Python's tables, with what they lack stated below.

Cases: a null or empty text, or one of white space, has no ids and decodes to
the empty text. Any other text is encoded whole; a long run without white space
takes time in proportion to n log n. Null ids decode to null.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexgraph.llm.runtime import replaced

END = "</w>"
#: Entries of the cache of words; a full cache is emptied. Longer words aren't kept.
CACHE, CACHED_LENGTH = 800_000, 48
#: Fragments of more bytes are merged by a heap.
LONG = 48
#: Letters and numbers of Unicode 16 that are not in Unicode 15.1 (fixed values, hexadecimal ranges).
NEW_LETTERS = (
    "1c89-1c8a a7cb-a7cd a7da-a7dc 105c0-105f3 10d4a-10d65 10d6f-10d85 10ec2-10ec4 11380-11389 1138b 1138e 11390-113b5 "
    "113b7 113d1 113d3 11bc0-11be0 13460-143fa 16100-1611d 16d40-16d6c 18cff 1e5d0-1e5ed 1e5f0"
)
NEW_NUMBERS = "10d40-10d49 116d0-116e3 11bf0-11bf9 16130-16139 16d70-16d79 1ccf0-1ccf9 1e5f1-1e5fa"
#: Lower case that Python's tables lack: first and last capital, and how far the small letter is (fixed values).
NEW_CAPITALS = (
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1),
    (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
)
#: A merge is one number, its rank over its id, so that the least number is the first merge.
_ID_BITS = 20
_ID = (1 << _ID_BITS) - 1
_NEVER = 1 << 60
_codecs: dict[str, Codec] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies (a fixed convention)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def _code_points(ranges: str) -> set[int]:
    ends = [[int(x, 16) for x in part.split("-")] for part in ranges.split()]
    return {c for e in ends for c in range(e[0], e[-1] + 1)}


class _Kinds(dict):
    """A letter, number or other sign that stands for each code point beyond ASCII, filled as they come."""

    letters, numbers = _code_points(NEW_LETTERS), _code_points(NEW_NUMBERS)

    def __missing__(self, code: int) -> int:
        kind = unicodedata.category(chr(code))[0]
        is_letter, is_number = kind == "L" or code in self.letters, kind == "N" or code in self.numbers
        self[code] = sign = code if code < 128 else ord("ä" if is_letter else "²" if is_number else "€")
        return sign


class Codec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.letters = _byte_letters()
        byte_of = {c: b for b, c in enumerate(self.letters)}
        self.vocabulary: dict[str, int] = model["vocab"]
        self.tokens = [""] * (max([*self.vocabulary.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for token, i in self.vocabulary.items():
            self.tokens[i] = token
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.added.items():
            self.tokens[i] = token
        self.token_array = np.array(self.tokens, dtype=object)
        self.numbers = [str(i) for i in range(len(self.tokens))]
        self.first = [self.vocabulary[c] for c in self.letters]
        self.final = [self.vocabulary[c + END] for c in self.letters]
        self.merges = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.merges[self.vocabulary[left] << _ID_BITS | self.vocabulary[right]] = rank << _ID_BITS | self.vocabulary[left + right]
        self.inside = set()
        for token in self.vocabulary:
            raw = [byte_of.get(c) for c in (token.removesuffix(END) if token != END else token)]
            self.inside.update(p for p in zip(raw, raw[1:]) if None not in p)
        added = "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))
        self.special = regex.compile(f"({added})") if added else None
        # white space as the library's expressions have it: the Unicode property, without the separators 0x1C-0x1F
        self.space = regex.compile(r"[\t-\r\x20\x85\p{Z}]+")
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.parts = regex.compile(pattern.replace(r"\s", r"\t-\r\x20\x85\p{Z}")).finditer
        self.kinds = _Kinds()
        self.small = {c: c + by for low, high, by in NEW_CAPITALS for c in range(low, high + 1)}
        self.capital = regex.compile(f"[{''.join(map(chr, self.small))}]").search
        self.words = _Words(self)

    def fragment(self, raw: bytes, last: bool) -> list[int]:
        """The ids of a fragment; `last`: the end of its word."""
        ids = [self.first[b] for b in raw]
        if last:
            ids[-1] = self.final[raw[-1]]
        if len(ids) > LONG:
            return self._merged(ids)
        merge = self.merges.get
        merges = [merge(a << _ID_BITS | b, _NEVER) for a, b in zip(ids, ids[1:])]
        while merges and (least := min(merges)) != _NEVER:
            i = merges.index(least)
            ids[i] = new = least & _ID
            del ids[i + 1], merges[i]
            if i:
                merges[i - 1] = merge(ids[i - 1] << _ID_BITS | new, _NEVER)
            if i < len(merges):
                merges[i] = merge(new << _ID_BITS | ids[i + 1], _NEVER)
        return ids

    def _merged(self, ids: list[int]) -> list[int]:
        """The same merges for long fragments: the first merge from a heap, neighbours by links."""
        n, merge = len(ids), self.merges.get
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        merges = [merge(a << _ID_BITS | b, _NEVER) for a, b in zip(ids, ids[1:])] + [_NEVER]
        heap = [(m, i) for i, m in enumerate(merges) if m != _NEVER]
        heapq.heapify(heap)
        while heap:
            least, i = heapq.heappop(heap)
            if merges[i] != least:
                continue  # one of the two was merged before
            gone = after[i]
            ids[i], merges[gone], after[i] = least & _ID, _NEVER, after[gone]
            if after[i] >= 0:
                before[after[i]] = i
            ids[gone] = -1
            for j in (before[i], i):
                if j >= 0:
                    merges[j] = merge(ids[j] << _ID_BITS | ids[after[j]], _NEVER) if after[j] >= 0 else _NEVER
                    if merges[j] != _NEVER:
                        heapq.heappush(heap, (merges[j], j))
        return [x for x in ids if x >= 0]

    def pieces(self, word: str) -> list[str]:
        """The runs of the splitting pattern."""
        kinds = word if word.isascii() else word.translate(self.kinds)
        return [word[m.start() : m.end()] for m in self.parts(kinds)]

    def piece(self, piece: str) -> bytes:
        """The ids of one piece of the splitting pattern, its fragments encoded on their own."""
        raw, start, ids, inside = piece.encode(), 0, [], self.inside
        if inside.issuperset(zip(raw, raw[1:])):
            return array("i", self.fragment(raw, True)).tobytes()
        for cut in [i for i, pair in enumerate(zip(raw, raw[1:]), 1) if pair not in inside]:
            ids += self.fragment(raw[start:cut], False)
            start = cut
        return array("i", ids + self.fragment(raw[start:], True)).tobytes()

    def word(self, word: str) -> bytes:
        """The ids of a run without white space, in lower case; a piece of it is a word of its own."""
        pieces = [word] if word.isalpha() and word.isascii() else self.pieces(word)
        if len(pieces) == 1:
            return self.piece(pieces[0])
        return b"".join(map(self.words.__getitem__, pieces))

    def encode_bytes(self, text: str) -> bytes:
        """The ids of a text as 32-bit numbers in a row."""
        if self.special is not None and "<" in text:
            parts = self.special.split(text)
            return b"".join(array("i", [self.added[p]]).tobytes() if k % 2 else self._plain(p) for k, p in enumerate(parts))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            text = text.translate(self.small) if self.capital(text) else text
        text = text.lower()
        # str.split() takes 0x1C-0x1F for white space too
        parts = self.space.split(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
        return b"".join(map(self.words.__getitem__, parts))

    def encode(self, text: str | None) -> list[int]:
        return array("i", self.encode_bytes(text or "")).tolist()

    def decode(self, ids) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))


class _Words(dict):
    """Ids by word, filled as words come."""

    def __init__(self, codec: Codec):
        super().__init__({"": b""})
        self.codec = codec

    def __missing__(self, word: str) -> bytes:
        ids = self.codec.word(word)
        if len(word) > CACHED_LENGTH:
            return ids
        if len(self) >= CACHE:
            self.forget()
        self[word] = ids
        return ids

    def forget(self) -> None:
        self.clear()
        self[""] = b""


def codec(path: str) -> Codec:
    """The codec of a file, read once in each Python process."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_column(path: str):
    def encode(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path)
        try:
            for text in texts:
                parts = [own.encode_bytes(t.as_py() or "") for t in text]
                ends = np.r_[0, np.cumsum(np.array([len(p) // 4 for p in parts], np.int64))].astype(np.int32)
                yield pa.ListArray.from_arrays(pa.array(ends), pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(parts))]))
        finally:  # the worker goes on to other tasks, which need the memory
            own.words.forget()

    return F.arrow_udf(encode, "array<int>")


def _joined(ids: pa.Array, strings: list[str]) -> pa.Array:
    out = []
    values, at = ids.flatten().to_numpy(), ids.offsets.to_numpy()
    at = at - at[0]
    valid = ids.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(ids)):
        out.append(" ".join(map(strings.__getitem__, values[at[i] : at[i + 1]].tolist())) if valid[i] else None)
    return pa.array(out, pa.string())


def decode_column(path: str):
    return F.arrow_udf(lambda ids: _joined(ids, codec(path).tokens), "string")


def id_text_column(path: str):
    """Decimal ids joined by single spaces."""
    return F.arrow_udf(lambda ids: _joined(ids, codec(path).numbers), "string")


def encode(docs: DataFrame, path: str | None = None, text: str = "text", to: str = "token_ids") -> DataFrame:
    """docs with the ids of each text, array<int>."""
    return replaced(docs, {to: encode_column(path or default_vocabulary())(F.coalesce(F.col(f"`{text}`"), F.lit("")))})


def decode(docs: DataFrame, path: str | None = None, ids: str = "token_ids", to: str = "decoded") -> DataFrame:
    """docs with the text of each list of ids, special tokens included."""
    return replaced(docs, {to: decode_column(path or default_vocabulary())(F.col(f"`{ids}`"))})
