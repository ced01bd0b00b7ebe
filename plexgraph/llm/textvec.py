"""Vector helpers over Arrow string columns, shared by the text operators.

A batch is cut into blocks of a few hundred kilobytes of whole documents, so
that the working arrays of a task stay small however the batches are sized.
Words are maximal runs of bytes other than 0x20 and 0x09-0x0D.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 18
WORD_CHAR = np.ones(256, bool)
WORD_CHAR[[9, 10, 11, 12, 13, 32]] = False

#: Letters, digits and all bytes of other characters, for words without their punctuation.
PLAIN_CHAR = np.zeros(256, bool)
PLAIN_CHAR[48:58] = PLAIN_CHAR[65:91] = PLAIN_CHAR[97:123] = PLAIN_CHAR[128:] = True
#: A-Z to lower case, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, BLOCK_BYTES * 2)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows (a null is empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES):
    """Ranges (first, last) of rows of about `limit` bytes together; one long row is a block of its own."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), first + 4000, n)
        yield first, last
        first = last


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = WORD_CHAR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word; a word never crosses rows."""
    inside = table[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    full = offsets[:-1][np.diff(offsets) > 0]
    before[full] = False
    after[full[1:] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes that doesn't depend on where the span is."""
    up, down = _power_table(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[data] * up[: len(data)], out=total[1:])
    return mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def gram_hashes(codes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of runs of n words within a row; a row of fewer words gives one run of all of them."""
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(codes) - n + 1
    hashes, rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if m > 0:
        h = codes[:m].copy()
        for j in range(1, n):
            h *= _BASE
            h += codes[j : m + j]
        whole = row[:m] == row[n - 1 :]
        hashes, rows = mix64(h[whole]), row[:m][whole]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    size = np.diff(np.r_[first, len(row)])
    few = size < n
    if few.any():
        short = []
        for a, k in zip(first[few], size[few]):
            v = np.uint64(int(k))
            for c in codes[a : a + k]:
                v = np.uint64((int(v) * int(_BASE) + int(c)) & 0xFFFFFFFFFFFFFFFF)
            short.append(v)
        hashes = np.r_[hashes, mix64(np.array(short, np.uint64))]
        rows = np.r_[rows, row[first[few]]]
    return hashes, rows
