"""Column-wise construction of the Burrows-Wheeler transform of a collection.

The strings stand right-aligned. Round by round, one more symbol of each string
is put in, from the last column to the first: the transform and the array of
longest common prefixes of all suffixes known so far are read from two files in
sequence, the new suffixes find their places by the LF mapping, and the grown
arrays are written in sequence to the files of the next round. Each string ends
with a sentinel of its own, so that no prefix reaches over the end of a string.
The caller bounds a collection, and with it the files and what is held of them.

Cases: an empty collection, and strings shorter than a window, have no windows.
Equal strings are separate members.
"""

from __future__ import annotations

import tempfile

import numpy as np

from plexgraph.llm.textvec import _BASE, _BYTE_CODES, mix64


def _last_first(transform: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(transform, kind="stable").astype(np.int32)
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return order, rank


class Files:
    """Two pairs of open files for the transform and the common prefixes: one pair is read while the other is written."""

    def __enter__(self) -> Files:
        self.files = [[tempfile.TemporaryFile(buffering=0) for _ in range(2)] for _ in range(2)]
        return self

    def __exit__(self, *_) -> None:
        for pair in self.files:
            for file in pair:
                file.close()

    def write(self, k: int, *arrays: np.ndarray) -> None:
        for file, array in zip(self.files[k], arrays):
            file.seek(0)
            left = memoryview(np.ascontiguousarray(array)).cast("B")
            file.truncate(len(left))
            while len(left):
                left = left[file.write(left) :]

    def read(self, k: int, *types) -> list[np.ndarray]:
        out = []
        for file, kind in zip(self.files[k], types):
            file.seek(0)
            out.append(np.frombuffer(file.readall(), kind))
        return out


def build(columns: np.ndarray, lengths: np.ndarray, files: Files) -> tuple[np.ndarray, np.ndarray]:
    """(transform, common prefixes) of a collection, both in suffix order; the sentinels come first.

    columns[j, i] is the j-th symbol from the end of string i, over 0, and 0
    where the string has no more; the last row is 0 throughout.
    """
    count, longest = columns.shape[1], columns.shape[0] - 1
    kinds = (columns.dtype, np.dtype(np.uint16))
    files.write(0, columns[0], np.zeros(count, np.uint16))
    active = np.flatnonzero(lengths > 0)
    place = active.copy()
    for length in range(1, longest + 1):
        transform, common = files.read((length - 1) % 2, *kinds)
        n = len(transform)
        order, rank = _last_first(transform)
        symbol, at = transform[place], rank[place]
        starts = n - int(np.count_nonzero(transform))
        target = at - starts + count
        # the neighbours in the new order: the suffixes before and after with the same first symbol
        left = order[np.maximum(at - 1, 0)]
        right = order[np.minimum(at + 1, n - 1)]
        has_left = (at > 0) & (transform[left] == symbol)
        has_right = (at + 1 < n) & (transform[right] == symbol)
        prefix = np.zeros(len(place), np.uint16)
        prefix[has_left] = _least(common, left[has_left] + 1, place[has_left] + 1) + 1
        follows = _least(common, place[has_right] + 1, right[has_right] + 1) + 1
        turn = np.argsort(target)
        active, target, prefix = active[turn], target[turn], prefix[turn]
        grown = n + len(active)
        fresh = np.zeros(grown, bool)
        fresh[target] = True
        old = ~fresh
        new_common = np.empty(grown, np.uint16)
        new_common[old] = common
        new_common[target] = prefix
        after = (at[has_right] + 1) - starts + count
        new_common[after] = follows
        new_transform = np.empty(grown, columns.dtype)
        new_transform[old] = transform
        new_transform[target] = columns[length][active]
        files.write(length % 2, new_transform, new_common)
        going = lengths[active] > length
        active, place = active[going], target[going]
    return tuple(files.read(longest % 2, *kinds))


def _least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of values[low:high] for each pair; no range is empty."""
    if not len(low):
        return np.zeros(0, values.dtype)
    turn = np.argsort(low, kind="stable")
    pairs = np.empty(2 * len(low), np.int64)
    pairs[0::2], pairs[1::2] = low[turn], high[turn]
    padded = np.append(values, values.dtype.type(0))
    out = np.empty(len(low), values.dtype)
    out[turn] = np.minimum.reduceat(padded, pairs)[0::2]
    return out


def _block_symbols(data: np.ndarray, block: int) -> np.ndarray:
    """The symbol of the `block` bytes from each position of the data: numbers from 1, alike for equal blocks."""
    h = _BYTE_CODES[data[: len(data) - block + 1]].copy()
    for j in range(1, block):
        h *= _BASE
        h += _BYTE_CODES[data[j : len(data) - block + 1 + j]]
    values, symbols = np.unique(mix64(h), return_inverse=True)
    return (symbols + 1).astype(np.uint16 if len(values) < 65535 else np.uint32)


def repeated_windows(strings: list[bytes], span: int, files: Files) -> list[np.ndarray]:
    """For each string, the starts of its windows of `span` bytes that also start elsewhere in the collection.

    The symbols are blocks of bytes (25 for a span of 200), so that a string
    gives one member of the collection for each phase of the blocks, and a
    window is a run of span / block symbols.
    """
    block = max(d for d in range(1, 33) if span % d == 0)
    sizes = np.array([len(s) for s in strings], np.int64)
    offsets = np.r_[0, np.cumsum(sizes)]
    none = np.zeros(0, np.int64)
    if not len(sizes) or sizes.max() < span:
        return [none for _ in strings]
    symbols = _block_symbols(np.frombuffer(b"".join(strings), np.uint8), block)
    who = np.repeat(np.arange(len(strings)), block)
    phase = np.tile(np.arange(block), len(strings))
    lengths = np.maximum((sizes[who] - phase) // block, 0)
    columns = np.zeros((int(lengths.max()) + 1, len(who)), symbols.dtype)
    for j in range(len(columns) - 1):
        has = lengths > j
        columns[j, has] = symbols[offsets[who[has]] + phase[has] + block * (lengths[has] - 1 - j)]
    transform, common = build(columns, lengths, files)
    _, rank = _last_first(transform)
    starts = len(transform) - int(np.count_nonzero(transform))
    twice = common >= span // block
    twice[:-1] |= twice[1:].copy()
    member = place = np.arange(len(who))
    found_in, found_at = [], []
    for length in range(1, len(columns)):
        going = lengths[member] >= length
        member, place = member[going], place[going]
        place = rank[place].astype(np.int64) - starts + len(who)
        if length * block >= span:
            hit = member[twice[place]]
            found_in.append(who[hit])
            found_at.append(phase[hit] + block * (lengths[hit] - length))
    found_in, found_at = np.concatenate(found_in), np.concatenate(found_at)
    turn = np.lexsort((found_at, found_in))
    return np.split(found_at[turn], np.searchsorted(found_in[turn], np.arange(1, len(strings))))
