"""Content-defined anchors of byte windows.

Every window of `span` bytes has one anchor: the leftmost k-byte gram in it
with the least hash. Equal windows have equal anchors wherever they lie, so
windows can be grouped by anchor before any of their bytes are compared.
Neighbouring windows with the same anchor are kept as one segment.
"""

from __future__ import annotations

import numpy as np

from plexgraph.llm.textvec import _BYTE_CODES, mix64, span_hashes

GRAM = 32
#: Windows of a part of a long text.
PART = 1 << 20


def gram_codes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position (the last GRAM - 1 positions are left out)."""
    h = _BYTE_CODES[data]
    factor, width = 0x9E3779B97F4A7C15, 1
    while width < GRAM:
        h = h[: len(h) - width] * np.uint64(factor) + h[width:]
        factor = factor * factor & 0xFFFFFFFFFFFFFFFF
        width *= 2
    return mix64(h)


def segments(data: np.ndarray, span: int):
    """Segments of one text: (first window, last window, anchor hash, segment hash). Needs len(data) >= span.

    Long texts are taken in parts of PART windows, at whose ends a segment may be cut in two. The hash of a segment covers all its bytes and where the anchor lies in it.
    """
    if len(data) >= PART + span:
        parts = [(a, segments(data[a : a + PART + span - 1], span)) for a in range(0, len(data) - span + 1, PART)]
        return tuple(np.concatenate([p[k] + a if k < 2 else p[k] for a, p in parts]) for k in range(4))
    codes = gram_codes(data)
    n, width = len(data) - span + 1, span - GRAM + 1
    # the least (hash, position): positions in the low bits make the leftmost win
    bits = np.uint64(21)
    low = (codes >> bits << bits) | np.arange(len(codes), dtype=np.uint64)
    reach = 1
    while reach * 2 <= width:
        low = np.minimum(low[: len(low) - reach], low[reach:])
        reach *= 2
    least = np.minimum(low[:n], low[width - reach : width - reach + n])
    place = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    last = np.r_[first[1:], n] - 1
    anchor = place[first]
    whole = span_hashes(data, first, last + span)
    return first, last, codes[anchor], mix64(whole + (anchor - first).astype(np.uint64))
