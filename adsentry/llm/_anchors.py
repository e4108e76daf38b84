"""Content-chosen anchors: which positions two equal windows are sure to share.

A window is ``length`` consecutive tokens of one document.  Its anchor is the ``gram``-token string inside it whose
hash is smallest (the leftmost one on a tie), so equal windows have the same anchor at the same offset.  Comparing only
places with an equal anchor therefore misses no repeated window, and there are about ``2 / (length - gram + 2)`` anchors
per token instead of one window per token.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

# Odd multipliers of a 64-bit mixing function (fixed values).
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S32, _S29 = np.uint64(32), np.uint64(29)


def mix(x: np.ndarray) -> np.ndarray:
    x = x * _B
    x ^= x >> _S29
    x *= _C
    x ^= x >> _S32
    return x


def join_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of what `left` and `right` stand for, in this order."""
    x = left * _A
    x += right
    x ^= x >> _S29
    x *= _B
    x ^= x >> _S32
    return x


def gram_hash(tokens: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` tokens, by doubling; the last step may overlap."""
    h, n = tokens, 1
    while n * 2 <= size:
        h, n = join_hash(h[:-n], h[n:]), n * 2
    return h if n == size else join_hash(h[: len(h) - (size - n)], h[size - n :])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while n * 2 <= width:
        x, n = np.minimum(x[:-n], x[n:]), n * 2
    return x if n == width else np.minimum(x[: len(x) - (width - n)], x[width - n :])


class Anchors(NamedTuple):
    """One row per anchor, in text order. Positions are indexes of the block's tokens."""

    doc: np.ndarray  # index of the document in the block
    pos: np.ndarray  # where the anchor starts
    first: np.ndarray  # the first window start that has this anchor
    last: np.ndarray  # the last one
    gram: np.ndarray  # hash of the anchor's own tokens
    around: np.ndarray  # hash of all tokens of these windows, and of where the document ends within them
    lo: np.ndarray  # the tokens hashed: from
    hi: np.ndarray  # to


def anchors(tokens: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int) -> Anchors:
    """Anchors of the documents ``tokens[starts[i]:ends[i]]``, which lie one after another in `tokens`."""
    none = np.zeros(0, np.int64)
    long = ends - starts >= length
    if not long.any():
        return Anchors(none, none, none, none, none.view(np.uint64), none.view(np.uint64), none, none)
    h = gram_hash(tokens, gram)
    index = np.arange(len(h), dtype=np.uint64)
    least = sliding_min((h >> _S32 << _S32) | index, length - gram + 1)
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # window starts whose window stays inside one document
    change = np.zeros(len(at) + 1, np.int32)
    np.add.at(change, starts[long], 1)
    np.add.at(change, ends[long] - length + 1, -1)
    inside = np.cumsum(change[:-1]) > 0
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | (at[1:] != at[:-1])
    first = np.flatnonzero(begin)
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | (at[1:] != at[:-1])
    last = np.flatnonzero(stop)
    pos = at[first]
    doc = np.searchsorted(starts, first, side="right") - 1
    reach = length - gram
    lo, hi = np.maximum(starts[doc], pos - reach), np.minimum(ends[doc], pos + length)
    # the tokens around, as grams that cover them; clipped where the document ends
    around = mix(((pos - lo).astype(np.uint64) << _S32) + (hi - pos).astype(np.uint64))
    for k in range(-(-(reach + length) // gram)):
        around = join_hash(around, h[np.minimum(lo + k * gram, hi - gram)])
    return Anchors(doc, pos, first, last, h[pos], around, lo, hi)
