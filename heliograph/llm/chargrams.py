"""Hashed character n-grams of whole texts, as arrays over one byte buffer; what both text classifiers read."""

from __future__ import annotations

import numpy as np

from heliograph.llm import common as C

BITS = 20
BLOCK = 1 << 18
# Bytes as the n-grams see them: A-Z lower-cased, everything else of ASCII but letters a space (digits a 0).
CLASS = np.full(256, 0x20, np.uint8)
CLASS[0x61:0x7B] = np.arange(0x61, 0x7B)
CLASS[0x41:0x5B] = np.arange(0x61, 0x7B)
CLASS[0x30:0x3A] = 0x30
CLASS[0x80:] = np.arange(0x80, 0x100)


def spaced(column) -> tuple[np.ndarray, np.ndarray]:
    """The folded bytes of all texts with a space before and after each, and where each begins (its space included)."""
    buf, offsets = C.texts(column)
    begin = offsets + np.arange(len(offsets))
    out = np.full(len(buf) + len(offsets), 0x20, np.uint8)
    letter = np.ones(len(out), bool)
    letter[begin] = False
    out[letter] = CLASS[buf]
    return out, begin


def grams(folded: np.ndarray, n: int, bits: int = BITS) -> np.ndarray:
    """The bucket of the n-gram (2 to 8 bytes) at every place of the buffer but its last n - 1."""
    if len(folded) < n:
        return np.zeros(0, np.int32)
    padded = np.concatenate([folded, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(folded) - n + 1,), (1,), writeable=False)
    h = eight & np.uint64((1 << (8 * n)) - 1)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93 + 2 * n)
    h >>= np.uint64(64 - bits)
    return h.astype(np.int32)


def owners(begin: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The number of the text that a place of the buffer belongs to."""
    return np.searchsorted(begin, places, "right") - 1


def places(folded: np.ndarray, begin: np.ndarray, n: int, bits: int = BITS, table: np.ndarray | None = None):
    """(text, bucket, or what table makes of it, if not below 0) of all n-grams within texts, in blocks of about BLOCK places, so that long texts cost no more memory."""
    for lo in range(0, len(folded) - n + 1, BLOCK):
        g = grams(folded[lo : lo + BLOCK + n - 1], n, bits)
        if table is None:
            a, b = owners(begin, lo), owners(begin, lo + len(g) - 1)
            bounds = np.clip(begin[a : b + 2], lo, lo + len(g))
            if b + 1 == len(begin):  # the space after the last text
                bounds = np.r_[bounds, lo + len(g)]
            doc = np.repeat(np.arange(a, b + 1), np.diff(bounds))
            at = np.arange(lo, lo + len(g))
        else:
            g = table[g]
            at = np.flatnonzero(g >= 0)
            g = g[at]
            at += lo
            doc = owners(begin, at)
        inside = at + n <= begin[np.minimum(doc + 1, len(begin) - 1)] + 1  # the space after a text may close its last n-gram
        yield doc[inside], g[inside]


def present(column, ns: tuple[int, ...], table: np.ndarray | None = None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs, in order; features are buckets, each n in a range of its own, or what table makes of them (below 0: none)."""
    folded, begin = spaced(column)
    found = [np.zeros(0, np.int64)]
    for i, n in enumerate(ns):
        own = None if table is None else table[i << bits : (i + 1) << bits]
        for doc, g in places(folded, begin, n, bits, own):
            found.append(np.unique((doc << 32) | (g.astype(np.int64) + ((i << bits) if table is None else 0))))
    key = np.unique(np.concatenate(found))
    return key >> 32, key & 0xFFFFFFFF


def distinct(column, ns: tuple[int, ...], bits: int = BITS):
    """The distinct buckets of each text, text by text."""
    folded, begin = spaced(column)
    if len(folded) > 4 * BLOCK:  # one long text, or a few: marks instead of sorting
        for i in range(len(begin) - 1):
            part = folded[begin[i] : begin[i + 1] + 1]
            mark = np.zeros(len(ns) << bits, bool)
            for k, n in enumerate(ns):
                for lo in range(0, len(part) - n + 1, BLOCK):
                    mark[grams(part[lo : lo + BLOCK + n - 1], n, bits) + (k << bits)] = True
            yield np.flatnonzero(mark)
        return
    every = [grams(folded, n, bits) + np.int32(k << bits) for k, n in enumerate(ns)]
    for i in range(len(begin) - 1):
        yield np.unique(np.concatenate([g[begin[i] : max(begin[i], begin[i + 1] + 2 - n)] for g, n in zip(every, ns)]))
