"""Whole-text kernels in numpy: words, hashes and shingles of many documents at once.

A slice holds the texts of some documents end to end as bytes. All arrays are flat over the slice, so the cost is a
few passes over the bytes and no Python work per word. Hashes have 64 bits: sums over random multipliers, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x = x * U64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U64(27))
        x = x * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def stream(seed: int, n: int, first: int = 0) -> np.ndarray:
    """`n` well-mixed words, by their index."""
    with np.errstate(over="ignore"):
        return mix((np.arange(first + 1, first + n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) ^ U64(seed))


BYTE = stream(11, 256)
PLACE = stream(12, 4096) | U64(1)
STEP = stream(13, 64) | U64(1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


class Slice(NamedTuple):
    first: int  # row of the batch
    buf: np.ndarray  # bytes
    offsets: np.ndarray  # of each document, and the end


class Words(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a batch into slices of whole documents; a null text is empty. One longer document is a slice of its own."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    n = len(texts)
    if not n:
        return
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + limit, "right")) - 1)
        yield Slice(i, raw[ends[i] : ends[j]], ends[i : j + 1] - ends[i])
        i = j


def per_doc(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of a value per byte over each document."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def words(s: Slice, lower: bool) -> Words:
    """The words `[^\\x20\\x09-\\x0D]+` in order, with a hash of each; `lower` folds A-Z first."""
    is_word = ~SPACE[s.buf]
    edge = np.zeros(len(s.buf) + 1, bool)
    edge[s.offsets] = True
    before = np.concatenate([[False], is_word[:-1]]) if len(is_word) else is_word
    start = np.flatnonzero(is_word & (~before | edge[:-1]))
    after = np.concatenate([is_word[1:], [False]]) if len(is_word) else is_word
    end = np.flatnonzero(is_word & (~after | edge[1:])) + 1
    doc = np.searchsorted(s.offsets, start, "right") - 1
    return Words(start, end, doc, span_hash(s.buf, is_word, start, end, lower))


def span_hash(buf: np.ndarray, inside: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """A hash of each span; the spans are all that is `inside`, in order."""
    if not len(start):
        return np.zeros(0, U64)
    b = buf[inside]
    if lower:
        b = LOWER[b]
    size = end - start
    at = np.cumsum(size) - size
    place = np.arange(len(b)) - np.repeat(at, size)
    with np.errstate(over="ignore"):
        factor = PLACE[place & 4095]
        if size.max() > 4096:
            factor = (factor * mix((place >> 12).astype(U64) + U64(1))) | U64(1)
        return mix(np.add.reduceat(BYTE[b] * factor, at) + size.astype(U64))


def windows(hashes: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first index of every run of `width` words in one document."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, U64)
        for k in range(width):
            h += hashes[k : k + n] * STEP[k]
    at = np.flatnonzero(doc[:n] == doc[width - 1 :])
    return mix(h[at]), at


def shingle_sets(s: Slice, width: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, ascending, end to end, and their offsets.

    A document of fewer than `width` words, but not none, has its whole sequence as its one shingle.
    """
    w = words(s, lower)
    n = len(s.offsets) - 1
    count = np.bincount(w.doc, minlength=n)
    h, at = windows(w.hash, w.doc, width)
    doc = w.doc[at]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        first = np.searchsorted(w.doc, short)
        with np.errstate(over="ignore"):
            one = np.array([mix(np.array([np.sum(w.hash[a : a + count[d]] * STEP[: count[d]], dtype=U64) + U64(count[d])]))[0] for d, a in zip(short, first)], U64)
        h, doc = np.concatenate([h, one]), np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))])
