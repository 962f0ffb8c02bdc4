"""Numpy kernels over the UTF-8 bytes of a batch of texts: words, word shingles and weighted sets.

Texts come as an Arrow string array; its buffers are read in place. Work goes in slices of half a
megabyte of text, so that a task's memory doesn't follow the batch. Words are runs of ASCII
letters and digits and of all non-ASCII bytes; A-Z count as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19

_U = np.uint64
_WORD = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _WORD[_a:_b] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit words that spreads every bit."""
    x = x + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(256, dtype=np.uint64)) | _U(1)
_P = 0xD6E8FEB86659FD93  # an odd multiplier, so that it has an inverse modulo 2**64
_P_INVERSE = pow(_P, -1, 1 << 64)


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    filled = 1
    while filled < n:
        step = min(filled, n - filled)
        out[filled : filled + step] = out[:step] * _U(pow(base, filled, 1 << 64))
        filled += step
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1] from 64-bit words."""
    return ((x >> _U(11)).astype(np.float64) + 1.0) * 2.0**-53


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about ``limit`` bytes; null texts are empty."""
    texts = texts.cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64, n + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        high = min(high, n, low + 60_000)
        yield low, high, raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start byte, end byte) of every word, and the first word of each text with the total at its end."""
    inside = _WORD[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True  # a word ends with its text
    starts = np.flatnonzero(inside & ~(np.concatenate(([False], inside[:-1])) & ~edge[:-1]))
    ends = np.flatnonzero(inside & ~(np.concatenate((inside[1:], [False])) & ~edge[1:])) + 1
    n = len(raw)
    size = 1 << max(10, int(n).bit_length())
    powers = _powers if size <= 2 * SLICE_BYTES else _powers.__wrapped__  # those of a very long text aren't kept
    up, down = powers(_P, size), powers(_P_INVERSE, size)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[_LOWER[raw]] * up[:n], dtype=np.uint64)))
    hashes = mix((total[ends] - total[starts]) * down[starts] ^ (ends - starts).astype(np.uint64))
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every run of ``k`` words; a shorter text that has words is one run."""
    n_words = np.diff(first)
    n = np.where(n_words >= k, n_words - k + 1, (n_words > 0).astype(np.int64))
    text = np.repeat(np.arange(len(n)), n)
    before = np.cumsum(n) - n
    at = np.arange(len(text)) - before[text] + first[:-1][text]
    end = first[1:][text]
    out = np.zeros(len(text), np.uint64)
    for j in range(k):
        there = at + j < end
        word = np.where(there, hashes[np.minimum(at + j, len(hashes) - 1)], _U(j + 1)) if len(hashes) else out
        out = out * _U(0x9FB21C651E98DF25) + word
        out ^= out >> _U(32)
    return text, mix(out)


def weighted(texts: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice: (first row, end row, text, element, count) of the texts' multisets of word shingles.

    An element is a 48-bit hash. Rows are in order of text, then element.
    """
    for low, high, raw, offsets in slices(texts):
        hashes, _, _, first = words(raw, offsets)
        text, h = shingles(hashes, first, k)
        key = (text.astype(np.uint64) << _U(48)) | (h >> _U(16))
        key.sort()
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.append(new, len(key)))
        key = key[new]
        yield low, high, (key >> _U(48)).astype(np.int64), key & _U((1 << 48) - 1), count


def overlap(a: pa.Array, b: pa.Array, k: int) -> np.ndarray:
    """Weighted Jaccard similarity of the shingle multisets of the texts in each row; 0 if both are empty."""
    out = np.zeros(len(a))
    step = max(1, int(len(a) // max(1, (a.nbytes + b.nbytes) // SLICE_BYTES + 1)))
    for low in range(0, len(a), step):
        x, y = a.slice(low, step), b.slice(low, step)
        n = len(x)
        (tx, ex, cx), (ty, ey, cy) = ([np.concatenate(p) for p in zip(*[(t + f, e, c) for f, _, t, e, c in weighted(z, k)], strict=True)] for z in (x, y))
        both = np.bincount(tx, cx, n) + np.bincount(ty, cy, n)
        kx, ky = (tx.astype(np.uint64) << _U(48)) | ex, (ty.astype(np.uint64) << _U(48)) | ey
        at = np.searchsorted(kx, ky)
        same = at < len(kx)
        same[same] = kx[at[same]] == ky[same]
        least = np.minimum(cx[at[same]], cy[same])
        shared = np.bincount(ty[same], least, n)
        with np.errstate(invalid="ignore"):
            out[low : low + n] = np.where(both > 0, shared / (both - shared), 0.0)
    return out
