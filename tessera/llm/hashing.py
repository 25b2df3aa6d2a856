"""Vectorised word and shingle hashes over the UTF-8 bytes of Arrow strings.

Words are runs of bytes outside ``\\x20\\x09-\\x0D``; these are all ASCII, so
bytes and characters give the same words.  All arithmetic is modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at a time.
CHUNK = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_GRAM = 0xA0761D6478BD642F

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def string_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array (null: empty)."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    arr = arr.cast(pa.large_string())
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, np.int64)[arr.offset: arr.offset + len(arr) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def word_spans(buf: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word; no word crosses a cut (document start)."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gap = SPACE[buf]
    begin = np.ones(n + 1, bool)
    begin[1:] = np.append(gap, True)[:n]
    begin[cuts[cuts < n]] = True
    starts = np.flatnonzero(begin[:n] & ~gap)
    stop = np.ones(n + 1, bool)
    stop[:n] = gap
    stop[cuts[cuts < n]] = True
    ends = np.flatnonzero(stop[1:] & ~gap) + 1
    return starts, ends


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span, from prefix sums of a polynomial in the bytes."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
        size = int(ends[j - 1] - base)
        up, down = _powers(1 << max(20, size.bit_length()))
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(BYTE[buf[base:base + size]] * up[:size], dtype=np.uint64, out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[e] - sums[s]) * down[s]
        i = j
    return mix(out + (ends - starts).astype(np.uint64) * _STEP)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive values, by doubling; length len(h) - k + 1."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    k = int(k)
    n = len(h) - k + 1
    out, done, power, width = np.zeros(n, np.uint64), 0, h, 1
    scale, shift, low = _GRAM, 1, (1 << 64) - 1  # scale: factor of a value `width` places further on
    while True:
        if k & width:
            out = out + power[done:done + n] * np.uint64(shift)
            shift, done = shift * scale & low, done + width
        if width * 2 > k:
            return mix(out + np.uint64(int(k) * _GRAM & low))
        power = power[:len(power) - width] + power[width:] * np.uint64(scale)
        scale, width = scale * scale & low, width * 2


def chunks(arr: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Documents of a string array, a megabyte (or one longer document) at a
    time: first and last document, bytes, word starts, word ends, and for each
    document of the chunk the index of its first word (one more at the end)."""
    data, off = string_buffers(arr)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + CHUNK, "right")) - 1)
        buf = data[off[lo]:off[hi]]
        if lower:
            buf = LOWER[buf]
        cuts = off[lo:hi] - off[lo]
        starts, ends = word_spans(buf, cuts)
        first = np.append(np.searchsorted(starts, cuts), len(starts))
        yield lo, hi, buf, starts, ends, first
        lo = hi


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
