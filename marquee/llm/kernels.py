"""Vectorised kernels over Arrow strings: words, word hashes, window hashes.

Texts are handled as one byte buffer a batch. Polynomial prefix sums modulo
2**64 give the hash of any byte or word range with two look-ups and one
multiplication by an inverse power (Rabin-Karp), so each byte is touched a
fixed number of times whatever the window length."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BYTES_BASE, WORDS_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
#: Of a second polynomial, where 64 bits are too few.
BYTES_BASE_2, WORDS_BASE_2 = 0xAF251AF3B0F025B5, 0x9FB21C651E98DF25
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: ASCII white space: blank, tab, line feed, vertical tab, form feed, return.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


_lean = False


def lean() -> None:
    """In a Python worker: memory of large arrays goes back to the system when
    they are freed, instead of staying with a worker that waits to be used
    again. The thresholds are glibc's; elsewhere nothing is done."""
    global _lean
    if not _lean and sys.platform == "linux":
        try:
            c = ctypes.CDLL(None)
            c.mallopt(-3, 1 << 19)  # M_MMAP_THRESHOLD
            c.mallopt(-1, 1 << 22)  # M_TRIM_THRESHOLD
        except (OSError, AttributeError):
            pass
        pa.set_memory_pool(pa.system_memory_pool())
    _lean = True


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n, at least."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[base] = (out[0], out[1])
    return _powers[base]


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def pieces(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes; a longer text stands alone."""
    ends = raw(texts)[1]
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        yield at, to
        at = to


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (from 0) of an Arrow string array; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offs, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return d, o - o[0]


def word_bounds(data: np.ndarray, offs: np.ndarray, between: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (maximal runs without ASCII white space, or
    without other bytes that stand between words) and, for each row, where its
    words begin among them."""
    on = ~between[data]
    prev, nxt = np.zeros(len(on), bool), np.zeros(len(on), bool)
    prev[1:], nxt[:-1] = on[:-1], on[1:]
    inner = offs[(offs > 0) & (offs < len(on))]
    prev[inner], nxt[inner - 1] = False, False
    starts, ends = np.flatnonzero(on & ~prev), np.flatnonzero(on & ~nxt) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BYTES_BASE) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    p, inv = powers(base, len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inv[starts])


def window_hashes(w: np.ndarray, rows: np.ndarray, k: int, base: int = WORDS_BASE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of k consecutive words of one row, and where each
    begins. rows: where each row's words begin among w."""
    n = np.maximum(np.diff(rows) - (k - 1), 0)
    if not n.sum():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.cumsum(n) - n
    at = np.arange(n.sum()) + np.repeat(rows[:-1] - first, n)
    p, inv = powers(base, len(w))
    sums = np.zeros(len(w) + 1, np.uint64)
    np.cumsum(w * p[: len(w)], out=sums[1:])
    return mix((sums[at + k] - sums[at]) * inv[at]), at


def shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-word shingle hashes of each text, sorted within it, and
    the offsets of the texts. A text of 1 to k-1 words has one shingle, all of
    it; without words it has none."""
    data, offs = raw(texts)
    starts, ends, rows = word_bounds(data, offs)
    w = word_hashes(data, starts, ends)
    h, at = window_hashes(w, rows, k)
    doc = np.searchsorted(rows, at, "right") - 1
    few = np.flatnonzero((np.diff(rows) > 0) & (np.diff(rows) < k))
    if len(few):
        p, inv = powers(WORDS_BASE, len(w))
        sums = np.zeros(len(w) + 1, np.uint64)
        np.cumsum(w * p[: len(w)], out=sums[1:])
        extra = mix((sums[rows[few + 1]] - sums[rows[few]]) * inv[rows[few]] + np.diff(rows)[few].astype(np.uint64))
        into = np.searchsorted(doc, few)
        h, doc = np.insert(h, into, extra), np.insert(doc, into, few)
    ends = np.searchsorted(doc, np.arange(len(texts) + 1))
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    return h, np.searchsorted(doc, np.arange(len(texts) + 1))


def minhashes(h: np.ndarray, offs: np.ndarray, count: int, seed: int) -> np.ndarray:
    """count MinHash values (uint32) of each non-empty set; rows of empty sets
    are all ones. h: 64-bit hashes, sets one after another."""
    out = np.full((len(offs) - 1, count), np.iinfo(np.uint32).max, np.uint32)
    full = np.flatnonzero(np.diff(offs) > 0)
    if not len(full):
        return out
    at = offs[full]
    low, high = h.astype(np.uint32), (h >> np.uint64(32)).astype(np.uint32)
    rng = np.random.default_rng(seed)
    mul = rng.integers(0, 1 << 32, (count, 2), dtype=np.uint32) | np.uint32(1)
    x, y = np.empty_like(low), np.empty_like(low)
    for i in range(count):
        np.multiply(low, mul[i, 0], out=x)
        np.right_shift(x, np.uint32(15), out=y)
        np.bitwise_xor(x, y, out=x)
        np.add(x, high, out=x)
        np.multiply(x, mul[i, 1], out=x)
        out[full, i] = np.minimum.reduceat(x, at)
    return out
