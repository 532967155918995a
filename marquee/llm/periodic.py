"""Periodic runs: stretches of words that repeat with a smallest period.

A run is a stretch of consecutive words with smallest period q (words q apart
are identical) of at least max(``shortest``, ``copies`` * q) words that no
neighbouring word extends keeping period q.

A harmonic grid finds them: a run of period p and at least c * p words holds c
neighbouring multiples of p, so for each p the words at jp and (j+1)p are
compared, n log n pairs in all. Where enough neighbouring pairs agree, the
longest common extensions forward and backward of jp and (j+1)p, from suffix
arrays of the words and of the reversed words and range minima of their common
prefixes, give the maximal stretch of period p. Of equal stretches the smallest
period counts; a smaller period that divides p finds the same stretch.

The texts of a batch share one pair of suffix arrays, piece by piece; a mark
behind each text, different from all words and marks, keeps extensions within.
Words are told apart exactly, by their bytes. A text is handled whole, in memory
of some 150 bytes a word.

Null and empty texts have no words and no runs. A null id gets no planted
repetition. Rows that repeat are answered each."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm import kernels as K

SHORTEST, COPIES = 24, 3
PIECE = 1 << 20
#: Pairs of the grid that are looked at in one go.
PAIRS = 4_000_000
BLOCK = 64


def word_ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word, equal for equal words of these texts, and where
    each text's words begin."""
    data, offs = K.raw(texts)
    starts, ends, rows = K.word_bounds(data, offs)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)), pa.py_buffer(data[~K.IS_SPACE[data]].tobytes())])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64), rows


def suffix_array(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes in order, the place of each one, and the longest common
    prefix of each with the one before it. By doubling: the order of the first
    2h words follows from that of the first h; suffixes that stand alone are
    sorted no more. w: numbers from 0."""
    n = len(w)
    _, rank = np.unique(w, return_inverse=True)
    # the rank of a suffix is the number of suffixes that start with smaller words
    place = np.argsort(rank, kind="stable")
    rank = np.searchsorted(rank[place], rank)
    levels, h = [rank.astype(np.int32)], 1
    while h < n:
        r = rank[place]
        tied = np.zeros(n, bool)
        tied[1:] = r[1:] == r[:-1]
        tied[:-1] |= tied[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        own = place[at]
        second = np.where(own + h < n, rank[np.minimum(own + h, n - 1)] + 1, 0)
        order = np.argsort(rank[own] * (n + 1) + second, kind="stable")
        own, second = own[order], second[order]
        place[at] = own
        first = rank[own]
        head = np.ones(len(own), bool)
        head[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        new = rank.copy()
        new[own] = at[np.flatnonzero(head)][np.cumsum(head) - 1]
        rank = new
        h *= 2
        levels.append(rank.astype(np.int32))
    common = np.zeros(n, np.int64)
    a, b = place[:-1].copy(), place[1:].copy()
    got = np.zeros(max(n - 1, 0), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        # equal ranks at a level: equal words up to its length; the last level has none
        fits = (a < n) & (b < n)
        same = fits & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
        step = same.astype(np.int64) << k
        got, a, b = got + step, a + step, b + step
    common[1:] = got
    return place, rank, common


class Minima:
    """Range minima by blocks: a sparse table of the blocks' minima, running
    minima from both ends within each block; ranges within one block step by
    step."""

    def __init__(self, x: np.ndarray):
        self.n = len(x)
        blocks = -(-max(self.n, 1) // BLOCK)
        grid = np.full(blocks * BLOCK, np.iinfo(np.int32).max, np.int32)
        grid[: self.n] = x
        self.x, grid = grid, grid.reshape(blocks, BLOCK)
        self.head = np.minimum.accumulate(grid, 1).reshape(-1)
        self.tail = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].reshape(-1)
        self.table = [grid.min(1)]
        while 2 << (len(self.table) - 1) <= blocks:
            t, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(t[:-half], t[half:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The least of x[a..b], both ends included, a <= b."""
        p, q = a // BLOCK, b // BLOCK
        out = np.minimum(self.tail[a], self.head[b])
        inner = q - p - 1
        for k in np.unique(np.log2(inner[inner > 0]).astype(np.int64)):
            at = np.flatnonzero((inner >> k) == 1)
            t = self.table[k]
            out[at] = np.minimum(out[at], np.minimum(t[p[at] + 1], t[q[at] - (1 << k)]))
        near = np.flatnonzero(p == q)
        if len(near):
            lo, hi = a[near], b[near]
            least = self.x[lo]
            for _ in range(BLOCK - 1):
                lo = np.minimum(lo + 1, hi)
                least = np.minimum(least, self.x[lo])
            out[near] = least
        return out


class Extensions:
    """Longest common prefixes of any two suffixes of w."""

    def __init__(self, w: np.ndarray):
        self.n = len(w)
        _, self.rank, common = suffix_array(w)
        self.least = Minima(common)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """a and b differ and lie within w, or behind its end (0)."""
        out = np.zeros(len(a), np.int64)
        at = np.flatnonzero((a < self.n) & (b < self.n))
        r, s = self.rank[a[at]], self.rank[b[at]]
        out[at] = self.least(np.minimum(r, s) + 1, np.maximum(r, s))
        return out


def grid(w: np.ndarray, lo: int, hi: int, shortest: int, copies: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, p) of the grid of the text w[lo:hi], i = lo + jp, whose words
    at i and i + p and at enough pairs beside them agree to lie in a run of
    period p. A bounded number of pairs at a time."""
    n = hi - lo
    top = n // copies
    if n < shortest or top < 1:
        return
    p = np.arange(1, top + 1)
    count = (n - 1) // p  # pairs (jp, (j+1)p) within the text
    ends = np.cumsum(count)
    a = 0
    while a < top:
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")))
        c = count[a:b]
        first = np.cumsum(c) - c
        period = np.repeat(p[a:b], c)
        i = lo + (np.arange(len(period)) - np.repeat(first, c)) * period
        same = w[i] == w[i + period]
        # stretches of neighbouring pairs that agree, of one period each
        edge = np.zeros(len(same) + 1, bool)
        edge[first], edge[-1] = True, True
        edge[1:-1] |= same[1:] != same[:-1]
        cuts = np.flatnonzero(edge)
        long = np.diff(cuts)
        begin = cuts[:-1]
        need = np.maximum(shortest // period[begin], copies) - 1
        take = np.repeat(same[begin] & (long >= need), long)
        yield i[take], period[take]
        a = b


def stretches(w: np.ndarray, text: np.ndarray, i: np.ndarray, p: np.ndarray, shortest: int, copies: int, ends: list) -> tuple[np.ndarray, ...]:
    """(text, start, end, period): the maximal stretches of period p around i
    and i + p that are long enough. ends: the extensions of w and of w
    reversed."""
    end = i + p + ends[0](i, i + p)
    start = i - ends[1](len(w) - i, len(w) - i - p)  # of the words before both
    fits = end - start >= np.maximum(shortest, copies * p)
    return smallest(text[fits], start[fits], end[fits], p[fits])


def smallest(text: np.ndarray, start: np.ndarray, end: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of equal stretches the one of the smallest period."""
    order = np.lexsort((p, end, start, text))
    text, start, end, p = text[order], start[order], end[order], p[order]
    first = np.ones(len(text), bool)
    first[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return text[first], start[first], end[first], p[first]


def runs(w: np.ndarray, rows: np.ndarray, shortest: int = SHORTEST, copies: int = COPIES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end, period) of all runs of the texts w[rows[k]:rows[k+1]],
    by text, start and period. A text with many pairs has suffix arrays of its
    own, so that its pairs need not be held together."""
    none = np.zeros(0, np.int64)
    held, out = [], [(none, none, none, none)]
    for k, (lo, hi) in enumerate(zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)):
        own, ends = [], []
        for i, p in grid(w, lo, hi, shortest, copies):
            own.append((np.full(len(i), k), i - lo, p))
            if sum(len(x[0]) for x in own) > PAIRS // 4:
                ends = ends or [Extensions(w[lo:hi]), Extensions(w[lo:hi][::-1].copy())]
                out.append(stretches(w[lo:hi], *(np.concatenate(x) for x in zip(*own, strict=True)), shortest, copies, ends))
                own = []
        if ends and own:
            out.append(stretches(w[lo:hi], *(np.concatenate(x) for x in zip(*own, strict=True)), shortest, copies, ends))
        else:
            held += own
    if sum(len(x[0]) for x in held):
        text, i, p = (np.concatenate(x) for x in zip(*held, strict=True))
        some = np.unique(text)  # only texts with pairs are searched; a mark of its own stands behind each
        size = rows[some + 1] - rows[some] + 1
        base = np.cumsum(size) - size
        both = np.concatenate([np.append(w[rows[k] : rows[k + 1]], w.max() + 1 + m) for m, k in enumerate(some)])
        shift = base[np.searchsorted(some, text)]
        text, start, end, p = stretches(both, text, i + shift, p, shortest, copies, [Extensions(both), Extensions(both[::-1].copy())])
        shift = base[np.searchsorted(some, text)]
        out.append((text, start - shift, end - shift, p))
    text, start, end, p = smallest(*(np.concatenate(x) for x in zip(*out, strict=True)))
    order = np.lexsort((p, start, text))
    return text[order], start[order], end[order], p[order]


def planted(w: np.ndarray, rows: np.ndarray, h: list[int | None]) -> tuple[np.ndarray, list[np.ndarray | None]]:
    """The words with a repetition in every text whose h ends in 0, and of those
    texts which of their words stands where."""
    out, order = w.copy(), []
    for k, (x, lo, hi) in enumerate(zip(h, rows[:-1].tolist(), rows[1:].tolist(), strict=True)):
        n, order_k = hi - lo, None
        if x is not None and x % 10 == 0 and n:
            g = x // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            i = np.arange(n)
            order_k = np.where(i >= a, a + (i - a) % p, i)
            out[lo:hi] = w[lo + order_k]
        order.append(order_k)
    return out, order


def told(shortest: int, copies: int):
    """mapInArrow: (id, text, h) -> one row for each text."""
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.lean()
        for batch in batches:
            for a, b in K.pieces(batch.column(1), PIECE):
                texts = batch.column(1).slice(a, b - a)
                w, rows = word_ids(texts)
                w, order = planted(w, rows, batch.column(2).slice(a, b - a).to_pylist())
                text, start, end, p = runs(w, rows, shortest, copies)
                cuts = np.searchsorted(text, np.arange(b - a + 1))
                out: dict[str, list] = {k: [] for k in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed_text")}
                for k, raw in enumerate(texts.cast(pa.binary()).to_pylist()):
                    own = slice(cuts[k], cuts[k + 1])
                    mine = list(zip(start[own].tolist(), (end[own] - start[own]).tolist(), p[own].tolist(), strict=True))
                    best = min(mine, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
                    n = int(rows[k + 1] - rows[k])
                    words = (raw or b"").split()  # at the same six signs
                    if order[k] is not None or mine:
                        gone = np.zeros(n + 1, np.int64)
                        for s, length, q in mine:
                            gone[s + q] += 1
                            gone[s + length] -= 1
                        left = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
                        words = [words[i] for i in (left if order[k] is None else order[k][left]).tolist()]
                    text_left = b" ".join(words)
                    for name, v in zip(out, (len(mine), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in mine).encode()).hexdigest(), hashlib.sha256(text_left).hexdigest(), [dict(zip(("start", "length", "period"), r, strict=True)) for r in mine], text_left), strict=True):
                        out[name].append(v)
                kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.list_(kind), pa.binary()]
                cols = [pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)]
                yield pa.record_batch([batch.column(0).slice(a, b - a), *cols[:-1], cols[-1].cast(pa.string())], names=["id", *out])

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False, shortest: int = SHORTEST, copies: int = COPIES) -> DataFrame:
    """One row per document: ``id_col``, ``n_runs``; of the run of greatest
    length / period (ties: smallest start, then period) ``start`` (word number),
    ``length``, ``period`` and ``exponent_milli``, null without runs;
    ``runs_sha256`` (of ``start,length,period`` and a line feed for each run, by
    start and period), ``collapsed_sha256``; ``runs`` and ``collapsed_text``: the
    words, joined by blanks, that no run contains behind its first period.

    plant: documents whose id's CRC-32 ends in 0 get a repetition first."""
    id_ = docs[f"`{id_col}`"]
    h = F.crc32(id_.cast("string").cast("binary")) if plant else F.lit(None).cast("long")
    docs = docs.select(id_.cast("long").alias("id"), docs[f"`{text_col}`"].alias("text"), h.alias("h"))
    out = "id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>, collapsed_text string"
    return docs.mapInArrow(told(shortest, copies), out).withColumnRenamed("id", id_col)
