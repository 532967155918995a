"""Which keys of documents (windows of words, lines) occur again, and where.

Each key is a hash of 96 bits, of two polynomials of the bytes. Keys are dealt by
ranges of their first bits to parts; each part puts its keys in the order of
(key, id, tag, position) and tells all occurrences but the first ones: those of
the smallest document, or only the smallest occurrence itself. Before that, each
piece of PIECE bytes of text tells its own: what is not a first occurrence there
goes for certain, and only the first ones travel, so a key that a third of all
documents hold reaches its part once a piece. Occurrences travel in packed
slices: what the part does not tell of the key, and the compressed distances to
the positions before.

A task holds one part at a time, so the number of tasks is bounded while parts
grow with the table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from marquee.llm import kernels as K

PART_KEYS, PIECE, TASKS = 1_000_000, 8 << 20, 16_384
#: Bytes of a key's second polynomial that travel.
SECOND = 4
#: (texts) -> the keys' first and last 64 bits, the rows that hold them and the positions there.
Keys = Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def planes(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones, and so on."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def numbers(data: bytes, at: int, n: int, kind: type) -> tuple[np.ndarray, int]:
    width = np.dtype(kind).itemsize
    x = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
    return np.ascontiguousarray(x).view(kind).reshape(n), at + n * width


def width(bits: int) -> int:
    """Bytes of a key whose first ``bits`` bits are known."""
    return SECOND + -(-(64 - bits) // 8)


def slices(keys: Keys, bits: int, piece: int, by_document: bool):
    """mapInArrow: (id, tag, text) -> packed slices (part, id, tag, keys, rest):
    a slice holds the occurrences of one part, the first ``bits`` bits of the
    key, in the order of the rows: the last bytes of the keys, and the rows'
    ids, tags and numbers of keys with the steps from position to position. Rows
    without keys bring the repeated positions of one document in its piece."""
    parts, keep = 1 << bits, width(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.lean()
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            all_ids, all_tags, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
            for a, b in K.pieces(texts, piece):
                found = []
                for c, d in K.pieces(texts.slice(a, b - a)):
                    hi, lo, doc, pos = keys(texts.slice(a + c, d - c))
                    found.append((hi, lo, (doc + a + c).astype(np.int32), pos.astype(np.int32)))
                hi, lo, doc, pos = (np.concatenate(x) for x in zip(*found, strict=True))
                del found
                if not len(hi):
                    continue
                out: dict[str, list] = {k: [] for k in ("part", "id", "tag", "keys", "rest")}
                ids, tags = all_ids[doc].astype(np.int64), all_tags[doc].astype(np.int64)
                o = again(hi, lo, ids, tags, pos, by_document)
                for i, t, at in by_id(o, ids, tags, pos):
                    for k, v in (("part", i % parts), ("id", i), ("tag", t), ("keys", b""), ("rest", at)):
                        out[k].append(v)
                stays = np.ones(len(hi), bool)
                stays[o] = False
                hi, lo, doc, pos = hi[stays], lo[stays], doc[stays], pos[stays]
                part = (hi >> np.uint64(64 - bits)).astype(np.int16 if bits < 16 else np.int32)
                order = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[order], np.arange(parts + 1))
                hi, lo, doc, pos = hi[order], lo[order], doc[order], pos[order]
                for p in np.flatnonzero(np.diff(cuts)):
                    own = slice(cuts[p], cuts[p + 1])
                    d = doc[own]
                    first = np.flatnonzero(np.diff(d, prepend=-1))
                    step = np.diff(pos[own], prepend=np.int32(0)).astype(np.int32)
                    step[first] = pos[own][first]
                    both = np.empty((len(d), SECOND + 8), np.uint8)
                    both[:, :SECOND], both[:, SECOND:] = lo[own].view(np.uint8).reshape(-1, 8)[:, :SECOND], hi[own].view(np.uint8).reshape(-1, 8)
                    out["part"].append(int(p))
                    out["id"].append(None)
                    out["tag"].append(None)
                    out["keys"].append(both[:, :keep].tobytes())
                    out["rest"].append(packer.compress(len(first).to_bytes(8, "little") + planes(np.diff(all_ids[d[first]].astype(np.int64), prepend=0)) + planes(all_tags[d[first]].astype(np.int64)) + planes(np.diff(np.append(first, len(d))).astype(np.int32)) + planes(step)))
                yield pa.record_batch([pa.array(out["part"], pa.int32()), pa.array(out["id"], pa.int64()), pa.array(out["tag"], pa.int64()), pa.array(out["keys"], pa.binary()), pa.array(out["rest"], pa.binary())], names=["part", "id", "tag", "keys", "rest"])

    return run


def opened(keys: pa.Buffer, rest: pa.Buffer, keep: int) -> tuple[np.ndarray, ...]:
    """A slice's keys (without the part's bits above), ids, tags and positions,
    one for each occurrence."""
    some = np.frombuffer(keys, np.uint8).reshape(-1, keep)
    both = np.zeros((2, len(some), 8), np.uint8)
    both[0, :, :SECOND], both[1, :, : keep - SECOND] = some[:, :SECOND], some[:, SECOND:]
    lo, hi = both.view(np.uint64).reshape(2, -1)
    data = zstandard.ZstdDecompressor().decompress(rest)
    docs = int.from_bytes(data[:8], "little")
    ids, at = numbers(data, 8, docs, np.int64)
    tags, at = numbers(data, at, docs, np.int64)
    n, at = numbers(data, at, docs, np.int32)
    step, _ = numbers(data, at, len(some), np.int32)
    total = np.cumsum(step.astype(np.int64))
    first = np.cumsum(n) - n
    base = total[first] - step[first]
    return hi, lo, np.repeat(np.cumsum(ids), n), np.repeat(tags, n), (total - np.repeat(base, n)).astype(np.int32)


def again(hi: np.ndarray, lo: np.ndarray, ids: np.ndarray, tags: np.ndarray, pos: np.ndarray, by_document: bool) -> np.ndarray:
    """Where, in order of (id, tag, position), each key occurs but for its
    smallest (id, tag, position) or, by document, but for its smallest (id, tag)."""
    order = np.argsort(hi)
    s = hi[order]
    same = s[1:] == s[:-1]
    several = np.zeros(len(s), bool)
    several[1:] |= same
    several[:-1] |= same
    o = order[several]
    o = o[np.lexsort((pos[o], tags[o], ids[o], lo[o], hi[o]))]
    head = np.ones(len(o), bool)
    head[1:] = (hi[o][1:] != hi[o][:-1]) | (lo[o][1:] != lo[o][:-1])
    lead = o[np.flatnonzero(head)][np.cumsum(head) - 1] if len(o) else o
    other = (ids[o] != ids[lead]) | (tags[o] != tags[lead])
    o = o[other] if by_document else o[other | (pos[o] != pos[lead])]
    return o[np.lexsort((pos[o], tags[o], ids[o]))]


def by_id(o: np.ndarray, ids: np.ndarray, tags: np.ndarray, pos: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """The positions of each (id, tag); o is in their order."""
    if not len(o):
        return
    i, t = ids[o], tags[o]
    first = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (t[1:] != t[:-1])]))
    for a, b in zip(first, np.append(first[1:], len(o)), strict=True):
        yield int(i[a]), int(t[a]), pos[o[a:b]].tobytes()


def repeats(buckets: int, bits: int, by_document: bool):
    """mapInArrow over slices sorted by part -> (bucket, ids, tags, positions):
    the repeated positions that a task finds, packed by a hash of the id."""
    keep = width(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.lean()
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def count(held: list) -> None:
            hi, lo, ids, tags, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            o = again(hi, lo, ids, tags, pos, by_document)
            found.append((ids[o], tags[o], pos[o]))

        def told() -> pa.RecordBatch:
            ids, tags, pos = (np.concatenate(x) for x in zip(*found, strict=True))
            found.clear()
            to = (K.mix(ids.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[order], np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(cuts))
            at = [order[cuts[b] : cuts[b + 1]] for b in some]
            return pa.record_batch([pa.array(some.astype(np.int32)), *[pa.array([x[o].tobytes() for o in at], pa.binary()) for x in (ids, tags, pos)]], names=["bucket", "ids", "tags", "positions"])

        now, held = None, []
        for batch in batches:
            for r in range(batch.num_rows):
                part = batch.column(0)[r].as_py()
                keys, rest = batch.column(3)[r].as_buffer(), batch.column(4)[r].as_buffer()
                if part != now and held:
                    count(held)
                    held = []
                now = part
                if keys.size:
                    held.append(opened(keys, rest, keep))
                else:
                    at = np.frombuffer(rest, np.int32).copy()
                    found.append((np.full(len(at), batch.column(1)[r].as_py()), np.full(len(at), batch.column(2)[r].as_py()), at))
                if len(found) >= 4096:
                    yield told()
        if held:
            count(held)
        if found:
            yield told()

    return run


def gathered(pack: Callable[[np.ndarray], bytes]):
    """mapInArrow over rows sorted by bucket: one row (id, tag, n, found) for
    each document, its positions as ``pack`` makes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.lean()

        def told(held: list) -> pa.RecordBatch:
            ids, tags, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            found = [(i, t, np.unique(np.frombuffer(p, np.int32))) for i, t, p in by_id(np.lexsort((tags, ids)), ids, tags, pos)]
            return pa.record_batch([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([len(x[2]) for x in found], pa.int64()), pa.array([pack(x[2]) for x in found], pa.binary())], names=["id", "tag", "n", "found"])

        now, held = None, []
        for batch in batches:
            for r in range(batch.num_rows):
                bucket = batch.column(0)[r].as_py()
                if bucket != now and held:
                    yield told(held)
                    held = []
                now = bucket
                held.append(tuple(np.frombuffer(batch.column(k)[r].as_buffer(), t) for k, t in ((1, np.int64), (2, np.int64), (3, np.int32))))
        if held:
            yield told(held)

    return run


def repeated(docs: DataFrame, keys: Keys, size: int, by_document: bool, pack: Callable[[np.ndarray], bytes]) -> DataFrame:
    """(id, tag, n, found) of those documents (id, tag, text) that hold repeated
    keys. size: how many keys there are, roughly."""
    bits = max(8, (size // PART_KEYS).bit_length())
    tasks = min(TASKS, max(8, (1 << bits) // 4))
    packed = docs.where("id is not null").select("id", "tag", "text").mapInArrow(slices(keys, bits, PIECE, by_document), "part int, id long, tag long, keys binary, rest binary")
    packed = packed.repartition(tasks, "part").sortWithinPartitions("part")
    found = packed.mapInArrow(repeats(tasks, bits, by_document), "bucket int, ids binary, tags binary, positions binary")
    return found.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(gathered(pack), "id long, tag long, n long, found binary")
