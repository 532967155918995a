"""Phrase collocations: the phrases of each language whose words belong together.

Texts, A-Z in lower case, are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and
those into words ``[^\\x20\\x09]+``. Everything is counted by language.

First pass: each piece of PIECE bytes of text adds the hashes of its phrases of
1 to ``longest`` words to a count-min sketch of ROWS rows. Partial sketches are
sparse, (cell, count) by ranges of cells, and merge by addition, a range in a
task. The merged sketch never counts a phrase too low, so every phrase of
``least`` occurrences is in cells of as many. Second pass: phrases all of whose
cells hold ``least`` are counted exactly, by their words, first those of a
task and then, packed by parts of a hash, all; those that the sketch let pass
wrongly go then. A part of a candidate occurs at least as often as the
candidate, so the counts of all parts are among them.

The sketch has a cell for each four occurrences or so, up to 2**MOST_BITS in a
row; what the second pass holds of it is one bit a cell, at most
ROWS * 2**MOST_BITS / 8 bytes (256 MB), the only thing that is broadcast. Where
a table is so large that this sketch fills up (beyond some 80 GB of text), more
phrases pass and the second pass counts more of them; the result is the same.

A candidate (2 words or more, ``least`` occurrences) of a occurrences, cut where
that is lowest into parts of l and r occurrences (ties: after the fewest words),
scores floor(2000000 * a / (l + r)). Candidates within a longer one of at least
``share`` % of their occurrences go.

Null texts are empty, a null language is ``und``; rows that repeat count each."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marquee.llm import kernels as K
from marquee.llm.repeats import numbers, planes
from marquee.llm.shared import columns, cut

LONGEST, LEAST, TOP, SHARE = 4, 30, 2000, 80
ROWS, LEAST_BITS, MOST_BITS = 2, 16, 30
#: Cells of a range and ranges of a row, at least.
RANGE_BITS, LEAST_RANGES = 20, 6
PIECE = 8 << 20
#: Bytes of text whose phrases travel together, and for which there is a part of the phrases.
FLUSH, PART = 32 << 20, 64 << 20
#: Ends a piece: . , ; : ! ? line feed, vertical tab, form feed, return.
ENDS = np.zeros(256, bool)
ENDS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
BETWEEN = ENDS.copy()
BETWEEN[[0x20, 0x09]] = True


def split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes in lower case, starts and ends of the words, for each piece
    where its words begin among them, and the row of each word."""
    data, offs = K.raw(texts)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    starts, ends, rows = K.word_bounds(data, offs, BETWEEN)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(rows))
    ended = np.concatenate([[0], np.cumsum(ENDS[data])])[starts]
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (ended[1:] != ended[:-1]) | (row[1:] != row[:-1])
    return data, starts, ends, np.append(np.flatnonzero(fresh), len(starts)), row


def salts(langs: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "little") for g in langs], np.uint64)


def phrases(texts: pa.Array, langs: pa.Array, longest: int) -> Iterator[tuple]:
    """For each number of words k: k, the hashes of all phrases and at which
    word they start; first of all what they are made of."""
    data, starts, ends, pieces, row = split(texts)
    codes = langs.fill_null("und").dictionary_encode()
    names = codes.dictionary.to_pylist()
    lang = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row] if len(row) else np.zeros(0, np.int64)
    yield data, starts, ends, lang, names
    words, salt = K.word_hashes(data, starts, ends), salts(names)
    for k in range(1, longest + 1):
        h, at = K.window_hashes(words, pieces, k)
        yield k, K.mix(h + salt[lang[at]] * np.uint64(2 * k + 1)) if len(at) else h, at


def cells(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The cell of each hash in each row of the sketch."""
    for r in range(ROWS):
        yield ((h if not r else K.mix(h ^ np.uint64(r))) >> np.uint64(64 - bits)).astype(np.int64)


def ranges(bits: int) -> int:
    """Bits of the number of ranges of a row."""
    return max(LEAST_RANGES, bits - RANGE_BITS)


def partial_sketches(bits: int, longest: int):
    """mapInArrow: (text, lang) -> (part, counts): for each range of cells of
    each row the cells that a piece of texts fills, as distances, and by how
    much."""
    shift, parts = bits - ranges(bits), 1 << ranges(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.lean()
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for a, b in K.pieces(batch.column(0), PIECE):
                found = []
                for c, d in K.pieces(batch.column(0).slice(a, b - a)):
                    found += [x[1] for x in list(phrases(batch.column(0).slice(a + c, d - c), batch.column(1).slice(a + c, d - c), longest))[1:]]
                h, n = np.unique(np.concatenate(found), return_counts=True)
                del found
                part, counts = [], []
                for r, cell in enumerate(cells(h, bits)):
                    order = slice(None) if not r else np.argsort(cell, kind="stable")
                    cell, own = cell[order], n[order]
                    first = np.flatnonzero(np.diff(cell, prepend=-1))
                    total = np.add.reduceat(own, first) if len(own) else own
                    cell = cell[first]
                    edge = np.searchsorted(cell, np.arange(parts + 1) << shift)
                    for p in np.flatnonzero(np.diff(edge)):
                        x = cell[edge[p] : edge[p + 1]] - (int(p) << shift)
                        part.append(r * parts + int(p))
                        counts.append(packer.compress(len(x).to_bytes(8, "little") + planes(np.diff(x, prepend=0).astype(np.int32)) + planes(total[edge[p] : edge[p + 1]].astype(np.int32))))
                if part:
                    yield pa.record_batch([pa.array(part, pa.int32()), pa.array(counts, pa.binary())], names=["part", "counts"])

    return run


def merged(bits: int, least: int):
    """mapInArrow over rows sorted by part -> (part, full): one bit for each
    cell of the range, whether the sum of all counts is ``least`` or more."""
    size = 1 << (bits - ranges(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.lean()
        now, sums = None, np.zeros(size, np.int64)

        def told() -> pa.RecordBatch:
            full = zstandard.ZstdCompressor(level=1).compress(np.packbits(sums >= least).tobytes())
            return pa.record_batch([pa.array([now], pa.int32()), pa.array([full], pa.binary())], names=["part", "full"])

        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if part != now:
                    if now is not None:
                        yield told()
                        sums[:] = 0
                    now = part
                data = zstandard.ZstdDecompressor().decompress(counts.as_buffer())
                n = int.from_bytes(data[:8], "little")
                step, at = numbers(data, 8, n, np.int32)
                more, _ = numbers(data, at, n, np.int32)
                sums[np.cumsum(step)] += more  # a cell once in each partial sketch
        if now is not None:
            yield told()

    return run


_bitmaps: dict[str, list[np.ndarray]] = {}


def bitmaps(held, bits: int) -> list[np.ndarray]:
    """In a worker: the bits of each row of the sketch, unpacked once."""
    if held.value[0] not in _bitmaps:
        _bitmaps.clear()
        out, size = np.zeros((ROWS, 1 << (bits - 3)), np.uint8), 1 << (bits - ranges(bits) - 3)
        flat = out.reshape(-1)
        for part, full in held.value[1]:
            flat[part * size : (part + 1) * size] = np.frombuffer(zstandard.ZstdDecompressor().decompress(full), np.uint8)
        _bitmaps[held.value[0]] = list(out)
    return _bitmaps[held.value[0]]


#: Phrases as they travel, without the schema.
COUNTS = pa.schema([("lang", pa.string()), ("k", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])


def summed(tables: list[pa.Table]) -> pa.Table:
    """Equal phrases of a language as one row, in order."""
    rows = pa.concat_tables(tables).group_by(["lang", "k", "phrase"]).aggregate([("n", "sum"), *[(c, "max") for c in tables[0].column_names[4:]]])
    rows = rows.rename_columns([c.removesuffix("_sum").removesuffix("_max") for c in rows.column_names])
    return rows.sort_by([("lang", "ascending"), ("phrase", "ascending")])


def survivors(held, bits: int, longest: int, part_bits: int):
    """mapInArrow: (text, lang) -> (part, counts): the phrases that the sketch
    lets pass, told apart by their words, and how often FLUSH bytes of text or so
    hold them, packed by the first bits of a hash; with k = 0 the number of
    words."""

    def told(lang: pa.Array, k: int, phrase: pa.Array, n: np.ndarray, h: np.ndarray) -> pa.Table:
        part = (h >> np.uint64(64 - part_bits)).astype(np.int32)
        return pa.table([lang.cast(pa.string()), pa.array(np.full(len(n), k), pa.int32()), phrase, pa.array(n.astype(np.int64)), pa.array(part)], names=[*COUNTS.names, "part"])

    def packed(tables: list[pa.Table]) -> pa.RecordBatch:
        rows = summed(tables)
        part = rows.column("part").to_numpy()
        order = np.argsort(part, kind="stable")
        rows = rows.select(COUNTS.names).take(pa.array(order)).combine_chunks()
        cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
        packer, out = zstandard.ZstdCompressor(level=3), []
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(part)], strict=True):
            some = pa.Table.from_batches(rows.slice(a, b - a).to_batches(), COUNTS).combine_chunks().to_batches()[0]
            own = pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in some.columns], schema=COUNTS)
            out.append(packer.compress(own.serialize().to_pybytes()))
        return pa.record_batch([pa.array(part[order][cuts], pa.int32()), pa.array(out, pa.binary())], names=["part", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.lean()
        found, read = [], 0
        for batch in batches:
            for a, b in K.pieces(batch.column(0), PIECE // 4):
                rest = phrases(batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), longest)
                data, starts, ends, lang, names = next(rest)
                if not len(starts):
                    continue
                read += len(data)
                size = ends - starts
                begin = np.concatenate([[0], np.cumsum(size)])
                on = np.repeat(starts - begin[:-1], size) + np.arange(begin[-1])
                text = data[on]
                ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(begin.astype(np.int64)), pa.py_buffer(text.tobytes())]).dictionary_encode().indices.to_numpy().astype(np.int64)
                many = int(ids.max()) + 1
                spaced = np.full(len(text) + len(starts), 0x20, np.uint8)  # a blank behind each word
                spaced[np.arange(len(text)) + np.repeat(np.arange(len(starts)), size)] = text
                begin = begin + np.arange(len(begin))
                n = np.bincount(lang, minlength=len(names))
                some = np.flatnonzero(n)
                found.append(told(pa.array(names).take(pa.array(some)), 0, pa.nulls(len(some), pa.string()), n[some], salts(names)[some]))
                for k, h, at in rest:
                    passes = np.ones(len(h), bool)
                    for full, cell in zip(bitmaps(held, bits), cells(h, bits), strict=True):
                        passes &= (full[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
                    at, h = at[passes], h[passes]
                    if not len(at):
                        continue
                    code = lang[at]
                    for j in range(k):
                        values, code = np.unique(code * many + ids[at + j], return_inverse=True)
                    _, first, n = np.unique(code, return_index=True, return_counts=True)
                    at = at[first]
                    size_k = begin[at + k] - 1 - begin[at]
                    offs = np.concatenate([[0], np.cumsum(size_k)])
                    own = spaced[np.repeat(begin[at] - offs[:-1], size_k) + np.arange(offs[-1])]
                    phrase = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(own.tobytes())])
                    found.append(told(pa.array(names).take(pa.array(lang[at])), k, phrase.cast(pa.large_string()).cast(pa.string()), n, h[first]))
                if read >= FLUSH:
                    yield packed(found)
                    found, read = [], 0
        if found:
            yield packed(found)

    return run


def counted(least: int):
    """mapInArrow over rows sorted by part -> (lang, k, phrase, f): phrases with
    ``least`` occurrences or more, and the numbers of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.lean()
        now, held, size = None, [], 0

        def told() -> Iterator[pa.RecordBatch]:
            rows = summed(held).rename_columns(["lang", "k", "phrase", "f"])
            keep = (rows.column("k").to_numpy() == 0) | (rows.column("f").to_numpy() >= least)
            yield from rows.filter(pa.array(keep)).to_batches()

        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if part != now:
                    if held:
                        yield from told()
                    now, held, size = part, [], 0
                data = zstandard.ZstdDecompressor().decompress(counts.as_buffer())
                held.append(pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(data), COUNTS)]))
                size += len(data)
                if size > FLUSH:  # a part never holds more than its distinct phrases and so much
                    held, size = [summed(held).select(COUNTS.names)], 0
        if held:
            yield from told()

    return run


def frequent(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(lang, k, phrase, f) of all phrases of (text, lang) with ``least``
    occurrences or more, exactly, and with k = 0 the number of words of each
    language."""
    spark = docs.sparkSession
    size = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    # a word has 6 bytes or so, and each starts a phrase of every length; 2 to 4 of these share a cell
    bits = min(MOST_BITS, max(LEAST_BITS, (size * longest // 24).bit_length() - 2))
    parts = ROWS << ranges(bits)
    sketch = docs.select("text", "lang").mapInArrow(partial_sketches(bits, longest), "part int, counts binary").repartition(parts, "part").sortWithinPartitions("part")
    full = sketch.mapInArrow(merged(bits, least), "part int, full binary").collect()  # at most ROWS * 2**MOST_BITS bits
    held = spark.sparkContext.broadcast((uuid.uuid4().hex, [(r["part"], bytes(r["full"])) for r in full]))
    part_bits = max(6, (size // PART).bit_length())
    found = docs.select("text", "lang").mapInArrow(survivors(held, bits, longest, part_bits), "part int, counts binary").repartition(1 << part_bits, "part").sortWithinPartitions("part")
    found = cut(found.mapInArrow(counted(least), "lang string, k int, phrase string, f long"), "phrases")
    held.unpersist()
    return found


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, top: int = TOP, share: int = SHARE) -> DataFrame:
    """The ``top`` candidates of each language by score, occurrences and phrase
    (byte order): ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` (the
    language's words) and ``score``."""
    counts = frequent(columns(docs, text=text_col, lang=lang_col), longest, least)
    some = counts.where("k > 1").select("lang", "k", "phrase", F.col("f").alias("a"))
    cuts = some.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("at"))
    cuts = cuts.select("lang", "phrase", "a", "at", F.expr("substring_index(phrase, ' ', at)").alias("first"), F.expr("substring_index(phrase, ' ', at - k)").alias("rest"))
    for side, name in (("first", "l"), ("rest", "r")):
        part = counts.where("k > 0").select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
        cuts = cuts.join(part, ["lang", side]).drop(side)
    score = F.expr("cast(2000000 as decimal(8,0)) * cast(a as decimal(20,0)) div cast(l + r as decimal(20,0))")  # the product has 28 digits
    low = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "at", "l", "r", "a")).alias("x"))
    low = low.select("lang", "phrase", "x.a", "x.l", "x.r", "x.score")
    within = "flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))"
    longer = some.where("k > 2").select(F.col("lang").alias("of"), F.explode(F.expr(within)).alias("part"), "a").groupBy("of", "part").agg(F.max("a").alias("most"))
    kept = low.join(longer, (low["lang"] == longer["of"]) & (low["phrase"] == longer["part"]), "left").where(F.col("most").isNull() | (F.col("most").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * share))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = kept.select("lang", rank.alias("rank"), "phrase", "a", "l", "r", "score").where(F.col("rank") <= top)
    words = counts.where("k = 0").select(F.col("lang").alias("of"), F.col("f").alias("n"))
    return best.join(words, best["lang"] == words["of"]).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
