"""Best-fit packing with several sequence lengths.

Documents become items of their words and one end mark; what is longer than the
longest permitted length is cut into full sequences and a rest. Items are dealt
by a hash of the id and of their place in the input to groups of GROUP_TOKENS
tokens or so, and each group is packed on its own: the number of groups follows
the data, their size does not, whatever ids are null or repeat.

Within a group items go, longest first, into the open bin that they fill best.
Where none has room a bin opens, of the permitted length with the least cost a
token that can still be put into it. At the end each bin shrinks to the least
length that holds its contents. This is done once for each permitted length as
the longest that may be opened freely, and the packing of least total cost
stays. A sequence of length c costs OVERHEAD + c (1 + c / ATTENTION).

Null texts and texts without words are items of no tokens, without a bin. Rows
with null ids are packed like others; repeated rows are packed again. The same
input files give the same groups."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm import kernels as K
from marquee.llm.shared import columns, cut

LENGTHS = (512, 1024, 2048, 4096, 8192)
GROUP_TOKENS, OVERHEAD, ATTENTION = 4_000_000, 32, 16384


def cost(c: int) -> float:
    return OVERHEAD + c * (1 + c / ATTENTION)


def fill(items: list[int], lengths: tuple[int, ...], longest: int) -> tuple[list[int], list[int], float]:
    """Bins of the items (sorted, longest first), the bins' final lengths and
    the total cost."""
    rest = sum(items)
    room: list[tuple[int, int]] = []  # (free tokens, bin), sorted
    where, used, sizes = [], [], []
    for n in items:
        at = bisect_left(room, (n, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            fits = [c for c in lengths if c >= n]
            free = min([c for c in fits if c <= longest] or fits[:1], key=lambda c: (cost(c) / min(c, rest), c))
            b = len(used)
            used.append(0)
            sizes.append(free)
        where.append(b)
        used[b] += n
        rest -= n
        if free > n:
            insort(room, (free - n, b))
    final = [next(c for c in lengths if c >= u) for u in used]
    return where, final, sum(map(cost, final))


def pack(items: list[int], lengths: tuple[int, ...]) -> tuple[list[int], list[int]]:
    where, final, _ = min((fill(items, lengths, c) for c in lengths), key=lambda x: x[2])
    return where, final


def grouped(lengths: tuple[int, ...]):
    """applyInArrow: (group, id, tokens) -> pieces with their places."""
    top = lengths[-1]

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("id", "ascending"), ("tokens", "ascending")])
        ids, tokens = rows.column("id").to_pylist(), rows.column("tokens").to_numpy()
        n = np.maximum(-(-tokens // top), 1)
        doc = np.repeat(np.arange(len(tokens)), n)
        piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        size = np.minimum(tokens[doc] - piece * top, top)
        order = np.lexsort((piece, doc, -size))
        order = order[size[order] > 0]
        where, final = pack(size[order].tolist(), lengths)
        bins, offset = np.full(len(size), -1), np.zeros(len(size), np.int64)
        at = [0] * len(final)
        for i, b in zip(order.tolist(), where, strict=True):
            bins[i], offset[i] = b, at[b]
            at[b] += int(size[i])
        none = pa.array(bins < 0)
        masked = lambda x, t: pa.compute.if_else(none, pa.scalar(None, t), pa.array(x).cast(t))
        length = np.array([*final, 0])[bins]
        return pa.table([pa.array([ids[d] for d in doc], rows.schema.field("id").type), pa.array(piece.astype(np.int32)), pa.array(piece * top), pa.array(size.astype(np.int64)), pa.array(np.full(len(size), key[0].as_py()), pa.int64()), masked(bins, pa.int32()), masked(offset, pa.int64()), masked(length, pa.int32())], names=["id", "piece", "start", "tokens", "bin_group", "bin", "bin_offset", "bin_length"])

    return run


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (id, text) -> (id, tokens, place), the place in the batch."""
    K.lean()
    for batch in batches:
        tokens = np.zeros(batch.num_rows, np.int64)
        for a, b in K.pieces(batch.column("text")):
            data, offs = K.raw(batch.column("text").slice(a, b - a))
            tokens[a:b] = np.diff(K.word_bounds(data, offs)[2])
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(tokens + (tokens > 0)), pa.array(np.arange(batch.num_rows, dtype=np.int32))], names=["id", "tokens", "place"])


def best_fit_packing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """One row per piece of a document: ``id_col``, ``piece`` (from 0),
    ``start`` (its first token), ``tokens``, ``bin_group`` and ``bin``, which
    name the sequence, ``bin_offset`` and ``bin_length``."""
    rows = columns(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    rows = cut(rows.mapInArrow(counted, f"id {kind}, tokens long, place int"), "items")
    total = rows.agg(F.sum("tokens")).first()[0] or 0
    groups = max(1, -(-int(total) // GROUP_TOKENS))
    rows = rows.withColumn("bin_group", F.pmod(F.xxhash64("id", "place"), F.lit(groups))).drop("place")
    # groups are small to read and long to pack: not many to a task
    out = rows.repartition(min(groups, 20_000), "bin_group").groupBy("bin_group").applyInArrow(grouped(tuple(sorted(lengths))), f"id {kind}, piece int, start long, tokens long, bin_group long, bin int, bin_offset long, bin_length int")
    return out.withColumnRenamed("id", id_col)
