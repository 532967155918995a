"""Line dedup: lines that other documents hold as well stay in one document only.

A line's key is the line without ASCII white space at both ends, A-Z in lower
case. Keys of at least ``shortest`` code points get hashes of 96 bits, which
are dealt by ranges to parts; each part sorts them by document and position
behind the key, streams through them and keeps the lines of the first document
(smallest id) of each key (``repeats``). What comes back is no text but, for
each document that loses lines, a compressed bitmap: bit i is set if line i
stays; lines behind the bitmap's end stay.

Null and empty texts have one empty line. Keys that one document alone holds stay,
however often. Rows with a null id take no part and stay as they are. Rows
repeating id and text are one document; rows of one id with different texts are
documents of their own, in the order of a hash of the text. Two different keys
share a hash with probability 2**-96 a pair."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm import kernels as K
from marquee.llm.repeats import repeated
from marquee.llm.shared import cut, tagged

SHORTEST = 10
#: Lines have so many bytes at least, on average; only the number of parts follows from it.
LINE_BYTES = 40


def lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, where each line starts and ends and, for each
    text, where its lines begin among them."""
    data, offs = K.raw(texts)
    feeds = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offs[:-1], feeds + 1]), kind="stable")
    # a line begins at each text and behind each feed; a text that begins where another one's last feed stood comes second
    rows = np.concatenate([np.arange(len(offs) - 1) + np.searchsorted(feeds, offs[:-1]), [len(starts)]])
    ends = np.empty(len(starts), np.int64)
    ends[rows[1:] - 1] = offs[1:]
    inner = np.ones(len(starts), bool)
    inner[rows[1:] - 1] = False
    ends[inner] = feeds
    return data, starts, ends, rows


def keys(shortest: int):
    """Keys of all lines of each text that have ``shortest`` code points."""

    def of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        data, starts, ends, rows = lines(texts)
        on = np.append(np.flatnonzero(~K.IS_SPACE[data]), len(data))
        first = on[np.minimum(np.searchsorted(on, starts), len(on) - 1)]
        last = np.append(-1, on)[np.searchsorted(on, ends)] + 1
        blank = first >= ends
        first, last = np.where(blank, starts, first), np.where(blank, starts, last)
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        at = np.flatnonzero(points[last] - points[first] >= shortest)
        low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        hi, lo = (K.word_hashes(low, first[at], last[at], base) for base in (K.BYTES_BASE, K.BYTES_BASE_2))
        doc = np.searchsorted(rows, at, "right") - 1
        return hi, lo, doc, at - rows[doc]

    return of


def bitmap(dropped: np.ndarray) -> bytes:
    keep = np.ones(8 * (int(dropped.max()) // 8 + 1), bool)  # whole bytes
    keep[dropped] = False
    return zstandard.ZstdCompressor(level=3).compress(np.packbits(keep).tobytes())


def kept_lines(packed: bytes | None, n: int) -> np.ndarray:
    """Whether each of a text's n lines stays."""
    keep = np.ones(n, bool)
    if packed:
        bits = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8))[:n].astype(bool)
        keep[: len(bits)] = bits
    return keep


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """One row for each document that loses lines: ``id``, ``tag`` (see
    ``shared.tagged``), ``n_dropped`` and ``keep``, its compressed bitmap."""
    docs = docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), docs[f"`{text_col}`"].alias("text"))
    return _bitmaps(tagged(docs, "id", "text")[0], shortest)


def _bitmaps(docs: DataFrame, shortest: int) -> DataFrame:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = repeated(docs, keys(shortest), int(size) // LINE_BYTES, True, bitmap)
    return cut(found.select("id", "tag", F.col("n").alias("n_dropped"), F.col("found").alias("keep")), "bitmaps")


def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (id, text, keep, n_dropped) -> what is left of each text."""
    for batch in batches:
        texts, packed = batch.column(1), batch.column(2)
        for a, b in K.pieces(texts):
            n, sha, kept = [], [], []
            for text, bits in zip(texts.slice(a, b - a).cast(pa.binary()).to_pylist(), packed.slice(a, b - a).to_pylist(), strict=True):
                own = (text or b"").split(b"\n")
                n.append(len(own))
                left = b"\n".join([own[i] for i in np.flatnonzero(kept_lines(bits, len(own))).tolist()]) if bits else text or b""
                sha.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), batch.column(3).slice(a, b - a), pa.array(sha), pa.array(kept, pa.binary()).cast(pa.string())], names=["id", "n_lines", "n_dropped", "kept_sha256", "kept_text"])


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """One row per document: ``id_col``, ``n_lines``, ``n_dropped``,
    ``kept_sha256`` and ``kept_text`` (lines that stay, joined by line feeds)."""
    docs = docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), docs[f"`{text_col}`"].alias("text"))
    docs, _ = tagged(docs, "id", "text")
    rows = docs.join(_bitmaps(docs, shortest).hint("merge"), ["id", "tag"], "left").select("id", "text", "keep", F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"))
    return rows.mapInArrow(applied, "id long, n_lines long, n_dropped long, kept_sha256 string, kept_text string").withColumnRenamed("id", id_col)
