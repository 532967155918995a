"""Substring dedup: repeated fixed-length token windows go.

Every window of ``window`` consecutive words (runs without ASCII white space)
of every text gets a Rabin-Karp hash of 96 bits (of two polynomials modulo 2**64).
The hashes are dealt by value to parts, which count them and tell, of each that
occurs again, all occurrences but the first: smallest id, then smallest start
(``repeats``). The repeated starts of each document merge into maximal intervals
of words, which are removed.

Null, empty and short texts have no window and stay. Rows with a null id take
no part and stay as they are. Rows repeating id and text are one document; rows
of one id with different texts are documents of their own, in the order of a
hash of the text.
Two different windows share a hash with probability 2**-96 a pair: of 100 TB,
17 trillion windows, some pair does with probability 0.002."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm import kernels as K
from marquee.llm.repeats import repeated
from marquee.llm.shared import cut, tagged

WINDOW = 20


def windows(window: int):
    """Keys of all windows of each text: two polynomials of their words."""

    def of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        data, offs = K.raw(texts)
        starts, ends, rows = K.word_bounds(data, offs)
        hi, at = K.window_hashes(K.word_hashes(data, starts, ends), rows, window)
        lo, _ = K.window_hashes(K.word_hashes(data, starts, ends, K.BYTES_BASE_2), rows, window, K.WORDS_BASE_2)
        doc = np.searchsorted(rows, at, "right") - 1
        return hi, lo, doc, at - rows[doc]

    return of


def removed(window: int):
    """mapInArrow: (id, text, starts, carried) -> what is left of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.lean()
        for batch in batches:
            ids, texts, found = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            for a, b in K.pieces(texts):
                data, offs = K.raw(texts.slice(a, b - a))
                starts, ends, rows = K.word_bounds(data, offs)
                buf = data.tobytes()
                n = np.diff(rows)
                gone, sha, kept, spans = np.zeros(b - a, np.int64), [], [], []
                for r in range(b - a):
                    lo, hi = starts[rows[r] : rows[r + 1]], ends[rows[r] : rows[r + 1]]
                    keep, span = np.ones(len(lo), bool), []
                    if found[a + r]:
                        depth = np.zeros(len(lo) + 1, np.int32)
                        at = np.frombuffer(found[a + r], np.int32)
                        np.add.at(depth, at, 1)
                        np.add.at(depth, at + window, -1)
                        keep = np.cumsum(depth[:-1]) == 0
                        edges = np.flatnonzero(np.diff(np.concatenate([[True], keep, [True]]).astype(np.int8)))
                        span = edges.reshape(-1, 2).tolist()
                    gone[r] = len(lo) - keep.sum()
                    text = b" ".join([buf[x:y] for x, y in zip(lo[keep].tolist(), hi[keep].tolist(), strict=True)])
                    sha.append(hashlib.sha256(text).hexdigest())
                    kept.append(text)
                    spans.append([{"start": x, "end": y} for x, y in span])
                yield pa.record_batch(
                    [batch.column(3).slice(a, b - a), ids.slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(gone), pa.array(sha), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                    names=["carried", "id", "n_words", "n_removed", "kept_sha256", "kept_text", "spans"],
                )

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, carry: list[str] | None = None) -> DataFrame:
    """One row per document: ``id_col``, ``n_words``, ``n_removed``,
    ``kept_sha256``, ``kept_text`` (kept words joined by one blank) and
    ``spans`` (maximal removed intervals of words, end exclusive); with
    ``carry`` also a struct ``carried`` of those columns of the document."""
    held = F.struct(*[docs[f"`{c}`"] for c in carry]) if carry else F.lit(None).cast("boolean")
    docs = docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), docs[f"`{text_col}`"].alias("text"), held.alias("carried"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    docs, _ = tagged(docs, "id", "text")
    # words have 6 bytes or so, with the blank behind them
    found = repeated(docs, windows(window), int(size) // 6, False, np.ndarray.tobytes)
    found = cut(found.select("id", "tag", F.col("found").alias("starts")), "repeats")
    rows = docs.join(found, ["id", "tag"], "left").select("id", "text", "starts", "carried")
    out = f"carried {docs.schema['carried'].dataType.simpleString()}, id long, n_words long, n_removed long, kept_sha256 string, kept_text string, spans array<struct<start:int,end:int>>"
    rows = rows.mapInArrow(removed(window), out).withColumnRenamed("id", id_col)
    return rows if carry else rows.drop("carried")
