"""Language identification by string kernels.

The kernel is the blended spectrum presence kernel: two texts share as many
features as distinct byte n-grams of lengths NGRAMS occur in both, over the
geometric mean of their own counts. Letters are compared in lower case (ASCII),
everything else but letters as one blank. N-grams are hashed to FEATURES
numbers. LANDMARKS texts of the sample, dealt evenly to the languages, give
the Nyström map phi(x) = K(x, L) K(L, L)^(-1/2); kernel ridge regression, one
language against the rest, is solved on it in closed form.

To score, the map, the ridge weights and the landmarks' features multiply to
one matrix (FEATURES x languages); a batch's presence matrix times this matrix,
over each text's norm, gives all scores. The presence matrix is sparse, so its
product sums the rows of the features that occur.

The model is fitted on a bounded sample, SAMPLE texts of each language in the
order of a hash of their id and at most SAMPLE_BYTES, in even shares as far as
the languages need them. Texts of more than a 64th of this come last, and a text
that does not fit is skipped; a language of which none fits has its shortest.
Of more than LANGUAGES languages the most frequent ones are learnt. Rows that
repeat id, language and text count once. Every text is scored whole."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.llm import kernels as K
from marquee.llm.shared import columns

NGRAMS = (2, 3, 4)
FEATURES = 1 << 16
SAMPLE, SAMPLE_BYTES, LANGUAGES, LANDMARKS, RIDGE = 300, 24 << 20, 256, 128, 1e-2
UNKNOWN = "und"
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # FEATURES x languages, float32
    bias: np.ndarray
    sharpness: float


def presence(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The features of each text, distinct and sorted, and the texts' offsets
    among them."""
    data, offs = K.raw(texts)
    data = _FOLD[data]
    out, ends = [], [0]
    seen = np.zeros(FEATURES, bool)
    for a, b in zip(offs[:-1], offs[1:], strict=True):
        d = data[a:b].astype(np.uint32)
        if len(d):
            blank = d == 0x20
            keep = np.ones(len(d), bool)
            keep[1:] = ~(blank[1:] & blank[:-1])
            d = np.concatenate([[0x20], d[keep], [0x20]]).astype(np.uint32)
        seen[:] = False
        for n in NGRAMS:
            if len(d) >= n:
                g = d[: len(d) - n + 1].copy()
                for k in range(1, n):
                    g <<= np.uint32(8)
                    g |= d[k : len(d) - n + 1 + k]
                g ^= np.uint32(n * 0x01000193)
                g *= np.uint32(0x9E3779B1)
                g ^= g >> np.uint32(15)
                seen[g & np.uint32(FEATURES - 1)] = True
        out.append(np.flatnonzero(seen).astype(np.int32))
        ends.append(ends[-1] + len(out[-1]))
    return np.concatenate(out) if out else np.zeros(0, np.int32), np.array(ends)


def fit(texts: list[str], labels: list[str]) -> Model:
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((FEATURES, 0), np.float32), np.zeros(0), 1.0)
    ids, ends = presence(pa.array(texts))
    norm = np.sqrt(np.maximum(np.diff(ends), 1)).astype(np.float32)
    code = np.array([languages.index(x) for x in labels])
    turn = np.zeros(len(labels), int)  # how many of its language stand before
    for c in range(len(languages)):
        turn[code == c] = np.arange((code == c).sum())
    marks = np.lexsort((code, turn))[:LANDMARKS]
    held = np.zeros((len(marks), FEATURES), np.float32)
    for r, m in enumerate(marks):
        held[r, ids[ends[m] : ends[m + 1]]] = 1 / norm[m]
    held = np.ascontiguousarray(held.T)
    kernel = np.stack([held[ids[a:b]].sum(0) for a, b in zip(ends[:-1], ends[1:], strict=True)]) / norm[:, None]
    values, vectors = np.linalg.eigh(kernel[marks].astype(np.float64))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    phi = kernel @ root
    mean = phi.mean(0)
    target = np.where(code[:, None] == np.arange(len(languages)), 1.0, -1.0)
    middle = target.mean(0)
    ridge = np.linalg.solve((phi - mean).T @ (phi - mean) + RIDGE * len(code) * np.eye(len(marks)), (phi - mean).T @ (target - middle))
    scores = phi @ ridge + middle - mean @ ridge
    best, least = 1.0, np.inf
    for sharp in (0.5, 1, 2, 3, 4, 6, 8):
        z = sharp * (scores - scores.max(1, keepdims=True))
        loss = -(z[np.arange(len(code)), code] - np.log(np.exp(z).sum(1))).mean()
        best, least = (sharp, loss) if loss < least else (best, least)
    return Model(languages, (held @ (root @ ridge)).astype(np.float32), middle - mean @ ridge, best)


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    """Probabilities (texts x languages)."""
    ids, ends = presence(texts)
    n = np.diff(ends)
    z = np.zeros((len(n), len(model.languages)))
    full = np.flatnonzero(n)
    if len(full):
        z[full] = np.add.reduceat(model.weights[ids], ends[full], axis=0) / np.sqrt(n[full])[:, None]
    z = model.sharpness * (z + model.bias)
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def within(sizes: list[tuple[str, int]], rows: list[tuple]) -> list[tuple]:
    """The rows that SAMPLE_BYTES have room for, given (language, size) of each:
    first within each language's even share, or else its shortest, then others."""
    share = SAMPLE_BYTES // max(1, len({g for g, _ in sizes}))
    used: dict[str, int] = {}
    taken = set()
    for i, (g, n) in enumerate(sizes):
        if used.get(g, 0) + n <= share:
            used[g] = used.get(g, 0) + n
            taken.add(i)
    for i, (g, n) in sorted(enumerate(sizes), key=lambda x: x[1][1]):
        if g not in used:
            used[g] = n
            taken.add(i)
    total = sum(used.values())
    for i, (_, n) in enumerate(sizes):
        if i not in taken and total + n <= SAMPLE_BYTES:
            total += n
            taken.add(i)
    return [x for i, x in enumerate(rows) if i in taken]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", where: Column | None = None) -> Model:
    """Fits on the rows of ``docs`` that hold ``where`` and have an id, a
    language and a text with a letter."""
    kept = docs if where is None else docs.where(where)
    kept = columns(kept, id=id_col, text=text_col, lang=lang_col).where("id is not null and lang is not null and text is not null")
    kept = kept.withColumn("u", F.xxhash64("id").bitwiseAND((1 << 53) - 1) / float(1 << 53))
    spark = docs.sparkSession
    # of frequent languages a share that holds the sample for certain is ranked
    top = kept.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()  # LANGUAGES rows
    if not top:
        return fit([], [])
    shares = spark.createDataFrame([(r["lang"], 8 * SAMPLE / r["count"]) for r in top], f"lang {kept.schema['lang'].dataType.simpleString()}, share double")
    few = kept.join(F.broadcast(shares), "lang").where("u < share")
    few = few.select("id", "lang", "u", F.octet_length("text").alias("size"), F.xxhash64("text").alias("h"), has_letter(F.col("text")).alias("ok")).where("ok")
    order = Window.partitionBy("lang").orderBy(F.greatest("size", F.lit(SAMPLE_BYTES // 64)), "u", "id", "h")
    few = few.dropDuplicates(["lang", "id", "h"]).withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= SAMPLE)
    chosen = sorted((r["turn"], r["lang"], r["id"], r["h"], r["size"]) for r in few.collect())  # SAMPLE rows a language
    chosen = within([(x[1], x[4]) for x in chosen], chosen)
    if not chosen:
        return fit([], [])
    wanted = spark.createDataFrame([(x[2], x[1], x[3]) for x in chosen], f"id {kept.schema['id'].dataType.simpleString()}, lang {kept.schema['lang'].dataType.simpleString()}, h long")
    rows = kept.select("id", "lang", "text", F.xxhash64("text").alias("h")).join(F.broadcast(wanted), ["id", "lang", "h"], "left_semi")
    found = {(r["id"], r["lang"], r["h"]): r["text"] for r in rows.dropDuplicates(["id", "lang", "h"]).collect()}  # SAMPLE rows a language
    pairs = [(found[i, lang, h], lang) for _, lang, i, h, _ in chosen]
    return fit([p[0] for p in pairs], [p[1] for p in pairs])


def has_letter(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\p{L}"), F.lit(False))


def held_out(c: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; null: no."""
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """The columns ``carry`` (default: all) of ``docs`` with ``pred`` and
    ``score``, the probability of the prediction; columns of those names are
    replaced. Null texts and texts without a letter are ``und`` with score 0,
    and so is all if there was nothing to learn from. Only texts are read."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES x languages numbers
    carry = [c for c in (docs.columns if carry is None else carry) if c not in (pred, score)]
    sent = docs.select(*[F.col(f"`{c}`") for c in carry], *([] if text_col in carry else [F.col(f"`{text_col}`")]))
    at, width = sent.columns.index(text_col), len(carry)
    out = T.StructType([*[sent.schema[c] for c in carry], T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.lean()
        m = held.value
        for batch in batches:
            texts = batch.column(at)
            ok = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool) & bool(m.languages)
            best, sure = np.zeros(len(ok), int), np.zeros(len(ok))
            if m.languages:
                for a, b in K.pieces(texts):
                    p = scores(m, texts.slice(a, b - a))
                    best[a:b], sure[a:b] = p.argmax(1), p.max(1)
            told = np.where(ok, np.array([*m.languages, UNKNOWN], object)[best], UNKNOWN)
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(told, pa.string()), pa.array(np.where(ok, sure, 0.0))], names=out.names)

    return sent.select("*", has_letter(F.col(f"`{text_col}`")).alias("__ok")).mapInArrow(run, out)
