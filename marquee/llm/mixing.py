"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. The cells' token
counts are raked: factors of the three marginals are fitted in turn until each
marginal has its target shares. The sample cannot take more of a cell than it
has, so the weights, scaled to SHARE of all tokens, are raked again under this
bound: cells that reach it are held and the others refitted. What a cell gives
over its tokens is the probability with which each of its documents is kept; a
hash of the id decides. Where the targets do not allow SHARE, fewer tokens are
taken (see probabilities); each row tells the expected share and the largest
distance of an expected marginal from its target.

A value without a target, null included, is pooled as ``other``, whose target
is its own share of the tokens; the listed targets share the rest. So the
cells are as many as the targets allow, whatever the data, and the fit runs on
the driver.

Topics: a column of the table, where it has one (``topic_col``). Otherwise the
texts' words of 5 bytes or more fall into TOPICS groups by a hash, and the group
with the most of them stands for the topic (ties to the smaller; none: null): a
split by vocabulary that needs no training, not one by subject."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm import kernels as K
from marquee.llm.shared import columns, cut, tagged

TOPICS, SHARE, ROUNDS, CLOSE = 8, 0.6, 200, 1e-9
BOUND_ROUNDS, BOUND_CLOSE = 500, 1e-6
OTHER = "other"
#: How many sources and topics get a target of their own where none are given.
MOST = 64
#: Target shares of tokens; each marginal is scaled to 1. A marginal without
#: targets has equal shares for its most frequent values, MOST of them.
TARGETS: dict[str, dict[str, float]] = {
    "lang": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15},
    "topic": {f"topic{i}": 1.0 for i in range(TOPICS)},
}


def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (id, tag, source, lang, given, text) -> id, tag, source, lang,
    given, topic, tokens."""
    K.lean()
    for batch in batches:
        texts = batch.column("text")
        tokens, topics = [], []
        for a, b in K.pieces(texts):
            data, offs = K.raw(texts.slice(a, b - a))
            starts, ends, rows = K.word_bounds(data, offs)
            n = np.diff(rows)
            long = ends - starts >= 5
            group = (K.word_hashes(data, starts, ends) >> np.uint64(40)).astype(np.int64) % TOPICS
            doc = np.repeat(np.arange(b - a), n)
            table = np.bincount(doc[long] * TOPICS + group[long], minlength=(b - a) * TOPICS).reshape(-1, TOPICS)
            tokens.append(n)
            topics += [f"topic{t}" if some else None for t, some in zip(table.argmax(1), table.any(1), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(topics, pa.string()), pa.array(np.concatenate(tokens).astype(np.int64) if tokens else np.zeros(0, np.int64))], names=["id", "tag", "source", "lang", "given", "topic", "tokens"])


def rake(cells: np.ndarray, targets: list[np.ndarray]) -> np.ndarray:
    """Iterative proportional fitting: cell weights with the target marginals
    (shares that sum to 1), from the cells' tokens. A target on a value without
    tokens is left out and the others take its share."""
    w = cells / cells.sum() if cells.sum() else cells.astype(float)
    axes = range(w.ndim)
    fit = []
    for axis in axes:
        there = w.sum(tuple(a for a in axes if a != axis)) > 0
        t = np.where(there, targets[axis], 0.0)
        fit.append(t / t.sum() if t.sum() else there / max(1, there.sum()))
    for _ in range(ROUNDS):
        off = 0.0
        for axis in axes:
            have = w.sum(tuple(a for a in axes if a != axis))
            off = max(off, float(np.abs(have - fit[axis]).max()))
            factor = np.divide(fit[axis], have, out=np.zeros_like(have), where=have > 0)
            w = w * factor.reshape([-1 if a == axis else 1 for a in axes])
        if off < CLOSE:
            break
    return w


def margin(x: np.ndarray, axis: int) -> np.ndarray:
    return x.sum(tuple(a for a in range(x.ndim) if a != axis))


def raised(m: np.ndarray, most: np.ndarray, want: np.ndarray) -> np.ndarray:
    """For each row the factor f with sum(min(most, f * m)) = want, or one that
    brings all to most where that is less. No m above 0 has a most of 0."""
    at = np.divide(most, m, out=np.zeros_like(m), where=m > 0)  # the factor from which a cell is held
    order = np.argsort(at, axis=1)
    at, m, most = (np.take_along_axis(x, order, 1) for x in (at, m, most))
    held = np.cumsum(most, 1) - most
    free = np.cumsum(m[:, ::-1], 1)[:, ::-1]
    k = (held + at * free < want[:, None]).sum(1)
    last = m.shape[1] - 1
    r = np.arange(len(m))
    f = np.divide(want - held[r, np.minimum(k, last)], free[r, np.minimum(k, last)], out=np.zeros(len(m)), where=free[r, np.minimum(k, last)] > 0)
    return np.where(k > last, at[:, -1], f)


def bounded(most: np.ndarray, start: np.ndarray, marginals: list[np.ndarray], total: float) -> tuple[np.ndarray, float]:
    """Iterative proportional fitting under the bound that no cell gives more
    than most: min(most, product of start and factors of the marginals) with
    the marginals times total; and by what share of total a marginal is off."""
    m, off = start * total, np.inf
    for _ in range(BOUND_ROUNDS):
        off = 0.0
        for axis, t in enumerate(marginals):
            flat = np.moveaxis(m, axis, 0)
            top = np.moveaxis(most, axis, 0).reshape(len(t), -1)
            have = np.minimum(top, flat.reshape(len(t), -1)).sum(1)
            off = max(off, float(np.abs(have / total - t).max()))
            m = m * raised(flat.reshape(len(t), -1), top, t * total).reshape([-1 if a == axis else 1 for a in range(m.ndim)])
            m = np.clip(m, 1e-30 * most, 1e9 * most)  # finite where the marginals cannot be had
        if off < BOUND_CLOSE:
            break
    return np.minimum(most, m), off


def filled(most: np.ndarray, have: np.ndarray, want: float) -> np.ndarray:
    """min(most, c * have) with the c that sums to want, or all that have any
    where that is less."""
    return np.minimum(most, have * raised(have.reshape(1, -1), np.where(have > 0, most, 0.0).reshape(1, -1), np.array([want]))[0])


def probabilities(cells: np.ndarray, weights: np.ndarray, share: float, squares: np.ndarray | None = None) -> np.ndarray:
    """The probabilities, none above 1, that keep share of the tokens with the
    marginals of weights in expectation. Where so many tokens with these
    marginals are not to be had, the share is the largest (to a thousandth) that
    is, unless it falls short of share by less than the standard error of the
    kept tokens (squares: each cell's sum of squared tokens; none: the share is
    held in any case): then what is missing is taken in proportion, above the
    marginals."""
    there = (weights > 0) & (cells > 0)
    if not there.any():
        return np.zeros_like(weights)
    w = np.where(there, weights, 0.0) / weights[there].sum()
    most = np.where(there, cells, 0.0)
    marginals = [margin(w, axis) for axis in range(w.ndim)]
    low = float((cells[there] / w[there]).min())  # up to here no cell reaches its bound
    want = high = share * cells.sum()
    best = w * min(low, high)
    if low < high:
        best, off = bounded(most, w, marginals, high)
        if off >= BOUND_CLOSE:
            best = w * low
            for axis, t in enumerate(marginals):
                high = min(high, float((margin(most, axis)[t > 0] / t[t > 0]).min()))
            while high - low > 5e-4 * high:
                middle = (low + high) / 2
                got, off = bounded(most, w, marginals, middle)
                if off < BOUND_CLOSE:
                    low, best = middle, got
                else:
                    high = middle
            more = filled(most, best, want)
            p = np.divide(more, cells, out=np.zeros_like(w), where=there)
            error = np.inf if squares is None else float(np.sqrt((squares * p * (1 - p)).sum()))
            best = more if want - best.sum() < error else best
    return np.minimum(1.0, np.divide(best, cells, out=np.zeros_like(w), where=there))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None, targets: dict[str, dict[str, float]] = TARGETS, share: float = SHARE) -> DataFrame:
    """One row per document: ``id_col``, ``source_cell``, ``lang_cell``,
    ``topic_cell``, ``tokens``, ``weight`` (the factor of its cell over the
    plain share), ``probability``, ``kept``, and, the same in all rows,
    ``expected_share`` of all tokens and ``target_gap``; and ``tag``, which with
    the id names the document (see tagged). Null and empty texts have no tokens
    and take their cell's probability. Rows of one id share the draw, but each
    has its cell's probability."""
    given = {"given": topic_col} if topic_col else {}
    rows = columns(docs, id=id_col, source=source_col, lang=lang_col, text=text_col, **given)
    kind = rows.schema["id"].dataType.simpleString()
    topic = F.col("given").cast("string") if topic_col else F.lit(None).cast("string")
    rows, _ = tagged(rows.select("id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), topic.alias("given"), "text"), "id", "text", "source", "lang")
    rows = rows.select("id", "tag", "source", "lang", "given", "text").mapInArrow(measured, f"id {kind}, tag long, source string, lang string, given string, topic string, tokens long")
    rows = (rows.withColumn("topic", F.col("given")) if topic_col else rows).drop("given")
    rows = cut(rows, "measured")
    targets = dict(targets)
    for k in ("source", "lang", "topic"):
        if k not in targets:
            top = rows.where(F.col(k).isNotNull()).groupBy(k).count().orderBy(F.desc("count"), k).limit(MOST).collect()  # MOST rows
            targets[k] = {r[k]: 1.0 for r in top}
    names = ("source", "lang", "topic")
    for k in names:
        rows = rows.withColumn(k, F.when(F.col(k).isin(sorted(targets[k])), F.col(k)).otherwise(F.lit(OTHER)))
    values = [[*sorted(targets[k]), OTHER] for k in names]
    cells, squares = np.zeros([len(v) for v in values]), np.zeros([len(v) for v in values])
    for r in rows.groupBy(*names).agg(F.sum("tokens").alias("t"), F.sum(F.col("tokens").cast("double") * F.col("tokens")).alias("q")).collect():  # as many as the targets allow
        at = tuple(v.index(r[k]) for v, k in zip(values, names, strict=True))
        cells[at], squares[at] = r["t"], r["q"]
    shares = []
    for axis, (k, v) in enumerate(zip(names, values, strict=True)):
        own = margin(cells, axis)
        rest = own[-1] / own.sum() if own.sum() else 0.0
        t = np.array([targets[k][x] for x in v[:-1]], float)
        shares.append(np.append(t / max(t.sum(), 1e-300) * (1 - rest), rest))
    weights = rake(cells, shares)
    p = probabilities(cells, weights, share, squares)
    taken = p * cells
    gap = max(float(np.abs(margin(taken, axis) / taken.sum() - t).max()) for axis, t in enumerate(shares)) if taken.any() else 0.0
    plain = cells / max(1.0, cells.sum())
    spark = docs.sparkSession
    table = spark.createDataFrame([(*[v[i] for v, i in zip(values, at, strict=True)], float(weights[at] / plain[at]) if plain[at] else 0.0, float(p[at]) if plain[at] else 1.0) for at in np.ndindex(cells.shape)], "source string, lang string, topic string, weight double, probability double")
    u = (F.xxhash64(F.lit("mix"), F.coalesce(F.col("id").cast("string"), F.col("tag").cast("string"))).bitwiseAND((1 << 53) - 1)) / float(1 << 53)
    out = rows.join(F.broadcast(table), list(names))  # the cells that the targets allow
    return out.select(F.col("id").alias(id_col), F.col("source").alias("source_cell"), F.col("lang").alias("lang_cell"), F.col("topic").alias("topic_cell"), "tokens", "weight", "probability", (u < F.col("probability")).alias("kept"), F.lit(float(taken.sum() / max(1.0, cells.sum()))).alias("expected_share"), F.lit(gap).alias("target_gap"), "tag")
