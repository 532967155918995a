"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of 5-word shingles (words: runs without ASCII white space,
unchanged). Two documents are linked when the Jaccard similarity of their sets
is at least the threshold.

1. One pass over the texts gives each document its set's fingerprint and the
   keys of BANDS bands of ROWS MinHash values. Documents with equal sets form
   a class; only its smallest id goes on.
2. Classes meet in buckets of equal band keys. Buckets with one member go, and
   of buckets with the same members one stays. A pair of similarity s shares
   no bucket with probability (1 - s**ROWS)**BANDS: 3e-9 at 0.8.
3. A bucket is compared in one task, or, beyond BLOCK_DOCS members or
   BLOCK_SHINGLES shingles, as blocks: a task for each pair of blocks. Within
   it MinHash values, from a family of their own, are compared STEP at a time;
   a pair whose posterior probability of reaching the threshold falls below
   TOLERANCE is dropped. What remains is verified exactly on the sets. A pair
   counts only in the first bucket that it shares, so no pair is ever written
   as a row: a task gives each document its number of links and the smallest
   member that it is connected with.
4. Connected components of these edges give the near-duplicate groups.

Nulls, empty texts and texts without words have no shingles and link with
nothing; 1 to 4 words are one shingle. Rows with a null id take no part and
are returned with null results. Every other row is a document: rows that repeat
an id count as copies where the text is the same and as documents of their own
where it is not. A group is named by the smallest id in it, so groups that share
that id share the name; ``kept`` tells them apart."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm import kernels as K
from marquee.llm.shared import columns, components, cut, shuffle_parts, tagged

BANDS, ROWS = 50, 5
STEP, STEPS, TOLERANCE = 16, 4, 1e-6
BLOCK_DOCS, BLOCK_SHINGLES = 4096, 4_000_000
LOW = 64  # a key's last 6 bits are its band


def least_matches(threshold: float, tolerance: float = TOLERANCE) -> list[int]:
    """For STEP, 2 STEP, ... compared values, the fewest matches m with
    P(similarity >= threshold | m of n) >= tolerance under a uniform prior.
    The posterior is Beta(m + 1, n - m + 1); its tail is a binomial sum."""

    def tail(m: int, n: int) -> float:
        return sum(comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1))

    return [next(m for m in range(n + 1) if tail(m, n) >= tolerance) for n in range(STEP, STEP * STEPS + 1, STEP)]


def signatures(ngram: int):
    """mapInArrow: per document the number of shingles, two fingerprints of
    the set and the band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.lean()
        for batch in batches:
            ids, tags, texts = batch.columns
            for a, b in K.pieces(texts):
                h, offs = K.shingles(texts.slice(a, b - a), ngram)
                n = np.diff(offs)
                full = np.flatnonzero(n)
                fp = np.zeros((2, b - a), np.uint64)
                if len(full):
                    fp[0, full] = np.add.reduceat(h, offs[full])
                    fp[1, full] = np.add.reduceat(K.mix(h + np.uint64(7)), offs[full])
                m = K.minhashes(h, offs, BANDS * ROWS, seed=1).astype(np.uint64).reshape(b - a, BANDS, ROWS)
                keys = np.zeros((b - a, BANDS), np.uint64)
                for r in range(ROWS):
                    keys = K.mix(keys * np.uint64(K.WORDS_BASE) + m[:, :, r])
                keys = (keys & ~np.uint64(LOW - 1)) | np.arange(BANDS, dtype=np.uint64)
                yield pa.record_batch(
                    [ids.slice(a, b - a), tags.slice(a, b - a), pa.array(n.astype(np.int32)), pa.array(fp[0].view(np.int64)), pa.array(fp[1].view(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(keys.reshape(-1).view(np.int64)))],
                    names=["id", "tag", "n", "fp1", "fp2", "keys"],
                )

    return run


def blocks(batches: Iterator[pa.RecordBatch], ngram: int, keep: int = 4):
    """Groups of consecutive rows with the same (key, i, j): per group the
    side of each row and its id, weight, bucket keys, set and MinHash values.
    Texts become sets as they arrive."""
    now, held = None, []
    for batch in batches:
        d = {k: batch.column(k) for k in batch.schema.names}
        for a, b in K.pieces(d["text"]):
            h, offs = K.shingles(d["text"].slice(a, b - a), ngram)
            m = K.minhashes(h, offs, STEP * STEPS, seed=2)
            part = {k: d[k].slice(a, b - a).to_numpy(zero_copy_only=False) for k in ("key", "i", "j", "block", "id", "w")}
            lists = d["keys"].slice(a, b - a).to_pylist()
            for r in range(b - a):
                group = (part["key"][r], part["i"][r], part["j"][r])
                if group != now:
                    if now is not None:
                        yield now, held
                    now, held = group, []
                table = np.zeros(LOW, np.int64)
                keys = np.array(lists[r], np.int64)
                table[keys & (LOW - 1)] = keys
                held.append((int(part["block"][r]), int(part["id"][r]), int(part["w"][r]), table, h[offs[r] : offs[r + 1]].copy(), m[r]))
    if now is not None:
        yield now, held


def link(rows: list, key: int, i: int, j: int, threshold: float, least: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All links of one task: ids, their link counts here, and the smallest id
    each is connected with here."""
    rows = sorted({r[1]: r for r in rows}.values(), key=lambda r: (r[0], r[1]))
    ids, w = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
    side = np.array([r[0] for r in rows])
    tables, mins = np.stack([r[3] for r in rows]), np.stack([r[5] for r in rows])
    sizes = np.array([len(r[4]) for r in rows])
    vocabulary, coded = np.unique(np.concatenate([r[4] for r in rows]), return_inverse=True)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    flags = np.zeros(len(vocabulary), np.int32)
    band = int(key) & (LOW - 1)
    counts, root = np.zeros(len(rows), np.int64), np.arange(len(rows))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    cut_at = int(np.searchsorted(side, j)) if i != j else 0
    for a in range(cut_at if i != j else len(rows)):
        others = np.arange(max(a + 1, cut_at), len(rows))
        # the sizes alone bound the similarity
        small, large = np.minimum(sizes[a], sizes[others]), np.maximum(sizes[a], sizes[others])
        others = others[small >= threshold * large - 1e-9]
        matches = np.zeros(len(others), np.int64)
        for s, m in enumerate(least):
            part = slice(s * STEP, (s + 1) * STEP)
            matches += (mins[others, part] == mins[a, part]).sum(1)
            others, matches = others[matches >= m], matches[matches >= m]
            if s == 0 and band:
                met = ((tables[others, :band] == tables[a, :band]) & (tables[a, :band] != 0)).any(1)
                others, matches = others[~met], matches[~met]
            if not len(others):
                break
        if not len(others):
            continue
        mine = coded[ends[a] : ends[a + 1]]
        flags[mine] = 1
        first = np.cumsum(sizes[others]) - sizes[others]
        at = np.arange(sizes[others].sum()) + np.repeat(ends[others] - first, sizes[others])
        both = np.add.reduceat(flags[coded[at]], first)
        flags[mine] = 0
        others = others[both >= threshold * (sizes[a] + sizes[others] - both) - 1e-9]
        counts[a] += w[others].sum()
        counts[others] += w[a]
        for b in others[root[others] != find(a)].tolist():
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    full = np.flatnonzero(counts)
    tops = np.array([find(int(x)) for x in full], np.int64)
    low = np.full(len(rows), np.iinfo(np.int64).max)
    np.minimum.at(low, tops, ids[full])
    return ids[full], counts[full], low[tops]


def linked(ngram: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.lean()
        least = least_matches(threshold)
        out, size = [], 0
        for (key, i, j), rows in blocks(batches, ngram):
            out.append(link(rows, key, i, j, threshold, least))
            size += len(out[-1][0])
            if size > 10_000:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["id", "n", "root"])
                out, size = [], 0
        if size:
            yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["id", "n", "root"])

    return run


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row per document: ``id_col``, ``class_id`` (smallest id of its
    near-duplicate group), ``n_links`` (other documents of similarity at least
    the threshold, copies included), ``copy_of`` (smallest id with an equal
    shingle set), ``n_shingles``, ``tag`` (see tagged) and ``kept``, true for the
    document that stands for its group and for rows that repeat it."""
    spark = docs.sparkSession
    docs = columns(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    real, repeated = tagged(docs.where("id is not null"), "id", "text")
    sig = cut(real.select("id", "tag", "text").mapInArrow(signatures(ngram), "id long, tag long, n int, fp1 long, fp2 long, keys array<long>"), "signatures")
    classes = sig.where("n > 0").groupBy("fp1", "fp2", "n").agg(F.min(F.struct("id", "tag")).alias("rep"), F.count(F.lit(1)).alias("w"), F.first("keys").alias("keys"))
    # a class is a node by its smallest id, or, where ids repeat, by a number of its own
    node = F.monotonically_increasing_id() if repeated else F.col("rep.id")
    classes = cut(classes.select("fp1", "fp2", "n", "w", "keys", F.col("rep.id").alias("rep"), F.col("rep.tag").alias("rep_tag"), node.alias("node")), "classes")
    met = classes.select(F.explode("keys").alias("key"), "node", "n")
    buckets = met.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.bit_xor(F.xxhash64("node")).alias("x"), F.min("node").alias("a")).where("docs > 1")
    # of buckets with the same members one stays
    buckets = cut(buckets.groupBy("docs", "x", "a").agg(F.min("key").alias("key")).select("key", "docs"), "buckets")
    # merge joins at every size: no side is bounded, and the plan stays the same
    met = cut(met.join(buckets.hint("merge"), "key"), "met")
    large = met.groupBy("key").agg(F.max("docs").alias("docs"), F.sum("n").alias("size"))
    large = large.select("key", F.ceil(F.greatest(F.col("docs") / BLOCK_DOCS, F.col("size") / BLOCK_SHINGLES)).cast("int").alias("blocks")).where("blocks > 1")
    met = met.join(large, "key", "left").select("key", "node", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    places = met.groupBy("node").agg(F.collect_list("key").alias("keys"), F.collect_list("blocks").alias("blocks"))  # at most BANDS each
    places = places.join(classes.select("node", "rep", "rep_tag", "w"), "node")
    texts = real.dropDuplicates(["id", "tag"]) if repeated else real
    put = texts.join(places.hint("merge"), (texts["id"] == places["rep"]) & (texts["tag"] == places["rep_tag"])).select(F.col("node").alias("id"), "text", "w", "keys", F.explode(F.arrays_zip("keys", "blocks")).alias("p"))
    put = put.select("id", "text", "w", "keys", F.col("p.keys").alias("key"), F.col("p.blocks").alias("blocks"), F.pmod(F.xxhash64("id"), F.col("p.blocks")).cast("int").alias("block"))
    # a block meets itself and each other block of its bucket once
    put = put.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("id", "text", "w", "keys", "key", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    put = put.repartition(shuffle_parts(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j", "block", "id")
    found = cut(put.mapInArrow(linked(ngram, threshold), "id long, n long, root long"), "found")
    comps = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("id").agg(F.sum("n").alias("links")).join(comps, "id", "left")
    # classes that hold more than one document or have links; the others stand alone
    told = classes.select("node", "rep", "rep_tag", "fp1", "fp2", F.col("n").alias("size"), "w").join(sums.withColumnRenamed("id", "node"), "node", "left").where("w > 1 or links > 0")
    told = told.select("rep", "rep_tag", "fp1", "fp2", "size", (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("root", "node").alias("root"))
    if repeated:
        told = cut(told, "told")
        least = told.groupBy("root").agg(F.min(F.struct("rep", "rep_tag")).alias("top"))
        told = told.join(least, "root").withColumn("root", F.col("top.rep")).withColumn("root_tag", F.col("top.rep_tag")).drop("top")
    else:
        told = told.withColumn("root_tag", F.lit(0).cast("long"))
    rows = sig.select("id", "tag", "n", "fp1", "fp2").join(told, (sig["fp1"] == told["fp1"]) & (sig["fp2"] == told["fp2"]) & (sig["n"] == told["size"]), "left")
    kept = F.col("root").isNull() | ((F.col("id") == F.col("root")) & (F.col("tag") == F.col("root_tag")))
    rows = rows.select(F.col("id").alias(id_col), F.coalesce("root", "id").alias("class_id"), F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("rep", "id").alias("copy_of"), F.col("n").alias("n_shingles"), "tag", kept.alias("kept"))
    none = docs.where("id is null").select(F.col("id").alias(id_col), *[F.lit(None).cast(t).alias(c) for c, t in (("class_id", "long"), ("n_links", "long"), ("copy_of", "long"), ("n_shingles", "int"))], F.xxhash64("text").alias("tag"), F.lit(True).alias("kept"))
    return rows.union(none)
