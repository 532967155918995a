"""Embedding near-dedup by dual traversal of cover trees.

Vectors of norm 1 link when their cosine is at least the threshold, that is
when their distance is at most reach = sqrt(2 - 2 threshold).

1. Equal vectors become one row with a weight.
2. The upper levels of the tree are Spark tables. Each round splits the cells of
   more than CHUNK vectors: a bounded sample of a cell (CELL_SAMPLE) gives a net
   whose centres are farther apart than the halved radius, as many of them as
   the cell's size asks for, FAN at most; every vector goes to the nearest one,
   streaming past its cell's centres, and each new cell's covering radius is
   measured. Hot cells are dealt to several tasks (SALT vectors each).
3. Each cell that is left is a chunk, and builds the rest of the tree: nested
   levels with halving radii, every node with the true distance of its farthest
   descendant.
4. Both trees are traversed together. Above the chunks a round of joins takes
   each pair of cells to the pairs of their children: a pair farther apart than
   both radii and the reach is pruned, one that links as a whole (distance and
   both radii below the reach) is counted by the cells' weights, the rest goes
   on. Within a pair of chunks the same happens level by level, but for coarse
   levels that are nearly as large as the finest; leaves are decided by the
   cosine in double precision on the original vectors.

Pairs never become rows: a task gives each vector its number of links and the
smallest id it is connected with, and connected components follow. Chunks
travel in TILES tiles of neighbouring cells, more if a tile would hold over
TILE_BYTES, so that each is sent as often as there are tiles, not chunks.
Vectors that lie in clusters meet only their cluster's neighbourhood. Where all
vectors are far from each other no metric bound prunes, and the work is one
matrix product for each pair of chunks: it stays quadratic there.

Vectors that are null, empty, zero or hold null or non-finite components link
with nothing, and neither do vectors of different lengths. Rows with a null id
come back with null results. Every other row is a vector of its own, also where
its id repeats; a component is named by the smallest id in it."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.shared import columns, components, cut, finite_vector, shuffle_parts, tagged

THRESHOLD = 0.9
CHUNK, FAN, CELL_SAMPLE, SALT, DEPTH, TILES, TILE_BYTES = 2048, 32, 1024, 500_000, 11, 16, 1 << 24
LEVELS = (1.0, 0.5, 0.25, 0.125, 0.0625)
#: From this level on radii are so small that hardly any far pair stays.
FINE = 4
BLOCK = 512  # rows of a matrix product, which then fits the cache
SLACK = 1e-3  # of distances in single precision


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between rows of norm 1, in the precision given."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def net(d: np.ndarray, members: np.ndarray, radius: float) -> tuple[list[int], np.ndarray]:
    """A greedy net over members, the first of them first: centres farther
    than radius from each other, and the centre nearest to each member."""
    far = np.full(len(members), np.inf, d.dtype)
    own, centres = np.zeros(len(members), np.int64), []
    at = 0
    while True:
        centres.append(int(members[at]))
        row = d[members[at], members]
        closer = row < far
        far[closer], own[closer] = row[closer], len(centres) - 1
        left = far > radius
        if not left.any():
            return centres, own
        at = int(left.argmax())


def picked(x: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` centres among vectors of norm 1: the first ones of the
    coarsest net that has so many, else of the finest one that has several; of
    vectors nearer than all nets, some that differ."""
    d = distances(x.astype(np.float32), x.astype(np.float32))
    np.fill_diagonal(d, 0)
    best: list[int] = []
    for radius in LEVELS:
        centres, _ = net(d, np.arange(len(x)), radius)
        best = centres[:most] if len(centres) > 1 else best
        if len(centres) >= most:
            break
    return x[best or np.arange(min(most, len(x)))]


class Tree:
    """Nested levels over few vectors of norm 1: ``order``, and for each level
    the nodes' centres, starts, ends (in that order), radii and parents."""

    def __init__(self, x: np.ndarray):
        n = len(x)
        x32 = x.astype(np.float32)
        d = distances(x32, x32)
        np.fill_diagonal(d, 0)
        groups = [np.arange(n)]
        parents, raw = [np.zeros(1, np.int64)], [groups]
        for radius in LEVELS:
            down, up = [], []
            for p, g in enumerate(groups):
                if len(g) == 1:
                    down.append(g)
                    up.append(p)
                    continue
                centres, own = net(d, g, radius)
                for c in range(len(centres)):
                    mine = g[own == c]
                    down.append(np.concatenate([[centres[c]], mine[mine != centres[c]]]))
                    up.append(p)
            groups = down
            raw.append(groups)
            parents.append(np.array(up))
        raw.append([np.array([i]) for g in groups for i in g])
        parents.append(np.repeat(np.arange(len(groups)), [len(g) for g in groups]))
        self.order = np.array([g[0] for g in raw[-1]], np.int64)
        self.x32 = x32[self.order]
        place = np.empty(n, np.int32)
        place[self.order] = np.arange(n)
        self.levels = []
        for k, (groups, up) in enumerate(zip(raw, parents, strict=True)):
            if k and len(groups) == len(raw[k - 1]):  # the level above: it is held once
                same = self.levels[-1]
                self.levels.append((*same[:4], same[4] if k > 1 and len(same[4]) == len(raw[k - 2]) else up.astype(np.int32)))
                continue
            size = np.array([len(g) for g in groups])
            end = np.cumsum(size).astype(np.int32)
            radius = np.array([d[g[0], g].max() for g in groups], np.float32)
            self.levels.append((place[[g[0] for g in groups]], (end - size).astype(np.int32), end, radius, up.astype(np.int32)))


def near_pairs(a: np.ndarray, b: np.ndarray, ra: np.ndarray, rb: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a and of b, of norm 1 and with these radii, that are no farther
    apart than both radii and the reach, and their distances. Each block of a
    matrix product is passed over while it is in the cache, and most hold no
    cosine that even the largest radii would let near."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
    for k in range(0, len(a), BLOCK):
        g = a[k : k + BLOCK] @ b.T
        least = 1 - (reach + SLACK + ra[k : k + BLOCK].max() + rb.max()) ** 2 / 2
        if g.max() >= least:
            at = np.flatnonzero(g >= least)
            i, j = at // len(b), at % len(b)
            d = np.sqrt(np.maximum(2 - 2 * g.ravel()[at], 0))
            near = d - ra[k + i] - rb[j] <= reach + SLACK
            found.append((k + i[near], j[near], d[near]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def traverse(a: Tree, b: Tree, reach: float) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """Pairs of node ranges (starts and ends on both sides) that link whole,
    and the pairs of vectors (positions in the trees' orders) left to decide.

    As long as most pairs of a level stay, all of the next level are taken as
    one matrix product; then pairs are listed and only their children looked
    at. A level of large radii is passed over where it has about as many pairs
    as there are vectors': its product would cost as much and prune less."""
    whole = []
    i = j = None
    last = len(a.levels) - 1
    for level in range(len(a.levels)):
        (ca, sa, ea, ra, _), (cb, sb, eb, rb, _) = a.levels[level], b.levels[level]
        if i is None:
            size = len(ca) * len(cb)
            if level < FINE and size * 16 > len(a.x32) * len(b.x32):
                continue
            i, j, d = near_pairs(a.x32[ca], b.x32[cb], ra, rb, reach)
            if len(i) > 0.25 * size and level < last:
                i = j = None
                continue
        else:
            d = np.concatenate([np.zeros(0, np.float32), *[np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", a.x32[ca[i[k : k + 65536]]], b.x32[cb[j[k : k + 65536]]]), 0)) for k in range(0, len(i), 65536)]])
            near = d - ra[i] - rb[j] <= reach + SLACK
            i, j, d = i[near], j[near], d[near]
        if level == last or not len(i):
            break
        inside = d + ra[i] + rb[j] <= reach - SLACK
        if inside.any():
            whole.append((sa[i[inside]], ea[i[inside]], sb[j[inside]], eb[j[inside]]))
            i, j = i[~inside], j[~inside]
        # on to all pairs of children
        na, nb = (np.bincount(t.levels[level + 1][4], minlength=len(t.levels[level][0])) for t in (a, b))
        fa, fb = np.cumsum(na) - na, np.cumsum(nb) - nb
        n = na[i] * nb[j]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        i, j, w = np.repeat(i, n), np.repeat(j, n), np.repeat(nb[j], n)
        i, j = fa[i] + k // w, fb[j] + k % w
    return whole, ca[i], cb[j]


def link(a: dict, b: dict, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, weighted link counts and smallest connected ids of two chunks, or
    of one with itself."""
    reach = float(np.sqrt(2 - 2 * threshold))
    xa, xb = a["unit"], b["unit"]
    whole, pa_, pb_ = traverse(a["tree"], b["tree"], reach)
    ia, ib, wa, wb = a["ids"], b["ids"], a["w"], b["w"]
    if not whole and not len(pa_):
        return ia[:0], wa[:0], ia[:0]
    exact = np.concatenate([np.zeros(0), *[np.einsum("ij,ij->i", xa[pa_[k : k + 65536]], xb[pb_[k : k + 65536]]) for k in range(0, len(pa_), 65536)]]) >= threshold
    if same:
        exact &= pa_ != pb_
    pa_, pb_ = pa_[exact], pb_[exact]
    na, nb = np.zeros(len(ia), np.int64), np.zeros(len(ib), np.int64)
    np.add.at(na, pa_, wb[pb_])
    np.add.at(nb, pb_, wa[pa_])
    # positions of b follow those of a, unless they are the same
    shift = 0 if same else len(ia)
    edges = [(pa_, pb_ + shift)]
    ca, cb = np.concatenate([[0], np.cumsum(wa)]), np.concatenate([[0], np.cumsum(wb)])
    for sa, ea, sb, eb in whole:
        da, db = np.zeros(len(ia) + 1, np.int64), np.zeros(len(ib) + 1, np.int64)
        np.add.at(da, sa, cb[eb] - cb[sb])
        np.add.at(da, ea, cb[sb] - cb[eb])
        np.add.at(db, sb, ca[ea] - ca[sa])
        np.add.at(db, eb, ca[sa] - ca[ea])
        na += np.cumsum(da)[:-1]
        nb += np.cumsum(db)[:-1]
        if same:  # a node taken whole with itself holds each vector's pair with itself
            own = np.zeros(len(ia) + 1, np.int64)
            np.add.at(own, sa[sa == sb], 1)
            np.add.at(own, ea[sa == sb], -1)
            na -= np.cumsum(own)[:-1] * wa
        for s, e, t, u in zip(sa.tolist(), ea.tolist(), sb.tolist(), eb.tolist(), strict=True):
            edges.append((np.arange(s, e), np.full(e - s, t + shift)))
            edges.append((np.full(u - t, s), np.arange(t, u) + shift))
    ids = ia if same else np.concatenate([ia, ib])
    n = na if same else np.concatenate([na, nb])
    x, y = (np.concatenate(z) for z in zip(*edges, strict=True))
    rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    low = rank.copy()
    while True:  # the smallest id spreads along the edges, with jumps
        before = low.copy()
        np.minimum.at(low, x, before[y])
        np.minimum.at(low, y, before[x])
        by_rank = np.empty(len(ids), np.int64)
        by_rank[rank] = low
        low = by_rank[low]
        if (low == before).all():
            break
    full = np.flatnonzero(n)
    return ids[full], n[full], np.sort(ids)[low[full]]


def split(key: tuple, rows: pa.Table) -> pa.Table:
    """applyInArrow: the centres of a cell, from its sample."""
    x = unit(matrix(rows.column("x").combine_chunks()))
    most = min(FAN, max(2, -(-rows.column("n")[0].as_py() * 4 // (3 * CHUNK))))
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int64()), pa.array([pickle.dumps(picked(x, most))], pa.binary())], names=["dim", "cell", "held"])


def matrix(x: pa.Array) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over (cell, held, id, w, x, dim), the centres of a cell before
    its vectors: each vector with its nearest centre's cell and distance."""
    centres = None
    for batch in batches:
        leads = np.flatnonzero(batch.column("held").is_valid().to_numpy(zero_copy_only=False))
        for at, to in zip([0, *(leads + 1).tolist()], [*leads.tolist(), batch.num_rows], strict=True):
            if at and at <= batch.num_rows and at - 1 in leads:
                centres = pickle.loads(batch.column("held")[at - 1].as_py())
            if to > at:
                part = batch.slice(at, to - at)
                d = distances(unit(matrix(part.column("x"))), centres)
                cell = part.column("cell").to_numpy() * FAN + 1 + d.argmin(1)
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in ("x", "id", "w", "dim")], pa.array(cell), pa.array(d.min(1))], names=["x", "id", "w", "dim", "cell", "far"])


def family(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (dim, cell, kids, held) -> what a pair of cells is expanded
    by: of each cell its children's names, centres, radii and whether they are
    leaves; a leaf is its own only child."""
    for batch in batches:
        out: dict[str, list] = {"dim": [], "cell": [], "held": []}
        for row in batch.to_pylist():
            kids = sorted(row["kids"], key=lambda k: k["cell"])
            cells = np.array([k["cell"] for k in kids], np.int64)
            centres = pickle.loads(row["held"])[(cells - 1) % FAN]
            radii, leaf = np.array([k["radius"] for k in kids]), np.array([k["leaf"] for k in kids])
            told = [(row["cell"], slice(None)), *[(int(cells[i]), slice(i, i + 1)) for i in np.flatnonzero(leaf)]]
            for cell, own in told:
                out["dim"].append(row["dim"])
                out["cell"].append(cell)
                out["held"].append(pickle.dumps((cells[own], centres[own], radii[own], leaf[own])))
        yield pa.RecordBatch.from_arrays([pa.array(out["dim"], pa.int32()), pa.array(out["cell"], pa.int64()), pa.array(out["held"], pa.binary())], names=["dim", "cell", "held"])


def expanded(reach: float):
    """mapInArrow: (dim, a, b, ha, hb) -> the pairs of their children that are
    not pruned (dim, a, b, state): WHOLE, both LEAF, or still OPEN."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for dim, a, b, ha, hb in zip(*[batch.column(k).to_pylist() for k in ("dim", "a", "b", "ha", "hb")], strict=True):
                (ca, xa, ra, la), (cb, xb, rb, lb) = pickle.loads(ha), pickle.loads(hb)
                d = distances(xa, xb)
                both = ra[:, None] + rb[None, :]
                near = d - both <= reach + SLACK
                if a == b:
                    near &= np.tri(len(ca), dtype=bool).T
                i, j = np.nonzero(near)
                whole = (d + both)[i, j] <= reach - SLACK
                state = np.where(whole, WHOLE, np.where(la[i] & lb[j], LEAF, OPEN)).astype(np.int32)
                parts.append((np.full(len(i), dim, np.int32), ca[i], cb[j], state))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=["dim", "a", "b", "state"])

    return run


OPEN, LEAF, WHOLE = 0, 1, 2


def chunk_row(key: tuple, rows: pa.Table) -> pa.Table:
    """applyInArrow: a chunk's vectors, in the order of their tree, and the
    tree, in one row."""
    raw = matrix(rows.column("x").combine_chunks())
    tree = Tree(unit(raw))
    o, tree.order = tree.order, np.arange(len(raw))
    held = {"ids": rows.column("id").to_numpy()[o], "w": rows.column("w").to_numpy()[o], "x": raw[o], "tree": tree}
    tree.x32 = None
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int64()), pa.array([key[2].as_py()], pa.int32()), pa.array([pickle.dumps(held)], pa.binary())], names=["dim", "cell", "part", "held"])


def unpacked(held: bytes) -> dict:
    """A chunk with its vectors at norm 1, in double and in single precision."""
    chunk = pickle.loads(held)
    chunk["unit"] = unit(chunk.pop("x"))
    chunk["tree"].x32 = chunk["unit"].astype(np.float32)
    return chunk


def pair_rows(threshold: float):
    """applyInArrow: the chunks of a pair of tiles and, in rows without a
    chunk, the pairs of them to compare -> their links."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        chunk = {(c, p): unpacked(h) for c, p, h in zip(*[rows.column(k).to_pylist() for k in ("cell", "part", "held")], strict=True) if h is not None}
        found = [[np.zeros(0, np.int64)] for _ in range(3)]
        for pairs in rows.column("pairs").to_pylist():
            for p in pairs or []:
                a, b = (p["a"], p["pa"]), (p["b"], p["pb"])
                if a in chunk and b in chunk:  # a chunk may be empty
                    for held, new in zip(found, link(chunk[a], chunk[b], a == b, threshold), strict=True):
                        held.append(new)
        return pa.table([pa.array(np.concatenate(x)) for x in found], names=["id", "n", "root"])

    return run


def tiled(cells: DataFrame) -> DataFrame:
    """(dim, cell, part, parts, tile) of the chunks: tiles of about equal size, in
    the order that cells have in the tree, so that what is near shares a tile."""
    starts = [(FAN**k - 1) // (FAN - 1) for k in range(DEPTH + 1)]  # the first cell of each depth
    first = F.coalesce(*[F.when(F.col("cell") >= starts[k], F.col("cell") * FAN ** (DEPTH - k) + starts[DEPTH - k]) for k in range(DEPTH, -1, -1)])
    order = Window.partitionBy("dim").orderBy(first)  # a row for a chunk or several, not for a vector
    n, before = F.sum("n").over(Window.partitionBy("dim")), F.sum("n").over(order) - F.col("n")
    tiles = F.greatest(F.lit(TILES), F.ceil(n * F.col("dim") * 4 / TILE_BYTES))
    tiles = F.greatest(F.least(F.lit(TILES), F.ceil(n / (2 * CHUNK))), F.ceil(n * F.col("dim") * 4 / TILE_BYTES))
    # a leaf above CHUNK, which only the last level can have, is dealt to parts
    parts = F.ceil(F.col("n") / CHUNK)
    leaf = cells.where("leaf").select("dim", "cell", "n", parts.cast("int").alias("parts"), before.alias("before"), (tiles / n).alias("each"))
    leaf = leaf.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return leaf.select("dim", "cell", "part", "parts", F.floor((F.col("before") + F.col("part") * F.col("n") / F.col("parts")) * F.col("each")).alias("tile"))


def upper_levels(vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Splits ``vectors (x, id, w, dim)`` until cells are chunks: the vectors
    with their leaf ``cell``, the cells (dim, cell, n, radius, w, least, leaf)
    and what pairs of them are expanded by (none, if no cell was split). The
    root is cell 0 and the children of c are FAN c + 1 and so on."""
    spark = vectors.sparkSession
    kind = vectors.schema["x"].dataType.simpleString()
    placed = vectors.select("x", "id", "w", "dim", F.lit(0).cast("long").alias("cell"), F.lit(2.0).alias("far"))
    leaves = cells = centres = None
    for depth in range(DEPTH + 1):
        size = placed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"), F.sum("w").alias("w"), F.min("id").alias("least"))
        stats = cut(size.withColumn("leaf", (F.col("n") <= CHUNK) | F.lit(depth == DEPTH)), "cells")
        cells = stats if cells is None else cells.union(stats)
        large = stats.where("not leaf").select("dim", "cell", "n")
        if large.isEmpty():
            leaves = placed if leaves is None else leaves.union(placed)
            break
        marked = placed.join(large, ["dim", "cell"], "left").select(*placed.columns, "n")
        done = marked.where("n is null").drop("n")
        leaves = done if leaves is None else leaves.union(done)
        going = marked.where("n is not null")
        u = F.xxhash64(F.lit(depth), "id").bitwiseAND((1 << 53) - 1) / float(1 << 53)
        turn = F.row_number().over(Window.partitionBy("dim", "cell").orderBy("u", "id"))
        few = going.select("x", "id", "dim", "cell", "n", u.alias("u")).where(F.col("u") < 4 * CELL_SAMPLE / F.col("n")).withColumn("turn", turn).where(F.col("turn") <= CELL_SAMPLE)
        nets = cut(few.select("dim", "cell", "x", "n").groupBy("dim", "cell").applyInArrow(split, "dim int, cell long, held binary"), "centres")
        centres = nets if centres is None else centres.union(nets)
        salts = F.ceil(F.col("n") / SALT)
        lead = nets.join(large, ["dim", "cell"]).select("dim", "cell", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), "held", F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("w"), F.lit(None).cast(kind).alias("x"))
        body = going.select("dim", "cell", F.pmod(F.xxhash64("id"), salts).alias("salt"), F.lit(None).cast("binary").alias("held"), "id", "w", "x")
        both = lead.union(body).repartition(shuffle_parts(spark), "dim", "cell", "salt").sortWithinPartitions("dim", "cell", "salt", F.col("held").isNull())
        placed = cut(both.mapInArrow(assigned, f"x {kind}, id long, w long, dim int, cell long, far double"), "placed")
    if centres is None:
        return leaves, cells, None
    kids = cells.where("cell > 0").groupBy("dim", F.floor((F.col("cell") - 1) / FAN).alias("cell")).agg(F.collect_list(F.struct("cell", "radius", "leaf")).alias("kids"))  # FAN at most
    kin = cut(kids.join(centres, ["dim", "cell"]).select("dim", "cell", "kids", "held").mapInArrow(family, "dim int, cell long, held binary"), "family")
    return leaves, cells, kin


def cell_pairs(cells: DataFrame, kin: DataFrame | None, reach: float) -> DataFrame:
    """(dim, a, b, state): the pairs of leaves to compare and the pairs of cells
    that link as a whole, by expanding the pairs of cells from the roots."""
    roots = cells.where("cell = 0").select("dim", F.col("cell").alias("a"), F.col("cell").alias("b"), F.when(F.col("leaf"), LEAF).otherwise(OPEN).alias("state"))
    told, now = roots.where(F.col("state") != OPEN), roots.where(F.col("state") == OPEN)
    while kin is not None and not now.isEmpty():
        ka, kb = (kin.select(F.col("dim"), F.col("cell").alias(k), F.col("held").alias(f"h{k}")) for k in ("a", "b"))
        met = now.select("dim", "a", "b").join(ka, ["dim", "a"]).join(kb, ["dim", "b"]).select("dim", "a", "b", "ha", "hb")
        new = cut(met.mapInArrow(expanded(reach), "dim int, a long, b long, state int"), "pairs")
        told, now = told.union(new.where(F.col("state") != OPEN)), new.where(F.col("state") == OPEN)
    return told


def whole_links(pairs: DataFrame, cells: DataFrame, leaves: DataFrame) -> DataFrame:
    """(id, n, root) from the pairs of cells that link as a whole."""
    c = cells.select("dim", "cell", "w", "least")
    sides = pairs.join(c.select("dim", F.col("cell").alias("a"), F.col("w").alias("wa"), F.col("least").alias("la")), ["dim", "a"]).join(c.select("dim", F.col("cell").alias("b"), F.col("w").alias("wb"), F.col("least").alias("lb")), ["dim", "b"])
    same, root = F.col("a") == F.col("b"), F.least("la", "lb").alias("root")
    given = sides.select("dim", F.col("a").alias("cell"), F.col("wb").alias("n"), same.cast("long").alias("own"), root).union(sides.where(~same).select("dim", F.col("b").alias("cell"), F.col("wa").alias("n"), F.lit(0).cast("long").alias("own"), root))
    given = given.groupBy("dim", "cell").agg(F.sum("n").alias("n"), F.sum("own").alias("own"), F.min("root").alias("root"))

    def up(line: Column, _: Column) -> Column:
        last = F.element_at(line, -1)
        return F.when(last > 0, F.array_append(line, F.floor((last - 1) / FAN))).otherwise(line)

    line = F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), F.array("cell"), up)  # a cell and all above it
    above = leaves.select("id", "w", "dim", F.explode(line).alias("cell"))
    rows = above.join(given, ["dim", "cell"]).groupBy("id").agg(F.sum(F.col("n") - F.col("own") * F.col("w")).alias("n"), F.min("root").alias("root"))
    return rows.where("n > 0")


def embedding_dedup(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: ``id_col``, ``n_links``, ``component_id``,
    ``kept``."""
    kind = table.schema[vector_col].dataType
    rows = columns(table, id=id_col, x=vector_col).select(F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x"))
    valid = rows.where("id is not null").where(finite_vector(F.col("x"))).withColumn("x", F.transform("x", lambda v: v + F.lit(0.0)))
    # a vector is a node by its smallest id, or, where ids repeat, by a number of its own
    _, repeated = tagged(valid.select("id"), "id", "id")
    groups = valid.groupBy("x").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("w"))
    groups = cut(groups.select("x", "least", (F.monotonically_increasing_id() if repeated else F.col("least")).alias("id"), "w", F.size("x").alias("dim")), "vectors")
    if groups.isEmpty():
        return rows.select(F.col("id").alias(id_col), F.when(F.col("id").isNotNull(), F.lit(0).cast("long")).alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    reach = float(np.sqrt(2 - 2 * threshold))
    # single precision where the vectors come in it, so that nothing is lost
    leaves, cells, kin = upper_levels(groups.select(F.col("x").cast(kind), "id", "w", "dim"))
    cells = cut(cells, "cells")
    pairs = cut(cell_pairs(cells, kin, reach), "pairs")
    tiles = cut(tiled(cells), "tiles")
    part = F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part")
    chunks = leaves.join(tiles.select("dim", "cell", "parts").distinct(), ["dim", "cell"]).select("id", "w", "x", "dim", "cell", part)
    chunks = cut(chunks.groupBy("dim", "cell", "part").applyInArrow(chunk_row, "dim int, cell long, part int, held binary"), "chunks")
    side = lambda k: tiles.select("dim", F.col("cell").alias(k), F.col("part").alias(f"p{k}"), F.col("tile").alias(f"t{k}"))
    met = pairs.where(F.col("state") == LEAF).join(side("a"), ["dim", "a"]).join(side("b"), ["dim", "b"]).where("a <> b or pa <= pb")
    met = cut(met.select("dim", F.least("ta", "tb").alias("i"), F.greatest("ta", "tb").alias("j"), "a", "pa", "b", "pb"), "met")
    asked = met.groupBy("dim", "i", "j").agg(F.collect_list(F.struct("a", "pa", "b", "pb")).alias("pairs"))  # of two tiles' chunks
    needed = met.select("dim", "i", "j", F.col("a").alias("cell"), F.col("pa").alias("part")).union(met.select("dim", "i", "j", "b", "pb")).distinct()
    none = F.lit(None)
    put = needed.join(chunks, ["dim", "cell", "part"]).select("dim", "i", "j", "cell", "part", "held", none.cast(asked.schema["pairs"].dataType).alias("pairs"))
    put = put.union(asked.select("dim", "i", "j", none.cast("long"), none.cast("int"), none.cast("binary"), "pairs"))
    # a task for each pair of tiles or few of them: they are small to read and long to compare
    tasks = min(10_000, max(1, 3 * asked.count()))
    found = put.repartition(tasks, "dim", "i", "j").groupBy("dim", "i", "j").applyInArrow(pair_rows(threshold), "id long, n long, root long")
    links = cut(found.union(whole_links(pairs.where(F.col("state") == WHOLE).select("dim", "a", "b"), cells, leaves)), "found")
    comps = components(links.select(F.col("id").alias("a"), F.col("root").alias("b")))
    sums = links.groupBy("id").agg(F.sum("n").alias("links"))
    if repeated:
        least = groups.select("id", "least").join(comps, "id").groupBy("root").agg(F.min("least").alias("name"))
        comps = comps.join(least, "root").select("id", F.col("name").alias("root"))
    told = groups.select("id", "least", "w", "x").join(sums, "id", "left").join(comps, "id", "left").where("w > 1 or links > 0")
    told = told.select(F.col("x").alias("same"), (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("root", "least").alias("component_id"))
    out = rows.withColumn("y", F.transform("x", lambda v: v + F.lit(0.0))).join(told, F.col("y") == F.col("same"), "left")
    comp = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.when(F.col("id").isNotNull(), F.coalesce("n_links", F.lit(0).cast("long"))).alias("n_links"), F.when(F.col("id").isNotNull(), comp).alias("component_id"), F.coalesce(comp == F.col("id"), F.lit(False)).alias("kept"))
