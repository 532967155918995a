"""Graphs as tables of links: components, chains, personalised rank, wedges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.checkpoints import cut


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links (a, b)``: ``(id, root)`` with the smallest
    id of each component as its root.

    Alternating large-star and small-star rounds: each round is one minimum
    per node (combined before the shuffle) and one equi-join, so no component
    is ever gathered in one task. Rounds end when the set of links stays as it
    was. Links of a node with itself and nulls are ignored."""

    def stars(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        low = low.select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        grown = both.join(low, both["a"] == low["u"])
        if large:  # larger neighbours of u hang on the smallest one
            out = grown.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:  # a > b here: smaller neighbours and u itself hang on the smallest
            out = grown.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    e = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = cut(e, "links")
    before = mark(e)
    while before[0]:
        e = cut(stars(stars(e, True), False), "links")
        now = mark(e)
        if now == before:
            break
        before = now
    return e.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("root")).union(e.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def successors(links: DataFrame) -> DataFrame:
    """``links (node, next)`` -> the links that chains keep: of each node the
    smallest successor, of those that name one the smallest node."""
    one = links.where("node <> next").groupBy("node").agg(F.min("next").alias("next"))
    return one.groupBy("next").agg(F.min("node").alias("node")).select("node", "next")


def chains(links: DataFrame) -> DataFrame:
    """``links (node, next)`` -> (node, head, position, next, length, cyclic): the
    place of every node in its chain, from 0, by pointer doubling.

    A node's successor is the smallest one that it names, its predecessor the
    smallest one that names it so; further predecessors end their own chains
    there (their ``next`` is null). Each round joins every unfinished node with the node that it points
    back to and takes over its pointer, which doubles what is known; the nodes
    at a head are finished and never joined to again, so a key has two rows at
    most. After log2(nodes) + 1 rounds what is unfinished lies on a cycle:
    ``cyclic``, with the smallest node of the cycle as ``head`` and no position.
    Links of a node with itself and nulls are ignored."""
    one = links.where("node <> next").groupBy("node").agg(F.min("next").alias("next"))
    kept = one.groupBy("next").agg(F.min("node").alias("node"))
    ids = one.select("node").union(one.select("next")).distinct()
    back = kept.select(F.col("next").alias("node"), F.col("node").alias("to"))
    state = cut(ids.join(back, "node", "left").select("node", "to", F.coalesce("to", "node").alias("low"), F.when(F.col("to").isNotNull(), 1).otherwise(0).cast("long").alias("steps"), F.col("to").isNull().alias("done")), "chains")
    finished = state.where("done").select("node", F.col("node").alias("head"), F.col("steps").alias("position"))
    rest = state.where("not done")
    n = state.count()
    for _ in range(max(1, n).bit_length() + 1):
        if rest.isEmpty():
            break
        at = rest.select(F.col("node").alias("to"), F.col("to").alias("beyond"), F.col("low").alias("lower"), F.col("steps").alias("more"))
        step = rest.join(at, "to", "left").select("node", F.coalesce("beyond", "to").alias("to"), F.least("low", F.coalesce("lower", "low"), "to").alias("low"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("beyond").isNull().alias("ended"))
        step = cut(step, "chains")
        # a pointer that finds no unfinished node points to a finished one
        found = step.where("ended").join(finished.select(F.col("node").alias("to"), "head", "position"), "to").select("node", "head", (F.col("steps") + F.col("position")).alias("position"))
        finished = cut(finished.union(found), "finished")
        rest = step.where("not ended").select("node", "to", "low", "steps")
    placed = finished.select("node", "head", "position", F.lit(False).alias("cyclic"))
    placed = placed.union(rest.select("node", F.col("low").alias("head"), F.lit(None).cast("long"), F.lit(True)))
    size = placed.groupBy("head").agg(F.count(F.lit(1)).alias("length"))
    return placed.join(size, "head").join(kept, "node", "left").select("node", "head", "position", "next", "length", "cyclic")


#: Mass is counted in whole units, so that sums do not depend on their order.
UNITS = 10**12
#: A cell of so many nodes times links at most is one row.
CELL = 1 << 20
#: So many steps a label goes; pairs of nodes and links that a task works on at once.
HOPS, WORK = 4, 1 << 21


def celled(edges: DataFrame) -> DataFrame:
    """``edges (a, b)`` -> (x, cell): of each node, named by its hash, the part of
    the graph that it lies in and no link leaves, or null where that is too large
    to be one row or more than HOPS steps wide.

    Each node takes the smallest label of itself and its neighbours, HOPS times
    or until all agree with their neighbours. A cell none of whose nodes has a
    neighbour of another label is closed. Two nodes of one hash lie in one cell,
    which is then no less closed."""
    e = edges.select(F.xxhash64("a").alias("x"), F.xxhash64("b").alias("y"))
    both = e.union(e.select("y", "x"))
    state = cut(both.groupBy("x").agg(F.min("y").alias("y"), F.count(F.lit(1)).alias("links")).select("x", "links", F.least("x", "y").alias("low")), "labels")
    for _ in range(HOPS):
        near = both.join(state.select(F.col("x").alias("y"), F.col("low").alias("near")), "y").groupBy("x").agg(F.min("near").alias("least"), F.max("near").alias("most"))
        agree = (F.col("least") == F.col("low")) & (F.col("most") == F.col("low"))
        state = cut(state.join(near, "x").select("x", "links", F.col("low").alias("cell"), F.least("low", "least").alias("low"), agree.alias("settled")), "labels")
        if state.where("not settled").isEmpty():
            break
    fits = F.every("settled") & (F.count(F.lit(1)) * F.sum("links") <= 2 * CELL)
    sized = state.groupBy("cell").agg(fits.alias("fits"))
    return cut(state.join(sized, "cell").select("x", F.when(F.col("fits"), F.col("cell")).alias("cell")), "cells")


def dealt(edges: DataFrame, about: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """``edges (a, b)`` in two parts that share no node: a row for each small cell
    (cell, links), with the rows of ``about (node, ...)`` for its nodes, and the
    edges that lie in no such cell, or None."""
    e = cut(edges.where("a <> b").select("a", "b"), "edges")
    cells = celled(e)
    own = cells.where("cell is not null")
    rows = e.withColumn("x", F.xxhash64("a")).join(own, "x").groupBy("cell").agg(F.collect_list(F.struct("a", "b")).alias("links"))
    if about is not None:
        told = about.select(F.xxhash64("node").alias("x"), F.struct(*about.columns).alias("row")).join(own, "x").groupBy("cell").agg(F.collect_list("row").alias("about"))
        rows = rows.join(told, "cell", "left")
    apart = cells.where("cell is null")
    return rows, None if apart.isEmpty() else cut(e.withColumn("x", F.xxhash64("a")).join(apart, "x", "left_semi").select("a", "b"), "edges")


def ranked(cells: DataFrame, rounds: int, keep: int = 15, least: int = UNITS // 10**6) -> DataFrame:
    """Rows of ``dealt`` with their ``members`` instead of the links and for each
    member, as a seed, its ``ranks``: structs of a member's place and its mass, as
    ``pushed`` would find it."""
    kind = cells.schema["links"].dataType.elementType["a"].dataType.simpleString()
    others = [c for c in cells.columns if c != "links"]
    schema = ", ".join(f"{c} {cells.schema[c].dataType.simpleString()}" for c in others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pc.list_value_length(batch.column("links")).to_numpy(zero_copy_only=False).astype(np.int64)
            turn = np.cumsum(n * (n + 1)) // WORK
            cuts = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), len(n)]
            for i, j in zip(cuts, cuts[1:]):
                some = batch.slice(i, j - i)
                if some.num_rows:
                    yield pa.RecordBatch.from_arrays([*(some.column(c) for c in others), *masses(some.column("links"), rounds, keep, least)], names=[*others, "members", "ranks"])

    return cells.mapInArrow(run, f"{schema}, members array<{kind}>, ranks array<array<struct<at:int,mass:bigint>>>")


def masses(links: pa.ListArray, rounds: int, keep: int, least: int) -> tuple[pa.ListArray, pa.ListArray]:
    """Members and ranks of some cells, all pairs of a cell's nodes at once. Sums
    of mass stay below 2**53, so they are exact in floating point."""
    size, ends = pc.list_value_length(links).to_numpy(zero_copy_only=False), links.flatten()
    named = pa.concat_arrays([ends.field("a"), ends.field("b")]).dictionary_encode()
    code, n = named.indices.to_numpy().astype(np.int64), len(named.dictionary)
    owner = np.zeros(n, np.int64)
    owner[code] = np.tile(np.repeat(np.arange(len(size)), size), 2)
    order = np.argsort(owner, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    owner, (a, b) = owner[order], place[code].reshape(2, -1)
    a, b = np.divmod(np.unique(np.concatenate([a * n + b, b * n + a])), n)
    count = np.bincount(owner, minlength=len(size))  # nodes of each cell
    first = (np.cumsum(count) - count)[owner]  # of each node the first one of its cell
    wide = count[owner]
    base = np.cumsum(wide) - wide  # where the pairs of each seed begin
    at = np.arange(wide.sum()) - np.repeat(base, wide)
    degree = np.bincount(a, minlength=n)[at + np.repeat(first, wide)]
    # each link carries mass for each seed of its cell
    times = wide[a]
    seed = np.repeat(first[a], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    shift = (base - first)[seed]
    source, target = shift + np.repeat(a, times), shift + np.repeat(b, times)
    kept, waits = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    waits[base + np.arange(n) - first] = UNITS
    for _ in range(rounds):
        part = waits * (100 - keep) // (100 * degree)
        part[part < least] = 0
        kept += np.where(part > 0, waits - part * degree, 0)
        waits = np.where(part > 0, 0, waits) + np.bincount(target, part[source], len(at)).astype(np.int64)
    mass = kept + waits
    held = mass > 0
    found = pa.StructArray.from_arrays([pa.array(at[held].astype(np.int32)), pa.array(mass[held])], names=["at", "mass"])
    ranks = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.add.reduceat(held, base, dtype=np.int64))]).astype(np.int32), found)
    cells = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
    return pa.ListArray.from_arrays(cells, named.dictionary.take(pa.array(order))), pa.ListArray.from_arrays(cells, ranks)


def personal_ranks(edges: DataFrame, seeds: DataFrame | None = None, rounds: int = 8, keep: int = 15, least: int = UNITS // 10**6) -> DataFrame:
    """Personalised PageRank by pushing mass, see ``pushed``, of the given seeds
    or, without any, of every node with a link. In the second case small cells
    of the graph are worked out where they lie: of these no pair of nodes is
    shuffled."""
    if seeds is not None:
        return pushed(edges, seeds, rounds, keep, least)
    cells, rest = dealt(edges)
    rows = ranked(cells, rounds, keep, least).select("members", F.posexplode("ranks").alias("seed", "near")).select("members", "seed", F.inline("near"))
    rows = rows.select(F.get("members", "seed").alias("seed"), F.get("members", "at").alias("node"), "mass")
    return rows if rest is None else rows.union(pushed(rest, nodes(rest), rounds, keep, least))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("seed")).union(edges.select("b"))


def pushed(edges: DataFrame, seeds: DataFrame, rounds: int = 8, keep: int = 15, least: int = UNITS // 10**6) -> DataFrame:
    """Personalised PageRank of each seed by pushing mass: ``edges (a, b)``, both
    ways and without repeats here, ``seeds (seed)`` -> (seed, node, mass).

    A seed starts with UNITS at its own node. In each round every node keeps
    ``keep`` % of what it holds and sends the rest in equal whole parts to its
    neighbours, if each gets ``least`` units at least; what a node does not send
    waits. So a seed never has more than UNITS / ``least`` parts on their way,
    whatever the degrees: a hub with too many neighbours holds what it gets.
    What a division leaves stays as well, so the mass of a seed is always UNITS."""
    both = edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut(both.join(both.groupBy("a").agg(F.count(F.lit(1)).alias("degree")), "a"), "edges")
    degrees = both.select("a", "degree").distinct()
    held = seeds.select("seed").distinct().join(degrees, F.col("seed") == F.col("a"), "left").select("seed", F.col("seed").alias("node"), F.col("degree"), F.lit(0).cast("long").alias("kept"), F.lit(UNITS).cast("long").alias("waits"))
    held = cut(held, "mass")
    part = F.expr(f"waits * {100 - keep} div (100 * degree)")
    for _ in range(rounds):
        sends = held.withColumn("part", F.when(F.col("degree").isNotNull() & (part >= least), part).otherwise(0))
        moved = sends.where("part > 0")
        # sends all but its own share: the remainder of the division is kept
        own = sends.select("seed", "node", F.when(F.col("part") > 0, F.col("kept") + F.col("waits") - F.col("part") * F.col("degree")).otherwise(F.col("kept")).alias("kept"), F.when(F.col("part") > 0, 0).otherwise(F.col("waits")).cast("long").alias("waits"))
        got = moved.select("seed", F.col("node").alias("a"), "part").join(both.select("a", "b"), "a").select("seed", F.col("b").alias("node"), F.lit(0).cast("long").alias("kept"), F.col("part").alias("waits"))
        now = own.union(got).groupBy("seed", "node").agg(F.sum("kept").alias("kept"), F.sum("waits").alias("waits"))
        held = cut(now.join(degrees, F.col("node") == F.col("a"), "left").select("seed", "node", "degree", "kept", "waits"), "mass")
    return held.select("seed", "node", (F.col("kept") + F.col("waits")).alias("mass"))


#: Members of one hub that are compared with each other in one go.
BLOCK = 512


#: Sets of more members do not name their choices of two.
LARGE = 64


def shared_twice(members: DataFrame, least: int = 2) -> DataFrame:
    """Pairs of sets that share ``least`` members or more: ``members (owner,
    member)`` -> (a, b, shared) with a < b.

    Two sets that share two members have that choice of two in common, which far
    fewer sets have than a single member. Each set names its choices, sets meet
    at those that several name, and a pair that meets n (n - 1) / 2 times shares n
    members: nothing is proposed that shares less than two. Where a choice still
    has many owners, these are dealt to blocks of BLOCK, and each pair of blocks is
    a key of its own. A set of more than LARGE members is met with all others at
    its members instead, but for its last ``least - 1``, by degree, and these
    pairs are counted by a join with the members of both. Repeated rows count
    once; nulls are ignored."""
    rows = members.where("owner is not null and member is not null").select("owner", "member").distinct()
    degree = rows.groupBy("member").agg(F.count(F.lit(1)).alias("degree"))
    listed = F.sort_array(F.collect_list(F.struct("degree", "member")))
    sets = rows.join(degree, "member").groupBy("owner").agg(listed.alias("listed")).withColumn("size", F.size("listed"))
    ordered = sets.where(F.col("size") >= least).select("owner", "size", F.posexplode("listed").alias("turn", "it"), "listed")
    rest = F.when(F.col("size") <= LARGE, F.transform(F.expr("slice(listed, turn + 2, size)"), lambda x: x["member"]))
    prefix = ordered.where(F.col("turn") < F.col("size") - 1 if least > 1 else F.lit(True))
    prefix = cut(prefix.select("owner", "size", "turn", F.col("it.member").alias("member"), F.col("it.degree").alias("degree"), rest.alias("rest")), "prefix")

    if least > 1:
        choices = prefix.select("owner", "member", F.explode("rest").alias("other"))
        named = choices.groupBy("member", "other").agg(F.count(F.lit(1)).alias("degree")).where("degree > 1")
        blocks = F.greatest(F.ceil(F.col("degree") / BLOCK), F.lit(1)).cast("long")
        dealt = choices.join(named, ["member", "other"]).withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("owner"), F.col("blocks")))
        # owners of block i meet those of block j once, at the key (i, j) with i <= j
        left = dealt.select("member", "other", F.col("owner").alias("x"), F.col("own").alias("i"), F.explode(F.expr("sequence(own, blocks - 1)")).alias("j"))
        right = dealt.select("member", "other", F.col("owner").alias("y"), F.col("own").alias("j"), F.explode(F.expr("sequence(0L, own)")).alias("i"))
        met = left.join(right, ["member", "other", "i", "j"]).where("x <> y and (i < j or x < y)")
        times = met.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count(F.lit(1)).alias("times"))
        pairs = times.select("a", "b", F.round((1 + F.sqrt(1 + 8 * F.col("times"))) / 2).cast("long").alias("shared")).where(F.col("shared") >= least)
    # large sets, and with ``least`` 1 all of them, meet the others at their members
    large = F.col("size") > LARGE if least > 1 else F.lit(True)
    asks = prefix.where(large & (F.col("turn") <= F.col("size") - least))
    blocks = F.greatest(F.ceil(F.col("degree") / BLOCK), F.lit(1)).cast("long")
    asks = asks.select("member", F.col("owner").alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("i"))
    given = prefix.where(F.col("turn") <= F.col("size") - least).select("member", F.col("owner").alias("y"), F.pmod(F.xxhash64("owner"), blocks).alias("i"))
    single = asks.join(given, ["member", "i"]).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit(None).cast("long").alias("shared")).distinct()
    pairs = cut(pairs.union(single) if least > 1 else single, "pairs")
    told = sets.select("owner", F.transform("listed", lambda x: x["member"]).alias("members"))
    both = pairs.where("shared is null").join(told.select(F.col("owner").alias("a"), F.col("members").alias("of_a")), "a").join(told.select(F.col("owner").alias("b"), F.col("members").alias("of_b")), "b")
    counted = both.select("a", "b", F.size(F.array_intersect("of_a", "of_b")).cast("long").alias("shared")).where(F.col("shared") >= least)
    return pairs.where("shared is not null").union(counted)


def best(rows: DataFrame, key: str, tie: str, k: int, score: str = "score") -> DataFrame:
    """The k rows of each key of highest score, ties to the smaller ``tie``,
    with their ``rank``."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), tie)).cast("long")
    return rows.withColumn("rank", place).where(F.col("rank") <= k)
