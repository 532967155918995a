"""Lineage: typed edges between works, one hop both ways."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.checkpoints import cut
from marquee.functions.values import plural
from marquee.operators.catalogue import bounded
from marquee.parts import parted
from marquee.schemas import LINEAGE

VISIBLE = ("resolved", "published")
SEQUELS = ("follows", "followed_by", "part_of_series")


def visible(assertions: DataFrame) -> DataFrame:
    return assertions.where(F.col("predicate").isin(*LINEAGE) & F.col("status").isin(*VISIBLE))


#: Fixed texts: the label and the question of each kind of edge, named by its
#: predicate and what its direction or target adds to it. The last one is for
#: every other edge.
COPY = {
    "based_on/film": ("Film adaptation", "Which premise, character engine, or pressure system is carried across this adaptation?"),
    "based_on": ("Source material", "Which premise, character engine, or pressure system is carried across this adaptation?"),
    "follows/incoming": ("Next installment", "What promise does this ending leave open, and how could the next story escalate it?"),
    "followed_by/outgoing": ("Next installment", "What promise does this ending leave open, and how could the next story escalate it?"),
    "follows/outgoing": ("Previous installment", "What story engine does this installment inherit, and what must it transform?"),
    "followed_by/incoming": ("Previous installment", "What story engine does this installment inherit, and what must it transform?"),
    "part_of_series": ("Series membership", "What is the repeatable story promise that holds this work inside the wider series?"),
    "": ("Related work", "What should a writer inspect in this source-backed relationship?"),
}


def labelled(edges: DataFrame) -> DataFrame:
    """relation_label and writer_question, looked up by the edge's predicate
    with its direction, with the kind of its target, or alone."""
    names = [F.concat_ws("/", "predicate", "direction"), F.concat_ws("/", "predicate", "target_kind"), F.col("predicate"), F.lit("")]

    def text(which: int) -> Column:
        table = F.create_map(*[F.lit(x) for k, v in COPY.items() for x in (k, v[which])])
        return F.coalesce(*[F.try_element_at(table, n) for n in names])

    return edges.withColumn("relation_label", text(0)).withColumn("writer_question", text(1))


def edges(assertions: DataFrame, entities: DataFrame, limit: int = 12) -> DataFrame:
    """The visible edges of every entity: per entity at most ``limit``, by label,
    title and target. Of edges with the same target and label the first stays,
    outgoing before incoming, then by assertion. Entities are counted first: the
    edges meet their targets in parts of a bounded number of them."""
    bounded(limit, 1, 30, "limit")
    seen = visible(assertions)
    e = entities.select(F.col("entity_id").alias("target_id"), F.col("label").alias("target_title"), F.col("kind").alias("target_kind"))
    out = seen.select(F.col("subject").alias("entity_id"), F.col("object").alias("target_id"), "assertion_id", "predicate", F.lit("outgoing").alias("direction"))
    back = seen.select(F.col("object").alias("entity_id"), F.col("subject").alias("target_id"), "assertion_id", "predicate", F.lit("incoming").alias("direction"))
    both = parted(out.unionByName(back).where("entity_id is not null"), entities.count(), "target_id")
    rows = labelled(both.join(e, "target_id"))
    first = Window.partitionBy("entity_id", "target_id", "relation_label").orderBy(F.desc("direction"), "assertion_id")
    rows = rows.withColumn("turn", F.row_number().over(first)).where("turn = 1").drop("turn")
    order = Window.partitionBy("entity_id").orderBy("relation_label", "target_title", "target_id")
    return rows.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)


def with_films(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Edges with the film that stands for the target, if one does, as a struct
    of the columns of ``items (entity_id, ...)``."""
    fields = [c for c in items.columns if c != "entity_id"]
    film = items.select(F.col("entity_id").alias("target_id"), F.struct(*fields).alias("target_film"))
    return rows.join(film, "target_id", "left")


def summaries(films: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, routes, summary) of each film; one without an entity, or without a
    route, has a fixed summary."""
    n = edges.groupBy("entity_id").agg(F.count(F.lit(1)).alias("routes"))
    rows = films.select("id", "entity_id").join(n, "entity_id", "left").withColumn("routes", F.coalesce("routes", F.lit(0)))
    # fixed texts of the catalogue
    unlinked, none = "This film has not yet been linked to the evidence core.", "No typed lineage route is available for this film yet."
    found = F.concat(plural(F.col("routes"), "source-backed lineage route", "source-backed lineage routes"), F.lit(" found."))
    return rows.select("id", "routes", F.when(F.col("entity_id").isNull(), unlinked).when(F.col("routes") == 0, none).otherwise(found).alias("summary"))


def entry_points(films: DataFrame, assertions: DataFrame, limit: int = 6) -> DataFrame:
    """Films with most installments, then routes, then by title and id."""
    bounded(limit, 1, 20, "limit")
    n = visible(assertions).groupBy(F.col("subject").alias("entity_id")).agg(F.count("assertion_id").alias("routes"), F.count_if(F.col("predicate").isin(*SEQUELS)).alias("installments"))
    return films.join(n, "entity_id").orderBy(F.desc("installments"), F.desc("routes"), "title", "entity_id").limit(limit)


#: After so many rounds what a closure knows becomes one table.
ROUNDS = 16


def closure(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """(child, ancestor, depth): transitive closure of a hierarchy, each node
    with itself at depth 0; of several ways the shortest.

    Rounds go over the nodes that have children only: every round joins the last
    round's new pairs, until there are none; cycles end as well. Leaves, the bulk
    of a hierarchy, take over what their parents know in one join."""
    pairs = edges.select(F.col(child).alias("child"), F.col(parent).alias("parent")).where("parent is not null").distinct()
    pairs = cut(pairs, "closure")
    inner = cut(pairs.select(F.col("parent").alias("child")).distinct(), "closure")
    up = cut(pairs.join(inner, "child"), "closure").withColumnRenamed("child", "ancestor")
    new = inner.select("child", F.col("child").alias("ancestor"), F.lit(0).alias("depth"))
    known = new
    for depth in count(1):
        step = new.join(up, "ancestor").select("child", F.col("parent").alias("ancestor")).distinct()
        new = cut(step.join(known, ["child", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)), "closure")
        if new.isEmpty():
            break
        known = known.unionByName(new)
        if depth % ROUNDS == 0:  # few tables to read, however deep the hierarchy
            known = cut(known, "closure")
    leaves = pairs.join(inner, "child", "left_anti")
    own = leaves.select("child").distinct().select("child", F.col("child").alias("ancestor"), F.lit(0).alias("depth"))
    above = leaves.where("child is not null").join(known.select(F.col("child").alias("parent"), "ancestor", "depth"), "parent")
    above = above.groupBy("child", "ancestor").agg((F.min("depth") + 1).alias("depth"))
    return known.unionByName(own).unionByName(above)


def handoffs(pairs: DataFrame, crew: DataFrame) -> DataFrame:
    """``pairs (node, next)``, ``crew (work, role)`` -> what each installment hands
    on: numbers of roles ``retained``, ``left`` and ``joined``, and the retained
    ones as text. Repeated credits count once."""
    roles = crew.where("role is not null").groupBy("work").agg(F.collect_set("role").alias("roles"))
    none = F.array().cast("array<string>")
    rows = pairs.join(roles.select(F.col("work").alias("node"), F.col("roles").alias("x")), "node", "left").join(roles.select(F.col("work").alias("next"), F.col("roles").alias("y")), "next", "left")
    rows = rows.select("node", "next", F.coalesce("x", none).alias("x"), F.coalesce("y", none).alias("y")).withColumn("kept", F.array_intersect("x", "y"))
    n = lambda c: F.size(c).cast("long")
    return rows.select("node", "next", n("kept").alias("retained"), (n("x") - n("kept")).alias("left"), (n("y") - n("kept")).alias("joined"), F.array_join(F.array_sort("kept"), ", ").alias("kept_roles"))
