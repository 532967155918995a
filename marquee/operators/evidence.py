"""Joins over the evidence core: snapshots, assertions, runs, passages and the
answers that cite them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unprojected_targets(assertions: DataFrame, target: str, films: DataFrame, film: str) -> DataFrame:
    """The targets of assertions that no film stands for, each once."""
    known = films.select(F.col(film).alias("id"))
    return assertions.select(F.col(target).alias("id")).where("id is not null").distinct().join(known, "id", "left_anti")


def member_passages(passages: DataFrame, snapshots: DataFrame, members: DataFrame, snapshot: str, entity: str) -> DataFrame:
    """Passages of the snapshots of a collection's members. The members reduce
    the snapshots before these meet the passages, the largest side, which is
    shuffled once; Spark broadcasts what its statistics show to be small."""
    return passages.join(snapshots.join(members, entity), snapshot)


def latest_snapshots(snapshots: DataFrame, assertions: DataFrame, entity: str, snapshot: str, *order: str) -> DataFrame:
    """The newest snapshot of each entity among those that have one of the
    assertions, by ``order`` and then by name. An aggregate, so that an entity
    with very many snapshots is folded before the shuffle."""
    held = snapshots.join(assertions.select(snapshot), snapshot, "left_semi")
    return held.groupBy(entity).agg(F.max_by(snapshot, F.struct(*order, snapshot)).alias(snapshot))


def run_assertions(assertions: DataFrame, run_snapshots: DataFrame, run: str) -> DataFrame:
    """The assertions of the snapshots that one run linked."""
    return assertions.join(run_snapshots.where(F.col("run_id") == run).select("snapshot_id"), "snapshot_id", "left_semi")


def completed_assertions(runs: DataFrame, run_snapshots: DataFrame, assertions: DataFrame) -> DataFrame:
    """Assertions of the snapshots of complete runs: two semi-joins in a chain,
    so that a snapshot of several runs counts once."""
    done = run_snapshots.join(runs.where("status = 'complete'").select("run_id"), "run_id", "left_semi")
    return assertions.join(done.select("snapshot_id"), "snapshot_id", "left_semi")


def members_in_order(entities: DataFrame, memberships: DataFrame, collection: str, limit: int | None = None) -> DataFrame:
    """The entities of a collection by their positions in it, then by id."""
    rows = entities.join(memberships.where(F.col("collection") == collection).select("entity_id", "position"), "entity_id").orderBy("position", "entity_id")
    return rows.limit(limit) if limit else rows


def missing_locators(definitions: DataFrame, passages: DataFrame, *locator: str) -> DataFrame:
    """Locators that a definition asks for and no passage has."""
    return definitions.select(*locator).distinct().join(passages.select(*locator), list(locator), "left_anti")


def answer_evidence(definitions: DataFrame, passages: DataFrame, *locator: str) -> DataFrame:
    """Each definition with the passages at its locator; one that no passage has
    is an error, raised where the rows are read."""
    rows = definitions.join(passages.withColumn("__there", F.lit(True)), list(locator), "left")
    told = F.concat(F.lit("no passage at "), F.concat_ws("/", *[F.col(c).cast("string") for c in locator]))
    checked = F.coalesce(F.col("__there"), F.raise_error(told).cast("boolean"))
    return rows.where(checked).drop("__there")


def narrative_quality(passages: DataFrame, answers: DataFrame, evidence: DataFrame, entity: str, section: str, markers: Column) -> DataFrame:
    """Per entity: passages, their distinct sections and citation markers,
    answers, evidence links, answers without any, and whether it passes: it has
    passages and answers, and none without evidence."""
    p = passages.groupBy(entity).agg(F.count(F.lit(1)).alias("passages"), F.count_distinct(section).alias("sections"), F.sum(markers).cast("long").alias("markers"))
    links = evidence.groupBy("answer_id").agg(F.count(F.lit(1)).alias("links"))
    a = answers.join(links, "answer_id", "left").groupBy(entity).agg(F.count(F.lit(1)).alias("answers"), F.coalesce(F.sum("links"), F.lit(0)).cast("long").alias("links"), F.count_if(F.col("links").isNull()).alias("missing"))
    rows = p.join(a, entity, "full").na.fill(0)
    return rows.withColumn("pass", (F.col("passages") > 0) & (F.col("answers") > 0) & (F.col("missing") == 0))

