"""The write path: one declarative policy for each table, one plan for all.

A policy names the key of a table and what a second writing of the key may
change. ``upsert`` unites the table with the incoming rows and folds each key in
one aggregate, whose partial step takes repeated keys together before the
shuffle; no side is joined, whatever its size, and nulls in a key are equal.
Every merge returns the next version of its table with a ``disposition``:
``created``, ``reused`` (the key came again) or ``kept`` (it did not)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.text import folded
from marquee.functions.values import filled


@dataclass(frozen=True)
class Policy:
    """``given`` columns take the incoming value unless it is null, zero or
    empty, ``fresh`` ones whatever it is; all others stay as first written."""

    key: tuple[str, ...]
    given: tuple[str, ...] = ()
    fresh: tuple[str, ...] = ()


POLICIES: dict[str, Policy] = {
    "film": Policy(("wikidata_id",), given=("release_date", "runtime", "countries")),
    "release_event": Policy(("film_id", "release_date", "source_id", "reference")),
    "external_relation": Policy(("film_id", "target", "type", "source_id")),
    "person": Policy(("wikidata_id",)),
    "film_genre": Policy(("film_id", "genre_id")),
    "film_credit": Policy(("film_id", "person_id", "role")),
    "corpus_record": Policy(("source_id", "external_id")),
    "narrative_document": Policy(("record_id", "document_type", "content_hash")),
    "entity_alias": Policy(("entity_id", "value", "language", "kind")),
    "source_record": Policy(("source_id", "external_id")),
    "assertion": Policy(("subject", "predicate", "object", "value_json", "reference")),
    "snapshot": Policy(("object_id", "revision", "content_hash")),
    "run_snapshot": Policy(("run_id", "snapshot_id")),
    "source_assertion": Policy(("snapshot_id", "locator", "extractor")),
    "passage": Policy(("snapshot_id", "locator", "ordinal", "content_hash")),
    "chunk": Policy(("configuration", "passage_id", "ordinal")),
    "discovery_query": Policy(("entity_id", "provider", "version"), fresh=("run_id", "status", "candidates")),
    "discovery_candidate": Policy(("entity_id", "provider", "work_id")),
    "membership": Policy(("collection", "entity_id")),
    "critical_work": Policy(("source_id", "external_id")),
    "work_subject": Policy(("source_id", "external_id", "entity_id", "role")),
    "answer": Policy(("entity_id", "question_id", "version")),
    "answer_evidence": Policy(("entity_id", "question_id", "passage_id")),
    "data_source": Policy(("name",)),
    "access_policy": Policy(("source_id", "mode"), fresh=("rate",)),
    "snapshot_entity": Policy(("wikidata_id",)),
    "source_object": Policy(("source_id", "external_id")),
    "collection": Policy(("code",)),
}


def upsert(name: str, old: DataFrame, new: DataFrame, *order: str) -> DataFrame:
    """The next version of the table ``name``. Of incoming rows with the same
    key the first counts, by ``order`` and then by all their values."""
    policy = POLICIES[name]
    key, rest = list(policy.key), [c for c in old.columns if c not in policy.key]
    row = F.struct(*[F.col(c) for c in rest]) if rest else F.lit(None).cast("boolean")
    turn = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.to_json(F.struct(*[F.col(c) for c in old.columns])).alias("o"))
    incoming = new.select(*key, row.alias("row"), F.lit(False).alias("held"), turn.alias("turn"))
    stored = old.select(*key, row.alias("row"), F.lit(True).alias("held"), F.lit(None).cast(incoming.schema["turn"].dataType).alias("turn"))
    came = ~F.col("held")
    both = stored.unionByName(incoming).groupBy(*key).agg(
        F.min_by("row", F.struct(came.alias("a"), F.col("turn").alias("b"))).alias("row"),
        F.min_by(F.when(came, F.col("row")), F.when(came, F.col("turn"))).alias("new"),
        F.max("held").alias("held"),
        F.max(came).alias("came"),
    )

    def value(c: str) -> Column:
        if c in policy.fresh:
            return F.when(F.col("came"), F.col("new")[c]).otherwise(F.col("row")[c])
        if c in policy.given:
            return F.when(F.col("held"), F.coalesce(filled(F.col("new")[c], old.schema[c].dataType), F.col("row")[c])).otherwise(F.col("row")[c])
        return F.col("row")[c]

    disposition = F.when(~F.col("held"), "created").when(F.col("came"), "reused").otherwise("kept")
    return both.select(*key, *[value(c).alias(c) for c in rest], disposition.alias("disposition"))


def created(rows: DataFrame) -> DataFrame:
    return rows.where("disposition = 'created'").drop("disposition")


def counters(rows: DataFrame) -> DataFrame:
    """One row: how many keys were created and how many came again."""
    return rows.agg(*[F.count_if(F.col("disposition") == d).alias(d) for d in ("created", "reused")])


def item_reference(qid: Column) -> Column:
    return F.concat(F.lit("https://www.wikidata.org/wiki/"), qid)


#: Fixed lists: the fields that a new film and a new person give provenance for.
FILM_FIELDS = ("canonical_title", "release_date", "runtime_minutes", "original_language_code", "country_codes")
PERSON_FIELDS = ("canonical_name",)


def aliases_of(rows: DataFrame, label: str) -> DataFrame:
    """(wikidata_id, value, normalized_value, language) of new films or people."""
    return created(rows).select("wikidata_id", F.col(label).alias("value"), folded(F.col(label)).alias("normalized_value"), F.lit("en").alias("language"))


def provenance_of(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(wikidata_id, field_name, reference) of new films or people, one row for
    each field."""
    names = F.explode(F.array(*[F.lit(f) for f in fields])).alias("field_name")
    return created(rows).select("wikidata_id", names, item_reference(F.col("wikidata_id")).alias("reference"))


def reviewed(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations to external works as incoming assertions: those to a work of
    unknown kind wait for a review. ``relations (subject, predicate, target,
    reference)``, ``entities (entity_id, kind)``."""
    kinds = entities.select(F.col("entity_id").alias("target"), F.col("kind").alias("object_kind"))
    rows = relations.join(kinds, "target", "left").withColumn("object_kind", F.coalesce("object_kind", F.lit("unknown_work")))
    status = F.when(F.col("object_kind") == "unknown_work", "review_required").otherwise("resolved")
    return rows.select("subject", "predicate", F.col("target").alias("object"), F.lit(None).cast("string").alias("value_json"), "reference", "object_kind", status.alias("status"))


def snapshot_id(*key: str) -> Column:
    """Named by what it is, so that a second run finds it again; a null part
    differs from an empty one."""
    return F.sha2(F.to_json(F.struct(*key), {"ignoreNullFields": "false"}), 256)


def captured(snapshots: DataFrame, links: DataFrame, assertions: DataFrame, incoming: DataFrame, run: str, extractor: str, locator: str = "metadata") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Snapshots, the run's links to them and the assertions of new ones, after
    ``incoming (object_id, revision, content_hash, url, value)`` came. A link
    tells whether the run created the snapshot or found it; a snapshot that was
    there before brings no assertion."""
    key = POLICIES["snapshot"].key
    stored = upsert("snapshot", snapshots, incoming.select(*snapshots.columns), "url")
    told = stored.where("disposition <> 'kept'").withColumn("snapshot_id", snapshot_id(*key))
    linked = upsert("run_snapshot", links, told.select(F.lit(run).alias("run_id"), "snapshot_id", F.col("disposition").alias("found")))
    values = incoming.groupBy(*key).agg(F.min("value").alias("value")).withColumn("snapshot_id", snapshot_id(*key)).select("snapshot_id", "value")
    fresh = told.where("disposition = 'created'").select("snapshot_id").join(values, "snapshot_id")
    asserted = upsert("source_assertion", assertions, fresh.select("snapshot_id", F.lit(locator).alias("locator"), F.lit(extractor).alias("extractor"), "value"))
    return stored, linked, asserted


def classified(entities: DataFrame, assertions: DataFrame, kinds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities take the kind and label of ``kinds (wikidata_id, kind, label)``,
    and assertions to them that wait for a review take the kind and are
    resolved. Kinds of unknown entities change nothing."""
    k = kinds.groupBy("wikidata_id").agg(F.min(F.struct("kind", "label")).alias("k"))
    known = entities.join(k, "wikidata_id", "left")
    after = known.withColumn("kind", F.coalesce("k.kind", "kind")).withColumn("label", F.coalesce("k.label", "label")).drop("k")
    told = known.where("k is not null").select(F.col("entity_id").alias("object"), F.col("k.kind").alias("__kind"))
    rows = assertions.join(told, "object", "left")
    waits = F.coalesce((F.col("status") == "review_required") & F.col("__kind").isNotNull(), F.lit(False))
    rows = rows.withColumn("object_kind", F.when(waits, F.col("__kind")).otherwise(F.col("object_kind"))).withColumn("status", F.when(waits, "resolved").otherwise(F.col("status")))
    return after, rows.select(*assertions.columns)


def attribution(authors: Column, source: Column) -> Column:
    """The names of the authors and the source."""
    return F.concat(F.array_join(F.transform(authors, lambda a: F.trim(a)), ", "), F.lit(" — "), source)


def works_and_subjects(works: DataFrame, subjects: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Critical works, their subjects and one row of counters, after
    ``incoming (source_id, external_id, title, authors, source_name, subjects)``
    came; ``subjects`` are structs of entity_id and role."""
    rows = incoming.withColumn("attribution_text", attribution(F.col("authors"), F.col("source_name")))
    stored = upsert("critical_work", works, rows.select(*works.columns), "title")
    linked = upsert("work_subject", subjects, incoming.select("source_id", "external_id", F.explode("subjects").alias("s")).select("source_id", "external_id", "s.entity_id", "s.role"))
    n = counters(stored).select(F.col("created").alias("works_created"), F.col("reused").alias("works_reused"))
    return stored, linked, n.crossJoin(counters(linked).select(F.col("created").alias("subject_links_created")))  # one row each


def snapshot_entities(old: DataFrame, snapshots: DataFrame) -> DataFrame:
    """An entity for each snapshot's item, labelled by the page's title or else
    by the item."""
    title = F.nullif(F.trim("title"), F.lit(""))
    return upsert("snapshot_entity", old, snapshots.select("wikidata_id", F.coalesce(title, F.col("wikidata_id")).alias("label")), "label")
