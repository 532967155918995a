"""Catalogue queries over films, genres, people and credits.

Every function takes whole tables and answers for all films or people at once;
a point look-up is a filter on the result's id, which Catalyst pushes down to
the scans. Children are aggregated on their own and joined, never multiplied
in one flat join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed order of the language editions; others follow by name.
EDITION_RANK = {"en": 0, "te": 1, "hi": 2, "ta": 3}


def bounded(value: int, low: int, high: int, name: str) -> int:
    if not low <= value <= high:
        raise ValueError(f"{name} must lie between {low} and {high}")
    return value


def genre_labels(genres: DataFrame) -> DataFrame:
    """(film_id, genres): sorted distinct labels."""
    return genres.groupBy("film_id").agg(F.array_sort(F.collect_set("label")).alias("genres"))


def film_items(films: DataFrame, genres: DataFrame) -> DataFrame:
    items = films.join(genre_labels(genres).withColumnRenamed("film_id", "id"), "id", "left")
    return items.withColumn("genres", F.coalesce("genres", F.array().cast("array<string>")))


def search(films: DataFrame, genres: DataFrame, q: str | None = None, genre: str | None = None, decade: int | None = None, limit: int = 24, offset: int = 0) -> DataFrame:
    """A page of published films, newest first with undated ones before all,
    then by title and id. ``q`` and ``genre`` may hold % and _ as wild cards."""
    bounded(limit, 1, 100, "limit")
    bounded(offset, 0, 2**31 - 1, "offset")
    rows = films.where(F.col("status") == "published")
    if q:
        rows = rows.where(F.col("title").ilike(f"%{q.strip()}%"))
    if genre:
        rows = rows.join(genres.where(F.col("label").ilike(genre.strip())), F.col("id") == F.col("film_id"), "left_semi")
    if decade:
        bounded(decade, 1880, 2100, "decade")
        rows = rows.where((F.col("release_date") >= F.make_date(F.lit(decade), F.lit(1), F.lit(1))) & (F.col("release_date") < F.make_date(F.lit(decade + 10), F.lit(1), F.lit(1))))
    page = rows.orderBy(F.col("release_date").desc_nulls_first(), "title", "id").offset(offset).limit(limit)
    return film_items(page, genres)


def credit_lists(credits: DataFrame, people: DataFrame) -> DataFrame:
    """(film_id, credits): structs sorted by role, name and person."""
    rows = credits.join(people, "person_id")
    return rows.groupBy("film_id").agg(F.array_sort(F.collect_list(F.struct("role", "name", "person_id"))).alias("credits"))


def provenance(rows: DataFrame, sources: DataFrame) -> DataFrame:
    return rows.join(sources, "source_id")


def details(films: DataFrame, genres: DataFrame, credits: DataFrame, people: DataFrame, aliases: DataFrame, provenance_: DataFrame | None = None) -> DataFrame:
    """Film items with nested credits and aliases and, where given, provenance
    (film_id, field_name, source_name, reference)."""
    out = film_items(films, genres)
    children = [credit_lists(credits, people), aliases.groupBy("film_id").agg(F.array_sort(F.collect_set("value")).alias("aliases"))]
    if provenance_ is not None:
        children.append(provenance_.groupBy("film_id").agg(F.array_sort(F.collect_list(F.struct("field_name", "source_name", "reference"))).alias("provenance")))
    for child in children:
        out = out.join(child.withColumnRenamed("film_id", "id"), "id", "left")
    return out


def filmography(films: DataFrame, credits: DataFrame) -> DataFrame:
    """(person_id, position, id, title, release_date): each person's films,
    each once, newest first with undated ones last."""
    rows = credits.select("person_id", F.col("film_id").alias("id")).distinct().join(films, "id")
    order = Window.partitionBy("person_id").orderBy(F.col("release_date").desc_nulls_last(), "title", "id")
    return rows.select("person_id", F.row_number().over(order).alias("position"), "id", "title", "release_date")


def person_graph(credits: DataFrame, people: DataFrame, max_people: int = 16) -> DataFrame:
    """Edges person -> film of each film's star graph: the people of the first
    credits (directors, writers, others; then names), their roles joined, and
    whether the film has more credits than people shown."""
    bounded(max_people, 1, 50, "max_people")
    rank = F.when(F.col("role") == "director", 0).when(F.col("role") == "writer", 1).otherwise(2)
    rows = credits.join(people, "person_id").groupBy("film_id", "person_id", "name").agg(F.min(rank).alias("rank"), roles(F.col("role")).alias("label"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("film_id").orderBy("rank", "name", "person_id")
    rows = rows.withColumn("position", F.row_number().over(order)).withColumn("credits", F.sum("n").over(Window.partitionBy("film_id")))
    rows = rows.withColumn("shown", F.least(F.count(F.lit(1)).over(Window.partitionBy("film_id")), F.lit(max_people)))
    return rows.where(F.col("position") <= max_people).select("film_id", "position", F.concat(F.lit("person:"), "person_id").alias("source"), F.concat(F.lit("film:"), "film_id").alias("target"), "label", (F.col("credits") > F.col("shown")).alias("truncated"))


def roles(c: Column) -> Column:
    return F.array_join(F.array_sort(F.collect_set(c)), "/")


def health(films: DataFrame, people: DataFrame, credits: DataFrame, sources: DataFrame, batches: DataFrame, at: str, languages: DataFrame | None = None) -> DataFrame:
    """One row: status, counts, the latest batch and, where given, the language
    editions in their order."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    out = one(films, "films").crossJoin(one(people, "people")).crossJoin(one(credits, "credits")).crossJoin(one(sources, "sources"))  # one row each
    out = out.crossJoin(batches.agg(F.max(at).alias("latest"))).withColumn("status", F.when(F.col("films") > 0, "ready").otherwise("empty"))
    if languages is None:
        return out
    listed = F.transform(F.array_sort(F.collect_list(F.struct(edition_rank(F.col("code")), "display_name", "code"))), lambda x: F.struct(x["code"].alias("code"), x["display_name"].alias("display_name")))
    return out.crossJoin(languages.agg(listed.alias("editions")))  # one row


def source_quality(sources: DataFrame, records: DataFrame, documents: DataFrame) -> DataFrame:
    """Per source the records by match status and the narrative documents;
    sources without any have zeros."""
    n = records.groupBy("source_id").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("match_status") == "matched").alias("matched"), F.count_if(F.col("match_status") == "review_required").alias("review_required"))
    d = documents.join(records.select("record_id", "source_id"), "record_id").groupBy("source_id").agg(F.count(F.lit(1)).alias("narrative_documents"))
    return sources.join(n, "source_id", "left").join(d, "source_id", "left").na.fill(0)


def edition_rank(code: Column) -> Column:
    return F.coalesce(*[F.when(code == k, F.lit(v)) for k, v in EDITION_RANK.items()], F.lit(99)).alias("rank")


def editions(languages: DataFrame) -> DataFrame:
    """(code, display_name) with its position among the editions."""
    # an edition list is small; the order is global by its nature
    return languages.withColumn("rank", edition_rank(F.col("code"))).orderBy("rank", "display_name")


def responses(rows: DataFrame) -> DataFrame:
    """Rows as the JSON documents that a service answers with: every field is
    there, nulls included, dates as ISO."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("body"))
