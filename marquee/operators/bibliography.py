"""Scholarly works: safe projections, title matching, discovery outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.text import ascii_tokens
from marquee.functions.values import rebuilt_text
from marquee.operators.merge import new_rows

#: Schemas of recorded works of the two kinds of providers.
LOCATION = "struct<landing_page_url:string,license:string,pdf_url:string>"
INDEXED = f"id string, title string, doi string, publication_date string, authorships array<struct<author:struct<display_name:string>>>, primary_location {LOCATION}, best_oa_location {LOCATION}, open_access struct<is_oa:boolean,oa_status:string>, language string, cited_by_count int, type string, abstract_inverted_index map<string,array<int>>"
DATE_PARTS = "struct<`date-parts`:array<array<int>>>"
REGISTERED = f"DOI string, title array<string>, URL string, type string, published {DATE_PARTS}, `published-print` {DATE_PARTS}, `published-online` {DATE_PARTS}, author array<struct<given:string,family:string>>, `container-title` array<string>, publisher string, license array<struct<URL:string>>, `is-referenced-by-count` int, abstract string"
OUTCOMES = ("complete", "no_candidates", "skipped_ambiguous", "failed")


def safe_title(normal: Column) -> Column:
    """Whether a normalised title is long enough to search for. Every listed
    ambiguous title is shorter than this."""
    return F.length(normal) >= 8


#: Fixed bounds: how many works of a title each kind of provider is asked for.
PER_TITLE = {"indexed": 10, "registered": 20}


def answered(rows: DataFrame, kind: str) -> DataFrame:
    """Of recorded answers (title, place, ...) those that a provider of the kind
    gives to one title."""
    return rows.where(F.col("place") < PER_TITLE[kind])


def registered_works(raw: DataFrame) -> DataFrame:
    """Bibliographic fields only: no abstract is kept. Works without a DOI or
    a title go."""
    doi, title = F.lower(F.trim("DOI")), F.trim(F.get("title", 0))
    rows = raw.where((F.coalesce(doi, F.lit("")) != "") & (F.coalesce(title, F.lit("")) != ""))
    names = F.transform(F.coalesce("author", F.array()), lambda a: F.concat_ws(" ", F.nullif(a["given"], F.lit("")), F.nullif(a["family"], F.lit(""))))
    return rows.select(
        doi.alias("doi"), title.alias("title"), F.coalesce("URL", F.concat(F.lit("https://doi.org/"), doi)).alias("url"), "type",
        F.coalesce("published", "`published-online`", "`published-print`").alias("published"), names.alias("authors"),
        F.coalesce("`container-title`", F.array().cast("array<string>")).alias("container_title"), "publisher",
        F.transform(F.coalesce("license", F.array().cast("array<struct<URL:string>>")), lambda x: x["URL"]).alias("licenses"), F.col("`is-referenced-by-count`").alias("cited_by_count"),
    )


def indexed_works(raw: DataFrame) -> DataFrame:
    """(work_id, title, url, abstract, metadata fields) of recorded works; the
    work id is the last part of the work's URL and begins with W."""
    wid = F.element_at(F.split(F.regexp_replace("id", "/+$", ""), "/"), -1)
    place = F.coalesce("best_oa_location", "primary_location")
    authors = F.array_compact(F.transform("authorships", lambda a: F.nullif(a["author"]["display_name"], F.lit(""))))
    return raw.select(
        F.when(F.assert_true(wid.startswith("W")).isNull(), wid).alias("work_id"), "title", F.col("id").alias("url"), rebuilt_text(F.col("abstract_inverted_index")).alias("abstract"),
        "doi", "publication_date", F.coalesce(authors, F.array().cast("array<string>")).alias("authors"), "language", "type", "cited_by_count",
        F.struct(F.col("open_access")["is_oa"].alias("is_oa"), F.col("open_access")["oa_status"].alias("oa_status"), place["license"].alias("license"), place["landing_page_url"].alias("landing_page_url"), place["pdf_url"].alias("pdf_url")).alias("open_access"),
    )


def abstract_match(phrase: Column, title: Column, abstract: Column) -> Column:
    """struct(method, score) of a phrase in a normalised title or abstract, or
    null. A phrase that only the abstract has bears the name of both."""
    in_title, in_abstract = F.contains(title, phrase), F.contains(abstract, phrase)
    told = lambda m, s: F.struct(F.lit(m).alias("method"), F.lit(s).alias("score"))
    return F.when(in_title & in_abstract, told("title_and_abstract_phrase", 1.0)).when(in_title, told("title_phrase", 0.92)).when(in_abstract, told("title_and_abstract_phrase", 0.8))


def title_match(phrase: Column, title: Column) -> Column:
    told = lambda s: F.struct(F.lit("title_phrase").alias("method"), F.lit(s).alias("score"))
    return F.when(phrase == title, told(1.0)).when(F.contains(title, phrase), told(0.92))


def discovered(entities: DataFrame, works: DataFrame, held: DataFrame, failed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Outcomes of a run and its new candidates. ``entities (entity_id, title)``
    are pending; ``works (entity_id, work_id, title, abstract)`` is what the
    provider returned for each; ``held`` are the candidates there already.
    Entities in ``failed`` (entity_id) stay eligible for the next run."""
    e = entities.withColumn("phrase", ascii_tokens("title")).withColumn("safe", safe_title(F.col("phrase")))
    w = works.select("entity_id", "work_id", F.col("title").alias("work_title"), ascii_tokens(F.coalesce("title", F.lit(""))).alias("t"), ascii_tokens(F.coalesce("abstract", F.lit(""))).alias("a"))
    match = e.where("safe").join(w, "entity_id").withColumn("m", abstract_match(F.col("phrase"), F.col("t"), F.col("a"))).where("m is not null")
    match = match.select("entity_id", "work_id", F.col("title").alias("query_title"), F.coalesce("work_title", "work_id").alias("candidate_title"), F.col("m.method").alias("method"), F.col("m.score").alias("score"))
    fresh = new_rows(held, match, ["entity_id", "work_id"], ["candidate_title"])
    n = fresh.groupBy("entity_id").agg(F.count(F.lit(1)).alias("candidates"))
    out = e.join(n, "entity_id", "left")
    status = F.when(~F.col("safe"), "skipped_ambiguous").when(F.col("candidates") > 0, "complete").otherwise("no_candidates")
    if failed is not None:
        out = out.join(failed.select("entity_id", F.lit(True).alias("broken")), "entity_id", "left")
        status = F.when(F.coalesce("broken", F.lit(False)), "failed").otherwise(status)
    return out.select("entity_id", status.alias("status"), F.coalesce("candidates", F.lit(0)).alias("candidates")), fresh


def discovery_report(collection: DataFrame, outcomes: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: films, checked, candidates and a count for each outcome."""
    mine = lambda df: df.join(collection.select("entity_id"), "entity_id", "left_semi")
    q = mine(outcomes).agg(F.count(F.lit(1)).alias("checked"), *[F.count_if(F.col("status") == s).alias(s) for s in OUTCOMES])
    return collection.agg(F.count(F.lit(1)).alias("collection_films")).crossJoin(q).crossJoin(mine(candidates).agg(F.count(F.lit(1)).alias("candidates")))  # one row each
