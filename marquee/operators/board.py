"""The corpus board: titles and the coverage of their fields, by every grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("dates", "writers", "directors", "cast", "links")


def covered(films: DataFrame, genres: DataFrame, credits: DataFrame, linked: DataFrame) -> DataFrame:
    """One row per film: ``decade`` (null without a date), ``genre`` (its first
    label), ``status`` and 0 or 1 for each of FIELDS."""
    genre = genres.groupBy("film_id").agg(F.min("label").alias("genre"))
    roles = credits.groupBy("film_id").agg(*[F.max((F.col("role") == r).cast("int")).alias(n) for r, n in (("writer", "writers"), ("director", "directors"), ("cast", "cast"))])
    links = linked.select("film_id").distinct().withColumn("links", F.lit(1))
    rows = films.withColumnRenamed("id", "film_id").join(genre, "film_id", "left").join(roles, "film_id", "left").join(links, "film_id", "left")
    have: list[Column] = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in FIELDS[1:]]
    return rows.select("film_id", (F.floor(F.year("release_date") / 10) * 10).cast("long").alias("decade"), "genre", "status", F.col("release_date").isNotNull().cast("int").alias("dates"), *have)


def board(rows: DataFrame) -> DataFrame:
    """Titles and coverage (counts and thousandths) over all, by decade, genre and
    status, and by decade with each of the others: one scan, one expansion.
    ``grouping`` tells which of (decade, genre, status) are not grouped by, as
    bits from the left; a null decade with its bit unset is a missing date."""
    decade, genre, status = F.col("decade"), F.col("genre"), F.col("status")
    sets = [[], [decade], [genre], [status], [decade, genre], [decade, status]]
    out = rows.groupingSets(sets, decade, genre, status).agg(F.grouping_id().cast("long").alias("grouping"), F.count(F.lit(1)).alias("titles"), *[F.sum(c).alias(c) for c in FIELDS])
    return out.select("decade", "genre", "status", "grouping", "titles", *FIELDS, *[F.expr(f"1000 * `{c}` div titles").alias(f"{c}_milli") for c in FIELDS])
