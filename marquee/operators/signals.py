"""Connections between films: shared genres, shared people, release era."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions.values import era_points, plural
from marquee.operators.catalogue import bounded

#: Fixed points: per shared genre or person, and the caps.
GENRE_POINTS, GENRE_CAP, PERSON_POINTS, PERSON_CAP = 15, 45, 12, 35


def pair_signals(pairs: DataFrame, films: DataFrame, genres: DataFrame, credits: DataFrame, people: DataFrame) -> DataFrame:
    """For each pair (first, second): (label, weight, contribution, evidence).

    Each signal is an equi-join of its own, from the pairs to both sides'
    children, and an aggregate."""
    g = genres.select("film_id", "label").distinct()
    shared = pairs.join(g.withColumnRenamed("film_id", "first"), "first").join(g.withColumnRenamed("film_id", "second"), ["second", "label"])
    genre = shared.groupBy("first", "second").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("label")), ", ").alias("evidence"))
    genre = genre.select("first", "second", F.lit("Shared genres").alias("label"), F.lit(0.45).alias("weight"), F.least(F.lit(GENRE_CAP), GENRE_POINTS * F.col("n")).cast("double").alias("contribution"), "evidence")

    c = credits.groupBy("film_id", "person_id").agg(F.collect_set("role").alias("roles"))
    a, b = c.select(F.col("film_id").alias("first"), "person_id", F.col("roles").alias("mine")), c.select(F.col("film_id").alias("second"), "person_id", F.col("roles").alias("theirs"))
    both = pairs.join(a, "first").join(b, ["second", "person_id"]).join(people, "person_id")
    told = F.concat("name", F.lit(" ("), F.array_join(F.array_sort(F.array_union("mine", "theirs")), "/"), F.lit(")"))
    person = both.groupBy("first", "second").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("name", "person_id", told.alias("told")))).alias("all"))
    evidence = F.concat(F.array_join(F.transform(F.slice("all", 1, 4), lambda x: x["told"]), ", "), F.when(F.col("n") > 4, F.lit(" and more")).otherwise(F.lit("")))
    person = person.select("first", "second", F.lit("Shared creative collaborators").alias("label"), F.lit(0.35).alias("weight"), F.least(F.lit(PERSON_CAP), PERSON_POINTS * F.col("n")).cast("double").alias("contribution"), evidence.alias("evidence"))

    d = films.select("id", "release_date").where("release_date is not null")
    dated = pairs.join(d.select(F.col("id").alias("first"), F.col("release_date").alias("d1")), "first").join(d.select(F.col("id").alias("second"), F.col("release_date").alias("d2")), "second")
    era = dated.withColumn("contribution", era_points(F.col("d1"), F.col("d2"))).where("contribution is not null")
    gap = F.abs(F.year("d1") - F.year("d2"))
    era = era.select("first", "second", F.lit("Release era").alias("label"), F.lit(0.2).alias("weight"), "contribution", F.concat(F.lit("Released "), plural(gap, "year", "years"), F.lit(" apart")).alias("evidence"))
    return genre.unionByName(person).unionByName(era)


def comparisons(pairs: DataFrame, films: DataFrame, genres: DataFrame, credits: DataFrame, people: DataFrame) -> DataFrame:
    """For each pair its number of signals, their points and a summary."""
    s = pair_signals(pairs, films, genres, credits, people).groupBy("first", "second").agg(F.count(F.lit(1)).alias("n"), F.sum("contribution").alias("points"))
    s = pairs.join(s, ["first", "second"], "left").na.fill(0, ["n"]).na.fill(0.0, ["points"])
    found = F.concat(plural(F.col("n"), "evidence-backed connection", "evidence-backed connections"), F.lit(" found."))
    return s.withColumn("summary", F.when(F.col("n") > 0, found).otherwise("No direct metadata connection was found in the current catalog."))


def compared(first: int, second: int, films: DataFrame, genres: DataFrame, credits: DataFrame, people: DataFrame) -> DataFrame:
    """The signals of one pair of films. The same film twice, and a film that is
    not there, are errors."""
    if first == second:
        raise ValueError("choose two different films to compare")
    there = {r["id"] for r in films.where(F.col("id").isin(first, second)).select("id").distinct().collect()}  # two at most
    if len(there) < 2:
        raise LookupError("one or both films were not found")
    pair = films.sparkSession.range(1).select(F.lit(first).cast("long").alias("first"), F.lit(second).cast("long").alias("second"))
    both = lambda df, c: df.where(F.col(c).isin(first, second))
    return pair_signals(pair, both(films, "id"), both(genres, "film_id"), both(credits, "film_id"), people)


def similar(target: int, films: DataFrame, genres: DataFrame, credits: DataFrame, limit: int = 8) -> DataFrame:
    """The published films with most points in common with one film.

    The target's genres and people are semi-joined to the children, so only
    what touches the target is aggregated; the era signal is a projection."""
    bounded(limit, 1, 20, "limit")
    mine = films.where(F.col("id") == target).select(F.col("release_date").alias("own_date"))
    g = genres.select("film_id", "label").distinct()
    g = g.join(g.where(F.col("film_id") == target).select("label"), "label", "left_semi").groupBy("film_id").agg(F.count(F.lit(1)).alias("shared_genres"))
    p = credits.select("film_id", "person_id").distinct()
    p = p.join(p.where(F.col("film_id") == target).select("person_id"), "person_id", "left_semi").groupBy("film_id").agg(F.count(F.lit(1)).alias("shared_people"))
    rows = films.where((F.col("status") == "published") & (F.col("id") != target)).crossJoin(F.broadcast(mine))  # one row
    for child in (g, p):
        rows = rows.join(child.withColumnRenamed("film_id", "id"), "id", "left")
    rows = rows.na.fill(0, ["shared_genres", "shared_people"]).withColumn("era", F.coalesce(era_points(F.col("own_date"), F.col("release_date")), F.lit(0.0)))
    score = F.least(F.lit(GENRE_CAP), GENRE_POINTS * F.col("shared_genres")) + F.least(F.lit(PERSON_CAP), PERSON_POINTS * F.col("shared_people")) + F.col("era")
    rows = rows.withColumn("score", F.least(F.lit(100.0), score.cast("double"))).where("score > 0")
    return rows.orderBy(F.desc("score"), "title", "id").limit(limit)


def era_neighbours(films: DataFrame, years: int = 10) -> DataFrame:
    """How many other films were released within so many years of each film: a
    band join as a sliding frame over years, of which there are few, instead
    of a comparison of all pairs."""
    y = films.where("release_date is not null").select("id", F.year("release_date").alias("year"))
    n = y.groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    near = n.select("n", F.explode(F.sequence(F.col("year") - years, F.col("year") + years)).alias("year")).groupBy("year").agg(F.sum("n").alias("near"))
    return y.join(near, "year").select("id", "year", (F.col("near") - 1).alias("neighbours"))
