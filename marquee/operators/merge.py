"""Merges by key: a left anti-join for what is new, an outer join for what
changes, and the counters of a run. Tables are never overwritten while they are
read: a merge returns the next version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.operators.relational import first_wins


def by_values(df: DataFrame, order: list | None = None) -> list:
    """A total order of rows: the given one, then all values that have one."""
    return [*(order or []), *[f.name for f in df.schema if not isinstance(f.dataType, T.MapType)]]


def new_rows(old: DataFrame, new: DataFrame, key: list[str], order: list | None = None) -> DataFrame:
    """Rows whose key the table lacks, the first of each key: by ``order``, then
    by all values."""
    first = first_wins(new, key, by_values(new, order))
    return first.join(old.select(*key), key, "left_anti")


def insert_if_absent(old: DataFrame, new: DataFrame, key: list[str], order: list | None = None) -> DataFrame:
    return old.unionByName(new_rows(old, new, key, order))


def insert_counts(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """One row: how many of the incoming keys are created and how many reused."""
    marked = dispositions(old, new, key)
    return marked.agg(F.count_if(F.col("disposition") == "created").alias("created"), F.count_if(F.col("disposition") == "reused").alias("reused"))


def dispositions(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    held = old.select(*key).distinct().withColumn("__held", F.lit(True))
    return new.select(*key).distinct().join(held, key, "left").withColumn("disposition", F.when(F.col("__held"), "reused").otherwise("created")).drop("__held")


def update_or_insert(old: DataFrame, new: DataFrame, key: list[str], updates: dict[str, Column | None], order: list | None = None) -> DataFrame:
    """The table with the first incoming row of each key: of a key that it has, the columns in
    ``updates`` take the incoming value where it is not null (or where the
    given condition on ``new_<column>`` and ``old_<column>`` holds) and the
    others stay; other keys are appended."""
    rest = [c for c in old.columns if c not in key]
    a = old.select(*key, *[F.col(c).alias(f"old_{c}") for c in rest], F.lit(True).alias("__old"))
    b = first_wins(new, key, by_values(new, order)).select(*key, *[F.col(c).alias(f"new_{c}") for c in rest])
    both = a.join(b, key, "full")
    out = []
    for c in rest:
        if c in updates:
            when = updates[c] if updates[c] is not None else F.col(f"new_{c}").isNotNull()
            held = F.when(when, F.col(f"new_{c}")).otherwise(F.col(f"old_{c}"))
        else:
            held = F.col(f"old_{c}")
        out.append(F.when(F.col("__old"), held).otherwise(F.col(f"new_{c}")).alias(c))
    return both.select(*key, *out)


def upgraded_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entities by qid: an unknown kind takes a known one, a label that is only
    the qid takes a real one; entities without a qid are always appended."""
    keyed = first_wins(new.where("qid is not null"), ["qid"], [F.col("kind") == "unknown_work", "label"])
    out = update_or_insert(old.where("qid is not null"), keyed, ["qid"], {"kind": (F.col("old_kind") == "unknown_work") & F.col("new_kind").isNotNull(), "label": (F.col("old_label") == F.col("qid")) & F.col("new_label").isNotNull()})
    return out.unionByName(old.where("qid is null")).unionByName(new.where("qid is null"))


def adopted_genres(old: DataFrame, new: DataFrame) -> DataFrame:
    """Genres by qid, else by label: a label without a qid adopts the incoming
    one; known qids keep their label."""
    fresh = first_wins(new.join(old.where("qid is not null").select("qid"), "qid", "left_anti"), ["label"], ["qid"])
    return update_or_insert(old, fresh, ["label"], {"qid": F.col("old_qid").isNull()})


def repaired(entities: DataFrame, statements: DataFrame, film: str) -> DataFrame:
    """Unknown works that a type statement proves to be films become films."""
    proof = statements.where((F.col("property") == "P31") & (F.col("value") == film)).groupBy("qid").agg(F.min("label").alias("proved"))
    out = entities.join(proof, "qid", "left")
    fixed = (F.col("kind") == "unknown_work") & F.col("proved").isNotNull()
    return out.withColumn("label", F.when(fixed & (F.col("label") == F.col("qid")), F.col("proved")).otherwise(F.col("label"))).withColumn("kind", F.when(fixed, "film").otherwise(F.col("kind"))).drop("proved")
