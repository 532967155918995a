"""Tables of the catalogue model and the contract that they keep.

Spark enforces no keys on Parquet, so every constraint is a check that returns
the rows that break it; an empty result means that the table passes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.parts import parted

FILM = "id long, title string, runtime int, release_date date, status string"
CREDIT = "film_id long, person_id long, role string"
ASSERTION = "assertion_id string, subject string, predicate string, object string, value_json string, status string"

#: Fixed vocabularies of the model.
ASSERTION_STATUS = ("candidate", "resolved", "review_required", "rejected", "published")
CHUNK_STATUS = ("eligible", "duplicate", "excluded")
LINEAGE = ("based_on", "follows", "followed_by", "part_of_series")


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(rule, key) of each row for which a rule does not hold; unknown is no
    violation, as for CHECK constraints."""
    broken = F.array_compact(F.array(*[F.when(~rule, F.lit(name)) for name, rule in rules.items()]))
    return df.select(F.explode(broken).alias("rule"), F.col(key).cast("string").alias("key"))


def duplicates(df: DataFrame, *key: str, null_safe: bool = False) -> DataFrame:
    """Keys that occur more than once. As in SQL, a key with a null is never a
    duplicate, unless null_safe. Rows are counted first and meet by key in parts
    of a bounded number; keys hardly repeat, so no task counts before that."""
    kept = df if null_safe else df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key]))
    kept = parted(kept.select(*key), df.count(), *key)
    return kept.groupBy(*key).agg(F.count(F.lit(1)).alias("times_found")).where("times_found > 1")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Children whose key is set and has no parent. With the hint shuffle_hash on
    ``parent`` its keys are hashed by parts and children are not sorted."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def has_target(df: DataFrame, key: str, *targets: str) -> DataFrame:
    """Rows without any of the targets."""
    return df.where(reduce(lambda a, b: a & b, [F.col(t).isNull() for t in targets])).select(F.lit("has_target").alias("rule"), F.col(key).cast("string").alias("key"))


def longer_than(df: DataFrame, key: str, **limits: int) -> DataFrame:
    return violations(df, key, {f"length_{c}": F.length(c) <= n for c, n in limits.items()})
