"""Spark helpers that the operators of this subpackage have in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.checkpoints import cut, removed, settled, shared_dir
from marquee.operators.graph import components

__all__ = ["columns", "components", "cut", "finite_vector", "removed", "sample", "settled", "shared_dir", "shuffle_parts", "tagged"]


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def columns(df: DataFrame, **named: str) -> DataFrame:
    """Only the columns that an operator reads, under its own names; whatever
    else the table holds cannot clash with them."""
    return df.select(*[df[f"`{c}`"].alias(k) for k, c in named.items()])


def tagged(df: DataFrame, key: str, *contents: str) -> tuple[DataFrame, bool]:
    """``df`` with a long ``tag`` so that (key, tag) names what a row is, and
    whether a key repeats. The tag is 0 where the key occurs once and a hash of
    the contents where it repeats or is null: rows that repeat key and contents
    have the same tag, rows of one key with different contents different ones.

    Only the keys are read and counted; where none repeats, nothing is joined."""
    several = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    several = cut(several.select(F.col(key).alias("__several")), "several")
    none = several.isEmpty()
    rows = df.withColumn("__several", F.lit(None)) if none else df.join(several, df[key] == several["__several"], "left")
    named = F.col("__several").isNull() & F.col(key).isNotNull()
    return rows.withColumn("tag", F.when(named, F.lit(0).cast("long")).otherwise(F.xxhash64(*contents))).drop("__several"), not none


def sample(df: DataFrame, key: str, size: int, seed: int = 0) -> DataFrame:
    """The ``size`` rows of least hash of ``key``. Of a large table only a share
    that holds them for certain is sorted, four times as many rows."""
    n = df.count()
    u = F.xxhash64(F.lit(seed), key).bitwiseAND((1 << 53) - 1) / float(1 << 53)
    few = df.where(u < 4 * size / n) if n > 4 * size else df
    return few.orderBy(u, key).limit(size)


def finite_vector(c: Column) -> Column:
    """Whether an array of floats is not null or empty, holds only finite
    numbers and is not zero."""
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(c.isNotNull() & ~bad & F.exists(c, lambda x: x != 0), F.lit(False))
