"""Counters that are kept up instead of counted anew.

A state has a row for each group and each range of 32,768 member numbers: how
many rows came, and a bitmap of the members among them. States of any batches
merge in any order, by sums and unions of bitmaps, into what one pass over all
rows gives, distinct members included, exactly. A group with very many members
is as many rows as it has ranges. Rows without a member count as rows only.
Merging a batch twice doubles its rows (not its members), so the ledger of the
ingest decides what is merged."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def delta(rows: DataFrame, by: list[str], member: str) -> DataFrame:
    """(by, range, rows, bits) of one batch; members are whole numbers from 0."""
    return rows.select(*by, F.col(member).alias("__m")).groupBy(*by, F.expr("bitmap_bucket_number(__m)").alias("range")).agg(F.count(F.lit(1)).alias("rows"), F.bitmap_construct_agg(F.bitmap_bit_position("__m")).alias("bits"))


def merged(by: list[str], *states: DataFrame) -> DataFrame:
    """One state of several."""
    return reduce(DataFrame.unionByName, states).groupBy(*by, "range").agg(F.sum("rows").alias("rows"), F.bitmap_or_agg("bits").alias("bits"))


def told(state: DataFrame, by: list[str]) -> DataFrame:
    """(by, rows, members): what the state has counted."""
    return state.groupBy(*by).agg(F.sum("rows").alias("rows"), F.sum(F.bitmap_count("bits")).alias("members"))
