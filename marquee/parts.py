"""Shuffles whose tasks hold a bounded number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: About so many rows go into a part.
ROWS = 1 << 18


def parted(df: DataFrame, rows: int, *key: str) -> DataFrame:
    """``df`` shuffled by ``key`` into a part for each ROWS of ``rows``, at least
    into the session's number of shuffle partitions.

    Adaptive execution merges other shuffles up to 64 MB of compressed bytes; ids
    and names compress so well that a task then sorts or hashes gigabytes. Parts
    of a stated number are not merged."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(n, -(-rows // ROWS)), *key)
