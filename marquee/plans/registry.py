"""The registry of queries: a name, a function of the model and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marquee.checkpoints import settled
from marquee.sources.tables import Model

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Queries that write on their way; their result is a table.
WRITES: set[str] = set()


def query(name: str, sql: str | None = None, writes: bool = False):
    """Registers a function of the model; without SQL only tests compare it. What
    a query that ``writes`` files or tables on its way has left there goes when
    its result is a table."""

    def keep(f: Callable[[Model], DataFrame]) -> Callable[[Model], DataFrame]:
        if writes:
            WRITES.add(name)
            QUERIES[name] = lambda spark, sf_dir: settled(spark, name, lambda: f(Model(spark, sf_dir)))
        else:
            QUERIES[name] = lambda spark, sf_dir: f(Model(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return keep
