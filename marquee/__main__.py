"""Runs a registered query and prints its rows as JSON lines:
``python -m marquee QUERY FOLDER``; without arguments the names."""

from __future__ import annotations

import json
import sys

from pyspark.sql import SparkSession

import marquee.plans  # noqa: F401
from marquee.plans.registry import QUERIES
from marquee.ship import ship


def main(arguments: list[str], out=sys.stdout) -> int:
    if len(arguments) != 2 or arguments[0] not in QUERIES:
        print("\n".join(sorted(QUERIES)), file=out)
        return 0 if not arguments else 2
    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    for row in QUERIES[arguments[0]](spark, arguments[1]).toLocalIterator():
        print(json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str), file=out)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
