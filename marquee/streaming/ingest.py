"""Page-checkpointed ingestion as Structured Streaming.

Input files arrive in a folder; every micro-batch is merged by key into a table
of append-only versions and noted in a ledger. ``availableNow`` drains what is
there and stops; a new start goes on where the last one ended, and a batch
that was written but not committed is found by its keys and reused. A batch
reads only the keys of the table."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marquee.operators.merge import new_rows


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


LEDGER = "run string, batch long, seen long, created long, reused long, status string, error string"


def ingest(spark: SparkSession, source: str, schema: str, key: list[str], table: str, ledger: str, checkpoint: str, run: str, files_per_batch: int = 1) -> StreamingQuery:
    """Drains ``source`` (JSON lines) into ``table``. The ledger has a row of a
    batch when it starts (running) and when it ends (complete, or failed with the
    error's first 500 characters)."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(source)

    def note(s: SparkSession, n: int, status: str, seen: int = 0, created: int = 0, error: str | None = None) -> None:
        s.createDataFrame([(run, n, seen, created, seen - created, status, error)], LEDGER).coalesce(1).write.mode("append").parquet(ledger)

    def merge(batch: DataFrame, n: int) -> None:
        s = batch.sparkSession
        note(s, n, "running")
        batch = batch.persist()
        try:
            held = read_or_empty(s, table, schema)
            fresh = new_rows(held.select(*key), batch, key).persist()
            seen, created = batch.count(), fresh.count()
            if created:
                fresh.write.mode("append").parquet(table)
            note(s, n, "complete", seen, created)
            fresh.unpersist()
        except Exception as e:
            note(s, n, "failed", error=str(e)[:500])
            raise
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Busy(RuntimeError):
    """Another writer has the table."""


@contextmanager
def exclusive(spark: SparkSession, table: str) -> Iterator[None]:
    """The only writer of a table: a lock file beside it, which the file system
    lets one of several create. A lock that a lost driver left is removed by hand."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{table.rstrip('/')}.lock")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.createNewFile(path):
        raise Busy(f"{table} has a writer")
    try:
        yield
    finally:
        system.delete(path, False)


def drain(spark: SparkSession, source: str, schema: str, key: list[str], table: str, ledger: str, checkpoint: str, run: str, files_per_batch: int = 1) -> None:
    """``ingest`` to its end, as the only writer of the table."""
    with exclusive(spark, table):
        ingest(spark, source, schema, key, table, ledger, checkpoint, run, files_per_batch).awaitTermination()


def runs(spark: SparkSession, ledger: str) -> DataFrame:
    """One row per run: its complete batches and counters, and ``status``: failed
    or running if one of its batches is and was not completed since by that run.
    A batch that was complete but not committed comes again and finds its own
    rows: of its counters those that created most count."""
    rows = read_or_empty(spark, ledger, LEDGER)
    counters = F.struct("created", "seen", "reused")
    done = rows.where("status = 'complete'").groupBy("run", "batch").agg(F.max(counters).alias("c")).select("run", "batch", "c.*")
    left = rows.where("status <> 'complete'").join(done.select("run", "batch"), ["run", "batch"], "left_anti")
    open_ = left.groupBy("run").agg(F.min("status").alias("open"), F.max("error").alias("error"))  # failed before running
    told = done.groupBy("run").agg(F.count(F.lit(1)).alias("batches"), *[F.sum(c).alias(c) for c in ("seen", "created", "reused")])
    told = rows.select("run").distinct().join(told, "run", "left").join(open_, "run", "left")
    return told.select("run", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("batches", "seen", "created", "reused")], F.coalesce("open", F.lit("complete")).alias("status"), "error")


def keyed(spark: SparkSession, source: str, schema: str, key: list[str], table: str, checkpoint: str, files_per_batch: int = 1) -> StreamingQuery:
    """Drains ``source`` (JSON lines) into ``table``, each key once, with the keys
    as state of the stream: a batch meets its keys where the state store holds
    them, by their hash, and reads nothing of the table, so its cost does not
    grow with it. State lies with the checkpoint and is found again by a later
    start. A batch writes the folder of its number, so one that comes again
    replaces what it left. Of rows with the same key any one of the first batch
    stays; rows with a null in the key are a key as well."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(source).dropDuplicates(key)

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={n}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_counts(rows: DataFrame, at: str, by: str, key: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """windowed_counts of a stream in which rows may come twice: a key counts once
    within the watermark, and its state goes with it."""
    once = rows.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
    return once.groupBy(F.window(at, size), by).agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(events: DataFrame, at: str, by: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by event-time window; rows later than the watermark are dropped
    and each window is final once the watermark has passed it."""
    return events.withWatermark(at, late).groupBy(F.window(at, size), by).agg(F.count(F.lit(1)).alias("n"))
