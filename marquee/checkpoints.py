"""Where lineage is cut: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of
    the session. Where it is unset, a local master (tests on one machine) gets
    a temporary folder, made once; on a cluster that is an error, as executors
    would write to disks of their own."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="marquee-"))
    return shared_dir(spark)


#: Removes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()
_writers: dict[int, list] = {}  # of each session the number of writers and the setting before the first
_own = threading.local()  # the tables that a thread has written, by scope


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """CLEANUP is on while any thread of the session writes."""
    with _lock:
        held = _writers.setdefault(id(spark), [0, None])
        if not held[0]:
            held[1] = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
        held[0] += 1
    try:
        yield
    finally:
        with _lock:
            held[0] -= 1
            if not held[0]:
                spark.conf.set(CLEANUP, held[1]) if held[1] is not None else spark.conf.unset(CLEANUP)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet into the shared folder and
    reads it again, so that a lost executor never repeats what lies before.
    The shuffle files that led there are of no more use and go."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with cleaned(spark):
        df.write.parquet(path)
    noted(path)
    return spark.read.schema(df.schema).parquet(path)


def noted(path: str) -> str:
    """The path goes with the scope that is open, if there is one."""
    scopes = getattr(_own, "scopes", None)
    if scopes:
        scopes[-1].append(path)
    return path


def removed(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def settled(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` returns as a written table; the tables that it wrote on
    its way are removed, also when it fails."""
    if not hasattr(_own, "scopes"):
        _own.scopes = []
    paths: list[str] = []
    _own.scopes.append(paths)
    out = None
    try:
        out = cut(build(), name)
    finally:
        _own.scopes.pop()
        kept = paths.pop() if out is not None else None  # the last one is the result
        for p in paths:
            removed(spark, p)
    if _own.scopes:
        _own.scopes[-1].append(kept)
    return out
