"""Sinks: content-addressed payloads, canonical manifests, reports, table versions."""

from __future__ import annotations

import hashlib
import io
import json
import tarfile
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.checkpoints import cut, noted, shared_dir


def as_uri(folder: str) -> str:
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


def store_payloads(payloads: DataFrame, folder: str, suffix: str = "json") -> DataFrame:
    """Writes each (source, body) once as a file named by its content: folder,
    source, the first two digits of its SHA-256, the hash. Returns (source, hash,
    uri, disposition) of all payloads, each once.

    A file is written under a name of its own and renamed, so that a reader sees
    all of it or none; of two writers of one payload both write the same."""
    body = F.col("body").cast("binary")
    rows = payloads.select("source", body.alias("body"), F.sha2(body, 256).alias("hash")).dropDuplicates(["source", "hash"])
    root = as_uri(folder).rstrip("/")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(root)
        for batch in batches:
            uris, found = [], []
            for source, content, name in zip(*[batch.column(k).to_pylist() for k in ("source", "body", "hash")], strict=True):
                place = f"{source}/{name[:2]}/{name}.{suffix}"
                there = system.get_file_info(f"{path}/{place}").type != fs.FileType.NotFound
                if not there:
                    system.create_dir(f"{path}/{source}/{name[:2]}", recursive=True)
                    part = f"{path}/{source}/{name[:2]}/_{uuid.uuid4().hex}"
                    with system.open_output_stream(part, compression=None) as out:
                        out.write(content)
                    system.move(part, f"{path}/{place}")
                uris.append(f"{root}/{place}")
                found.append("reused" if there else "created")
            yield pa.RecordBatch.from_arrays([batch.column("source"), batch.column("hash"), pa.array(uris, pa.string()), pa.array(found, pa.string())], names=["source", "hash", "uri", "disposition"])

    # written before it is read, so that a second reading does not find its own files
    return cut(rows.where("body is not null").mapInArrow(put, "source string, hash string, uri string, disposition string"), "payloads")


def read_payloads(uris: DataFrame) -> DataFrame:
    """``uris`` with the ``body`` of each stored payload; null where the file is
    not there or its content does not have the hash that it is named by, which
    ``available`` tells."""
    fields = uris.columns

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = []
            for uri in batch.column("uri").to_pylist():
                try:
                    system, path = fs.FileSystem.from_uri(uri)
                    with system.open_input_stream(path, compression=None) as f:
                        content = f.read()
                except (OSError, TypeError, pa.ArrowInvalid):
                    content = None
                name = uri.rsplit("/", 1)[-1].partition(".")[0] if uri else ""
                bodies.append(content if content is not None and hashlib.sha256(content).hexdigest() == name else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bodies, pa.binary())], names=[*fields, "body"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in uris.schema)
    return uris.mapInArrow(get, f"{schema}, body binary").withColumn("available", F.col("body").isNotNull())


def put_text(uri: str, text: str) -> None:
    """A small file."""
    system, path = fs.FileSystem.from_uri(as_uri(uri))
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path, compression=None) as out:
        out.write(text.encode())


def manifest_text(document: dict) -> tuple[str, str]:
    """Canonical JSON of a manifest and its SHA-256."""
    text = json.dumps(document, sort_keys=True, indent=2, ensure_ascii=False) + "\n"
    return text, hashlib.sha256(text.encode()).hexdigest()


def manifest_hash(document: Column) -> Column:
    """SHA-256 of the canonical JSON of manifests that come as JSON texts."""

    @F.pandas_udf("string")
    def told(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else manifest_text(json.loads(t))[1])

    return told(document)


#: Bytes of lines in an archive, or so.
ARCHIVE = 64 << 20


def write_archives(lines: DataFrame, folder: str, limit: int = ARCHIVE) -> int:
    """Writes ``lines (member, value)`` as tar.gz archives: each task fills its own
    one after another, with all members that it has lines of, in the order of
    its rows. An archive gets its name when it is complete, the same one in each
    attempt. The number of archives."""
    folder = as_uri(folder)
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(folder)
        held: dict[str, list[bytes]] = {}
        names, size = [], 0

        def close() -> None:
            packed = io.BytesIO()
            with tarfile.open(fileobj=packed, mode="w:gz") as tar:
                for member, own in held.items():
                    info = tarfile.TarInfo(member)
                    body = b"\n".join(own) + b"\n"
                    info.size = len(body)
                    tar.addfile(info, io.BytesIO(body))
            name = f"part-{TaskContext.get().partitionId():06d}-{len(names):06d}.tar.gz"
            temporary = f"{path}/_{name}.{uuid.uuid4().hex}"
            with system.open_output_stream(temporary, compression=None) as out:
                out.write(packed.getvalue())
            if system.get_file_info(f"{path}/{name}").type != fs.FileType.NotFound:
                system.delete_file(f"{path}/{name}")  # of an attempt that was lost
            system.move(temporary, f"{path}/{name}")
            names.append(name)
            held.clear()

        for batch in batches:
            for member, value in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                line = (value or "").encode()
                held.setdefault(member, []).append(line)
                size += len(line) + 1
                if size >= limit:
                    close()
                    size = 0
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["archive"])

    return lines.select("member", "value").mapInArrow(run, "archive string").count()


def title_manifest(entries: DataFrame, name: str, input_hash: str, **method: str) -> dict:
    """Numbered entries of a selection, which is as short as a person's list,
    with the hash of its input and how it was made."""
    rows = [r.asDict() for r in entries.orderBy("position").collect()]
    return {"schema": name, "input_sha256": input_hash, "count": len(rows), "entries": rows, **({"method": method} if method else {})}


def report_text(row: DataFrame) -> str:
    """A report of one row as JSON, dates and numbers as they print."""
    return json.dumps(row.first().asDict(recursive=True), sort_keys=True, indent=2, ensure_ascii=False, default=str)


def next_version(df: DataFrame, folder: str) -> str:
    """Writes a new version of a table beside those that may still be read."""
    path = f"{folder}/v-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def outcomes(rows: DataFrame, statuses: tuple[str, ...], status: str = "status") -> DataFrame:
    """The counters of a run: rows by status, all of them, and when it was
    counted."""
    return rows.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(status) == s).alias(s) for s in statuses]).withColumn("counted_at", F.current_timestamp())


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder of that name in the shared folder; it goes with the query."""
    return noted(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
