"""WARC archives compressed with a Zstandard dictionary.

A dictionary is trained on a bounded sample of the payloads: the first PIECE
bytes of each of SAMPLE of them. It is embedded in a skippable frame that leads
each archive, and every record, whole whatever its size, is a Zstandard frame
of its own that uses it. Records are ``response``
with the whole payload, or, where an equal payload of at least LEAST bytes is
archived under a smaller id, ``revisit`` with a reference to it.

Each task writes the archives of its partition, one after another, under a
temporary name and renames them when they are complete; a task that runs again
writes the same archives. The folder lies in the shared folder or where the
caller says, on any file system that Arrow opens by URI. Archives hold ARCHIVE
bytes of payload or so; they are read back through Spark's binary file source.

Null and empty payloads are empty. Null URLs are archived as urn:page:<id>,
line breaks in URLs are escaped. Rows with a null id are responses that nothing
refers to. Rows of one id with different payloads are records of their own, each
a response or a revisit by its own payload; rows that repeat id and payload are
archived again, under a record id of their own: it comes of page (or URL),
digest and, for such rows, a number. A reference names the response of its digest."""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.shared import columns, cut, sample, shared_dir

LEAST, ARCHIVE = 100, 64 << 20
SAMPLE, PIECE, DICTIONARY, LEVEL = 2000, 4096, 112_640, 3
#: Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def record_id(page: int | None, url: str, digest: str, turn: int) -> str:
    """turn: 0, or what tells apart rows that repeat id and payload."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'urn:page:{page} {digest} {turn}' if page is not None else f'{url} {digest} {turn}')}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, first: int | None, turn: int) -> bytes:
    """One WARC/1.1 record; first: the id of the response that it revisits, of
    the same digest and turn 0."""
    url = (url or f"urn:page:{page}").replace("\r", "%0D").replace("\n", "%0A")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if first is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {record_id(page, url, digest, turn)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}"]
    if page is not None:
        lines.append(f"X-Page-Id: {page}")
    if first is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first, '', digest, 0)}", f"X-Refers-To-Page-Id: {first}"]
    lines += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def train(samples: list[bytes]) -> bytes:
    """A dictionary, or nothing where there is too little to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes() if len(samples) > 7 else b""
    except zstandard.ZstdError:
        return b""


def lead(dictionary: bytes) -> bytes:
    """The skippable frame with the dictionary, itself compressed."""
    held = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return struct.pack("<II", SKIPPABLE, len(held)) + held if dictionary else b""


def records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive."""
    at, context = 0, zstandard.ZstdDecompressor()
    if archive[:4] == struct.pack("<I", SKIPPABLE):
        (n,) = struct.unpack("<I", archive[4:8])
        at = 8 + n
        context = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(context.decompress(archive[8:at])))
    with io.BufferedReader(context.stream_reader(io.BytesIO(memoryview(archive)[at:]), read_across_frames=True), 1 << 20) as stream:
        while line := stream.readline():
            if line.strip() != b"WARC/1.1":
                raise ValueError(f"not a WARC record: {line[:40]!r}")
            headers = {}
            while (line := stream.readline().rstrip(b"\r\n")):
                name, _, value = line.decode().partition(": ")
                headers[name] = value
            block = stream.read(int(headers["Content-Length"]))
            if stream.read(4) != b"\r\n\r\n":
                raise ValueError("a record does not end where its length says")
            yield headers, block


def writer(folder: str, held, limit: int):
    """mapInArrow: (id, url, html, digest, first, turn) -> (archive, n, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = held.value
        context = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        system, path = fs.FileSystem.from_uri(folder)
        part, turn, out = TaskContext.get().partitionId(), 0, None
        told = {"archive": [], "n": [], "bytes": []}

        def close() -> None:
            nonlocal out, turn
            out.close()
            if system.get_file_info(f"{path}/{name}").type != fs.FileType.NotFound:
                system.delete_file(f"{path}/{name}")  # of an attempt that was lost
            system.move(f"{path}/{temporary}", f"{path}/{name}")
            for k, v in (("archive", name), ("n", n), ("bytes", size)):
                told[k].append(v)
            out, turn = None, turn + 1

        for batch in batches:
            for page, url, html, digest, first, of_row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if out is None:
                    name, n, size = f"part-{part:06d}-{turn:04d}.warc.zst", 0, 0
                    temporary = f"_{name}.{uuid.uuid4().hex}"
                    out = system.open_output_stream(f"{path}/{temporary}")
                    out.write(lead(dictionary))
                payload = html or b""
                out.write(context.compress(record(page, url, payload, digest, first, of_row)))
                n, size = n + 1, size + len(payload)
                if size >= limit:
                    close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(told["archive"], pa.string()), pa.array(told["n"], pa.int64()), pa.array(told["bytes"], pa.int64())], names=["archive", "n", "bytes"])

    return run


def write(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> str:
    """Writes the archives and gives their folder's URI."""
    spark = pages.sparkSession
    rows = columns(pages, id=id_col, url=url_col, html=payload_col).select(F.col("id").cast("long").alias("id"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    some = columns(pages, id=id_col, html=payload_col).where("id is not null").select("id", F.substring(F.col("html").cast("binary"), 1, PIECE).alias("html"))
    few = [bytes(r["html"]) for r in sample(some.where(F.length("html") > 0), "id", SAMPLE).collect()]  # SAMPLE pieces
    held = spark.sparkContext.broadcast(train(few))  # DICTIONARY bytes
    meta = rows.where("id is not null").where(F.length("html") >= LEAST).select("id", "digest")
    first = meta.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last").select("digest", "first")
    revisits = cut(meta.join(first, "digest").where("id <> first").distinct(), "revisits")
    several = cut(rows.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "several")
    rows = rows.withColumn("own", F.monotonically_increasing_id() + 1)
    lead = F.col("own")
    if not several.isEmpty():
        leads = rows.join(several, "id", "left_semi").groupBy("id", "digest").agg(F.min("own").alias("lead"))
        rows, lead = rows.join(leads, ["id", "digest"], "left"), F.coalesce("lead", "own")
    rows = rows.withColumn("turn", F.when(F.col("id").isNotNull() & (F.col("own") == lead), 0).otherwise(F.col("own")))
    # an id may come with several payloads, so that it takes both to tell
    put = rows.join(revisits, ["id", "digest"], "left").select("id", "url", "html", "digest", "first", "turn")
    # in the same order in every attempt, so that it fills the same archives
    put = put.sortWithinPartitions("id", "digest", "turn")
    cut(put.mapInArrow(writer(folder, held, ARCHIVE), "archive string, n long, bytes long"), "archives")
    return folder


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the archives: ``page_id``, ``url``, ``payload_bytes``,
    ``payload_digest``, ``record_type``, ``refers_to``, ``payload`` (null for
    revisits). A payload that does not have its digest is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for archive in batch.column(0):
                rows, size = [], 0
                for headers, block in records(archive.as_py()):
                    head, _, body = block.partition(b"\r\n\r\n")
                    kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha256:")
                    length = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
                    if kind == "response" and (len(body) != length or hashlib.sha256(body).hexdigest() != digest):
                        raise ValueError(f"{headers['WARC-Record-ID']}: the payload does not have its digest")
                    page, first = headers.get("X-Page-Id"), headers.get("X-Refers-To-Page-Id")
                    rows.append({"page_id": page and int(page), "url": headers["WARC-Target-URI"], "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": first and int(first), "payload": body if kind == "response" else None})
                    size += len(body)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content")
    return files.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
