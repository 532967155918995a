"""A paced client for remote query services, and a batch source over it.

The transport is a callable (query) -> (status, headers, body), so that tests
and recorded answers need no network."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Answer = tuple[int, dict, str]


class Unavailable(RuntimeError):
    pass


@dataclass(frozen=True)
class Reply:
    """What an answer means: done, or how long to wait before the next try, or
    why there is none."""

    done: bool = False
    wait: float | None = None
    fault: str = ""


def asked_to_wait(_: int, headers: dict) -> Reply:
    return Reply(wait=float(headers.get("Retry-After", 60)), fault="the service stays unavailable")


def overloaded(tries: int, _: dict) -> Reply:
    return Reply(wait=2.0**tries, fault="the service answers with a gateway error")


def denied(_: int, __: dict) -> Reply:
    return Reply(fault="the service denies the request")


#: Fixed meanings of status codes; any other ends the request.
REPLIES: dict[int, Callable[[int, dict], Reply]] = {
    200: lambda *_: Reply(done=True),
    401: denied,
    403: denied,
    429: asked_to_wait,
    502: overloaded,
    503: overloaded,
    504: overloaded,
}


@dataclass
class PacedClient:
    """At most one request an ``interval`` and ``attempts`` of them a query; an
    answer means what REPLIES says."""

    transport: Callable[[str], Answer]
    interval: float = 1.0
    attempts: int = 4
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic
    _next: float = field(default=float("-inf"), init=False)

    def paced(self, text: str) -> Answer:
        self.sleep(max(0.0, self._next - self.clock()))
        answer = self.transport(text)
        self._next = self.clock() + self.interval
        return answer

    def query(self, text: str) -> str:
        fault = "no attempt is allowed"
        for tries in range(self.attempts):
            status, headers, body = self.paced(text)
            reply = REPLIES.get(status, lambda *_: Reply(fault="the service does not answer"))(tries, headers)
            if reply.done:
                return body
            fault = f"{reply.fault} ({status})"
            if reply.wait is None:
                break
            if tries + 1 < self.attempts:
                self.sleep(reply.wait)
        raise Unavailable(fault)

    def bindings(self, text: str) -> list[dict]:
        return json.loads(self.query(text))["results"]["bindings"]


def pages(ids: list[str], size: int) -> Iterator[list[str]]:
    for a in range(0, len(ids), size):
        yield ids[a : a + size]


class RecordedSource(DataSource):
    """``spark.read.format("recorded_bindings").option("path", path)``: a file, or
    a folder of files, with one recorded answer a line; a row for each binding.
    A partition for each file."""

    @classmethod
    def name(cls) -> str:
        return "recorded_bindings"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return RecordedReader(self.options["path"])


@dataclass
class RecordedFile(InputPartition):
    path: str


class RecordedReader(DataSourceReader):
    def __init__(self, path: str):
        self.uri = path if "://" in path or path.startswith("file:") else f"file://{path}"

    def partitions(self) -> list[InputPartition]:
        system, path = fs.FileSystem.from_uri(self.uri)
        if system.get_file_info(path).type == fs.FileType.File:
            return [RecordedFile(path)]
        files = system.get_file_info(fs.FileSelector(path))
        return [RecordedFile(f.path) for f in files if f.is_file and not f.base_name.startswith(("_", "."))]

    def read(self, partition: RecordedFile) -> Iterator[tuple[str]]:
        system, _ = fs.FileSystem.from_uri(self.uri)
        with system.open_input_stream(partition.path) as f:
            for line in f.read().decode().splitlines():
                for b in json.loads(line)["results"]["bindings"]:
                    yield (json.dumps(b),)
