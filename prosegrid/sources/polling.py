"""A Python Data Source for paged services: batch and stream readers over an injected transport.

Register a transport under a name: a function from (request, page token) to (records, next token),
records newest first, each a dict with ``id``, ``ts`` (epoch seconds) and anything else, which
becomes the JSON column ``body``. One request is one partition (a country, a mailbox, a query).
Reading of a request stops at the first record that is not newer than its cursor or, in a batch, at
``max_count``. The stream reader's offset is the time of the newest record of each request; a
micro-batch reads all records between two offsets, on the executors, so none is skipped.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

Transport = Callable[[dict, str | None], tuple[list[dict], str | None]]
TRANSPORTS: dict[str, Transport] = {}
SCHEMA = "key string, id string, ts timestamp, body string"


def register_transport(name: str, transport: Transport) -> None:
    TRANSPORTS[name] = transport


def tolerant(transport: Transport, errors: tuple[type[Exception], ...] = (RuntimeError,)) -> Transport:
    """A transport whose failures are logged and read as an empty page; the cursor stays where it was."""

    def read(request: dict, token: str | None) -> tuple[list[dict], str | None]:
        try:
            return transport(request, token)
        except errors:
            logging.getLogger(__name__).exception("no records for %s", request.get("key"))
            return [], None

    return read


def pages(transport: Transport, request: dict, since: float, max_count: int | None) -> Iterator[dict]:
    """Records of one request that are newer than ``since``, newest first."""
    token, count = None, 0
    while True:
        records, token = transport(request, token)
        for record in records:
            if record["ts"] <= since or (max_count is not None and count >= max_count):
                return
            count += 1
            yield record
        if not token:
            return


def _row(request: dict, record: dict) -> tuple:
    from datetime import datetime, timezone

    body = {k: v for k, v in record.items() if k not in ("id", "ts")}
    return request["key"], str(record["id"]), datetime.fromtimestamp(record["ts"], timezone.utc), json.dumps(body, ensure_ascii=False)


class Request(InputPartition):
    def __init__(self, request: dict):
        super().__init__(request)


class _Options:
    def __init__(self, options: dict, transports: dict[str, Transport]):
        self.requests: list[dict] = json.loads(options["requests"])
        self.transport = transports[options["transport"]]
        self.since = {r["key"]: float(r.get("since", options.get("since", 0))) for r in self.requests}
        self.max_count = int(options["maxCount"]) if "maxCount" in options else None


class PolledReader(DataSourceReader):
    def __init__(self, options: _Options):
        self.options = options

    def partitions(self) -> list[Request]:
        return [Request(r) for r in self.options.requests]

    def read(self, partition: Request) -> Iterator[tuple]:
        request = partition.value
        for record in pages(self.options.transport, request, self.options.since[request["key"]], self.options.max_count):
            yield _row(request, record)


class PolledStream(DataSourceStreamReader):
    def __init__(self, options: _Options):
        self.options = options
        self.newest = dict(options.since)

    def initialOffset(self) -> dict:
        return {"since": self.options.since}

    def latestOffset(self) -> dict:
        """The time of the first record of each request, which is its newest; it never goes back."""
        for request in self.options.requests:
            key = request["key"]
            for record in pages(self.options.transport, request, self.newest[key], 1):
                self.newest[key] = record["ts"]
        return {"since": dict(self.newest)}

    def partitions(self, start: dict, end: dict) -> list[Request]:
        spans = [{"request": r, "since": start["since"].get(r["key"], 0), "upto": end["since"].get(r["key"], 0)} for r in self.options.requests]
        return [Request(x) for x in spans if x["since"] < x["upto"]]

    def read(self, partition: Request) -> Iterator[tuple]:
        span = partition.value
        for record in pages(self.options.transport, span["request"], span["since"], None):
            if record["ts"] <= span["upto"]:
                yield _row(span["request"], record)

    def commit(self, end: dict) -> None:
        """Nothing to do: offsets are kept by the stream's checkpoint."""


def data_source(transports: dict[str, Transport] | None = None) -> type[DataSource]:
    """The source class to register with ``spark.dataSource.register``; it carries its transports along."""
    held = dict(transports if transports is not None else TRANSPORTS)

    class Polled(DataSource):
        @classmethod
        def name(cls) -> str:
            return "polled"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema: StructType) -> DataSourceReader:
            return PolledReader(_Options(self.options, held))

        def streamReader(self, schema: StructType) -> DataSourceStreamReader:
            return PolledStream(_Options(self.options, held))

    return Polled
