"""Python data sources for change feeds: batch and stream readers of paged chat changes, and a federated mail source.

`telegram_changes` reads pages of JSON lines {"cursor", "dialog_id", "message_id", "sender", "sent_at", "text", ...}: from a UNIX socket
(option socket_path: one JSON request and reply a line) or from a file (option path). Its offset is the number of the last change.
"""

from __future__ import annotations

import json
import socket
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "cursor long, dialog_id long, message_id long, sender string, sent_at string, text string, edit_date string, standalone_search boolean"
_NAMES = [c.strip().split(" ")[0] for c in SCHEMA.split(",")]


def ask(socket_path: str, request: dict, timeout: float = 30.0) -> dict:
    """One request to a provider's socket; an error reply raises."""
    with socket.socket(socket.AF_UNIX, socket.SOCK_STREAM) as s:
        s.settimeout(timeout)
        s.connect(socket_path)
        s.sendall(json.dumps(request).encode() + b"\n")
        reply = json.loads(s.makefile().readline())
    if reply.get("error"):
        raise RuntimeError(str(reply["error"]))
    return reply


def _page(options: dict, after: int, limit: int) -> list[dict]:
    if options.get("socket_path"):
        return ask(options["socket_path"], {"method": "export_changes", "cursor": f"offset:{after}", "limit": limit}).get("changes", [])
    rows = (json.loads(x) for x in Path(options["path"]).read_text().splitlines() if x.strip())
    return sorted((r for r in rows if r["cursor"] > after), key=lambda r: r["cursor"])[:limit]


def _tuples(rows: list[dict]) -> Iterator[tuple]:
    for r in rows:
        yield tuple(r.get(n, True if n == "standalone_search" else None) for n in _NAMES)


class _Batch(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]  # a cursor is followed by one reader

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        after, limit = int(self.options.get("after", 0)), int(self.options.get("limit", 1000))
        while page := _page(self.options, after, limit):
            yield from _tuples(page)
            after = page[-1]["cursor"]


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def initialOffset(self) -> dict:  # noqa: N802
        return {"after": int(self.options.get("after", 0))}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        page = _page(self.options, start["after"], int(self.options.get("limit", 1000)))
        return iter(list(_tuples(page))), {"after": page[-1]["cursor"] if page else start["after"]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        page = _page(self.options, start["after"], 1 << 30)
        return iter([*_tuples([r for r in page if r["cursor"] <= end["after"]])])


class TelegramChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "telegram_changes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Batch(dict(self.options))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: ANN001, N802
        return _Stream(dict(self.options))


class _Mail(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def read(self, partition) -> Iterator[tuple]:  # noqa: ANN001
        for i, m in enumerate(json.loads(x) for x in Path(self.options["path"]).read_text().splitlines() if x.strip()):
            head = {h["name"].lower(): h["value"] for h in (m.get("payload") or {}).get("headers", [])}
            yield m.get("id"), head.get("subject"), head.get("from"), head.get("date"), json.dumps(m.get("payload") or {}), i


class GmailMessages(DataSource):
    """Messages as the mail API gives them, from JSON lines (option path): federated only, ranked as delivered."""

    @classmethod
    def name(cls) -> str:
        return "gmail_messages"

    def schema(self) -> str:
        return "id string, subject string, sender string, date string, payload string, native_rank int"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Mail(dict(self.options))


def register(spark: SparkSession) -> None:
    for source in (TelegramChanges, GmailMessages):
        spark.dataSource.register(source)
