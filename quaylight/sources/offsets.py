"""A stream of landed message files read by offset, as a Python data source.

Files land whole, in the order of their names, in a folder that driver and executors share.  The offset is the
name of the last file handed on, so a trigger only lists names; each file is read by one task, once, and a
restart from the checkpoint goes on after it.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "msg_id bigint, chat_id string, sent_at string, text string"


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def _names(self) -> list[str]:
        return sorted(f for f in os.listdir(self.path) if f.endswith(".jsonl"))

    def initialOffset(self) -> dict:
        return {"file": ""}

    def latestOffset(self) -> dict:
        return {"file": max(self._names(), default="")}

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        return [_Part(f"{self.path}/{f}") for f in self._names() if start["file"] < f <= end["file"]]

    def read(self, part: _Part) -> Iterator[tuple]:
        return _rows(part.path)

    def commit(self, end: dict) -> None:
        """Files stay; what was handed on is known by the checkpoint alone."""


def _rows(path: str) -> Iterator[tuple]:
    with open(path, encoding="utf-8") as f:
        for line in f:
            try:
                x = json.loads(line)
                yield int(x["msg_id"]), str(x.get("chat_id")), x.get("sent_at"), x.get("text")
            except (ValueError, KeyError, TypeError):
                continue


class MessageFiles(DataSource):
    """``spark.readStream.format("message_files").option("path", folder)``."""

    @classmethod
    def name(cls) -> str:
        return "message_files"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> _Reader:
        return _Reader(self.options["path"])
