"""A topic without a broker: a stream source with offsets, and a sink that commits by epoch.

A topic is a folder. A writer puts each partition of a micro-batch into a file of JSON lines and names
the files in one commit, a small file called after the epoch that appears whole or not at all; what no commit
names is not there. An epoch that runs again finds its commit and adds nothing. A reader's offset is how many
commits of each writer it has read, so a restart neither loses nor repeats a message; a new reader starts after
the latest commit unless told to start at the earliest. Paths may lie on any file system pyarrow knows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceStreamReader,
    DataSourceStreamWriter,
    InputPartition,
    WriterCommitMessage,
)

FORMAT = "topic_log"
_COMMITS, _DATA = "commits", "data"


def _names(system: fs.FileSystem, folder: str) -> list[str]:
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.base_name for f in found if not f.base_name.startswith("."))


@dataclass
class _Topic:
    """Where things lie in a topic's folder."""

    path: str

    def open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def commits(self) -> dict[str, list[str]]:
        """Commit names in order, by writer."""
        system, root = self.open()
        return {w: _names(system, f"{root}/{_COMMITS}/{w}") for w in _names(system, f"{root}/{_COMMITS}")}

    def files(self, writer: str, commit: str) -> list[str]:
        system, root = self.open()
        with system.open_input_stream(f"{root}/{_COMMITS}/{writer}/{commit}") as file:
            return json.loads(file.read())


@dataclass
class _File(InputPartition):
    name: str


class TopicReader(DataSourceStreamReader):
    def __init__(self, topic: _Topic, earliest: bool):
        self.topic, self.earliest = topic, earliest

    def initialOffset(self) -> dict:
        return {} if self.earliest else self.latestOffset()

    def latestOffset(self) -> dict:
        return {writer: len(names) for writer, names in self.topic.commits().items()}

    def partitions(self, start: dict, end: dict) -> list[_File]:
        commits = self.topic.commits()
        return [
            _File(file) for writer in sorted(end) for commit in commits[writer][start.get(writer, 0) : end[writer]]
            for file in self.topic.files(writer, commit)
        ]

    def read(self, partition: _File) -> Iterator[tuple]:
        system, root = self.topic.open()
        with system.open_input_stream(f"{root}/{_DATA}/{partition.name}") as file:
            for line in file.read().splitlines():
                yield tuple(json.loads(line))

    def commit(self, end: dict) -> None:
        pass


@dataclass
class _Written(WriterCommitMessage):
    file: str | None


class TopicWriter(DataSourceStreamWriter):
    def __init__(self, topic: _Topic, writer: str):
        self.topic, self.writer = topic, writer

    def write(self, iterator: Iterator) -> _Written:
        system, root = self.topic.open()
        first = next(iterator, None)
        if first is None:
            return _Written(None)
        name = f"{uuid.uuid4().hex}.jsonl"
        system.create_dir(f"{root}/{_DATA}")
        with system.open_output_stream(f"{root}/{_DATA}/{name}") as file:
            file.write((json.dumps(list(first)) + "\n").encode())
            for row in iterator:
                file.write((json.dumps(list(row)) + "\n").encode())
        return _Written(name)

    def commit(self, messages: list[_Written | None], batchId: int) -> None:
        system, root = self.topic.open()
        folder, name = f"{root}/{_COMMITS}/{self.writer}", f"{int(batchId):020d}"
        system.create_dir(folder)
        if name in _names(system, folder):
            return
        hidden = f"{folder}/.{name}-{uuid.uuid4().hex}"
        with system.open_output_stream(hidden) as file:
            file.write(json.dumps(sorted(m.file for m in messages if m and m.file)).encode())
        system.move(hidden, f"{folder}/{name}")

    def abort(self, messages: list[_Written | None], batchId: int) -> None:
        """Files without a commit are never read."""


class TopicLog(DataSource):
    """Options: `path`; for reading `startingOffsets` (latest or earliest), for writing `writer`, a name of its own."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "key string, value string"

    def streamReader(self, schema) -> TopicReader:
        return TopicReader(_Topic(self.options["path"]), self.options.get("startingOffsets", "latest") == "earliest")

    def streamWriter(self, schema, overwrite: bool) -> TopicWriter:
        return TopicWriter(_Topic(self.options["path"]), self.options.get("writer", "writer"))


def topic_source(spark: SparkSession, path: str, starting: str = "latest") -> DataFrame:
    """(key, value) of a topic's messages as they are committed."""
    spark.dataSource.register(TopicLog)
    return spark.readStream.format(FORMAT).option("path", path).option("startingOffsets", starting).load()


def topic_sink(messages: DataFrame, path: str, writer: str = "writer"):
    """A writer of (key, value) messages to a topic; start it with a checkpoint location of its own."""
    messages.sparkSession.dataSource.register(TopicLog)
    return messages.selectExpr("CAST(key AS STRING) AS key", "CAST(value AS STRING) AS value").writeStream.format(
        FORMAT).option("path", path).option("writer", writer)
