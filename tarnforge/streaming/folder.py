"""A folder as a stream of file events, by the data source API.

An offset is a snapshot of the folder: each file's size and time of change. What differs between two snapshots are the events of a batch, so a batch that
runs again has the same events, and a stream that stops goes on from the last snapshot that it has committed, with whatever changed meanwhile.
The folder is listed where the stream's driver runs, so it has to be there; an offset has one entry a file, as a watcher's memory has.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tarnforge.streaming.events import EVENTS

#: Events that one task makes, at most.
PART_EVENTS = 10_000


def snapshot(root: str, settle: float = 0.0, before: dict[str, list[int]] | None = None) -> dict[str, list[int]]:
    """``path: [size, nanoseconds of the last change]`` of all files below ``root``; links are not followed.

    A file that changed less than ``settle`` seconds ago is still being written: it stays as ``before`` has it.
    """
    found: dict[str, list[int]] = {}
    young = time.time_ns() - int(settle * 1e9)
    todo = [root]
    while todo:
        at = todo.pop()
        try:
            entries = list(os.scandir(at))
        except FileNotFoundError:  # gone since it was listed
            continue
        for e in entries:
            if e.is_symlink():
                continue
            if e.is_dir():
                todo.append(e.path)
                continue
            try:
                s = e.stat()
            except FileNotFoundError:
                continue
            path = os.path.relpath(e.path, root)
            if settle and s.st_mtime_ns > young:
                if before and path in before:
                    found[path] = before[path]
                continue
            found[path] = [s.st_size, s.st_mtime_ns]
    return dict(sorted(found.items()))


def differences(before: dict[str, list[int]], after: dict[str, list[int]], at: int) -> list[tuple[str, str, int]]:
    """``type, path, nanoseconds`` by path: files added, changed, and unlinked; the last at the snapshot's own time ``at``."""
    out = [("add" if p not in before else "change", p, x[1]) for p, x in after.items() if before.get(p) != x]
    out += [("unlink", p, at) for p in before if p not in after]
    return sorted(out, key=lambda e: e[1])


class _Part(InputPartition):
    def __init__(self, first: int, found: list[tuple[str, str, int]]):
        self.first, self.found = first, found


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.settle = float(options.get("settle", 0))
        self.existing = options.get("existing", "false").lower() == "true"
        self._last: dict | None = None

    def _now(self, files: dict[str, list[int]]) -> dict:
        """The offset of a snapshot; the one before, if nothing has changed."""
        if self._last is None or self._last["files"] != files:
            self._last = {"at": time.time_ns() // 1_000_000, "files": files}
        return self._last

    def initialOffset(self) -> dict:
        """The folder as it is, so that files that are there already are no events; nothing, if they are to be."""
        return {"at": 0, "files": {}} if self.existing else self._now(snapshot(self.root))

    def latestOffset(self) -> dict:
        return self._now(snapshot(self.root, self.settle, self._last and self._last["files"]))

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        found = differences(start["files"], end["files"], end["at"] * 1_000_000)
        return [_Part(end["at"] * 1_000_000 + i, found[i : i + PART_EVENTS]) for i in range(0, len(found), PART_EVENTS)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        kinds, paths, times = zip(*partition.found, strict=True)
        ids = range(partition.first, partition.first + len(paths))
        stamps = [datetime.fromtimestamp(t / 1e9, timezone.utc) for t in times]
        columns = [pa.array(ids, pa.int64()), pa.array(kinds), pa.array(paths), pa.array(stamps, pa.timestamp("us", "UTC"))]
        yield pa.RecordBatch.from_arrays(columns, ["event_id", "type", "path", "timestamp"])


class FolderEvents(DataSource):
    """Options: ``path``, the folder; ``settle``, seconds that a file must be left alone; ``existing``, whether files that are there at the start are added."""

    @classmethod
    def name(cls) -> str:
        return "folder_events"

    def schema(self) -> str:
        return EVENTS

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options)


def watch(spark: SparkSession, root: str, settle: float = 0.0, existing: bool = False) -> DataFrame:
    """File events of the folder ``root`` and all below it, with paths relative to it; ids grow with time."""
    spark.dataSource.register(FolderEvents)
    return spark.readStream.format("folder_events").option("settle", settle).option("existing", str(existing).lower()).load(root)
