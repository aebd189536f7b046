"""A structured log: events with a level and values, kept in order, read back by level, and cleared."""

from __future__ import annotations

import json
import threading
from collections import deque
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

#: Levels, the least urgent first (fixed values).
LEVELS = ("debug", "info", "warn", "error")
SCHEMA = "at timestamp, level string, event string, data string"


class Log:
    """The last ``most`` events from ``least`` on; each also goes to ``sink`` as one line of JSON, if there is one."""

    def __init__(self, most: int = 1000, least: str = "info", sink: Callable[[str], None] | None = None, clock: Callable[[], datetime] | None = None):
        self._kept: deque[dict] = deque(maxlen=most)
        self._least, self._sink = LEVELS.index(least), sink
        self._clock = clock or (lambda: datetime.now(UTC))
        self._lock = threading.Lock()

    def emit(self, level: str, event: str, **data) -> None:
        if LEVELS.index(level) < self._least:
            return
        entry = {"at": self._clock().replace(tzinfo=None), "level": level, "event": event, "data": data}
        with self._lock:
            self._kept.append(entry)
        if self._sink:
            self._sink(json.dumps(entry, default=str))

    def debug(self, event: str, **data) -> None:
        self.emit("debug", event, **data)

    def info(self, event: str, **data) -> None:
        self.emit("info", event, **data)

    def warn(self, event: str, **data) -> None:
        self.emit("warn", event, **data)

    def error(self, event: str, **data) -> None:
        self.emit("error", event, **data)

    def last(self, n: int = 100, level: str | None = None) -> list[dict]:
        """The last ``n`` events, of one level if given, oldest first."""
        with self._lock:
            found = [e for e in self._kept if level in (None, e["level"])]
        return found[-n:] if n > 0 else []

    def counts(self) -> dict[str, int]:
        with self._lock:
            return {x: sum(e["level"] == x for e in self._kept) for x in LEVELS}

    def clear(self) -> int:
        with self._lock:
            n = len(self._kept)
            self._kept.clear()
        return n

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(e["at"], e["level"], e["event"], json.dumps(e["data"], default=str)) for e in self.last(len(self._kept))], SCHEMA)
