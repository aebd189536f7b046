"""From file events to an index: handlers for each batch, counters, a log of the last events, a sweep of old entries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarnforge.api import Engine
from tarnforge.operators import rules
from tarnforge.sources import storage
from tarnforge.sources.files import ignored
from tarnforge.streaming import events

Handler = Callable[[DataFrame, int], None]


def counted(found: DataFrame, rule_list: list[str] = ()) -> DataFrame:
    """``found`` without ignored paths; what came and what was left out is in the query's progress as ``file_events``."""
    out = ignored(F.col("path"), list(rule_list))
    marked = found.withColumn("_out", out)
    kinds = [F.count_if((F.col("type") == k) & ~F.col("_out")).alias(k) for k in ("add", "change", "unlink")]
    seen = marked.observe("file_events", F.count("*").alias("received"), F.count_if(F.col("_out")).alias("ignored"), *kinds)
    return seen.where(~F.col("_out")).drop("_out")


def counts(query: StreamingQuery) -> dict[str, int]:
    """The sums of a query's ``file_events`` counters over the batches that its progress still has."""
    total: dict[str, int] = {}
    for p in query.recentProgress:
        row = (p.get("observedMetrics") or {}).get("file_events")
        for k, v in (row or {}).items() if isinstance(row, dict) else (row.asDict().items() if row else ()):
            total[k] = total.get(k, 0) + (v or 0)
    return total


class Handlers:
    """Handlers by name, each called with every batch, in the order in which they were added.

    A batch counts as done when all have returned; if one fails the batch runs again for all of them, so each must give the same for a
    batch that it has seen.
    """

    def __init__(self):
        self._known: dict[str, Handler] = {}

    def add(self, name: str, handler: Handler) -> None:
        if name in self._known:
            raise ValueError(f"{name} is there already")
        self._known[name] = handler

    def remove(self, name: str) -> bool:
        return self._known.pop(name, None) is not None

    def names(self) -> list[str]:
        return list(self._known)

    def __call__(self, batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            batch.count()  # computed once, so that the counters see each event once, and with no handler too
            for handler in list(self._known.values()):
                handler(batch, number)
        finally:
            batch.unpersist()


def last_by_path(batch: DataFrame) -> DataFrame:
    """``path, type``: what happened last to each path of a batch."""
    return batch.groupBy("path").agg(F.max_by("type", F.struct("timestamp", "event_id")).alias("type"))


def to_index(engine: Engine, root: str, project: str | None = None, now: str = "1970-01-01 00:00:00", rule_list: list[str] = ()) -> Handler:
    """A handler that brings the engine's store up to date with the files below ``root`` that a batch names."""

    def handle(batch: DataFrame, number: int) -> None:
        last = last_by_path(batch)
        if not last.isEmpty():
            engine.apply(root, project or root, last.where("type <> 'unlink'").select("path"), last.where("type = 'unlink'").select("path"), now, list(rule_list))
            engine.log.info("stream.batch", batch=number)

    return handle


def chunk_events(batch: DataFrame, files: DataFrame, before: DataFrame, options: rules.Options = rules.Options()) -> DataFrame:
    """``path, id, event``: which chunks a batch of file events adds, changes or removes.

    ``files (path, language, content)`` are the files as they are now, ``before (file, id, code)`` the chunks as they were. A
    chunk is known by its id; its code decides whether it changed.
    """
    last = last_by_path(batch)
    now = rules.chunk_rows(files.join(last.where("type <> 'unlink'").select("path"), "path", "left_semi"), options)
    new = now.groupBy("id").agg(F.first("file").alias("n_file"), F.min("code").alias("n_code"))
    old = before.join(last.select(F.col("path").alias("file")), "file", "left_semi").groupBy("id").agg(F.first("file").alias("o_file"), F.min("code").alias("o_code"))
    event = F.when(F.col("o_file").isNull(), "added").when(F.col("n_file").isNull(), "removed").when(F.col("o_code") != F.col("n_code"), "changed")
    both = new.join(old, "id", "full").select(F.coalesce("n_file", "o_file").alias("path"), "id", event.alias("event"))
    return both.where("event is not null")


def to_ring(path: str, most: int = 1000) -> Handler:
    """A handler that keeps the last ``most`` events, by time and id, as the table ``ring`` below ``path``."""

    def handle(batch: DataFrame, number: int) -> None:
        tables = storage.Versioned(batch.sparkSession, path)
        at = tables.path("ring")
        rows = batch.select("event_id", "type", "path", "timestamp")
        if at:
            rows = rows.unionByName(batch.sparkSession.read.schema(events.EVENTS).parquet(at))
        tables.commit(ring=rows.dropDuplicates(["event_id"]).orderBy(F.desc("timestamp"), F.desc("event_id")).limit(most))

    return handle


def ring(spark: SparkSession, path: str) -> DataFrame:
    at = storage.Versioned(spark, path).path("ring")
    return spark.read.schema(events.EVENTS).parquet(at) if at else spark.createDataFrame([], events.EVENTS)


def swept(spark: SparkSession, path: str, now: str, table: str = "cache") -> int:
    """Take the expired entries out of the table ``table (expires_at, ...)`` below ``path``; returns how many."""
    tables = storage.Versioned(spark, path)
    at = tables.path(table)
    if at is None:
        return 0
    rows = spark.read.parquet(at)
    old = F.col("expires_at") < F.lit(now).cast("timestamp")
    n = rows.where(old).count()
    if n:
        tables.commit(**{table: rows.where(~F.coalesce(old, F.lit(False)))})
    return n


def every(spark: SparkSession, seconds: int, action: Callable[[int], None], checkpoint: str) -> StreamingQuery:
    """Call ``action(number)`` about every so many seconds until the query is stopped."""
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()
    writer = clock.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda _, number: action(number))
    return writer.trigger(processingTime=f"{seconds} seconds").start()


KINDS = ("add", "change", "unlink")


def to_counters(path: str, rule_list: list[str] = ()) -> Handler:
    """A handler that keeps what each batch received, ignored and has of each type as a row of its own: a batch that runs again replaces it."""

    def handle(batch: DataFrame, number: int) -> None:
        out = ignored(F.col("path"), list(rule_list))
        kinds = [F.count_if((F.col("type") == k) & ~out).alias(k) for k in KINDS]
        found = batch.agg(F.count("*").alias("received"), F.count_if(out).alias("ignored"), *kinds)
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return handle


def counters(spark: SparkSession, path: str) -> dict[str, int]:
    """The sums of all rows that ``to_counters`` has left below ``path``, over restarts too."""
    names = ("received", "ignored", *KINDS)
    if not storage.exists(spark, path):
        return {}
    rows = spark.read.schema(", ".join(f"`{n}` long" for n in names)).parquet(path)
    return rows.agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names)).first().asDict()


class Watcher:
    """A stream of file events and its handlers, with a beginning and an end.

    ``source`` is a folder of event files or a streaming DataFrame of events, such as ``folder.watch`` gives. Counters are a table beside the checkpoint, so they
    go on when the watcher is started again.
    """

    def __init__(self, spark: SparkSession, source: str | DataFrame, checkpoint: str, rule_list: list[str] = (), kind: str = "parquet"):
        self.handlers, self._query = Handlers(), None
        self._spark, self._source, self._checkpoint, self._rules, self._kind = spark, source, checkpoint, list(rule_list), kind
        self._counters = f"{checkpoint}-counters"

    @property
    def active(self) -> bool:
        return self._query is not None and self._query.isActive

    def start(self, available_now: bool = True, trigger: str = "2 seconds") -> StreamingQuery:
        if self.active:
            raise RuntimeError("the watcher runs already")
        stream = events.read(self._spark, self._source, kind=self._kind) if isinstance(self._source, str) else self._source
        count = to_counters(self._counters, self._rules)

        def each(batch: DataFrame, number: int) -> None:
            batch = batch.persist()
            try:
                count(batch, number)
                self.handlers(events.last_wins(events.accepted(batch, self._rules)), number)
            finally:
                batch.unpersist()

        writer = stream.writeStream.option("checkpointLocation", self._checkpoint).foreachBatch(each)
        self._query = (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=trigger)).start()
        return self._query

    def wait(self) -> None:
        if self._query:
            self._query.awaitTermination()

    def stop(self) -> None:
        if self._query:
            self._query.stop()

    def counts(self) -> dict[str, int]:
        return counters(self._spark, self._counters)

    def status(self) -> dict:
        return {"active": self.active, "handlers": self.handlers.names(), "counts": self.counts()}
