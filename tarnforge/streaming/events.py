"""File events as a stream: ignore rules, last event of each path wins, idempotent index updates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarnforge.sources.files import ignored

EVENTS = "event_id long, type string, path string, timestamp timestamp"


def read(spark: SparkSession, path: str, schema: str = EVENTS, kind: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    """Events from files that appear below ``path``, a bounded number a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(kind).load(path)


def accepted(events: DataFrame, rules: list[str] = ()) -> DataFrame:
    return events.where(~ignored(F.col("path"), list(rules)))


def last_wins(events: DataFrame) -> DataFrame:
    """One event for each type and path: the latest, of equal times the one with the greater id."""
    by = F.struct("timestamp", "event_id")
    return events.groupBy("type", "path").agg(F.max("timestamp").alias("timestamp"), F.max_by("event_id", by).alias("event_id"))


def each_batch(events: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True, every: str = "2 seconds") -> StreamingQuery:
    """Run ``handler(batch, batch id)`` on each micro-batch's last events; the trigger is the debounce."""
    writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: handler(last_wins(df), i))
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def to_table(out: str) -> Callable[[DataFrame, int], None]:
    """A handler that keeps each batch's rows in a folder of its own: a batch that is run again replaces its rows."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return write


def counted(events: DataFrame, late: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """An extension: events by tumbling window and type, late ones within the watermark."""
    return events.withWatermark("timestamp", late).groupBy(F.window("timestamp", window), "type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "type", "n")


def debounced(events: DataFrame, quiet: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """The last event of each path once ``quiet`` time has passed since it, by event time; each new event starts the wait anew.

    State is one event a path and goes when it is emitted.
    """
    import pandas as pd

    wait = int(pd.Timedelta(quiet).total_seconds() * 1000)

    def settle(key, batches, state):
        if state.hasTimedOut:
            event_id, kind, at = state.get
            state.remove()
            yield pd.DataFrame({"event_id": [event_id], "type": [kind], "path": [key[0]], "timestamp": [pd.Timestamp(at, unit="us")]})
            return
        last = state.get if state.exists else None
        for b in batches:
            for r in b.itertuples():
                now = (int(r.event_id), r.type, int(r.timestamp.value // 1000))
                if last is None or (now[2], now[0]) >= (last[2], last[0]):
                    last = now
        state.update(last)
        state.setTimeoutTimestamp(max(last[2] // 1000 + wait, state.getCurrentWatermarkMs() + 1))

    keyed = events.withWatermark("timestamp", late).groupBy("path")
    return keyed.applyInPandasWithState(settle, EVENTS, "event_id long, type string, at long", "append", "EventTimeTimeout")
