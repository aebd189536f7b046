"""The last event of a path once it has been left alone for a while by the clock, and learnt thresholds: state that a stream keeps for each key."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupStateTimeout

from tarnforge.functions import score
from tarnforge.streaming.events import EVENTS

#: The store of state that timers need.
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def timers(spark: SparkSession) -> Iterator[None]:
    """Streams that start in the block keep their state in a store that has timers; what the session had is put back after."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)


class _Settle(StatefulProcessor):
    """One event and one timer a path: each event puts the timer off."""

    def __init__(self, quiet: int, ttl: int):
        self.quiet, self.ttl = quiet, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "event_id long, type string, at long", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get() if self.last.exists() else None
        for b in rows:
            for r in b.itertuples():
                now = (int(r.event_id), r.type, r.timestamp.value // 1000)
                if last is None or (now[2], now[0]) >= (last[2], last[0]):
                    last = now
        self.last.update(tuple(last))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            event_id, kind, at = self.last.get()
            self.last.clear()
            yield pd.DataFrame({"event_id": [event_id], "type": [kind], "path": [key[0]], "timestamp": [pd.Timestamp(at, unit="us")]})

    def close(self) -> None:
        pass


def settled(events: DataFrame, quiet: float = 1.0, ttl: float = 86_400.0) -> DataFrame:
    """The last event of each path when ``quiet`` seconds by the clock have passed since it came; each event starts the wait anew.

    Waits are part of the stream's checkpoint, so one that stops and starts again keeps them. An event whose stream stood still for ``ttl`` seconds is
    forgotten. The query has to start in a block of ``timers``, with a trigger by time: a wait ends in a batch of its own.
    """
    processor = _Settle(int(quiet * 1000), int(ttl * 1000))
    # A stream that has started again runs no batch before something comes: a clock's ticks, of which no row is left, make sure that something does.
    clock = events.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load().where("value < 0")
    ticks = clock.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema))
    return events.unionByName(ticks).groupBy("path").transformWithStateInPandas(processor, EVENTS, "append", "ProcessingTime")


ROUNDS = "kind string, round long, n long, mean double, std double"
LEARNT = "kind string, round long, threshold double, multiplier double"
_STATE = "samples long, multiplier double, means array<double>, stds array<double>, thresholds array<double>"


def learnt(rounds: DataFrame, params: dict[str, score.Threshold] = score.THRESHOLDS) -> DataFrame:
    """``kind, round, threshold, multiplier`` of a stream of ``rounds``: each round's threshold, and the multiplier after it.

    A round is a search's distribution of scores for one kind of content. The state of a kind is its multiplier and its last 100 rounds; it is the
    stream's, so it outlives the session. Rounds of a kind count in their order within a batch, and by batch; a kind that ``params`` lacks is ``other``.
    """

    def fold(key, batches, state) -> Iterator[pd.DataFrame]:
        kind = key[0]
        at = score.AdaptiveThreshold(params.get(kind, params["other"]))
        if state.exists:
            at.samples, multiplier, *history = state.get
            at.multiplier = None if multiplier is None or multiplier != multiplier else multiplier
            at.history = list(zip(*history, strict=True))
        rows = pd.concat(list(batches)).sort_values("round")
        out = []
        for r in rows.itertuples():
            t = at.update(int(r.n), float(r.mean), float(r.std))
            out.append((kind, int(r.round), t, at.stats()["multiplier"]))
        state.update((at.samples, at.multiplier, *(list(map(float, x)) for x in zip(*at.history, strict=True))))
        yield pd.DataFrame(out, columns=["kind", "round", "threshold", "multiplier"])

    return rounds.groupBy("kind").applyInPandasWithState(fold, LEARNT, _STATE, "append", GroupStateTimeout.NoTimeout)
