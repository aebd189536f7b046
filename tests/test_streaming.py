import datetime
import time

import pytest
from pyspark.sql import functions as F

from tarnforge.api import Engine
from tarnforge.functions import score
from tarnforge.sources import storage
from tarnforge.streaming import events, folder, indexing, settle

T = datetime.datetime(2024, 1, 1)


def rows(n, start=0):
    return [(start + i, ("add", "change")[i % 2], f"src/{i % 5}.{'log' if i % 5 == 4 else 'ts'}", T + datetime.timedelta(minutes=start + i)) for i in range(n)]


def test_batches_replace_and_last_wins(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    spark.createDataFrame(rows(20), events.EVENTS).write.parquet(src)
    run = lambda: events.each_batch(events.accepted(events.read(spark, src)), events.to_table(out), mark).awaitTermination()
    run()
    first = spark.read.parquet(out).count()
    run()  # nothing new
    assert spark.read.parquet(out).count() == first
    spark.createDataFrame(rows(10, 100), events.EVENTS).write.mode("append").parquet(src)
    run()
    last = {(r.type, r.path): r.event_id for r in events.last_wins(spark.read.parquet(out)).collect()}
    assert last == {(t, p): max(i for i, a, b, _ in rows(10, 100) if (a, b) == (t, p)) for _, t, p, _ in rows(10, 100) if not p.endswith(".log")}
    events.to_table(out)(spark.createDataFrame(rows(1), events.EVENTS), 0)  # a batch that runs again
    assert spark.read.parquet(out).where("batch = 0").count() == 1


def test_windows(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame(rows(120), events.EVENTS).write.parquet(src)
    q = events.counted(events.read(spark, src)).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counted").agg(F.sum("n")).first()[0] == 120


def test_debounced(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    at = lambda s: T + datetime.timedelta(seconds=s)

    def run(batch):
        spark.createDataFrame(batch, events.EVENTS).coalesce(1).write.mode("append").parquet(src)
        settled = events.debounced(events.read(spark, src))
        settled.writeStream.option("checkpointLocation", mark).format("parquet").option("path", out).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.event_id, r.type, r.path) for r in spark.read.parquet(out).collect())

    assert run([(1, "add", "a", at(0)), (2, "change", "a", at(1)), (3, "add", "b", at(0))]) == []
    assert (2, "change", "a") not in run([(4, "change", "a", at(2))])
    run([(5, "add", "c", at(60))])
    assert run([(6, "add", "d", at(61))])[:2] == [(3, "add", "b"), (4, "change", "a")]


def test_watcher_counts_and_handlers(spark, tmp_path):
    src, mark = str(tmp_path / "src"), str(tmp_path / "mark")
    spark.createDataFrame(rows(20), events.EVENTS).write.parquet(src)
    seen = []
    w = indexing.Watcher(spark, src, mark)
    w.handlers.add("one", lambda df, i: seen.append(("one", df.count())))
    w.handlers.add("two", lambda df, i: seen.append(("two", df.count())))
    w.handlers.add("three", lambda df, i: seen.append(("three", 0)))
    assert w.handlers.remove("three") and not w.handlers.remove("three") and w.handlers.names() == ["one", "two"]
    with pytest.raises(ValueError):
        w.handlers.add("one", print)
    w.start()
    w.wait()
    assert w.counts() == {"received": 20, "ignored": 4, "add": 8, "change": 8, "unlink": 0} and not w.active
    assert [n for n, _ in seen] == ["one", "two"] and len({k for _, k in seen}) == 1
    w.stop()
    assert w.status()["handlers"] == ["one", "two"]


def test_stream_to_index(spark, tmp_path):
    root, src, mark = tmp_path / "root", str(tmp_path / "src"), str(tmp_path / "mark")
    root.mkdir()
    for n in ("a.md", "b.md", "c.log"):
        (root / n).write_text(f"# {n}\n\nSome words of this file.\n")
    engine = Engine(spark, str(tmp_path / "store"))
    w = indexing.Watcher(spark, src, mark)
    w.handlers.add("index", indexing.to_index(engine, str(root), "p"))

    def send(*batch):
        found = [(i, k, p, T + datetime.timedelta(seconds=i)) for i, k, p in batch]
        spark.createDataFrame(found, events.EVENTS).write.mode("append").parquet(src)
        w.start()
        w.wait()
        return {r.file_path: r.content for r in engine.store().collect()}

    assert set(send((1, "add", "a.md"), (2, "add", "b.md"), (3, "add", "c.log"))) == {"a.md", "b.md"}
    (root / "a.md").write_text("# changed\n\nOther words now.\n")
    (root / "b.md").unlink()
    found = send((4, "change", "a.md"), (5, "change", "b.md"), (6, "unlink", "b.md"), (7, "add", "gone.md"))
    assert set(found) == {"a.md"} and found["a.md"].startswith("# changed")
    assert engine.update(str(root), "p") == {"added": 0, "modified": 0, "deleted": 0, "unchanged": 1}
    handler = indexing.to_index(engine, str(root), "p")
    for _ in range(2):  # a batch that runs again
        handler(spark.createDataFrame([(8, "change", "a.md", T)], events.EVENTS), 9)
        assert {r.file_path: r.content for r in engine.store().collect()} == found


def test_ring_and_sweep(spark, tmp_path):
    at = str(tmp_path / "ring")
    keep = indexing.to_ring(at, 5)
    assert indexing.ring(spark, at).count() == 0
    for i in (0, 1, 1):
        keep(spark.createDataFrame(rows(4, 4 * i), events.EVENTS), i)
    assert sorted(r.event_id for r in indexing.ring(spark, at).collect()) == [3, 4, 5, 6, 7]
    cache = spark.createDataFrame([("a", T), ("b", T + datetime.timedelta(days=1)), ("c", None)], "key string, expires_at timestamp")
    assert indexing.swept(spark, at, "2024-01-01 12:00:00") == 0
    storage.Versioned(spark, at).commit(cache=cache)
    assert indexing.swept(spark, at, "2024-01-01 12:00:00") == 1 and indexing.swept(spark, at, "2024-01-01 12:00:00") == 0
    assert sorted(r.key for r in spark.read.parquet(storage.Versioned(spark, at).path("cache")).collect()) == ["b", "c"]


def test_every(spark, tmp_path):
    seen = []
    q = indexing.every(spark, 1, seen.append, str(tmp_path / "mark"))
    for _ in range(100):
        if len(seen) >= 2:
            break
        time.sleep(0.2)
    q.stop()
    assert len(seen) >= 2


def test_counters_over_restarts(spark, tmp_path):
    src, mark = str(tmp_path / "src"), str(tmp_path / "mark")
    for start in (0, 100):
        spark.createDataFrame(rows(20, start), events.EVENTS).write.mode("append").parquet(src)
        w = indexing.Watcher(spark, src, mark)
        w.start()
        w.wait()
    assert w.counts() == {"received": 40, "ignored": 8, "add": 16, "change": 16, "unlink": 0}
    indexing.to_counters(f"{mark}-counters", [])(spark.createDataFrame(rows(20), events.EVENTS), 0)  # a batch that runs again, under other rules
    assert w.counts()["received"] == 40 and w.counts()["ignored"] < 8 + 8


def wait_for(what, seconds=60):
    until = time.monotonic() + seconds
    while time.monotonic() < until:
        if found := what():
            return found
        time.sleep(0.2)
    raise AssertionError("it did not come")


def test_settled_by_the_clock(spark, tmp_path):
    """A path comes out once it has been left alone; the waits are kept when the stream stops."""
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))

    def send(*batch):
        spark.createDataFrame(batch, events.EVENTS).coalesce(1).write.mode("append").parquet(src)

    def start(quiet):
        with settle.timers(spark):
            found = settle.settled(events.read(spark, src), quiet)
            return found.writeStream.option("checkpointLocation", mark).format("parquet").option("path", out).trigger(processingTime="300 milliseconds").start()

    def settled():
        rows = spark.read.schema(events.EVENTS).parquet(out).collect() if storage.exists(spark, out) else []
        return sorted((r.event_id, r.type, r.path) for r in rows)

    send((1, "add", "a", T), (2, "change", "a", T + datetime.timedelta(seconds=1)), (3, "add", "b", T))
    q = start(15)
    came = lambda: sum(x["numInputRows"] for p in q.recentProgress for x in p["sources"] if "FileStreamSource" in x["description"])
    wait_for(lambda: came() >= 3)
    assert settled() == []
    send((4, "unlink", "a", T + datetime.timedelta(seconds=2)))
    wait_for(lambda: came() >= 4)
    q.stop()
    assert settled() == []
    q = start(15)  # no event comes any more: what is left are the timers
    wait_for(lambda: len(settled()) >= 2)
    q.stop()
    assert settled() == [(3, "add", "b"), (4, "unlink", "a")]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert not spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("RocksDBStateStoreProvider")


def test_folder_between_runs(spark, tmp_path):
    """Each run gives what has changed since the one before, once."""
    root, out, mark = tmp_path / "root", str(tmp_path / "out"), str(tmp_path / "mark")
    (root / "sub").mkdir(parents=True)
    (root / "old.txt").write_text("there before")
    seen = set()

    def run():
        q = folder.watch(spark, str(root)).writeStream.option("checkpointLocation", mark).foreachBatch(events.to_table(out)).trigger(availableNow=True).start()
        q.awaitTermination()
        found = {(r.event_id, r.type, r.path) for r in spark.read.parquet(out).collect()} if storage.exists(spark, out) else set()
        new = sorted(found - seen)
        seen.update(found)
        return [(kind, path) for _, kind, path in new]

    assert run() == []
    (root / "a.txt").write_text("one")
    (root / "sub" / "b.txt").write_text("two")
    (root / "link").symlink_to(root / "a.txt")
    assert run() == [("add", "a.txt"), ("add", "sub/b.txt")]
    (root / "a.txt").write_text("other")
    (root / "old.txt").unlink()
    assert run() == [("change", "a.txt"), ("unlink", "old.txt")]
    assert run() == []


def test_folder_into_an_index(spark, tmp_path):
    """A watched folder keeps a store up to date, with counters."""
    root, mark = tmp_path / "root", str(tmp_path / "mark")
    root.mkdir()
    (root / "a.md").write_text("# a\n\nSome words of this file.\n")
    engine = Engine(spark, str(tmp_path / "store"))

    def run():
        w = indexing.Watcher(spark, folder.watch(spark, str(root), existing=True), mark, ["*.log"])
        w.handlers.add("index", indexing.to_index(engine, str(root), "p"))
        w.start()
        w.wait()
        return w.counts(), {r.file_path for r in engine.store().collect()}

    assert run() == ({"received": 1, "ignored": 0, "add": 1, "change": 0, "unlink": 0}, {"a.md"})
    (root / "b.md").write_text("# b\n\nOther words of this one.\n")
    (root / "c.log").write_text("left out by the rules")
    (root / "a.md").unlink()
    assert run() == ({"received": 4, "ignored": 1, "add": 2, "change": 0, "unlink": 1}, {"b.md"})


def test_snapshots(tmp_path):
    (tmp_path / "a").write_text("x")
    one = folder.snapshot(str(tmp_path))
    assert list(one) == ["a"] and folder.snapshot(str(tmp_path), settle=60) == {} and folder.snapshot(str(tmp_path), 60, one) == one
    (tmp_path / "b").write_text("y")
    two = folder.snapshot(str(tmp_path))
    assert folder.differences(one, two, 7) == [("add", "b", two["b"][1])] and folder.differences(two, one, 7) == [("unlink", "b", 7)]
    assert folder.differences(one, {"a": [2, 3]}, 7) == [("change", "a", 3)] and folder.snapshot(str(tmp_path / "none")) == {}


def test_learnt_as_by_hand(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    found = [(kind, i, 3 + i % 9, 0.4 + 0.01 * (i % 5), 0.1 + 0.002 * (i % 3)) for kind in ("code", "odd") for i in range(130)]
    for part in (found[:50] + found[130:140], found[50:130] + found[140:]):
        spark.createDataFrame(part, settle.ROUNDS).repartition(3).write.mode("append").parquet(src)
        q = settle.learnt(spark.readStream.schema(settle.ROUNDS).parquet(src)).writeStream.option("checkpointLocation", mark)
        q.format("parquet").option("path", out).trigger(availableNow=True).start().awaitTermination()
    got = {(r.kind, r["round"]): (r.threshold, r.multiplier) for r in spark.read.schema(settle.LEARNT).parquet(out).collect()}
    for kind, params in (("code", "code"), ("odd", "other")):
        at = score.AdaptiveThreshold(score.THRESHOLDS[params])
        for k, i, n, mean, std in found:
            if k == kind:
                want = at.update(n, mean, std)
                assert got[kind, i] == pytest.approx((want, at.stats()["multiplier"]))
        assert at.multiplier is not None
