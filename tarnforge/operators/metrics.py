"""Metric points, their statistics and exports."""

from __future__ import annotations

import math
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LEVELS = {"debug": 0, "info": 1, "warn": 2, "error": 3}
#: Groups whose sums a task holds at once.
TOGETHER = 50_000


def rate(part: Column, whole: Column) -> Column:
    """``part / whole``, 0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def points(metrics: DataFrame, kind: str | None = None, since: str | None = None, last: int | None = None) -> DataFrame:
    """Metric points of a type, from a time on, the newest ones."""
    if kind is not None:
        metrics = metrics.where(F.col("type") == kind)
    if since is not None:
        metrics = metrics.where(F.col("timestamp") >= F.lit(since).cast("timestamp"))
    return metrics if last is None else metrics.orderBy(F.desc("timestamp"), F.desc("metric_id")).limit(last)


def log_entries(logs: DataFrame, least: str = "debug", source: str | None = None, since: str | None = None, last: int | None = None) -> DataFrame:
    """Log entries of at least a level."""
    rank = reduce(lambda c, kv: c.when(F.col("level") == kv[0], kv[1]), LEVELS.items(), F)
    logs = logs.where(rank >= LEVELS[least])
    if source is not None:
        logs = logs.where(F.col("source") == source)
    if since is not None:
        logs = logs.where(F.col("timestamp") >= F.lit(since).cast("timestamp"))
    return logs if last is None else logs.orderBy(F.desc("timestamp"), F.desc("log_id")).limit(last)


def quality(scores: DataFrame, *by: str) -> DataFrame:
    """Number, mean, median, least and greatest of ``score``."""
    return scores.groupBy(*by).agg(F.count("score").alias("n"), F.avg("score").alias("mean"), F.percentile("score", 0.5).alias("median"), F.min("score").alias("least"), F.max("score").alias("greatest"))


def histogram(scores: DataFrame, buckets: int = 10, inclusive: bool = False) -> DataFrame:
    """``bucket, midpoint, n`` over min(``buckets``, rows) equal parts of the range.

    Parts are half open, so the greatest score itself falls out unless ``inclusive``. Without a range nothing is counted.
    """
    span = scores.agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.least(F.lit(buckets), F.count("score")).cast("int").alias("k"))
    parts = span.where("k > 0").select("lo", "hi", "k", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("bucket"))
    width = (F.col("hi") - F.col("lo")) / F.col("k")
    grid = parts.select("bucket", (F.col("lo") + (F.col("bucket") + 0.5) * width).alias("midpoint"))
    at = F.floor(F.try_divide(F.col("score") - F.col("lo"), width)).cast("int")
    placed = scores.join(F.broadcast(span)).select(F.when((F.col("score") == F.col("hi")) & F.lit(inclusive), F.col("k") - 1).when(F.col("score") < F.col("hi"), at).alias("bucket"))
    counted = placed.where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))
    return grid.join(counted, "bucket", "left").select("bucket", "midpoint", F.coalesce("n", F.lit(0)).alias("n"))


def indexing_rates(runs: DataFrame) -> DataFrame:
    """By run: success in per cent, files and chunks a second."""
    return runs.select("run_id", (100 * rate(F.col("indexed"), F.col("files"))).alias("success_percent"), rate(F.col("files"), F.col("seconds")).alias("files_per_second"), rate(F.col("chunks"), F.col("seconds")).alias("chunks_per_second"))


def cache_stats(events: DataFrame) -> DataFrame:
    """Hits, misses and their ratio from a log of cache events ``(kind)``."""
    n = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, 1).otherwise(0)), F.lit(0)).cast("long")
    return events.agg(n("hit").alias("hits"), n("miss").alias("misses"), rate(n("hit"), n("hit") + n("miss")).alias("hit_ratio"))


def as_json(points: DataFrame, path: str) -> None:
    points.write.mode("overwrite").json(path)


def as_csv(points: DataFrame, path: str) -> None:
    """CSV with every field quoted and quotes doubled."""
    points.write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def recorded(records: DataFrame, kind: str, values: dict[str, str], *kept: str) -> DataFrame:
    """Metric points of wide records: a row for each of ``values`` (column by unit), beside ``kept`` columns."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value"), F.lit(u).alias("unit")) for c, u in values.items())))
    return records.select(*kept, F.lit(kind).alias("type"), each.alias("m")).select(*kept, "type", "m.*")


def enrichment(runs: DataFrame) -> DataFrame:
    """By model: calls, success in per cent and mean time, of ``runs (model, success, ms)``; each call counts once."""
    return runs.groupBy("model").agg(F.count("*").alias("processed"), (100 * F.avg(F.when(F.col("success"), 1.0).otherwise(0.0))).alias("success_percent"), F.avg(F.col("ms").cast("double")).alias("avg_ms"))


def means(rows: DataFrame, by: str, value: str) -> DataFrame:
    """``by, mean, exact, n``: the mean of ``value`` as ``avg`` has it, the double next to the true mean, and the number of rows, of each ``by``.

    The last digits of ``avg`` follow the order in which rows are added; ``exact`` is the same in any order, and if all rows are repeated. A task adds
    up as whole numbers and a power of two, at most ``TOGETHER`` of ``by`` at a time. Nulls count as rows alone; of infinities and NaN both means are ``avg``.
    """
    together, names = TOGETHER, ["by", "total", "digits", "places", "odd", "valued", "n"]
    kind = rows.schema[by].dataType.simpleString()

    def add(batches):
        held: dict = {}

        def told(of):
            out: dict[str, list] = {n: [] for n in names}
            for key, (total, exact, places, odd, valued, n) in held.items():
                for name, x in zip(names, (key, total, f"{exact:x}", places, odd, valued, n), strict=True):
                    out[name].append(x)
            kinds = (of, pa.float64(), pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int64())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(names, kinds, strict=True)], names)

        of = None
        for batch in batches:
            of = batch.schema.field(0).type
            for key, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = held.get(key)
                if own is None:
                    if len(held) == together:
                        yield told(of)
                    own = held[key] = [0.0, 0, 0, None, 0, 0]
                own[5] += 1
                if x is None:
                    continue
                own[0] += x
                own[4] += 1
                if math.isfinite(x):
                    whole, parts = x.as_integer_ratio()
                    more = parts.bit_length() - 1 - own[2]
                    if more > 0:
                        own[1] = (own[1] << more) + whole
                        own[2] += more
                    else:
                        own[1] += whole << -more
                else:
                    own[3] = x if own[3] is None else own[3] + x
        if held:
            yield told(of)

    def mean(sums, valued):
        places = max(s["places"] for s in sums)
        total = sum(int(s["digits"], 16) << places - s["places"] for s in sums)
        return total / (valued << places) if valued else None

    parts = rows.select(F.col(by).alias("by"), F.col(value).cast("double").alias("value")).mapInArrow(add, f"by {kind}, total double, digits string, places int, odd double, valued long, n long")
    sums = parts.groupBy("by").agg(F.sum("total").alias("total"), F.collect_list(F.struct("digits", "places")).alias("sums"), F.sum("odd").alias("odd"), F.sum("valued").alias("valued"), F.sum("n").alias("n"))
    both = sums.withColumn("exact", F.coalesce("odd", F.udf(mean, "double", useArrow=True)("sums", "valued")))
    return both.select(F.col("by").alias(by), F.when(F.abs("total") < float("inf"), F.try_divide("total", "valued")).otherwise(F.col("exact")).alias("mean"), "exact", "n")


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two set-ups' results ``(query_id, id, points)`` side by side: means by query, and which is better. Equal means are even in any order of rows."""
    side = lambda df, n: means(df, "query_id", "points").select("query_id", F.col("mean").alias(f"points_{n}"), F.col("n").alias(f"results_{n}"), F.col("exact").alias(f"exact_{n}"))
    both = side(a, "a").join(side(b, "b"), "query_id", "full")
    both = both.withColumns({c: F.coalesce(c, F.lit(0).cast(both.schema[c].dataType)) for c in both.columns if c != "query_id"})
    better = F.when(F.col("exact_a") > F.col("exact_b"), "a").when(F.col("exact_a") < F.col("exact_b"), "b").otherwise("even")
    return both.withColumn("better", better).drop("exact_a", "exact_b")


def rolling(rows: DataFrame, per: str, order: list[str], value: str, n: int = 100) -> DataFrame:
    """``rows`` with ``n`` and ``total`` of the last ``n`` values of each ``per``, the row's own included."""
    last = Window.partitionBy(per).orderBy(*order).rowsBetween(1 - n, 0)
    return rows.select(*rows.columns, F.count("*").over(last).alias("n"), F.sum(value).over(last).alias("total"))
