"""Quality selection by importance resampling.

A text's importance is the ratio of its likelihoods under two hashed n-gram models, of target documents
and of the raw corpus. Gumbel noise on its logarithm and the k largest sums give a sample without
replacement in proportion to the importance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnforge.llm import common, ngrams

#: Equal bins into which each pass over the keys parts the range that still holds the k-th largest.
_BINS = 4096


def kth_largest(keys: DataFrame, k: int) -> tuple[float, int] | None:
    """The k-th largest ``key`` of ``keys (key double)``, and how many rows have a larger one; None if k is no rank.

    Each pass counts bins of the range that holds it; the range ends as one value. Only counts come to the driver.
    """
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if not 1 <= k <= n:
        return None
    above = 0
    while low < high:
        width = (high - low) / _BINS
        if width == 0 or low + width == low:  # no room for bins: neighbouring doubles
            rows = keys.where(F.col("key").between(low, high)).groupBy("key").count().orderBy(F.desc("key")).collect()
            for r in rows:
                if above + r["count"] >= k:
                    return r["key"], above
                above += r["count"]
        cell = F.least(F.floor((F.col("key") - low) / width), F.lit(_BINS - 1))
        bins = keys.where(F.col("key").between(low, high)).groupBy(cell.alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
        for r in sorted(bins, key=lambda r: -r["lo"]):
            if above + r["n"] >= k:
                low, high = r["lo"], r["hi"]
                break
            above += r["n"]
    return low, above


def importance(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 11) -> DataFrame:
    """``doc_id, log_weight, key, kept`` for every row of ``docs (doc_id, text, ...)``.

    Target documents are all those that ``labels (doc_id, quality)`` call good; the raw model covers all rows. ``share`` of
    the rows, rounded to whole rows, are kept: by default the share of good ones among the labels. Noise is a function of
    seed, doc_id and text, so a run can be repeated; among equal keys the rows with the smallest hash of doc_id are kept
    first, and rows that are equal in that too stay or go together.

    Null, empty or wordless text: no n-grams, log_weight 0, a null key, never kept. Null doc_id: as any other row. Empty
    table: empty result; no labels: the weights are those of equal models and everything with words is kept. Other
    columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    known = ngrams.labels_of(labels, "quality")
    good, of = known.agg(F.coalesce(F.sum(F.when(F.col("quality") > 0, 1)), F.lit(0)), F.count("*")).first()
    share = share if share is not None else good / of if of else 1.0
    rows = ngrams.joined(docs.select("doc_id", "text"), known.where("quality > 0"), "left")
    total = ngrams.counts(rows.select("text", F.col("quality").isNotNull().alias("target")))
    sent = spark.sparkContext.broadcast(ngrams.log_ratios(total))

    def weigh(batch: pa.RecordBatch):
        out = [ngrams.score(t, sent.value) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([s if n else None for s, n in out], pa.float64())], ["doc_id", "draw", "log_weight"])

    draw = F.xxhash64("doc_id", "text", F.lit(seed)).alias("draw")
    weighed, _ = common.cut(common.map_arrow(docs.select("doc_id", "text", draw), weigh, "doc_id long, draw long, log_weight double"), "weights")
    uniform = (F.pmod("draw", F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = weighed.withColumn("key", F.col("log_weight") - F.log(-F.log(uniform)))
    k = min(round(share * docs.count()), keyed.where("key is not null").count())
    found = kth_largest(keyed.select("key").where("key is not null"), k)
    if found is None:
        kept = F.lit(False)
    else:
        bar, above = found
        ties = keyed.where(F.col("key") == bar)
        turn = F.xxhash64("doc_id", F.lit(seed)).cast("double")
        last = kth_largest(ties.select((-turn).alias("key")), k - above)
        kept = F.coalesce((F.col("key") > bar) | ((F.col("key") == bar) & (-turn >= last[0])), F.lit(False))
    return keyed.select("doc_id", F.coalesce("log_weight", F.lit(0.0)).alias("log_weight"), "key", kept.alias("kept"))
