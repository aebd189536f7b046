"""Token counts through a digest cache.

Each text is known by the digest of its normal form, each tokenizer by the digest of its vocabulary file and
library version. The normal form is the tokenizer's own: what it would look at next, so texts that share it have
one count. Counts that the cache table already holds are joined; only distinct texts that it lacks are encoded, and their counts are
appended to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnforge.llm import common

CACHE_SCHEMA = "digest binary, n_tokens long, version string"


@cache
def _encoder(path: str):
    """``texts -> counts`` by the library that the file's kind belongs to; loaded once in each worker."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]


@cache
def version_of(path: str) -> str:
    """Digest of the vocabulary file and of the library that reads it."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + library.__version__.encode()).hexdigest()


@cache
def _normaliser(path: str):
    """``text -> bytes``, equal for two texts only if the library gives both one count.

    The library parts a text into tokens after it has normalised it. Added tokens it looks for in the text as it came, so
    a text that holds one before or after is its own normal form.
    """
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: model.normalize(text).encode("utf-8", "surrogatepass")
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    if model.normalizer is None:
        return lambda text: text.encode("utf-8", "surrogatepass")
    added = [t.content for t in model.get_added_tokens_decoder().values()]

    def normal(text: str) -> bytes:
        out = model.normalizer.normalize_str(text)
        if any(t in text or t in out for t in added):
            return b"\x01" + text.encode("utf-8", "surrogatepass")
        return b"\x00" + out.encode("utf-8", "surrogatepass")

    return normal


#: Digests that a task remembers to send their texts once.
_SEEN = 500_000


def _digests(vocabulary: str, texts: list[str]) -> list[bytes]:
    normal = _normaliser(vocabulary)
    return [hashlib.sha256(normal(t)).digest() for t in texts]


def token_counts(docs: DataFrame, vocabulary: str, cache_path: str | None = None, limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs (doc_id, text, ...)``.

    ``vocabulary`` is the path of a tokenizer file that every worker has; ``cache_path`` a folder that
    driver and executors share, kept from run to run (by default a new one for this run). The cache is partitioned by version.

    Null text: as empty, no bytes and no tokens. Null or repeated doc_id: each row is returned by itself.
    Empty table: empty result, and nothing is appended. Very long texts are encoded whole. Other columns
    are ignored, whatever their names.
    """
    spark = docs.sparkSession
    version = version_of(vocabulary)
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    kept = cache_path or common.fresh(spark, "token-cache")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(kept)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)
    stored = spark.read.schema(CACHE_SCHEMA).parquet(kept)

    def known(batch: pa.RecordBatch):
        found = pa.array(_digests(vocabulary, batch.column(2).to_pylist()), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], ["doc_id", "n_bytes", "digest"])

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text that the task has not sent yet, under its digest: copies meet in one task as one row of each task at most."""
        seen: set[bytes] = set()
        for b in batches:
            texts = b.column(0).to_pylist()
            new = {}
            for d, t in zip(_digests(vocabulary, texts), texts, strict=True):
                if d not in seen:
                    seen.add(d)
                    new[d] = t
            if len(seen) > _SEEN:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.binary()), pa.array(new.values(), pa.string())], ["digest", "text"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            new = {}
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if d not in seen:
                    seen.add(d)
                    new[d] = t
            counts = _encoder(vocabulary)(list(new.values()))
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.binary()), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    rows, _ = common.cut(common.map_arrow(docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text), known, "doc_id long, n_bytes long, digest binary"), "digests")
    asked = common.map_tasks(docs.select(text), sent, "digest binary, text string").repartition("digest")
    misses = asked.join(stored.where(F.col("version") == version).select("digest"), "digest", "left_anti").select("digest", "text")
    fresh = common.map_tasks(misses, encode, "digest binary, n_tokens long")
    fresh.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").partitionBy("version").parquet(kept)

    counts = spark.read.schema(CACHE_SCHEMA).parquet(kept).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    out = common.join_hot(rows, counts, "digest")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
