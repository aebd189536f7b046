"""Hashed n-gram multinomials of a target and of the raw corpus, counted over whole texts.

Two kinds of n-grams are hashed into one table each: runs of three code points inside blank-padded words,
and pairs of neighbouring words. A table has a fixed number of buckets, so a model's size does not grow
with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnforge.llm import common

BUCKETS = 1 << 16
CHARS, PAIRS = 0, 1
#: Bytes of n-grams that wait in a task to be counted, with what each array of them takes besides.
_WAITING, _ARRAY = 4 << 20, 128


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``, case kept, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


#: White space between words, as code points.
_BLANK = np.zeros(0x21, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


#: Characters, or words, whose n-grams are computed at once: what a very long text takes does not grow with it.
PIECE = 1 << 17


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Buckets of the three-character runs of a text's words, a blank before and after each; one for each character of a word.

    In pieces, each of which sees the characters beside it.
    """
    for at in range(0, len(text), PIECE):
        part = f"{text[at - 1] if at else ' '}{text[at : at + PIECE]}{text[at + PIECE : at + PIECE + 1] or ' '}"
        c = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        blank = (c <= 0x20) & _BLANK[np.minimum(c, 0x20).astype(np.int64)]
        c[blank] = 0x20
        h = common.mix((c[:-2] * np.uint64(0x100000001B3) + c[1:-1]) * np.uint64(0x100000001B3) + c[2:])
        yield (h[~blank[1:-1]] & np.uint64(BUCKETS - 1)).astype(np.uint16)


def pairs(words: list[bytes]) -> Iterator[np.ndarray]:
    """Buckets of a text's pairs of neighbouring words, in pieces."""
    for at in range(0, len(words) - 1, PIECE):
        h = common.hashes(words[at : at + PIECE + 1])
        yield (common.mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) & np.uint64(BUCKETS - 1)).astype(np.uint16)


def cells(text: str | None, kind: int) -> Iterator[np.ndarray]:
    """Buckets of a text's n-grams of a kind, in pieces."""
    return trigrams(text or "") if kind == CHARS else pairs(words_of(text))


def counts(docs: DataFrame, kinds: tuple[int, ...] = (CHARS, PAIRS)) -> np.ndarray:
    """Counts ``[2, kinds, buckets]`` of all rows of ``docs (text, target)``, and of those with ``target``.

    Each task sends one row for each bucket that it met; the sums are bounded by the number of buckets.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 2, BUCKETS), np.int64)
        found: dict[tuple[int, int], list[np.ndarray]] = {(side, kind): [] for side in (0, 1) for kind in kinds}
        waiting = 0

        def settle():
            for (side, kind), some in found.items():
                if some:
                    total[side, kind] += np.bincount(np.concatenate(some), minlength=BUCKETS)
                    some.clear()

        for b in batches:
            for text, target in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for kind in kinds:
                    for piece in cells(text, kind):
                        waiting += piece.nbytes + _ARRAY
                        for side in (0, 1) if target else (0,):
                            found[side, kind].append(piece)
                        if waiting > _WAITING:
                            settle()
                            waiting = 0
        settle()
        which, kind, bucket = np.nonzero(total)
        columns = which.astype(np.int8), kind.astype(np.int8), bucket.astype(np.int32), total[which, kind, bucket]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["which", "kind", "bucket", "n"])

    df = docs.select("text", F.coalesce("target", F.lit(False)).alias("target"))
    found = common.map_tasks(df, count, "which byte, kind byte, bucket int, n long").groupBy("which", "kind", "bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((2, 2, BUCKETS), np.int64)
    out[tuple(found.column(c).to_numpy() for c in ("which", "kind", "bucket"))] = found.column("n").to_numpy()
    return out


def log_ratios(total: np.ndarray, prior: float = 50.0) -> np.ndarray:
    """``log(p_target / p_raw)`` by kind and bucket; the target's multinomial has ``prior`` counts of raw's shape a bucket."""
    raw = total[0] + 0.5
    raw = raw / raw.sum(axis=1, keepdims=True)
    strength = prior * BUCKETS / 100
    target = (total[1] + strength * raw) / (total[1].sum(axis=1, keepdims=True) + strength)
    return np.log(target / raw)


def score(text: str | None, ratios: np.ndarray, kinds: tuple[int, ...] = (CHARS, PAIRS)) -> tuple[float, int]:
    """The sum of a text's n-grams' log ratios, and how many n-grams it is of."""
    total, n = 0.0, 0
    for kind in kinds:
        for piece in cells(text, kind):
            total += float(ratios[kind][piece].sum())
            n += len(piece)
    return total, n


#: Labels that are broadcast; more of them are joined by a shuffle, with the same result.
BROADCAST_LABELS = 1_000_000


def labels_of(labels: DataFrame, column: str) -> DataFrame:
    """``doc_id`` and the greatest ``column`` of each labelled document."""
    return labels.where(f"doc_id is not null and {column} is not null").groupBy("doc_id").agg(F.max(column).alias(column))


def joined(docs: DataFrame, known: DataFrame, how: str) -> DataFrame:
    """``docs`` with the labels ``known``, which are broadcast only if there are few."""
    small = known.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    return docs.join(F.broadcast(known) if small else known, "doc_id", how)


def sampled(known: DataFrame, max_rows: int) -> DataFrame:
    """At most about ``max_rows`` of the labels ``known``, chosen by a hash of the id."""
    n = known.count()
    if n > max_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < int((1 << 30) * max_rows / n))
    return known
