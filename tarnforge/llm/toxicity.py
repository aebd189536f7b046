"""Toxic passages by maximum-scoring segments.

Each token has a log-odds of toxic against other documents. Its Dirichlet prior is centred on the tokens
that share its first characters, and theirs on the corpus, so a rare inflection leans on its stem. A
linear scan finds every maximal segment of positive score. The best score that a clean text reaches by
chance follows an extreme-value law in the length of the text; segments beyond it are the significant
passages, and a logistic curve over what they exceed it by gives the document's score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnforge.llm import common, ngrams

WORDS, STEMS = 1 << 20, 1 << 18
#: Leading characters of a word that its inflections share.
STEM_CHARS = 4
#: Strength of the priors, in documents: of a word's stem on the word, of the corpus on the stem.
WORD_PRIOR, STEM_PRIOR = 12.0, 40.0
#: What each token costs, so that segments end, and the greatest log-odds of either sign.
DRIFT, MOST = 0.75, 6.0
#: A segment counts if chance gives its score less often than this in a clean text of its length.
ALPHA = 0.05
#: Quantiles of clean texts' best scores that fix the law.
TAIL = (0.8, 0.98)
#: Words that a worker remembers before it starts anew.
_MEMO = 300_000
_EDGE = bytes(range(0x21, 0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x7F))


def _cells(word: bytes) -> tuple[int, int]:
    """Buckets of a lower-cased word without its outer punctuation, and of its stem; -1 if nothing is left."""
    w = word.strip(_EDGE)
    if not w:
        return -1, -1
    if w.isascii():  # in lower case already
        return xxhash.xxh64_intdigest(w) % WORDS, xxhash.xxh64_intdigest(w[:STEM_CHARS], 1) % STEMS
    t = w.decode("utf-8", "surrogatepass").lower()
    return xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) % WORDS, xxhash.xxh64_intdigest(t[:STEM_CHARS].encode("utf-8", "surrogatepass"), 1) % STEMS


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(first, last, score)`` of a sequence of scores, in linear time.

    A segment is maximal if no overlapping one scores more and its every prefix and suffix is positive. Runs of
    scores above 0 are taken as one step each; the sums before and through them come from one cumulative sum.
    """
    up = np.nonzero(np.diff(np.concatenate(([0], (scores > 0).view(np.int8), [0]))))[0]
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    firsts, ends = up[0::2], up[1::2]
    stack: list[tuple] = []  # first, end, sum before it, sum through it, the one below with a smaller sum before
    for first, end, low, through in zip(firsts.tolist(), ends.tolist(), sums[firsts].tolist(), sums[ends].tolist(), strict=True):
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= through:
                stack.append((first, end, low, through, j))
                break
            first, _, low, _, up = stack[j]
            del stack[j:]
            j = up
    return [(a, b - 1, hi - lo) for a, b, lo, hi, _ in stack]


@dataclass
class Model:
    """What scoring needs; its size does not depend on the corpus."""

    positive: np.ndarray  # documents, by word bucket, that are toxic
    other: np.ndarray
    stem_positive: np.ndarray
    stem_other: np.ndarray
    base: float  # share of toxic documents
    rate: float = 1.0  # of the extreme-value law, by score
    place: float = 0.0  # log of its constant
    curve: tuple[float, ...] = (0.0, 1.0, 0.0)
    drift: float = DRIFT
    memo: dict = field(default_factory=dict, repr=False)

    def _odds(self, cells: np.ndarray, own: int = -1) -> np.ndarray:
        """Log-odds of tokens, without a document of label ``own`` (-1: none) that holds them."""
        w, s = cells[:, 0], cells[:, 1]
        out1, out0 = own == 1, own == 0
        sp, so = self.stem_positive[s] - out1, self.stem_other[s] - out0
        stem = (sp + STEM_PRIOR * self.base) / (sp + so + STEM_PRIOR)
        wp, wo = self.positive[w] - out1, self.other[w] - out0
        p = (wp + WORD_PRIOR * stem) / (wp + wo + WORD_PRIOR)
        odds = np.log(p / (1 - p)) - math.log(self.base / (1 - self.base))
        return np.where(w < 0, 0.0, np.clip(odds, -MOST, MOST))

    def passages(self, text: str | None, own: int = -1) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of words, and the maximal scoring segments by word."""
        words = common.words_of(text)
        memo = self.memo.setdefault(own, {})
        if missing := [w for w in set(words) if w not in memo]:
            if len(memo) > _MEMO:
                memo.clear()
                missing = list(set(words))
            memo.update(zip(missing, self._odds(np.array([_cells(w) for w in missing], np.int64), own).tolist(), strict=True))
        return len(words), segments(np.fromiter(map(memo.__getitem__, words), np.float64, len(words)) - self.drift)

    def features(self, n: int, found: list[tuple[int, int, float]]) -> tuple[float, float]:
        """By how much the best passage exceeds what chance gives, and the sum over significant passages."""
        if not found:
            return 0.0, 0.0
        level = self.place + math.log(max(n, 1))
        over = [self.rate * s - level for *_, s in found]
        bar = -math.log(-math.log1p(-ALPHA))
        return max(0.0, max(over)), sum(x for x in over if x > bar)

    def chance(self, features: tuple[float, float]) -> float:
        a, b, c = self.curve
        z = a + b * math.log1p(features[0]) + c * math.log1p(features[1])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _counted(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents by label, and by label and bucket of their words and stems, over rows ``(text, toxic)``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.zeros(2, np.int64)
        words, stems = np.zeros((2, WORDS), np.int32), np.zeros((2, STEMS), np.int32)
        memo: dict[bytes, tuple[int, int]] = {}
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                size[toxic] += 1
                if len(memo) > _MEMO:
                    memo.clear()
                cells = set()
                for w in set(common.words_of(text)):
                    if (c := memo.get(w)) is None:
                        c = memo[w] = _cells(w)
                    cells.add(c)
                cells.discard((-1, -1))
                if cells:
                    w, s = np.array(list(cells), np.int64).T
                    words[toxic, np.unique(w)] += 1
                    stems[toxic, np.unique(s)] += 1
        for kind, table in ((0, words), (1, stems), (2, size[:, None])):
            label, bucket = np.nonzero(table)
            if len(label):
                columns = np.full(len(label), kind, np.int8), label.astype(np.int8), bucket.astype(np.int32), table[label, bucket].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "label", "bucket", "n"])

    counted = common.map_tasks(docs, count, "kind byte, label byte, bucket int, n long").groupBy("kind", "label", "bucket").agg(F.sum("n").alias("n"))
    found = counted.toArrow()
    kind, label, bucket, n = (found.column(c).to_numpy() for c in ("kind", "label", "bucket", "n"))
    out = []
    for k, width in ((0, WORDS), (1, STEMS), (2, 1)):
        t = np.zeros((2, width))
        of = kind == k
        t[label[of], bucket[of]] = n[of]
        out.append(t)
    return out[2][:, 0], out[0], out[1]


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Ridge logistic regression by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(x.shape[1]), np.diag([0.0] + [0.05] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-6 * np.eye(len(w)), x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 200_000) -> Model:
    """A model from the labelled rows of ``docs`` whose crc32(doc_id as text) mod 5 is not 0.

    At most about ``max_rows`` labelled documents are used, chosen by a hash of their id; that bounds the
    broadcast of their labels and the features that come to the driver for the calibration.
    """
    taught = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    known = ngrams.sampled(ngrams.labels_of(taught, "toxic"), max_rows)
    rows = ngrams.joined(docs.select("doc_id", "text"), known, "inner").select("text", F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic"))
    size, words, stems = _counted(rows)
    model = Model(words[1], words[0], stems[1], stems[0], (size[1] + 0.5) / (size.sum() + 1))
    if not size.all():  # one label alone, or none: the share is all there is to say
        model.curve = (math.log(model.base / (1 - model.base)), 0.0, 0.0)
        return model
    with common.scratch() as made:
        _calibrate(model, rows)
        common.release(docs.sparkSession, made)
    model.memo = {}
    return model


def _calibrate(model: Model, rows: DataFrame) -> None:
    """Fit the law of chance and the curve to ``rows (text, toxic)``, each scored without itself.

    The segments' scores stay in a table. Label, length and best score of each row come to the driver for the law, and
    its two features for the curve.
    """
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def scored(batch: pa.RecordBatch):
        n, scores = [], []
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words, found = sent.value.passages(text, toxic)
            n.append(words)
            scores.append([s for *_, s in found])
        yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(scores, pa.list_(pa.float64()))], ["toxic", "n", "scores"])

    kept, _ = common.cut(common.map_arrow(rows, scored, "toxic long, n long, scores array<double>"), "segments")
    seen = kept.where("n > 0 and toxic = 0").select("n", F.coalesce(F.array_max("scores"), F.lit(0.0)).alias("best")).toArrow()
    n, best = seen.column("n").to_numpy(), seen.column("best").to_numpy()
    if not len(n):  # no clean text has words: nothing says what chance gives
        model.curve = (math.log(model.base / (1 - model.base)), 0.0, 0.0)
        return
    # Gumbel law of clean texts' best scores, fitted to the upper quantiles, where it has to hold: rate * best - log n
    # has the place, and best has the spread, of a standard one.
    high, higher = np.quantile(best, TAIL)
    gumbel = [-math.log(-math.log(q)) for q in TAIL]
    model.rate = (gumbel[1] - gumbel[0]) / max(float(higher - high), 0.05)
    model.place = float(np.quantile(model.rate * best - np.log(n), TAIL[0])) - gumbel[0]
    law = Model(*(np.zeros(0),) * 4, model.base, model.rate, model.place)

    def features(batch: pa.RecordBatch):
        both = [law.features(n, [(0, 0, s) for s in scores]) for n, scores in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in both], pa.float64()) for i in (0, 1))], ["toxic", "over", "total"])

    x = common.map_arrow(kept, features, "toxic long, over double, total double").toArrow()
    model.curve = _logistic(np.log1p(np.column_stack([x.column(c).to_numpy() for c in ("over", "total")])), x.column("toxic").to_numpy().astype(float))


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """``doc_id, held_out, score, predicted, passages`` for every row of ``docs (doc_id, text, ...)``.

    ``labels (doc_id, toxic)`` teach the model (see ``fit``); they, lang, source and doc_id are no inputs of a
    score. ``passages`` are the significant segments as ``start, end`` (by word) and ``score``.

    Null, empty or wordless text: no passages, the score of a text without any. Null doc_id: held_out is
    null. Repeated rows: each is returned; of repeated labels of a document the largest counts. Labels of
    one kind only, or none, or clean training texts without any word: every score is the smoothed share of toxic labels. Empty
    table: empty result.
    Very long texts are scored whole, in one linear scan. Other columns are ignored, whatever their names.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_rows))
    bar = -math.log(-math.log1p(-ALPHA))

    def score(batch: pa.RecordBatch):
        model, scores, spans = sent.value, [], []
        for text in batch.column(1).to_pylist():
            n, found = model.passages(text)
            scores.append(model.chance(model.features(n, found)))
            level = model.place + math.log(max(n, 1)) + bar
            spans.append([{"start": a, "end": b + 1, "score": s} for a, b, s in found if model.rate * s > level])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "passages"])

    out = common.map_arrow(docs.select("doc_id", "text"), score, "doc_id long, score double, passages array<struct<start:long,end:long,score:double>>")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "passages")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_rows: int = 200_000) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, columns as they are.

    Null and empty texts stay, as do rows with a null doc_id that score below it. Repeated rows stay or go together. Empty
    table: empty result. Columns other than doc_id and text play no part, whatever their names.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_rows))
    at = docs.columns.index("text")

    def keep(batch: pa.RecordBatch):
        model = sent.value
        low = [not t or model.chance(model.features(*model.passages(t))) < threshold for t in batch.column(at).to_pylist()]
        yield batch.filter(pa.array(low, pa.bool_()))

    return common.map_arrow(docs, keep, docs.schema)
