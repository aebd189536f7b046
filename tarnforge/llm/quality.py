"""Quality rules: text statistics and a log-likelihood ratio against the raw corpus.

The base rules look at one text. The verdict compares two hashed n-gram multinomials, of trusted target
documents and of the whole raw corpus: the ratio of a text's likelihoods, by n-gram, against one threshold. The threshold
comes from trusted documents that the multinomials have not seen.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnforge.llm import common, importance, ngrams

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_BLANKS = re.compile(r"[\x20\x09-\x0D]+")
_WHITE = " \t\n\x0b\x0c\r"
#: The verdict's n-grams: character runs and word pairs.
KINDS = (ngrams.CHARS, ngrams.PAIRS)
#: Share of trusted documents that the threshold may turn away, and what is taken off beside it.
TRUSTED_LOSS, MARGIN = 0.002, 0.02
#: One in so many trusted documents, by a hash of the id, sets the threshold and teaches nothing.
HELD = 5


def statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = ngrams.words_of(text)
    chars = len(_BLANKS.sub("", text))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(_WHITE):
            seen.add(line)
    repeat = 0
    if len(words) >= 5:
        _, of, n = np.unique(common.windows(common.hashes(words), 5), return_inverse=True, return_counts=True)
        twice = n[of] > 1
        if twice.any():
            edge = np.zeros(len(words) + 1, np.int64)
            at = np.nonzero(twice)[0]
            np.add.at(edge, at, 1)
            np.add.at(edge, at + 5, -1)
            repeat = int((np.cumsum(edge) > 0).sum())
    return len(words), chars, len(_SYMBOLS.findall(text)), dup, repeat


def fails(n_words: int, n_repeat: int) -> bool:
    return n_words < 10 or 100 * n_repeat > 20 * n_words


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Log ratios of the n-grams, and the threshold.

    Raw counts cover all rows of ``docs``. Of the documents that ``labels (doc_id, quality)`` trust (quality above 0) one in
    ``HELD`` sets the threshold: it lies below all but ``TRUSTED_LOSS`` of their ratios, by ``MARGIN``. All others are
    the target's counts.
    """
    held = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(HELD)) == 0
    known = ngrams.labels_of(labels.where("quality > 0"), "quality").select("doc_id", held.alias("held"))
    rows = ngrams.joined(docs.select("doc_id", "text"), known, "left")
    ratios = ngrams.log_ratios(ngrams.counts(rows.select("text", (F.col("held") == F.lit(False)).alias("target")), KINDS))
    sent = docs.sparkSession.sparkContext.broadcast(ratios)

    def rate(batch: pa.RecordBatch):
        out = []
        for text in batch.column(0).to_pylist():
            n, *_, repeat = statistics(text)
            if not fails(n, repeat):
                s, k = ngrams.score(text, sent.value, KINDS)
                out.append(s / k)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64())], ["key"])

    with common.scratch() as made:
        trusted, _ = common.cut(common.map_arrow(ngrams.joined(docs.select("doc_id", "text"), known.where("held"), "inner").select("text"), rate, "key double"), "ratios")
        n = trusted.count()
        found = importance.kth_largest(trusted, n - int(TRUSTED_LOSS * n))
        common.release(docs.sparkSession, made)
    sent.unpersist()  # the judging sends the ratios again, with the threshold
    return ratios, found[0] - MARGIN if found else -np.inf


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The base statistics, ``base_failed``, ``log_ratio`` and ``kept`` of every row of ``docs (doc_id, text, ...)``.

    Null, empty or wordless text: all counts 0, base_failed, log_ratio 0. Without trusted labels no document falls by
    the verdict. Null or repeated doc_id: each row is returned by itself. Empty table: empty result. Very
    long texts are read whole. Other columns are ignored, whatever their names.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def judge(batch: pa.RecordBatch):
        ratios, threshold = sent.value
        stats, failed, ratio = [], [], []
        for text in batch.column(1).to_pylist():
            own = statistics(text)
            s, k = ngrams.score(text, ratios, KINDS)
            stats.append(own)
            failed.append(fails(own[0], own[4]))
            ratio.append(s / k if k else 0.0)
        kept = [not f and r >= threshold for f, r in zip(failed, ratio, strict=True)]
        columns = [pa.array([x[i] for x in stats], pa.int64()) for i in range(5)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(failed, pa.bool_()), pa.array(ratio, pa.float64()), pa.array(kept, pa.bool_())], ["doc_id", *names, "base_failed", "log_ratio", "kept"])

    return common.map_arrow(docs.select("doc_id", "text"), judge, f"doc_id long, {', '.join(f'{x} long' for x in names)}, base_failed boolean, log_ratio double, kept boolean")
