import re
from collections import Counter

import numpy as np
import test_importance
import test_mixing

from tarnforge.llm import ngrams, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    repeat = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat), n < 10 or 100 * len(repeat) > 20 * n


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_documents(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    assert {i: tuple(r[f] for f in FIELDS) for i, r in got.items()} == {i: brute(t) for i, t in rows.items()}
    assert all(not (r.base_failed and r.kept) for r in got.values())
    mark = {r.doc_id: r.quality for r in labels.collect()}
    good = [got[i].kept for i, q in mark.items() if q and not got[i].base_failed]
    bad = [got[i].kept for i, q in mark.items() if not q]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.5 * len(bad)


def test_held_out(spark):
    """Documents whose labels taught nothing: the good are kept, the bad go."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    hidden = "pmod(xxhash64(doc_id), 4) = 0"
    got = {r.doc_id: r for r in quality.quality(docs, labels.where(f"not {hidden}")).collect()}
    share = {}
    for q in (0, 1):
        own = [got[r.doc_id] for r in labels.where(hidden).where(f"quality = {q}").collect()]
        share[q] = sum(r.kept for r in own if not r.base_failed) / sum(not r.base_failed for r in own)
    assert share[1] >= 0.98 and share[0] <= 0.15, share


def brute_verdict(rows, trusted):
    """Ratios and threshold by the formulas, n-gram by n-gram."""
    def cells(text):
        return test_importance.runs(text or ""), test_importance.cells(ngrams.pairs(ngrams.words_of(text)))

    held = {i for i in trusted if test_mixing.spark_hash(i, (13,)) % quality.HELD == 0}
    raw, target = np.zeros((2, ngrams.BUCKETS)), np.zeros((2, ngrams.BUCKETS))
    for i, t in rows:
        for k, own in enumerate(cells(t)):
            np.add.at(raw[k], own, 1)
            if i in trusted - held:
                np.add.at(target[k], own, 1)
    p = (raw + 0.5) / (raw + 0.5).sum(axis=1, keepdims=True)
    strength = 0.5 * ngrams.BUCKETS
    q = (target + strength * p) / (target.sum(axis=1, keepdims=True) + strength)
    logs = np.log(q / p)
    ratio = {}
    for i, t in rows:
        found = [logs[k][c] for k, own in enumerate(cells(t)) for c in own]
        ratio[i] = sum(found) / len(found) if found else 0.0
    own = sorted((ratio[i] for i, t in rows if i in held and not brute(t)[-1]), reverse=True)
    return ratio, own[len(own) - int(quality.TRUSTED_LOSS * len(own)) - 1] - quality.MARGIN


def test_verdict(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    ratio, bar = brute_verdict(rows, {r.doc_id for r in labels.collect() if r.quality})
    for r in quality.quality(docs, labels).collect():
        assert abs(r.log_ratio - ratio[r.doc_id]) < 1e-9
        assert abs(ratio[r.doc_id] - bar) < 1e-9 or r.kept == (not r.base_failed and ratio[r.doc_id] >= bar)


def test_many_labels(spark, sf, monkeypatch):
    """Labels that are too many to broadcast give the same verdicts."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    want = sorted(map(tuple, quality.quality(docs, labels).collect()))
    monkeypatch.setattr(ngrams, "BROADCAST_LABELS", 3)
    assert sorted(map(tuple, quality.quality(docs, labels).collect())) == want


def test_edges(spark):
    texts = [None, "", " \n \n", "a b c d e " * 4, "x\ny\nx\n\n\nx ", "😀 é ### $$ <b>", "a b c d e f a b c d e", "w " * 100_000, "one\ttwo\x0bthree\x0cfour\rfive six"]
    rows = [(i, t, "q") for i, t in enumerate(texts)] + [(None, "a b", None), (0, "z", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = sorted(((r.doc_id or -1, *(r[f] for f in FIELDS)) for r in quality.quality(df, none).collect()), key=str)
    assert got == sorted(((i or -1, *brute(t)) for i, t, _ in rows), key=str)
    assert quality.quality(df.limit(0), none).collect() == []
