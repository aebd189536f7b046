import math
import re
import struct

import numpy as np
import xxhash

from tarnforge.llm import importance, ngrams


def test_kth_largest(spark):
    values = [float(x) for x in np.random.default_rng(1).normal(size=3000)] + [0.5] * 40 + [1e300, -1e300, 5e-324]
    df = spark.createDataFrame([(v,) for v in values], "key double")
    ranked = sorted(values, reverse=True)
    for k in (1, 2, 3, 700, 1500, len(values)):
        bar, above = importance.kth_largest(df, k)
        assert bar == ranked[k - 1] and above == sum(v > bar for v in values)
    assert importance.kth_largest(df, 0) is None and importance.kth_largest(df.limit(0), 1) is None


def runs(text):
    """Buckets of each word's three-character runs, hashed one by one."""

    def bucket(t):
        a, b, c = map(ord, t)
        x = ((a * 0x100000001B3 + b) * 0x100000001B3 + c) % 2**64
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
        return (x ^ x >> 31) % ngrams.BUCKETS

    padded = (f" {w} " for w in re.findall(r"[^\x20\x09-\x0D]+", text))
    return [bucket(p[i : i + 3]) for p in padded for i in range(len(p) - 2)]


def test_trigrams():
    for t in ("", " ", "a", "ab\tc", "\x0b\x1fé😀\n\n x\x85y "):
        assert cells(ngrams.trigrams(t)) == runs(t)


def cells(pieces):
    return [int(x) for p in pieces for x in p]


def test_pieces(monkeypatch):
    """Pieces of a long text give what the whole does."""
    text = "é😀 abc\tde  f\n\n ghi jk " * 7
    words = ngrams.words_of(text)
    whole = cells(ngrams.trigrams(text)), cells(ngrams.pairs(words))
    for size in (1, 2, 3, 5, 8):
        monkeypatch.setattr(ngrams, "PIECE", size)
        assert (cells(ngrams.trigrams(text)), cells(ngrams.pairs(words))) == whole


def test_counts_match_one_pass(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("text", "doc_id % 3 = 0 as target")
    got, want = ngrams.counts(docs), np.zeros((2, 2, ngrams.BUCKETS), np.int64)
    for r in docs.collect():
        w = ngrams.words_of(r.text)
        for side in (0, 1) if r.target else (0,):
            for x in runs(r.text):
                want[side, 0, x] += 1
            np.add.at(want[side, 1], cells(ngrams.pairs(w)), 1)
    assert (got == want).all()
    s, n = ngrams.score("a b", ngrams.log_ratios(got))
    assert n == 3 and np.isfinite(s)


def brute(rows, target, share, seed=11):
    """The documents with the largest keys, models and noise computed anew."""
    total = np.zeros((2, 2, ngrams.BUCKETS), np.int64)
    for r in rows:
        w = ngrams.words_of(r.text)
        for side in (0, 1) if r.doc_id in target else (0,):
            for x in runs(r.text):
                total[side, 0, x] += 1
            np.add.at(total[side, 1], cells(ngrams.pairs(w)), 1)
    ratio, keys = ngrams.log_ratios(total), []
    for r in rows:
        w = ngrams.words_of(r.text)
        if w:
            s = ratio[0][runs(r.text)].sum() + ratio[1][cells(ngrams.pairs(w))].sum()
            h = xxhash.xxh64_intdigest(struct.pack("<i", seed), xxhash.xxh64_intdigest(r.text.encode(), xxhash.xxh64_intdigest(struct.pack("<q", r.doc_id), 42)))
            keys.append((s - math.log(-math.log((h % 2**52 + 0.5) / 2**52)), r.doc_id))
    return {i for _, i in sorted(keys, reverse=True)[: round(share * len(rows))]}


def test_documents(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = importance.importance(docs, labels).collect()
    good, of = labels.where("quality > 0").count(), labels.count()
    assert sum(r.kept for r in out) == round(good / of * docs.count())
    mark = {r.doc_id: r.quality for r in labels.collect()}
    assert {r.doc_id for r in out if r.kept} == brute(docs.collect(), {i for i, q in mark.items() if q}, good / of)
    kept = lambda q: np.mean([r.kept for r in out if mark.get(r.doc_id) == q])
    assert kept(1) > kept(0) + 0.3


def test_edges(spark):
    rows = [(1, None, 1), (2, "", 1), (3, "a b c", 1), (3, "a b c", 1), (None, "x y z", 2), (5, "q " * 100_000, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = importance.importance(df, none).collect()
    assert sorted(((r.doc_id or -1), r.kept) for r in out) == [(-1, True), (1, False), (2, False), (3, True), (3, True), (5, True)]
    assert importance.importance(df.limit(0), none).collect() == []
    assert sum(r.kept for r in importance.importance(df, none, share=0.5).collect()) in (2, 3, 4)
