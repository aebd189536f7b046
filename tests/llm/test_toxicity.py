import math
import random
import re
import zlib
from collections import Counter
from itertools import accumulate

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnforge.llm import toxicity


def brute(scores):
    """Maximal scoring segments by their definition: take the best, then go on to its left and right."""
    if not scores or max(scores) <= 0:
        return []
    sums = [0, *accumulate(scores)]
    best = max(((sums[j] - sums[i], i - j, -i, i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)))
    *_, i, j = best
    return [*brute(scores[:i]), (i, j - 1, best[0]), *((a + j, b + j, s) for a, b, s in brute(scores[j:]))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([-1.0, -1.0, -2.17, 0.37, 1.11, 2.73, 5.19]), max_size=14))
def test_segments(scores):
    got = toxicity.segments(np.array(scores, np.float64))
    assert [(round(s, 6)) for *_, s in got] == [round(s, 6) for *_, s in brute(scores)]
    assert all(b < c for (_, b, _), (c, _, _) in zip(got, got[1:]))
    assert all(abs(sum(scores[a : b + 1]) - s) < 1e-9 for a, b, s in got)


def plain(w):
    """A word without its outer ASCII punctuation, in lower case."""
    return re.sub(r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$", "", w.lower())


def brute_scores(rows, labels):
    """Score and significant passages of each row by the formulas, word by word, without shared tables."""
    known = {i: int(t > 0) for i, t in labels if zlib.crc32(str(i).encode()) % 5}
    words = [[plain(w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] for _, t in rows]
    train = [(words[k], known[i]) for k, (i, _) in enumerate(rows) if i in known]
    toxic = sum(y for _, y in train)
    base = (toxic + 0.5) / (len(train) + 1)
    holds, stems = Counter(), Counter()
    for w, y in train:
        holds.update({(x, y) for x in w if x})
        stems.update({(x[:4], y) for x in w if x})

    def odds(x, own=None):
        if not x:
            return 0.0
        n = [holds[x, y] - (own == y) for y in (0, 1)]
        m = [stems[x[:4], y] - (own == y) for y in (0, 1)]
        stem = (m[1] + 40 * base) / (sum(m) + 40)
        p = (n[1] + 12 * stem) / (sum(n) + 12)
        return max(-6.0, min(6.0, math.log(p / (1 - p)) - math.log(base / (1 - base))))

    def found(w, own=None):
        return brute([odds(x, own) - 0.75 for x in w])

    own = [(len(w), y, [s for *_, s in found(w, y)]) for w, y in train]
    clean = [(n, max(s, default=0.0)) for n, y, s in own if not y and n]
    g = [-math.log(-math.log(q)) for q in (0.8, 0.98)]
    high = np.quantile([b for _, b in clean], (0.8, 0.98))
    rate = (g[1] - g[0]) / max(high[1] - high[0], 0.05)
    place = np.quantile([rate * b - math.log(n) for n, b in clean], 0.8) - g[0]
    bar = -math.log(-math.log1p(-0.05))

    def features(n, scores):
        over = [rate * s - place - math.log(max(n, 1)) for s in scores]
        return [math.log1p(max([0.0, *over])), math.log1p(sum(x for x in over if x > bar))]

    x = np.array([[1, *features(n, s)] for n, _, s in own])
    y = np.array([y for _, y, _ in own], float)
    w = np.zeros(3)
    for _ in range(200):  # the same penalised likelihood, by plain Newton steps
        p = 1 / (1 + np.exp(-x @ w))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-6, 0.05 + 1e-6, 0.05 + 1e-6]), x.T @ (y - p) - np.diag([0, 0.05, 0.05]) @ w)
    out = []
    for k, (i, _) in enumerate(rows):
        spans = found(words[k])
        z = np.array([1, *features(len(words[k]), [s for *_, s in spans])]) @ w
        level = place + math.log(max(len(words[k]), 1)) + bar
        out.append((i, 1 / (1 + math.exp(-z)), [(a, b + 1) for a, b, s in spans if rate * s > level]))
    return out


def test_whole_score(spark):
    draw = random.Random(5)
    nasty, neutral = [f"Nast{c}y!" for c in "abcdef"], [f"{c}word" for c in "abcdefghijklmnop"]
    rows, labels = [], []
    for i in range(160):
        w = draw.choices(neutral, k=draw.randint(3, 40))
        if i % 4 == 0:
            for _ in range(2):
                at = draw.randint(0, len(w))
                w[at:at] = draw.choices(nasty, k=4)
        elif i % 4 == 1:
            w.insert(0, draw.choice(nasty))
        rows.append((i, " ".join(w) + draw.choice(["", " ...", "\n"])))
        labels.append((i, int(i % 4 == 0)))
    rows += [(500, None), (501, ""), (502, "?! ...")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.toxicity(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    for i, score, spans in brute_scores(rows, labels):
        assert abs(got[i].score - score) < 1e-6 and [(p.start, p.end) for p in got[i].passages] == spans
    assert any(len(r.passages) > 1 for r in got.values())


def test_clean_training_texts_without_words(spark):
    rows = [(i, None if i % 2 else "some words") for i in range(40)]
    df, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, 1 - i % 2) for i in range(40)], "doc_id long, toxic int")
    (score,) = {r.score for r in toxicity.toxicity(df, labels).collect()}
    used = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    assert score == pytest.approx((sum(1 - i % 2 for i in used) + 0.5) / (len(used) + 1))


def test_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(out) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in out.items())
    mark = [(r.toxic, out[r.doc_id].predicted) for r in labels.collect() if out[r.doc_id].held_out]
    assert np.mean([a == b for a, b in mark]) >= 0.9


def test_held_out_labels_teach_nothing(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    other = labels.selectExpr("doc_id", "quality", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    run = lambda x: {r.doc_id: r.score for r in toxicity.toxicity(docs, x).collect()}
    assert run(labels) == run(other)


def test_edges(spark, sf):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "...", 1), (3, "...", 1), (None, "a b", 1), (5, "word " * 200_000, 1)], "doc_id long, text string, toxic int")
    for labels in ([], [(1, 1), (2, 1)], [(5, 0), (5, None), (None, 1)]):
        out = toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
        assert len(out) == 6 and len({r.score for r in out}) == 1
    assert toxicity.toxicity(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int")).collect() == []


def test_without_toxic(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    low = {r.doc_id for r in toxicity.toxicity(docs, labels).collect() if r.score < 0.5}
    out = toxicity.without_toxic(docs, labels)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == low


def test_repeated_passage():
    """A passage is found each time it stands, and though its words stood scattered before."""
    insults = [f"insult{i}" for i in range(8)]
    positive, other, stems = np.zeros(toxicity.WORDS), np.full(toxicity.WORDS, 500.0), np.zeros((2, toxicity.STEMS))
    for w in insults:
        cell = toxicity._cells(w.encode())[0]
        positive[cell], other[cell] = 50, 0
    model = toxicity.Model(positive, other, *stems, 0.1)
    clean = [f"clean{i}" for i in range(600)]
    twice = [*clean[:200], *insults, *clean[200:400], *insults, *clean[400:]]
    spans = lambda words: [(a, b) for a, b, s in model.passages(" ".join(words))[1] if s > 10]
    assert spans(twice) == [(200, 207), (408, 415)]
    scattered = list(clean)
    scattered[0:320:40] = insults
    assert spans([*scattered, *insults]) == [(600, 607)]
