import re
from collections import Counter

import pytest

from tarnforge.llm import neardup

SCHEMA = "doc_id long, text string"


def brute(rows):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    at = {}
    for i, s in sets.items():
        for x in s:
            at.setdefault(x, []).append(i)
    both = Counter((a, b) for ids in at.values() for k, a in enumerate(ids) for b in ids[k + 1 :])
    for (a, b), n in both.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {(i, len(s), root(i), root(i) == i) for i, s in sets.items()}


def got(df):
    return {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_documents_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert got(neardup.near_duplicates(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_large_group_of_near_copies(spark):
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*base[:i % 100], f"x{i}", *base[i % 100 + 1 :]])) for i in range(150)]
    rows += [(500 + i, " ".join(base[: 40 + i])) for i in range(60)]
    assert got(neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_edges(spark):
    long = " ".join(f"t{i}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one\ttwo"), (6, "one two three four five"), (7, long), (8, long + " end"), (9, "ONE TWO three four five"), (10, "É a"), (11, "é a")]
    assert got(neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_repeats_nulls_and_other_columns(spark):
    rows = [(5, "a b c", 1), (5, "a b c", 1), (3, "A B C", 2), (None, "a b c", 3)]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, comp long")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in out) == [(0, 0, False), (3, 3, True), (5, 3, False), (5, 3, False)]


def test_empty_table(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_components_of_a_long_chain(spark):
    n = 60
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101)], "u long, v long")
    assert {(r.node, r.root) for r in neardup.components(links).collect()} == {(i, 0) for i in range(1, n + 1)} | {(101, 100)}


@pytest.mark.parametrize("kept", [True])
def test_deduplicated_keeps_columns(spark, sf, kept):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = neardup.deduplicated(docs)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.select("doc_id").collect()} == {r[0] for r in got(neardup.near_duplicates(docs)) if r[3] is kept}
