"""Every registered query with a SQL twin against DuckDB on the same tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DIR = os.environ.get("TWIN_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.catalogue.QUERIES, entry.catalogue.SQL


def value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    return x


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(value(r[i]) for i in order) for r in found), key=repr), [names[i] for i in order]


def same_words(spark, got, names):
    """Every word of every document is in its chunks, in order, and their places are consecutive."""
    chunks = {}
    at = {n: names.index(n) for n in names}
    for r in got:
        chunks.setdefault(r[at["id"]], []).append((r[at["chunk_index"]], r[at["total_chunks"]], r[at["chunk"]]))
    from tarnforge.plans.tables import store

    for r in store(spark, DIR, False).select("id", "content", "content_type").collect():
        own = sorted(chunks[r.id])
        assert [(i, n) for i, n, _ in own] == [(i, len(own)) for i in range(len(own))]
        words, held = r.content.split(), iter(" ".join(c for *_, c in own).split())
        assert all(w in held for w in words), r.id  # each word is met after the one before


def true_neighbours(spark, got, names):
    """The inverted file finds at least nine in ten of the true ten nearest."""
    from tarnforge.operators import search

    e = spark.read.parquet(f"{DIR}/embeddings.parquet").selectExpr("vec_id as id", "embedding as vector")
    best = search.for_queries(e.where("id % 20 = 0").withColumnRenamed("id", "query_id"), e, 10).collect()
    found = {(r[names.index("query_id")], r[names.index("id")]) for r in got}
    assert sum((r.query_id, r.id) in found for r in best) >= 0.9 * len(best)


#: What holds of the queries that have no twin.
UNTWINNED = {"intelligent_chunks": same_words, "index_search": true_neighbours}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in Path(DIR).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_twin(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    got, names = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in SQL:
        UNTWINNED[name](spark, got, names)
        return
    rel = duck.sql(SQL[name])
    want, columns = rows(rel.columns, rel.fetchall())
    assert names == columns
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == pytest.approx(b, abs=2e-6) if all(isinstance(x, int | float) for x in (*a, *b)) else all(x == y or (isinstance(x, float) and abs(x - float(y)) < 2e-6) for x, y in zip(a, b)), (a, b)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "sim"] and df.count() == 10


def test_every_twin_has_a_query():
    assert set(SQL) <= set(QUERIES)
