import numpy as np
import pytest

from tarnforge.operators import ann, search
from tarnforge.plans.scratch import fresh

SCHEMA = "id long, vector array<float>"


def exact(spark, rows, k):
    df = spark.createDataFrame(rows, SCHEMA)
    return search.for_queries(df.where("id % 20 = 0").withColumnRenamed("id", "query_id"), df, k)


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(12, 16))
    near = [centres[i % 12] + 0.3 * draw.normal(size=16) for i in range(1500)]
    # A third of all rows are copies of one vector.
    return [(i, [float(x) for x in (near[i] if i % 3 else near[1])]) for i in range(1500)]


def test_recall(spark, rows):
    want = exact(spark, rows, 10)
    df = spark.createDataFrame(rows, SCHEMA)
    index = ann.build(df, fresh(spark, "index"), cells=24)
    found = ann.search(index, df.where("id % 20 = 0").withColumnRenamed("id", "query_id"), 10, probes=6)
    assert index.rows(spark).count() == 1500 and ann.recall(found, want) >= 0.9
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("vec_id as id", "embedding as vector")
    asked = e.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    index = ann.build(e, fresh(spark, "index"), cells=16)
    assert index.rows(spark).count() == e.count()
    assert ann.recall(ann.search(index, asked, 10, probes=12), search.for_queries(asked, e, 10)) >= 0.9


@pytest.mark.parametrize(("part", "sent"), [(20_000, 1 << 26), (20_000, 0), (64, 0)])
def test_exact(spark, rows, monkeypatch, part, sent):
    """What the first cells leave out is found, with queries sent to the vectors or dealt by cell, in cells of several parts too."""
    monkeypatch.setattr(ann, "PART_ROWS", part)
    df = spark.createDataFrame(rows, SCHEMA)
    index = ann.build(df, fresh(spark, "index"), cells=24)
    asked = df.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    monkeypatch.setattr(ann, "SENT_BYTES", sent)
    got = ann.search_exact(index, asked, fresh(spark, "first"), 10, probes=1)
    rounded = lambda x: sorted((r.query_id, r.id, round(r.sim, 6)) for r in x.collect())
    assert rounded(got) == rounded(exact(spark, rows, 10))


def test_edges(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, 0.0]), (4, [1.0, 0.0]), (5, [0.0, 2.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])], "query_id long, vector array<float>")
    index = ann.build(df, fresh(spark, "index"), cells=8)
    want = [(1, 4), (1, 4), (1, 5)]
    for found in (ann.search(index, q, 3, probes=8), ann.search_exact(index, q, fresh(spark, "first"), 3, probes=1), search.for_queries(q, df, 3)):
        assert sorted((r.query_id, r.id) for r in found.collect()) == want
    empty = ann.build(df.limit(0), fresh(spark, "index"))
    assert ann.search(empty, q).collect() == [] and ann.search_exact(empty, q, fresh(spark, "first")).collect() == []
    assert ann.search(index, q.limit(0)).collect() == []


def files_of(index, spark, cells):
    return {f.split("/cell=")[1].split("/")[0] for f in index.rows(spark, cells).inputFiles()}


def test_opened_again(spark, rows):
    """Another session finds the index on disk, reads the probed cells' folders alone and shuffles no vectors."""
    df = spark.createDataFrame(rows, SCHEMA)
    asked = df.where("id = 40").withColumnRenamed("id", "query_id")
    path = fresh(spark, "index")
    built = ann.build(df, path, cells=24)
    want = sorted(map(tuple, ann.search(built, asked, 10, probes=3).collect()))
    index = ann.opened(spark.newSession(), path)
    assert (index.centres == built.centres).all() and (index.reach == built.reach).all() and index.counts.sum() == 1500
    found = ann.search(index, asked, 10, probes=3)
    assert sorted(map(tuple, found.collect())) == want
    read = {f.split("/cell=")[1].split("/")[0] for f in found.inputFiles()}
    assert len(read) == 3 and read == files_of(index, spark, [int(c) for c in read])
    assert len(files_of(index, spark, None)) > 15
    plan = found._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning(query_id") == plan.count("Exchange") == 1  # what each task found, by query


def test_added(spark, rows):
    """A batch that comes later is found, exactly; the index as it was opened before stays as it was."""
    df = spark.createDataFrame(rows, SCHEMA)
    path = fresh(spark, "index")
    first = ann.build(df.where("id < 1000"), path, cells=24)
    later = ann.added(first, df.where("id >= 1000"))
    again = ann.opened(spark, path)
    assert later.counts.tolist() == again.counts.tolist() and (again.reach >= first.reach).all()
    assert first.rows(spark).count() == 1000 and again.rows(spark).count() == 1500
    asked = df.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    rounded = lambda x: sorted((r.query_id, r.id, round(r.sim, 6)) for r in x.collect())
    assert rounded(ann.search_exact(again, asked, fresh(spark, "first"), 10, probes=1)) == rounded(exact(spark, rows, 10))
    with pytest.raises(ValueError):
        ann.added(ann.build(df.limit(0), fresh(spark, "index")), df)


def test_measured_recall(spark, rows):
    """What was measured is kept, and is what a search by default reaches."""
    df, want = spark.createDataFrame(rows, SCHEMA), exact(spark, rows, 10)
    asked = df.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    path = fresh(spark, "index")
    index = ann.measured(ann.build(df, path, cells=32), asked, want)
    assert list(index.recall) == sorted(index.recall) and list(index.recall.values()) == sorted(index.recall.values())
    assert ann.opened(spark, path).recall == index.recall and index.probes() < 32
    assert ann.recall(ann.search(index, asked, 10), want) >= 0.9
