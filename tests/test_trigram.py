import random

import pytest
from pyspark.sql import functions as F

from tarnforge.functions import text as T
from tarnforge.operators import trigram
from tarnforge.plans.scratch import fresh

SCHEMA = "id string, content string, file_path string, meta struct<a int, b array<string>>"
SIGMA = ["ΟΔΟΣ ΣΙΣΥΦΟΣ", "οδος", "ΟΔΟΣ.", "σ", "Σ"]


@pytest.fixture(scope="module")
def rows():
    random.seed(3)
    words = ["The", "the", "then", "ab", "a", "É", "éa", "100%", "_x_", "\\", "İstanbul", "straße", "𝛼β", *SIGMA]
    out = [(str(i), " ".join(random.choices(words, k=random.randrange(7))), f"src/f{i}.ts", (i, None)) for i in range(600)]
    return [*out, ("n", None, None, None), ("e", "", "", (1, ["x"])), ("r", "rare needle here", "p", None), ("r", "rare needle here", "p", None)]


@pytest.fixture(scope="module")
def index(spark, rows):
    path = fresh(spark, "text")
    df = spark.createDataFrame(rows, SCHEMA)
    first = trigram.build(df.limit(300), path, part_rows=20)
    left = df.exceptAll(df.limit(300))
    trigram.added(first, left.select("file_path", "meta", "content", "id"), part_rows=20)
    assert first.rows(spark).count() == 300
    return trigram.opened(spark.newSession(), path)


@pytest.mark.parametrize("options", [{}, {"prefix": True}, {"suffix": True}, {"substring": False}, {"prefix": True, "suffix": True}, {"case_sensitive": True}])
def test_same_as_a_scan(spark, rows, index, options):
    df = spark.createDataFrame(rows, SCHEMA)
    for k, query in enumerate(("The éa", "a", "_x_ \\", "straße 𝛼β", "Σ", "οδος i̇st", "f1 %")):
        operator, in_paths = ("and", False) if k % 2 else ("or", True)
        columns = [F.col("content"), *([F.col("file_path")] if in_paths else [])]
        want = sorted(map(str, df.where(T.text_filter(columns, query, operator, **options)).collect()))
        got = trigram.matching(index, spark, query, operator, in_paths, **options)
        assert got.columns == df.columns and sorted(map(str, got.collect())) == want, (query, operator)
    assert trigram.matching(index, spark, " ", **options).count() == len(rows)


def test_reads_a_share(spark, index):
    """A rare term reads the lists of a few slots and the contents of the parts that have it."""
    found = trigram.matching(index, spark, "needle")
    assert found.count() == 2
    parts = {f.split("/_part=")[1].split("/")[0] for f in found.inputFiles() if "/_part=" in f}
    assert len(parts) <= 2 and len({f for f in index.rows(spark).inputFiles()}) > 25
    lists = trigram._rows_with(index, spark, "needle", 1).inputFiles()
    assert len({f.split("slot=")[1].split("/")[0] for f in lists}) <= 4 < len({f.split("slot=")[1].split("/")[0] for f in index.lists(spark).inputFiles()})


def test_dealt_candidates(spark, rows, index, monkeypatch):
    monkeypatch.setattr(trigram, "SENT_ROWS", 0)
    df = spark.createDataFrame(rows, SCHEMA)
    assert trigram.matching(index, spark, "the ab", in_paths=False).count() == df.where(T.text_filter([F.col("content")], "the ab")).count()


def test_empty(spark):
    index = trigram.build(spark.createDataFrame([], SCHEMA), fresh(spark, "text"))
    assert trigram.matching(index, spark, "the").collect() == trigram.matching(index, spark, "a").collect() == trigram.matching(index, spark, "").collect() == []
