import pytest
from pyspark.errors import AnalysisException

from tarnforge.operators import chunking, table_functions


@pytest.fixture(scope="module")
def docs(spark):
    table_functions.register(spark)
    text = "def f():\n    return 1\n\n" * 300
    rows = [(1, text, "code"), (2, "a b c d e", "other"), (3, None, None), (4, "# Head\n\nwords " * 900, "doc")]
    spark.createDataFrame(rows, "id long, content string, content_type string").createOrReplaceTempView("tf_docs")
    return rows


def test_chunks_as_from_python(spark, docs):
    got = spark.sql("select * from tf_chunks(table(select * from tf_docs))")
    assert got.columns == ["id", "chunk_index", "total_chunks", "chunk"] and got.schema["id"].dataType.simpleString() == "bigint"
    want = [(i, k, len(parts), p) for i, t, kind in docs for parts in [chunking.intelligent(t or "", kind)] for k, p in enumerate(parts)]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 10


def test_limits_and_joins(spark, docs):
    got = spark.sql("select d.content_type, c.chunk from tf_word_chunks(table(select id, content from tf_docs where id = 2), 3, 1) c join tf_docs d on c.id = d.id order by chunk_index")
    assert [tuple(r) for r in got.collect()] == [("other", "a b c"), ("other", "c d e")]
    named = spark.sql("select name, first_line, last_line from tf_symbols(table(select id, content from tf_docs where id = 1)) order by first_line limit 2")
    assert [tuple(r) for r in named.collect()] == [("f", 1, 2), ("f", 4, 5)]
    assert spark.sql("select * from tf_chunks(table(select * from tf_docs where id > 9))").collect() == []


@pytest.mark.parametrize("call", ["tf_chunks(table(select id from tf_docs))", "tf_symbols(1)", "tf_word_chunks(table(select * from tf_docs), 3, 3)", "tf_word_chunks(table(select * from tf_docs), 'x')"])
def test_wrong_calls_fail_when_analysed(spark, docs, call):
    with pytest.raises(AnalysisException):
        spark.sql(f"select * from {call}")
