import datetime
import json

import pytest
from pyspark.sql import functions as F

from tarnforge.functions import detect, diff, score, sql, text, vector


def one(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


@pytest.mark.parametrize(
    "path, content, kind, language",
    [
        ("lib/total.js", "let total = 0;\nfunction add(n) { total += n; }", "code", "javascript"),
        ("notes/plan.md", "# Plan\n\nFirst this, and then that.", "doc", None),
        ("settings.json", '{"depth": 3, "paths": ["a", "b"]}', "config", "json"),
        ("deploy.yaml", "stage: live\nhosts: 2", "config", "yaml"),
        ("sums.py", "def total(xs):\n    return sum(xs)", "code", "python"),
        ("letter.txt", "Dear all, the meeting is on Monday", "doc", None),
        ("a.xyz", "", "other", None),
        ("A.TSX", None, "code", "typescript"),
    ],
)
def test_detected(spark, path, content, kind, language):
    found = one(spark, detect.detected(F.lit(path), F.lit(content).cast("string")))[0]
    assert (found.content_type, found.language) == (kind, language)


def test_content_outweighs_extension(spark):
    code = "\n".join(["import x", "function f() { return 1; } // c"] * 60)
    found = one(spark, detect.detected(F.lit("a.md"), F.lit(code)))[0]
    assert found.content_type == "code" and found.detected_by == "content" and found.confidence == 0.9


@pytest.mark.parametrize(
    "path, content, expected",
    [
        ("lib/utils/dates.ts", "export const day = (d) => d.getDay();", "helper"),
        ("app/tests/sum.test.ts", "it('adds', () => { expect(1 + 1).toBe(2); });", "test"),
        ("examples/reader.py", "reader = Reader()\nreader.run()", "example"),
        ("templates/letter.ts", "export class Letter { body = ''; }", "template"),
        ("src/engine/loop.ts", "class Loop { step() { this.n += 1; } }", "core"),
    ],
)
def test_role(spark, path, content, expected):
    assert one(spark, detect.role(F.lit(path), F.lit(content), F.lit("code")))[0] == expected


def fold(s, h, k):
    for c in s:
        h = (h * k + ord(c) + 2**31) % 2**32 - 2**31
    return h


@pytest.mark.parametrize("s", ["", "a", "hello world", "/home/x/project", "é😀" * 30])
def test_hashes(spark, s):
    assert one(spark, text.rolling_hash(F.lit(s)), text.djb2_hash(F.lit(s)), text.project_id(F.lit(s))) == (fold(s, 0, 31), fold(s, 5381, 33), f"{abs(fold(s, 0, 31)):08x}")


def test_paths(spark):
    p = F.lit("src/a.test.ts#chunk12")
    assert one(spark, text.clean_path(p), text.chunk_id(F.lit("p"), p, F.lit(3), F.lit(9)), text.chunk_id(F.lit("p"), p, F.lit(0), F.lit(1)), text.extension(F.lit("a.b.ts")), text.dotted_extension(F.lit("A.B.TS")), text.dotted_extension(F.lit("none"))) == ("src/a.test.ts", "p:src/a.test.ts#chunk3", "p:src/a.test.ts", "ts", ".ts", "")


def test_like_pattern():
    assert text.like_pattern("50%_x") == "%50\\%\\_x%" and text.like_pattern("A", prefix=True) == "a%"
    assert text.like_pattern("A", suffix=True, case_sensitive=True) == "%A" and text.like_pattern("a", substring=False) == "a"


def test_text_score(spark):
    s = lambda t, q: one(spark, text.text_score(F.lit(t), q))[0]
    assert s("nothing", "c++") == 0 and s("c++ here", "C++") == 1.0
    assert s("x" * 200 + " term", "term other") == pytest.approx(0.5)
    assert s("x" * 200 + " term term", "term other") == pytest.approx(0.65)
    assert s("anything", "") == 0


def test_vectors(spark):
    a, z = vector.constant([3, 4]), vector.constant([0, 0])
    got = one(spark, vector.norm(a), vector.cosine(a, a), vector.cosine(a, z), vector.l2_normalized(a), vector.l2_normalized(z))
    assert got[0] == 5 and got[1] == pytest.approx(1) and got[2] is None and got[3] == pytest.approx([0.6, 0.8]) and got[4] == [0, 0]
    e = one(spark, vector.wave_embedding(F.lit("abc"), 768))[0]
    assert len(e) == 768 and sum(x * x for x in e) == pytest.approx(1)


@pytest.mark.parametrize("values, low, high", [([0.95, 0.96, 0.94, 0.97, 0.95, 0.96], 0.7, 0.8), ([0.85, 0.45, 0.72, 0.33, 0.91, 0.28, 0.67, 0.52], 0.6, 0.75), ([0.12, 0.08, 0.15, 0.10, 0.09, 0.14], 0.1, 0.15), ([0.9, 0.9], 0.3, 0.3)])
def test_threshold(spark, values, low, high):
    df = spark.createDataFrame([(v,) for v in values], "sim double").agg(F.count("*").alias("n"), F.avg("sim").alias("m"), F.stddev_pop("sim").alias("s"))
    t = df.select(score.threshold(F.col("n"), F.col("m"), F.col("s"), score.THRESHOLDS["other"])).first()[0]
    assert low <= t <= high


def test_adaptive_threshold():
    a = score.AdaptiveThreshold(score.THRESHOLDS["other"])
    for _ in range(30):
        t = a.update(10, 0.4, 0.1)
    assert t == pytest.approx(0.45) and a.multiplier == pytest.approx(0.5)
    a.reset()
    assert a.update(2, 0.4, 0.1) == 0.3


def test_rerank_without_metadata(spark):
    null = F.lit(None)
    got = one(spark, score.reranked(F.lit(0.8), null.cast("timestamp"), null.cast("int"), null.cast("string"), null.cast("string"), null.cast("string"), F.lit("2024-01-01").cast("timestamp")))[0]
    assert got == pytest.approx(0.56)


def test_diff(spark):
    d = one(spark, diff.content_diff(F.lit("a" * 100), F.lit("a" * 110)), diff.significant(F.lit("a" * 100), F.lit("a" * 110)), diff.change_percent(F.lit(""), F.lit("x")))
    assert d[0].significant_change is False and d[1] is True and d[2] == 100


def test_sizes(spark):
    assert [one(spark, text.human_size(F.lit(n)))[0] for n in (0, 1023, 1024, 1536, 5 << 20)] == ["0.00 B", "1023.00 B", "1.00 KB", "1.50 KB", "5.00 MB"]


def test_density_and_comments(spark):
    t = F.lit("# a\n\ncode here\n  // b")
    got = one(spark, text.content_density(t), text.comment_ratio(t), text.content_density(F.lit("")))
    assert got[0] == pytest.approx(3 / 4 * (18 / 3) / 100) and got[1] == 50 and got[2] == 0
    assert json.dumps(got)


def test_sql_functions(spark):

    assert "tf_cosine" in sql.register(spark)
    r = spark.sql("select tf_cosine(array(3D, 4D), array(3D, 4D)) a, tf_cosine(array(0D), array(1D)) b, tf_clean_path('a.ts#chunk3') c, tf_lines('a\\nb') d, tf_change_percent('', 'x') e, tf_tokens('abcde') f").first()
    assert tuple(r) == (pytest.approx(1), None, "a.ts", 2, 100.0, 2)
    store = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0]), ("z", None)], "id string, vector array<float>")
    sql.register_search(spark, store)
    assert [tuple(x) for x in spark.sql("select * from tf_search(array(1D, 0D), 0.5D)").collect()] == [("x", 1.0)]


def test_more_sql_functions(spark):
    sql.register(spark)
    r = spark.sql("select tf_significant('abcdefghij', 'abcdefghijk', 10D) a, tf_content_diff('a\\nb', 'a') b, tf_message_relevance('The Alpha', 'alpha') c, tf_message_relevance('my code', 'x') d, tf_extension('a/b.ts#chunk2') e").first()
    assert r.a and r.c == 0.9 and r.d == 0.7 and r.e == "ts"
    assert r.b == one(spark, diff.content_diff(F.lit("a\nb"), F.lit("a")))[0]
    t = datetime.datetime(2024, 1, 1)
    rows = [("c", v, "x" * v, "updated" if v > 1 else "created", t) for v in (1, 2, 3)] + [("d", 1, "y", "created", t)]
    sql.register_history(spark, spark.createDataFrame(rows, "chunk_id string, version int, content string, change_type string, changed_at timestamp"))
    assert [x.version for x in spark.sql("select * from tf_chunk_history('c', 2) order by version desc").collect()] == [3, 2]
    found = {x.field: (x.value1, x.value2, x.different) for x in spark.sql("select * from tf_compare_versions('c', 1, 3)").collect()}
    assert found == {"content": ("x", "xxx", True), "content_length": ("1", "3", True), "change_type": ("created", "updated", True)}
    assert spark.sql("select * from tf_compare_versions('d', 1, 2)").collect() == []


def test_threshold_stats():
    a = score.AdaptiveThreshold(score.THRESHOLDS["other"])
    assert a.stats() == {"samples": 0, "rounds": 0, "multiplier": 0.5, "mean": None, "std": None, "threshold": None} or a.stats()["multiplier"] == a.params.multiplier
    t = a.update(10, 0.5, 0.1)
    assert a.stats()["rounds"] == 1 and a.stats()["threshold"] == t and a.stats()["mean"] == 0.5
    a.reset()
    assert a.stats()["samples"] == 0


def test_summary(spark):
    found = one(spark, *(text.summary(F.lit(c).cast("string"), F.lit(k)) for c, k in (("class A {}\nfunction b() {}", "code"), ("One thing. And  more", "doc"), ("no end\n here", "doc"), ("x" * 200, "other"), (None, "doc"))))
    assert found == ("Declares A, b", "One thing.", "no end here", "x" * 150 + "...", None)
