import datetime
import gzip
import json
import math
from base64 import b64encode

import pytest
from pyspark.sql import functions as F

from tarnforge.operators import analysis, chunking, compression, graph, metrics, search, stats, store
from tarnforge.sources import files, providers


def test_word_chunks_match_the_loop(spark):
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (0, 1, 9, 10, 11, 18, 19, 100)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r.c for r in df.select("id", chunking.word_chunks(F.col("text"), 10, 2).alias("c")).collect()}
    assert got == {i: chunking.by_words(t, 10, 2) for i, t in enumerate(texts)}
    for overlap in (10, 11):
        with pytest.raises(ValueError):
            chunking.word_chunks(F.col("text"), 10, overlap)
        with pytest.raises(ValueError):
            chunking.by_words("a", 10, overlap)


def test_paragraphs_and_documentation():
    assert chunking.paragraphs("aa\n\nbb\n \n" + "c" * 9, 6) == ["aa\n\nbb", "c" * 9]
    doc = "# One\ntext\n## Two\n" + "\n".join(f"line {i}" for i in range(40))
    parts = chunking.documentation(doc, 100, 100)
    assert parts[0] == "# One\ntext" and parts[1].startswith("## Two") and all(f"line {i}" in "\n".join(parts) for i in range(40))
    assert parts[2].split("\n")[:2] == parts[1].split("\n")[-2:]


def test_configuration():
    small = '{"a": 1}'
    assert chunking.configuration(small, 10) == [small]
    big = json.dumps({"a": {"x": "1" * 30, "y": [1, 2]}, "b": ["z" * 40, "w"]})
    parts = [json.loads(p) for p in chunking.configuration(big, 12)]
    assert {"a.x": "1" * 30} in parts and {"b.0": "z" * 40} in parts
    assert chunking.configuration("---\na: 1\n" * 20, 10)[:2] == ["a: 1", "a: 1"]


TS = """import x from 'y';
export function one(a: string) {
  if (a) { return "}"; }
  return 1;
}
const two = (b) => {
  return b;
};
class Three {
  four() { return 4; }
}
interface Five { a: string }
"""
PY = "import os\n\ndef f(a):\n    return a\n\nclass B(object):\n    x = 1\n\n    def m(self):\n        return 2\n\nasync_ = 3\n"


def test_symbols():
    assert chunking.symbols(TS) == [("function", "one", 2, 5), ("function", "two", 6, 8), ("class", "Three", 9, 11), ("method", "four", 10, 10), ("interface", "Five", 12, 12)]
    assert chunking.symbols(PY) == [("function", "f", 3, 4), ("class", "B", 6, 10), ("method", "m", 9, 10)]


def test_code_chunks_lose_nothing():
    text = TS * 40
    parts = chunking.intelligent(text, "code", 200, 20)
    assert sum(p.startswith("class Three") for p in parts) == 40 and sum("import x" in p for p in parts) == 40
    assert chunking.intelligent("short", "code") == ["short"] and chunking.intelligent("", None) == [""]


def test_imports(spark):
    got = spark.range(1).select(chunking.imports(F.lit(TS)).alias("a"), chunking.imports(F.lit("from a.b import c\nimport os")).alias("b")).first()
    assert got.a == ["y"] and sorted(got.b) == ["a.b", "os"]


def test_compression(spark):
    rows = [(1, "x" * 10_240), (2, "é" * 6_000), (3, None), (4, "")]
    out = {r.id: r for r in compression.compressed(spark.createDataFrame(rows, "id long, content string")).collect()}
    assert [out[i].is_compressed for i in (1, 2, 3, 4)] == [False, True, False, False] and out[2].original_size_bytes == 12_000
    assert out[2].content == b64encode(gzip.compress(("é" * 6_000).encode(), mtime=0)).decode()
    odd = spark.createDataFrame([("no base64!", True), (b64encode(b"plain").decode(), True)], "content string, is_compressed boolean")
    assert sorted(r.content for r in compression.decoded(odd).collect()) == sorted(["no base64!", b64encode(b"plain").decode()])


@pytest.mark.parametrize(
    "path, rules, hit",
    [("src/a.ts", [], False), ("node_modules/x/a.js", [], True), ("a/node_modules/x.js", [], True), ("x.log", [], True), ("x.log", ["!x.log"], False), ("docs/a/b.md", ["docs/**/*.md"], True), ("docs/a.md", ["docs/**/*.md"], True), ("other/docs/a.md", ["/docs/"], False), ("tmp/a", ["tmp"], True), ("a/b/tmpx", ["tmp"], False), ("a.c", ["*.[ch]"], True), ("build/.ragignore", [], False), ("a?b", ["a\\?b", "# note", ""], True)],
)
def test_ignored(spark, path, rules, hit):
    rules = [r.replace("\\", "") for r in rules]
    assert spark.range(1).select(files.ignored(F.lit(path), rules)).first()[0] is hit


def test_scan(spark, tmp_path):
    for name, body in {"a.ts": "const a = 1234567;", "b/c.md": "# some text here", "d.md": "short", ".hidden/x.md": "hidden text here", "node_modules/m.js": "ignored text here", "e.bin": "not in the globs here", "f.log": "x" * 50}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text(body)
    found = files.scan(spark, str(tmp_path))
    assert {(r.relative_path, r.content) for r in found.collect()} == {("a.ts", "const a = 1234567;"), ("b/c.md", "# some text here")}
    assert {(r.extension, r.files) for r in files.extensions(found).collect()} == {("ts", 1), ("md", 1)}


def test_project_rules(spark, tmp_path):
    assert files.project_rules(spark, str(tmp_path)) == []
    (tmp_path / files.RULE_FILE).write_text("# note\n\n*.md\n!keep.md\n")
    for n in ("a.md", "keep.md", "b.ts"):
        (tmp_path / n).write_text("long enough to keep")
    rules = files.project_rules(spark, str(tmp_path))
    assert rules == ["*.md", "!keep.md"]
    assert {r.relative_path for r in files.scan(spark, str(tmp_path), rules=rules).collect()} == {"keep.md", "b.ts"}


def test_graph_file_and_missing_entity(spark, tmp_path):
    e = spark.createDataFrame([("a", "t", ["x", "x", "y"]), ("b", "t", [])], "name string, entityType string, observations array<string>")
    r = spark.createDataFrame([("a", "b", "k")], "`from` string, `to` string, relationType string")
    files.write_graph(e, r, str(tmp_path / "g"))
    e2, r2 = files.read_graph(spark, str(tmp_path / "g"))
    assert sorted(map(tuple, e2.collect())) == sorted(map(tuple, e.collect())) and r2.collect() == r.collect()
    assert files.read_graph(spark, str(tmp_path / "none"))[0].collect() == []
    gone = spark.createDataFrame([("a", ["y"])], "name string, contents array<string>")
    assert {x.name: x.observations for x in graph.delete_observations(e, gone).collect()} == {"a": ["x", "x"], "b": []}
    with pytest.raises(KeyError):
        graph.add_observations(e, spark.createDataFrame([("z", ["y"])], "name string, contents array<string>"))


def test_project_tables(spark, tmp_path):
    assert files.init_tables(spark, str(tmp_path)) == list(files.TABLES)
    assert files.init_tables(spark, str(tmp_path)) == []
    assert spark.read.parquet(str(tmp_path / "llm_cache")).columns == ["key", "value", "created_at", "expires_at"]


def test_metrics_exports_and_histogram(spark, tmp_path):
    m = spark.createDataFrame([(0.9, 'a "q"'), (0.8, "b"), (0.7, "c"), (0.95, "d"), (0.6, "e")], "score double, name string")
    q = metrics.quality(m).first()
    assert (q.n, q.mean, q.median, q.least, q.greatest) == (5, pytest.approx(0.79), 0.8, 0.6, 0.95)
    h = metrics.histogram(m).collect()
    assert len(h) == 5 and sum(r.n for r in h) == 4
    assert sum(r.n for r in metrics.histogram(m, inclusive=True).collect()) == 5
    assert sum(r.n for r in metrics.histogram(m.where("score = 0.9")).collect()) == 0 and metrics.histogram(m.limit(0)).collect() == []
    metrics.as_csv(m, str(tmp_path / "c"))
    body = "".join(p.read_text() for p in (tmp_path / "c").glob("*.csv"))
    assert '"a ""q"""' in body
    metrics.as_json(m, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 5


def test_providers(spark):
    df = spark.createDataFrame([("1", "same"), ("2", "same"), ("3", None)], "id string, content string")
    own = {r.id: r.vector for r in providers.embedded(df, 16).collect()}
    assert own["1"] == own["2"] and len(own["3"]) == 16
    given = {r.id: r.vector for r in providers.embedded(df, provider=lambda texts: [[float(len(t)), 1.0] for t in texts]).collect()}
    assert given == {"1": [4, 1], "2": [4, 1], "3": [0, 1]}
    assert providers.rendered("a {{x}} {{y}}", {"x": "1"}) == "a 1 {{y}}"
    assert providers.valid_output('{"a": 1}', ["a"]) == {"a": 1} and providers.valid_output("[]", []) is None and providers.valid_output("{", []) is None
    assert providers.enriched(df.where("content is not null")).first().keywords == ["same"]


def test_upsert_keeps_what_an_update_does_not_touch(spark):
    schema = "id string, file_path string, content string, version int"
    old = spark.createDataFrame([("1", "a", "x", 3), ("2", "b", "y", 1)], schema)
    new = spark.createDataFrame([("2", "bb", None, 9), ("3", "c", "z", 1)], schema)
    assert sorted(map(tuple, store.upsert(old, new).collect())) == [("1", "a", "x", 3), ("2", "b", None, 1), ("3", "c", "z", 1)]


def test_empty_project(spark):
    s = spark.createDataFrame([], "project_path string, file_path string, content_type string, created_at timestamp, updated_at timestamp")
    r = stats.project_stats(s, "none").first()
    assert r.chunks == 0 and r.by_type == {} and r.first_created is None


def test_for_queries_in_blocks(spark):
    import numpy as np

    g = np.random.default_rng(2)
    v = g.normal(size=(300, 8))
    rows = [(i, [float(x) for x in v[i % 290]]) for i in range(300)] + [(900, None)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    out = search.for_queries(df.where("id % 20 = 0").withColumnRenamed("id", "query_id"), df, 4, block=4)
    got = {}
    for r in out.collect():
        got.setdefault(r.query_id, []).append((-round(r.sim, 9), r.id))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q, found in got.items():
        sims = sorted((-round(float(u[i % 290] @ u[q % 290]), 9), i) for i in range(300))[:4]
        assert sorted(found) == sims
    assert len(got) == 15
    assert search.for_queries(df.limit(0).withColumnRenamed("id", "query_id"), df).collect() == []


def test_clamp():
    assert [search.clamp_limit(x) for x in (None, 0, 5, 500)] == [20, 1, 5, 50]


def test_bucketed_upsert(spark, tmp_path):
    schema = "id string, file_path string, content string, version int"
    rows = [(f"i{i}", "a", f"x{i}", 1) for i in range(200)]
    kept = store.BucketStore(spark, str(tmp_path / "store"))
    kept.write(spark.createDataFrame(rows, schema), 16)
    before = kept.read()
    new = spark.createDataFrame([("i3", "b", "new", 9), ("n1", "c", "added", 1)], schema)
    assert 1 <= kept.upsert(new) <= 2
    want = {r[0]: r for r in rows} | {"i3": ("i3", "a", "new", 1), "n1": ("n1", "c", "added", 1)}
    for _ in range(2):
        got = kept.read().collect()
        assert len(got) == 201 and {r.id: tuple(r) for r in got} == want
        kept.upsert(new)
    assert {tuple(r) for r in before.collect()} == set(rows)  # a reader of the store before
    assert kept.upsert(new.limit(0)) == 0
    assert kept.swept() >= 1 and {r.id: tuple(r) for r in kept.read().collect()} == want and kept.swept() == 0


def test_failed_upsert_leaves_the_store(spark, tmp_path, monkeypatch):
    schema = "id string, file_path string, content string, version int"
    kept = store.BucketStore(spark, str(tmp_path / "store"))
    kept.write(spark.createDataFrame([("a", "f", "x", 1)], schema), 4)

    def fails(*_):
        raise OSError("no room")

    monkeypatch.setattr(store.storage, "put_new", fails)
    with pytest.raises(OSError):
        kept.upsert(spark.createDataFrame([("a", "f", "y", 1)], schema))
    assert [r.content for r in kept.read().collect()] == ["x"]


def test_plan_of_a_bucketed_store(spark, tmp_path):
    """Readers make one scan after any number of upserts; small folders are put together."""
    schema = "id string, file_path string, content string, version int"
    kept = store.BucketStore(spark, str(tmp_path / "store"))
    kept.write(spark.createDataFrame([(f"i{i}", "f", "x", 1) for i in range(40)], schema), 8)
    size = lambda: len(kept.read()._jdf.queryExecution().optimizedPlan().toString().split("\n"))
    first = size()
    for i in range(5):
        kept.upsert(spark.createDataFrame([(f"i{i}", "f", f"new {i}", 1)], schema))
    want = sorted(map(tuple, kept.read().collect()))
    assert size() == first and sum(r[2].startswith("new") for r in want) == 5
    before = kept.read()
    assert kept.compacted() > 1 and kept.compacted() == 0
    assert sorted(map(tuple, kept.read().collect())) == want == sorted(map(tuple, before.collect()))
    kept.swept()
    assert sorted(map(tuple, kept.read().collect())) == want and len(list((tmp_path / "store").glob("part=*"))) == 1


def test_two_writers(spark, tmp_path, monkeypatch):
    """The one that comes second fails by name and leaves what the first has written."""
    schema = "id string, file_path string, content string, version int"
    row = lambda x: spark.createDataFrame([("a", "f", x, 1)], schema)
    kept, other = (store.BucketStore(spark, str(tmp_path / "store")) for _ in range(2))
    kept.write(row("x"), 4)
    put = store.BucketStore._put

    def late(self, rows, buckets):
        folder = put(self, rows, buckets)
        if self is kept:
            other.upsert(row("first"))
        return folder

    monkeypatch.setattr(store.BucketStore, "_put", late)
    with pytest.raises(store.StaleStore):
        kept.upsert(row("second"))
    assert [r.content for r in kept.read().collect()] == ["first"]


def test_upsert_with_repeats_and_nulls(spark):
    schema = "id string, content string, version int, updated_at timestamp"
    t = [datetime.datetime(2024, 1, i) for i in (1, 2, 3)]
    old = spark.createDataFrame([("a", "old", 1, t[0]), ("b", "old", 1, t[0]), (None, "none", 1, t[0])], schema)
    new = spark.createDataFrame([("a", "x", 7, t[1]), ("a", "last", 7, t[2]), ("a", "y", 7, None), ("c", "p", 2, t[1]), ("c", "q", 2, t[1])], schema)
    want = [(None, "none", 1), ("a", "last", 1), ("b", "old", 1), ("c", "q", 2)]
    assert sorted((tuple(r)[:3] for r in store.upsert(old, new).collect()), key=str) == sorted(want, key=str)
    assert store.upsert(old, new.limit(0)).count() == 3 and store.upsert(old.limit(0), new).count() == 2


def test_graph_with_repeats(spark):
    e = spark.createDataFrame([("n", "t", ["a"])], "name string, entityType string, observations array<string>")
    more = spark.createDataFrame([("n", ["b", "a"]), ("n", ["c", "b"]), ("n", None)], "name string, contents array<string>")
    (row,) = graph.add_observations(e, more).collect()
    assert sorted(row.observations) == ["a", "b", "c"] and row.observations[0] == "a"
    (row,) = graph.delete_observations(graph.add_observations(e, more), more).collect()
    assert row.observations == []
    twice = spark.createDataFrame([("m", "t", []), ("m", "u", []), ("n", "t", [])], e.schema)
    assert sorted(r.name for r in graph.create_entities(e, twice).collect()) == ["m", "n"]


def test_pairwise_covers_all_pairs(spark):
    import math
    import random
    import statistics

    import __spark_entry__ as entry

    r = random.Random(7)
    rows = [("abc"[i % 3], i, [r.gauss(0, 1) for _ in range(5)]) for i in range(150)]
    rows += [("a", 3, [1.0] * 5), ("a", 200, [0.0] * 5), ("a", 201, None), ("a", 202, [1.0, 2.0]), ("b", 203, [1.0, None, 0.0, 0.0, 0.0])]
    rows += [("d", 1, [1.0]), ("e", 1, [1.0]), ("e", 2, [-1.0]), ("f", 1, None), ("f", 2, None), (None, 1, [1.0]), (None, 2, [1.0]), ("e", None, [1.0])]

    def distance(u, v):
        if not u or not v or len(u) != len(v) or None in u + v or not any(u) or not any(v):
            return None
        return 1 - sum(x * y for x, y in zip(u, v)) / math.hypot(*u) / math.hypot(*v)

    def brute(rows, label):
        own = [(i, v) for k, i, v in rows if k == label and i is not None]
        all_pairs = [distance(u, v) for x, u in own for y, v in own if x < y]
        s = [x for x in all_pairs if x is not None]
        return (len(all_pairs), min(s), max(s), sum(s) / len(s), statistics.stdev(s) if len(s) > 1 else None) if s else (len(all_pairs), None, None, None, None)

    df = spark.createDataFrame(rows, "label string, id long, vector array<double>")
    for block in (7, 1024):
        got = {x.label: tuple(x)[1:] for x in stats.pairwise(df, block).collect()}
        assert set(got) == set("abcef")
        for label, found in got.items():
            assert found == pytest.approx(brute(rows, label), abs=1e-9)
    assert stats.pairwise(df.limit(0)).collect() == []
    d = "/root/testdata/sf0.01"
    n = {x.label: x["count"] for x in spark.read.parquet(f"{d}/embeddings.parquet").groupBy("label").count().collect()}
    assert {x.label: x.pairs for x in entry.queries()["pairwise_stats"](spark, d).collect()} == {k: v * (v - 1) // 2 for k, v in n.items()}


def test_compared_means_are_exact(spark, monkeypatch):
    """Equal means are even however the rows lie; null queries, nulls, NaN, infinities and far values are as SQL has them."""
    import random
    from fractions import Fraction

    monkeypatch.setattr(metrics, "TOGETHER", 2)
    draw = random.Random(5)
    values = {q: [round(draw.uniform(0, 600), 2) for _ in range(40)] for q in range(30)}
    a = [(q, v) for q, vs in values.items() for v in vs]
    b = [(q, v) for q, vs in values.items() for v in vs * 3]
    draw.shuffle(a), draw.shuffle(b)
    a += [(100, 1e308), (100, 1.0), (100, -1e308), (101, 5e-324), (102, None), (103, float("nan")), (104, float("inf")), (104, float("-inf")), (105, float("inf")), (None, 2.0), (106, 1e308), (106, 1e308)]
    b += [(100, 0.3), (101, 0.0), (102, -1.0), (103, 1.0), (104, float("nan")), (105, 1e300), (None, 4.0), (107, -1.0), (107, None)]
    half = lambda rows: spark.createDataFrame([(q, i, v) for i, (q, v) in enumerate(rows)], "query_id long, id long, points double").repartition(5)
    found = [tuple(r) for r in metrics.compared(half(a), half(b)).collect()]
    got = {r[0]: r[1:] for r in found if r[0] is not None}
    for q, vs in values.items():
        mean = float(sum(map(Fraction, vs)) / len(vs))
        assert got[q] == (pytest.approx(mean, abs=1e-9), 40, pytest.approx(mean, abs=1e-9), 120, "even"), q
    assert got[100][1:] == (3, 0.3, 1, "a")
    assert got[101] == (5e-324, 1, 0.0, 1, "a")
    assert got[102] == (0.0, 1, -1.0, 1, "a")
    assert math.isnan(got[103][0]) and got[103][1:] == (1, 1.0, 1, "a")
    assert math.isnan(got[104][0]) and math.isnan(got[104][2]) and got[104][4] == "even"
    assert got[105] == (float("inf"), 1, 1e300, 1, "a")
    assert got[106] == (1e308, 2, 0.0, 0, "a") and got[107] == (0.0, 0, -1.0, 2, "a")
    assert sorted(r[1:] for r in found if r[0] is None) == [(0.0, 0, 4.0, 1, "b"), (2.0, 1, 0.0, 0, "a")]


def test_contained_names(spark, monkeypatch):
    """Names inside of words, whatever the case, with a file's chunks in several parts."""
    monkeypatch.setattr(analysis, "TOGETHER", 2)
    names = ["alpha", "pha", "Beta", "", None, "betamax", "é", "alpha"]
    codes = ["ALPHABET betaMAX", "beta", "", None, "xÉx pha", "alph", "nothing", "Alpha é"]
    rows = [(f, i + 10 * (f == "g"), n, c) for f in ("f", "g") for i, (n, c) in enumerate(zip(names, codes, strict=True))]
    want = sorted((a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] != b[1] and b[2] and b[2].lower() in (a[3] or "").lower())
    df = spark.createDataFrame(rows, "file string, id long, name string, code string")
    assert sorted(map(tuple, analysis.contained(df).collect())) == want and len(want) > 10
    assert analysis.contained(df.limit(0)).collect() == []


def test_view_state(spark, tmp_path):
    """A refresh reads the log and the state alone, and gives what the store would."""
    schema = "id string, project_path string, file_path string, language string, file_extension string, file_size_bytes int, lines_count int, is_compressed boolean, original_size_bytes int"
    row = lambda i, p, **k: tuple(({"id": i, "project_path": p, "file_path": f"f{i}", "language": "x", "file_extension": "ts", "file_size_bytes": 7, "lines_count": 3, "is_compressed": True, "original_size_bytes": 21} | k).values())
    frame = lambda rows: spark.createDataFrame(rows, schema)
    old = [row("1", "p"), row("2", "p", language=None), row("3", "p", is_compressed=False), row("4", "q"), row("5", None), row("6", "z", file_size_bytes=None, lines_count=None, original_size_bytes=0)]
    new = [row("1", "p", language="y", file_size_bytes=9), row("2", "q"), row("3", "p", is_compressed=False), row("5", None), row("6", "z", file_size_bytes=None, lines_count=None, original_size_bytes=0), row("7", "n")]
    state = stats.ProjectViewState(spark, str(tmp_path / "view"))
    state.build(frame(old))
    rounded = lambda df: sorted((tuple(round(x, 8) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)
    same = lambda store: rounded(state.view()) == rounded(stats.project_view(store).select(state.view().columns))
    assert same(frame(old))
    log = stats.signed(frame(old), frame(new))
    assert sorted((r.id, r.sign) for r in log.collect()) == [("1", -1), ("1", 1), ("2", -1), ("2", 1), ("4", -1), ("7", 1)]
    state.refresh(log)
    assert same(frame(new))
    state.refresh(log.limit(0))
    assert same(frame(new))
    state.refresh(frame(new).withColumn("sign", F.lit(-1)))
    assert state.view().collect() == []


def test_contained_pairs_are_not_shuffled(spark):
    """What is shuffled does not grow with the pairs: all chunks have the name of all. Codes are shuffled once."""
    df = spark.createDataFrame([("f", i, "shared", "a shared name") for i in range(300)], "file string, id long, name string, code string")
    found = analysis.contained(df)
    assert found.count() == 300 * 299
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "Exchange" not in plan[: plan.index("FlatMapCoGroupsInArrow")]
    lines = plan.split("\n")
    assert sum("Exchange" in a and "code#" in b for a, b in zip(lines, lines[1:])) == 1


@pytest.mark.parametrize("most", [1, 2, 1000])
def test_contained_with_repeated_ids(spark, monkeypatch, most):
    """Ids in several rows and files give each pair once; null ids and files none; names and their owners are dealt over tasks."""
    for what in ("TOGETHER", "NAMES", "OWNERS", "PIECE"):
        monkeypatch.setattr(analysis, what, most)
    rows = [("f", 1, "alpha", "beta alpha"), ("f", 1, "beta", "gamma beta"), ("f", 2, "alpha", "beta alphabeta"), ("g", 2, "alpha", "alpha beta"), ("g", 1, "alpha", "alpha"), ("f", 2, "alpha", "beta alphabeta")]
    rows += [("f", 3, "beta", "alpha"), ("f", None, "pha", "alpha"), (None, 4, "alpha", "beta"), (None, 5, "beta", "alpha"), ("f", 6, "gamma", None), ("f", 7, None, "gamma"), ("g", 8, "", "alpha")]
    rows += [("h", i, f"n{i % 5}", f"n{i % 3} n{i % 4}") for i in range(20, 40)]
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] and a[0] == b[0] and a[1] and b[1] and a[1] != b[1] and b[2] and b[2].lower() in (a[3] or "").lower()}
    for kind in ("long", "string"):
        df = spark.createDataFrame(rows, "file string, id long, name string, code string").withColumn("id", F.col("id").cast(kind)).repartition(3)
        assert sorted((int(x), int(y)) for x, y in analysis.contained(df).collect()) == sorted(want) and len(want) > 50
