import pytest

from tarnforge import settings, workspace
from tarnforge.api import Engine, Tools, as_text
from tarnforge.operators import analysis
from tarnforge.operators.search import Filters
from tarnforge.settings import Settings

TS = """import x from 'y';
// a note
// of two lines
export class A {
  /** Adds. */
  add(a, b) { return a && b ? a : b; }
}
function one(a) {
  if (a) { return 1; }
  return new A();
}
"""


def test_engine_round_trip(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.ts").write_text(TS)
    (src / "b.md").write_text("# Title\n\nWords about a needle in some text.\n" * 3)
    (src / "c.json").write_text('{"name": "something long"}')
    e = Engine(spark, str(tmp_path / "store"), Settings.of(chunk_size=400, chunk_overlap=50))
    assert len(e.init()) == 5 and e.projects() == []
    assert e.index(str(src), "p")["files"] == 3
    assert e.index(str(src), "p")["files"] == 3  # again: nothing doubles
    assert e.search("needle", "text").first().id == "p:b.md"
    assert e.search("needle", "semantic", threshold=-1.0, limit=2).count() == 2
    assert e.search("needle", "hybrid", threshold=-1.0, filters=Filters(content_type="code")).select("id").first().id.startswith("p:a.ts")
    (src / "b.md").write_text("# Changed\n\nNo such word any more, but others.\n")
    (src / "c.json").unlink()
    (src / "d.py").write_text("def needle():\n    return 1\n")
    assert e.update(str(src), "p") == {"added": 1, "modified": 1, "deleted": 1, "unchanged": 1}
    assert [r.id for r in e.search("needle", "text").collect()] == ["p:d.py"]
    assert e.update(str(src), "p")["unchanged"] == 3
    assert e.projects() == ["p"] and e.project_stats("p")["files"] == 3
    assert "d.py" in as_text(e.search("needle", "text"), e.store()) and as_text(e.search("zzz", "text"), e.store()) == "No results."
    with pytest.raises(ValueError):
        e.search("x", "other")
    assert e.tools.execute("projects") == ["p"] and e.tools.names("p", first="project_stats") == ["project_stats", "projects"]


def test_tools():
    t = Tools()
    t.register("b", lambda: 1)
    t.register("a", lambda x: x, "graph")
    assert t.names() == ["a", "b"] and t.names(category="graph") == ["a"] and t.execute("a", x=3) == 3
    with pytest.raises(ValueError):
        t.register("a", print)
    with pytest.raises(KeyError):
        t.execute("c")


def test_settings(tmp_path, monkeypatch):
    assert Settings.of(chunk_size=5, chunk_overlap=0).chunk_size == 100 and Settings.of(search_limit=0).search_limit == 1
    with pytest.raises(ValueError):
        Settings.of(chunk_size=100, chunk_overlap=100)
    with pytest.raises(TypeError):
        Settings.of(odd=1)
    (tmp_path / "s.json").write_text('{"chunk_size": 700, "other": 1}')
    monkeypatch.setenv("TARNFORGE_SEARCH_LIMIT", "99")
    s = Settings.read(str(tmp_path / "s.json"))
    assert (s.chunk_size, s.search_limit) == (700, 50)
    assert settings.valid("search_limit", 50) and not settings.valid("search_limit", 51) and settings.valid("none", 9)


def test_workspace(tmp_path, monkeypatch):
    (tmp_path / ".git").mkdir()
    (tmp_path / "s").mkdir()
    for n in ("a.py", "b.py", "c.js"):
        (tmp_path / "s" / n).write_text("")
    monkeypatch.chdir(tmp_path / "s")
    w = workspace.detect()
    assert (w.path, w.found_by, w.language, w.extensions) == (str(tmp_path), "mark", "python", {"py": 2, "js": 1})
    assert workspace.detect(str(tmp_path / "s")).found_by == "given"
    with pytest.raises(NotADirectoryError):
        workspace.detect(str(tmp_path / "none"))


def test_units(spark):
    found = {(u.kind, u.name): u for u in analysis.units("a.ts", "typescript", TS)}
    assert found["import", "import"].first == 1 and [(u.first, u.last, u.parent) for u in analysis.units("a.ts", None, TS) if u.kind == "comment"] == [(2, 3, None), (5, 5, "a.ts:class:A:4")]
    assert found["class", "A"].documentation == "Adds." and found["function", "one"].complexity == 2
    assert "complexity:low" in found["class", "A"].tags and found["class", "A"].complexity == 3
    assert analysis.complexity("def f(a):\n    if a and b or c:\n        return [x for x in a]\n", "python") == 5
    rows = analysis.unit_rows(spark.createDataFrame([("a.ts", "typescript", TS), ("e", None, None)], "path string, language string, content string"))
    nodes, edges = analysis.dependency_graph(rows)
    assert nodes.count() == 7 and {(r.target, r.type) for r in edges.collect()} == {("y", "depends_on"), ("a.ts:class:A:4", "child_of")}
    assert {r.kind: r.units for r in analysis.unit_metrics(rows).collect()} == {"import": 1, "comment": 2, "class": 1, "function": 1, "method": 1, "block": 1}
    assert analysis.accepted(rows).count() == 7
    refs = analysis.references(rows.select("file", "id", "name", "code"))
    assert ("a.ts:function:one:8", "a.ts:class:A:4") in {tuple(r) for r in refs.collect()}


def test_coherence_matches_pairs(spark):
    lines = [1, 1, 1, 30, 49, 51, 260, 260, 900]
    df = spark.createDataFrame([("f", x) for x in lines] + [("g", 5)], "file string, line int")
    score = sum(1 if abs(a - b) < 50 else 0.5 if abs(a - b) < 200 else 0 for i, a in enumerate(lines) for b in lines[i + 1 :])
    want = 100 * score / (len(lines) * (len(lines) - 1) / 2)
    assert {r.file: pytest.approx(r.coherence) for r in analysis.coherence(df).collect()} == {"f": want, "g": 100}


def test_suggestions():
    doc = "# A\none\ntwo\n\n## B\nthree\nfour"
    found = analysis.suggestions(doc, "doc")
    assert (1, 4, "section", 0.7) in found and (5, 7, "section", 0.7) in found and (1, 3, "paragraph", 0.6) in found
    assert analysis.suggestions(TS, "code")[0][2] == "class"
    long = "\n".join(f"# H{i}\n" + "words and words " * 6 for i in range(4))
    parts = analysis.optimised(long, ["x"], analysis.suggestions(long, "doc"))
    assert len(parts) == 4 and analysis.optimised("short", ["x"], []) == ["x"]


def test_quality(spark):
    df = spark.createDataFrame([("atomic", "d", 1), ("group", "", 0)], "granularity string, documentation string, relations int")
    assert tuple(analysis.quality(df).first()) == (2, 50.0, 50.0, 50.0)
    assert tuple(analysis.quality(df.limit(0)).first()) == (0, 0.0, 0.0, 0.0)


def test_class_parts():
    code = "class A {\n  x = 1;\n  a() { return 1; }\n  private b() {\n    return 2;\n  }\n  c() { }\n  d() { }\n  e() { }\n}"
    parts = analysis.class_parts(code)
    assert [k for k, _ in parts] == ["definition", "public methods", "public methods", "private methods"]
    assert parts[0][1] == "class A {\n  x = 1;\n}" and "return 2" in parts[3][1]
    py = "class B:\n    def a(self):\n        return 1\n\n    def _b(self):\n        return 2"
    assert [k for k, _ in analysis.class_parts(py)] == ["definition", "public methods", "protected methods"]


def test_problems():
    good = {"id": "a", "type": "class", "code": "x", "language": "python", "file": "f", "position": {"first": 1, "last": 2}, "quality": 50, "relevance": 60, "tokens": 3}
    assert analysis.problems(good) == [] and len(analysis.problems({})) == 8
    assert analysis.problems(good | {"position": {"first": 3, "last": 2}}) == ["lines are out of order"]


def test_answers(spark):
    from tarnforge.sources import providers

    def model(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError
        return ['{"keywords": []}' for _ in prompts]

    df = spark.createDataFrame([("1", "code", "x"), ("2", None, "bad"), ("3", "text", None)], "id string, kind string, content string")
    out = {r.id: (r.answer, r.valid) for r in providers.answered(df, "keywords", model, ["keywords"]).collect()}
    assert out == {"1": ('{"keywords": []}', True), "2": (None, False), "3": ('{"keywords": []}', True)}
    assert list(providers.prompts("summary")) == ["summary"] and len(providers.prompts(has="json")) == 3
