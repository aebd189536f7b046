"""Models, the enricher, a project's state, the log, and stores on any file system."""

import datetime
import json
import time

import pytest

from tarnforge import project
from tarnforge.api import Engine, Tools, as_lines, as_records, as_report, tool
from tarnforge.log import Log
from tarnforge.operators import stats
from tarnforge.operators import store as stores
from tarnforge.operators.search import Filters
from tarnforge.sources import files, models, providers, storage
from tarnforge.sources.models import Enricher, ModelError, Prompt, Prompts, Service


def echo(prompts):
    return [p[-5:] for p in prompts]


def test_prompts():
    known = Prompts([Prompt("a", "A", "x {{content}}", ("t", "u")), Prompt("b", "B", "y", ("t",), enabled=False)])
    assert known.get("b").name == "B" and known.named("B") is None and known.named("A").id == "a"
    assert [p.id for p in known.tagged("t")] == ["a"] and known.tagged("t", "v") == []
    known.enable("b")
    assert [p.id for p in known.tagged("t")] == ["a", "b"]
    assert {p.id for p in models.LIBRARY.tagged("enrichment")} == {"summary", "keywords", "entities", "complexity"}


def test_service():
    s = Service(echo, "m", lambda: ["m"], max_chars=10)
    assert s.available() and s.generate("hello") == "hello" and s.analysed("summary", "x" * 20) == "[cut]"
    assert not Service(echo, "m", lambda: ["n"]).available() and not Service(None).available() and not Service(echo, enabled=False).available()
    for bad in (Service(None), Service(echo, enabled=False), Service(lambda p: [])):
        with pytest.raises(ModelError):
            bad.generate("x")
    with pytest.raises(ModelError):
        s.analysed("none", "x")
    with pytest.raises(ModelError, match="no answer"):
        Service(lambda p: time.sleep(1) or ["late"], timeout=0.05).generate("x")

    def picky(prompts):
        if any("bad" in p for p in prompts):
            raise ValueError("bad")
        return ["ok"] * len(prompts)

    assert Service(picky, batch=2).analysed_all("summary", [("a", "t"), ("bad", "t"), ("b", "t")]) == ["ok", None, "ok"]


def test_enricher_settings(monkeypatch):
    assert Enricher.of(temperature=2, features=["summary"]).features == ("summary",)
    with pytest.raises(ValueError, match="temperature.*batch_size.*no such provider.*no such feature"):
        Enricher.of(temperature=3, batch_size=0, provider="x", features=["y"])
    with pytest.raises(TypeError):
        Enricher.of(odd=1)
    for k, v in (("ENABLED", "true"), ("MAX_TOKENS", "7"), ("TEMPERATURE", "warm"), ("FEATURES", "topics,summary")):
        monkeypatch.setenv(f"TARNFORGE_ENRICHER_{k}", v)
    e = Enricher.read()
    assert (e.enabled, e.max_tokens, e.temperature, e.features) == (True, 7, 0.1, ("topics", "summary")) and json.loads(e.as_json())["max_tokens"] == 7


def test_enriched(spark):
    def answers(prompts):
        return ['{"summary": "s"}' if "Summarise" in p else '{"keywords": 3}' if "bad" in p else '{"keywords": ["k"], "more": 1}' for p in prompts]

    df = spark.createDataFrame([(1, "code", "x = 1"), (2, None, "bad"), (3, "code", " "), (None, "code", "x"), (5, "code", None)], "id long, kind string, content string")
    out = {r.id: r for r in models.enriched(df, Enricher.of(enabled=True, features=["summary", "keywords"]), Service(answers)).collect()}
    assert json.loads(out["1"].answer) == {"keywords": ["k"], "summary": "s"} and out["1"].problems == []
    assert out["2"].problems == ["keywords is of the wrong kind"]
    assert out["3"].problems == out["5"].problems == ["content is empty"] and out[None].problems == ["id is missing"]
    off = models.enriched(df, Enricher(), Service(answers)).collect()
    assert {tuple(r.problems) for r in off} == {("enrichment is disabled",)}


def test_offline_keywords(spark):
    texts = ["some some word word word here", "", None, "a bb ccc", "Zeta zeta alpha beta beta", "x" * 5000 + " " + "tail " * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    got = {r.id: r.keywords for r in providers.enriched(df).collect()}
    assert got == {0: ["word", "some", "here"], 1: [], 2: [], 3: [], 4: ["beta", "zeta", "alpha"], 5: ["tail", "x" * 5000]}


def test_project(spark, tmp_path):
    path, registry = str(tmp_path / "p"), str(tmp_path / "reg")
    assert project.state(spark, path).errors == ["there is no configuration"]
    bad = project.initialise(spark, path)
    assert bad.status == "error" and bad.steps[0].error and not bad.state.initialised
    (tmp_path / "p").mkdir()
    first = project.initialise(spark, path, "full", now="2024-01-01", registry=registry)
    assert first.status == "initialised" and all(s.done for s in first.steps) and [s.name for s in first.steps][:5] == ["resolve", "folders", "settings", "tables", "project"]
    assert len(first.state.tables) == len(files.TABLES) and first.state.warnings == [] and first.state.project_id == project.project_id(path)
    assert project.registered(spark, registry)[first.state.project_id]["mode"] == "full"
    assert project.initialise(spark, path).status == "already_initialised"
    again = project.initialise(spark, path, force=True)
    assert again.status == "initialised" and again.state.mode == "default" and next(s for s in again.steps if s.name == "rules").made == []
    config = tmp_path / "p" / ".tarnforge" / "config" / "project.json"
    for text, wrong in (("{", "cannot be read"), ("[]", "cannot be read"), ('{"initialised": true, "mode": "default", "version": "2"}', "project_id")):
        storage.replace(spark, str(config), text)
        found = project.state(spark, path)
        assert not found.initialised and wrong in found.errors[0]
    (tmp_path / "q").mkdir()
    memory = project.initialise(spark, str(tmp_path / "q"), "memory-only")
    assert memory.state.initialised and memory.state.tables == []
    with pytest.raises(ValueError):
        project.initialise(spark, path, "other")


def test_log(spark):
    lines = []
    at = iter(datetime.datetime(2024, 1, 1, 0, 0, i) for i in range(60))
    log = Log(most=3, least="info", sink=lines.append, clock=lambda: next(at))
    log.debug("no")
    for i in range(4):
        log.info("e", i=i)
    log.error("bad", why="x")
    assert [e["event"] for e in log.last()] == ["e", "e", "bad"] and log.last(1)[0]["level"] == "error" and len(log.last(9, "info")) == 2 and log.last(0) == []
    assert log.counts() == {"debug": 0, "info": 2, "warn": 0, "error": 1} and len(lines) == 5 and json.loads(lines[-1])["data"] == {"why": "x"}
    assert [r.event for r in log.rows(spark).collect()] == ["e", "e", "bad"] and log.clear() == 3 and log.last() == []


def test_storage(spark, tmp_path):
    at = str(tmp_path / "d" / "f.txt")
    storage.replace(spark, at, "one é")
    storage.replace(spark, at, "two")
    assert storage.read(spark, at) == "two" and "f.txt" in storage.names(spark, str(tmp_path / "d")) and storage.names(spark, str(tmp_path / "none")) == []
    t = storage.Versioned(spark, str(tmp_path / "v"))
    assert t.path("a") is None
    t.commit(a=spark.range(3), b=spark.range(1))
    old = spark.read.parquet(t.path("a"))
    t.commit(a=spark.range(5))
    assert old.count() == 3 and spark.read.parquet(t.path("a")).count() == 5 and spark.read.parquet(t.path("b")).count() == 1
    assert t.swept() == 1 and t.swept() == 0 and spark.read.parquet(t.path("a")).count() == 5
    view = stats.materialised(spark.range(2), str(tmp_path / "m"))
    assert stats.materialised(view.unionByName(view), str(tmp_path / "m")).count() == 4 and view.count() == 2


class Source:
    @tool("one", visible=False)
    def first(self):
        return 1

    @tool("two", "other")
    def second(self):
        return 2


def test_discovered_tools():
    t = Tools()
    assert t.discover(Source()) == ["one", "two"] and t.discover(Source()) == []
    assert t.names() == ["two"] and t.names(hidden=True) == ["one", "two"] and t.execute("one") == 1 and t.names(category="other") == ["two"]
    t.show("one")
    t.alias("uno", "one")
    assert t.names() == ["one", "two"] and t.execute("uno") == 1
    with pytest.raises(KeyError):
        t.show("none")


def test_results_for_readers(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.md").write_text("# Title\n\nWords about a needle in some text.\n")
    e = Engine(spark, str(tmp_path / "store"))
    e.index(str(src), "p")
    found = e.search("needle", "text")
    assert as_lines(found, e.store(), "needle").startswith('Query: "needle"\nResults: 1\n\n1. a.md')
    report = as_report(found, e.store(), "needle", "text")
    assert "a.md" in report and "content_type: doc" in report and "   | # Title" in report
    assert "Nothing matches" in as_report(e.search("zzz", "text"), e.store(), "zzz", "text")
    assert as_records(found, e.store())[0]["file_path"] == "a.md" and e.tools.execute("search_code", query="needle", mode="text").count() == 1
    assert [x["event"] for x in e.log.last()] == ["index.start", "index.end"]
    plan = Filters(content_type="doc").apply(e.store())._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(content_type" in plan  # only the folder of that type is read
    before = e.store()
    e.index(str(src), "p")
    assert before.count() == 1 and e.swept() == 2 and e.store().count() == 1


def test_legacy_store(spark, tmp_path):
    rows = [("p:a.ts", "p", "a.ts", "let x", [1.0, 0.0]), ("p:b.md#chunk1", "p", "b.md#chunk1", "text", None)]
    old = spark.createDataFrame(rows, "id string, project_path string, file_path string, content string, vector array<float>")
    old.write.parquet(str(tmp_path / "store" / "legacy_store"))
    e = Engine(spark, str(tmp_path / "store"))
    assert {r.id: (r.content_type, r.chunk_index, r.vector) for r in e.store().collect()} == {"p:a.ts": ("code", 0, [1.0, 0.0]), "p:b.md#chunk1": ("doc", 1, None)}
    assert not stores.is_current(old) and stores.is_current(e.store())
    assert Filters(project="p").apply(old).count() == 2
    with pytest.raises(ValueError, match="content_type, language"):
        Filters(content_type="code", language="x").apply(old)
