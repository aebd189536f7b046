"""The syntax tree, chunks by rules, and what a text suggests of its segmentation."""

import time

import pytest

from tarnforge.operators import analysis, rules, segmentation, syntax
from tarnforge.operators.rules import Options, Rule, RuleSet

TS = """import { a, b as c } from "./x";
import z from 'z'

// what f does,
// in two lines
export async function f<T>(x: number, {p, q}: P = {}, ...rest: string[]): Promise<T> {
  if (x) { return "}"; } else { g(); }
  for (const k of rest) {
    h(k);
  }
}
/** doc */
export default class A extends B implements C, D {
  private readonly n: number = 1;
  static s = `}`;
  constructor(private m: M) { this.q = 1; }
  protected static async run(a, b) { while (a) { b(); } }
  #hid(x: string): void { }
}
const add = (a, b) => a + b;
type U = | "a"
  | "b";
enum E { X, Y }
interface I extends J { k: string; }
export { add, sq as default };
export * from "q";
"""
PY = '''import os, sys as s
from a.b import (c,
  d as e)

# a note
@deco
class K(Base, metaclass=M):
    """doc of K"""
    x: int = 1

    @staticmethod
    async def m(a, *args, b: int = 3, **kw) -> dict[str, int]:
        self.z = "def q(): "
        if a:
            return 1
        else:
            return 2

    def __p(self): pass

def g(x):
    return x
# the end
'''


def named(tree, name, kind=None):
    return next(n for n in tree.nodes if n.name == name and kind in (None, n.kind))


def test_braced():
    t = syntax.Tree(TS, "typescript")
    assert [(n.kind, n.name, n.first, n.last) for n in t.nodes if n.kind not in ("export", "block")] == [
        ("import", "import", 1, 1), ("import", "import", 2, 2), ("comment", "comment", 4, 5), ("function", "f", 6, 11), ("comment", "comment", 12, 12), ("class", "A", 13, 19),
        ("method", "constructor", 16, 16), ("method", "run", 17, 17), ("method", "#hid", 18, 18), ("function", "add", 20, 20), ("type", "U", 21, 22), ("type", "E", 23, 23), ("interface", "I", 24, 24),
    ]
    assert [(n.name, n.first, n.last, n.parent.name) for n in t.nodes if n.kind == "block"] == [("if", 7, 7, "f"), ("for", 8, 10, "f")]
    f, a, run, hid = (syntax.metadata(t, named(t, x, k)) for x, k in (("f", "function"), ("A", "class"), ("run", "method"), ("#hid", "method")))
    assert f["parameters"] == ["x", "{p, q}: P = {}", "...rest"] and f["return_type"] == "Promise<T>" and f["async"] and not f["static"]
    assert a["properties"] == ["n", "s", "q"] and a["bases"] == ["B", "C", "D"] and a["methods"] == ["constructor", "run", "#hid"]
    assert run["visibility"] == "protected" and run["static"] and run["async"] and hid["visibility"] == "private" and hid["return_type"] == "void"
    assert syntax.metadata(t, named(t, "constructor"))["parameters"] == ["m"]
    assert syntax.metadata(t, t.nodes[0]) == {"modules": ["./x"], "names": ["a", "c"]} and syntax.metadata(t, t.nodes[1])["modules"] == ["z"]
    assert [syntax.metadata(t, n)["names"] for n in t.nodes if n.kind == "export"] == [["f"], ["A"], ["add", "default"], ["*"]]


def test_indented():
    t = syntax.Tree(PY)
    assert t.language == "python"
    assert [(n.kind, n.name, n.first, n.last) for n in t.nodes] == [
        ("import", "import", 1, 1), ("import", "import", 2, 3), ("comment", "comment", 5, 5), ("class", "K", 7, 19), ("method", "m", 12, 17),
        ("block", "if", 14, 17), ("method", "__p", 19, 19), ("function", "g", 21, 22), ("comment", "comment", 23, 23),
    ]
    m, k = syntax.metadata(t, named(t, "m")), syntax.metadata(t, named(t, "K"))
    assert m["parameters"] == ["a", "*args", "b", "**kw"] and m["return_type"] == "dict[str, int]" and m["static"] and m["async"] and m["decorators"] == ["staticmethod"]
    assert k["bases"] == ["Base"] and k["properties"] == ["x", "z"] and k["methods"] == ["m", "__p"] and k["decorators"] == ["deco"]
    assert syntax.visibility(t, named(t, "__p")) == "private"
    assert syntax.metadata(t, t.nodes[0]) == {"modules": ["os", "sys"], "names": ["os", "s"]} and syntax.metadata(t, t.nodes[1]) == {"modules": ["a.b"], "names": ["c", "e"]}


def test_helpers():
    t = syntax.Tree(TS, "typescript")
    f, a = named(t, "f", "function"), named(t, "A", "class")
    assert [n.name for n in syntax.walk([a])] == ["A", "constructor", "run", "#hid"]
    assert syntax.enclosing(t, 17, "method").name == "run" and syntax.enclosing(t, 14).name == "A" and syntax.enclosing(t, 3) is None
    assert [n.name for n in syntax.between(t, 20, 23)] == ["add", "U", "E"] and syntax.comment_before(t, f).first == 4
    assert syntax.contains(a, named(t, "run")) and not syntax.contains(f, a)
    assert syntax.node_complexity(t, named(t, "#hid")) == 1 + (syntax.size(t, named(t, "#hid")) > 10) and syntax.node_complexity(t, a) > 3


UNITS = [
    "function f() {\n", "if (a) {\n", "def f():\n", "((", "'", "/*", "class A {", "export const a = (\n", 'x = "\n', "type A = |\n", "  m() {\n", "a }\n",
    "class A {\n m() { if (x) { y(); } }\n}\n", "import a,\n",
]


@pytest.mark.parametrize("unit", UNITS)
def test_linear(unit):
    began = time.process_time()
    syntax.Tree(unit * 4000)
    once = time.process_time() - began
    syntax.Tree(unit * 16_000)
    assert time.process_time() - began - once < 1 + 10 * once


def test_rules():
    found = rules.chunks(TS, "typescript", Options(least_comment=10))
    assert [(c.rule, c.name) for c in found] == [
        ("import", "import"), ("import", "import"), ("comment", "comment"), ("function", "f"), ("comment", "comment"), ("class", "A"), ("function", "constructor"), ("function", "run"),
        ("function", "#hid"), ("function", "add"), ("type", "U"), ("type", "E"), ("interface", "I"), ("export", "export"), ("export", "export"),
    ]
    by = {c.name: c for c in found}
    assert by["f"].documentation == "what f does,\nin two lines" and by["A"].documentation == "doc" and by["f"].complexity == 3 and by["run"].parent == "A" and "static" in by["run"].tags
    assert not any(c.rule == "comment" for c in rules.chunks(TS, None, Options(comments=False)))
    loose = "if (a) {\n  b();\n}\nfor (;;) {\n  c();\n}\n"
    assert [c.name for c in rules.chunks(loose, "typescript", Options(granularity="logical"))] == ["if", "for"]
    assert [c.rule for c in rules.chunks(loose, "typescript")] == ["plain"]
    assert rules.chunks("", None) == []


def test_long_classes_are_parted():
    methods = "".join(f"  m{i}() {{ return {i}; }}\n" for i in range(7)) + "  private p() { return 1; }\n"
    found = rules.chunks("class Long {\n  x = 1;\n" + methods + "}\n", "typescript", Options(max_tokens=20))
    assert [c.rule for c in found] == ["class_hierarchy"] * 5 and found[0].code == "class Long {\n  x = 1;\n}" and found[-1].code.strip().startswith("private p")
    assert sum(c.code.count("return") for c in found) == 8


def test_rule_sets():
    todo = Rule("todo", 95, lambda n, _: n.kind == "comment", lambda t, n, _: [rules.Chunk("todo", "atomic", "todo", t.source(n), n.first, n.last)])
    names = lambda s: [c.rule for c in rules.chunks(TS, "typescript", Options(), s)]
    assert names(RuleSet().with_rule(todo)).count("todo") == 2 and "todo" not in names(RuleSet())
    assert "import" not in names(RuleSet().without("import")) and "type" not in names(RuleSet().enabled("type", False)) and "type" in names(RuleSet().enabled("type", False).enabled("type"))
    assert [r.name for r in RuleSet().ordered()][:3] == ["function", "class", "class_hierarchy"]


def test_filters():
    prose = "\n".join(["This is a sentence that goes on for a while and ends."] * 4)
    mixed = rules.Chunk("text", "logical", "t", prose + "\n" + "\n".join(f"a = {i};" for i in range(4)), 1, 8)
    assert rules.mixes(mixed) and not rules.mixes(rules.Chunk("text", "logical", "t", prose, 1, 4)) and not rules.passes(mixed, Options()) and rules.passes(mixed, Options(never_mix=False))
    cut = rules.Chunk("function", "atomic", "f", "function f() { if (a) {", 1, 1, tags=("typescript",))
    assert rules.cut_short(cut) and not rules.cut_short(rules.Chunk("function", "atomic", "f", "function f() { return '{'; }", 1, 1, tags=("typescript",)))
    two = rules.Chunk("block", "logical", "b", "function f() {}\nfunction g() {}\n", 1, 2, tags=("typescript",))
    assert rules.several_intents(two) and not rules.passes(two, Options()) and rules.passes(two, Options(one_intent=False))


def test_collapse_and_plain():
    body = "\n".join(f"  step{i}();" for i in range(50))
    (c,) = rules.chunks(f"function f(a) {{\n{body}\n}}\n", "typescript", Options(max_tokens=50, collapse=True))
    assert c.code == "function f(a) {\n    // ...\n}" and "collapsed" in c.tags
    py = "def f(a,\n      b):\n" + "\n".join(f"    step{i}()" for i in range(50)) + "\n"
    (c,) = rules.chunks(py, "python", Options(max_tokens=50, collapse=True))
    assert c.code == "def f(a,\n      b):\n    # ..."
    lines = [f"plain words in line {i}" for i in range(100)]
    parts = rules.chunks("\n".join(lines), None, Options(max_tokens=60))
    assert "\n".join(p.code for p in parts) == "\n".join(lines) and all(rules.tokens(p.code) <= 60 for p in parts)
    assert parts[0].first == 1 and parts[-1].last == 100


def test_chunk_rows(spark):
    df = spark.createDataFrame([("a.ts", "typescript", TS), ("e", None, None), ("f", None, "")], "path string, language string, content string")
    rows = rules.chunk_rows(df).collect()
    assert len(rows) == len(rules.chunks(TS, "typescript")) and {r.file for r in rows} == {"a.ts"}
    assert {r.kind for r in rows} <= set(analysis.PRIORITY) and rules.chunk_rows(df.limit(0)).collect() == []


def test_segmentation():
    doc = "# One\n\nfirst words\nmore words\n\n# Two\n\nlast\nof it\n"
    found = segmentation.analysed(doc, "doc")
    assert [(p.first, p.last) for p in found.parts if p.kind == "section"] == [(1, 5), (6, 10)] and found.chunk_size == 1000 and found.strategy == "structural"
    assert segmentation.analysed(TS, "code").strategy == "structural" and segmentation.analysed(TS, "code").complexity == 1.0
    config = segmentation.analysed('{"a": 1, "b": {"c": [1, 2, 3, 4, 5, 6]}, "d": 1, "e": 2}', "config")
    assert [(p.reason, p.confidence) for p in config.parts] == [("object of 4", 0.8), ("list of 6 b.c", 0.7)] and config.chunk_size == 800
    assert len(segmentation.analysed("a: 1\n---\nb: 2\n", "config").parts) == 2 and segmentation.analysed("", "config").strategy == "semantic"
    other = segmentation.analysed("a\nb\n\nc\n\nd\ne", None)
    assert [(p.first, p.last) for p in other.parts] == [(1, 2), (6, 7)] and other.chunk_size == 1200


def test_model_answers():
    answer = 'Well: {"suggestions": [{"startLine": 2, "endLine": 99, "type": "function", "confidence": 0.9}, {"startLine": 5}, 7]} ok'
    found = segmentation.parsed(answer, "\n" * 9, "code")
    assert [(p.first, p.last, p.kind) for p in found.parts] == [(2, 10, "function"), (5, 10, "logical_block")] and found.chunk_size == 800 and found.strategy == "hybrid"
    lines = segmentation.parsed("lines 3 to 5 belong together\nLine 7\nnothing 9", "\n" * 30, "doc")
    assert [(p.first, p.last) for p in lines.parts] == [(3, 5), (7, 17)] and lines.complexity == 0.4
    for odd in ("", "{", '{"suggestions": 3}', "[1]", "{}"):
        (p,) = segmentation.parsed(odd, "x", None).parts
        assert (p.first, p.last, p.reason) == (1, 1, "no answer")


def test_preprocessed():
    found = segmentation.preprocessed(TS, "typescript")
    assert [f["name"] for f in found["functions"]] == ["f", "constructor", "run", "#hid", "add"] and [c["name"] for c in found["classes"]] == ["A", "I"]
    assert found["imports"][0]["modules"] == ["./x"] and len(found["comments"]) == 2 and "what f does" not in found["bare"] and '"}"' in found["bare"]


def test_segmented(spark):
    df = spark.createDataFrame([(1, TS, "code"), (2, None, None)], "id long, content string, content_type string")
    rows = {r.id: r for r in segmentation.segmented(df).collect()}
    assert rows["1"].strategy == "structural" and rows["2"].parts == [] and len(rows["1"].parts) > 3
