"""Semantic chunks of sources by rules: objects with a name, a priority, a condition and what they make of a node.

For each node of a file's syntax tree the first rule in the order of priority that applies makes its chunks. What a rule
takes whole is not looked into; a class's members are. Chunks that break one of the filters are left out, long ones can
be collapsed to their signatures, and a file without any chunk is cut at line ends.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnforge.operators import analysis, syntax
from tarnforge.operators.syntax import Node, Tree


@dataclass(frozen=True)
class Options:
    """What a run of the chunker is to do."""

    granularity: str = "atomic"  # logical: blocks too
    comments: bool = True
    least_comment: int = 50
    max_tokens: int = 1000
    collapse: bool = False
    never_mix: bool = True
    never_split: bool = True
    one_intent: bool = True


@dataclass(frozen=True)
class Chunk:
    kind: str
    granularity: str
    name: str
    code: str
    first: int
    last: int
    parent: str | None = None
    tags: tuple[str, ...] = ()
    complexity: int = 1
    documentation: str = ""
    rule: str = ""


@dataclass(frozen=True)
class Rule:
    """``make`` gives the chunks of a node for which ``applies``; ``whole`` says that what lies inside is theirs too."""

    name: str
    priority: int
    applies: Callable[[Node, Options], bool]
    make: Callable[[Tree, Node, Options], list[Chunk]]
    whole: bool = True
    enabled: bool = True


def tokens(code: str) -> int:
    return -(-len(code) // 4)


def _documentation(tree: Tree, node: Node) -> str:
    above = syntax.comment_before(tree, node)
    own = analysis.documentation(tree.source(node)) if tree.language == syntax.PYTHON else ""
    return own or (analysis.documentation(tree.source(above)) or re.sub(r"(?m)^\s*(?://|#)\s?", "", tree.source(above)) if above else "")


def _chunk(tree: Tree, node: Node, kind: str, granularity: str, code: str | None = None, **more) -> Chunk:
    code = tree.source(node) if code is None else code
    marks = [kind, granularity, tree.language, *node.modifiers]
    return Chunk(kind, granularity, node.name, code, node.first, node.last, node.parent.name if node.parent else None, tuple(dict.fromkeys(marks)), **more)


def _declared(kind: str):
    def make(tree: Tree, node: Node, _: Options) -> list[Chunk]:
        level = analysis.complexity(tree.source(node), None)
        return [_chunk(tree, node, node.kind if kind == "function" else kind, "atomic", complexity=level, documentation=_documentation(tree, node))]

    return make


def _hierarchy(tree: Tree, node: Node, options: Options) -> list[Chunk]:
    """A long class as its definition and groups of its methods."""
    parts = analysis.class_parts(tree.source(node))
    return [_chunk(tree, node, "class", "logical", code, documentation=_documentation(tree, node) if i == 0 else "") for i, (_, code) in enumerate(parts)]


def _simple(kind: str, granularity: str):
    return lambda tree, node, _: [_chunk(tree, node, kind, granularity, complexity=syntax.node_complexity(tree, node) if kind == "block" else 1)]


def _long_class(n: Node, o: Options) -> bool:
    return n.kind == "class" and n.end - n.start > 4 * o.max_tokens and any(c.kind == "method" for c in n.children)


def _of(*kinds: str):
    return lambda n, _: n.kind in kinds


#: The rules by falling priority; more can be put among them, and any can be left out or disabled.
RULES = (
    Rule("function", 100, _of("function", "method"), _declared("function")),
    Rule("class", 90, lambda n, o: n.kind == "class" and not _long_class(n, o), _declared("class"), whole=False),
    Rule("class_hierarchy", 85, _long_class, _hierarchy),
    Rule("import", 80, _of("import"), _simple("import", "logical")),
    Rule("interface", 70, _of("interface"), _declared("interface")),
    Rule("export", 60, _of("export"), _simple("export", "logical")),
    Rule("block", 50, lambda n, o: n.kind == "block" and o.granularity == "logical", _simple("block", "logical")),
    Rule("comment", 40, lambda n, o: n.kind == "comment" and o.comments and n.end - n.start >= o.least_comment, _simple("comment", "atomic")),
    Rule("type", 30, _of("type"), _simple("type", "atomic")),
)


@dataclass(frozen=True)
class RuleSet:
    """Rules in the order in which they are tried; each change gives a new set."""

    rules: tuple[Rule, ...] = field(default=RULES)

    def with_rule(self, rule: Rule) -> RuleSet:
        return RuleSet((*(r for r in self.rules if r.name != rule.name), rule))

    def without(self, name: str) -> RuleSet:
        return RuleSet(tuple(r for r in self.rules if r.name != name))

    def enabled(self, name: str, on: bool = True) -> RuleSet:
        return RuleSet(tuple(replace(r, enabled=on) if r.name == name else r for r in self.rules))

    def ordered(self) -> list[Rule]:
        return sorted((r for r in self.rules if r.enabled), key=lambda r: (-r.priority, r.name))


# Filters: what no chunk may be.


def mixes(chunk: Chunk) -> bool:
    """Prose and code in one chunk: both at least three lines and a third of it. Comments and doc strings are neither."""
    bare = re.sub(r"/\*.*?\*/|(\"{3}|'{3}).*?\1|(?m:^\s*(?://|#).*$)", "", chunk.code, flags=re.S) if chunk.kind != "text" else chunk.code
    lines = [x for x in bare.split("\n") if x.strip()]
    coded = sum(bool(re.search(r"[;{}()=]|^\s*(?:def|class|import|from|return)\b", x)) for x in lines)
    prose = sum(bool(re.match(r"^\s*[A-Z][^;{}()=]{20,}[.!?]$", x)) for x in lines)
    return coded >= 3 and prose >= 3 and 3 * min(coded, prose) >= len(lines)


def cut_short(chunk: Chunk) -> bool:
    """A declaration whose brackets do not close."""
    if chunk.kind not in ("function", "method", "class", "interface") or chunk.granularity != "atomic":
        return False
    tree = Tree(chunk.code, syntax.PYTHON if syntax.PYTHON in chunk.tags else "typescript")
    return sum(tree.code.count(c) for c in "([{") != len(tree.pairs) or sum(tree.code.count(c) for c in ")]}") != len(tree.pairs)


def several_intents(chunk: Chunk) -> bool:
    """More than one outermost declaration in a chunk that is to be one thing."""
    if chunk.kind in ("import", "comment", "text") or chunk.granularity == "logical" and chunk.kind == "class":
        return False
    tree = Tree(chunk.code, syntax.PYTHON if syntax.PYTHON in chunk.tags else "typescript")
    own = [n for n in tree.nodes if n.parent is None and n.kind in ("function", "class", "interface", "type")]
    return len(own) > 1


def passes(chunk: Chunk, options: Options) -> bool:
    return not (options.never_mix and mixes(chunk) or options.never_split and cut_short(chunk) or options.one_intent and several_intents(chunk))


# What is too long, and what has no declarations.


def collapsed(chunk: Chunk) -> Chunk:
    """A function as its head, a mark and its last line; a class as its head and the heads of its methods."""
    tree = Tree(chunk.code, syntax.PYTHON if syntax.PYTHON in chunk.tags else "typescript")
    mark = "    # ..." if tree.language == syntax.PYTHON else "    // ..."
    top = next((n for n in tree.nodes if n.kind in ("class", "function", "method") and n.parent is None), None)
    lines = chunk.code.split("\n")

    def head(first: int, last: int) -> list[str]:
        """Lines up to the one that opens the body."""
        ends = ":" if tree.language == syntax.PYTHON else "{"
        for i in range(first, last + 1):
            if lines[i - 1].split("#" if ends == ":" else "//")[0].rstrip().endswith(ends):
                return lines[first - 1 : i]
        return lines[first - 1 : first]

    if top is None or len(lines) <= 5:
        return chunk
    out = head(top.first, top.last)
    if top.kind == "class":
        for c in top.children:
            if c.kind == "method":
                out += [*head(c.first, c.last), "    " + mark]
    else:
        out.append(mark)
    if lines[-1].strip() in ("}", "};", "})", "});"):
        out.append(lines[-1])
    return replace(chunk, code="\n".join(out), tags=(*chunk.tags, "collapsed"))


def plain(text: str, language: str | None, options: Options) -> list[Chunk]:
    """A text at its line ends, in pieces of at most ``max_tokens``; a longer line is a piece of its own."""
    out, held, n, first = [], [], 0, 1

    def close(last: int):
        if any(x.strip() for x in held):
            out.append(Chunk("text", "logical", "text", "\n".join(held), first, last, None, ("text", language or "unknown"), rule="plain"))

    for i, line in enumerate(text.split("\n"), 1):
        if held and n + tokens(line + "\n") > options.max_tokens:
            close(i - 1)
            held, n, first = [], 0, i
        held.append(line)
        n += tokens(line + "\n")
    close(first + len(held) - 1)
    return out


def chunks(text: str, language: str | None = None, options: Options = Options(), rules: RuleSet = RuleSet()) -> list[Chunk]:
    """The chunks of a source, in its order."""
    tree, order = Tree(text, language), rules.ordered()
    out: list[Chunk] = []

    def visit(nodes: list[Node]) -> None:
        todo = list(reversed(nodes))
        while todo:
            n = todo.pop()
            rule = next((r for r in order if r.applies(n, options)), None)
            if rule:
                out.extend(replace(c, rule=rule.name) for c in rule.make(tree, n, options))
            if not rule or not rule.whole:
                todo += reversed(n.children)

    starts = {n.start for n in tree.nodes if n.kind in ("function", "class", "interface", "type")}
    visit([n for n in tree.nodes if n.parent is None and not (n.kind == "export" and n.start in starts)])
    kept = [c for c in out if passes(c, options)]
    if options.collapse:
        kept = [collapsed(c) if tokens(c.code) > options.max_tokens else c for c in kept]
    return kept or [c for c in plain(text, tree.language, options) if passes(c, options)]


SCHEMA = (
    "file string, id string, kind string, granularity string, name string, code string, first_line int, last_line int, parent string, "
    "tags array<string>, complexity int, documentation string, rule string"
)


def chunk_rows(docs: DataFrame, options: Options = Options(), rules: RuleSet = RuleSet()) -> DataFrame:
    """The chunks of every row of ``docs (path, language, content)``, a file at a time in Arrow batches.

    Null content: no chunks. Repeated paths: each row's chunks.
    """

    def rows(path: str, language: str | None, text: str) -> Iterator[tuple]:
        for c in chunks(text, language, options, rules):
            yield path, f"{path}:{c.kind}:{c.name}:{c.first}:{c.rule}", c.kind, c.granularity, c.name, c.code, c.first, c.last, c.parent, list(c.tags), c.complexity, c.documentation, c.rule

    def run(batches):
        t, i = pa.string(), pa.int32()
        kinds = [t, t, t, t, t, t, i, i, t, pa.list_(t), i, t, t]
        names = ["file", "id", "kind", "granularity", "name", "code", "first_line", "last_line", "parent", "tags", "complexity", "documentation", "rule"]
        for b in batches:
            found = [r for p, lang, text in zip(*(c.to_pylist() for c in b.columns), strict=True) if text for r in rows(p or "", lang, text)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], kind) for k, kind in enumerate(kinds)], names)

    return docs.select(F.col("path").cast("string").alias("path"), "language", "content").mapInArrow(run, SCHEMA)
