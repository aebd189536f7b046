"""A light syntax tree of JavaScript, TypeScript and Python sources, and what their declarations say of themselves.

No grammar is needed: what is not code is blanked out, by a scanner with a stack where there are templates, regular expressions and markup; brackets are paired
once, and declarations, blocks and imports are found where a line starts. A Python unit ends where its indentation does, any other where its braces do. All is
linear in the source but for sorting what was found.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from tarnforge.operators import scan

PYTHON = "python"

_PYTHON_TEXT = re.compile(r"""(?P<note>\#[^\n]*+)|\"{3}(?:\\.|[^"\\]|"(?!""))*+(?:\"{3})?|'{3}(?:\\.|[^'\\]|'(?!''))*+(?:'{3})?|"(?:\\.|[^"\\\n])*+"?|'(?:\\.|[^'\\\n])*+'?""", re.S)
_KEPT = re.compile(r"[^\n]")
_BLANK, _NAME = re.compile(r"\s*+"), re.compile(r"[\w$.]*+")

_MODIFIERS = r"(?:(?:public|private|protected|static|abstract|async|readonly|override|declare|get|set)[ \t]++)*+"
#: Type parameters, three deep.
_GENERICS = r"(?:<(?:[^<>\n]|=>|<(?:[^<>\n]|=>|<(?:[^<>\n]|=>)*+>)*+>)*+>)?"
_BRACED = re.compile(
    rf"^[ \t]*+(?P<export>export[ \t]++(?:default[ \t]++)?)?(?P<modifiers>{_MODIFIERS})(?:"
    r"(?P<word>function|class|interface|enum|type|namespace)\b[ \t]*+\*?[ \t]*+(?P<name>[\w$]+)"
    rf"|(?:const|let|var)[ \t]++(?P<arrow>[\w$]++)(?:[^=\n]|=>)*+=(?!>)[ \t]*+(?:async[ \t]*+)?(?=function\b|{_GENERICS}\(|[\w$]++[ \t]*+=>)"
    r"|(?P<import>import\b)"
    r"|(?P<block>if|for|while|try|switch|do)\b"
    rf"|(?P<method>[#\w$]++)\??[ \t]*+{_GENERICS}\("
    r")",
    re.M,
)
_PARAMETERS, _ARROW = re.compile(rf"{_GENERICS}\("), re.compile(r"\s*+(?::[^;\n]*?)?=>")
_EXPORT = re.compile(r"^[ \t]*+export\b", re.M)
_INDENTED = re.compile(
    r"^(?P<indent>[ \t]*+)(?:(?P<async>async[ \t]++)?(?P<word>def|class)[ \t]++(?P<name>\w+)|(?P<import>import|from)\b|(?P<block>if|for|while|try|with|match)\b)",
    re.M,
)
_NO_METHODS = frozenset("if for while switch catch return function super new await typeof else do".split())
_KINDS = {"function": "function", "def": "function", "class": "class", "interface": "interface", "enum": "type", "type": "type", "namespace": "block"}


@dataclass
class Node:
    """A part of a source: characters ``[start, end)``, lines from 1."""

    kind: str
    name: str
    start: int
    end: int
    first: int
    last: int
    word: str = ""
    modifiers: tuple[str, ...] = ()
    exported: bool = False
    parent: Node | None = field(default=None, repr=False)
    children: list[Node] = field(default_factory=list, repr=False)


class Tree:
    """The nodes of a source, outermost and first ones first."""

    def __init__(self, text: str, language: str | None = None):
        self.text, self.language = text, language or guessed(text)
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        solid = [m.span() for m in re.finditer(r"\S+", text)]
        self._solid = [a for a, _ in solid], [b for _, b in solid]
        notes: list[tuple[int, int]] = []

        def blank(m: re.Match) -> str:
            if m["note"]:
                notes.append(m.span())
            return _KEPT.sub(" ", m[0])

        #: The source without strings and comments, every character in its place.
        if self.language == PYTHON:
            self.code = _PYTHON_TEXT.sub(blank, text)
        else:
            self.code, notes = scan.blanked(text)
        self.pairs, self.inner = _paired(self.code)
        self.notes = notes
        found = self._indented() if self.language == PYTHON else self._braced()
        self.nodes = self._nested([*found, *self._comments(notes)])

    def line_of(self, at: int) -> int:
        return bisect.bisect_right(self.lines, at)

    def source(self, node: Node) -> str:
        return self.text[node.start : node.end]

    def node(self, kind: str, name: str, start: int, end: int, **more) -> Node:
        i = bisect.bisect_left(self._solid[0], end) - 1
        end = max(start, min(end, self._solid[1][i])) if i >= 0 else start
        return Node(kind, name, start, end, self.line_of(start), self.line_of(max(start, end - 1)), **more)

    def _line_end(self, at: int) -> int:
        end = self.code.find("\n", at)
        return len(self.code) if end < 0 else end

    def _statement_end(self, at: int, body: bool = False) -> int:
        """Where a braced statement that starts at ``at`` ends: after its body if it has one, else at ``;`` or its last line's end."""
        n = len(self.code)
        opened = False
        while at < n:
            c = self.code[at]
            if c in "([":
                at = self.pairs.get(at, n - 1) + 1
                continue
            if c == "{":
                at = self.pairs.get(at, n - 1) + 1
                if body:
                    return at
                opened = True
                continue
            if c == ";":
                return at + 1
            if c == "}" or c == "\n" and (opened or at + 1 in self.heads and not body):
                return at
            if c == "\n" and not body and not re.match(r"\s*+(?:[|&.?:=+]|=>)", self.code[at : at + 200]) and not re.search(r"(?:[=(,|&:]|=>)\s*$", self.code[max(0, at - 80) : at]):
                return at
            at += 1
        return n

    def _body(self, at: int) -> int | None:
        """The brace that opens the body of a method whose parameters end at ``at``, past its type; None if it has none."""
        m = _BLANK.match(self.code, at)
        at = m.end()
        if self.code[at : at + 1] == "{":
            return at
        if self.code[at : at + 1] != ":":
            return None
        at, operand = at + 1, True  # a part of the type is due
        while at < len(self.code):
            at = _BLANK.match(self.code, at).end()
            c = self.code[at : at + 1]
            if c == "{" and not operand:
                return at
            if c and c in "{[(":
                at, operand = self.pairs.get(at, len(self.code)) + 1, False
            elif c in ("", ";", "}", ")", "="):
                if self.code[at : at + 2] != "=>":
                    return None
                at, operand = at + 2, True
            elif c in "|&?:<,":
                at, operand = at + 1, True
            else:
                at, operand = max(at + 1, _NAME.match(self.code, at).end()), False
        return None

    def _braced(self) -> Iterator[Node]:
        done = 0
        found = list(_BRACED.finditer(self.code))
        #: Lines that start a declaration, where a statement without a body ends at the latest.
        self.heads = {m.start() for m in found if m["word"] or m["arrow"] or m["import"] or m["export"]}
        for m in found:
            start = m.end() - len(m[0].lstrip())
            modifiers = tuple(m["modifiers"].split())
            more = {"modifiers": modifiers, "exported": bool(m["export"])}
            if m["import"]:
                yield self.node("import", "import", start, self._statement_end(m.end()))
            elif m["block"]:
                end = self._statement_end(m.end(), body=True)
                while (tail := re.compile(r"\s*+(?:else\b(?:\s*+if\b)?|catch\b|finally\b|while\b)").match(self.code, end)) and not (m["block"] != "do" and "while" in tail[0]):
                    end = self._statement_end(tail.end(), body=True)
                yield self.node("block", m["block"], start, end, word=m["block"])
            elif m["method"]:
                close = self.pairs.get(m.end() - 1)
                if close is None or m["method"] in _NO_METHODS or m.start() < done:
                    continue
                body = self._body(close + 1)
                if body is not None and self.inner.get(m.end() - 1) is not None:
                    yield self.node("method", m["method"], start, self.pairs.get(body, len(self.code) - 1) + 1, word="method", **more)
            elif m["arrow"]:
                opened = _PARAMETERS.match(self.code, m.end())
                if opened and not _ARROW.match(self.code, self.pairs.get(opened.end() - 1, len(self.code)) + 1):
                    continue  # a value in parentheses
                done = m.end()
                yield self.node("function", m["arrow"], start, self._statement_end(m.end()), word="arrow", **more)
            else:
                done = m.end()
                word = m["word"]
                end = self._statement_end(m.end(), body=word != "type")
                yield self.node(_KINDS[word], m["name"], start, end, word=word, **more)
        for m in _EXPORT.finditer(self.code):
            start = m.end() - len(m[0].lstrip())
            yield self.node("export", "export", start, self._statement_end(m.end(), body=bool(re.compile(r"[ \t]+(?:default[ \t]+)?(?:abstract[ \t]+|async[ \t]+)?(?:function|class|interface|enum)\b").match(self.code, m.end()))))

    def _indented(self) -> Iterator[Node]:
        ends, last = self._ends(), self._last_solid()
        for m in _INDENTED.finditer(self.code):
            line = self.line_of(m.end()) - 1
            start = self.lines[line] + len(m["indent"])
            if self.inner.get(("line", line)):
                continue
            end = self._line_end(self.lines[last[ends[line] - 1]])
            if m["import"]:
                stop = start
                while (stop := self._line_end(stop)) < len(self.code) and (self.code[stop - 1] == "\\" or self.inner.get(("line", self.line_of(stop)))):
                    stop += 1
                yield self.node("import", "import", start, stop)
            elif m["block"]:
                yield self.node("block", m["block"], start, end, word=m["block"])
            else:
                yield self.node(_KINDS[m["word"]], m["name"], start, end, word=m["word"], modifiers=("async",) if m["async"] else ())

    def _ends(self) -> list[int]:
        """By line, the line after the last that is indented more than it; ``else`` and its like go on a block."""
        rows = self.code.split("\n")
        width = [len(r) - len(r.lstrip()) for r in rows]
        there = [bool(r.strip()) and not self.inner.get(("line", i)) for i, r in enumerate(rows)]
        goes_on = [bool(re.match(r"\s*(?:else|elif|except|finally|case)\b", r)) for r in rows]
        ends, stack = [0] * len(rows), []
        for i in range(len(rows) - 1, -1, -1):
            if not there[i]:
                ends[i] = i + 1
                continue
            while stack and (width[stack[-1]] > width[i] or width[stack[-1]] == width[i] and goes_on[stack[-1]]):
                stack.pop()
            ends[i] = stack[-1] if stack else len(rows)
            stack.append(i)
        return ends

    def _last_solid(self) -> list[int]:
        """By line, the last one up to it that is neither blank nor a comment alone."""
        rows, of_note = self.text.split("\n"), {self.line_of(a) - 1 for a, _ in self.notes}
        code, out = self.code.split("\n"), []
        for i, row in enumerate(rows):
            solid = row.strip() and (i not in of_note or code[i].strip())
            out.append(i if solid or not i else out[-1])
        return out

    def _comments(self, notes: list[tuple[int, int]]) -> Iterator[Node]:
        """Comments; those on lines that follow each other are one, one beside code is none."""
        run: tuple[int, int] | None = None
        for a, b in notes:
            if self.code[self.lines[self.line_of(a) - 1] : a].strip():
                continue
            if run and self.line_of(a) <= self.line_of(run[1] - 1) + 1:
                run = run[0], b
                continue
            if run:
                yield self.node("comment", "comment", *run)
            run = a, b
        if run:
            yield self.node("comment", "comment", *run)

    def _nested(self, found: list[Node]) -> list[Node]:
        out = []
        stack: list[tuple[Node, Node | None]] = []  # each with the innermost one around that is no export, itself included
        for n in sorted(found, key=lambda n: (n.start, n.kind != "export", -n.end)):
            while stack and stack[-1][0].end < n.end:
                stack.pop()
            n.parent = stack[-1][1] if stack else None
            if n.parent:
                n.parent.children.append(n)
                if n.kind == "function" and n.word != "arrow" and n.parent.kind == "class":
                    n.kind = "method"
            if n.kind == "method" and (not n.parent or n.parent.kind != "class"):
                if n.parent:
                    n.parent.children.pop()
                continue
            out.append(n)
            stack.append((n, n.parent if n.kind == "export" else n))
        return out


def guessed(text: str) -> str:
    """Python where definitions end in a colon, else a language with braces."""
    return PYTHON if re.search(r"(?m)^[ \t]*+(?:def|class)[ \t]++\w[^\n{]*:[ \t]*+(?:#.*)?$", text) else "typescript"


def _paired(code: str) -> tuple[dict[int, int], dict]:
    """Closing place by opening place, the opening bracket around each opening one, and the lines that start inside brackets."""
    pairs: dict[int, int] = {}
    inner: dict = {}
    stack: list[int] = []
    closes = {")": "(", "]": "[", "}": "{"}
    line = 0
    for m in re.finditer(r"[()\[\]{}\n]", code):
        c, at = m[0], m.start()
        if c == "\n":
            line += 1
            if stack:
                inner["line", line] = True
        elif c in "([{":
            inner[at] = stack[-1] if stack else None
            stack.append(at)
        elif stack and code[stack[-1]] == closes[c]:
            pairs[stack.pop()] = at
        elif stack and any(code[s] == closes[c] for s in stack[-8:]):  # a bracket that nothing closed
            while code[stack[-1]] != closes[c]:
                stack.pop()
            pairs[stack.pop()] = at
    return pairs, inner


# Helpers over a tree.


def walk(nodes: list[Node]) -> Iterator[Node]:
    """Each outermost node and all below it, parents first."""
    todo = [n for n in reversed(nodes) if n.parent is None]
    while todo:
        n = todo.pop()
        yield n
        todo += reversed(n.children)


def of_kind(tree: Tree, *kinds: str) -> list[Node]:
    return [n for n in tree.nodes if n.kind in kinds]


def between(tree: Tree, first: int, last: int) -> list[Node]:
    """Nodes that lie wholly in the lines."""
    return [n for n in tree.nodes if first <= n.first and n.last <= last]


def enclosing(tree: Tree, line: int, *kinds: str) -> Node | None:
    """The innermost node, of the kinds if any are given, that has the line."""
    own = [n for n in tree.nodes if n.first <= line <= n.last and (not kinds or n.kind in kinds)]
    return min(own, key=lambda n: (n.end - n.start, n.kind == "export", n.start), default=None)


def contains(outer: Node, inner: Node) -> bool:
    return outer.start <= inner.start and inner.end <= outer.end and outer is not inner


def comment_before(tree: Tree, node: Node) -> Node | None:
    """The comment that ends on the line above a node."""
    return next((n for n in tree.nodes if n.kind == "comment" and n.last == node.first - 1), None)


def size(tree: Tree, node: Node) -> int:
    """Number of words, numbers and signs of a node, strings as one each at most: the leaves of its syntax."""
    return len(re.findall(r"[\w$]+|[^\s\w$]", tree.code[node.start : node.end]))


def node_complexity(tree: Tree, node: Node) -> int:
    """A tenth of the size of a node, from 1 to 10."""
    return min(max(-(-size(tree, node) // 10), 1), 10)


# What declarations say of themselves.


def _parts(tree: Tree, start: int, end: int) -> list[str]:
    """The text between two places, parted by the commas outside brackets."""
    out, at, i = [], start, start
    angles = 0
    while i < end:
        c = tree.code[i]
        if c in "([{" and i in tree.pairs:
            i = tree.pairs[i]
        elif c == "<":
            angles += 1
        elif c == ">" and tree.code[i - 1] != "=":
            angles = max(0, angles - 1)
        elif c == "," and not angles:
            out.append(tree.text[at:i])
            at = i + 1
        i += 1
    return [p.strip() for p in [*out, tree.text[at:end]] if p.strip()]


def _list_of(tree: Tree, node: Node) -> tuple[int, int] | None:
    """The places of the brackets around a function's parameters."""
    at = tree.code.find("(", node.start, node.end)
    return (at, tree.pairs[at]) if at in tree.pairs and tree.pairs[at] < node.end else None


def parameters(tree: Tree, node: Node) -> list[str]:
    """Names of a function's parameters; patterns as they are written."""
    span = _list_of(tree, node)
    if span is None:
        m = re.search(r"=\s*(?:async\s+)?([\w$]+)\s*=>", tree.code[node.start : node.end])
        return [m[1]] if m else []
    out = []
    for p in _parts(tree, span[0] + 1, span[1]):
        p = re.sub(r"^(?:@\w+(?:\([^)]*\))?\s*|(?:public|private|protected|readonly)\s+)+", "", p)
        m = re.match(r"(\.{3}|\*{0,2})\s*([\w$]+)", p)
        if m:
            out.append(m[1] + m[2])
        elif p[0] in "{[":
            out.append(re.sub(r"\s+", " ", p[: p.rfind("}" if p[0] == "{" else "]") + 1]))
    return out


def return_type(tree: Tree, node: Node) -> str | None:
    span = _list_of(tree, node)
    if span is None:
        return None
    rest = tree.code[span[1] + 1 : node.end]
    m = re.match(r"\s*->\s*([^:\n]+):" if tree.language == PYTHON else r"\s*:\s*([^{;]+?)\s*(?:=>|\{|;|$)", rest)
    return tree.text[span[1] + 1 + m.start(1) : span[1] + 1 + m.end(1)].strip() if m else None


def decorators(tree: Tree, node: Node) -> list[str]:
    """Names of the marks on the lines above a declaration, the nearest first."""
    out, line = [], node.first - 2
    while line >= 0 and (m := re.match(r"\s*@([\w.]+)", tree.text[tree.lines[line] : tree._line_end(tree.lines[line])])):
        out.append(m[1])
        line -= 1
    return out


def visibility(tree: Tree, node: Node) -> str:
    """By its word, or by the form of its name: ``#x`` and ``__x`` are private, ``_x`` is protected."""
    for v in ("public", "private", "protected"):
        if v in node.modifiers:
            return v
    if node.name.startswith("#") or node.name.startswith("__") and not node.name.endswith("__"):
        return "private"
    return "protected" if node.name.startswith("_") and not node.name.startswith("__") else "public"


def properties(tree: Tree, node: Node) -> list[str]:
    """Names of a class's fields: declared in its body, or set on self or this in a method."""
    inside = [(c.start, c.end) for c in node.children if c.kind == "method"]
    bare, at = [], node.start
    for a, b in inside:
        bare.append(tree.code[at:a])
        at = b
    body = "".join([*bare, tree.code[at : node.end]])
    if tree.language == PYTHON:
        found = re.findall(r"(?m)^[ \t]+(\w+)\s*(?::[^=\n]+)?=[^=]|^[ \t]+(\w+)\s*:\s*[\w\[]", body.partition("\n")[2])
    else:
        found = re.findall(r"(?m)^[ \t]*(?:(?:public|private|protected|static|readonly|declare)\s+)*([#\w$]+)[?!]?\s*(?:[:=][^\n]*|)()(?:;|$)", body.partition("{")[2])
    own = [x or y for x, y in found]
    own += re.findall(r"\b(?:self|this)\.([#\w$]+)\s*(?::[^=\n]+)?=(?!=|>)", tree.code[node.start : node.end])
    return list(dict.fromkeys(n for n in own if n not in ("return", "pass")))


def bases(tree: Tree, node: Node) -> list[str]:
    """What a class or interface extends or implements."""
    head = tree.text[node.start : node.end].partition(":" if tree.language == PYTHON else "{")[0]
    if tree.language == PYTHON:
        m = re.search(r"\(([^()]*)\)", head)
        return [b.strip() for b in m[1].split(",") if b.strip() and "=" not in b] if m else []
    return [b.strip() for m in re.finditer(r"\b(?:extends|implements)\s+([\w$.<>, ]+?)(?=\s+(?:extends|implements)\b|\s*$)", head) for b in m[1].split(",")]


def imported(tree: Tree, node: Node) -> tuple[list[str], list[str]]:
    """Modules and names that an import brings in."""
    t = tree.source(node)
    if tree.language == PYTHON:
        if m := re.match(r"from\s+([\w.]+)\s+import\s+(.*)", t, re.S):
            return [m[1]], [n.split()[-1] for n in re.sub(r"[()\\]|#[^\n]*", " ", m[2]).split(",") if n.strip()]
        names = [n.strip() for n in t.removeprefix("import").split(",") if n.strip()]
        return [n.split()[0] for n in names], [n.split()[-1] for n in names]
    modules = re.findall(r"(?:from|import|require\()\s*[\"']([^\"']+)[\"']", t)
    head = re.split(r"\bfrom\b", t)[0] if "from" in t else ""
    return modules, [n.split()[-1] for n in re.split(r"[{},]", re.sub(r"^import\s+(?:type\s+)?", "", head)) if n.strip()]


def exported_names(tree: Tree, node: Node) -> list[str]:
    t = tree.source(node)
    if m := re.match(r"export\s+(?:type\s+)?\{([^}]*)\}", t):
        return [n.split()[-1] for n in m[1].split(",") if n.strip()]
    if re.match(r"export\s+\*", t):
        return ["*"]
    m = re.match(r"export\s+(default\s+)?(?:(?:declare|abstract|async)\s+)*(?:(?:function|class|interface|enum|type|namespace|const|let|var)\b[\s*]*)?([\w$]*)", t)
    return [m[2] or "default"] if m and (m[2] or m[1]) else ["default"]


def metadata(tree: Tree, node: Node) -> dict:
    """What is known of a declaration; which keys there are follows from its kind."""
    if node.kind in ("function", "method"):
        marks = decorators(tree, node)
        return {
            "parameters": parameters(tree, node),
            "return_type": return_type(tree, node),
            "visibility": visibility(tree, node),
            "static": "static" in node.modifiers or "staticmethod" in marks,
            "async": "async" in node.modifiers or bool(re.match(r"[^(\n]*=\s*async\b", tree.code[node.start : node.end])),
            "decorators": marks,
        }
    if node.kind in ("class", "interface"):
        own = {"properties": properties(tree, node), "bases": bases(tree, node), "visibility": visibility(tree, node)}
        return own | {"methods": [c.name for c in node.children if c.kind == "method"], "decorators": decorators(tree, node)}
    if node.kind == "import":
        modules, names = imported(tree, node)
        return {"modules": modules, "names": names}
    return {"names": exported_names(tree, node)} if node.kind == "export" else {}
