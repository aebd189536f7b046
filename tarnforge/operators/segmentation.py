"""What a text suggests about its segmentation: parts, a chunk size, a strategy; and a model's answer to the same question."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnforge.operators import analysis, chunking, syntax


@dataclass(frozen=True)
class Part:
    first: int
    last: int
    kind: str
    confidence: float
    reason: str = ""


@dataclass(frozen=True)
class Segmentation:
    parts: tuple[Part, ...]
    chunk_size: int
    strategy: str  # structural, semantic or hybrid
    complexity: float


def density(text: str) -> float:
    """Share of lines with text, times their mean length in hundreds of characters; at most 1."""
    lines = text.split("\n")
    filled = sum(bool(x.strip()) for x in lines)
    return min(1.0, filled / len(lines) * sum(map(len, lines)) / len(lines) / 100)


def structure(text: str) -> float:
    """Declarations in ten lines; at most 1."""
    found = chunking.symbols(text)
    return min(1.0, 10 * len(found) / max(text.count("\n") + 1, 1))


def members(text: str) -> Iterator[Part]:
    """Large objects and lists of a JSON text, documents of a YAML one. Where they stand in the lines is not known: 0."""
    try:
        todo = [(json.loads(text), "", 0)] if text.lstrip()[:1] in ("{", "[") else []
    except ValueError:
        todo = []
    while todo:
        value, path, depth = todo.pop()
        if isinstance(value, list) and len(value) > 5 and depth < 3:
            yield Part(0, 0, "logical_block", 0.7, f"list of {len(value)} {path}".strip())
        if isinstance(value, dict):
            if len(value) > 3 and depth < 2:
                yield Part(0, 0, "logical_block", 0.8, f"object of {len(value)} {path}".strip())
            todo += [(v, f"{path}.{k}".lstrip("."), depth + 1) for k, v in reversed(value.items())]
    if re.search(r"(?m)^---$", text):
        documents = [d for d in re.split(r"(?m)^---\n", text) if d.strip()]
        yield from (Part(0, 0, "logical_block", 0.9, f"document {i} of {len(documents)}") for i in range(1, len(documents) + 1))


def blocks(text: str) -> Iterator[Part]:
    """Runs of at least two lines between blank ones."""
    first = None
    lines = [*text.split("\n"), ""]
    for i, line in enumerate(lines, 1):
        if line.strip():
            first = first or i
        elif first:
            if i - first > 1:
                yield Part(first, i - 1, "logical_block", 0.5, "between blank lines")
            first = None


def analysed(text: str, content_type: str | None) -> Segmentation:
    """Parts by a text's type, and the size and strategy that they speak for (fixed values)."""
    if content_type == "config":
        parts = tuple(members(text))
        return Segmentation(parts, 800, "structural" if parts else "semantic", 0.7 if parts else 0.3)
    if content_type in ("code", "doc"):
        parts = tuple(Part(a, b, k, c) for a, b, k, c in analysis.suggestions(text, content_type))
        level = structure(text) if content_type == "code" else density(text)
        size = (800 if level > 0.6 else 1200) if content_type == "code" else 600 if level > 0.5 else 1000
        return Segmentation(parts, size, "structural" if len(parts) > 2 else "semantic", level)
    level = density(text)
    return Segmentation(tuple(blocks(text)), 700 if level > 0.4 else 1200, "semantic", level)


#: How complex a model's answer takes a text of each type to be (fixed values).
_ASSUMED = {"code": 0.7, "config": 0.6, "doc": 0.4}


def _number(value, otherwise: float) -> float:
    return value if isinstance(value, int | float) and not isinstance(value, bool) and value else otherwise


def parsed(answer: str, text: str, content_type: str | None) -> Segmentation:
    """A model's answer as a segmentation: its JSON object's suggestions, else the line numbers that it names.

    An answer with neither is one part, the text's beginning, of little confidence. Lines are brought within the text.
    """
    n = text.count("\n") + 1
    found: list[Part] = []
    try:
        given = json.loads(answer[answer.index("{") : answer.rindex("}") + 1]).get("suggestions")
    except (ValueError, AttributeError):
        given = None
    for s in given if isinstance(given, list) else ():
        if isinstance(s, dict):
            first, last = int(_number(s.get("startLine"), 1)), int(_number(s.get("endLine"), n))
            found.append(Part(first, last, str(s.get("type") or "logical_block"), float(_number(s.get("confidence"), 0.7)), str(s.get("reason") or "")))
    if not found:
        for line in answer.split("\n"):
            m = re.search(r"(\d+)(?:\D+(\d+))?", line) if re.search(r"\blines?\b|\bstart\b", line, re.I) else None
            if m:
                first = int(m[1])
                found.append(Part(first, int(m[2]) if m[2] else first + 10, "logical_block", 0.6))
    clamp = lambda x: min(max(x, 1), n)
    parts = [Part(clamp(p.first), max(clamp(p.last), clamp(p.first)), p.kind, min(max(p.confidence, 0.0), 1.0), p.reason) for p in found]
    level = _ASSUMED.get(content_type or "", 0.5)
    parts = parts or [Part(1, min(20, n), "logical_block", 0.5, "no answer")]
    return Segmentation(tuple(parts), 800 if level > 0.6 else 1200, "structural" if len(parts) > 2 else "hybrid", level)


def preprocessed(text: str, language: str | None = None) -> dict:
    """A source's comments, imports, exports, functions and classes, each with its lines, and the source without comments."""
    tree = syntax.Tree(text, language)
    out = {"language": tree.language}
    for name, kinds in (("comments", ("comment",)), ("imports", ("import",)), ("exports", ("export",)), ("functions", ("function", "method")), ("classes", ("class", "interface"))):
        out[name] = [{"name": n.name, "first": n.first, "last": n.last, "code": tree.source(n)} | syntax.metadata(tree, n) for n in syntax.of_kind(tree, *kinds)]
    kept, at = [], 0
    for a, b in tree.notes:
        kept.append(text[at:a])
        at = b
    out["bare"] = "".join([*kept, text[at:]])
    return out


SCHEMA = "id string, chunk_size int, strategy string, complexity double, parts array<struct<first:int,last:int,kind:string,confidence:double,reason:string>>"


def segmented(docs: DataFrame) -> DataFrame:
    """``analysed`` for every row of ``docs (id, content, content_type)``, by file in Arrow batches; null content is empty."""
    part = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("kind", pa.string()), ("confidence", pa.float64()), ("reason", pa.string())]))

    def run(batches):
        for b in batches:
            found = [analysed(t or "", k) for t, k in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            columns = [b.column(0), pa.array([s.chunk_size for s in found], pa.int32()), pa.array([s.strategy for s in found], pa.string())]
            columns += [pa.array([s.complexity for s in found], pa.float64()), pa.array([[asdict(p) for p in s.parts] for s in found], part)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "chunk_size", "strategy", "complexity", "parts"])

    return docs.select(F.col("id").cast("string").alias("id"), "content", "content_type").mapInArrow(run, SCHEMA)
