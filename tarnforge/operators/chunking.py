"""Chunkers: words and token estimates as expressions, structure-aware ones as Arrow-batched table functions."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnforge.operators import syntax

SIZE, OVERLAP = 1000, 200


def word_chunks(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Overlapping windows of ``size`` words, ``overlap`` shared; native, linear in the text."""
    if overlap >= size or size < 1 or overlap < 0:
        raise ValueError("overlap must be at least 0 and less than size")
    def windows(words: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.size(words) - overlap) / (size - overlap)).cast("int") - 1)
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(words, i * (size - overlap) + 1, F.lit(size)), " "))

    # Bound once: a plain expression would split the text anew for each window.
    once = F.array(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.element_at(F.transform(once, windows), 1)


def exploded(docs: DataFrame, chunks: Column, *kept: str) -> DataFrame:
    """One row a chunk with its place and how many its text has."""
    found = docs.select(*kept, chunks.alias("chunks"))
    return found.select(*kept, F.size("chunks").alias("total_chunks"), F.posexplode("chunks").alias("chunk_index", "chunk"))


def paragraphs(text: str, size: int = SIZE) -> list[str]:
    """Blank-line paragraphs, packed greedily while two characters of joint and the next still fit."""
    out: list[str] = []
    for p in re.split(r"\n\s*\n", text):
        if not p.strip():
            continue
        if out and len(out[-1]) + len(p) + 2 <= size:
            out[-1] += "\n\n" + p
        else:
            out.append(p)
    return out


def documentation(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Breaks before headings and where the size is reached; a few lines overlap in the latter case."""
    shared = min(overlap // 50, 5)
    out: list[str] = []
    lines: list[str] = []
    length = 0

    def close():
        if any(x.strip() for x in lines):
            out.append("\n".join(lines))

    for line in text.split("\n"):
        heading = re.match(r"#{1,6}\s", line)
        if heading and lines:
            close()
            lines, length = [], 0
        elif length + len(line) + 1 > size and lines:
            close()
            lines = lines[-shared:] if shared else []
            length = sum(len(x) + 1 for x in lines)
        lines.append(line)
        length += len(line) + 1
    close()
    return out


def configuration(text: str, size: int = SIZE) -> list[str]:
    """JSON by its members as far as they exceed the size, YAML by its documents, anything else by paragraphs."""
    if len(text) <= 8 * size:
        return [text]

    def split(value, path: str) -> list[str]:
        whole = json.dumps({path: value} if path else value, ensure_ascii=False)
        if len(whole) <= size or not isinstance(value, dict | list) or not value:
            return [whole]
        members = value.items() if isinstance(value, dict) else enumerate(value)
        return [c for k, v in members for c in split(v, f"{path}.{k}" if path else str(k))]

    try:
        return split(json.loads(text), "")
    except ValueError:
        pass
    if re.search(r"(?m)^---$", text):
        return [p.strip("\n") for p in re.split(r"(?m)^---\n", text) if p.strip()]
    return paragraphs(text, size)


def symbols(text: str, language: str | None = None) -> list[tuple[str, str, int, int]]:
    """``(kind, name, first line, last line)`` of functions, methods, classes and interfaces; lines from 1."""
    return [(n.kind, n.name, n.first, n.last) for n in syntax.Tree(text, language).nodes if n.kind in ("function", "method", "class", "interface")]


def code(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Outermost declarations as chunks, longer ones by words, what is left between them by paragraphs."""
    lines, out, at = text.split("\n"), [], 0

    def rest(a: int, b: int):
        between = "\n".join(lines[a:b])
        if between.strip():
            out.extend(paragraphs(between, size))

    for _, _, first, last in symbols(text):
        if first - 1 < at:
            continue
        rest(at, first - 1)
        body = "\n".join(lines[first - 1 : last])
        out.extend([body] if len(body) < 4 * size else by_words(body, size, overlap))
        at = last
    rest(at, len(lines))
    return out or [text]


def by_words(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    words, step = text.split(), size - overlap
    if step < 1:
        raise ValueError("overlap must be less than size")
    return [" ".join(words[i : i + size]) for i in range(0, max(1, len(words) - overlap), step)]


def intelligent(text: str, content_type: str | None, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Chunks by a file's type; a text of up to four sizes is one."""
    if content_type == "config":
        return configuration(text, size)
    if len(text) <= 4 * size:
        return [text]
    if content_type == "code":
        return code(text, size, overlap)
    if content_type == "doc":
        return documentation(text, size, overlap)
    return by_words(text, size, overlap)


def chunked(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """``id, chunk_index, total_chunks, chunk`` of every row of ``docs (id, content, content_type)``, by file in Arrow batches."""

    def run(batches):
        for b in batches:
            ids, index, total, chunks = [], [], [], []
            for i, text, kind in zip(*(c.to_pylist() for c in b.columns), strict=True):
                parts = intelligent(text or "", kind, size, overlap)
                ids += [i] * len(parts)
                index += range(len(parts))
                total += [len(parts)] * len(parts)
                chunks += parts
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(index, pa.int32()), pa.array(total, pa.int32()), pa.array(chunks, pa.string())], ["id", "chunk_index", "total_chunks", "chunk"])

    return docs.select(F.col("id").cast("string").alias("id"), "content", "content_type").mapInArrow(run, "id string, chunk_index int, total_chunks int, chunk string")


def symbol_rows(docs: DataFrame) -> DataFrame:
    """``id, kind, name, first_line, last_line`` of every declaration of ``docs (id, content)``."""

    def run(batches):
        for b in batches:
            rows = [(i, *s) for i, t in zip(*(c.to_pylist() for c in b.columns), strict=True) for s in symbols(t or "")]
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["id", "kind", "name", "first_line", "last_line"])

    return docs.select(F.col("id").cast("string").alias("id"), "content").mapInArrow(run, "id string, kind string, name string, first_line int, last_line int")


_METADATA = (
    "struct<parameters:array<string>,return_type:string,visibility:string,static:boolean,async:boolean,decorators:array<string>,"
    "properties:array<string>,bases:array<string>,methods:array<string>,modules:array<string>,names:array<string>>"
)


def symbol_metadata(docs: DataFrame) -> DataFrame:
    """``id, kind, name, owner, first_line, last_line, metadata`` of the declarations, imports and exports of ``docs (id, content)``.

    ``owner`` is the class around a method. ``metadata`` has the fields of its kind; the others are null.
    """
    kinds = ("function", "method", "class", "interface", "import", "export")

    def run(batches):
        t, n = pa.string(), pa.int32()
        many = pa.list_(t)
        inner = pa.struct([
            ("parameters", many), ("return_type", t), ("visibility", t), ("static", pa.bool_()), ("async", pa.bool_()), ("decorators", many),
            ("properties", many), ("bases", many), ("methods", many), ("modules", many), ("names", many),
        ])
        for b in batches:
            rows = []
            for i, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                tree = syntax.Tree(text or "")
                for x in syntax.of_kind(tree, *kinds):
                    rows.append((i, x.kind, x.name, x.parent.name if x.parent else None, x.first, x.last, syntax.metadata(tree, x)))
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((t, t, t, t, n, n, inner))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "kind", "name", "owner", "first_line", "last_line", "metadata"])

    schema = f"id string, kind string, name string, owner string, first_line int, last_line int, metadata {_METADATA}"
    return docs.select(F.col("id").cast("string").alias("id"), "content").mapInArrow(run, schema)


def imports(content: Column) -> Column:
    """Modules that a source text imports, JS, TS and Python forms, without repeats."""
    js = F.regexp_extract_all(content, F.lit(r"(?m)(?:from|require\(|import)\s*[\"']([^\"']+)[\"']"), F.lit(1))
    py = F.regexp_extract_all(content, F.lit(r"(?m)^\s*(?:from\s+([\w.]+)\s+import|import\s+[\w.]+)"), F.lit(1))
    plain = F.regexp_extract_all(content, F.lit(r"(?m)^\s*import\s+([\w.]+)(?:\s+as\s+\w+)?\s*$"), F.lit(1))
    return F.array_distinct(F.filter(F.concat(js, py, plain), lambda x: x != ""))
