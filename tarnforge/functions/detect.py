"""Content type, language and role of files by expressions alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnforge.functions.text import dotted_extension

#: Extensions by content type and by language (fixed values).
TYPES = {
    "code": "js ts jsx tsx py java cpp c cs go rs php rb sh bash html css scss sass less sql r m swift kt scala lua pl pm",
    "doc": "md txt rst tex adoc asciidoc wiki rtf",
    "config": "json yaml yml toml ini cfg conf properties env xml",
    "other": "csv tsv log lock",
}
LANGUAGES = {"javascript": "js jsx", "typescript": "ts tsx", "python": "py", "bash": "sh bash", "html": "html", "css": "css", "scss": "scss sass", "json": "json", "yaml": "yaml yml"}

#: Patterns in contents, with what each adds to its type's score (fixed values).
SIGNS = {
    "code": [
        (2.0, r"\b(function|def|class|interface|enum|const|let|var)\s+\w+"),
        (1.5, r"\b(import|from|require|include)\b"),
        (1.0, r"\b(if|else|for|while|switch|case|break|continue|return)\b"),
        (0.5, r"(//|/\*|\*/|#)"),
        (0.5, r"[{}()\[\]]"),
    ],
    "doc": [(3.0, r"(?m)^#{1,6}\s+.+"), (1.5, r"(?m)^\s*[-*+]\s+.+"), (1.0, r"\[[^\]]+\]\([^)]+\)"), (0.5, r"[.!?]\s+"), (0.5, r"\n\s*\n")],
    "config": [(3.0, r"^\s*[{\[]"), (2.0, r"(?m)^---$"), (1.0, r"(?m)^\s*[\w-]+\s*[:=]"), (1.0, r"(?m)^\s*[A-Z_][A-Z0-9_]*\s*=")],
}
#: A language's pattern; the first that matches decides (fixed values).
LANGUAGE_SIGNS = [
    ("javascript", r"\bconsole\.log|function\s+\w+\s*\(|const\s+\w+\s*="),
    ("typescript", r"\binterface\s+\w+|type\s+\w+\s*="),
    ("python", r"\bdef\s+\w+\s*\(|import\s+\w+|from\s+\w+\s+import"),
    ("bash", r"^#!/bin/(bash|sh)|echo\s+\""),
    ("html", r"<!DOCTYPE html>|<html|<head|<body"),
    ("css", r"\.selector\s*\{|@media|#id\s*\{"),
    ("scss", r"\$[a-z-]+:|@mixin|@include"),
    ("json", r"^\s*\{|^\s*\["),
    ("yaml", r"(?m)^---$|^[a-z_]+:"),
]
_ROLE_PATHS = [("test", "test|spec"), ("example", "example|demo"), ("template", "template|boilerplate"), ("helper", "util|helper|common")]
_TESTS, _EXPORTS = r"describe\(|it\(|test\(|assert|expect\(", "export (function|const|class|default)"
_UTILITY = r"\b(utils?|helpers?|common|tools?|format|parse|validate|calculate)\b"


def _mapped(ext: Column, table: dict[str, str]) -> Column:
    return reduce(lambda c, kv: c.when(ext.isin([f".{e}" for e in kv[1].split()]), kv[0]), table.items(), F)


def type_by_extension(path: Column) -> Column:
    return _mapped(dotted_extension(path), TYPES)


def language_by_extension(path: Column) -> Column:
    return _mapped(dotted_extension(path), LANGUAGES)


def type_score(content: Column, kind: str) -> Column:
    """Sum of the signs of a type, scaled by the number of lines up to 100."""
    lines = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + 1
    points = reduce(lambda a, b: a + b, (F.when(content.rlike(p), w).otherwise(0.0) for w, p in SIGNS[kind]))
    return points * F.least(F.lit(100), lines) / 100


def language_by_content(content: Column) -> Column:
    return reduce(lambda c, kv: c.when(content.rlike(kv[1]), kv[0]), LANGUAGE_SIGNS, F)


def detected(path: Column, content: Column) -> Column:
    """Struct of content_type, language, confidence and detected_by; extension and content weighed."""
    empty = content.isNull() | (content == "")
    parts = F.struct(type_by_extension(path).alias("by_ext"), *(type_score(content, k).alias(k) for k in SIGNS), F.coalesce(language_by_extension(path), F.when(~empty, language_by_content(content))).alias("language"))

    def weighed(x: Column) -> Column:
        by_ext, known = x["by_ext"], x["by_ext"].isNotNull()
        top = F.greatest(*(x[k] for k in SIGNS))
        kind = F.when(top <= 1, "other").when(top == x["code"], "code").when(top == x["doc"], "doc").otherwise("config")
        sure = F.when(top <= 1, 0.5).otherwise(F.least(F.lit(0.9), top / 5))
        by_content = ~empty & F.when(known, (kind != by_ext) & (sure > 0.7)).otherwise(sure > 0.6)
        final = F.when(by_content, kind).otherwise(F.coalesce(by_ext, F.lit("other")))
        confidence = F.when(by_content, sure).when(known & ~empty & (kind == by_ext), 0.95).when(known, 0.9).otherwise(0.3)
        language = F.coalesce(x["language"], F.when((final == "code") & ~empty, "unknown"))
        return F.struct(final.alias("content_type"), language.alias("language"), confidence.alias("confidence"), F.when(by_content, "content").otherwise("extension").alias("detected_by"))

    # Bound once: each score is used several times, and its patterns are what costs.
    return F.element_at(F.transform(F.array(parts), weighed), 1)


def role(path: Column, content: Column, content_type: Column) -> Column:
    p, c = F.lower(path), F.lower(content)
    code = content_type == "code"
    out = reduce(lambda acc, kv: acc.when(p.rlike(kv[1]), kv[0]), _ROLE_PATHS, F)
    out = out.when(code & c.rlike(_TESTS), "test").when(code & c.rlike("example|demo"), "example").when(code & c.rlike(_EXPORTS) & c.rlike(_UTILITY), "helper")
    return out.when(code, "core").otherwise("other")


def indexed_role(content_type: Column) -> Column:
    """The role that indexing gives a file by its type alone."""
    return F.when(content_type == "code", "core").when(content_type == "doc", "example").when(content_type == "config", "template").otherwise("other")
