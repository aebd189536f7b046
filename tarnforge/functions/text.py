"""Text, path and hash expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_path(path: Column) -> Column:
    """A file path without its trailing chunk mark."""
    return F.regexp_replace(path, r"#chunk[0-9]+$", "")


def chunk_id(project: Column, path: Column, index: Column, total: Column) -> Column:
    base = F.concat(project, F.lit(":"), clean_path(path))
    return F.when(total > 1, F.concat(base, F.lit("#chunk"), index.cast("string"))).otherwise(base)


def extension(path: Column) -> Column:
    """The last dot's segment without the dot; the whole name where there is none."""
    return F.element_at(F.split(path, r"\."), -1)


def dotted_extension(path: Column) -> Column:
    """Lower-cased extension with its dot; empty where there is none."""
    return F.regexp_extract(F.lower(path), r"\.[a-z0-9]+$", 0)


def line_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def _int32(x: Column) -> Column:
    return F.pmod(x + 2**31, F.lit(2**32)) - 2**31


def _folded(text: Column, start: int, step) -> Column:
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(start).cast("long"), lambda h, c: _int32(step(h, F.ascii(c).cast("long"))))


def rolling_hash(text: Column) -> Column:
    """32-bit hash ``31 * h + code point``, from 0."""
    return _folded(text, 0, lambda h, c: h * 31 + c)


def djb2_hash(text: Column) -> Column:
    """32-bit hash ``33 * h + code point``, from 5381."""
    return _folded(text, 5381, lambda h, c: h * 33 + c)


def project_id(path: Column) -> Column:
    """Eight hex digits of the path's rolling hash without its sign."""
    return F.lpad(F.lower(F.hex(F.abs(rolling_hash(path)))), 8, "0")


def like_pattern(term: str, prefix: bool = False, suffix: bool = False, substring: bool = True, case_sensitive: bool = False) -> str:
    """LIKE pattern of a search term; ``%`` and ``_`` in it are literal."""
    t = term if case_sensitive else term.lower()
    t = t.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    if prefix and suffix or substring and not prefix and not suffix:
        return f"%{t}%"
    return f"{t}%" if prefix else f"%{t}" if suffix else t


def text_filter(columns: Sequence[Column], query: str, operator: str = "and", **options) -> Column:
    """Whether the query's terms, all or any, occur in one of ``columns``."""
    case = options.get("case_sensitive", False)
    hits = []
    for term in query.split():
        p = like_pattern(term, **options)
        hits.append(reduce(lambda a, b: a | b, (c.like(p) if case else c.ilike(p) for c in columns)))
    if not hits:
        return F.lit(True)
    return reduce((lambda a, b: a & b) if operator.lower() == "and" else (lambda a, b: a | b), hits)


def occurrences(text: Column, term: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("int")


def text_score(content: Column, query: str) -> Column:
    """How well a text matches: terms found, with repeats, an early first hit and several hits, at most 1."""
    terms = query.lower().split()
    if not terms:
        return F.lit(0.0)
    low = F.lower(content)
    counts = [occurrences(low, t) for t in terms]
    each = [F.when(n > 0, 1.0 + 0.1 * F.least(n - 1, F.lit(3))).otherwise(0.0) for n in counts]
    total = reduce(lambda a, b: a + b, counts)
    first = F.least(*(F.when(F.instr(low, t) > 0, F.instr(low, t) - 1) for t in terms), F.lit(None).cast("int"))
    score = reduce(lambda a, b: a + b, each) / len(terms) + F.when(first < 100, 0.2).otherwise(0.0) + F.when(total > 1, 0.1).otherwise(0.0)
    return F.least(F.when(total > 0, score).otherwise(0.0), F.lit(1.0))


def shortened(content: Column, limit: int) -> Column:
    return F.when(F.length(content) > limit, F.concat(F.substring(content, 1, limit), F.lit("..."))).otherwise(content)


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def comment_ratio(text: Column) -> Column:
    """Percentage of lines that start as a comment."""
    lines = F.split(text, "\n")
    return 100.0 * F.size(F.filter(lines, lambda x: F.trim(x).rlike(r"^(//|#|/\*|\*)"))) / F.size(lines)


def content_density(text: Column) -> Column:
    """Share of non-empty lines times their average length by 100, at most 1."""
    lines = F.split(text, "\n")
    full = F.filter(lines, lambda x: F.trim(x) != "")
    chars = F.aggregate(full, F.lit(0), lambda s, x: s + F.length(x))
    return F.least(F.coalesce(F.size(full) / F.size(lines) * F.try_divide(chars, F.size(full)) / 100, F.lit(0.0)), F.lit(1.0))


def code_complexity(functions: Column, classes: Column, lines: Column) -> Column:
    return F.coalesce(F.least(F.lit(1.0), F.try_divide(10.0 * (functions + classes), lines)), F.lit(0.0))


def human_size(size: Column) -> Column:
    """Bytes by powers of 1024 with two decimals."""
    power = F.when(size > 0, F.least(F.floor(F.log(size) / math.log(1024)), F.lit(4))).otherwise(0)
    unit = F.element_at(F.array(*(F.lit(u) for u in ("B", "KB", "MB", "GB", "TB"))), (power + 1).cast("int"))
    return F.concat_ws(" ", F.format_string("%.2f", (size / F.pow(F.lit(1024.0), power)).cast("double")), unit)


def summary(content: Column, kind: Column, chars: int = 150) -> Column:
    """What a text is about: of code the names that it declares, else its first sentence; at most ``chars`` characters."""
    names = F.regexp_extract_all(content, F.lit(r"\b(?:function|def|class|interface|enum)\s+(\w+)"), F.lit(1))
    declared = F.concat(F.lit("Declares "), F.array_join(F.array_distinct(names), ", "))
    plain = F.trim(F.regexp_replace(content, r"\s+", " "))
    first = F.regexp_extract(plain, r"^(.*?[.!?])(?: |$)", 1)
    out = F.when((kind == "code") & (F.size(names) > 0), declared).when(first != "", first).otherwise(plain)
    return F.when(F.length(out) > chars, F.concat(F.left(out, F.lit(chars)), F.lit("..."))).otherwise(out)
