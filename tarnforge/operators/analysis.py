"""Semantic units of source texts, their relations, and what a segmentation would suggest."""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnforge.operators import syntax
from tarnforge.operators.chunking import symbols

#: Which unit comes first where several begin on a line (fixed values).
PRIORITY = {"function": 100, "method": 100, "class": 90, "import": 80, "interface": 70, "export": 60, "block": 50, "comment": 40, "type": 30}
_BRANCH = re.compile(r"\b(?:if|for|while|case|catch|except|elif)\b|&&|\|\||\?(?![.?:])|\b(?:and|or)\b")
_STRINGS = re.compile(r"""("{3}|'{3}).*?\1|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|//[^\n]*|/\*.*?\*/|#[^\n]*""", re.S)


def complexity(code: str, language: str | None = None) -> int:
    """One more than the number of branches: by syntax tree for Python that parses, else by keywords outside strings and comments."""
    if language == "python":
        try:
            tree = ast.parse(code)
        except (SyntaxError, ValueError, RecursionError):
            pass
        else:
            kinds = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.match_case, ast.comprehension)
            return 1 + sum(isinstance(n, kinds) for n in ast.walk(tree)) + sum(len(n.values) - 1 for n in ast.walk(tree) if isinstance(n, ast.BoolOp))
    return 1 + len(_BRANCH.findall(_STRINGS.sub(" ", code)))


def documentation(code: str) -> str:
    """The first doc comment or doc string."""
    if m := re.search(r"/\*\*(.*?)\*/", code, re.S):
        return "\n".join(x.strip().lstrip("*").strip() for x in m[1].strip().splitlines()).strip()
    if m := re.search(r"(\"{3}|'{3})(.*?)\1", code, re.S):
        return m[2].strip()
    return ""


def tags(kind: str, language: str | None, head: str, level: int) -> list[str]:
    out = [f"type:{kind}", f"language:{language or 'unknown'}"]
    if m := re.search(r"\b(public|private|protected)\b", head):
        out.append(f"visibility:{m[1]}")
    out += [f"modifier:{w}" for w in ("static", "async") if re.search(rf"\b{w}\b", head)]
    return [*out, "complexity:high" if level > 10 else "complexity:medium" if level > 5 else "complexity:low"]


@dataclass(frozen=True)
class Unit:
    id: str
    kind: str
    name: str
    first: int
    last: int
    parent: str | None
    code: str
    documentation: str
    complexity: int
    tags: list[str]


def units(path: str, language: str | None, text: str) -> list[Unit]:
    """Declarations, exports, types, blocks, runs of imports and of comments, outermost first; a unit names the class around it."""
    tree = syntax.Tree(text, language)
    lines, found = text.split("\n"), []
    declared = {n.start for n in tree.nodes if n.kind in PRIORITY and n.kind != "export"}
    for n in tree.nodes:
        if n.kind == "export" and n.start in declared:  # the declaration says so itself
            continue
        around = n.parent
        while around and around.kind != "class":
            around = around.parent
        if n.kind == "import" and found and found[-1][0] == "import" and found[-1][4] is around and found[-1][3] == n.first - 1:
            found[-1][3] = n.last
        else:
            found.append([n.kind, n.name, n.first, n.last, around])
    out: list[Unit] = []
    for kind, name, first, last, around in sorted(found, key=lambda f: (f[2], -PRIORITY[f[0]], -f[3])):
        code = "\n".join(lines[first - 1 : last])
        level = complexity(code, language) if kind in ("function", "method", "class") else 1
        parent = f"{path}:class:{around.name}:{around.first}" if around else None
        out.append(Unit(f"{path}:{kind}:{name}:{first}", kind, name, first, last, parent, code, documentation(code), level, tags(kind, language, lines[first - 1], level)))
    return out


UNITS = "file string, id string, kind string, name string, first_line int, last_line int, parent string, code string, documentation string, complexity int, tags array<string>"


def unit_rows(docs: DataFrame) -> DataFrame:
    """The units of every row of ``docs (path, language, content)``, by file in Arrow batches."""

    def run(batches):
        for b in batches:
            rows = [(p, u.id, u.kind, u.name, u.first, u.last, u.parent, u.code, u.documentation, u.complexity, u.tags) for p, lang, t in zip(*(c.to_pylist() for c in b.columns), strict=True) for u in units(p or "", lang, t or "")]
            text, number = pa.string(), pa.int32()
            kinds = [text, text, text, text, number, number, text, text, text, number, pa.list_(text)]
            names = [c.split()[0] for c in UNITS.replace("array<string>", "list").split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return docs.select(F.col("path").cast("string").alias("path"), "language", "content").mapInArrow(run, UNITS)


def dependencies(code: Column) -> Column:
    """Modules that a unit's code imports, in either language's form."""
    found = [F.regexp_extract_all(code, F.lit(p), F.lit(1)) for p in (r"from\s+['\"]([^'\"]+)['\"]", r"(?m)^\s*import\s+([\w.]+)\s*$", r"(?m)^\s*from\s+([\w.]+)\s+import\b")]
    return F.array_distinct(F.concat(*found))


def dependency_graph(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes, and edges ``depends_on`` and ``child_of``, of unit rows."""
    depends = rows.select(F.col("id").alias("source"), F.explode(dependencies(F.col("code"))).alias("target"), F.lit("depends_on").alias("type"))
    child = rows.where("parent is not null").select(F.col("id").alias("source"), F.col("parent").alias("target"), F.lit("child_of").alias("type"))
    return rows.select("id", F.col("kind").alias("type"), "name"), depends.unionByName(child)


def unit_metrics(rows: DataFrame) -> DataFrame:
    """By kind: number, mean complexity and lines, documented ones in per cent."""
    lines = F.col("last_line") - F.col("first_line") + 1
    return rows.groupBy("kind").agg(F.count("*").alias("units"), F.avg(F.col("complexity").cast("double")).alias("avg_complexity"), F.avg(lines.cast("double")).alias("avg_lines"), (100 * F.avg(F.when(F.col("documentation") != "", 1.0).otherwise(0.0))).alias("documented_percent"))


def mixed(code: Column) -> Column:
    """Whether prose and code share a chunk: both at least three lines and a third of it."""
    lines = F.filter(F.split(code, "\n"), lambda x: F.trim(x) != "")
    coded = F.size(F.filter(lines, lambda x: x.rlike(r"[;{}()=]|^\s*(?:def|class|import|from|return)\b")))
    prose = F.size(F.filter(lines, lambda x: x.rlike(r"^[A-Z][^;{}()=]{20,}[.!?]$")))
    return (coded >= 3) & (prose >= 3) & (F.least(coded, prose) * 3 >= F.size(lines))


def whole(kind: Column, code: Column) -> Column:
    """Whether a declaration's braces close, as far as it has any."""
    count = lambda c: F.length(code) - F.length(F.replace(code, F.lit(c), F.lit("")))
    return ~kind.isin("function", "method", "class") | (count("{") == count("}"))


def accepted(rows: DataFrame) -> DataFrame:
    """Unit rows that neither mix prose with code nor are cut."""
    return rows.where(~mixed(F.col("code")) & whole(F.col("kind"), F.col("code")))


def quality(chunks: DataFrame) -> DataFrame:
    """One row: atomic, documented and related chunks in per cent, of ``chunks (granularity, documentation, relations)``."""
    share = lambda c: F.coalesce(100 * F.avg(F.when(c, 1.0).otherwise(0.0)), F.lit(0.0))
    return chunks.agg(F.count("*").alias("chunks"), share(F.col("granularity") == "atomic").alias("atomic_rate"), share(F.length(F.coalesce("documentation", F.lit(""))) > 0).alias("documented_rate"), share(F.col("relations") > 0).alias("related_rate"))


def granularity_stats(chunks: DataFrame) -> DataFrame:
    """Chunks by kind and granularity: their number, mean lines and complexity, and how many are documented; of ``rules.chunk_rows``."""
    lines = (F.col("last_line") - F.col("first_line") + 1).cast("double")
    documented = F.count_if(F.length(F.coalesce("documentation", F.lit(""))) > 0)
    return chunks.groupBy("kind", "granularity").agg(
        F.count("*").alias("chunks"), F.avg(lines).alias("avg_lines"), F.avg(F.col("complexity").cast("double")).alias("avg_complexity"), documented.alias("documented")
    )


def coherence(chunks: DataFrame, near: int = 50, far: int = 200) -> DataFrame:
    """``file, coherence``: share of a file's pairs of chunks that begin close together, further ones counting half.

    Pairs are counted by windows over the lines of ``chunks (file, line)``, so none are made.
    """
    order = Window.partitionBy("file").orderBy("line")
    within = lambda d: F.count("*").over(order.rangeBetween(0, d - 1)) - 1
    same = F.count("*").over(order.rangeBetween(0, 0)) - 1
    seen = chunks.select("file", "line").withColumns({"n": within(near), "f": within(far), "s": same})
    sums = seen.groupBy("file").agg(F.count("*").alias("k"), F.sum(F.col("n") - F.col("s") / 2).alias("n"), F.sum(F.col("f") - F.col("s") / 2).alias("f"))
    pairs = F.col("k") * (F.col("k") - 1) / 2
    return sums.select("file", F.coalesce(F.try_divide(100 * (F.col("n") + (F.col("f") - F.col("n")) / 2), pairs), F.lit(100.0)).alias("coherence"))


def references(chunks: DataFrame) -> DataFrame:
    """``id, refers_to``: chunks of a file whose code has the name of another as a word; ``contained`` finds names inside of words too.

    ``chunks (file, id, name, code)``.
    """
    words = chunks.select("file", "id", F.explode(F.array_distinct(F.regexp_extract_all("code", F.lit(r"[A-Za-z_]\w*"), F.lit(0)))).alias("name"))
    names = chunks.where("name <> ''").select("file", "name", F.col("id").alias("refers_to"))
    return words.join(names, ["file", "name"]).where("id <> refers_to").select("id", "refers_to").distinct()


#: Chunks of a file that one task looks through.
TOGETHER = 2000
#: Names of a file that one automaton has, owners of a file's names that one task has, and about how many owners of a name are one row.
NAMES, OWNERS, PIECE = 300_000, 2_000_000, 100_000


def contained(chunks: DataFrame) -> DataFrame:
    """``id, refers_to``: chunks of a file whose code has the name of another anywhere, whatever the case.

    ``chunks (file, id, name, code)``. One automaton over a file's names reads each code once, so that work is linear in a file. A file's chunks are dealt
    over tasks, each with the file's names and their owners; beyond ``NAMES`` names or ``OWNERS`` chunks of a file these are dealt, too, and its codes read
    once for each deal. A task gives, for each name, who has it in the code and who owns it; the pairs, which grow with the square of a file, are made from
    that row by row and are neither shuffled nor held. Only pairs with an owner whose id several rows share are, to tell repeated ones. Null and empty names
    are found nowhere, and null ids and files refer to nothing.
    """
    rows = chunks.select("file", "id", F.lower("code").alias("code"), F.lower("name").alias("name")).where("file is not null and id is not null")
    owners = rows.where("name <> ''").select("file", "name", "id")
    codes = rows.select("file", "id", "code")
    shared = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    if shared.isEmpty():
        return _referring(codes, owners)
    several = owners.join(shared, "id", "left_semi").distinct()
    return _referring(codes, owners.join(shared, "id", "left_anti")).unionByName(_referring(codes, several).distinct())


def _referring(codes: DataFrame, owners: DataFrame) -> DataFrame:
    """``id, refers_to`` of ``codes (file, id, code)`` and ``owners (file, name, id)``; a pair comes once for each name that it is found by."""
    import ahocorasick

    of = owners.schema["id"].dataType.simpleString()
    deals = lambda n, most: F.ceil(F.col(n) / most).cast("int")
    kinds = owners.groupBy("file").agg(F.count("*").alias("owned"), F.count_distinct("name").alias("names")).select("file", deals("owned", PIECE).alias("pieces"), F.greatest(deals("names", NAMES), deals("owned", OWNERS)).alias("slices"))
    parts = codes.groupBy("file").agg(F.count("*").alias("n")).select("file", deals("n", TOGETHER).alias("parts"))
    # Of the files that are dealt at all there are at most as many as rows by TOGETHER: codes meet them without a shuffle.
    large = F.broadcast(parts.join(kinds, "file", "left").where("parts > 1 or pieces > 1 or slices > 1"))
    numbers = {c: F.coalesce(c, F.lit(1)) for c in ("parts", "pieces", "slices")}
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    number = lambda n, *by: F.pmod(F.xxhash64(*by), F.col(n)).cast("int")
    # All codes of an id lie in one part, so that it has a name once.
    dealt = codes.join(large, "file", "left").withColumns(numbers).select("file", number("parts", "id").alias("part"), every("slices").alias("slice"), "id", "code")
    held = owners.join(large, "file", "left").withColumns(numbers).groupBy("file", "parts", "slices", "name", number("pieces", "id").alias("piece")).agg(F.sort_array(F.collect_list("id")).alias("owners"))
    sent = held.select(F.col("file").alias("of"), number("slices", "name", "piece").alias("place"), every("parts").alias("number"), "name", "owners")

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, has = left.schema.field("id").type, {}
        if left.num_rows and right.num_rows:
            at: dict[str, list[int]] = {}
            automaton = ahocorasick.Automaton()
            for i, n in enumerate(right.column("name").to_pylist()):
                if n not in at:
                    automaton.add_word(n, n)
                at.setdefault(n, []).append(i)
            automaton.make_automaton()
            for own, code in zip(left.column("id").to_pylist(), left.column("code").to_pylist(), strict=True):
                for n in {n for _, n in automaton.iter(code or "")}:
                    has.setdefault(n, {})[own] = None
        found = [(list(who), i) for n, who in has.items() for i in at[n]]
        named = right.column("owners").take(pa.array([i for _, i in found], pa.int64())).cast(pa.list_(ids))
        return pa.table({"ids": pa.array([who for who, _ in found], pa.list_(ids)), "owners": named})

    met = dealt.groupBy("file", "part", "slice").cogroup(sent.groupBy("of", "number", "place"))
    found = met.applyInArrow(find, f"ids array<{of}>, owners array<{of}>")
    return found.select(F.explode("ids").alias("id"), "owners").select("id", F.explode("owners").alias("refers_to")).where("id <> refers_to")


def suggestions(text: str, content_type: str) -> list[tuple[int, int, str, float]]:
    """``(first line, last line, kind, confidence)`` of the parts that a text falls into."""
    if content_type == "code":
        return [(a, b, k, 0.9 if k == "class" else 0.85) for k, _, a, b in symbols(text)]
    lines = text.split("\n")
    if content_type == "doc":
        heads = [i for i, x in enumerate(lines) if re.match(r"#{1,6}\s+\S", x)]
        edges = sorted({0, *heads, len(lines)})
        sections = [(a + 1, b, "section", 0.7) for a, b in zip(edges, edges[1:]) if b - a > 1]
    else:
        sections = []
    out, at = sections, 0
    for block in re.split(r"\n\s*\n", text):
        n = block.count("\n") + 1
        if n > 1 and block.strip():
            out.append((at + 1, at + n, "paragraph", 0.6))
        at += n + 1
    return sorted(out)


def optimised(text: str, chunks: list[str], found: list[tuple[int, int, str, float]], sure: float = 0.6) -> list[str]:
    """The suggested parts instead of ``chunks``, if those that are sure and of a good length cover the text."""
    lines = text.split("\n")
    parts = ["\n".join(lines[a - 1 : b]) for a, b, _, c in found if c > sure]
    parts = [p for p in parts if 50 < len(p) < 2000]
    return parts if sum(map(len, parts)) >= 0.8 * len(text) else chunks


def class_parts(code: str, group: int = 3) -> list[tuple[str, str]]:
    """A class as ``(kind, code)``: its head with the fields, then its methods by visibility in groups.

    The head is what stands outside the methods. Methods keep their order inside a visibility.
    """
    tree = syntax.Tree(code)
    top = next((n for n in tree.nodes if n.kind == "class"), None)
    lines = code.split("\n")
    taken: set[int] = set()
    methods: dict[str, list[str]] = {"public": [], "protected": [], "private": []}
    for n in top.children if top else ():
        if n.kind == "method":
            first = n.first - len(syntax.decorators(tree, n))
            methods[syntax.visibility(tree, n)].append("\n".join(lines[first - 1 : n.last]))
            taken |= set(range(first - 1, n.last))
    out = [("definition", "\n".join(x for i, x in enumerate(lines) if i not in taken))]
    for kind, own in methods.items():
        out += [(f"{kind} methods", "\n".join(own[i : i + group])) for i in range(0, len(own), group)]
    return out


def problems(chunk: dict) -> list[str]:
    """What is wrong with a semantic chunk, by the schema's rules; empty if nothing is."""
    place = chunk.get("position") or {}
    rules = [
        ("id is missing", bool(chunk.get("id"))),
        ("unknown type", chunk.get("type") in PRIORITY),
        ("code is empty", bool((chunk.get("code") or "").strip())),
        ("language is missing", bool(chunk.get("language"))),
        ("file is missing", bool(chunk.get("file"))),
        ("lines are out of order", 1 <= place.get("first", 0) <= place.get("last", 0)),
        ("quality is out of range", 0 <= chunk.get("quality", -1) <= 100),
        ("relevance is out of range", 0 <= chunk.get("relevance", -1) <= 100),
        ("tokens are negative", chunk.get("tokens", 0) >= 0),
    ]
    return [name for name, holds in rules if not holds]


def problem_rows(chunks: DataFrame) -> DataFrame:
    """``id, problems``: the same rules over ``chunks (id, type, code, language, file, first, last, quality, relevance, tokens)``, natively."""
    text = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    within = lambda c: ~F.coalesce(F.col(c).between(0, 100), F.lit(False))
    first, last = F.coalesce("first", F.lit(0)), F.coalesce("last", F.lit(0))
    rules = [
        ("id is missing", F.coalesce("id", F.lit("")) == ""),
        ("unknown type", ~F.coalesce(F.col("type").isin(*PRIORITY), F.lit(False))),
        ("code is empty", text(F.regexp_replace("code", r"\s", ""))),
        ("language is missing", F.coalesce("language", F.lit("")) == ""),
        ("file is missing", F.coalesce("file", F.lit("")) == ""),
        ("lines are out of order", ~((first >= 1) & (first <= last))),
        ("quality is out of range", within("quality")),
        ("relevance is out of range", within("relevance")),
        ("tokens are negative", F.coalesce("tokens", F.lit(0)) < 0),
    ]
    found = F.filter(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules)), lambda x: x.isNotNull())
    return chunks.select("id", found.alias("problems")).where(F.size("problems") > 0)
