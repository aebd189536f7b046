"""Merkle manifest of a dataset: one digest for all rows, and for each row a proof that it is among them.

Rows are leaves. Those of one source, in the order of their id, are the leaves of the source's tree; the sources' roots, in the
order of the sources, are the leaves of the tree above. Every ``FANOUT`` neighbours become the digest of their hexadecimal texts.

Places are counted without gathering a source anywhere: rows are sorted by range over all tasks, and what precedes a task's rows of
a source is a sum over a table with one row for each task and source. A superblock is ``SPAN = FANOUT ** LEVELS`` neighbours: their places
divided by ``SPAN`` name it, one group collapses its levels, and its root is a leaf of the next, ``SPAN`` times smaller round. Proofs are
made from the top down: the part inside a superblock, then that of the superblock's root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnforge.llm import common

FANOUT, LEVELS = 16, 3
SPAN = FANOUT**LEVELS
#: Hexadecimal digits of a digest.
HEX = 64
#: What a leaf is made of, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(values: dict[str, Column]) -> Column:
    """The digest of a row's fields: each is ``-`` if null, else its length in UTF-8 bytes, a colon and itself."""
    parts = []
    for name in FIELDS:
        text = values[name].cast("string")
        parts.append(F.when(values[name].isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts), 256)


def folded(own: Column, left: Column, right: Column) -> Column:
    """The root that a leaf and its siblings give: level by level the digest of left ones, it and right ones."""
    runs = F.arrays_zip(left.alias("left"), right.alias("right"))
    return F.aggregate(runs, own, lambda at, run: F.sha2(F.concat(run["left"], at, run["right"]), 256))


def proof_digest(left: Column, right: Column) -> Column:
    """The digest of all siblings, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.zip_with(left, right, lambda x, y: F.concat(x, y))), 256)


def _height(n: int) -> int:
    """Levels until one of ``n`` nodes is left."""
    h = 0
    while n > 1:
        n, h = -(-n // FANOUT), h + 1
    return h


def _digest(run: list[str]) -> str:
    return hashlib.sha256("".join(run).encode()).hexdigest()


def _collapse(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of each level, lowest first."""
    out = [nodes]
    for _ in range(levels):
        at = out[-1]
        out.append([_digest(at[i : i + FANOUT]) for i in range(0, len(at), FANOUT)])
    return out


def _runs(keys: list[str], places: list[int]) -> Iterator[tuple[int, int]]:
    """Bounds of each superblock in rows sorted by key and place."""
    start = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[start] or places[i] // SPAN != places[start] // SPAN:
            yield start, i
            start = i


def _group(packs: int) -> Column:
    """The group of a row ``key, block, n``: its superblock, or, for small trees, one of ``packs`` groups of whole trees."""
    return F.when(F.col("n") > SPAN, F.xxhash64("key", "block")).otherwise(F.pmod(F.xxhash64("key"), F.lit(packs))).alias("pack")


def _placed(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves (key, node, ...)`` with each row's place ``i`` in its key by ``order``, and the key's number of rows ``n``."""
    rows, _ = common.cut(leaves, "leaves")
    tie = common.unused(rows, "tie")[0]
    by = ["key", *order, "node", tie]
    ranged = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop(tie)
    # The number of a row holds its task in the bits above 33, and counts within it.
    rows, _ = common.cut(ranged.withColumn("at", F.monotonically_increasing_id()).withColumn("task", F.shiftright("at", 33)), "sorted")
    parts = rows.groupBy("key", "task").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("key").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(
        "key", "task",
        (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("rows").over(Window.partitionBy("key")).alias("n"),
    )
    parts, _ = common.cut(parts, "parts")
    found = rows.join(parts, ["key", "task"]).withColumn("i", F.col("at") + F.col("shift"))
    return found.drop("at", "task", "shift")


class Tree:
    """The trees of all keys of ``leaves (key, node, ...)``: ``levels[j]`` has the leaves of the j-th round of superblocks."""

    def __init__(self, leaves: DataFrame, order: list[str]):
        at, _ = common.cut(_placed(leaves, order), "level")
        self.levels, self.packs = [at], []
        while True:
            most, small = at.agg(F.max("n"), F.sum(F.when(F.col("n") <= SPAN, 1).otherwise(0))).first()
            self.packs.append(max(1, (small or 0) // SPAN))
            if (most or 0) <= 1:
                break
            at, _ = common.cut(self._reduced(at, self.packs[-1]), "level")
            self.levels.append(at)

    @staticmethod
    def _reduced(level: DataFrame, packs: int) -> DataFrame:
        """The roots of all superblocks of a level, as leaves of the next."""

        def collapse(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["key", "i"])
            keys, places, nodes, sizes = (rows[c].tolist() for c in ("key", "i", "node", "n"))
            out = []
            for a, b in _runs(keys, places):
                root = _collapse(nodes[a:b], min(LEVELS, _height(sizes[a])))[-1]
                out.append((keys[a], places[a] // SPAN, -(-sizes[a] // SPAN), root[0]))
            return pd.DataFrame(out, columns=["key", "i", "n", "node"])

        more = level.where("n > 1").select("key", "i", "n", "node", F.expr(f"i div {SPAN}").alias("block"))
        grouped = more.select("key", "i", "n", "node", _group(packs)).groupBy("pack")
        return grouped.applyInPandas(collapse, "key string, i long, n long, node string")

    def roots(self) -> DataFrame:
        """``key, node``: the root of each key's tree."""
        out = None
        for level in self.levels:
            found = level.where("n = 1").select("key", "node")
            out = found if out is None else out.unionByName(found)
        return out

    def proofs(self, above: DataFrame) -> DataFrame:
        """The leaves with ``left`` and ``right``: the siblings before and after, level by level to the top.

        ``above (key, left, right, ...)`` has for each key the siblings of its tree's root; its other columns are added too.
        """
        more = [c for c in above.columns if c not in ("key", "left", "right")]
        upper = None
        for j in range(len(self.levels) - 1, -1, -1):
            level = self.levels[j]
            found = level.where("n = 1").join(above, "key")
            if upper is not None:
                found = found.unionByName(self._inside(level.where("n > 1"), upper, more, self.packs[j]))
            if j:
                upper, _ = common.cut(found, "proofs")
        return found.drop("i", "n", "key")

    @staticmethod
    def _inside(level: DataFrame, upper: DataFrame, more: list[str], packs: int) -> DataFrame:
        """Each row of a level with its siblings inside the superblock, then those of the superblock's root in ``upper``."""

        def prove(rows: pa.Table, roots: pa.Table) -> pa.Table:
            rows = rows.drop_columns(["pack"]).sort_by([("key", "ascending"), ("i", "ascending")])
            keys, places, nodes, sizes = (rows.column(c).to_pylist() for c in ("key", "i", "node", "n"))
            names = [roots.column(c).to_pylist() for c in ("key", "i")]
            at = {x: k for k, x in enumerate(zip(*names, strict=True))}
            lefts, rights = (roots.column(c).to_pylist() for c in ("left", "right"))
            sides, sizes_out, taken = ([], []), [], []
            for a, b in _runs(keys, places):
                levels = _collapse(nodes[a:b], min(LEVELS, _height(sizes[a])))
                joined = [["".join(x[i : i + FANOUT]) for i in range(0, len(x), FANOUT)] for x in levels[:-1]]
                root = at[keys[a], places[a] // SPAN]
                for i in range(b - a):
                    for run in joined:
                        text, place = run[i // FANOUT], i % FANOUT * HEX
                        sides[0].append(text[:place])
                        sides[1].append(text[place + HEX :])
                        i //= FANOUT
                    sides[0].extend(lefts[root])
                    sides[1].extend(rights[root])
                    sizes_out.append(len(joined) + len(lefts[root]))
                    taken.append(root)
            ends = pa.array([0, *sizes_out], pa.int32()).to_numpy().cumsum().astype("int32")
            for name, values in zip(("left", "right"), sides, strict=True):
                rows = rows.append_column(name, pa.ListArray.from_arrays(ends, pa.array(values, pa.string())))
            for name in more:
                rows = rows.append_column(name, roots.column(name).take(pa.array(taken, pa.int64())))
            return rows.select(out)

        out = [*level.columns, "left", "right", *more]
        kinds = {f.name: f.dataType.simpleString() for f in level.schema} | {c: "array<string>" for c in ("left", "right")}
        kinds |= {f.name: f.dataType.simpleString() for f in upper.schema if f.name in more}
        schema = ", ".join(f"`{c}` {kinds[c]}" for c in out)
        rows = level.withColumn("block", F.expr(f"i div {SPAN}")).withColumn("pack", _group(packs)).drop("block")
        # A root is the block-th leaf of the next round; its tree there is as large as the one below says.
        known = level.groupBy("key").agg(F.first("n").alias("n"))
        roots = upper.select("key", "i", "left", "right", *more).join(known, "key")
        roots = roots.withColumn("block", F.col("i")).withColumn("pack", _group(packs)).drop("block", "n")
        return rows.groupBy("pack").cogroup(roots.groupBy("pack")).applyInArrow(prove, schema)


def manifest(leaves: DataFrame) -> DataFrame:
    """``leaves (doc_id, source, leaf, ...)``, one row a leaf, with ``subroot, root, left, right``.

    ``subroot`` is the root of the row's source, ``root`` that of all; ``left`` and ``right`` have, for each level from the leaf to the
    root, the digests of the siblings before and after, joined: ``folded`` makes the root of them again.

    Null doc_id: before all others of its source. Repeated doc_id: in the order of their leaves; equal rows are leaves by themselves. Null
    source: a source, the first. Null and empty texts differ, as the leaf says. A source with one row: its leaf is the subroot.
    Empty table: empty result. Very long texts are one digest by then. Columns named like the added ones are replaced; others come back as they are.
    """
    added = ("subroot", "root", "left", "right")
    own = [c for c in leaves.columns if c.lower() not in ("doc_id", "source", "leaf", *added)]
    # Null first, then by bytes.
    key = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source")))
    rows = leaves.select(
        key.alias("key"), F.col("doc_id").alias("doc"), F.col("leaf").alias("node"), F.col("source").alias("of"),
        *(F.col(f"`{c}`").alias(f"own_{k}") for k, c in enumerate(own)),
    )
    sources = Tree(rows, ["doc"])
    roots = sources.roots()
    top = Tree(roots.select(F.lit("").alias("key"), "node", F.col("key").alias("name")), ["name"])
    none = F.array().cast("array<string>")
    whole = top.roots().select("key", none.alias("left"), none.alias("right"), F.col("node").alias("root"))
    above = top.proofs(whole).select(F.col("name").alias("key"), "left", "right", "root", F.col("node").alias("subroot"))
    above, _ = common.cut(above, "above")
    found = sources.proofs(above)
    return found.select(
        F.col("doc").alias("doc_id"), F.col("of").alias("source"), F.col("node").alias("leaf"),
        *(F.col(f"own_{k}").alias(c) for k, c in enumerate(own)),
        "subroot", "root", "left", "right",
    )
