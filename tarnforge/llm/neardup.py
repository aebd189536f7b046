"""Near-duplicate groups by MinHash with tensored banding.

Two small collections of ``m`` half keys each (a half key is a pair of minima) are combined pairwise
into ``m * m`` table keys, so ``4 * m`` minima serve as many tables as ``4 * m * m`` independent ones
would. Two texts meet in some table exactly if they share a half key of either collection. A half key
that one text alone holds cannot complete a table key, so table keys are formed only from the others.

Texts that meet are confirmed on their full shingle sets. Members of a table are first held against
pivots, so that a large group becomes one component without all of its pairs. Among what is still apart
after that, an exact prefix filter finds every pair across components that can be similar enough.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnforge.llm import common

#: Rows of hashes that are reduced at once, for very long texts.
_BLOCK = 16384

#: Rows of ids that are broadcast to what they select or name; beyond that both sides are shuffled.
BROADCAST_IDS = 1_000_000


def _signer(m: int, shingle: int, seed: int):
    draw = np.random.default_rng(seed)
    flips = draw.integers(0, 2**64, (4 * m, 1), np.uint64)
    odd = draw.integers(0, 2**64, (4 * m, 1), np.uint64) | np.uint64(1)
    place = np.arange(2 * m, dtype=np.uint64)
    side = (place >= m).astype(np.uint64)

    def sign(batch: pa.RecordBatch):
        n, digest, halves = [], [], []
        for text in batch.column(1).to_pylist():
            u = np.unique(common.windows(common.hashes(common.words_of(text)), shingle))
            n.append(len(u))
            digest.append(xxhash.xxh3_128_digest(u.tobytes()) if len(u) else None)
            if not len(u):
                halves.append(None)
                continue
            low = np.full(4 * m, 2**64 - 1, np.uint64)
            for i in range(0, len(u), _BLOCK):
                low = np.minimum(low, ((u[None, i : i + _BLOCK] ^ flips) * odd).min(axis=1))
            half = common.mix(low[0::2] * np.uint64(0x9E3779B97F4A7C15) + common.mix(low[1::2] + place))
            half = (half & ~np.uint64(1) | side).view(np.int64)  # its last bit says which collection it is of
            halves.append(half)
        columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(halves, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "digest", "halves"])

    return sign


def _shingler(shingle: int):
    def sets(batch: pa.RecordBatch):
        out = [np.unique(common.windows(common.hashes(common.words_of(t)), shingle)).view(np.int64) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "shingles"])

    return sets


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links (u, v)`` whose smallest reachable node is another one.

    Each node hooks onto its smallest neighbour, chains are shortened by pointer jumping, and the links
    between the roots that remain go round again. Nothing is gathered on the driver but emptiness.
    """
    spark = links.sparkSession
    edges, path = common.cut(links.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    roots, used = None, [path]
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent, path = common.cut(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).where("root < node"), "parents")
        used.append(path)
        while True:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("top"))
            jumped, path = common.cut(parent.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "parents")
            used.append(path)
            parent = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        to = lambda c: parent.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        edges, path = common.cut(edges.join(to("u"), "u", "left").join(to("v"), "v", "left").select(F.coalesce("u_root", "u").alias("u"), F.coalesce("v_root", "v").alias("v")).where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
        used.append(path)
        if roots is None:
            roots = parent
        else:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("top"))
            moved = roots.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
            roots = moved.unionByName(parent.join(roots, "node", "left_anti"))
    if roots is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out, _ = common.cut(roots, "roots")
    common.drop(spark, *used)
    return out


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels (rep, comp)`` after the components that ``links (u, v)`` of representatives join are one."""
    at = lambda c: labels.select(F.col("rep").alias(c), F.col("comp").alias(f"{c}_comp"))
    found = components(links.join(at("u"), "u").join(at("v"), "v").select(F.col("u_comp").alias("u"), F.col("v_comp").alias("v")))
    return common.cut(labels.join(found.withColumnRenamed("node", "comp"), "comp", "left").select("rep", F.coalesce("root", "comp").alias("comp")), "labels")[0]


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(u, v)`` whose full shingle sets are at least ``percent`` per cent similar; only sets of texts in a pair are sent."""
    pairs = _aside(pairs)
    own = lambda c: sets.join(_by_size(_aside(pairs.select(F.col(c).alias("doc_id")).distinct())), "doc_id", "left_semi")
    left = own("u").select(F.col("doc_id").alias("u"), F.col("shingles").alias("su"))
    right = own("v").select(F.col("doc_id").alias("v"), F.col("shingles").alias("sv"))
    both = F.size(F.array_intersect("su", "sv"))
    return pairs.join(left, "u").join(right, "v").where(100 * both >= percent * (F.size("su") + F.size("sv") - both)).select("u", "v")


def _aside(groups: DataFrame) -> DataFrame:
    """``groups`` as a table of its own: a join with it can then split the rows of one large group over tasks."""
    return common.cut(groups, "groups")[0]


def _by_size(table: DataFrame) -> DataFrame:
    """A written table of ids, marked for broadcast if it has few rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_IDS else table


def _apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members ``(key, rep, o, comp)`` of those tables' buckets that still hold more than one component."""
    here = members.join(_by_size(labels), "rep")
    split = _aside(here.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key"))
    return here.join(split, "key").select("key", "rep", "o", "comp")


def _prefix_pairs(apart: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(u, v)`` of ``apart``'s texts in different components that can be similar enough: all such pairs.

    Shingles are put in one order, rarest first. Two similar texts share one early in the order of both,
    where what is left of either still suffices for the intersection; shingles of one text alone only count
    as places taken. Noisy copies of one text thus meet at few of their shingles, or at none.
    """
    comp = apart.select(F.col("rep").alias("doc_id"), "comp").distinct()
    here = sets.join(comp, "doc_id").select("doc_id", "comp", F.size("shingles").alias("n"), F.xxhash64("shingles").alias("part"), "shingles")
    tokens = here.select("doc_id", "comp", "n", "part", F.explode("shingles").alias("s"))
    often = tokens.groupBy("s").agg(F.count("*").alias("c")).where("c > 1")
    often = _aside(often)
    ranked = tokens.join(often, "s").groupBy("doc_id", "comp", "n", "part").agg(F.array_sort(F.collect_list(F.struct("c", "s"))).alias("l"))
    early = ranked.select("doc_id", "comp", "n", (F.col("n") - F.size("l")).alias("alone"), F.posexplode("l").alias("i", "t"))
    early = early.select("doc_id", "comp", "n", "t.s", (F.col("n") - F.col("alone") - F.col("i")).alias("left")).where(100 * F.col("left") >= percent * F.col("n"))
    early, _ = common.cut(early, "prefixes")
    split = _aside(early.groupBy("s").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("s"))
    mixed = _aside(early.join(split, "s"))
    # The largest component of each shingle meets the others only.
    most = _aside(mixed.groupBy("s", "comp").count().groupBy("s").agg(F.max_by("comp", "count").alias("major")))
    few = _aside(mixed.join(most, "s").where("comp <> major").select("s", *(F.col(c).alias(f"{c}_x") for c in ("doc_id", "comp", "n", "left"))))
    fits = (F.col("comp_x") != F.col("comp")) & ((100 + percent) * F.least("left", "left_x") >= percent * (F.col("n") + F.col("n_x")))
    return few.join(mixed, "s").where(fits).select(F.least("doc_id_x", "doc_id").alias("u"), F.greatest("doc_id_x", "doc_id").alias("v")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 75, shingle: int = 5, m: int = 10, seed: int = 20240607) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs (doc_id, text, ...)``.

    Links are pairs of texts with ``100 * intersection >= percent * union`` of their shingle sets;
    ``component_id`` is the smallest reachable doc_id, and one document of each component is kept.
    At the threshold itself a pair is missed by all ``m * m`` tables with probability
    ``2 * (1 - 0.75 ** 2) ** m`` (5e-4 for m = 10; 7e-5 at a similarity of 0.8).

    Null or wordless text: an empty set, linked with nothing, kept. Null doc_id: takes no part,
    component_id is null and kept false. Repeated rows: each is returned; rows of one doc_id are one node.
    Empty table: empty result. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    with common.scratch() as made:
        texts = docs.select("doc_id", "text")
        signatures = common.map_arrow(texts, _signer(m, shingle, seed), "doc_id long, n_shingles long, digest binary, halves array<long>")
        signed, signed_at = common.cut(signatures, "signatures")
        able = signed.where("doc_id is not null and digest is not null")
        classes, _ = common.cut(able.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("halves").alias("halves")), "classes")

        # Half keys that more than one class holds, and the table keys that they complete.
        halves = classes.select("rep", F.explode("halves").alias("half"))
        often = _aside(halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half"))
        own = halves.join(often, "half").groupBy("rep").agg(F.collect_set("half").alias("halves"))
        of = lambda side: F.filter("halves", lambda x: x.bitwiseAND(F.lit(1)) == side)
        sides = own.select("rep", of(0).alias("a"), of(1).alias("b"))
        # A text with many half keys that others hold lies in the middle of its group: it comes first.
        keys = sides.select("rep", (-F.size("a") * F.size("b")).cast("short").alias("o"), F.explode("a").alias("x"), "b")
        keys = keys.select("rep", "o", "x", F.explode("b").alias("y")).select(F.xxhash64("x", "y").alias("key"), "rep", "o")
        keys, keys_at = common.cut(keys, "keys")
        first = F.min(F.struct("o", F.col("rep").alias("v"))).alias("p")
        full = _aside(keys.groupBy("key").agg(F.count("*").alias("n"), first).where("n > 1").select("key", F.col("p.o").alias("p_o"), F.col("p.v").alias("v")))
        members, _ = common.cut(keys.join(full, "key"), "members")
        common.drop(spark, keys_at)

        # A text can stand for several classes if rows of one doc_id differ; labels are by node.
        labels, _ = common.cut(classes.select("rep", F.col("rep").alias("comp")).distinct(), "labels")
        wanted = members.select(F.col("rep").alias("doc_id")).distinct()
        meeting = texts.join(_by_size(_aside(wanted)), "doc_id")
        sets, _ = common.cut(common.map_arrow(meeting, _shingler(shingle), "doc_id long, shingles array<long>").where(F.size("shingles") > 0), "sets")

        # First each member meets the one pivot of its tables that comes first, then up to eight of those of other components, then all
        # that is still apart goes through the exact filter.
        pairs = members.where("rep <> v").groupBy(F.col("rep").alias("u")).agg(F.min(F.struct(F.col("p_o").alias("o"), "v")).alias("p")).select("u", "p.v")
        labels = _merged(labels, _confirmed(pairs, sets, percent))
        members = members.select("key", "rep", "o")
        for pivots in (8, 0):
            apart, _ = common.cut(_apart(members, labels), "apart")
            if apart.isEmpty():
                break
            if pivots:
                members = apart.select("key", "rep", "o")
                first = F.min(F.struct("o", F.col("rep").alias("v"), F.col("comp").alias("other"))).alias("p")
                pivot = _aside(apart.groupBy("key").agg(first).select("key", F.col("p.o").alias("p_o"), "p.v", "p.other"))
                nearest = F.slice(F.array_sort(F.collect_set(F.struct(F.col("p_o").alias("o"), "v"))), 1, pivots)
                pairs = apart.join(pivot, "key").where("comp <> other").groupBy(F.col("rep").alias("u")).agg(nearest.alias("p")).select("u", F.explode("p.v").alias("v"))
            else:
                pairs = _prefix_pairs(apart, sets, percent)
            labels = _merged(labels, _confirmed(pairs, sets, percent))

        # Rows of one doc_id are one node; where their texts differ, it stands for several sets.
        repeated = able.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo < hi").select("doc_id")
        by_class = classes.select("digest", "rep").join(labels.select("rep", "comp"), "rep")
        placed = able.select("doc_id", "digest").join(by_class, "digest").select("doc_id", "comp")
        if not repeated.isEmpty():
            of = placed.distinct()
            least = of.join(repeated, "doc_id").groupBy("doc_id").agg(F.min("comp").alias("v"))
            joined = components(of.join(least, "doc_id").select(F.col("comp").alias("u"), "v"))
            placed = placed.join(joined.withColumnRenamed("node", "comp"), "comp", "left").select("doc_id", F.coalesce("root", "comp").alias("comp"))
        placed, placed_at = common.cut(placed.groupBy("doc_id").agg(F.min("comp").alias("component_id")), "placed")
        common.release(spark, made, signed_at, placed_at)
    out = signed.select("doc_id", "n_shingles").join(placed, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, columns as they are.

    Rows without a doc_id cannot be told apart and stay; rows that share a doc_id stay or go together. Null and
    wordless texts stay. Empty table: empty result. Other columns play no part, whatever their names.
    """
    found = near_duplicates(docs, **options)
    gone = found.where("doc_id is not null and not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
