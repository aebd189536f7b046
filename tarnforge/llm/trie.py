"""The prefix trie of conversations, and what sharing prefixes saves.

A node is a distinct sequence of first turns, known by a digest that goes on from its parent's. Totals of subtrees come by peeling leaves:
a node holds a counter of children that it still waits for; nodes whose counter is zero are complete and send their totals
to their parents, in one round after another, until only the root is left and finishes. What one conversation alone goes through has one leaf
and saves nothing, so it is complete at once: rounds and messages are those of shared prefixes. Each round is a table of the
nodes that are still open; complete ones are appended to another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnforge.llm import common

#: Every so many conversations share the first turns of the first of them; at most so many less one.
SHARE, HEADS = 5, 9
#: Ids that one piece of a joined list has at most.
PIECE = 100_000


def turn_lists(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: the turns of each conversation in their order, null first; repeated ones by role and text."""
    empty = F.lit("")
    turn = F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    rows = conversations.where("conv_id is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return rows.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))


def rebuilt(lists: DataFrame) -> DataFrame:
    """``lists (conv_id, turns)`` with each conversation's first turns replaced by those of the first of its ``SHARE``.

    How many is fixed by a checksum of its id; all if there are fewer, none if that conversation does not exist.
    """
    lists, _ = common.cut(lists, "turns")
    n = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(HEADS)).cast("int")
    first = F.col("conv_id") % SHARE == 0
    heads = lists.where(first).select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEADS - 1).alias("heads"))
    rest = lists.where(~first).withColumn("base", F.expr(f"conv_id - conv_id % {SHARE}")).join(heads, "base", "left")
    none = F.slice("turns", 1, 0)
    own = F.slice("turns", n + 1, F.greatest(F.size("turns") - n, F.lit(0)))
    joined = F.concat(F.slice(F.coalesce("heads", none), F.lit(1), n), own)
    return lists.where(first).unionByName(rest.select("conv_id", joined.alias("turns")))


def _paths(lists: DataFrame) -> DataFrame:
    """A row for each conversation and node that it goes through: the node's key, parent and last text's bytes, and whether it ends there."""

    def walk(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, depths, keys, parents, sizes, last = [], [], [], [], [], []
        for conv, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            key, above = b"", None
            turns = turns or []
            for d in range(len(turns) + 1):
                size = 0
                if d:
                    role, text = (turns[d - 1][c].encode("utf-8", "surrogatepass") for c in ("role", "text"))
                    above, size = key, len(text)
                    key = hashlib.blake2b(b"".join((above, b"%d:" % len(role), role, text)), digest_size=16).digest()
                ids.append(conv)
                depths.append(d)
                keys.append(key)
                parents.append(above)
                sizes.append(size)
                last.append(d == len(turns))
        columns = [pa.array(ids, pa.int64()), pa.array(depths, pa.int64()), pa.array(keys, pa.binary()), pa.array(parents, pa.binary()), pa.array(sizes, pa.int64()), pa.array(last)]
        yield pa.RecordBatch.from_arrays(columns, ["conv_id", "depth", "key", "parent", "bytes", "last"])

    return common.map_arrow(lists, walk, "conv_id long, depth long, key binary, parent binary, bytes long, last boolean")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``key, conv_id``, sorted, as pieces of the comma-joined list of each key."""
    at, ids = None, []

    def piece() -> pa.RecordBatch:
        text = ",".join(map(str, ids))
        return pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([text])], ["key", "first", "ids"])

    for b in batches:
        for key, conv in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if ids and (key != at or len(ids) >= PIECE):
                yield piece()
                ids = []
            at = key
            ids.append(conv)
    if ids:
        yield piece()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each key's list; its pieces come one after the other."""
    at, digest = None, None
    for b in batches:
        keys, out = [], []
        for key, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if digest is not None and key == at:
                digest.update(b",")
            else:
                if digest is not None:
                    keys.append(at)
                    out.append(digest.hexdigest())
                at, digest = key, hashlib.sha256()
            digest.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(out, pa.string())], ["key", "ends"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([digest.hexdigest()])], ["key", "ends"])


def _ends(paths: DataFrame) -> DataFrame:
    """``key, ends``: the digest of the ids of the conversations that end at a node.

    A digest is made in one go, so a node's ids meet in one task, but as pieces that many tasks have sorted and joined, and one piece at a time.
    """
    rows = paths.where("last").select("key", "conv_id")
    pieces = common.map_tasks(rows.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id"), _joined, "key binary, first long, ids string")
    pieces = pieces.repartition("key").sortWithinPartitions("key", "first").select("key", "ids")
    return common.map_tasks(pieces, _hashed, "key binary, ends string")


def _peeled(nodes: DataFrame) -> DataFrame:
    """``key, leaves, saved`` of the shared ones of ``nodes (key, parent, n_convs, n_children, own)``."""
    spark = nodes.sparkSession
    shared = nodes.where("n_convs > 1")
    # The subtrees of one conversation are complete: the top of each sends one leaf to its parent.
    sent = nodes.where("n_convs = 1").groupBy("parent").agg(F.count("*").alias("n")).withColumnRenamed("parent", "key")
    begun = shared.join(sent, "key", "left").select(
        "key", "parent",
        (F.col("n_children") - F.coalesce("n", F.lit(0))).alias("waiting"),
        F.when(F.col("n_children") == 0, 1).otherwise(F.coalesce("n", F.lit(0))).alias("leaves"),
        F.col("own").alias("saved"),
    )
    done = common.fresh(spark, "done")
    state, path = common.cut(begun, "open")
    schema = "key binary, leaves long, saved long"
    spark.createDataFrame([], schema).write.parquet(done)
    while state.count():
        complete = state.where("waiting = 0")
        complete.select("key", "leaves", "saved").write.mode("append").parquet(done)
        messages = complete.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(
            F.count("*").alias("n"), F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")
        )
        none = F.lit(0)
        following = state.where("waiting > 0").join(messages, "key", "left").select(
            "key", "parent",
            (F.col("waiting") - F.coalesce("n", none)).alias("waiting"),
            (F.col("leaves") + F.coalesce("more_leaves", none)).alias("leaves"),
            (F.col("saved") + F.coalesce("more_saved", none)).alias("saved"),
        )
        old = path
        state, path = common.cut(following, "open")
        common.drop(spark, old)
    common.drop(spark, path)
    return spark.read.schema(schema).parquet(done)


def trie(lists: DataFrame) -> DataFrame:
    """The nodes of the trie of ``lists (conv_id, turns array<struct<role, text>>)``, one row a conversation.

    Columns: ``key`` and ``parent`` (digests), ``conv_id`` (the smallest that goes through), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves`` (childless nodes of the subtree), ``saved_tokens`` (over the subtree, a node's last text's bytes for each
    conversation but one), ``ends_sha256`` (of the ids that end at the node, ascending and comma-joined).

    Conversations without turns end at the root. No conversations: no nodes, no root either. Null roles and texts are to be
    replaced before, as ``turn_lists`` does, which also leaves out rows without a conv_id: they belong to no conversation. Very long
    texts are digests here; a long conversation is one row. A prefix that several conversations share takes a round for each of its turns.
    """
    spark = lists.sparkSession
    paths, _ = common.cut(_paths(lists.select("conv_id", "turns")), "paths")
    same = {c: F.any_value(c).alias(c) for c in ("parent", "depth", "bytes")}
    nodes = paths.groupBy("key").agg(*same.values(), F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    nodes, found_at = common.cut(nodes, "nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes, _ = common.cut(nodes.withColumn("own", (F.col("n_convs") - 1) * F.col("bytes")), "nodes")
    common.drop(spark, found_at)
    totals = _peeled(nodes)
    found = nodes.join(totals, "key", "left").join(_ends(paths), "key", "left")
    found, _ = common.cut(found, "totals")
    above = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    found = common.join_hot(found, above, "parent", "left")
    return found.select(
        "key", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"),
        F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
