"""Approximate nearest vectors by an inverted file that is kept on disk, with an exact way for what it leaves out.

Centroids are fitted to a bounded sample; every vector is assigned to its nearest one and lies in that cell's folder. A search reads only
the folders of the cells nearest to its queries: the queries are sent to the vectors, which are not shuffled. How far a cell reaches from its
centroid is kept with it, so for each cell that was left out a bound says whether it could hold something better: the exact search goes on
with those cells alone.

An index is a folder: vectors by batch and cell, the centroids, and one small file that names what is current. ``opened`` reads it in any session,
``added`` appends a batch by replacing that file, so readers of the one before go on undisturbed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnforge.sources import storage

#: Vectors that a centroid fit looks at, at most.
SAMPLE = 50_000
#: Rows of a cell that one task holds where vectors are dealt by cell; a larger cell is several parts.
PART_ROWS = 20_000
#: Bytes of queries, each counted once a cell that it asks, that are sent to the vectors; beyond, both are dealt by cell.
SENT_BYTES = 64 << 20
#: Numbers of probed cells that ``measured`` tries, as parts of all cells, and the recall that ``search`` asks for by default.
STEPS, RECALL = (1 / 64, 1 / 32, 1 / 16, 1 / 8, 1 / 4, 1 / 2, 3 / 4, 1), 0.9


def _unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    m = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1) if len(rows) else np.zeros((0, 1))
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(size > 0, size, 1)


def _vectors(df: DataFrame, key: str) -> DataFrame:
    """Rows whose vector has a direction."""
    v = F.col("vector").cast("array<double>")
    return df.select(F.col(key).cast("long").alias(key), v.alias("vector")).where("vector is not null and exists(vector, x -> x <> 0)")


def fit(vectors: DataFrame, cells: int = 64, sample: int = SAMPLE, rounds: int = 15, seed: int = 5) -> np.ndarray:
    """Centroids of length 1 by spherical k-means over at most about ``sample`` vectors, chosen by a hash of their id."""
    rows = _vectors(vectors, "id")
    n = rows.count()
    if n > sample:
        rows = rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * sample / n))
    m = _unit(rows.orderBy("id").toArrow().column("vector"))
    if not len(m):
        return np.zeros((0, 0))
    draw = np.random.default_rng(seed)
    centres = m[draw.choice(len(m), min(cells, len(m)), replace=False)]
    for _ in range(rounds):
        nearest = (m @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, m)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
    return centres


@dataclass(frozen=True)
class Index:
    """An index at ``path``: its centroids, its batches' cells with their rows and greatest angle, and the recall measured by probes."""

    path: str
    centres: np.ndarray
    batches: dict[str, dict[int, tuple[int, float]]]
    recall: dict[int, float]

    @property
    def counts(self) -> np.ndarray:
        """Rows by cell."""
        out = np.zeros(len(self.centres), np.int64)
        for cells in self.batches.values():
            for c, (n, _) in cells.items():
                out[c] += n
        return out

    @property
    def reach(self) -> np.ndarray:
        """The greatest angle of each cell's vectors from its centroid; -1 where there are none."""
        out = np.full(len(self.centres), -1.0)
        for cells in self.batches.values():
            for c, (_, angle) in cells.items():
                out[c] = max(out[c], angle)
        return out

    def rows(self, spark: SparkSession, cells: Iterable[int] | None = None) -> DataFrame:
        """``id, vector, cell`` of some cells, or of all: only their folders are looked at."""
        wanted = None if cells is None else set(cells)
        folders = [f"{self.path}/rows/batch={b}/cell={c}" for b, known in self.batches.items() for c in known if wanted is None or c in wanted]
        if not folders:
            return spark.createDataFrame([], "id long, vector array<double>, cell int")
        reader = spark.read.schema(f"{_ROWS}, cell int, batch string").option("basePath", f"{self.path}/rows")
        return reader.parquet(*folders).select("id", "vector", "cell")

    def probes(self, recall: float = RECALL) -> int:
        """The least number of probed cells that reached ``recall`` when it was measured; all cells if none did or nothing was."""
        return min((p for p, found in self.recall.items() if found >= recall), default=max(1, len(self.centres)))


_ROWS = "id long, vector array<double>, angle double"


def _saved(spark: SparkSession, index: Index) -> Index:
    kept = {
        "batches": {b: {str(c): list(x) for c, x in cells.items()} for b, cells in index.batches.items()},
        "recall": {str(p): x for p, x in index.recall.items()},
    }
    storage.replace(spark, f"{index.path}/index.json", json.dumps(kept))
    return index


def opened(spark: SparkSession, path: str) -> Index:
    """The index that ``build`` has left at ``path``, in this or another session."""
    kept = json.loads(storage.read(spark, f"{path}/index.json"))
    centres = spark.read.schema("cell int, centre array<double>").parquet(f"{path}/centres").orderBy("cell").collect()
    return Index(
        path,
        np.array([r.centre for r in centres]) if centres else np.zeros((0, 0)),
        {b: {int(c): (int(n), float(angle)) for c, (n, angle) in cells.items()} for b, cells in kept["batches"].items()},
        {int(p): x for p, x in kept["recall"].items()},
    )


def _batch(vectors: DataFrame, path: str, centres: np.ndarray) -> tuple[str, dict[int, tuple[int, float]]]:
    """Write the vectors below their cells' folders: the batch's name, and rows and greatest angle by cell."""
    spark, name = vectors.sparkSession, uuid.uuid4().hex
    if not len(centres):
        return name, {}
    sent = spark.sparkContext.broadcast(centres)

    def assign(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sims = _unit(b.column(1)) @ sent.value.T
            cell = sims.argmax(axis=1)
            angle = np.arccos(np.clip(sims[np.arange(len(cell)), cell], -1, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(angle), pa.array(cell, pa.int32())], ["id", "vector", "angle", "cell"])

    placed = _vectors(vectors, "id").mapInArrow(assign, f"{_ROWS}, cell int")
    at = f"{path}/rows/batch={name}"
    # Few files a cell, and a cell with very many vectors in several tasks.
    placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(at)
    rows = spark.read.schema(f"{_ROWS}, cell int").parquet(at)
    known = rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("reach")).collect()
    return name, {r.cell: (r.n, r.reach) for r in known}


def build(vectors: DataFrame, path: str, cells: int = 64, sample: int = SAMPLE) -> Index:
    """Index every vector of ``vectors (id, vector)`` into a new folder ``path``.

    Null and zero vectors have no direction and are in no cell. Repeated ids: each row. On the driver are the centroids and a few numbers for each.
    """
    spark = vectors.sparkSession
    centres = fit(vectors, cells, sample)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centres)]
    spark.createDataFrame(rows, "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    name, known = _batch(vectors, path, centres)
    return _saved(spark, Index(path, centres, {name: known}, {}))


def added(index: Index, vectors: DataFrame) -> Index:
    """The index with a further batch, placed by the centroids as they are; recall has to be measured anew.

    An index that was built without vectors has no centroids: then vectors that have a direction raise ValueError.
    """
    spark = vectors.sparkSession
    if not len(index.centres) and not _vectors(vectors, "id").isEmpty():
        raise ValueError("the index has no cells: build it from vectors first")
    name, known = _batch(vectors, index.path, index.centres)
    return _saved(spark, Index(index.path, index.centres, index.batches | {name: known}, {}))


def _asked(index: Index, queries: DataFrame, probes: int) -> DataFrame:
    """``query_id, vector, cell, first, bound``: every cell that has rows, nearest first, with the best that it could hold."""
    sent = queries.sparkSession.sparkContext.broadcast((index.centres, index.reach))

    def rank(batches):
        centres, reach = sent.value
        there = np.nonzero(reach >= 0)[0]
        for b in batches:
            if not b.num_rows or not len(there):
                continue
            angle = np.arccos(np.clip(_unit(b.column(1)) @ centres[there].T, -1, 1))
            order = angle.argsort(axis=1, kind="stable")
            bound = np.cos(np.maximum(0, np.take_along_axis(angle, order, 1) - reach[there][order]))
            ends = np.arange(len(angle) + 1, dtype=np.int32) * len(there)
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.ravel(), kind)) for x, kind in ((there[order], pa.int32()), (bound, pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], ["query_id", "vector", "cells", "bounds"])

    found = queries.mapInArrow(rank, "query_id long, vector array<double>, cells array<int>, bounds array<double>")
    each = F.posexplode(F.arrays_zip("cells", "bounds")).alias("rank", "c")
    found = found.select("query_id", "vector", each)
    return found.select("query_id", "vector", F.col("c.cells").alias("cell"), (F.col("rank") < probes).alias("first"), F.col("c.bounds").alias("bound"))


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


_FOUND = "query_id long, id long, sim double"


def _nearest(ids: np.ndarray, v: np.ndarray, asked: np.ndarray, q: np.ndarray, k: int):
    """The ``k`` best rows of ``ids`` and ``v`` for each query, a block of queries at a time: query ids, ids, similarities."""
    for at in range(0, len(q), 256):
        for i, sims in zip(asked[at : at + 256], q[at : at + 256] @ v.T, strict=True):
            order = np.lexsort((ids, -sims))[:k]
            yield np.full(len(order), i), ids[order], sims[order]


def _looked(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows, task by task, for each query in the cells that ``asked (query_id, vector, cell)`` names.

    Queries of at most ``SENT_BYTES`` are sent to where the vectors of the asked cells are read; more are dealt by cell, as the vectors are then.
    """
    spark = asked.sparkSession
    known = asked.groupBy("cell").agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).collect()  # one row a cell at most
    cells = [r.cell for r in known]
    rows = index.rows(spark, cells)
    if sum(r.n * (8 * r.width + 16) for r in known) <= SENT_BYTES:
        return rows.mapInArrow(_sent_search(asked, k), _FOUND) if cells else spark.createDataFrame([], _FOUND)
    return _dealt_search(index, asked, rows, k)


def _sent_search(asked: DataFrame, k: int):
    """A function over rows ``id, vector, cell`` that holds all queries by cell."""
    found = asked.select("query_id", "vector", "cell").toArrow().combine_chunks()
    cell = found.column("cell").to_numpy()
    order = np.argsort(cell, kind="stable")
    ids, q, cell = found.column("query_id").to_numpy()[order], _unit(found.column("vector"))[order], cell[order]
    starts = np.nonzero(np.append(True, cell[1:] != cell[:-1]))[0]
    by = {int(cell[a]): (ids[a:b], q[a:b]) for a, b in zip(starts, [*starts[1:], len(cell)], strict=True)}
    sent = asked.sparkSession.sparkContext.broadcast(by)

    def run(batches):
        best: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def kept(query: int) -> tuple[np.ndarray, np.ndarray]:
            own, sims = (np.concatenate(x) for x in zip(*best[query], strict=True))
            order = np.lexsort((own, -sims))[:k]
            return own[order], sims[order]

        for b in batches:
            cells = b.column(2).to_numpy()
            for c in np.unique(cells):
                if int(c) not in sent.value:
                    continue
                part = b.filter(pa.array(cells == c))
                asked_ids, q = sent.value[int(c)]
                for query, own, sims in _nearest(part.column(0).to_numpy(), _unit(part.column(1)), asked_ids, q, k):
                    if len(query):
                        at = best.setdefault(int(query[0]), [])
                        at.append((own, sims))
                        if len(at) > 8:
                            best[int(query[0])] = [kept(int(query[0]))]
        for query in best:
            own, sims = kept(query)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), query)), pa.array(own), pa.array(sims)], ["query_id", "id", "sim"])

    return run


def _dealt_search(index: Index, asked: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Queries and vectors by cell and part of it: any number of queries."""
    spark = asked.sparkSession
    parts = spark.createDataFrame([(c, -(-int(n) // PART_ROWS)) for c, n in enumerate(index.counts) if n], "cell int, parts int")
    rows = rows.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    wanted = asked.join(F.broadcast(parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            out = list(_nearest(right.column("id").to_numpy(), _unit(right.column("vector")), left.column("query_id").to_numpy(), _unit(left.column("vector")), k))
        kinds = (pa.int64(), pa.int64(), pa.float64())
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [[], [], []]
        return pa.table({c: pa.array(x, kind) for c, x, kind in zip(("query_id", "id", "sim"), columns, kinds, strict=True)})

    pairs = wanted.select("cell", "part", "query_id", "vector").groupBy("cell", "part").cogroup(rows.select("cell", "part", "id", "vector").groupBy("cell", "part"))
    return pairs.applyInArrow(search, _FOUND)


def search(index: Index, queries: DataFrame, k: int = 10, probes: int | None = None) -> DataFrame:
    """``query_id, id, sim``: the ``k`` best in the ``probes`` nearest cells for each of ``queries (query_id, vector)``.

    By default as many cells are probed as ``measured`` found to be enough.
    """
    asked = _asked(index, _vectors(queries, "query_id"), index.probes() if probes is None else probes)
    return _best(_looked(index, asked.where("first").select("query_id", "vector", "cell"), k), k)


def search_exact(index: Index, queries: DataFrame, path: str, k: int = 10, probes: int = 8) -> DataFrame:
    """The ``k`` best of all: the nearest cells first, then each cell that could still hold something as good.

    ``path`` is a new folder in which what the first cells give is kept.
    """
    asked = _asked(index, _vectors(queries, "query_id"), probes)
    _best(_looked(index, asked.where("first").select("query_id", "vector", "cell"), k), k).write.parquet(path)
    found = queries.sparkSession.read.schema(_FOUND).parquet(path)
    bar = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(-1.0).alias("bar"))
    more = asked.where(~F.col("first")).join(bar, "query_id", "left").where(F.col("bound") >= F.coalesce("bar", F.lit(-1.0)) - 1e-9)
    return _best(found.unionByName(_looked(index, more.select("query_id", "vector", "cell"), k)), k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of ``exact``'s rows that ``found`` has too, by query and id."""
    n = exact.count()
    return found.join(exact.select("query_id", "id"), ["query_id", "id"], "left_semi").count() / n if n else 1.0


def measured(index: Index, queries: DataFrame, exact: DataFrame, k: int = 10) -> Index:
    """The index with its recall by number of probed cells, kept on disk: against ``exact``, the true ``k`` best of ``queries``.

    Numbers are tried in turn until the recall is whole.
    """
    found: dict[int, float] = {}
    for step in STEPS:
        probes = max(1, round(step * len(index.centres)))
        if probes not in found:
            found[probes] = recall(search(index, queries, k, probes), exact)
        if found[probes] == 1:
            break
    return _saved(queries.sparkSession, Index(index.path, index.centres, index.batches, found))


def dropped(index_path: str, spark: SparkSession) -> None:
    """Delete an index's folder."""
    storage.delete(spark, index_path)
