"""Semantic, text and hybrid search over a chunk store."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnforge.functions import score as S
from tarnforge.functions import text as T
from tarnforge.functions import vector as V


def clamp_limit(limit: int | None, default: int = 20, most: int = 50) -> int:
    return min(max(default if limit is None else limit, 1), most)


#: The column of the store that each filter looks at.
_COLUMN = {
    "project": "project_path", "content_type": "content_type", "role": "role", "extension": "file_extension", "language": "language",
    "min_bytes": "file_size_bytes", "max_bytes": "file_size_bytes", "min_lines": "lines_count", "max_lines": "lines_count",
    "created_from": "created_at", "created_to": "created_at", "compressed": "is_compressed", "exclude_compressed": "is_compressed",
}


@dataclass(frozen=True)
class Filters:
    """Metadata filters; None or an empty list leaves a column alone, 0 is a bound."""

    project: str | None = None
    content_type: str | Sequence[str] | None = None
    role: str | Sequence[str] | None = None
    extension: str | Sequence[str] | None = None
    language: str | Sequence[str] | None = None
    min_bytes: int | None = None
    max_bytes: int | None = None
    min_lines: int | None = None
    max_lines: int | None = None
    created_from: datetime | str | None = None
    created_to: datetime | str | None = None
    compressed: bool | None = None
    exclude_compressed: bool = False

    def predicates(self) -> list[Column]:
        out = [F.col("project_path") == self.project] if self.project is not None else []
        for name, value in (("content_type", self.content_type), ("role", self.role), ("file_extension", self.extension), ("language", self.language)):
            if value is not None and value != [] and value != ():
                out.append(F.col(name) == value if isinstance(value, str) else F.col(name).isin(list(value)))
        for name, low, high in (("file_size_bytes", self.min_bytes, self.max_bytes), ("lines_count", self.min_lines, self.max_lines)):
            out += [F.col(name) >= low] if low is not None else []
            out += [F.col(name) <= high] if high is not None else []
        out += [F.col("created_at") >= F.lit(self.created_from).cast("timestamp")] if self.created_from is not None else []
        out += [F.col("created_at") <= F.lit(self.created_to).cast("timestamp")] if self.created_to is not None else []
        out += [F.col("is_compressed") == self.compressed] if self.compressed is not None else []
        out += [~F.col("is_compressed")] if self.exclude_compressed else []
        return out

    def apply(self, store: DataFrame) -> DataFrame:
        """Rows that pass; plain predicates on columns, so they reach the scan.

        A store of the older schema has no such columns but project_path and created_at: asking for others fails by name.
        """
        asked = {f: c for f, c in _COLUMN.items() if getattr(self, f) not in (None, [], (), False)}
        if missing := sorted({c for c in asked.values() if c not in store.columns}):
            raise ValueError(f"the store has no {', '.join(missing)}: bring it into the current schema first")
        for p in self.predicates():
            store = store.where(p)
        return store


def scored(store: DataFrame, query: Sequence[float], filters: Filters = Filters()) -> DataFrame:
    """``id, vector``'s similarity to ``query`` as ``sim``, content not carried along."""
    return filters.apply(store).select("id", V.cosine(F.col("vector"), V.constant(query)).alias("sim")).where("sim is not null")


def semantic(store: DataFrame, query: Sequence[float], limit: int = 10, threshold: float | None = 0.3, filters: Filters = Filters()) -> DataFrame:
    """The ``limit`` most similar chunks at or above ``threshold``; ids break ties."""
    found = scored(store, query, filters)
    if threshold is not None:
        found = found.where(F.col("sim") >= threshold)
    return found.orderBy(F.desc("sim"), "id").limit(limit)


def distribution(scores: DataFrame, top: int = 50) -> DataFrame:
    """Number, mean and population deviation of the ``top`` best scores."""
    best = scores.orderBy(F.desc("sim"), "id").limit(top)
    return best.agg(F.count("*").alias("n"), F.avg("sim").alias("mean"), F.stddev_pop("sim").alias("std"))


def dynamic_threshold(scores: DataFrame, params: S.Threshold = S.THRESHOLDS["other"], top: int = 50) -> DataFrame:
    """One row: the threshold that the distribution of the best scores gives."""
    return distribution(scores, top).select("n", "mean", "std", S.threshold(F.col("n"), F.col("mean"), F.col("std"), params).alias("threshold"))


def semantic_dynamic(store: DataFrame, query: Sequence[float], limit: int = 10, filters: Filters = Filters(), params: S.Threshold = S.THRESHOLDS["other"]) -> DataFrame:
    """Semantic search whose threshold follows the scores; it lies in a one-row table, joined by broadcast."""
    found = scored(store, query, filters)
    bar = dynamic_threshold(found, params).select("threshold")
    return found.join(F.broadcast(bar), F.col("sim") >= F.col("threshold")).orderBy(F.desc("sim"), "id").limit(limit)


def text_search(store: DataFrame, query: str, limit: int = 20, operator: str = "and", filters: Filters = Filters(), in_paths: bool = True, **options) -> DataFrame:
    """Chunks whose content, or path, has the query's terms, best score first."""
    columns = [F.col("content")] + ([F.col("file_path")] if in_paths else [])
    found = filters.apply(store).where(T.text_filter(columns, query, operator, **options))
    return found.select("id", T.text_score(F.col("content"), query).alias("text_score")).orderBy(F.desc("text_score"), "id").limit(limit)


def hybrid(store: DataFrame, query: Sequence[float], words: str, limit: int = 20, semantic_weight: float = 0.7, text_weight: float = 0.3, threshold: float = 0.3, filters: Filters = Filters(), operator: str = "or") -> DataFrame:
    """Semantic and text results merged by id, scores weighted; both keep where each score is from."""
    total = semantic_weight + text_weight
    a, b = (semantic_weight / total, text_weight / total) if total else (0.5, 0.5)
    left = semantic(store, query, limit, threshold, filters)
    right = text_search(store, words, limit, operator, filters)
    both = left.join(right, "id", "full")
    s, t = F.coalesce("sim", F.lit(0.0)), F.coalesce("text_score", F.lit(0.0))
    out = both.select("id", s.alias("semantic_score"), t.alias("text_score"), (s * a).alias("weighted_semantic"), (t * b).alias("weighted_text"), (s * a + t * b).alias("combined_score"))
    return out.orderBy(F.desc("combined_score"), "id").limit(limit)


def reranked(store: DataFrame, results: DataFrame, now: str, **options) -> DataFrame:
    """``results (id, sim)`` with ``final_score`` by metadata, best first; the store is joined after the search."""
    meta = store.select("id", "updated_at", "file_size_bytes", "content_type", "role", "language")
    joined = results.join(meta, "id")
    final = S.reranked(F.col("sim"), F.col("updated_at"), F.col("file_size_bytes"), F.col("content_type"), F.col("role"), F.col("language"), F.lit(now).cast("timestamp"), **options)
    return joined.select("id", "sim", final.alias("final_score")).orderBy(F.desc("final_score"), "id")


def shaped(store: DataFrame, results: DataFrame, content_chars: int = 500) -> DataFrame:
    """Results with what a reader sees: path, shortened content and metadata."""
    return results.join(store, "id").select("id", "file_path", T.shortened(F.col("content"), content_chars).alias("content"), "content_type", "language")


#: Bytes of queries that are broadcast at once; more of them are searched in further passes over the store.
QUERY_BYTES = 128 << 20


def for_queries(queries: DataFrame, store: DataFrame, k: int = 10, block: int = 256) -> DataFrame:
    """``query_id, id, sim``: the ``k`` nearest vectors of ``store (id, vector)`` for each of ``queries (query_id, vector)``.

    The queries' matrix is broadcast, at most ``QUERY_BYTES`` of it a pass over the store. In a task a block of queries and a batch of vectors are
    one matrix product, and only the task's ``k`` best of each query leave it. Null and zero vectors have no
    direction: such queries find nothing, and such rows are not found.
    """
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.window import Window

    def unit(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Rows as a matrix, scaled to length 1, and which of them have a direction."""
        width = len(column[0].as_py()) if len(column) else 0
        m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)
        size = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(size > 0, size, 1), size[:, 0] > 0

    def nearest(sent):
        def run(batches):
            ids, q = sent.value
            best: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0))] * len(ids)
            for b in batches:
                if not b.num_rows:
                    continue
                v, there = unit(b.column(1))
                own, v = b.column(0).to_numpy()[there], v[there]
                for at in range(0, len(ids), block):
                    sims = q[at : at + block] @ v.T
                    for i, row in enumerate(sims, at):
                        known, scores = best[i]
                        known, scores = np.concatenate([known, own]), np.concatenate([scores, row])
                        if len(known) > k:
                            order = np.lexsort((known, -scores))[:k]
                            known, scores = known[order], scores[order]
                        best[i] = known, scores
            sizes = [len(x) for x, _ in best]
            if sum(sizes):
                columns = np.repeat(ids, sizes), np.concatenate([x for x, _ in best]), np.concatenate([x for _, x in best])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "id", "sim"])

        return run

    spark = store.sparkSession
    rows = store.select("id", F.col("vector").cast("array<double>").alias("vector")).where("vector is not null and size(vector) > 0")
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).where("vector is not null and size(vector) > 0")
    n, width = asked.agg(F.count("*"), F.max(F.size("vector"))).first()
    passes = max(1, -(-n * 8 * (width or 1) // QUERY_BYTES))
    out = spark.createDataFrame([], "query_id long, id long, sim double")
    for i in range(passes if n else 0):
        own = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i).toArrow().combine_chunks()
        if not own.num_rows:
            continue
        q, there = unit(own.column("vector").chunk(0))
        sent = spark.sparkContext.broadcast((own.column("query_id").to_numpy()[there], q[there]))
        out = out.unionByName(rows.mapInArrow(nearest(sent), "query_id long, id long, sim double"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")
