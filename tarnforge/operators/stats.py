"""Statistics views over the chunk store and its history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnforge.functions.text import clean_path
from tarnforge.sources import storage

#: Upper bounds in bytes of the size classes (fixed values).
SIZES = (("tiny", 1024), ("small", 10_240), ("medium", 102_400), ("large", 1_048_576))


def _count_if(c: Column) -> Column:
    return F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")


def _mean(c: Column | str) -> Column:
    return F.avg((F.col(c) if isinstance(c, str) else c).cast("double"))


def compression_percent() -> Column:
    return F.try_divide(100.0 * (F.col("original_size_bytes") - F.col("file_size_bytes")), F.col("original_size_bytes"))


def store_stats(store: DataFrame) -> DataFrame:
    return store.groupBy("project_path", "content_type", "role").agg(F.count("*").alias("chunks"), F.countDistinct("file_path").alias("files"), _mean(F.length("content")).alias("avg_length"), F.min("created_at").alias("first_created"), F.max("updated_at").alias("last_updated"), _count_if(F.col("is_compressed")).alias("compressed"))


def coverage(store: DataFrame) -> DataFrame:
    """By project. ``total_chunks`` sums a file's own total over its chunks; ``chunks`` counts them once."""
    return store.groupBy("project_path").agg(F.countDistinct("file_path").alias("chunk_paths"), F.countDistinct(clean_path(F.col("file_path"))).alias("files"), F.sum(F.col("total_chunks").cast("long")).alias("total_chunks"), F.count("*").alias("chunks"), F.max("updated_at").alias("last_updated"))


def project_view(store: DataFrame) -> DataFrame:
    return store.groupBy("project_path").agg(F.count("*").alias("chunks"), F.countDistinct("file_path").alias("files"), F.countDistinct("language").alias("languages"), F.countDistinct("file_extension").alias("extensions"), F.sum("file_size_bytes").cast("long").alias("bytes"), _mean("lines_count").alias("avg_lines"), _mean(F.when(F.col("is_compressed"), compression_percent())).alias("avg_compression"))


def size_class() -> Column:
    out = F
    for name, bound in SIZES:
        out = out.when(F.col("file_size_bytes") < bound, name)
    return out.otherwise("huge")


def size_distribution(store: DataFrame) -> DataFrame:
    return store.groupBy(size_class().alias("size_class")).agg(F.count("*").alias("chunks"), _mean("file_size_bytes").alias("avg_bytes"), F.min("file_size_bytes").cast("long").alias("min_bytes"), F.max("file_size_bytes").cast("long").alias("max_bytes"), F.sum("file_size_bytes").cast("long").alias("bytes"))


def temporal_coverage(store: DataFrame) -> DataFrame:
    return store.groupBy("project_path", F.to_date("created_at").alias("day")).agg(F.count("*").alias("chunks"), F.countDistinct("file_path").alias("files"))


def compression_stats(store: DataFrame) -> DataFrame:
    """Compressed chunks by project and type."""
    return store.where("is_compressed").groupBy("project_path", "content_type").agg(F.count("*").alias("chunks"), F.sum("original_size_bytes").cast("long").alias("original_bytes"), F.sum("file_size_bytes").cast("long").alias("bytes"), _mean(compression_percent()).alias("avg_compression"))


def performance_stats(store: DataFrame) -> DataFrame:
    """One row over the whole store, in one pass."""
    return store.agg(F.count("*").alias("chunks"), F.countDistinct("project_path").alias("projects"), F.countDistinct("file_path").alias("files"), _count_if(F.col("content_type") == "code").alias("code"), _count_if(F.col("content_type") == "doc").alias("doc"), _count_if(F.col("is_compressed")).alias("compressed"), _mean("file_size_bytes").alias("avg_bytes"))


def project_stats(store: DataFrame, project: str) -> DataFrame:
    """One row for a project: counts, first and last times, and chunks by type as a map; zeros if it has none."""
    own = store.where(F.col("project_path") == project)
    kinds = own.groupBy("content_type").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("content_type", "n")))).alias("by_type"))
    whole = own.agg(F.count("*").alias("chunks"), F.countDistinct(clean_path(F.col("file_path"))).alias("files"), F.min("created_at").alias("first_created"), F.max("updated_at").alias("last_updated"))
    return whole.join(F.broadcast(kinds))


def projects(store: DataFrame) -> DataFrame:
    return store.select("project_path").distinct().orderBy("project_path")


def type_distribution(store: DataFrame) -> DataFrame:
    return store.groupBy("content_type").agg(F.count("*").alias("chunks")).orderBy(F.desc("chunks"), "content_type")


def chunk_stats(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("project_path", "content_type", "language").agg(F.count("*").alias("chunks"), _mean("lines_count").alias("avg_lines"), _mean(F.length("content")).alias("avg_length"))


def project_summary(projects: DataFrame, chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Projects with chunks and embeddings, both joined left; ``chunk_rows`` counts a chunk once for each of its models."""
    joined = projects.join(chunks, "project_id", "left").join(embeddings, "chunk_id", "left")
    return joined.groupBy("project_id").agg(F.count("chunk_id").alias("chunk_rows"), F.countDistinct("chunk_id").alias("chunks"), F.countDistinct("model").alias("models"), F.count("embedding_id").alias("embeddings"))


def version_stats(history: DataFrame) -> DataFrame:
    kinds = {k: _count_if(F.col("change_type") == k).alias(k) for k in ("created", "updated", "deleted")}
    return history.groupBy("chunk_id").agg(F.count("*").alias("versions"), F.min("version").alias("first_version"), F.max("version").alias("last_version"), *kinds.values(), _mean(F.get_json_object("metadata", "$.change_percentage").cast("double")).alias("avg_change"))


def materialised(view: DataFrame, path: str, name: str = "view") -> DataFrame:
    """Write a view's rows as a new version of the table ``name`` below ``path``, and read them: refreshing is computing anew.

    A view may be computed from its own last version; readers of that go on until ``storage.Versioned.swept``.
    """
    tables = storage.Versioned(view.sparkSession, path)
    tables.commit(**{name: view})
    return view.sparkSession.read.schema(view.schema).parquet(tables.path(name))


#: Columns whose distinct values by project the view counts.
_DISTINCT = {"files": "file_path", "languages": "language", "extensions": "file_extension"}


def signed(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """The change log of rows that go from ``old`` to ``new``, images of the same rows: ``sign`` -1 for what was, 1 for what is; unchanged ones are left out."""
    names = [c for c in old.columns]
    both = old.withColumn("sign", F.lit(-1)).unionByName(new.select(*names).withColumn("sign", F.lit(1)))
    same = both.groupBy(key, F.xxhash64(*names).alias("_image")).agg(F.sum("sign").alias("sign"), F.any_value(F.struct(*names)).alias("_row"))
    return same.where("sign <> 0").select("_row.*", "sign")


class ProjectViewState:
    """``project_view`` kept up to date from change logs alone, as two tables below ``path``.

    ``sums`` has a project's counts and exact sums, ``members`` how many chunks have each value of the columns whose distinct values are counted. A
    refresh reads a change log and these tables, which become a new version together; the store is not read.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.tables = spark, storage.Versioned(spark, path)

    def build(self, store: DataFrame) -> None:
        rows = store.withColumn("sign", F.lit(1))
        self._commit(self._sums(rows), self._members(rows))

    def refresh(self, changes: DataFrame) -> None:
        """Take in ``changes``: rows of the store with ``sign`` -1 or 1, as ``signed`` gives them."""
        sums, members = (self.spark.read.parquet(self.tables.path(n)) for n in ("sums", "members"))
        self._commit(sums.unionByName(self._sums(changes)), members.unionByName(self._members(changes)))

    def view(self) -> DataFrame:
        """The rows that ``project_view`` would compute from the store."""
        sums, members = (self.spark.read.parquet(self.tables.path(n)) for n in ("sums", "members"))
        counted = members.groupBy("project_path").agg(*(_count_if(F.col("kind") == k).alias(k) for k in _DISTINCT))
        mean = lambda total, n: F.try_divide(F.col(total).cast("double"), F.col(n))
        counted = counted.withColumnRenamed("project_path", "_of")
        return sums.join(counted, F.col("project_path").eqNullSafe(F.col("_of")), "left").select(
            "project_path", "chunks", *(F.coalesce(k, F.lit(0)).alias(k) for k in _DISTINCT),
            F.when(F.col("sized") > 0, F.col("bytes")).alias("bytes"),
            mean("lines", "lined").alias("avg_lines"), mean("saved", "packed").alias("avg_compression"),
        )

    @staticmethod
    def _sums(rows: DataFrame) -> DataFrame:
        sign = F.col("sign").cast("long")
        saved = F.when(F.col("is_compressed"), compression_percent()).cast("decimal(22,12)")
        total = lambda x: F.coalesce(F.sum(sign * x), F.lit(0))
        held = lambda x: F.coalesce(F.sum(F.when(x.isNotNull(), sign)), F.lit(0))
        size, lines = F.col("file_size_bytes").cast("long"), F.col("lines_count").cast("long")
        return rows.groupBy("project_path").agg(
            F.sum(sign).alias("chunks"), total(size).alias("bytes"), held(size).alias("sized"), total(lines).alias("lines"), held(lines).alias("lined"),
            # A product of decimals would have fewer places.
            F.coalesce(F.sum(F.when(sign < 0, -saved).otherwise(saved)), F.lit(0)).cast("decimal(38,12)").alias("saved"), held(saved).alias("packed"),
        )

    @staticmethod
    def _members(rows: DataFrame) -> DataFrame:
        values = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in _DISTINCT.items()))).alias("m")
        found = rows.select("project_path", "sign", values).where("m.value is not null")
        return found.groupBy("project_path", "m.kind", "m.value").agg(F.sum("sign").cast("long").alias("n"))

    def _commit(self, sums: DataFrame, members: DataFrame) -> None:
        columns = [c for c in sums.columns if c != "project_path"]
        sums = sums.groupBy("project_path").agg(*(F.sum(c).cast(sums.schema[c].dataType).alias(c) for c in columns)).where("chunks > 0")
        members = members.groupBy("project_path", "kind", "value").agg(F.sum("n").cast("long").alias("n")).where("n > 0")
        self.tables.commit(sums=sums, members=members)


def versions_by_total(history: DataFrame, limit: int = 50) -> DataFrame:
    """Versions with the number of chunks that have them, the commonest first."""
    return history.groupBy("version").agg(F.count("*").alias("total")).orderBy(F.desc("total"), "version").limit(limit)


def pairwise(vectors: DataFrame, block: int = 1024) -> DataFrame:
    """``label, pairs, least, greatest, mean, deviation`` of the cosine distances of all pairs ``a.id < b.id`` of a label.

    ``vectors`` are ``label, id, vector``. A label's rows are dealt into blocks by a hash of their id; each two blocks are
    one matrix product in some worker, of which counts, sums and extremes leave it. A pair with a zero or null vector,
    or of two lengths, counts and has no distance; null labels and ids pair with nothing.
    """
    import numpy as np
    import pyarrow as pa

    rows = vectors.select("label", "id", F.col("vector").cast("array<double>").alias("vector")).where("label is not null and id is not null")
    blocks = rows.groupBy("label").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = rows.join(blocks, "label").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # Rows of one id share a block, so that any two rows of different blocks are one pair.
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("label", "id", "vector", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def partial(group: pa.Table) -> pa.Table:
        label, i, j = (group.column(c)[0] for c in ("label", "i", "j"))
        one = i == j
        own, given = group.column("own").to_numpy(), group.column("vector").to_pylist()
        ids = np.unique(group.column("id").to_numpy(), return_inverse=True)[1] if one else None
        # A size of 0 is of a vector without direction.
        sizes = np.array([len(v) if v and None not in v and any(v) else 0 for v in given])
        left, right = (np.arange(len(own)),) * 2 if one else (np.nonzero(own == i.as_py())[0], np.nonzero(own == j.as_py())[0])
        pairs, n, least, greatest, total, squares = 0, 0, np.inf, -np.inf, 0.0, 0.0
        if one:
            counts = np.bincount(ids)
            pairs = (len(ids) ** 2 - int((counts.astype(np.int64) ** 2).sum())) // 2
        else:
            pairs = len(left) * len(right)
        for size in set(sizes.tolist()) - {0}:
            a, b = left[sizes[left] == size], right[sizes[right] == size]
            if not len(a) or not len(b):
                continue
            u, v = (np.array([given[k] for k in x], np.float64) for x in (a, b))
            u, v = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (u, v))
            for k in range(0, len(a), 256):
                cos = u[k : k + 256] @ v.T
                cos = cos[ids[a[k : k + 256], None] < ids[b]] if one else cos.ravel()
                if cos.size:
                    n, total, squares = n + cos.size, total + float(cos.sum()), squares + float(cos @ cos)
                    least, greatest = min(least, 1 - float(cos.max())), max(greatest, 1 - float(cos.min()))
        out = {"label": pa.array([label.as_py()], label.type), "pairs": pa.array([pairs], pa.int64()), "n": pa.array([n], pa.int64())}
        return pa.table(out | {k: pa.array([x if n else None], pa.float64()) for k, x in (("least", least), ("greatest", greatest), ("total", total), ("squares", squares))})

    kind = vectors.schema["label"].dataType.simpleString()
    parts = dealt.groupBy("label", "i", "j").applyInArrow(partial, f"label {kind}, pairs long, n long, least double, greatest double, total double, squares double")
    sums = parts.groupBy("label").agg(*(F.sum(c).alias(c) for c in ("pairs", "n", "total", "squares")), F.min("least").alias("least"), F.max("greatest").alias("greatest")).where("pairs > 0")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("squares") - F.col("total") * F.col("total") / F.col("n")) / (F.col("n") - 1))
    return sums.select("label", "pairs", "least", "greatest", (1 - F.try_divide("total", "n")).alias("mean"), F.when(F.col("n") > 1, spread).alias("deviation"))
