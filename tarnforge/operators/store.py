"""The versioned chunk store: writes as whole new tables, history, differences and migration."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window

from tarnforge.functions import detect, text
from tarnforge.functions.diff import content_diff
from tarnforge.sources import storage

#: What an upsert replaces; id, paths, chunk places, version and the creation time stay.
REPLACED = ("content", "content_type", "role", "file_extension", "file_size_bytes", "lines_count", "language", "vector", "is_compressed", "original_size_bytes", "updated_at")


def last_of(rows: DataFrame, key: str = "id", order: str = "updated_at") -> DataFrame:
    """One row a key: the last by ``order``, if there is such a column; of equal ones that whose values, as text, are greatest."""
    every = F.struct(*(F.col(f"`{c}`") for c in rows.columns))
    by = F.struct(*([order] if order in rows.columns else []), F.to_json(every))
    return rows.groupBy(key).agg(F.max_by(every, by).alias("_last")).select("_last.*")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` with the rows of ``new`` by id: replaced where known, added where not.

    Of rows of ``new`` that share an id the last by ``updated_at`` counts. Rows of ``old`` that share an id are all replaced. Null ids
    match nothing: those rows of either stay, in ``new`` one of them.
    """
    names = old.columns
    new = last_of(new).withColumn("_new", F.lit(True))
    both = old.withColumn("_old", F.lit(True)).alias("o").join(new.alias("n"), F.col("o.id") == F.col("n.id"), "full")
    there, known = F.col("n._new").isNotNull(), F.col("o._old").isNotNull()

    def value(c: str) -> Column:
        if c in REPLACED:
            return F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
        return F.when(known, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))

    return both.select(*(value(c).alias(c) for c in names))


def without_file(store: DataFrame, project: str, path: str) -> DataFrame:
    """The store without a file's chunks, whichever they are; files whose names only start alike stay."""
    return store.where(~((F.col("project_path") == project) & (text.clean_path(F.col("file_path")) == path)))


def without_project(store: DataFrame, project: str) -> DataFrame:
    return store.where(F.col("project_path") != project)


def without_expired(cache: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Cache entries that are still alive, and the number of the others."""
    at = F.lit(now).cast("timestamp")
    return cache.where(F.col("expires_at") >= at), cache.where(F.col("expires_at") < at).agg(F.count("*").alias("removed"))


def newest(cache: DataFrame, per: str, order: list[str], n: int) -> DataFrame:
    """What a cache of ``n`` entries a ``per`` keeps: its last ones by ``order``, the rest being evicted."""
    rank = F.row_number().over(Window.partitionBy(per).orderBy(*(F.desc(c) for c in order)))
    return cache.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``id, change_type`` of every created, updated or deleted chunk; content or vector decide on an update."""
    o, n = old.select("id", F.col("content").alias("c0"), F.col("vector").alias("v0"), F.lit(True).alias("in0")), new.select("id", F.col("content").alias("c1"), F.col("vector").alias("v1"), F.lit(True).alias("in1"))
    both = o.join(n, "id", "full")
    kind = F.when(F.col("in0").isNull(), "created").when(F.col("in1").isNull(), "deleted").when(~F.col("c0").eqNullSafe(F.col("c1")) | ~F.col("v0").eqNullSafe(F.col("v1")), "updated")
    return both.select("id", kind.alias("change_type"), F.coalesce("c0", F.lit("")).alias("old_content"), F.coalesce("c1", F.lit("")).alias("new_content")).where("change_type is not null")


def history_rows(found: DataFrame, history: DataFrame, changed_at: Column) -> DataFrame:
    """Rows to append to ``history`` for ``changes``: the next version of each chunk, with its difference as JSON."""
    last = history.groupBy(F.col("chunk_id").alias("id")).agg(F.max("version").alias("last"))
    diff = content_diff(F.col("old_content"), F.col("new_content"))
    return found.join(last, "id", "left").select(F.col("id").alias("chunk_id"), (F.coalesce("last", F.lit(0)) + 1).alias("version"), F.when(F.col("change_type") == "deleted", F.col("old_content")).otherwise(F.col("new_content")).alias("content"), changed_at.alias("changed_at"), "change_type", F.to_json(diff).alias("metadata"))


def replayed_versions(events: DataFrame) -> DataFrame:
    """``events (chunk_id, changed_at, ...)`` with the version that each has when they are applied in order."""
    return events.withColumn("version", F.row_number().over(Window.partitionBy("chunk_id").orderBy("changed_at", "event_id")))


def chunk_history(history: DataFrame, chunk_id: str | None = None, limit: int = 10) -> DataFrame:
    """The newest ``limit`` versions of one chunk, or of each."""
    if chunk_id is not None:
        return history.where(F.col("chunk_id") == chunk_id).orderBy(F.desc("version")).limit(limit)
    rank = F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc("version")))
    return history.withColumn("rank", rank).where(F.col("rank") <= limit).drop("rank")


def compared_versions(history: DataFrame, v1: int, v2: int) -> DataFrame:
    """Four rows for each chunk that has both versions: field, either value, and whether they differ."""
    at = lambda v, s: history.where(F.col("version") == v).select("chunk_id", *(F.col(c).alias(f"{c}{s}") for c in ("content", "change_type", "changed_at")))
    both = at(v1, 1).join(at(v2, 2), "chunk_id")
    rows = [
        ("content", F.left("content1", F.lit(100)), F.left("content2", F.lit(100)), ~F.col("content1").eqNullSafe(F.col("content2"))),
        ("content_length", F.length("content1").cast("string"), F.length("content2").cast("string"), F.length("content1") != F.length("content2")),
        ("change_type", F.col("change_type1"), F.col("change_type2"), F.col("change_type1") != F.col("change_type2")),
        ("changed_at", F.date_format("changed_at1", "yyyy-MM-dd HH:mm:ss"), F.date_format("changed_at2", "yyyy-MM-dd HH:mm:ss"), F.col("changed_at1") != F.col("changed_at2")),
    ]
    return both.select("chunk_id", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), a.alias("value1"), b.alias("value2"), d.alias("different")) for f, a, b, d in rows))).alias("r")).select("chunk_id", "r.*")


def snapshot(files: DataFrame) -> DataFrame:
    """``path, content_hash`` of files, for incremental runs."""
    return files.select("path", F.sha2("content", 256).alias("content_hash"))


def incremental_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """``path, status``: added, modified, deleted or unchanged between two snapshots."""
    b = before.select("path", F.col("content_hash").alias("h0"))
    a = after.select("path", F.col("content_hash").alias("h1"))
    status = F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "deleted").when(F.col("h0") != F.col("h1"), "modified").otherwise("unchanged")
    return b.join(a, "path", "full").select("path", status.alias("status"))


def migrated(legacy: DataFrame) -> DataFrame:
    """Rows of the old schema in the new one: type, extension, sizes and places derived."""
    path = text.clean_path(F.col("file_path"))
    kind = F.coalesce(detect.type_by_extension(path), F.lit("other"))
    index = F.regexp_extract("file_path", r"#chunk([0-9]+)$", 1)
    return legacy.select("id", "project_path", "file_path", "content", kind.alias("content_type"), detect.indexed_role(kind).alias("role"), F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1).alias("file_extension"), F.octet_length("content").alias("file_size_bytes"), text.line_count(F.col("content")).alias("lines_count"), F.when(index == "", 0).otherwise(F.try_to_number(index, F.lit("999999999")).cast("int")).alias("chunk_index"), F.lit(False).alias("is_compressed"), F.lit(1).alias("version"))


def as_current(legacy: DataFrame, schema: str) -> DataFrame:
    """A store of the old schema as one of ``schema``: what it has, what ``migrated`` derives, nulls for the rest."""
    extra = [c for c in ("vector", "created_at", "updated_at") if c in legacy.columns]
    derived = migrated(legacy).join(legacy.select("id", *extra), "id") if extra else migrated(legacy)
    want = StructType.fromDDL(schema)
    return derived.select(*((F.col(f.name) if f.name in derived.columns else F.lit(1 if f.name == "total_chunks" else None)).cast(f.dataType).alias(f.name) for f in want))


def is_current(store: DataFrame) -> bool:
    """Whether a store has the columns that only the newer schema has: without them their filters cannot be asked for."""
    return {"content_type", "role", "file_extension", "chunk_index"} <= set(store.columns)


def errors(store: DataFrame) -> DataFrame:
    """``id, problems`` of the rows that break the schema's rules."""
    rules = {
        "content_type": ~F.coalesce(F.col("content_type"), F.lit("")).isin("code", "doc", "config", "other"),
        "role": F.col("role").isNotNull() & ~F.col("role").isin("core", "helper", "test", "example", "template", "other"),
        "chunk_index": F.col("chunk_index") < 0,
        "total_chunks": (F.col("total_chunks") < 1) | (F.col("chunk_index") >= F.col("total_chunks")),
        "file_size_bytes": F.col("file_size_bytes") < 0,
        "content": F.col("content").isNull() | (F.col("content") == ""),
    }
    found = F.filter(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules.items())), lambda x: x.isNotNull())
    return store.select("id", found.alias("problems")).where(F.size("problems") > 0)


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))


class StaleStore(RuntimeError):
    """Another writer has changed the store since this one read it; nothing of this one's work is seen."""


class BucketStore:
    """A store below ``path`` as partitions by a hash of the id, and manifests that say which folder holds each; the newest counts.

    An upsert rewrites only the buckets that it touches, into a folder of its own, and then puts the next manifest in place, by one
    rename that fails if there is one already: of two writers at once one raises ``StaleStore``. Until then, and after a failed run, readers see the
    manifest before; folders that it does not name are deleted by ``swept``. A reader scans the named folders' files at once, so its plan does not grow
    with upserts. The manifest has the number of buckets, so they cannot be counted otherwise later.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, store: DataFrame, buckets: int = 256) -> None:
        before = self._newest()
        folder = self._put(store, buckets)
        self._name({"buckets": buckets, "schema": store.schema.json(), "folders": {str(b): folder for b in self._there(folder)}}, before)

    def upsert(self, new: DataFrame) -> int:
        """Returns how many buckets were rewritten. Bucket numbers are all that comes to the driver."""
        before = self._newest()
        now = self._manifest(before)
        rows = _bucketed(new, now["buckets"])
        touched = sorted(r.bucket for r in rows.select("bucket").distinct().collect())
        if touched:
            old = self._read(now, touched)
            self._replace(now, before, touched, self._put(upsert(old, rows.select(*old.columns)), now["buckets"]))
        return len(touched)

    def compacted(self, least: int = 128 << 20) -> int:
        """Write the buckets of all folders of fewer than ``least`` bytes into one folder; returns how many folders they were in."""
        before = self._newest()
        now = self._manifest(before)
        small = {f for f in set(now["folders"].values()) if storage.size(self.spark, f"{self.path}/{f}") < least}
        if len(small) < 2:
            return 0
        moved = sorted(int(b) for b, f in now["folders"].items() if f in small)
        self._replace(now, before, moved, self._put(self._read(now, moved), now["buckets"]))
        return len(small)

    def read(self) -> DataFrame:
        return self._read(self._manifest(self._newest()), None)

    def swept(self) -> int:
        """Delete the folders that the newest manifest does not name, and older manifests; for when no reader of one is left."""
        newest = self._newest()
        held = set(self._manifest(newest)["folders"].values())
        there = storage.names(self.spark, self.path)
        gone = [n for n in there if n.startswith("part=") and n not in held]
        for n in [*gone, *(n for n in there if n.startswith("manifest-") and n < _manifest_name(newest))]:
            storage.delete(self.spark, f"{self.path}/{n}")
        return len(gone)

    def _put(self, store: DataFrame, buckets: int) -> str:
        folder = f"part={uuid.uuid4().hex}"
        _bucketed(store, buckets).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        return folder

    def _there(self, folder: str) -> list[int]:
        """Buckets that have rows in a folder."""
        return [int(n.partition("=")[2]) for n in storage.names(self.spark, f"{self.path}/{folder}") if n.startswith("bucket=")]

    def _replace(self, now: dict, before: int, buckets: list[int], folder: str) -> None:
        kept = {b: f for b, f in now["folders"].items() if int(b) not in buckets}
        self._name(now | {"folders": kept | {str(b): folder for b in self._there(folder)}}, before)

    def _read(self, manifest: dict, buckets: list[int] | None) -> DataFrame:
        schema = StructType.fromJson(json.loads(manifest["schema"]))
        wanted = None if buckets is None else set(buckets)
        paths = [f"{self.path}/{f}/bucket={b}" for b, f in sorted(manifest["folders"].items()) if wanted is None or int(b) in wanted]
        if not paths:
            return self.spark.createDataFrame([], schema)
        whole = StructType([*schema.fields, StructField("part", StringType()), StructField("bucket", IntegerType())])
        return self.spark.read.schema(whole).option("basePath", self.path).parquet(*paths).drop("part", "bucket")

    def _newest(self) -> int:
        """The number of the newest manifest; 0 if there is none."""
        return max((int(n[9:-5]) for n in storage.names(self.spark, self.path) if n.startswith("manifest-") and n.endswith(".json")), default=0)

    def _manifest(self, number: int) -> dict:
        return json.loads(storage.read(self.spark, f"{self.path}/{_manifest_name(number)}"))

    def _name(self, manifest: dict, before: int) -> None:
        if not storage.put_new(self.spark, f"{self.path}/{_manifest_name(before + 1)}", json.dumps(manifest)):
            raise StaleStore(f"{self.path} has been written since it was read")


def _manifest_name(number: int) -> str:
    return f"manifest-{number:012d}.json"
