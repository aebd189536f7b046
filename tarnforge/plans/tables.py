"""The retrieval tables as views of the driver's tables, in Spark and in SQL.

A document is one of three chunks of a file of its source; its type, role and times follow from its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnforge.functions.text import line_count

NOW = "2024-03-01 00:00:00"
_KINDS, _ROLES = ("code", "doc", "config", "other"), ("core", "helper", "test", "example", "template", "other")
_EXT, _LANG = ("ts", "md", "json", "log"), ("typescript", None, "json", None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, least: int = 1 << 20) -> DataFrame:
    """``df`` over more tasks, if its scan has fewer than there are cores, each with ``least`` bytes of input at least.

    For work on whole texts, where one small file would keep all cores but one idle.
    """
    plan = df._jdf.queryExecution()
    size = int(str(plan.optimizedPlan().stats().sizeInBytes()))
    tasks = min(df.sparkSession.sparkContext.defaultParallelism, size // least)
    return df.repartition(tasks) if plan.toRdd().getNumPartitions() < tasks else df


def _pick(values: tuple, by: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (by + 1).cast("int"))


def at(minutes: Column) -> Column:
    return F.timestamp_seconds(F.lit(1704067200) + minutes * 60)


def store(spark: SparkSession, sf_dir: str, vectors: bool = True) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    file = F.floor(F.col("doc_id") / 3)
    kind = F.pmod(file, F.lit(4))
    path = F.concat(F.lit("src/f"), file.cast("string"), F.lit("."), _pick(_EXT, kind))
    size = F.octet_length("text")
    long = size > 10240
    index = (F.col("doc_id") % 3).cast("int")
    out = d.select(
        "doc_id",
        F.concat("source", F.lit(":"), path, F.lit("#chunk"), index.cast("string")).alias("id"),
        F.col("source").alias("project_path"),
        F.concat(path, F.lit("#chunk"), index.cast("string")).alias("file_path"),
        index.alias("chunk_index"),
        F.lit(3).alias("total_chunks"),
        F.col("text").alias("content"),
        _pick(_KINDS, kind).alias("content_type"),
        _pick(_ROLES, F.col("doc_id") % 6).alias("role"),
        _pick(_EXT, kind).alias("file_extension"),
        size.alias("file_size_bytes"),
        line_count(F.col("text")).alias("lines_count"),
        _pick(_LANG, kind).alias("language"),
        long.alias("is_compressed"),
        F.when(long, size * 2).alias("original_size_bytes"),
        F.lit(1).alias("version"),
        at(F.col("doc_id")).alias("created_at"),
        at(F.col("doc_id") * 2).alias("updated_at"),
    )
    if vectors:
        e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
        out = out.join(e, "doc_id", "left")
    return out


#: The same table for the SQL twins.
STORE = """
store as (
  select d.doc_id, d.source || ':' || d.path || '#chunk' || (d.doc_id % 3) as id, d.source as project_path,
    d.path || '#chunk' || (d.doc_id % 3) as file_path, cast(d.doc_id % 3 as integer) as chunk_index, 3 as total_chunks,
    d.text as content, ['code', 'doc', 'config', 'other'][d.kind + 1] as content_type,
    ['core', 'helper', 'test', 'example', 'template', 'other'][d.doc_id % 6 + 1] as role, d.ext as file_extension,
    strlen(d.text) as file_size_bytes, length(d.text) - length(replace(d.text, chr(10), '')) + 1 as lines_count,
    ['typescript', null, 'json', null][d.kind + 1] as language, strlen(d.text) > 10240 as is_compressed,
    case when strlen(d.text) > 10240 then strlen(d.text) * 2 end as original_size_bytes, 1 as version,
    timestamp '2024-01-01' + to_minutes(d.doc_id) as created_at, timestamp '2024-01-01' + to_minutes(d.doc_id * 2) as updated_at,
    e.embedding as vector
  from (select *, 'src/f' || (doc_id // 3) || '.' || ['ts', 'md', 'json', 'log'][(doc_id // 3) % 4 + 1] as path,
          ['ts', 'md', 'json', 'log'][(doc_id // 3) % 4 + 1] as ext, (doc_id // 3) % 4 as kind from documents) d
  left join embeddings e on e.vec_id = d.doc_id
)"""


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """One stored vector, as a query."""
    return list(table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first().embedding)


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of chunks from the event log: one event is one change of its user's chunk."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 7 == 0, "deleted").when(F.col("event_id") % 3 == 0, "created").otherwise("updated")
    return e.select("event_id", F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("chunk_id"), F.col("ts").alias("changed_at"), kind.alias("change_type"), F.concat(F.col("event_type"), F.lit(" "), F.col("props")).alias("content"), F.to_json(F.struct((F.round(F.col("value"), 2)).alias("change_percentage"))).alias("metadata"))


HISTORY = """
hist as (
  select event_id, 'c' || user_id as chunk_id, ts as changed_at,
    case when event_id % 7 = 0 then 'deleted' when event_id % 3 = 0 then 'created' else 'updated' end as change_type,
    event_type || ' ' || props as content, round(value, 2) as change_percentage
  from events
), versions as (select *, row_number() over (partition by chunk_id order by changed_at, event_id) as version from hist)"""


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("interaction_id"), (F.col("user_id") % 50).alias("project_id"), "user_id", F.col("event_type").alias("interaction_type"), F.col("ts").alias("created_at"), F.col("value").alias("duration_ms"), (F.col("event_type") != "error").alias("success"))


INTERACTIONS = "inter as (select event_id as interaction_id, user_id % 50 as project_id, user_id, event_type as interaction_type, ts as created_at, value as duration_ms, event_type <> 'error' as success from events)"


def projects(spark: SparkSession) -> DataFrame:
    return spark.range(60).select(F.col("id").alias("project_id"))


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Regions, nations and suppliers as entities, where each lies as relations."""
    r, n, s = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    e = r.select(F.col("r_name").alias("name"), F.lit("region").alias("entityType"), F.array(F.concat(F.lit("key "), F.col("r_regionkey").cast("string"))).alias("observations"))
    e = e.unionByName(n.select(F.col("n_name").alias("name"), F.lit("nation").alias("entityType"), F.array(F.concat(F.lit("in region "), F.col("n_regionkey").cast("string")), F.concat(F.lit("key "), F.col("n_nationkey").cast("string"))).alias("observations")))
    e = e.unionByName(s.select(F.col("s_name").alias("name"), F.lit("supplier").alias("entityType"), F.array(F.concat(F.lit("nation "), F.col("s_nationkey").cast("string"))).alias("observations")))
    rel = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("from"), F.col("r_name").alias("to"), F.lit("in").alias("relationType"))
    rel = rel.unionByName(s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_name").alias("from"), F.col("n_name").alias("to"), F.lit("based in").alias("relationType")))
    return e, rel


GRAPH = """
ent as (
  select r_name as name, 'region' as etype, ['key ' || r_regionkey] as obs from region
  union all select n_name, 'nation', ['in region ' || n_regionkey, 'key ' || n_nationkey] from nation
  union all select s_name, 'supplier', ['nation ' || s_nationkey] from supplier
), rel as (
  select n_name as f, r_name as t, 'in' as k from nation join region on n_regionkey = r_regionkey
  union all select s_name, n_name, 'based in' from supplier join nation on s_nationkey = n_nationkey
)"""
