"""Files of a project as rows, ignore rules, and the project's own tables."""

from __future__ import annotations

import re
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DEFAULT_GLOB = "*.{js,ts,py,md,txt,json,yaml,yml,html,css,scss}"
#: A project's own rules (fixed value).
RULE_FILE = ".ragignore"
#: Paths that are never indexed (fixed values).
BUILT_IN = ("node_modules/", ".git/", "dist/", "build/", "coverage/", "__pycache__/", ".venv/", "*.log", "*.lock", "*.csv", "*.parquet", "*.pyc", "*.min.js", "*.map", ".DS_Store")


def rule_pattern(rule: str) -> str | None:
    """A gitignore rule as a regular expression over slash-separated relative paths; None for blanks and remarks."""
    rule = rule.strip()
    if not rule or rule.startswith("#"):
        return None
    rule = rule.removeprefix("!").removeprefix("\\")
    folder = rule.endswith("/")
    rule = rule.rstrip("/")
    rooted = "/" in rule
    out, i = "", 0
    rule = rule.removeprefix("/")
    while i < len(rule):
        if rule.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif rule.startswith("**", i):
            out, i = out + ".*", i + 2
        elif rule[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif rule[i] == "?":
            out, i = out + "[^/]", i + 1
        elif rule[i] == "[" and "]" in rule[i + 2 :]:
            end = rule.index("]", i + 2)
            body = rule[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] == "!" else body) + "]", end + 1
        else:
            out, i = out + re.escape(rule[i]), i + 1
    return ("^" if rooted else "(?:^|/)") + out + ("/" if folder else "(?:/|$)")


def ignored(path: Column, *rule_sets: list[str]) -> Column:
    """Whether the last rule that matches a relative path ignores it; the rule file itself never is.

    Rules are compiled on the driver into one expression, negations included, so no UDF is needed.
    """
    out = F.lit(False)
    for rules in (list(BUILT_IN), *rule_sets):
        for r in rules:
            if (p := rule_pattern(r)) is not None:
                out = F.when(path.rlike(p), F.lit(not r.strip().startswith("!"))).otherwise(out)
    return out & ~path.rlike(rf"(?:^|/){re.escape(RULE_FILE)}$")


def project_rules(spark: SparkSession, root: str) -> list[str]:
    """The rules of a project's own rule file, in its order; none if it has none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{RULE_FILE}")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return []
    # Spark leaves out files whose names start with a dot, so the file's own reader is used.
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return [x for x in text.splitlines() if x.strip() and not x.startswith("#")]


def scan(spark: SparkSession, root: str, glob: str = DEFAULT_GLOB, rules: list[str] = (), least: int = 10, most_bytes: int = 10 << 20, recursive: bool = True) -> DataFrame:
    """``path, relative_path, content, size, modified`` of the files below ``root``, hidden ones left out.

    Ignored and over-long files are dropped on their metadata alone, before any content is decoded.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", glob).load(root)
    base = re.escape(str(PurePosixPath(root)).removeprefix("file:"))
    relative = F.regexp_replace("path", rf"^[a-z]*:?/*{base.lstrip('/')}/?", "")
    files = files.select("path", relative.alias("relative_path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    files = files.where((F.col("size") <= most_bytes) & ~F.col("relative_path").rlike(r"(?:^|/)\.") & ~ignored(F.col("relative_path"), list(rules)))
    text = files.withColumn("content", F.try_validate_utf8(F.decode("content", "UTF-8")))
    return text.where(F.length(F.trim("content")) >= least)


def extensions(files: DataFrame, top: int = 10) -> DataFrame:
    """The commonest extensions."""
    ext = F.regexp_extract(F.lower("path"), r"\.([a-z0-9]+)$", 1)
    return files.where(ext != "").groupBy(ext.alias("extension")).agg(F.count("*").alias("files")).orderBy(F.desc("files"), "extension").limit(top)


def indexed_share(scanned: DataFrame, indexed: DataFrame) -> DataFrame:
    """By project: files there, files indexed, and the share in per cent."""
    s = scanned.groupBy("project_path").agg(F.countDistinct("path").alias("scanned"))
    i = indexed.groupBy("project_path").agg(F.countDistinct("path").alias("indexed"))
    share = F.coalesce(F.try_divide(100.0 * F.coalesce("indexed", F.lit(0)), F.col("scanned")), F.lit(0.0))
    return s.join(i, "project_path", "full").select("project_path", F.coalesce("scanned", F.lit(0)).alias("scanned"), F.coalesce("indexed", F.lit(0)).alias("indexed"), share.alias("percent"))


def missing(scanned: DataFrame, indexed: DataFrame, top: int = 10) -> DataFrame:
    """The projects with the most files that are not indexed: how many, and the share in per cent that is."""
    found = indexed_share(scanned, indexed).withColumn("missing", F.col("scanned") - F.col("indexed"))
    return found.where("missing > 0").select("project_path", "missing", "percent").orderBy(F.desc("missing"), "project_path").limit(top)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of a JSON-lines file; empty tables if it is not there."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    schema = "type string, name string, entityType string, observations array<string>, `from` string, `to` string, relationType string"
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    rows = spark.read.schema(schema).json(path) if there else spark.createDataFrame([], schema)
    return rows.where("type = 'entity'").select("name", "entityType", "observations"), rows.where("type = 'relation'").select("from", "to", "relationType")


def write_graph(entities: DataFrame, relations: DataFrame, path: str) -> None:
    """Both tables as JSON lines in a new folder ``path``; the caller swaps it in, so readers of the old one are safe."""
    e = entities.select(F.to_json(F.struct(F.lit("entity").alias("type"), "name", "entityType", "observations")).alias("value"))
    r = relations.select(F.to_json(F.struct(F.lit("relation").alias("type"), "from", "to", "relationType")).alias("value"))
    e.unionByName(r).write.text(path)


#: The tables that a project keeps (fixed values).
TABLES = {
    "files_indexed": "path string, content_hash string, indexed_at timestamp, chunks int",
    "chunks": "id string, path string, chunk_index int, content string",
    "llm_cache": "key string, value string, created_at timestamp, expires_at timestamp",
    "events": "event_id long, type string, path string, at timestamp",
    "project_state": "key string, value string",
}


def init_tables(spark: SparkSession, root: str, force: bool = False) -> list[str]:
    """Make a project's empty tables below ``root``; existing ones stay unless ``force``. Returns what was made."""
    made = []
    for name, schema in TABLES.items():
        path = f"{root}/{name}"
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if force or not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
            made.append(name)
    return made


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row by ``order`` of each ``key``."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
