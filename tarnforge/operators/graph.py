"""A small knowledge graph: entities with observations, and typed relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["from", "to", "relationType"]


def _names(*names: str):
    return F.array(*(F.lit(n) for n in names))


def _contents_of(rows: DataFrame) -> DataFrame:
    """``name, contents``: one row a name, the contents of its rows one after the other, in order of their values."""
    return rows.groupBy("name").agg(F.flatten(F.array_sort(F.collect_list(F.coalesce("contents", F.array().cast("array<string>"))))).alias("contents"))


def create_entities(entities: DataFrame, new: DataFrame) -> DataFrame:
    """Entities with those of ``new`` whose name is not there yet; of several of one name, one."""
    return entities.unionByName(new.dropDuplicates(["name"]).join(entities.select("name"), "name", "left_anti").select(*entities.columns))


def create_relations(relations: DataFrame, new: DataFrame) -> DataFrame:
    """Relations with those of ``new`` that are not there yet, each once."""
    return relations.unionByName(new.dropDuplicates(KEYS).join(relations.select(*KEYS), KEYS, "left_anti").select(*relations.columns))


def add_observations(entities: DataFrame, new: DataFrame) -> DataFrame:
    """Entities with observations ``(name, contents)`` appended unless there; fails if a name is missing."""
    missing = new.join(entities, "name", "left_anti").select("name").limit(5).collect()
    if missing:
        raise KeyError(f"no such entity: {', '.join(sorted(r.name for r in missing))}")
    new = _contents_of(new)
    added = F.filter(F.coalesce("contents", F.array().cast("array<string>")), lambda x: ~F.array_contains("observations", x))
    return entities.join(new, "name", "left").select("name", "entityType", F.concat("observations", F.array_distinct(added)).alias("observations"))


def delete_entities(entities: DataFrame, relations: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the entities of ``names (name)`` and without their relations."""
    gone = names.select("name").distinct()
    left = relations.join(gone.withColumnRenamed("name", "from"), "from", "left_anti").join(gone.withColumnRenamed("name", "to"), "to", "left_anti")
    return entities.join(gone, "name", "left_anti"), left.select(*relations.columns)


def delete_observations(entities: DataFrame, gone: DataFrame) -> DataFrame:
    """Entities without observations ``(name, contents)``; repeats of the others stay."""
    gone = _contents_of(gone)
    unwanted = F.coalesce("contents", F.array().cast("array<string>"))
    return entities.join(gone, "name", "left").withColumn("_gone", unwanted).select("name", "entityType", F.filter("observations", lambda x: ~F.array_contains("_gone", x)).alias("observations"))


def delete_relations(relations: DataFrame, gone: DataFrame) -> DataFrame:
    return relations.join(gone, KEYS, "left_anti").select(*relations.columns)


def _within(relations: DataFrame, entities: DataFrame) -> DataFrame:
    names = entities.select("name")
    ends = relations.join(names.withColumnRenamed("name", "from"), "from", "left_semi").join(names.withColumnRenamed("name", "to"), "to", "left_semi")
    return ends.select(*relations.columns)


def search(entities: DataFrame, relations: DataFrame, query: str) -> tuple[DataFrame, DataFrame]:
    """Entities with ``query`` in name, type or an observation, whatever the case, and the relations among them."""
    q = query.lower()
    has = lambda c: F.contains(F.lower(c), F.lit(q))
    found = entities.where(has(F.col("name")) | has(F.col("entityType")) | F.exists("observations", has))
    return found, _within(relations, found)


def open_nodes(entities: DataFrame, relations: DataFrame, names: list[str] | DataFrame) -> tuple[DataFrame, DataFrame]:
    """The entities of ``names``, a list or a table ``(name)`` of any length, and the relations among them."""
    if isinstance(names, DataFrame):
        found = entities.join(names.select("name").distinct(), "name", "left_semi").select(*entities.columns)
    else:
        found = entities.where(F.array_contains(_names(*names), F.col("name")) if names else F.lit(False))
    return found, _within(relations, found)
