"""The main expressions as temporary SQL functions, for queries written as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Name, parameters, result and body; bodies are expressions, so Catalyst sees through them.
FUNCTIONS = {
    "tf_dot": ("a array<double>, b array<double>", "double", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "tf_norm": ("a array<double>", "double", "sqrt(aggregate(a, 0D, (s, x) -> s + x * x))"),
    "tf_cosine": ("a array<double>, b array<double>", "double", "try_divide(tf_dot(a, b), tf_norm(a) * tf_norm(b))"),
    "tf_clean_path": ("path string", "string", "regexp_replace(path, '#chunk[0-9]+$', '')"),
    "tf_lines": ("content string", "int", "length(content) - length(replace(content, '\\n', '')) + 1"),
    "tf_change_percent": ("old string, new string", "double", "coalesce(try_divide(100D * (length(new) - length(old)), length(old)), 100D)"),
    "tf_significant": ("old string, new string, bar double", "boolean", "abs(tf_change_percent(old, new)) >= bar"),
    "tf_content_diff": (
        "old string, new string",
        "struct<old_length:int,new_length:int,length_change:int,old_lines:int,new_lines:int,line_change:int,change_percentage:double,significant_change:boolean>",
        "named_struct('old_length', length(old), 'new_length', length(new), 'length_change', length(new) - length(old), 'old_lines', tf_lines(old), "
        "'new_lines', tf_lines(new), 'line_change', tf_lines(new) - tf_lines(old), 'change_percentage', tf_change_percent(old, new), "
        "'significant_change', abs(tf_change_percent(old, new)) > 10)",
    ),
    "tf_message_relevance": (
        "message string, project string",
        "double",
        "case when contains(lower(message), lower(project)) then 0.9D when regexp_like(lower(message), 'project|code|file') then 0.7D else 0.5D end",
    ),
    "tf_extension": ("path string", "string", "regexp_extract(tf_clean_path(path), '[.]([A-Za-z0-9]+)$', 1)"),
    "tf_tokens": ("content string", "bigint", "cast(ceil(length(content) / 4) as bigint)"),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session; returns their names."""
    for name, (params, result, body) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({params}) returns {result} return {body}")
    return list(FUNCTIONS)


def register_history(spark: SparkSession, history: DataFrame, view: str = "tf_history") -> list[str]:
    """Table functions over ``history``: ``tf_chunk_history(chunk, most)`` and ``tf_compare_versions(chunk, v1, v2)``."""
    register(spark)
    history.createOrReplaceTempView(view)
    rows = "version int, content string, change_type string, changed_at timestamp"
    spark.sql(
        f"create or replace temporary function tf_chunk_history(chunk string, most int) returns table ({rows}) return "
        f"select version, content, change_type, changed_at from (select *, row_number() over (order by version desc) as place from {view} where chunk_id = chunk) "
        "where place <= most"
    )
    spark.sql(
        "create or replace temporary function tf_compare_versions(chunk string, v1 int, v2 int) returns table (field string, value1 string, value2 string, "
        "different boolean) return select r.* from (select a.content as c1, b.content as c2, a.change_type as k1, b.change_type as k2 from "
        f"{view} a, {view} b where a.chunk_id = chunk and b.chunk_id = chunk and a.version = v1 and b.version = v2) lateral view explode(array("
        "named_struct('field', 'content', 'value1', left(c1, 100), 'value2', left(c2, 100), 'different', not (c1 <=> c2)), "
        "named_struct('field', 'content_length', 'value1', cast(length(c1) as string), 'value2', cast(length(c2) as string), 'different', length(c1) <> length(c2)), "
        "named_struct('field', 'change_type', 'value1', k1, 'value2', k2, 'different', k1 <> k2))) t as r"
    )
    return ["tf_chunk_history", "tf_compare_versions"]


def register_search(spark: SparkSession, store: DataFrame, view: str = "tf_store") -> str:
    """A table function ``tf_search(query, least)`` over ``store``: ``id, similarity`` of every chunk that is similar enough."""
    register(spark)
    store.createOrReplaceTempView(view)
    spark.sql(f"create or replace temporary function tf_search(query array<double>, least double) returns table (id string, similarity double) return select id, tf_cosine(cast(vector as array<double>), query) as similarity from {view} where vector is not null and tf_cosine(cast(vector as array<double>), query) >= least")
    return "tf_search"
