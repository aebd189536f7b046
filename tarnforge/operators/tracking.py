"""Projects, messages and interactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recent_projects(projects: DataFrame, interactions: DataFrame, user: int | None = None, limit: int = 10) -> DataFrame:
    """Projects by their last interaction; the latest one's type beside it. With a user, only projects of theirs."""
    if user is not None:
        interactions = interactions.where(F.col("user_id") == user)
    joined = projects.join(interactions, "project_id", "left" if user is None else "inner")
    by = F.struct("created_at", "interaction_id")
    out = joined.groupBy("project_id").agg(F.count("interaction_id").alias("interactions"), F.max("created_at").alias("last_at"), F.max_by("interaction_type", by).alias("last_type"))
    return out.orderBy(F.desc_nulls_last("last_at"), "project_id").limit(limit)


def interaction_stats(projects: DataFrame, interactions: DataFrame) -> DataFrame:
    joined = projects.join(interactions, "project_id", "left")
    won = F.sum(F.when(F.col("success"), 1).otherwise(0)).cast("long")
    lost = F.sum(F.when(~F.col("success"), 1).otherwise(0)).cast("long")
    return joined.groupBy("project_id").agg(F.count("interaction_id").alias("interactions"), won.alias("succeeded"), lost.alias("failed"), F.countDistinct("interaction_type").alias("types"), F.avg("duration_ms").alias("avg_ms"))


def message_stats(projects: DataFrame, messages: DataFrame) -> DataFrame:
    joined = projects.join(messages, "project_id", "left")
    return joined.groupBy("project_id").agg(F.count("message_id").alias("messages"), F.sum(F.when(F.col("related"), 1).otherwise(0)).cast("long").alias("related"), F.avg("relevance").alias("avg_relevance"), F.min("relevance").alias("min_relevance"), F.max("relevance").alias("max_relevance"), F.countDistinct("user").alias("users"), F.countDistinct("conversation_id").alias("conversations"))


def relevance(message: Column, project_name: Column) -> Column:
    """0.9 if a message names the project, 0.7 if it speaks of projects, code or files, else 0.5."""
    named = F.contains(F.lower(message), F.lower(project_name))
    about = F.lower(message).rlike("project|code|file")
    return F.when(named, 0.9).when(about, 0.7).otherwise(0.5)


def linked(messages: DataFrame, name: Column) -> DataFrame:
    score = relevance(F.col("text"), name)
    reason = F.when(score >= 0.8, "named").when(score >= 0.6, "related").otherwise("context")
    return messages.select("*", score.alias("relevance"), reason.alias("reason"), (score >= 0.3).alias("related"))


def initialised(tracking: DataFrame, store: DataFrame) -> DataFrame:
    """Tracking rows ``(project_id, files, bytes)`` brought up to a store's: known ones replaced, missing ones added."""
    now = store.groupBy(F.col("project_path").alias("project_id")).agg(F.countDistinct("file_path").alias("new_files"), F.sum("file_size_bytes").cast("long").alias("new_bytes"))
    both = tracking.join(now, "project_id", "full")
    return both.select("project_id", F.coalesce("new_files", "files").alias("files"), F.coalesce("new_bytes", "bytes").alias("bytes"))


def recorded(projects: DataFrame, history: DataFrame, interactions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Projects and history after ``interactions``: missing projects are made, touched ones get the last time."""
    touched = interactions.groupBy("project_id").agg(F.max("created_at").alias("touched"))
    known = projects.join(touched, "project_id", "full").select("project_id", F.greatest("last_accessed", "touched").alias("last_accessed"))
    return known, history.unionByName(interactions)
