"""The corpus pipeline: documents from raw to mixed, a table written after each stage.

Each stage takes ``(spark, docs, sf_dir)`` and returns what it keeps of ``docs``. Toxic documents go, one
document of each group of near-duplicates stays, passages of the benchmark are cut out, personal data is
replaced by its kind, and the sources are drawn to their target weights.

In every stage: an empty table gives an empty one; columns other than those that are read come back as they are, whatever their
names; texts are read whole; rows that are repeated are treated alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnforge.llm import common, decontaminate, mixing, neardup, pii, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5. Null and empty texts stay; a null doc_id has no label, and its text decides."""
    return toxicity.without_toxic(docs, common.table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group.

    Rows with a null doc_id, a null text or one without words are in no group and stay; rows of one doc_id stay or go together.
    """
    return neardup.deduplicated(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the benchmark's passages; those that are mostly such passages go. Null texts and ids stay as they are."""
    return decontaminate.decontaminated(docs, common.table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind. Null texts and ids stay as they are."""
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mixture draws, with their tokens, their source's weight, how often they are drawn, and each draw's place.

    A null text has no tokens and goes with its block, a null source is one source, rows with a null doc_id share a block.
    Columns named like the added ones are replaced.
    """
    return mixing.mixed(docs).where("kept").drop("kept")


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("personal data", mask_personal_data),
    ("mixing", mix_sources),
]

#: SQL can't express the learnt stages; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; a stage's table, and what it made, goes when the next one is written."""
    docs, path = common.table(spark, sf_dir, "documents"), ""
    for _, stage in STAGES[:-1]:
        with common.scratch() as made:
            before = path
            docs, path = common.cut(stage(spark, docs, sf_dir), "stage")
            common.release(spark, made, path)
        if before:
            common.drop(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
