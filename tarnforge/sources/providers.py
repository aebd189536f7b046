"""Models behind an interface: embeddings and text tasks, with offline stand-ins that are deterministic."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnforge.functions.vector import wave_embedding

#: Dimensions of known models; any other has the last (fixed values).
DIMENSIONS = {"code": 768, "text": 768, "config": 384}
FALLBACK_DIMENSION = 1024

PROMPTS = {
    "summary": "Summarise the following {{kind}} in one sentence:\n{{content}}",
    "keywords": "List the keywords of the following {{kind}}, as JSON {\"keywords\": [...]}:\n{{content}}",
    "entities": "List the named entities of the following {{kind}}, as JSON {\"entities\": [...]}:\n{{content}}",
    "complexity": "Rate the complexity of the following {{kind}}, as JSON {\"complexity\": 1-10}:\n{{content}}",
}


def rendered(template: str, values: dict[str, str]) -> str:
    """A template with its ``{{name}}`` marks replaced; unknown marks stay."""
    return re.sub(r"\{\{(\w+)\}\}", lambda m: str(values.get(m[1], m[0])), template)


def valid_output(text: str, required: list[str]) -> dict | None:
    """A model's JSON object if it has all required fields."""
    try:
        found = json.loads(text)
    except ValueError:
        return None
    return found if isinstance(found, dict) and all(k in found for k in required) else None


def embedded(chunks: DataFrame, dimension: int = 64, provider: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """``chunks (id, content)`` with ``vector``; each distinct content is embedded once and joined back by digest.

    Without a provider the vector is an expression. With one, its batches go through Arrow.
    """
    keyed = chunks.withColumn("_digest", F.sha2(F.coalesce("content", F.lit("")), 256))
    distinct = keyed.groupBy("_digest").agg(F.first("content").alias("_content"))
    if provider is None:
        vectors = distinct.select("_digest", wave_embedding(F.coalesce("_content", F.lit("")), dimension).cast("array<float>").alias("vector"))
    else:
        import pyarrow as pa

        def run(batches):
            for b in batches:
                found = provider([t or "" for t in b.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.float32()))], ["_digest", "vector"])

        vectors = distinct.mapInArrow(run, "_digest string, vector array<float>")
    return keyed.drop("vector").join(vectors, "_digest").drop("_digest")


def cache_key(content: Column, model: str, dimension: int) -> Column:
    """What a cache of embeddings knows a text by: model, dimension and the digest of its content."""
    return F.concat(F.lit(f"{model}:{dimension}:"), F.sha2(F.coalesce(content, F.lit("")), 256))


def cache_gain(chunks: DataFrame) -> DataFrame:
    """One row: chunks, distinct contents and sources of ``chunks (content, source)``: what a cache by content would save."""
    return chunks.agg(F.count("*").alias("chunks"), F.countDistinct(F.sha2("content", 256)).alias("contents"), F.countDistinct("source").alias("sources"))


def enriched(chunks: DataFrame, keywords: int = 5) -> DataFrame:
    """The offline enrichment of ``chunks (id, content)``: first words as summary, the most frequent long ones as keywords.

    Of equally frequent words the alphabetically first come first. Null content has neither.
    """
    words = F.array_sort(F.filter(F.split(F.lower("content"), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 4))
    summary = F.array_join(F.slice(F.split(F.trim("content"), r"\s+"), 1, 12), " ")

    def counted(w: Column) -> Column:
        """Each distinct word with how often it stands in sorted ``w``: the runs of equal ones, most frequent first."""
        starts = F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: (i == 1) | (F.get(w, i - 1) != F.get(w, F.greatest(i - 2, F.lit(0)))))

        def runs(at: Column) -> Column:
            end = lambda k: F.coalesce(F.get(at, k + 1), F.size(w) + 1)
            return F.array_sort(F.transform(at, lambda s, k: F.struct((s - end(k)).alias("n"), F.get(w, s - 1).alias("word"))))

        return F.when(F.size(w) > 0, F.element_at(F.transform(F.array(starts), runs), 1))

    best = F.slice(F.element_at(F.transform(F.array(words), counted), 1), 1, keywords)
    out = F.transform(F.coalesce(best, F.array().cast("array<struct<n:int,word:string>>")), lambda x: x["word"])
    return chunks.select("id", summary.alias("summary"), out.alias("keywords"), F.lit("offline").alias("model"))


def prompts(name: str | None = None, has: str | None = None) -> dict[str, str]:
    """Known prompts by name, or those whose text has a word."""
    return {k: v for k, v in PROMPTS.items() if name in (None, k) and (has is None or has.lower() in v.lower())}


def answered(rows: DataFrame, task: str, model: Callable[[list[str]], list[str]], required: list[str] = (), batch: int = 10) -> DataFrame:
    """``id, answer, valid`` of ``rows (id, kind, content)``: the task's prompt through ``model``, a bounded number at a time.

    A batch that fails is tried one by one; what fails then has a null answer.
    """
    import pyarrow as pa

    template = PROMPTS[task]

    def one(prompt: str) -> str | None:
        try:
            return model([prompt])[0]
        except Exception:  # a model's failure is a row's, not the job's
            return None

    def run(batches):
        for b in batches:
            asked = [rendered(template, {"kind": k or "text", "content": c or ""}) for k, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            out: list[str | None] = []
            for i in range(0, len(asked), batch):
                part = asked[i : i + batch]
                try:
                    out += model(part)
                except Exception:
                    out += [one(p) for p in part]
            valid = [x is not None and (not required or valid_output(x, list(required)) is not None) for x in out]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), pa.array(valid, pa.bool_())], ["id", "answer", "valid"])

    return rows.select(F.col("id").cast("string").alias("id"), "kind", "content").mapInArrow(run, "id string, answer string, valid boolean")
