"""The queries of this subpackage, ``opN_<name>`` and ``pipeline``, with SQL where it can express them."""

from __future__ import annotations

import string

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from tarnforge.llm import chat, decontaminate, html, importance, manifest, mixing, neardup, pii, quality, repeats, tokens, toxicity, trie, twins
from tarnforge.llm.common import table

QUERIES, SQL = {}, {}

#: The vocabulary that op3 counts with.
VOCABULARY = "piece_bpe_32k.model"


def _query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@_query("op1_minhash_neardup", twins.NEAR_DUPLICATES)
def op1(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@_query("op2_weak_supervision_pii")
def op2(spark, sf_dir):
    return pii.personal_data(table(spark, sf_dir, "documents"))


@_query("op3_digest_cache_tokens")
def op3(spark, sf_dir):
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


@_query("op4_temperature_mixing")
def op4(spark, sf_dir):
    found = mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return found.select("doc_id", "source", "n_tokens", "weight", "copies", "draws", "kept")


@_query("op5_importance_resampling")
def op5(spark, sf_dir):
    return importance.importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query("op6_relational_chat", chat.SQL)
def op6(spark, sf_dir):
    return chat.read_back(chat.formatted(chat.with_injection(table(spark, sf_dir, "conversations"))))


@_query("op7_two_pass_html")
def op7(spark, sf_dir):
    return html.main_text(table(spark, sf_dir, "pages"))


@_query("op8_ratio_quality")
def op8(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query("op9_automaton_decontamination", twins.CONTAMINATION)
def op9(spark, sf_dir):
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("spans")


@_query("op10_segment_toxicity")
def op10(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("passages")


@_query("op11_leaf_peeling_trie", twins.TRIE)
def op11(spark, sf_dir):
    return trie.trie(trie.rebuilt(trie.turn_lists(table(spark, sf_dir, "conversations")))).drop("key", "parent")


@_query("op12_suffix_family", twins.REPEATS)
def op12(spark, sf_dir):
    found = repeats.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    size, left = F.octet_length(F.coalesce("text", F.lit(""))).cast("long"), F.octet_length("kept_bytes").cast("long")
    spans = F.size("starts").cast("long").alias("n_spans")
    return found.select("doc_id", size.alias("n_bytes"), (size - left).alias("n_removed"), spans, F.sha2("kept_bytes", 256).alias("kept_sha256"))


@_query("op13_superblock_merkle", twins.MANIFEST)
def op13(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    fields = {c: F.col(c) for c in manifest.FIELDS}
    altered = fields | {"text": F.translate("text", string.ascii_uppercase, string.ascii_lowercase)}
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, manifest.leaf(altered))
    found = manifest.manifest(docs.select("doc_id", "source", manifest.leaf(fields).alias("leaf"), tampered.alias("tampered")))
    folded = manifest.folded(F.coalesce("tampered", "leaf"), F.col("left"), F.col("right"))
    out = found.select("doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("left"), F.col("right")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
