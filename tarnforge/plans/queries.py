"""The registered queries over the driver's tables, each beside its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnforge.functions import detect, diff, score, text, vector
from tarnforge.operators import analysis, chunking, graph, metrics, rules, search, stats, tracking
from tarnforge.operators import store as stores
from tarnforge.plans.catalogue import query
from tarnforge.plans.tables import GRAPH, HISTORY, INTERACTIONS, NOW, STORE, at, history, interactions, projects, query_vector, spread, store, table
from tarnforge.plans.tables import graph as graph_tables

_COS = "list_cosine_similarity(cast(vector as double[]), (select cast(embedding as double[]) from embeddings where vec_id = 0))"
_SCORED = f"scored as (select *, {_COS} as sim from store where vector is not null)"


def _six(df, *names):
    """Doubles to six decimals, so that two engines' sums agree."""
    return df.withColumns({n: F.round(n, 6) for n in names})


def _stamp(df, *names):
    return df.withColumns({n: F.date_format(n, "yyyy-MM-dd HH:mm:ss") for n in names})


# Search ---------------------------------------------------------------------------------------------


@query(
    "semantic_topk",
    f"with {STORE}, {_SCORED} select id, round(sim, 6) as sim from scored where content_type in ('code', 'doc') and sim >= 0.0 order by scored.sim desc, id "
    f"limit 10",
)
def semantic_topk(spark, d):
    found = search.semantic(store(spark, d), query_vector(spark, d), 10, 0.0, search.Filters(content_type=["code", "doc"]))
    return _six(found, "sim")


@query("semantic_threshold", f"with {STORE}, {_SCORED} select id, round(sim, 6) as sim from scored where sim >= 0.2")
def semantic_threshold(spark, d):
    return _six(search.scored(store(spark, d), query_vector(spark, d)).where("sim >= 0.2"), "sim")


_FILTERS = (
    "project_path in ('src1') and role in ('core', 'helper', 'test', 'example') and file_size_bytes >= 0 and file_size_bytes <= 9000 and lines_count >= 1 "
    "and lines_count <= 400 and created_at >= timestamp '2024-01-01 00:00:00' and created_at <= timestamp '2024-01-08 00:00:00' and not is_compressed"
)


@query(
    "semantic_filters",
    f"with {STORE}, {_SCORED} select id, round(sim, 6) as sim from scored where {_FILTERS} order by scored.sim desc, id limit 20",
)
def semantic_filters(spark, d):
    f = search.Filters("src1", role=["core", "helper", "test", "example"], content_type=[], min_bytes=0, max_bytes=9000, min_lines=1, max_lines=400, created_from="2024-01-01 00:00:00", created_to="2024-01-08 00:00:00", exclude_compressed=True)
    return _six(search.semantic(store(spark, d), query_vector(spark, d), 20, None, f), "sim")


@query(
    "filter_scalar_and_list",
    f"with {STORE} select id, content_type, language from store where file_extension = 'ts' and language in ('typescript', 'json') and is_compressed = false",
)
def filter_scalar_and_list(spark, d):
    f = search.Filters(extension="ts", language=["typescript", "json"], compressed=False)
    return f.apply(store(spark, d, vectors=False)).select("id", "content_type", "language")


@query("filter_compressed", f"with {STORE} select id, file_size_bytes from store where is_compressed")
def filter_compressed(spark, d):
    return search.Filters(compressed=True).apply(store(spark, d, vectors=False)).select("id", "file_size_bytes")


@query(
    "semantic_batch",
    "select q.vec_id as query_id, v.vec_id as id, round(list_cosine_similarity(cast(v.embedding as double[]), cast(q.embedding as double[])), 5) as sim "
    "from embeddings q, embeddings v where q.vec_id % 20 = 0 qualify row_number() over (partition by q.vec_id order by "
    "list_cosine_similarity(cast(v.embedding as double[]), cast(q.embedding as double[])) desc, v.vec_id) <= 5",
)
def semantic_batch(spark, d):
    """Five nearest vectors of every twentieth one, among all."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    queries = e.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    return search.for_queries(queries, e, 5).withColumn("sim", F.round("sim", 5))


@query(
    "vector_norms",
    "select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double)))), 6) as norm from embeddings",
)
def vector_norms(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(vector.norm(F.col("embedding")), 6).alias("norm"))


@query(
    "l2_normalize",
    "select vec_id, round(list_sum(list_transform(embedding, lambda x: cast(x as double))) / sqrt(list_sum(list_transform(embedding, lambda x: cast(x as "
    "double) * cast(x as double)))), 6) as total from embeddings",
)
def l2_normalize(spark, d):
    unit = vector.l2_normalized(F.transform("embedding", lambda x: x.cast("double") * 3))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(unit, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query(
    "pairwise_stats",
    "select a.label, count(*) as pairs, round(min(s), 6) as least, round(max(s), 6) as greatest, round(avg(s), 6) as mean, round(stddev_samp(s), 6) as "
    "deviation from (select a.label, 1 - list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])) as s from embeddings a join "
    "embeddings b on a.label = b.label and a.vec_id < b.vec_id) a group by a.label",
)
def pairwise_stats(spark, d):
    """Distances of all pairs inside a label."""
    e = table(spark, d, "embeddings").select("label", F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return _six(stats.pairwise(e), "least", "greatest", "mean", "deviation")


_TOP = "top as (select sim from scored order by sim desc, id limit 50), dist as (select count(*) as n, avg(sim) as mean, stddev_pop(sim) as std from top)"


def _bar(p):
    return f"case when n < {p.min_samples} then {p.default} else least(greatest(mean + {p.multiplier} * std, {p.low}), {p.high}) end"


@query(
    "dynamic_threshold",
    f"with {STORE}, {_SCORED}, {_TOP} select n, round(mean, 6) as mean, round(std, 6) as std, round({_bar(score.THRESHOLDS['other'])}, 6) as threshold from "
    f"dist",
)
def dynamic_threshold(spark, d):
    return _six(search.dynamic_threshold(search.scored(store(spark, d), query_vector(spark, d))), "mean", "std", "threshold")


@query(
    "dynamic_threshold_search",
    f"with {STORE}, {_SCORED}, {_TOP} select id, round(sim, 6) as sim, round({_bar(score.THRESHOLDS['other'])}, 6) as threshold from scored, dist where sim "
    f">= {_bar(score.THRESHOLDS['other'])} order by scored.sim desc, id limit 10",
)
def dynamic_threshold_search(spark, d):
    return _six(search.semantic_dynamic(store(spark, d), query_vector(spark, d)), "sim", "threshold")


@query(
    "threshold_by_type",
    f"with {STORE}, {_SCORED}, ranked as (select *, row_number() over (partition by content_type order by sim desc, id) as r from scored), dist as (select "
    f"content_type, count(*) as n, avg(sim) as mean, stddev_pop(sim) as std from ranked where r <= 50 group by 1) select content_type, n, round(case "
    f"content_type " + " ".join(f"when '{k}' then {_bar(p)}" for k, p in score.THRESHOLDS.items()) + " end, 6) as threshold from dist",
)
def threshold_by_type(spark, d):
    s = store(spark, d)
    found = search.scored(s, query_vector(spark, d)).join(s.select("id", "content_type"), "id")
    rank = F.row_number().over(Window.partitionBy("content_type").orderBy(F.desc("sim"), "id"))
    dist = found.withColumn("r", rank).where("r <= 50").groupBy("content_type").agg(F.count("*").alias("n"), F.avg("sim").alias("mean"), F.stddev_pop("sim").alias("std"))
    bar = F
    for kind, p in score.THRESHOLDS.items():
        bar = bar.when(F.col("content_type") == kind, score.threshold(F.col("n"), F.col("mean"), F.col("std"), p))
    return dist.select("content_type", "n", F.round(bar, 6).alias("threshold"))


_FRESH = f"coalesce(greatest(0.0, 1 - (epoch_us(timestamp '{NOW}') - epoch_us(updated_at)) / 86400000000.0 / 365), 0.0)"
_LIKED = (
    "(case when content_type in ('code', 'doc') then 1.0 else 0.5 end) * 0.05 + (case when role in ('core', 'helper') then 1.0 else 0.5 end) * 0.05 + "
    "(case when language in ('typescript', 'javascript', 'python') then 1.0 when language is not null then 0.5 else 0.0 end) * 0.02"
)


@query(
    "rerank",
    f"with {STORE}, {_SCORED}, found as (select * from scored order by sim desc, id limit 20) select id, round(sim, 6) as sim, round(0.7 * sim + 0.15 * "
    f"{_FRESH} + {_LIKED} + 0.03 * (case when file_size_bytes > 0 then least(1.0, file_size_bytes / 1048576.0) else 0.0 end), 6) as final_score from found",
)
def rerank(spark, d):
    s = store(spark, d)
    return _six(search.reranked(s, search.semantic(s, query_vector(spark, d), 20, None), NOW), "sim", "final_score")


def _text_query(name, words, where, operator="and", in_paths=False, columns=("id",), **options):
    @query(name, f"with {STORE} select id from store where {where}")
    def run(spark, d):
        s = spread(store(spark, d, vectors=False))
        cols = [F.col("content")] + ([F.col("file_path")] if in_paths else [])
        return s.where(text.text_filter(cols, words, operator, **options)).select(*columns)

    return run


_text_query("text_and", "the And", r"content ilike '%the%' escape '\' and content ilike '%and%' escape '\'")
_text_query("text_or", "token ÉA", r"content ilike '%token%' escape '\' or content ilike '%éa%' escape '\'", "or")
_text_query("text_prefix", "The", r"content ilike 'the%' escape '\'", prefix=True)
_text_query("text_suffix", "the.", r"content ilike '%the.' escape '\'", suffix=True)
_text_query("text_exact", "100%", r"content ilike '100\%' escape '\'", substring=False)
_text_query("text_literal_marks", "%%% _", r"content ilike '%\%\%\%%' escape '\' and content ilike '%\_%' escape '\'")
_text_query("text_case", "The", r"content like '%The%' escape '\'", case_sensitive=True)
_text_query("text_in_paths", "f1", r"content ilike '%f1%' escape '\' or file_path ilike '%f1%' escape '\'", in_paths=True)


def _sql_text_score(terms):
    n = [f"cast((length(low) - length(replace(low, '{t}', ''))) / {len(t)} as integer)" for t in terms]
    each = " + ".join(f"case when {x} > 0 then 1.0 + 0.1 * least({x} - 1, 3) else 0.0 end" for x in n)
    first = "least(" + ", ".join(f"case when instr(low, '{t}') > 0 then instr(low, '{t}') - 1 else 1000000000 end" for t in terms) + ")"
    total = " + ".join(n)
    return f"least(1.0, case when {total} > 0 then cast({each} as double) / {len(terms)} + case when {first} < 100 then 0.2 else 0.0 end + case when {total} > 1 then 0.1 else 0.0 end else 0.0 end)"


_WORDS = ("token", "idiot")
_TEXT = (
    f"texts as (select id, {_sql_text_score(_WORDS)} as text_score from (select *, lower(content) as low from store where content ilike '%token%' or "
    f"content ilike '%idiot%' or file_path ilike '%token%' or file_path ilike '%idiot%'))"
)


@query("text_score", f"with {STORE}, {_TEXT} select id, round(text_score, 6) as text_score from texts order by texts.text_score desc, id limit 20")
def text_score(spark, d):
    return _six(search.text_search(spread(store(spark, d, vectors=False)), "token Idiot", 20, "or"), "text_score")


@query(
    "hybrid",
    f"with {STORE}, {_SCORED}, {_TEXT}, a as (select id, sim from scored where sim >= 0.1 order by sim desc, id limit 20), b as (select id, text_score from "
    f"texts order by text_score desc, id limit 20), m as (select coalesce(a.id, b.id) as id, coalesce(sim, 0) as s, coalesce(text_score, 0) as t from a "
    f"full join b on a.id = b.id) select id, round(s, 6) as semantic_score, round(t, 6) as text_score, round(s * 0.6, 6) as weighted_semantic, round(t * "
    f"0.4, 6) as weighted_text, round(s * 0.6 + t * 0.4, 6) as combined_score from m order by s * 0.6 + t * 0.4 desc, id limit 20",
)
def hybrid(spark, d):
    found = search.hybrid(store(spark, d), query_vector(spark, d), "token idiot", 20, 1.5, 1.0, 0.1)
    return _six(found, "semantic_score", "text_score", "weighted_semantic", "weighted_text", "combined_score")


@query(
    "output_shaping",
    f"with {STORE}, {_SCORED} select id, file_path, case when length(content) > 120 then left(content, 120) || '...' else content end as content, "
    f"content_type, language from (select * from scored order by sim desc, id limit 10)",
)
def output_shaping(spark, d):
    s = store(spark, d)
    return search.shaped(s, search.semantic(s, query_vector(spark, d), 10, None), 120)


@query(
    "projects_found",
    f"with {STORE}, {_SCORED} select count(distinct project_path) as projects, round(coalesce(avg(sim), 0), 6) as mean_score from (select * from scored "
    f"order by sim desc, id limit 20)",
)
def projects_found(spark, d):
    s = store(spark, d)
    found = search.semantic(s, query_vector(spark, d), 20, None).join(s.select("id", "project_path"), "id")
    return _six(found.agg(F.countDistinct("project_path").alias("projects"), F.coalesce(F.avg("sim"), F.lit(0.0)).alias("mean_score")), "mean_score")


@query(
    "routing_models",
    f"with {STORE} select content_type, case content_type when 'code' then 'model-code' when 'doc' then 'model-text' when 'config' then 'model-config' else "
    f"'model-any' end as model, count(*) as chunks from store group by 1, 2",
)
def routing_models(spark, d):
    m = score.routed_model(F.col("content_type"), {"code": "model-code", "text": "model-text", "config": "model-config"}, "model-any")
    return store(spark, d, vectors=False).groupBy("content_type", m.alias("model")).agg(F.count("*").alias("chunks"))


@query(
    "ab_relevance",
    f"with {STORE}, {_SCORED} select id, round(least(100.0, case when content_type = 'code' then 30.0 else 0.0 end + 10.0 * (cast(contains(lower(content), "
    f"'the') as integer) + cast(contains(lower(content), 'of') as integer)) + least(20.0, 20 * sim) + case when age < 30 then 10.0 when age < 90 then 5.0 "
    f"else 0.0 end), 5) as points from (select *, (epoch_us(timestamp '{NOW}') - epoch_us(updated_at)) / 86400000000.0 as age from scored)",
)
def ab_relevance(spark, d):
    s = store(spark, d)
    found = search.scored(s, query_vector(spark, d)).join(s.select("id", "content_type", "content", "updated_at"), "id")
    hits = sum(F.contains(F.lower("content"), F.lit(k)).cast("int") for k in ("the", "of"))
    age = score.days_between(F.col("updated_at"), F.lit(NOW).cast("timestamp"))
    return found.select("id", F.round(score.ab_relevance(F.col("content_type") == "code", hits, F.col("sim"), age), 5).alias("points"))


# Statistics -----------------------------------------------------------------------------------------

_F = "'%Y-%m-%d %H:%M:%S'"


@query(
    "store_stats",
    f"with {STORE} select project_path, content_type, role, count(*) as chunks, count(distinct file_path) as files, round(avg(length(content)), 6) as "
    f"avg_length, strftime(min(created_at), {_F}) as first_created, strftime(max(updated_at), {_F}) as last_updated, cast(sum(case when is_compressed then "
    f"1 else 0 end) as bigint) as compressed from store group by all",
)
def store_stats(spark, d):
    return _stamp(_six(stats.store_stats(store(spark, d, False)), "avg_length"), "first_created", "last_updated")


@query(
    "coverage",
    f"with {STORE} select project_path, count(distinct file_path) as chunk_paths, count(distinct regexp_replace(file_path, '#chunk[0-9]+$', '')) as files, "
    f"cast(sum(total_chunks) as bigint) as total_chunks, count(*) as chunks, strftime(max(updated_at), {_F}) as last_updated from store group by 1",
)
def coverage(spark, d):
    return _stamp(stats.coverage(store(spark, d, False)), "last_updated")


_COMPRESSION = "100.0 * (original_size_bytes - file_size_bytes) / original_size_bytes"


@query(
    "project_stats_mv",
    f"with {STORE} select project_path, count(*) as chunks, count(distinct file_path) as files, count(distinct language) as languages, count(distinct "
    f"file_extension) as extensions, cast(sum(file_size_bytes) as bigint) as bytes, round(avg(lines_count), 6) as avg_lines, round(avg(case when "
    f"is_compressed then {_COMPRESSION} end), 6) as avg_compression from store group by 1",
)
def project_stats_mv(spark, d):
    return _six(stats.project_view(store(spark, d, False)), "avg_lines", "avg_compression")


@query(
    "size_distribution",
    f"with {STORE} select case when file_size_bytes < 1024 then 'tiny' when file_size_bytes < 10240 then 'small' when file_size_bytes < 102400 then "
    f"'medium' when file_size_bytes < 1048576 then 'large' else 'huge' end as size_class, count(*) as chunks, round(avg(file_size_bytes), 6) as avg_bytes, "
    f"cast(min(file_size_bytes) as bigint) as min_bytes, cast(max(file_size_bytes) as bigint) as max_bytes, cast(sum(file_size_bytes) as bigint) as bytes "
    f"from store group by 1",
)
def size_distribution(spark, d):
    return _six(stats.size_distribution(store(spark, d, False)), "avg_bytes")


@query(
    "temporal_coverage",
    f"with {STORE} select project_path, strftime(created_at, '%Y-%m-%d') as day, count(*) as chunks, count(distinct file_path) as files from store group by "
    f"1, 2",
)
def temporal_coverage(spark, d):
    return stats.temporal_coverage(store(spark, d, False)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    "compression_stats",
    f"with {STORE} select project_path, content_type, count(*) as chunks, cast(sum(original_size_bytes) as bigint) as original_bytes, "
    f"cast(sum(file_size_bytes) as bigint) as bytes, round(avg({_COMPRESSION}), 6) as avg_compression from store where is_compressed group by 1, 2",
)
def compression_stats(spark, d):
    return _six(stats.compression_stats(store(spark, d, False)), "avg_compression")


@query(
    "perf_stats",
    f"with {STORE} select count(*) as chunks, count(distinct project_path) as projects, count(distinct file_path) as files, count(*) filter (content_type = "
    f"'code') as code, count(*) filter (content_type = 'doc') as doc, count(*) filter (is_compressed) as compressed, round(avg(file_size_bytes), 6) as "
    f"avg_bytes from store",
)
def perf_stats(spark, d):
    return _six(stats.performance_stats(store(spark, d, False)), "avg_bytes")


@query(
    "project_stats",
    f"with {STORE} select count(*) as chunks, count(distinct regexp_replace(file_path, '#chunk[0-9]+$', '')) as files, strftime(min(created_at), {_F}) as "
    f"first_created, strftime(max(updated_at), {_F}) as last_updated, (select string_agg(content_type || '=' || n, ',' order by content_type) from (select "
    f"content_type, count(*) as n from store where project_path = 'src3' group by 1)) as by_type from store where project_path = 'src3'",
)
def project_stats(spark, d):
    one = stats.project_stats(store(spark, d, False), "src3")
    flat = F.array_join(F.transform(F.map_entries("by_type"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return _stamp(one, "first_created", "last_updated").withColumn("by_type", flat)


@query("list_projects", "select distinct source as project_path from documents")
def list_projects(spark, d):
    return stats.projects(store(spark, d, False))


@query("type_distribution", f"with {STORE} select content_type, count(*) as chunks from store group by 1")
def type_distribution(spark, d):
    return stats.type_distribution(store(spark, d, False))


@query(
    "chunk_stats",
    f"with {STORE} select project_path, content_type, language, count(*) as chunks, round(avg(lines_count), 6) as avg_lines, round(avg(length(content)), 6) "
    f"as avg_length from store group by 1, 2, 3",
)
def chunk_stats(spark, d):
    return _six(stats.chunk_stats(store(spark, d, False)), "avg_lines", "avg_length")


_MODELS = "e as (select vec_id as embedding_id, vec_id % 400 as chunk_id, 'm' || (vec_id % 3) as model from embeddings)"


@query(
    "project_summary",
    f"with p as (select cast(range as bigint) as project_id from range(60)), c as (select doc_id as chunk_id, doc_id % 50 as project_id from documents), "
    f"{_MODELS} select p.project_id, count(c.chunk_id) as chunk_rows, count(distinct c.chunk_id) as chunks, count(distinct model) as models, "
    f"count(embedding_id) as embeddings from p left join c on p.project_id = c.project_id left join e on c.chunk_id = e.chunk_id group by 1",
)
def project_summary(spark, d):
    c = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % 50).alias("project_id"))
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("embedding_id"), (F.col("vec_id") % 400).alias("chunk_id"), F.concat(F.lit("m"), (F.col("vec_id") % 3).cast("string")).alias("model"))
    return stats.project_summary(projects(spark), c, e)


@query(
    "version_stats",
    f"with {HISTORY} select chunk_id, count(*) as versions, min(version) as first_version, max(version) as last_version, count(*) filter (change_type = "
    f"'created') as created, count(*) filter (change_type = 'updated') as updated, count(*) filter (change_type = 'deleted') as deleted, "
    f"round(avg(change_percentage), 6) as avg_change from versions group by 1",
)
def version_stats(spark, d):
    out = stats.version_stats(stores.replayed_versions(history(spark, d)))
    return out.withColumn("avg_change", F.round("avg_change", 6)).withColumns({c: F.col(c).cast("long") for c in ("first_version", "last_version")})


# Store ----------------------------------------------------------------------------------------------

_EDIT = "case when doc_id % 7 = 0 then 'x ' || content when doc_id % 5 = 0 then content || repeat('!', 200) else content end"


def _edited(spark, d):
    """The store, and a later one: some files are renamed, some contents edited."""
    s = store(spark, d)
    new = s.withColumn("id", F.when(F.col("doc_id") % 5 == 2, F.concat("id", F.lit("~"))).otherwise(F.col("id"))).withColumn("content", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("x "), F.col("content"))).when(F.col("doc_id") % 5 == 0, F.concat("content", F.lit("!" * 200))).otherwise(F.col("content")))
    return s, new.withColumn("updated_at", at(F.col("doc_id") * 3)).withColumn("version", F.lit(9))


_BOTH = (
    f"old as (select * from store), new as (select * replace (case when doc_id % 5 = 2 then id || '~' else id end as id, {_EDIT} as content, timestamp "
    f"'2024-01-01' + to_minutes(doc_id * 3) as updated_at, 9 as version) from store)"
)


@query(
    "upsert",
    f"with {STORE}, {_BOTH} select coalesce(o.id, n.id) as id, sha256(coalesce(n.content, o.content)) as content_sha256, coalesce(o.version, n.version) as "
    f"version, strftime(coalesce(n.updated_at, o.updated_at), {_F}) as updated_at, strftime(coalesce(o.created_at, n.created_at), {_F}) as created_at from "
    f"old o full join new n on o.id = n.id",
)
def upsert(spark, d):
    out = stores.upsert(*_edited(spark, d))
    return _stamp(out, "updated_at", "created_at").select("id", F.sha2("content", 256).alias("content_sha256"), "version", "updated_at", "created_at")


@query(
    "delete_file",
    f"with {STORE} select id from store where not (project_path = 'src3' and regexp_replace(file_path, '#chunk[0-9]+$', '') = 'src/f1.md')",
)
def delete_file(spark, d):
    return stores.without_file(store(spark, d, False), "src3", "src/f1.md").select("id")


@query("delete_project", "select count(*) as chunks, count(distinct source) as projects from documents where source <> 'src3'")
def delete_project(spark, d):
    return stores.without_project(store(spark, d, False), "src3").agg(F.count("*").alias("chunks"), F.countDistinct("project_path").alias("projects"))


@query(
    "store_changes",
    f"with {STORE}, {_BOTH} select coalesce(o.id, n.id) as id, case when o.id is null then 'created' when n.id is null then 'deleted' else 'updated' end as "
    f"change_type from old o full join new n on o.id = n.id where o.id is null or n.id is null or o.content is distinct from n.content or o.vector is "
    f"distinct from n.vector",
)
def store_changes(spark, d):
    return stores.changes(*_edited(spark, d)).select("id", "change_type")


@query(
    "history_append",
    f"with {STORE}, {_BOTH}, {HISTORY}, last as (select chunk_id, max(version) as v from versions group by 1) select coalesce(o.id, n.id) as chunk_id, "
    f"coalesce(v, 0) + 1 as version, coalesce(length(n.content), 0) - coalesce(length(o.content), 0) as length_change from old o full join new n on o.id = "
    f"n.id left join last on last.chunk_id = 'c' || o.doc_id where o.id is null or n.id is null or o.content is distinct from n.content",
)
def history_append(spark, d):
    old, new = _edited(spark, d)
    names = store(spark, d, False).select("id", F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("cid"))
    past = stores.replayed_versions(history(spark, d)).join(names, F.col("chunk_id") == F.col("cid")).select(F.col("id").alias("chunk_id"), "version")
    rows = stores.history_rows(stores.changes(old, new), past, F.lit(NOW).cast("timestamp"))
    return rows.select("chunk_id", F.col("version").cast("long").alias("version"), F.get_json_object("metadata", "$.length_change").cast("long").alias("length_change"))


_OLDNEW = f"pairs as (select doc_id, content as old_text, {_EDIT} as new_text from store)"
_PCT = "case when length(old_text) = 0 then 100.0 else 100.0 * (length(new_text) - length(old_text)) / length(old_text) end"


def _pairs(spark, d):
    s = store(spark, d, False)
    new = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("x "), F.col("content"))).when(F.col("doc_id") % 5 == 0, F.concat("content", F.lit("!" * 200))).otherwise(F.col("content"))
    return s.select("doc_id", F.col("content").alias("old_text"), new.alias("new_text"))


@query(
    "content_diff",
    f"with {STORE}, {_OLDNEW} select doc_id, length(old_text) as old_length, length(new_text) as new_length, length(new_text) - length(old_text) as "
    f"length_change, length(old_text) - length(replace(old_text, chr(10), '')) + 1 as old_lines, round({_PCT}, 6) as change_percentage, abs({_PCT}) > 10 as "
    f"significant_change from pairs",
)
def content_diff(spark, d):
    out = _pairs(spark, d).select("doc_id", diff.content_diff(F.col("old_text"), F.col("new_text")).alias("d"))
    out = out.select("doc_id", *(F.col(f"d.{c}").cast("long").alias(c) for c in ("old_length", "new_length", "length_change", "old_lines")), "d.change_percentage", "d.significant_change")
    return _six(out, "change_percentage")


@query("significant_change", f"with {STORE}, {_OLDNEW} select doc_id, abs({_PCT}) >= 10 as significant from pairs")
def significant_change(spark, d):
    return _pairs(spark, d).select("doc_id", diff.significant(F.col("old_text"), F.col("new_text")).alias("significant"))


@query(
    "compare_versions",
    f"with {HISTORY}, p as (select a.chunk_id, a.content as c1, b.content as c2, a.change_type as t1, b.change_type as t2, a.changed_at as w1, b.changed_at "
    f"as w2 from versions a join versions b on a.chunk_id = b.chunk_id and a.version = 1 and b.version = 2) select chunk_id, 'content' as field, left(c1, "
    f"100) as value1, left(c2, 100) as value2, c1 is distinct from c2 as different from p union all select chunk_id, 'content_length', cast(length(c1) as "
    f"varchar), cast(length(c2) as varchar), length(c1) <> length(c2) from p union all select chunk_id, 'change_type', t1, t2, t1 <> t2 from p union all "
    f"select chunk_id, 'changed_at', strftime(w1, {_F}), strftime(w2, {_F}), w1 <> w2 from p",
)
def compare_versions(spark, d):
    return stores.compared_versions(stores.replayed_versions(history(spark, d)), 1, 2)


@query(
    "history_versions",
    f"with {HISTORY} select chunk_id, version, change_type from versions qualify row_number() over (partition by chunk_id order by version desc) <= 3",
)
def history_versions(spark, d):
    return stores.chunk_history(stores.replayed_versions(history(spark, d)), limit=3).select("chunk_id", F.col("version").cast("long").alias("version"), "change_type")


@query("history_of_chunk", f"with {HISTORY} select version, change_type, content from versions where chunk_id = 'c7' order by version desc limit 10")
def history_of_chunk(spark, d):
    return stores.chunk_history(stores.replayed_versions(history(spark, d)), "c7").select(F.col("version").cast("long").alias("version"), "change_type", "content")


@query(
    "version_changes",
    f"with {HISTORY}, l as (select chunk_id, version, content, lag(content) over (partition by chunk_id order by version) as before from versions) select "
    f"chunk_id, version, round(100.0 * (length(content) - length(before)) / length(before), 6) as change_percentage from l where before is not null",
)
def version_changes(spark, d):
    v = stores.replayed_versions(history(spark, d))
    before = F.lag("content").over(Window.partitionBy("chunk_id").orderBy("version"))
    out = v.withColumn("before", before).where("before is not null")
    return out.select("chunk_id", F.col("version").cast("long").alias("version"), F.round(diff.change_percent(F.col("before"), F.col("content")), 6).alias("change_percentage"))


@query(
    "incremental_diff",
    f"with {STORE}, {_BOTH} select coalesce(o.id, n.id) as path, case when o.id is null then 'added' when n.id is null then 'deleted' when o.content <> "
    f"n.content then 'modified' else 'unchanged' end as status from old o full join new n on o.id = n.id",
)
def incremental_diff(spark, d):
    old, new = (x.withColumn("path", F.col("id")) for x in _edited(spark, d))
    return stores.incremental_diff(stores.snapshot(old), stores.snapshot(new))


@query(
    "migrate_legacy",
    f"with {STORE} select id, content_type, case content_type when 'code' then 'core' when 'doc' then 'example' when 'config' then 'template' else 'other' "
    f"end as role, file_extension, file_size_bytes, lines_count, chunk_index from store",
)
def migrate_legacy(spark, d):
    old = store(spark, d, False).select("id", "project_path", "file_path", "content", "created_at", "updated_at")
    out = stores.migrated(old).select("id", "content_type", "role", "file_extension", "file_size_bytes", "lines_count", "chunk_index")
    return out.withColumns({c: F.col(c).cast("long") for c in ("file_size_bytes", "lines_count", "chunk_index")})


@query(
    "validation_errors",
    "select source || ':' || doc_id as id, case when doc_id % 11 = 0 and doc_id % 13 = 0 then 'content_type,total_chunks' when doc_id % 11 = 0 then "
    "'content_type' else 'total_chunks' end as problems from documents where doc_id % 11 = 0 or doc_id % 13 = 0",
)
def validation_errors(spark, d):
    s = store(spark, d, False).withColumn("id", F.concat("project_path", F.lit(":"), F.col("doc_id").cast("string")))
    s = s.withColumn("content_type", F.when(F.col("doc_id") % 11 == 0, "odd").otherwise(F.col("content_type"))).withColumn("total_chunks", F.when(F.col("doc_id") % 13 == 0, F.col("chunk_index")).otherwise(F.col("total_chunks")))
    return stores.errors(s).withColumn("problems", F.array_join("problems", ","))


# Tracking -------------------------------------------------------------------------------------------

_P = "p as (select cast(range as bigint) as project_id from range(60))"


@query(
    "recent_projects",
    f"with {INTERACTIONS}, {_P} select p.project_id, count(interaction_id) as interactions, strftime(max(created_at), {_F}) as last_at, "
    f"arg_max(interaction_type, row(created_at, interaction_id)) as last_type from p left join inter i on p.project_id = i.project_id group by 1 order by "
    f"max(created_at) desc nulls last, 1 limit 10",
)
def recent_projects(spark, d):
    return _stamp(tracking.recent_projects(projects(spark), interactions(spark, d)), "last_at")


@query(
    "recent_projects_of_user",
    f"with {INTERACTIONS}, {_P} select p.project_id, count(*) as interactions, strftime(max(created_at), {_F}) as last_at, arg_max(interaction_type, "
    f"row(created_at, interaction_id)) as last_type from p join inter i on p.project_id = i.project_id where user_id = 7 group by 1",
)
def recent_projects_of_user(spark, d):
    return _stamp(tracking.recent_projects(projects(spark), interactions(spark, d), 7), "last_at")


@query(
    "interaction_stats",
    f"with {INTERACTIONS}, {_P} select p.project_id, count(interaction_id) as interactions, cast(sum(case when success then 1 else 0 end) as bigint) as "
    f"succeeded, cast(sum(case when not success then 1 else 0 end) as bigint) as failed, count(distinct interaction_type) as types, round(avg(duration_ms), "
    f"6) as avg_ms from p left join inter i on p.project_id = i.project_id group by 1",
)
def interaction_stats(spark, d):
    return tracking.interaction_stats(projects(spark), interactions(spark, d)).withColumn("avg_ms", F.round("avg_ms", 6))


_REL = "case when contains(lower(text), 'and') then 0.9 when regexp_matches(lower(text), 'project|code|file') then 0.7 else 0.5 end"


def _messages(spark, d):
    m = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("message_id"), (F.col("conv_id") % 50).alias("project_id"), F.col("role").alias("user"), F.col("conv_id").alias("conversation_id"), "text")
    return tracking.linked(m, F.lit("And"))


@query(
    "message_stats",
    f"with {_P}, m as (select conv_id * 100 + turn as message_id, conv_id % 50 as project_id, role as usr, conv_id, {_REL} as relevance from conversations) "
    f"select p.project_id, count(message_id) as messages, cast(sum(case when relevance >= 0.3 then 1 else 0 end) as bigint) as related, "
    f"round(cast(avg(relevance) as double), 6) as avg_relevance, cast(min(relevance) as double) as min_relevance, cast(max(relevance) as double) as "
    f"max_relevance, count(distinct usr) as users, count(distinct conv_id) as conversations from p left join m on p.project_id = m.project_id group by 1",
)
def message_stats(spark, d):
    return _six(tracking.message_stats(projects(spark), _messages(spark, d)), "avg_relevance")


@query(
    "link_relevance",
    f"select conv_id * 100 + turn as message_id, cast({_REL} as double) as relevance, case when {_REL} >= 0.8 then 'named' when {_REL} >= 0.6 then "
    f"'related' else 'context' end as reason, true as related from conversations",
)
def link_relevance(spark, d):
    return _messages(spark, d).select("message_id", "relevance", "reason", "related")


@query("cache_ttl", "select event_id as cache_key, user_id from events where ts + to_hours(24) >= timestamp '2024-01-15'")
def cache_ttl(spark, d):
    c = table(spark, d, "events").select(F.col("event_id").alias("cache_key"), "user_id", (F.col("ts") + F.expr("interval 24 hours")).alias("expires_at"))
    return stores.without_expired(c, "2024-01-15 00:00:00")[0].select("cache_key", "user_id")


@query("cache_removed", "select count(*) as removed from events where ts + to_hours(24) < timestamp '2024-01-15'")
def cache_removed(spark, d):
    c = table(spark, d, "events").select((F.col("ts") + F.expr("interval 24 hours")).alias("expires_at"))
    return stores.without_expired(c, "2024-01-15 00:00:00")[1]


@query(
    "cache_eviction",
    "select event_id as cache_key from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 3",
)
def cache_eviction(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("cache_key"), "user_id", "ts")
    return stores.newest(e, "user_id", ["ts", "cache_key"], 3).select("cache_key")


@query(
    "init_tracking",
    f"with {STORE}, t as (select 'src' || range as project_id, 1 as files, cast(2 as bigint) as bytes from range(15, 25)), n as (select project_path, "
    f"count(distinct file_path) as files, cast(sum(file_size_bytes) as bigint) as bytes from store group by 1) select coalesce(t.project_id, "
    f"n.project_path) as project_id, coalesce(n.files, t.files) as files, coalesce(n.bytes, t.bytes) as bytes from t full join n on t.project_id = "
    f"n.project_path",
)
def init_tracking(spark, d):
    t = spark.range(15, 25).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("project_id"), F.lit(1).cast("long").alias("files"), F.lit(2).cast("long").alias("bytes"))
    return tracking.initialised(t, store(spark, d, False))


@query(
    "record_interaction",
    f"with {INTERACTIONS}, p as (select cast(range as bigint) as project_id, timestamp '2024-01-10' as last_accessed from range(30)) select "
    f"coalesce(p.project_id, i.project_id) as project_id, strftime(greatest(last_accessed, t), {_F}) as last_accessed from p full join (select project_id, "
    f"max(created_at) as t from inter group by 1) i on p.project_id = i.project_id",
)
def record_interaction(spark, d):
    p = spark.range(30).select(F.col("id").alias("project_id"), F.lit("2024-01-10 00:00:00").cast("timestamp").alias("last_accessed"))
    i = interactions(spark, d)
    return _stamp(tracking.recorded(p, i.limit(0), i)[0], "last_accessed")


# Functions ------------------------------------------------------------------------------------------

_INT32 = "((({0}) + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648"


def _sql_hash(value, start, factor):
    return f"list_reduce(list_transform(string_split({value}, ''), lambda c: cast(unicode(c) as bigint)), lambda h, c: {_INT32.format(f'h * {factor} + c')}, cast({start} as bigint))"


@query("rolling_hash", f"select doc_id, {_sql_hash('text', 0, 31)} as rolling, {_sql_hash('text', 5381, 33)} as djb2 from documents")
def rolling_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", text.rolling_hash(F.col("text")).alias("rolling"), text.djb2_hash(F.col("text")).alias("djb2"))


@query(
    "project_ids",
    f"select source as project_path, lpad(lower(printf('%x', abs({_sql_hash('source', 0, 31)}))), 8, '0') as project_id from (select distinct source from "
    f"documents)",
)
def project_ids(spark, d):
    return table(spark, d, "documents").select(F.col("source").alias("project_path")).distinct().select("project_path", text.project_id(F.col("project_path")).alias("project_id"))


@query("chunk_ids", f"with {STORE} select id, id as made, project_path || ':' || regexp_replace(file_path, '#chunk[0-9]+$', '') as single from store")
def chunk_ids(spark, d):
    c = [F.col(x) for x in ("project_path", "file_path", "chunk_index")]
    return store(spark, d, False).select("id", text.chunk_id(*c, F.col("total_chunks")).alias("made"), text.chunk_id(*c, F.lit(1)).alias("single"))


@query(
    "token_estimates",
    "select doc_id, cast(ceil(length(text) / 4.0) as bigint) as tokens, cast(length(text) - length(replace(text, chr(10), '')) + 1 as bigint) as lines "
    "from documents",
)
def token_estimates(spark, d):
    return table(spark, d, "documents").select("doc_id", text.estimated_tokens(F.col("text")).alias("tokens"), text.line_count(F.col("text")).cast("long").alias("lines"))


_FULL = "list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')"


@query(
    "content_density",
    f"select doc_id, round(least(1.0, coalesce(len({_FULL}) / len(string_split(text, chr(10))) * (list_sum(list_transform({_FULL}, lambda x: length(x))) / "
    f"nullif(len({_FULL}), 0)) / 100, 0)), 6) as density from documents",
)
def content_density(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(text.content_density(F.col("text")), 6).alias("density"))


@query(
    "comment_ratio",
    "select doc_id, round(100.0 * len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(trim(x), '^(//|#|/\\*|\\*)'))) / "
    "len(string_split(text, chr(10))), 6) as percent from documents",
)
def comment_ratio(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(text.comment_ratio(F.col("text")), 6).alias("percent"))


@query(
    "quality_score",
    "select doc_id, cast(least(100, greatest(0, 50 + case when doc_id % 30 > 20 then 20 when doc_id % 30 > 10 then 10 else 0 end + case when doc_id % 2 = "
    "0 then 15 else 0 end + least(5 * (doc_id % 6), 15) - case when ceil(length(text) / 4.0) > 1000 then 10 else 0 end)) as bigint) as quality, "
    "cast(least(100, 60 + case when doc_id % 3 = 0 then 20 else 0 end + case when doc_id % 12 between 3 and 7 then 10 else 0 end + case when doc_id % 20 "
    "between 5 and 15 then 10 else 0 end) as bigint) as relevance from documents",
)
def quality_score(spark, d):
    i = F.col("doc_id")
    q = score.quality_score(i % 30, i % 2 == 0, i % 6, text.estimated_tokens(F.col("text")))
    r = score.relevance_score(i % 3 == 0, i % 12, i % 20)
    return table(spark, d, "documents").select("doc_id", q.cast("long").alias("quality"), r.cast("long").alias("relevance"))


@query(
    "word_chunks",
    "with w as (select doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') as ws from documents), n as (select *, greatest(1, "
    "cast(ceil((len(ws) - 20) / 80.0) as bigint)) as total from w), i as (select doc_id, ws, total, unnest(range(total)) as chunk_index from n) select "
    "doc_id, total as total_chunks, chunk_index, md5(array_to_string(list_slice(ws, chunk_index * 80 + 1, chunk_index * 80 + 100), ' ')) as chunk from i",
)
def word_chunks(spark, d):
    out = chunking.exploded(spread(table(spark, d, "documents")), chunking.word_chunks(F.col("text"), 100, 20), "doc_id")
    return out.select("doc_id", F.col("total_chunks").cast("long").alias("total_chunks"), F.col("chunk_index").cast("long").alias("chunk_index"), F.md5("chunk").alias("chunk"))


@query(
    "chunk_references",
    "with c as (select doc_id as id, source as file, text as code, regexp_extract(text, '[A-Za-z]{12,}') as name from documents), w as (select distinct "
    "id, file, unnest(regexp_extract_all(code, '[A-Za-z_][A-Za-z0-9_]*')) as name from c) select distinct w.id, n.id as refers_to from w join c n on "
    "w.file = n.file and w.name = n.name where n.name <> '' and w.id <> n.id",
)
def chunk_references(spark, d):
    """Documents of a source whose words have the name of another: its first long word."""
    c = table(spark, d, "documents").select(F.col("source").alias("file"), F.col("doc_id").alias("id"), F.regexp_extract("text", "[A-Za-z]{12,}", 0).alias("name"), F.col("text").alias("code"))
    return analysis.references(c)


# Detection ------------------------------------------------------------------------------------------


def _sql_sign(pattern):
    p = pattern.replace("'", "''")
    return p


def _sql_score(kind):
    return "(" + " + ".join(f"case when regexp_matches(content, '{_sql_sign(p)}') then {w} else 0.0 end" for w, p in detect.SIGNS[kind]) + ") * least(100, lines_count) / 100"


_DET = (
    f"det as (select *, cast({_sql_score('code')} as double) as cs, cast({_sql_score('doc')} as double) as ds, cast({_sql_score('config')} as double) as fs "
    f"from store), kinds as (select *, greatest(cs, ds, fs) as top from det), named as (select *, case when top <= 1 then 'other' when top = cs then 'code' "
    f"when top = ds then 'doc' else 'config' end as kind, case when top <= 1 then 0.5 else least(0.9, top / 5) end as sure from kinds)"
)


@query(
    "detect_type",
    f"with {STORE}, {_DET} select id, case when kind <> content_type and sure > 0.7 then kind else content_type end as found_type, case when kind <> "
    f"content_type and sure > 0.7 then 'content' else 'extension' end as detected_by, round(case when kind <> content_type and sure > 0.7 then sure when "
    f"kind = content_type then 0.95 else 0.9 end, 6) as confidence from named",
)
def detect_type(spark, d):
    s = spread(store(spark, d, False))
    out = s.select("id", detect.detected(text.clean_path(F.col("file_path")), F.col("content")).alias("x"))
    return out.select("id", F.col("x.content_type").alias("found_type"), "x.detected_by", F.round("x.confidence", 6).alias("confidence"))


def _sql_first(signs, column):
    return "case " + " ".join(f"when regexp_matches({column}, '{_sql_sign(p)}') then '{n}'" for n, p in signs) + " end"


@query("detect_language", f"select doc_id, {_sql_first(detect.LANGUAGE_SIGNS, 'text')} as language from documents")
def detect_language(spark, d):
    return spread(table(spark, d, "documents")).select("doc_id", detect.language_by_content(F.col("text")).alias("language"))


@query("html_language", f"select page_id, {_sql_first(detect.LANGUAGE_SIGNS, 'html')} as language from pages")
def html_language(spark, d):
    return table(spark, d, "pages").select("page_id", detect.language_by_content(F.col("html")).alias("language"))


_ROLE = """case when regexp_matches(p, 'test|spec') then 'test' when regexp_matches(p, 'example|demo') then 'example' when regexp_matches(p, 'template|boilerplate') then 'template'
  when regexp_matches(p, 'util|helper|common') then 'helper' when content_type = 'code' and regexp_matches(c, 'describe\\(|it\\(|test\\(|assert|expect\\(') then 'test'
  when content_type = 'code' and regexp_matches(c, 'example|demo') then 'example' when content_type = 'code' and regexp_matches(c, 'export (function|const|class|default)') and regexp_matches(c, '\\b(utils?|helpers?|common|tools?|format|parse|validate|calculate)\\b') then 'helper'
  when content_type = 'code' then 'core' else 'other' end"""
_PATHS = (
    "case doc_id % 6 when 0 then 'src/test/a.ts' when 1 then 'examples/demo.ts' when 2 then 'templates/base.ts' when 3 then 'src/utils/Helper.ts' when 4 "
    "then 'src/core/app.ts' else 'lib/b.ts' end"
)
_BODY = (
    "case doc_id % 5 when 0 then 'export function formatDate() {} // util ' when 1 then 'describe(x) ' when 2 then 'a demo ' when 3 then 'export class A ' "
    "else '' end || content"
)


@query(
    "detect_role",
    f"with {STORE}, r as (select id, content_type, lower({_PATHS}) as p, lower({_BODY}) as c from store) select id, {_ROLE} as role from r",
)
def detect_role(spark, d):
    i = F.col("doc_id")
    path = F.element_at(F.array(*map(F.lit, ("src/test/a.ts", "examples/demo.ts", "templates/base.ts", "src/utils/Helper.ts", "src/core/app.ts", "lib/b.ts"))), (i % 6 + 1).cast("int"))
    lead = F.when(i % 5 == 0, "export function formatDate() {} // util ").when(i % 5 == 1, "describe(x) ").when(i % 5 == 2, "a demo ")
    body = F.concat(lead.when(i % 5 == 3, "export class A ").otherwise(""), F.col("content"))
    return store(spark, d, False).select("id", detect.role(path, body, F.col("content_type")).alias("role"))


# Graph ----------------------------------------------------------------------------------------------


@query(
    "graph_create",
    f"with {GRAPH} select name, etype as \"entityType\" from ent union all select 'customer ' || c_custkey, 'customer' from customer",
)
def graph_create(spark, d):
    e, _ = graph_tables(spark, d)
    known = e.where("entityType <> 'supplier'").select("name", F.lit("again").alias("entityType"), "observations")
    new = table(spark, d, "customer").select(F.concat(F.lit("customer "), F.col("c_custkey").cast("string")).alias("name"), F.lit("customer").alias("entityType"), F.array().cast("array<string>").alias("observations"))
    return graph.create_entities(e, new.unionByName(known)).select("name", "entityType")


@query(
    "graph_delete_cascade",
    f"with {GRAPH}, gone as (select n_name as name from nation where n_regionkey = 1) select f as \"from\", t as \"to\", k as \"relationType\" from rel "
    f"where f not in (select name from gone) and t not in (select name from gone)",
)
def graph_delete_cascade(spark, d):
    e, r = graph_tables(spark, d)
    return graph.delete_entities(e, r, table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_name").alias("name")))[1]


@query(
    "graph_create_relations",
    f"with {GRAPH} select f as \"from\", t as \"to\", k as \"relationType\" from rel union all select n_name, n_name, 'self' from nation",
)
def graph_create_relations(spark, d):
    _, r = graph_tables(spark, d)
    new = table(spark, d, "nation").select(F.col("n_name").alias("from"), F.col("n_name").alias("to"), F.lit("self").alias("relationType"))
    return graph.create_relations(r, new.unionByName(r.limit(3)))


@query("graph_delete_relations", f"with {GRAPH} select f as \"from\", t as \"to\", k as \"relationType\" from rel where k <> 'in'")
def graph_delete_relations(spark, d):
    _, r = graph_tables(spark, d)
    return graph.delete_relations(r, r.where("relationType = 'in'"))


@query(
    "graph_observations",
    f"with {GRAPH} select name, array_to_string(obs || case when etype = 'nation' then ['a nation'] else [] end, ';') as observations from ent",
)
def graph_observations(spark, d):
    e, _ = graph_tables(spark, d)
    more = e.where("entityType = 'nation'").select("name", F.array(F.lit("a nation"), F.element_at("observations", 1)).alias("contents"))
    return graph.add_observations(e, more).select("name", F.array_join("observations", ";").alias("observations"))


@query(
    "graph_delete_observations",
    f"with {GRAPH} select name, array_to_string(list_filter(obs, lambda x: not starts_with(x, 'key')), ';') as observations from ent",
)
def graph_delete_observations(spark, d):
    e, _ = graph_tables(spark, d)
    gone = e.select("name", F.filter("observations", lambda x: F.startswith(x, F.lit("key"))).alias("contents"))
    return graph.delete_observations(e, gone).select("name", F.array_join("observations", ";").alias("observations"))


@query(
    "graph_search",
    f"with {GRAPH}, hit as (select name from ent where contains(lower(name), 'region') or contains(lower(etype), 'region') or len(list_filter(obs, lambda "
    f"x: contains(lower(x), 'region'))) > 0) select f as \"from\", t as \"to\", k as \"relationType\" from rel where f in (select name from hit) and t in "
    f"(select name from hit)",
)
def graph_search(spark, d):
    return graph.search(*graph_tables(spark, d), "Region")[1]


@query(
    "graph_open",
    f"with {GRAPH} select name, etype as \"entityType\", array_to_string(obs, ';') as observations from ent where name in (select r_name from region)",
)
def graph_open(spark, d):
    names = table(spark, d, "region").select(F.col("r_name").alias("name"))
    return graph.open_nodes(*graph_tables(spark, d), names)[0].withColumn("observations", F.array_join("observations", ";"))


# Metrics --------------------------------------------------------------------------------------------


def _points(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("metric_id"), F.col("event_type").alias("type"), F.col("value").alias("score"), F.col("ts").alias("timestamp"))


@query(
    "search_quality_stats",
    "select event_type as type, count(*) as n, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as median, round(min(value), 6) as least, "
    "round(max(value), 6) as greatest from events group by 1",
)
def search_quality_stats(spark, d):
    out = metrics.quality(_points(spark, d), "type")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "median", "least", "greatest")})


@query(
    "score_histogram",
    "with s as (select min(value) as lo, max(value) as hi from events), g as (select cast(range as integer) as bucket, lo + (range + 0.5) * (hi - lo) / 10 "
    "as midpoint, lo, hi from range(10), s) select bucket, round(midpoint, 6) as midpoint, (select count(*) from events where value < hi and "
    "cast(floor((value - lo) / ((hi - lo) / 10)) as integer) = bucket) as n from g",
)
def score_histogram(spark, d):
    return metrics.histogram(_points(spark, d)).withColumn("midpoint", F.round("midpoint", 6))


@query(
    "metrics_filter",
    "select event_id as metric_id, round(value, 6) as score from events where event_type = 'click' and ts >= timestamp '2024-01-10' order by ts desc, "
    "event_id desc limit 50",
)
def metrics_filter(spark, d):
    return metrics.points(_points(spark, d), "click", "2024-01-10 00:00:00", 50).select("metric_id", F.round("score", 6).alias("score"))


@query(
    "log_filter",
    "select event_id as log_id, level from (select *, ['debug', 'info', 'warn', 'error'][event_id % 4 + 1] as level from events) where level in ('warn', "
    "'error') and user_id = 3",
)
def log_filter(spark, d):
    logs = table(spark, d, "events").select(F.col("event_id").alias("log_id"), F.element_at(F.array(*map(F.lit, metrics.LEVELS)), (F.col("event_id") % 4 + 1).cast("int")).alias("level"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source"), F.col("ts").alias("timestamp"))
    return metrics.log_entries(logs, "warn", "u3").select("log_id", "level")


_RUNS = (
    "select user_id as run_id, count(*) as files, count(*) filter (event_type <> 'error') as indexed, count(*) * 3 as chunks, user_id % 7 as seconds from "
    "events group by user_id"
)


@query(
    "indexing_rates",
    f"select run_id, round(100.0 * indexed / files, 6) as success_percent, round(case when seconds > 0 then files / seconds else 0 end, 6) as "
    f"files_per_second, round(case when seconds > 0 then chunks / seconds else 0 end, 6) as chunks_per_second from ({_RUNS})",
)
def indexing_rates(spark, d):
    runs = table(spark, d, "events").groupBy(F.col("user_id").alias("run_id")).agg(F.count("*").alias("files"), F.count_if(F.col("event_type") != "error").alias("indexed"))
    runs = runs.withColumn("chunks", F.col("files") * 3).withColumn("seconds", F.col("run_id") % 7)
    return _six(metrics.indexing_rates(runs), "success_percent", "files_per_second", "chunks_per_second")


@query(
    "cache_stats",
    "select count(*) filter (user_id % 3 > 0) as hits, count(*) filter (user_id % 3 = 0) as misses, round(count(*) filter (user_id % 3 > 0) / count(*), 6) "
    "as hit_ratio from events",
)
def cache_stats(spark, d):
    e = table(spark, d, "events").select(F.when(F.col("user_id") % 3 == 0, "miss").otherwise("hit").alias("kind"))
    return _six(metrics.cache_stats(e), "hit_ratio")


@query(
    "rolling_history",
    "select user_id, event_id, count(*) over w as n, round(sum(value) over w, 2) as total from events window w as (partition by user_id order by ts, "
    "event_id rows between 99 preceding and current row)",
)
def rolling_history(spark, d):
    """The last hundred rounds of each user, as a mean's two parts."""
    out = metrics.rolling(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value", 100)
    return out.select("user_id", "event_id", "n", F.round("total", 2).alias("total"))


@query(
    "metric_rows",
    "select event_id as run_id, 'indexing' as type, unnest(['files', 'seconds']) as name, unnest([cast(user_id as double), round(value, 2)]) as value, "
    "unnest(['count', 's']) as unit from events",
)
def metric_rows(spark, d):
    runs = table(spark, d, "events").select(F.col("event_id").alias("run_id"), F.col("user_id").alias("files"), F.round("value", 2).alias("seconds"))
    return metrics.recorded(runs, "indexing", {"files": "count", "seconds": "s"}, "run_id")


@query(
    "enrichment_by_model",
    "select 'm' || (user_id % 4) as model, count(*) as processed, round(100.0 * avg(case when event_type <> 'error' then 1 else 0 end), 6) as "
    "success_percent, round(avg(value), 6) as avg_ms from events group by 1",
)
def enrichment_by_model(spark, d):
    runs = table(spark, d, "events").select(F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string")).alias("model"), (F.col("event_type") != "error").alias("success"), F.col("value").alias("ms"))
    return _six(metrics.enrichment(runs), "success_percent").withColumn("avg_ms", F.round("avg_ms", 6))


@query(
    "ab_report",
    "with a as (select user_id as q, avg(value) as p, count(*) as n from events where event_id % 2 = 0 group by 1), b as (select user_id as q, avg(value) "
    "as p, count(*) as n from events where event_id % 2 = 1 group by 1) select coalesce(a.q, b.q) as query_id, round(coalesce(a.p, 0), 6) as points_a, "
    "coalesce(a.n, 0) as results_a, round(coalesce(b.p, 0), 6) as points_b, coalesce(b.n, 0) as results_b, case when coalesce(a.p, 0) > coalesce(b.p, 0) "
    "then 'a' when coalesce(a.p, 0) < coalesce(b.p, 0) then 'b' else 'even' end as better from a full join b on a.q = b.q",
)
def ab_report(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), F.col("value").alias("points"))
    return metrics.compared(e.where("id % 2 = 0"), e.where("id % 2 = 1")).withColumns({c: F.round(c, 6) for c in ("points_a", "points_b")})


@query(
    "indexed_share",
    "with s as (select source as p, count(distinct doc_id) as scanned, count(distinct vec_id) as indexed from documents left join embeddings on doc_id = "
    "vec_id group by 1) select p as project_path, scanned, indexed, round(100.0 * indexed / scanned, 6) as percent from s",
)
def indexed_share(spark, d):
    from tarnforge.sources.files import indexed_share as share

    files = table(spark, d, "documents").select(F.col("source").alias("project_path"), F.col("doc_id").alias("path"))
    return _six(share(files, files.join(table(spark, d, "embeddings"), F.col("path") == F.col("vec_id"), "left_semi")), "percent")


_LINES = "select source as file, n_chars % 1500 as line from documents"


@query(
    "semantic_coherence",
    f"with c as (select *, row_number() over () as i from ({_LINES})), p as (select a.file, case when abs(a.line - b.line) < 50 then 1.0 when abs(a.line - "
    f"b.line) < 200 then 0.5 else 0.0 end as s from c a join c b on a.file = b.file and a.i < b.i) select file, round(100 * avg(cast(s as double)), 6) as "
    f"coherence from p group by 1",
)
def semantic_coherence(spark, d):
    c = table(spark, d, "documents").select(F.col("source").alias("file"), (F.col("n_chars") % 1500).alias("line"))
    return _six(analysis.coherence(c), "coherence")


@query(
    "chunk_quality",
    "select count(*) as chunks, round(100.0 * avg(case when doc_id % 3 = 0 then 1 else 0 end), 6) as atomic_rate, round(100.0 * avg(case when text like "
    "'%token%' then 1 else 0 end), 6) as documented_rate, round(100.0 * avg(case when doc_id % 4 > 0 then 1 else 0 end), 6) as related_rate from documents",
)
def chunk_quality(spark, d):
    c = table(spark, d, "documents").select(F.when(F.col("doc_id") % 3 == 0, "atomic").otherwise("group").alias("granularity"), F.when(F.contains("text", F.lit("token")), "yes").alias("documentation"), (F.col("doc_id") % 4).alias("relations"))
    return _six(analysis.quality(c), "atomic_rate", "documented_rate", "related_rate")


@query("compression_gate", "select octet_length(encode(text)) > 10240 as long, count(*) as chunks from documents group by 1")
def compression_gate(spark, d):
    from tarnforge.operators import compression

    kept = compression.compressed(table(spark, d, "documents").select("doc_id", F.col("text").alias("content")))
    return kept.groupBy(F.col("is_compressed").alias("long")).agg(F.count("*").alias("chunks"))


@query("distinct_contents", "select count(*) as chunks, count(distinct text) as contents, count(distinct source) as sources from documents")
def distinct_contents(spark, d):
    """What a content-keyed cache of embeddings would save."""
    from tarnforge.sources import providers

    return providers.cache_gain(table(spark, d, "documents").select(F.col("text").alias("content"), "source"))


@query(
    "recent_code",
    f"with {STORE} select id, strftime(updated_at, {_F}) as updated_at from store where content_type = 'code' and language = 'typescript' order by "
    f"store.updated_at desc, id limit 10",
)
def recent_code(spark, d):
    found = search.Filters(content_type="code", language="typescript").apply(store(spark, d, False))
    return _stamp(found.select("id", "updated_at").orderBy(F.desc("updated_at"), "id").limit(10), "updated_at")


@query(
    "docs_by_role",
    f"with {STORE} select role, count(*) as chunks, count(distinct file_path) as files from store where content_type = 'doc' group by 1",
)
def docs_by_role(spark, d):
    found = search.Filters(content_type="doc").apply(store(spark, d, False))
    return found.groupBy("role").agg(F.count("*").alias("chunks"), F.countDistinct("file_path").alias("files"))


_NAME = "regexp_replace(lower(regexp_extract(text, '^([^ \\t\\n]*)', 1)), '[^a-z]', '', 'g')"


@query(
    "unit_metrics",
    "with u as (select unnest(['import', 'class', 'method', 'function', 'block']) as kind, unnest([1, 2, 1, 2, 1]) as level, unnest([1, 3, 1, 3, 1]) as "
    "lines, unnest([0, 0, 0, 0, 0]) as documented from documents) select kind, count(*) as units, avg(case when kind in ('class', 'method', 'function') "
    "then level - (kind = 'class')::int else 1 end)::double as avg_complexity, avg(lines)::double as avg_lines, 100.0 * avg(documented)::double as "
    "documented_percent from u group by 1",
)
def unit_metrics(spark, d):
    """Semantic units of a source text made from each document's first word."""
    name = F.regexp_replace(F.lower(F.regexp_extract("text", r"^([^ \t\n]*)", 1)), r"[^a-z]", "")
    body = F.concat(F.lit("import x from 'y';\nclass A"), name, F.lit(" {\n  f(a) { return a; }\n}\nfunction g"), name, F.lit("(a) {\n  if (a) { return 1; }\n}\n"))
    rows = analysis.unit_rows(table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.lit("typescript").alias("language"), body.alias("content")))
    return analysis.unit_metrics(rows)


# Rows without a twin, and the stream ----------------------------------------------------------------


def _file_events(spark, d):
    return table(spark, d, "events").select("event_id", F.element_at(F.array(*map(F.lit, ("add", "change", "unlink"))), (F.col("event_id") % 3 + 1).cast("int")).alias("type"), F.concat(F.lit("src/u"), F.col("user_id").cast("string"), F.when(F.col("user_id") % 9 == 0, ".log").otherwise(".ts")).alias("path"), F.col("ts").alias("timestamp"))


@query(
    "file_event_last_wins",
    f"with e as (select event_id, ['add', 'change', 'unlink'][event_id % 3 + 1] as type, 'src/u' || user_id || '.ts' as path, ts from events where user_id "
    f"% 9 <> 0) select type, path, strftime(max(ts), {_F}) as timestamp, arg_max(event_id, row(ts, event_id)) as event_id from e group by 1, 2",
)
def file_event_last_wins(spark, d):
    from tarnforge.streaming import events

    return _stamp(events.last_wins(events.accepted(_file_events(spark, d))), "timestamp")


@query(
    "file_event_stream",
    f"with e as (select event_id, ['add', 'change', 'unlink'][event_id % 3 + 1] as type, 'src/u' || user_id || '.ts' as path, ts from events where user_id "
    f"% 9 <> 0) select type, path, strftime(max(ts), {_F}) as timestamp, arg_max(event_id, row(ts, event_id)) as event_id from e group by 1, 2",
)
def file_event_stream(spark, d):
    """The same by a stream over a folder of event files, each batch kept in a table of its own."""
    from tarnforge.plans.scratch import fresh
    from tarnforge.streaming import events

    src, out, mark = (fresh(spark, x) for x in ("events", "stream", "mark"))
    _file_events(spark, d).repartition(3).write.parquet(src)
    events.each_batch(events.accepted(events.read(spark, src)), events.to_table(out), mark).awaitTermination()
    return _stamp(events.last_wins(spark.read.parquet(out).drop("batch")), "timestamp")


@query("gzip_roundtrip", "select doc_id, sha256(text) as content_sha256, strlen(text) > 10240 as was_compressed from documents")
def gzip_roundtrip(spark, d):
    from tarnforge.operators import compression

    s = spread(table(spark, d, "documents")).select("doc_id", F.col("text").alias("content"))
    back = compression.decoded(compression.compressed(s))
    return back.select("doc_id", F.sha2("content", 256).alias("content_sha256"), F.col("is_compressed").alias("was_compressed"))


@query("intelligent_chunks")
def intelligent_chunks(spark, d):
    """Chunks by type of every document, with blank lines after every sentence line so that paragraphs occur."""
    s = spread(store(spark, d, False)).select("id", F.replace("content", F.lit(".\n"), F.lit(".\n\n")).alias("content"), "content_type")
    return chunking.chunked(s)


@query(
    "code_symbols",
    f"with n as (select doc_id, {_NAME} as name from documents) select cast(doc_id as varchar) as id, unnest(['class', 'method', 'function']) as kind, "
    f"unnest(['A' || name, 'f' || name, 'g' || name]) as name, unnest([2, 3, 7]) as first_line, unnest([4, 4, 8]) as last_line from n",
)
def code_symbols(spark, d):
    """Declarations in a source text made from each document: three of its first word, then the whole text as a comment."""
    s = table(spark, d, "documents")
    name = F.regexp_replace(F.lower(F.regexp_extract("text", r"^([^ \t\n]*)", 1)), r"[^a-z]", "")
    rest = F.concat(F.lit("# "), F.regexp_replace("text", r"\n", "\n# "))
    body = F.concat(F.lit("import os\nclass A"), name, F.lit(":\n    def f"), name, F.lit("(self):\n        return 1\n\n\ndef g"), name, F.lit("():\n    pass\n"), rest)
    return chunking.symbol_rows(s.select(F.col("doc_id").alias("id"), body.alias("content")))


@query(
    "rule_chunks",
    f"with n as (select doc_id, {_NAME} as name from documents) select cast(doc_id as varchar) as file, unnest(['import', 'class', 'method', 'function', "
    f"'type']) as kind, unnest(['import', 'A' || name, 'f', 'g' || name, 'T']) as name, unnest(['import', 'class', 'function', 'function', 'type']) as "
    f"rule, unnest([1, 2, 3, 6, 9]) as first_line, unnest([1, 4, 3, 8, 9]) as last_line, unnest([null, null, 'A' || name, null, null]) as parent, "
    f"unnest([1, 1, 1, 2, 1]) as complexity from n",
)
def rule_chunks(spark, d):
    """Chunks by the rules of a source text made from each document's first word."""
    name = F.regexp_replace(F.lower(F.regexp_extract("text", r"^([^ \t\n]*)", 1)), r"[^a-z]", "")
    body = F.concat(F.lit("import x from 'y';\nclass A"), name, F.lit(" {\n  f(a) { return a; }\n}\n// g\nexport function g"), name, F.lit("(a) {\n  if (a) { return '}'; }\n}\ntype T = string;\n"))
    rows = rules.chunk_rows(table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.lit("typescript").alias("language"), body.alias("content")))
    return rows.select("file", "kind", "name", "rule", "first_line", "last_line", "parent", "complexity")


@query(
    "symbol_metadata",
    f"with n as (select doc_id, {_NAME} as name from documents) select cast(doc_id as varchar) as id, 'm' || name as name, 'A' || name as owner, 'a,' || "
    f"name || 'x' as parameters, 'Promise<string>' as return_type, 'protected' as visibility, true as static, true as async from n",
)
def symbol_metadata(spark, d):
    """What methods say of themselves, in a source text made from each document's first word."""
    name = F.regexp_replace(F.lower(F.regexp_extract("text", r"^([^ \t\n]*)", 1)), r"[^a-z]", "")
    body = F.concat(F.lit("class A"), name, F.lit(" extends B {\n  protected static async m"), name, F.lit("(a: number, "), name, F.lit("x = {b: 1}): Promise<string> { return a; }\n}\n"))
    rows = chunking.symbol_metadata(table(spark, d, "documents").select(F.col("doc_id").alias("id"), body.alias("content")))
    m = F.col("metadata")
    return rows.where("kind = 'method'").select("id", "name", "owner", F.array_join(m["parameters"], ",").alias("parameters"), m["return_type"].alias("return_type"), m["visibility"].alias("visibility"), m["static"].alias("static"), m["async"].alias("async"))
