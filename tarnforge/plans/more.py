"""More registered queries: what the stream brings, the index, segmentation, and the second results of graph and tracking."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnforge.functions import score, sql
from tarnforge.operators import analysis, ann, graph, rules, search, segmentation, stats, table_functions, tracking, trigram
from tarnforge.operators import store as stores
from tarnforge.plans.catalogue import query
from tarnforge.plans.catalogue import SQL
from tarnforge.plans.queries import _F, _NAME, _file_events, _stamp, graph_tables
from tarnforge.plans.scratch import fresh
from tarnforge.plans.tables import GRAPH, HISTORY, INTERACTIONS, STORE, history, interactions, query_vector, store, table
from tarnforge.sources import files, models, providers
from tarnforge.streaming import events, indexing, settle

_SIM = "list_cosine_similarity(cast(v.embedding as double[]), cast(q.embedding as double[]))"


def _vectors(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return e, e.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")


@query(
    "index_search_exact",
    f"select q.vec_id as query_id, v.vec_id as id, round({_SIM}, 5) as sim from embeddings q, embeddings v where q.vec_id % 20 = 0 qualify row_number() "
    f"over (partition by q.vec_id order by {_SIM} desc, v.vec_id) <= 5",
)
def index_search_exact(spark, d):
    """Five nearest vectors of every twentieth one by the inverted file, then by the cells that could hold better ones."""
    e, asked = _vectors(spark, d)
    index = ann.build(e, fresh(spark, "index"), cells=16)
    return ann.search_exact(index, asked, fresh(spark, "first"), 5, probes=4).withColumn("sim", F.round("sim", 5))


@query("index_search")
def index_search(spark, d):
    """Ten nearest vectors by the inverted file alone; how many of the true ones are among them, tests measure."""
    e, asked = _vectors(spark, d)
    return ann.search(ann.build(e, fresh(spark, "index"), cells=16), asked, 10, probes=12).withColumn("sim", F.round("sim", 5))


@query("index_reopened", f"select q.vec_id as query_id, v.vec_id as id, round({_SIM}, 5) as sim from embeddings q, embeddings v where q.vec_id % 20 = 0 qualify row_number() over (partition by q.vec_id order by {_SIM} desc, v.vec_id) <= 3")
def index_reopened(spark, d):
    """Three nearest vectors by an index that was built from one half, left on disk, given the other half, and opened again."""
    e, asked = _vectors(spark, d)
    path = fresh(spark, "index")
    ann.added(ann.build(e.where("id % 2 = 0"), path, cells=16), e.where("id % 2 = 1"))
    return ann.search_exact(ann.opened(spark, path), asked, fresh(spark, "first"), 3, probes=4).withColumn("sim", F.round("sim", 5))


@query(
    "chunk_references_contained",
    "with c as (select doc_id as id, source as file, lower(text) as code, lower(regexp_extract(text, '[A-Za-z]{7,}')) as name from documents) select distinct a.id, b.id as refers_to "
    "from c a join c b on a.file = b.file and b.name <> '' and a.id <> b.id and contains(a.code, b.name)",
)
def chunk_references_contained(spark, d):
    """Documents of a source whose text has the name of another anywhere: its first long word."""
    c = table(spark, d, "documents").select(F.col("source").alias("file"), F.col("doc_id").alias("id"), F.regexp_extract("text", "[A-Za-z]{7,}", 0).alias("name"), F.col("text").alias("code"))
    return analysis.contained(c)


@query("view_refresh_by_changes", SQL["project_stats_mv"])
def view_refresh_by_changes(spark, d):
    """The projects' view after an upsert and a deletion, from the change log: a seventh of the rows is new, a fifth was other, and some go."""
    now = store(spark, d, vectors=False)
    other = {"language": F.lit("other"), "file_size_bytes": F.lit(1), "lines_count": F.col("lines_count") + 1, "is_compressed": F.lit(False)}
    known = now.where("doc_id % 7 > 0")
    before = known.select(*(F.when(F.col("doc_id") % 5 == 0, other[c]).otherwise(F.col(c)).cast(known.schema[c].dataType).alias(c) if c in other else F.col(c) for c in known.columns))
    gone = now.where("doc_id % 11 = 0").withColumn("id", F.concat("id", F.lit("-gone"))).withColumn("file_path", F.concat("file_path", F.lit("-gone")))
    state = stats.ProjectViewState(spark, fresh(spark, "view"))
    state.build(before.unionByName(gone))
    touched = now.where("doc_id % 7 = 0 or doc_id % 5 = 0")
    state.refresh(stats.signed(before.join(touched.select("id"), "id", "left_semi"), touched))
    state.refresh(gone.withColumn("sign", F.lit(-1)))
    out = state.view()
    return out.withColumns({c: F.round(c, 6) for c in ("avg_lines", "avg_compression")})


@query("sql_word_chunks", SQL["word_chunks"])
def sql_word_chunks(spark, d):
    """Word chunks by a table function, called from SQL with a table."""
    table_functions.register(spark)
    table(spark, d, "documents").createOrReplaceTempView("tf_documents")
    return spark.sql(
        "select id as doc_id, cast(total_chunks as bigint) as total_chunks, cast(chunk_index as bigint) as chunk_index, md5(chunk) as chunk "
        "from tf_word_chunks(table(select doc_id as id, text as content from tf_documents), 100, 20)"
    )


@query(
    "sql_symbols",
    f"with n as (select doc_id, {_NAME} as name, doc_id % 3 + 1 as m from documents), b as (select *, case when doc_id % 2 = 0 then 2 else 6 end as c, "
    "case when doc_id % 2 = 0 then 5 + 2 * m else 2 end as g from n) select doc_id as id, 'class' as kind, 'A' || name as name, c as first_line, c + 2 * m as last_line "
    "from b union all select doc_id, 'function', 'g' || name, g, g + 1 from b union all select doc_id, 'method', 'f' || k, c + 1 + 2 * k, c + 2 + 2 * k from "
    "(select *, unnest(range(m)) as k from b)",
)
def sql_symbols(spark, d):
    """Declarations by a table function, in sources that differ by document: one to three methods, the class before or after the function."""
    table_functions.register(spark)
    _varied_sources(spark, d).createOrReplaceTempView("tf_sources")
    return spark.sql(
        "select id, kind, name, cast(first_line as bigint) as first_line, cast(last_line as bigint) as last_line from tf_symbols(table(select id, content from tf_sources))"
    )


def _varied_sources(spark, d):
    """``id, content``: a Python source of each document, with one to three methods, its class before or after a function, and its text as a comment."""
    table(spark, d, "documents").createOrReplaceTempView("tf_documents")
    return spark.sql(
        r"""with n as (select doc_id, text, regexp_replace(lower(regexp_extract(text, '^([^ \\t\\n]*)', 1)), '[^a-z]', '') as name from tf_documents), parts as (
          select *, concat('def g', name, '():\n    pass\n\n\n') as f, concat('class A', name, ':\n', array_join(transform(sequence(0, cast(doc_id % 3 as int)),
            k -> concat('    def f', k, '(self):\n        return ', k)), '\n'), '\n\n\n') as c from n
        ) select doc_id as id, concat('import os\n', if(doc_id % 2 = 0, concat(c, f), concat(f, c)), '# ', replace(text, '\n', '\n# ')) as content from parts"""
    )


@query(
    "chunk_granularity",
    "with d as (select doc_id % 3 + 1 as m from documents), k as (select 'import' as kind, 1 as chunks, 1 as lines from d union all select 'class', 1, 2 * m + 1 from d "
    "union all select 'function', 1, 2 from d union all select 'method', m, 2 from d) select kind, case kind when 'import' then 'logical' else 'atomic' end as granularity, sum(chunks)::bigint as chunks, "
    "round(sum(chunks * lines)::double / sum(chunks), 6) as avg_lines from k group by kind",
)
def chunk_granularity(spark, d):
    """Declarations' chunks by kind and granularity, of the sources that differ by document."""
    docs = _varied_sources(spark, d).select(F.col("id").alias("path"), F.lit("python").alias("language"), "content")
    found = analysis.granularity_stats(rules.chunk_rows(docs).where("kind <> 'comment'"))
    return found.select("kind", "granularity", "chunks", F.round("avg_lines", 6).alias("avg_lines"))


@query("sql_search", SQL["semantic_threshold"])
def sql_search(spark, d):
    """Search by threshold as a table function."""
    sql.register_search(spark, store(spark, d))
    return spark.sql("select id, round(similarity, 6) as sim from tf_search(:query, 0.2D)", args={"query": F.array(*(F.lit(float(x)) for x in query_vector(spark, d)))})


@query("sql_history", SQL["history_versions"])
def sql_history(spark, d):
    """Each chunk's newest three versions: the table function, called for every chunk by a lateral join."""
    versions = stores.replayed_versions(history(spark, d))
    sql.register_history(spark, versions)
    return spark.sql(
        "select c.chunk_id, cast(h.version as bigint) as version, h.change_type from (select distinct chunk_id from tf_history) c, lateral tf_chunk_history(c.chunk_id, 3) h"
    )


@query(
    "sql_compare",
    f"select * from ({SQL['compare_versions']}) where field <> 'changed_at'",
)
def sql_compare(spark, d):
    """Each chunk's first two versions, field by field, by a lateral call."""
    sql.register_history(spark, stores.replayed_versions(history(spark, d)))
    return spark.sql("select c.chunk_id, r.* from (select distinct chunk_id from tf_history) c, lateral tf_compare_versions(c.chunk_id, 1, 2) r")


@query(
    "sql_more_functions",
    "with p as (select doc_id, source, text, 'src/f' || doc_id || '.ts#chunk2' as path from documents) select doc_id, 'src/f' || doc_id || '.ts' as clean, 'ts' as extension, "
    "case when length(text) = 0 then 100.0 else round(100.0 * (length(source) - length(text)) / length(text), 6) end as change_percent, "
    "length(source) - length(text) as length_change, 5.0::double as dot, 5.0::double as norm, 0.6::double as cosine from p",
)
def sql_more_functions(spark, d):
    """The functions that ``sql_functions`` does not call."""
    sql.register(spark)
    table(spark, d, "documents").selectExpr("*", "'src/f' || doc_id || '.ts#chunk2' as path").createOrReplaceTempView("tf_paths")
    return spark.sql(
        "select doc_id, tf_clean_path(path) as clean, tf_extension(path) as extension, round(tf_change_percent(text, source), 6) as change_percent, "
        "tf_content_diff(text, source).length_change as length_change, tf_dot(array(1D, 2D), array(1D, 2D)) as dot, tf_norm(array(3D, 4D)) as norm, "
        "round(tf_cosine(array(3D, 4D), array(5D, 0D)), 6) as cosine from tf_paths"
    )


def _text_index_query(name, words, scan, **options):
    """The text query ``scan`` by the trigram index, of one half of the rows and then the other, opened again."""

    @query(name, SQL[scan])
    def run(spark, d):
        rows, path = store(spark, d, vectors=False), fresh(spark, "text")
        first = trigram.build(rows.where("doc_id % 2 = 0"), path, part_rows=500)
        trigram.added(first, rows.where("doc_id % 2 = 1"), part_rows=500)
        return trigram.matching(trigram.opened(spark, path), spark, words, **options).select("id")


_text_index_query("text_index_and", "the And", "text_and", in_paths=False)
_text_index_query("text_index_or", "token ÉA", "text_or", operator="or", in_paths=False)
_text_index_query("text_index_prefix", "The", "text_prefix", prefix=True, in_paths=False)
_text_index_query("text_index_suffix", "the.", "text_suffix", suffix=True, in_paths=False)
_text_index_query("text_index_literal", "%%% _", "text_literal_marks", in_paths=False)
_text_index_query("text_index_paths", "f1", "text_in_paths")


@query("versions_by_total", f"with {HISTORY} select version, count(*) as total from versions group by 1 order by total desc, version limit 50")
def versions_by_total(spark, d):
    return stats.versions_by_total(stores.replayed_versions(history(spark, d))).withColumn("version", F.col("version").cast("long"))


@query(
    "missing_files",
    "with s as (select source as p, count(distinct doc_id) as scanned, count(distinct case when doc_id % 3 > 0 then doc_id end) as indexed from documents "
    "group by 1) select p as project_path, scanned - indexed as missing, round(100.0 * indexed / scanned, 6) as percent from s where scanned > indexed "
    "order by missing desc, p limit 10",
)
def missing_files(spark, d):
    all_files = table(spark, d, "documents").select(F.col("source").alias("project_path"), F.col("doc_id").alias("path"))
    return files.missing(all_files, all_files.where("path % 3 > 0")).withColumn("percent", F.round("percent", 6))


@query("legacy_search", f"with {STORE} select id, content_type, file_extension from store where content_type = 'code'")
def legacy_search(spark, d):
    """A filter over a store of the older schema, once it is brought into the current one."""
    s = store(spark, d, False)
    old = s.select("id", "project_path", "file_path", "content")
    schema = "id string, project_path string, file_path string, content string, content_type string, role string, file_extension string, chunk_index int, total_chunks int"
    return search.Filters(content_type="code").apply(stores.as_current(old, schema)).select("id", "content_type", "file_extension")


@query("embedding_cache_keys", "select 'text:64:' || sha256(text) as key, count(*) as chunks from documents group by 1")
def embedding_cache_keys(spark, d):
    t = table(spark, d, "documents")
    return t.groupBy(providers.cache_key(F.col("text"), "text", 64).alias("key")).agg(F.count("*").alias("chunks"))


@query(
    "offline_keywords",
    "with w as (select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]{4,}')) as word from documents), n as (select doc_id, word, count(*) "
    "as n from w group by 1, 2 qualify row_number() over (partition by doc_id order by n desc, word) <= 5) select d.doc_id, coalesce(k.keywords, '') as "
    "keywords from documents d left join (select doc_id, string_agg(word, ' ' order by n desc, word) as keywords from n group by 1) k using (doc_id)",
)
def offline_keywords(spark, d):
    out = providers.enriched(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")))
    return out.select(F.col("id").alias("doc_id"), F.array_join("keywords", " ").alias("keywords"))


@query(
    "segmentation_density",
    "with l as (select doc_id, string_split(text, chr(10)) as lines from documents), s as (select doc_id, least(1.0, len(list_filter(lines, lambda x: "
    "regexp_matches(x, '\\S'))) / len(lines) * list_sum(list_transform(lines, lambda x: length(x))) / len(lines) / 100.0) as c from l) select cast(doc_id "
    "as varchar) as id, round(c, 6) as complexity, case when c > 0.4 then 700 else 1200 end as chunk_size, 'semantic' as strategy from s",
)
def segmentation_density(spark, d):
    found = segmentation.segmented(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.lit("other").alias("content_type")))
    return found.select("id", F.round("complexity", 6).alias("complexity"), "chunk_size", "strategy")


@query(
    "enrichment_checks",
    "select doc_id % 2 = 0 and trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '' as answered, count(*) as chunks from documents "
    "group by 1",
)
def enrichment_checks(spark, d):
    """Chunks that a stand-in model answers; it fails for every second one."""
    service = models.Service(_stand_in, batch=4)
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("text").alias("kind"), F.when(F.trim(F.regexp_replace("text", r"[\x09-\x0d ]+", " ")) == "", "").otherwise(F.concat((F.col("doc_id") % 2).cast("string"), F.lit(" "), F.left("text", F.lit(100)))).alias("content"))
    found = models.enriched(rows, models.Enricher.of(enabled=True, features=["summary"]), service)
    return found.groupBy((F.size("problems") == 0).alias("answered")).agg(F.count("*").alias("chunks"))


def _stand_in(prompts: list[str]) -> list[str]:
    return ['{"summary": "s"}' if p.partition(":\n")[2].startswith("0") else "no" for p in prompts]


# Graph and tracking: what the other queries leave out -------------------------------------------------


@query(
    "graph_search_entities",
    f"with {GRAPH} select name, etype as \"entityType\", array_to_string(obs, ';') as observations from ent where contains(lower(name), 'region') or "
    f"contains(lower(etype), 'region') or len(list_filter(obs, lambda x: contains(lower(x), 'region'))) > 0",
)
def graph_search_entities(spark, d):
    return graph.search(*graph_tables(spark, d), "Region")[0].withColumn("observations", F.array_join("observations", ";"))


@query(
    "graph_delete_entities",
    f"with {GRAPH} select name, etype as \"entityType\", array_to_string(obs, ';') as observations from ent where name not in (select n_name from nation "
    f"where n_regionkey = 1)",
)
def graph_delete_entities(spark, d):
    gone = table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_name").alias("name"))
    return graph.delete_entities(*graph_tables(spark, d), gone)[0].withColumn("observations", F.array_join("observations", ";"))


@query(
    "graph_open_relations",
    f"with {GRAPH}, own as (select name from ent where name in (select r_name from region) or name in (select n_name from nation where n_regionkey = 2)) "
    f"select f as \"from\", t as \"to\", k as \"relationType\" from rel where f in (select name from own) and t in (select name from own)",
)
def graph_open_relations(spark, d):
    names = table(spark, d, "region").select(F.col("r_name").alias("name"))
    return graph.open_nodes(*graph_tables(spark, d), names.unionByName(table(spark, d, "nation").where("n_regionkey = 2").select(F.col("n_name").alias("name"))))[1]


@query("recorded_interactions", f"with {INTERACTIONS} select interaction_id, project_id from inter")
def recorded_interactions(spark, d):
    p = spark.range(30).select(F.col("id").alias("project_id"), F.lit("2024-01-10 00:00:00").cast("timestamp").alias("last_accessed"))
    i = interactions(spark, d)
    return tracking.recorded(p, i.where("interaction_id % 2 = 0"), i.where("interaction_id % 2 = 1"))[1].select("interaction_id", "project_id")


# Stream -----------------------------------------------------------------------------------------------


@query(
    "event_counters",
    "select count(*) as received, count(*) filter (user_id % 9 = 0) as ignored, count(*) filter (user_id % 9 <> 0 and event_id % 3 = 0) as \"add\", "
    "count(*) filter (user_id % 9 <> 0 and event_id % 3 = 1) as change, count(*) filter (user_id % 9 <> 0 and event_id % 3 = 2) as unlink from events",
)
def event_counters(spark, d):
    """What a stream over the events received and left out, from its own counters."""
    src, mark = fresh(spark, "events"), fresh(spark, "mark")
    _file_events(spark, d).repartition(3).write.parquet(src)
    w = indexing.Watcher(spark, src, mark)
    w.start()
    w.wait()
    names = ["received", "ignored", "add", "change", "unlink"]
    found = w.counts()
    return spark.createDataFrame([tuple(int(found.get(n, 0)) for n in names)], ", ".join(f"`{n}` long" for n in names))


#: Kinds of content by event type, and their parameters in the order of the twin's columns.
_LEARNING = {"click": "code", "signup": "doc", "view": "config", "error": "other", "purchase": "other"}
_LEARNERS = ", ".join(
    f"('{event}', {p.multiplier}::double, {p.low}::double, {p.high}::double, {p.default}::double, {p.min_samples}, {p.rate}::double)"
    for event, p in ((e, score.THRESHOLDS[k]) for e, k in _LEARNING.items())
)


@query(
    "learnt_thresholds",
    f"""with recursive rounds as (
  select event_type as kind, (epoch_us(ts) // 21600000000) as round, count(*) as n, avg(value / (value + 50)) as mean, stddev_pop(value / (value + 50)) as std,
    row_number() over (partition by event_type order by epoch_us(ts) // 21600000000) as k from events group by 1, 2
), params(kind, m, low, high, unset, least_n, rate) as (values {_LEARNERS}), fold as (
  select kind, 0::bigint as k, 0::bigint as round, 0::bigint as samples, m as multiplier, []::double[] as means, []::double[] as stds, []::double[] as past, 0.0::double as threshold from params
  union all
  select kind, k, round, samples, case when samples >= 20 and len(means) >= 10 and list_avg(means) <> 0 and list_avg(stds) <> 0 and threshold <> 0
      and abs(mean - list_avg(means)) / list_avg(means) < 0.2 and abs(std - list_avg(stds)) / list_avg(stds) < 0.3
    then least(greatest(multiplier * (1 + (list_avg(past) / threshold - 1) * rate), 0.2), 1.5) else multiplier end, means, stds, past, threshold
  from (
    select *, list_append(past_before, threshold)[-100:] as past from (
      select f.kind, r.k, r.round, f.samples + r.n as samples, f.multiplier, list_append(f.means, r.mean)[-100:] as means, list_append(f.stds, r.std)[-100:] as stds, f.past as past_before,
        r.mean, r.std, p.rate, case when r.n < greatest(1, p.least_n) then p.unset else least(greatest(r.mean + f.multiplier * r.std, p.low), p.high) end as threshold
      from fold f join rounds r on r.kind = f.kind and r.k = f.k + 1 join params p on p.kind = f.kind
    )
  )
) select kind, round, round(threshold, 6) as threshold, round(multiplier, 6) as multiplier from fold where k > 0""",
)
def learnt_thresholds(spark, d):
    """Thresholds that a stream learns round by round for each kind, in two runs with one checkpoint."""
    src, out, mark = (fresh(spark, x) for x in ("rounds", "learnt", "mark"))
    x = F.col("value") / (F.col("value") + 50)
    of = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 21_600_000_000).cast("long")
    found = table(spark, d, "events").groupBy(F.col("event_type").alias("kind"), of.alias("round")).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"))
    middle = found.agg(F.percentile_approx("round", 0.5)).first()[0] or 0
    params = {event: score.THRESHOLDS[kind] for event, kind in _LEARNING.items()} | {"other": score.THRESHOLDS["other"]}
    for part in (F.col("round") <= middle, F.col("round") > middle):
        found.where(part).coalesce(1).write.mode("append").parquet(src)
        stream = settle.learnt(spark.readStream.schema(settle.ROUNDS).parquet(src), params)
        stream.writeStream.option("checkpointLocation", mark).format("parquet").option("path", out).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(settle.LEARNT).parquet(out).withColumns({c: F.round(c, 6) for c in ("threshold", "multiplier")})


@query(
    "event_ring",
    f"select event_id, ['add', 'change', 'unlink'][event_id % 3 + 1] as type, strftime(ts, {_F}) as timestamp from events where user_id % 9 <> 0 order by "
    f"ts desc, event_id desc limit 200",
)
def event_ring(spark, d):
    """The last 200 events that a handler kept, batch by batch."""
    src, mark, kept = fresh(spark, "events"), fresh(spark, "mark"), fresh(spark, "ring")
    _file_events(spark, d).repartition(3).write.parquet(src)
    w = indexing.Watcher(spark, src, mark)
    w.handlers.add("ring", indexing.to_ring(kept, 200))
    stream = indexing.counted(events.read(spark, src, files_per_trigger=1))
    # Every event, not the last of each path: the ring is a log.
    stream.writeStream.option("checkpointLocation", mark).foreachBatch(w.handlers).trigger(availableNow=True).start().awaitTermination()
    return _stamp(indexing.ring(spark, kept).select("event_id", "type", "timestamp"), "timestamp")


@query(
    "chunk_events",
    f"with n as (select doc_id, cast(doc_id as varchar) as path, {_NAME} as name from documents) select path, path || ':function:g' || name || "
    f"':1:function' as id, 'added' as event from n where doc_id % 3 = 0 and doc_id % 4 > 1 union all select path, path || ':function:g' || name || "
    f"':1:function', 'changed' from n where doc_id % 3 < 2 and doc_id % 4 = 1 union all select path, path || ':function:g' || name || ':1:function', "
    f"'removed' from n where doc_id % 3 = 2 and doc_id % 4 < 2 union all select path, path || ':function:g' || name || ':1:function', 'added' from n where "
    f"doc_id % 3 = 1 and doc_id % 4 > 1",
)
def chunk_events(spark, d):
    """Chunk events of a batch that adds, changes and removes a small file for each document; some had their chunk before."""
    i = F.col("doc_id")
    name = F.regexp_replace(F.lower(F.regexp_extract("text", r"^([^ \t\n]*)", 1)), r"[^a-z]", "")
    path = i.cast("string")
    docs = table(spark, d, "documents")
    batch = docs.select(i.alias("event_id"), F.element_at(F.array(*map(F.lit, ("add", "change", "unlink"))), (i % 3 + 1).cast("int")).alias("type"), path.alias("path"), F.timestamp_seconds(i).alias("timestamp"))
    source = lambda body: F.concat(F.lit("function g"), name, F.lit(f"(a) {{ {body} }}"))
    now = docs.select(path.alias("path"), F.lit("typescript").alias("language"), source("return a;").alias("content"))
    old = docs.where(i % 4 < 2).select(path.alias("path"), F.lit("typescript").alias("language"), F.when(i % 4 == 1, source("return 0;")).otherwise(source("return a;")).alias("content"))
    return indexing.chunk_events(batch, now, rules.chunk_rows(old).select("file", "id", "code"))
