"""Registered queries over what is written and read back: files, graph files, metric files, buckets, views, caches; and rules on chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnforge.functions import sql, text, vector
from tarnforge.operators import analysis, chunking, metrics, rules, stats
from tarnforge.operators import store as stores
from tarnforge.plans.catalogue import query
from tarnforge.plans.queries import _BOTH, _COMPRESSION, _F, _NAME, _edited, _sql_hash, _stamp, graph_tables
from tarnforge.plans.scratch import fresh
from tarnforge.plans.tables import GRAPH, STORE, store, table
from tarnforge.sources import files, providers, storage
from tarnforge.streaming import indexing


@query(
    "file_scan",
    "select 'k=' || n_nationkey as folder, length('n ' || n_name || chr(10)) as size, sha256('n ' || n_name || chr(10)) as content_sha256 "
    "from nation where length('n ' || n_name) >= 9",
)
def file_scan(spark, d):
    """Files written for each nation, scanned: too short ones are left out."""
    path = fresh(spark, "files")
    rows = table(spark, d, "nation").select(F.concat(F.lit("n "), F.col("n_name")).alias("value"), F.col("n_nationkey").alias("k"))
    rows.write.partitionBy("k").text(path)
    found = files.scan(spark, path, "*.txt")
    return found.select(F.substring_index("relative_path", "/", 1).alias("folder"), "size", F.sha2("content", 256).alias("content_sha256"))


_PATHS = ("src/a.ts", "node_modules/x/b.js", "logs/run.log", "logs/keep.log", "docs/tmp/x.md", "docs/tmp.md", "a/b/secret.key", "a/b/public.key")


@query("ignore_rules", "select doc_id, doc_id % 8 in (1, 2, 4, 6) as ignored from documents")
def ignore_rules(spark, d):
    """Built-in rules and a project's, of which the last that matches decides."""
    path = F.element_at(F.array(*map(F.lit, _PATHS)), (F.col("doc_id") % 8 + 1).cast("int"))
    own = ["# remarks", "!logs/keep.log", "tmp/", "*.key", "!public.key"]
    return table(spark, d, "documents").select("doc_id", files.ignored(path, own).alias("ignored"))


@query(
    "graph_file",
    f"with {GRAPH} select 'entity' as type, name as a, etype as b, array_to_string(obs, ';') as c from ent union all select 'relation', f, t, k from rel",
)
def graph_file(spark, d):
    """A graph written as lines of JSON and read back."""
    path = fresh(spark, "graph")
    files.write_graph(*graph_tables(spark, d), path)
    e, r = files.read_graph(spark, path)
    rows = e.select(F.lit("entity").alias("type"), F.col("name").alias("a"), F.col("entityType").alias("b"), F.array_join("observations", ";").alias("c"))
    return rows.unionByName(r.select(F.lit("relation").alias("type"), F.col("from").alias("a"), F.col("to").alias("b"), F.col("relationType").alias("c")))


_H = f"abs({_sql_hash('n_name', 0, 31)})"
_WAVE = "0.3 * sin(0.01 * h + 0.017 * i) + 0.2 * cos(0.007 * h + 0.023 * i)"


@query(
    "standin_embedding",
    f"with h as (select n_name, cast({_H} as double) as h from nation), w as (select n_name, i, {_WAVE} as w from h, range(8) r(i)), "
    "n as (select n_name, sqrt(sum(w * w)) as size from w group by 1) select n_name, i, round(w / size, 6) as value from w join n using (n_name)",
)
def standin_embedding(spark, d):
    e = table(spark, d, "nation").select("n_name", vector.wave_embedding(F.col("n_name"), 8).alias("v"))
    return e.select("n_name", F.posexplode("v").alias("i", "value")).select("n_name", F.col("i").cast("long").alias("i"), F.round("value", 6).alias("value"))


@query("code_complexity", "select doc_id, round(least(1.0, 10.0 * (doc_id % 7 + doc_id % 3) / n_chars), 6) as level from documents")
def code_complexity(spark, d):
    i = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", F.round(text.code_complexity(i % 7, i % 3, F.col("n_chars")), 6).alias("level"))


@query(
    "chunk_problems",
    "with c as (select doc_id, case when doc_id % 11 = 0 then 'odd' else 'class' end as type, case when doc_id % 13 = 0 then ' ' || chr(10) else text end as code, "
    "doc_id % 5 as first, doc_id % 7 as last, doc_id % 120 as quality from documents), p as (select doc_id, list_filter([case when type = 'odd' then 'unknown type' end, "
    "case when not regexp_matches(code, '[^ \\t\\n\\x0b\\f\\r]') then 'code is empty' end, case when not (first >= 1 and first <= last) then 'lines are out of order' "
    "end, case when quality > 100 then 'quality is out of range' end], lambda x: x is not null) as p from c) "
    "select cast(doc_id as varchar) as id, array_to_string(p, ';') as problems from p where len(p) > 0",
)
def chunk_problems(spark, d):
    i = F.col("doc_id")
    c = table(spark, d, "documents").select(
        i.cast("string").alias("id"),
        F.when(i % 11 == 0, "odd").otherwise("class").alias("type"),
        F.when(i % 13 == 0, " \n").otherwise(F.col("text")).alias("code"),
        F.lit("python").alias("language"),
        F.lit("f").alias("file"),
        (i % 5).alias("first"),
        (i % 7).alias("last"),
        (i % 120).alias("quality"),
        F.lit(50).alias("relevance"),
        F.lit(1).alias("tokens"),
    )
    return analysis.problem_rows(c).withColumn("problems", F.array_join("problems", ";"))


@query(
    "bucket_upsert",
    f"with {STORE}, {_BOTH} select coalesce(o.id, n.id) as id, sha256(coalesce(n.content, o.content)) as content_sha256, coalesce(o.version, n.version) as "
    f"version, strftime(coalesce(n.updated_at, o.updated_at), {_F}) as updated_at from old o full join new n on o.id = n.id",
)
def bucket_upsert(spark, d):
    """An upsert into a store of buckets, read back by its manifest."""
    old, new = _edited(spark, d)
    kept = stores.BucketStore(spark, fresh(spark, "buckets"))
    kept.write(old, 16)
    kept.upsert(new)
    return _stamp(kept.read(), "updated_at").select("id", F.sha2("content", 256).alias("content_sha256"), "version", "updated_at")


@query(
    "view_refresh",
    f"with {STORE} select project_path, count(*) as chunks, round(avg(case when is_compressed then {_COMPRESSION} end), 6) as avg_compression from store group by 1",
)
def view_refresh(spark, d):
    """A view that is written, refreshed and read."""
    path, s = fresh(spark, "views"), store(spark, d, False)
    stats.materialised(stats.project_view(s.limit(10)), path, "projects")
    out = stats.materialised(stats.project_view(s), path, "projects")
    return out.select("project_path", "chunks", F.round("avg_compression", 6).alias("avg_compression"))


@query("metric_files", "select event_id, event_type, round(value, 4) as value, props from events union all select event_id, event_type, round(value, 4), props from events")
def metric_files(spark, d):
    """Points written as CSV and as JSON, both read back."""
    points = table(spark, d, "events").select("event_id", "event_type", F.round("value", 4).alias("value"), "props")
    csv, lines = fresh(spark, "csv"), fresh(spark, "json")
    metrics.as_csv(points, csv)
    metrics.as_json(points, lines)
    read = spark.read.schema(points.schema)
    return read.option("header", True).option("escape", '"').csv(csv).unionByName(read.json(lines))


_TS = ";\nimport q from 'q';\nexport class A", " {\n  run() { return 1; }\n  private hide() { return 2; }\n}\n"


def _class_source():
    name = F.regexp_replace(F.lower(F.regexp_extract("text", r"^([^ \t\n]*)", 1)), r"[^a-z]", "")
    return F.concat(F.lit("import x from 'm"), name, F.lit("'"), F.lit(_TS[0]), name, F.lit(_TS[1]))


_IDS = f"with n as (select cast(doc_id as varchar) as path, {_NAME} as name from documents)"


@query(
    "dependency_edges",
    f"{_IDS} select path || ':import:import:1' as source, unnest(['m' || name, 'q']) as target, 'depends_on' as type from n union all "
    "select path || ':method:' || unnest(['run:4', 'hide:5']), path || ':class:A' || name || ':3', 'child_of' from n",
)
def dependency_edges(spark, d):
    """Edges of a source text made from each document's first word."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.lit("typescript").alias("language"), _class_source().alias("content"))
    return analysis.dependency_graph(analysis.unit_rows(docs))[1]


@query(
    "semantic_tags",
    f"{_IDS} select path, unnest(['import', 'class', 'method', 'method']) as kind, unnest([1, 3, 4, 5]) as first_line, unnest(["
    "'type:import,language:typescript,complexity:low', 'type:class,language:typescript,complexity:low', 'type:method,language:typescript,complexity:low', "
    "'type:method,language:typescript,visibility:private,complexity:low']) as tags from n",
)
def semantic_tags(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.lit("typescript").alias("language"), _class_source().alias("content"))
    return analysis.unit_rows(docs).select(F.col("file").alias("path"), "kind", "first_line", F.array_join("tags", ",").alias("tags"))


@query(
    "class_groups",
    f"{_IDS} select path as file, unnest(['import', 'import', 'class_hierarchy', 'class_hierarchy', 'class_hierarchy']) as rule, unnest([1, 2, 3, 3, 3]) as first_line, "
    "unnest(['import x from ''m' || name || ''';', 'import q from ''q'';', 'export class A' || name || ' {' || chr(10) || '}', '  run() { return 1; }', "
    "'  private hide() { return 2; }']) as code from n",
)
def class_groups(spark, d):
    """A class that is too long as its definition and its methods by visibility."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.lit("typescript").alias("language"), _class_source().alias("content"))
    return rules.chunk_rows(docs, rules.Options(max_tokens=5)).select("file", "rule", "first_line", "code")


@query("symbol_counts", "select unnest(['class', 'method']) as kind, unnest([count(*), 2 * count(*)]) as symbols from documents")
def symbol_counts(spark, d):
    found = chunking.symbol_rows(table(spark, d, "documents").select(F.col("doc_id").alias("id"), _class_source().alias("content")))
    return found.groupBy("kind").agg(F.count("*").alias("symbols"))


@query(
    "sql_functions",
    "select doc_id, length(text) - length(replace(text, chr(10), '')) + 1 as lines, cast(ceil(length(text) / 4.0) as bigint) as tokens, "
    "case when contains(lower(text), 'and') then 0.9 when regexp_matches(lower(text), 'project|code|file') then 0.7 else 0.5 end as relevance, "
    "abs(case when length(text) = 0 then 100.0 else 100.0 * (length(source) - length(text)) / length(text) end) >= 50 as significant from documents",
)
def sql_functions(spark, d):
    """The functions that queries written as text use."""
    sql.register(spark)
    table(spark, d, "documents").createOrReplaceTempView("tf_documents")
    return spark.sql(
        "select doc_id, cast(tf_lines(text) as bigint) as lines, tf_tokens(text) as tokens, tf_message_relevance(text, 'And') as relevance, "
        "tf_significant(text, source, 50D) as significant from tf_documents"
    )


@query("cache_sweep", "select event_id as cache_key from events where ts + to_hours(24) >= timestamp '2024-01-15'")
def cache_sweep(spark, d):
    """What a sweep leaves of a cache's table."""
    path = fresh(spark, "cache")
    c = table(spark, d, "events").select(F.col("event_id").alias("cache_key"), (F.col("ts") + F.expr("interval 24 hours")).alias("expires_at"))
    tables = storage.Versioned(spark, path)
    tables.commit(cache=c)
    indexing.swept(spark, path, "2024-01-15 00:00:00")
    return spark.read.parquet(tables.path("cache")).select("cache_key")


_FLAT = "trim(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))"
_YAML = f"'id: ' || doc_id || chr(10) || '---' || chr(10) || 'text: ' || {_FLAT} || chr(10) || '---' || chr(10) || 'end: 1'"


@query(
    "config_documents",
    f"with c as (select cast(doc_id as varchar) as id, {_YAML} as content, {_FLAT} as flat from documents) select id, 0 as chunk_index, 1 as total_chunks, md5(content) as "
    "chunk from c where length(content) <= 80 union all select id, unnest([0, 1, 2]), 3, md5(unnest(['id: ' || id, 'text: ' || flat, 'end: 1'])) from c "
    "where length(content) > 80",
)
def config_documents(spark, d):
    """Chunks of a configuration of three documents, made from each text."""
    flat = F.trim(F.regexp_replace("text", r"[ \t\n\x0b\f\r]+", " "))
    body = F.concat(F.lit("id: "), F.col("doc_id").cast("string"), F.lit("\n---\ntext: "), flat, F.lit("\n---\nend: 1"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), body.alias("content"), F.lit("config").alias("content_type"))
    return chunking.chunked(docs, 10, 0).withColumn("chunk", F.md5("chunk"))


@query(
    "code_chunks",
    f"{_IDS} select path as id, i as chunk_index, 8 as total_chunks, 'function f' || i || name || '() {{' || chr(10) || '  return ' || i || ';' || chr(10) || '}}' as chunk "
    "from n, range(8) r(i)",
)
def code_chunks(spark, d):
    """A source of eight functions, made from each document's first word, a chunk each."""
    name = F.regexp_replace(F.lower(F.regexp_extract("text", r"^([^ \t\n]*)", 1)), r"[^a-z]", "")
    parts = [F.concat(F.lit(f"function f{i}"), name, F.lit(f"() {{\n  return {i};\n}}\n\n")) for i in range(8)]
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(*parts).alias("content"), F.lit("code").alias("content_type"))
    return chunking.chunked(docs, 40, 0)


@query(
    "doc_sections",
    "with l as (select cast(doc_id as varchar) as id, '# ' || lpad(cast(doc_id as varchar), 8, '0') as head from documents) select id, i as chunk_index, 9 as total_chunks, "
    "head || '.' || i || chr(10) || 'the body of part ' || i || case when i = 8 then chr(10) else '' end as chunk from l, range(9) r(i)",
)
def doc_sections(spark, d):
    """A text of nine sections, made for each document, a chunk each."""
    head = F.concat(F.lit("# "), F.lpad(F.col("doc_id").cast("string"), 8, "0"))
    parts = [F.concat(head, F.lit(f".{i}\nthe body of part {i}\n")) for i in range(9)]
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(*parts).alias("content"), F.lit("doc").alias("content_type"))
    return chunking.chunked(docs, 60, 0)


@query(
    "packed_paragraphs",
    "with l as (select cast(doc_id as varchar) as id, lpad(cast(doc_id as varchar), 8, '0') as t from documents) select id, i as chunk_index, 13 as total_chunks, "
    "t || 'a' || chr(10) || chr(10) || t || 'b' as chunk from l, range(13) r(i)",
)
def packed_paragraphs(spark, d):
    """Paragraphs of nine characters, two of which fit into a chunk."""
    t = F.lpad(F.col("doc_id").cast("string"), 8, "0")
    body = F.array_join(F.array_repeat(F.concat(t, F.lit("a\n\n"), t, F.lit("b")), 13), "\n\n")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), body.alias("content"), F.lit("config").alias("content_type"))
    return chunking.chunked(docs, 28, 0)


def _echo(prompts: list[str]) -> list[str]:
    return prompts


@query(
    "rendered_prompts",
    "select cast(doc_id as varchar) as id, md5('Summarise the following ' || lang || ' in one sentence:' || chr(10) || text) as answer, true as valid from documents",
)
def rendered_prompts(spark, d):
    """Prompts as a model gets them, by one that says what it was asked."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("kind"), F.col("text").alias("content"))
    return providers.answered(rows, "summary", _echo).withColumn("answer", F.md5("answer"))


@query(
    "embedded_contents",
    f"with h as (select n_nationkey as id, cast({_H} as double) as h from nation), w as (select id, i, {_WAVE} as w from h, range(4) r(i)), "
    "n as (select id, sqrt(sum(w * w)) as size from w group by 1) select id, round(w / size, 5) as first from w join n using (id) where i = 0",
)
def embedded_contents(spark, d):
    """Vectors by a provider that is called with distinct contents only."""
    chunks = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("content"))
    return providers.embedded(chunks, 4).select("id", F.round(F.get("vector", F.lit(0)).cast("double"), 5).alias("first"))
