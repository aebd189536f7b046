"""The engine as named tools over a project's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnforge.functions import detect, text, vector
from tarnforge.log import Log
from tarnforge.operators import chunking, search, stats
from tarnforge.operators import store as stores
from tarnforge.settings import Settings
from tarnforge.sources import files, providers, storage

_SCHEMA = (
    "id string, project_path string, file_path string, chunk_index int, total_chunks int, content string, content_type string, role string, file_extension string, "
    "file_size_bytes int, lines_count int, language string, vector array<float>, is_compressed boolean, original_size_bytes int, version int, created_at timestamp, updated_at timestamp"
)


class Tools:
    """Callables by name, with a category each; hidden ones can be called but are not listed."""

    def __init__(self):
        self._known: dict[str, tuple[Callable, str]] = {}
        self._hidden: set[str] = set()

    def register(self, name: str, call: Callable, category: str = "retrieval", visible: bool = True) -> None:
        if name in self._known:
            raise ValueError(f"{name} is there already")
        self._known[name] = (call, category)
        if not visible:
            self._hidden.add(name)

    def alias(self, name: str, of: str) -> None:
        """Another name, not listed, of a tool: for callers that know an older one."""
        self.register(name, *self._known[of], visible=False)

    def discover(self, source: object, category: str = "retrieval") -> list[str]:
        """Register what ``source``, a module or an object, marks with ``tool``; returns the new names."""
        found = []
        for attribute in sorted(dir(source)):
            call = getattr(source, attribute, None)
            mark = getattr(call, "_tool", None)
            if mark and mark["name"] not in self._known:
                self.register(mark["name"], call, mark["category"] or category, mark["visible"])
                found.append(mark["name"])
        return found

    def show(self, name: str, visible: bool = True) -> None:
        if name not in self._known:
            raise KeyError(f"no such tool: {name}")
        (self._hidden.discard if visible else self._hidden.add)(name)

    def names(self, prefix: str = "", category: str | None = None, first: str | None = None, hidden: bool = False) -> list[str]:
        found = [n for n, (_, c) in self._known.items() if n.startswith(prefix) and category in (None, c) and (hidden or n not in self._hidden)]
        return sorted(found, key=lambda n: (n != first, n))

    def execute(self, name: str, **arguments):
        if name not in self._known:
            raise KeyError(f"no such tool: {name}")
        return self._known[name][0](**arguments)


def tool(name: str, category: str | None = None, visible: bool = True):
    """Mark a callable for ``Tools.discover``."""

    def mark(call):
        call._tool = {"name": name, "category": category, "visible": visible}
        return call

    return mark


#: Older names of tools (fixed values).
ALIASES = {"search_code": "search", "index_project": "index", "update_project": "update", "manage_projects": "projects"}


class Engine:
    """A project's chunk store and file snapshot below ``root``, on any file system that Spark can write.

    Each write makes new folders and then names both by one rename, so store and snapshot always belong together and readers
    of the version before go on. The store is partitioned by content type, which filters on it prune.
    """

    def __init__(self, spark: SparkSession, root: str, settings: Settings = Settings(), provider=None, log: Log | None = None):
        self.spark, self.root, self.settings, self.provider = spark, str(root).rstrip("/"), settings, provider
        self.tables, self.log = storage.Versioned(spark, self.root), log or Log()
        self.tools = Tools()
        self.tools.discover(self)
        for name, of in ALIASES.items():
            self.tools.alias(name, of)

    @tool("init", "project")
    def init(self, force: bool = False) -> list[str]:
        storage.make_folder(self.spark, self.root)
        return files.init_tables(self.spark, self.root, force)

    def store(self) -> DataFrame:
        """The store; rows of the older schema, where a project still has only such, brought into this one."""
        at = self.tables.path("store")
        if at:
            return self.spark.read.schema(_SCHEMA).parquet(at)
        old = f"{self.root}/legacy_store"
        if storage.exists(self.spark, old):
            return stores.as_current(self.spark.read.parquet(old), _SCHEMA)
        return self.spark.createDataFrame([], _SCHEMA)

    def _commit(self, store: DataFrame, snapshot: DataFrame) -> None:
        self.tables.commit({"store": "content_type"}, store=store, snapshot=snapshot)

    def swept(self) -> int:
        """Delete the folders of earlier versions, when nothing reads them any more."""
        return self.tables.swept()

    def _chunks(self, project: str, scanned: DataFrame, now: str) -> DataFrame:
        kind = detect.detected(F.col("relative_path"), F.col("content"))
        known = scanned.select("relative_path", "content", "size", kind.alias("d"))
        parts = chunking.chunked(known.select(F.col("relative_path").alias("id"), "content", F.col("d.content_type").alias("content_type")), self.settings.chunk_size, self.settings.chunk_overlap)
        rows = parts.withColumnRenamed("id", "relative_path").join(known.select("relative_path", "d"), "relative_path")
        path = F.when(F.col("total_chunks") > 1, F.concat("relative_path", F.lit("#chunk"), F.col("chunk_index").cast("string"))).otherwise(F.col("relative_path"))
        at = F.lit(now).cast("timestamp")
        out = rows.select(
            text.chunk_id(F.lit(project), path, F.col("chunk_index"), F.col("total_chunks")).alias("id"), F.lit(project).alias("project_path"), path.alias("file_path"), "chunk_index", "total_chunks", F.col("chunk").alias("content"),
            F.col("d.content_type").alias("content_type"), detect.indexed_role(F.col("d.content_type")).alias("role"), text.extension(F.col("relative_path")).alias("file_extension"), F.octet_length("chunk").alias("file_size_bytes"),
            text.line_count(F.col("chunk")).cast("int").alias("lines_count"), F.col("d.language").alias("language"), F.lit(False).alias("is_compressed"), F.lit(None).cast("int").alias("original_size_bytes"), F.lit(1).alias("version"), at.alias("created_at"), at.alias("updated_at"),
        )
        return providers.embedded(out, self.settings.dimension, self.provider).select(*self.store().columns)

    def _scan(self, path: str, rules: list[str]) -> DataFrame:
        own = self.settings
        return files.scan(self.spark, path, own.file_glob, [*files.project_rules(self.spark, path), *rules], own.least_chars, own.most_bytes, own.recursive)

    @tool("index", "indexing")
    def index(self, path: str, project: str | None = None, now: str = "1970-01-01 00:00:00", rules: list[str] = ()) -> dict:
        """All files below ``path`` into the store, over what it had of the project."""
        project = project or path
        self.log.info("index.start", project=project)
        scanned = self._scan(path, rules)
        self._commit(stores.without_project(self.store(), project).unionByName(self._chunks(project, scanned, now)), self._snapshot(project, scanned, keep=True))
        counts = F.count("*").alias("chunks"), F.countDistinct(text.clean_path(F.col("file_path"))).alias("files")
        out = self.store().where(F.col("project_path") == project).agg(*counts).first().asDict()
        self.log.info("index.end", project=project, **out)
        return out

    def _snapshot(self, project: str, scanned: DataFrame, keep: bool = False) -> DataFrame:
        now = stores.snapshot(scanned.withColumn("path", F.col("relative_path"))).withColumn("project_path", F.lit(project))
        at = self.tables.path("snapshot")
        return self.spark.read.parquet(at).where(F.col("project_path") != project).unionByName(now) if keep and at else now

    def _without(self, project: str, paths: DataFrame) -> DataFrame:
        """The store without the chunks of ``paths (_path)`` of a project."""
        own = F.when(F.col("project_path") == project, text.clean_path(F.col("file_path")))
        return self.store().withColumn("_path", own).join(paths, "_path", "left_anti").drop("_path")

    @tool("update", "indexing")
    def update(self, path: str, project: str | None = None, now: str = "1970-01-01 00:00:00", rules: list[str] = ()) -> dict:
        """Only files whose content changed since the last run are chunked and embedded again."""
        project = project or path
        at = self.tables.path("snapshot")
        if at is None:
            return self.index(path, project, now, rules)
        scanned = self._scan(path, rules)
        before = self.spark.read.parquet(at).where(F.col("project_path") == project)
        found = stores.incremental_diff(before, self._snapshot(project, scanned))
        counts = {r.status: r["count"] for r in found.groupBy("status").count().collect()}
        changed = found.where("status in ('added', 'modified')").select(F.col("path").alias("relative_path"))
        stale = found.where("status in ('deleted', 'modified')").select(F.col("path").alias("_path"))
        added = self._chunks(project, scanned.join(changed, "relative_path", "left_semi"), now)
        self._commit(self._without(project, stale).unionByName(added), self._snapshot(project, scanned, keep=True))
        out = {k: counts.get(k, 0) for k in ("added", "modified", "deleted", "unchanged")}
        self.log.info("update.end", project=project, **out)
        return out

    def apply(self, path: str, project: str, changed: DataFrame, gone: DataFrame, now: str, rules: list[str] = ()) -> None:
        """Index the files of ``changed (path)`` anew and drop those of ``gone (path)``; run again, it gives the same store.

        A changed file that is not there any more, or that the rules ignore, is dropped.
        """
        paths = changed.select("path").unionByName(gone.select("path")).distinct()
        scanned = self._scan(path, rules).join(changed.select(F.col("path").alias("relative_path")).distinct(), "relative_path", "left_semi")
        store = self._without(project, paths.withColumnRenamed("path", "_path")).unionByName(self._chunks(project, scanned, now))
        now_there = stores.snapshot(scanned.withColumn("path", F.col("relative_path"))).withColumn("project_path", F.lit(project))
        at = self.tables.path("snapshot")
        if at:
            known = self.spark.read.parquet(at)
            others = known.join(paths.withColumn("project_path", F.lit(project)), ["path", "project_path"], "left_anti").select(*known.columns)
            now_there = others.unionByName(now_there.select(*known.columns))
        self._commit(store, now_there)

    @tool("search")
    def search(self, query: str, mode: str = "hybrid", limit: int | None = None, threshold: float | None = None, filters: search.Filters = search.Filters(), dynamic: bool | None = None) -> DataFrame:
        """``semantic``, ``text`` or ``hybrid`` results as ``id, score``."""
        n = search.clamp_limit(limit, self.settings.search_limit)
        bar = self.settings.search_threshold if threshold is None else threshold
        if mode == "text":
            return search.text_search(self.store(), query, n, filters=filters).withColumnRenamed("text_score", "score")
        if self.provider:
            q = self.provider([query])[0]
        else:
            q = self.spark.range(1).select(vector.wave_embedding(F.lit(query), self.settings.dimension)).first()[0]
        if mode == "semantic":
            dynamic = self.settings.dynamic_threshold if dynamic is None else dynamic
            found = search.semantic_dynamic(self.store(), q, n, filters) if dynamic else search.semantic(self.store(), q, n, bar, filters)
            return found.select("id", F.col("sim").alias("score"))
        if mode != "hybrid":
            raise ValueError(f"no such mode: {mode}")
        return search.hybrid(self.store(), q, query, n, self.settings.semantic_weight, self.settings.text_weight, threshold=bar, filters=filters).select("id", F.col("combined_score").alias("score"))

    @tool("projects", "project")
    def projects(self) -> list[str]:
        return [r.project_path for r in stats.projects(self.store()).toLocalIterator()]

    @tool("project_stats", "project")
    def project_stats(self, project: str) -> dict:
        return stats.project_stats(self.store(), project).first().asDict()


def _shown(results: DataFrame, store: DataFrame, *columns, most: int = 50) -> list:
    """The best results with what a reader is shown, best first."""
    return results.join(store.select("id", *columns), "id").orderBy(F.desc("score"), "id").limit(most).collect()


def as_text(results: DataFrame, store: DataFrame, chars: int = 200) -> str:
    """Results for a reader, best first."""
    rows = _shown(results, store, "file_path", text.shortened(F.col("content"), chars).alias("content"), "content_type", "language")
    if not rows:
        return "No results."
    return "\n\n".join(f"{i}. {r.file_path} ({r.score:.3f}, {r.content_type}{', ' + r.language if r.language else ''})\n{r.content}" for i, r in enumerate(rows, 1))


def as_lines(results: DataFrame, store: DataFrame, query: str, chars: int = 100) -> str:
    """Results as the older tool gave them: a head with the query and how many, then a path, a share and a beginning each."""
    rows = _shown(results, store, "file_path", "project_path", F.left("content", F.lit(chars)).alias("content"))
    head = f'Query: "{query}"\nResults: {len(rows)}'
    return "\n\n".join([head, *(f"{i}. {r.file_path} ({100 * r.score:.2f}%)\n   Project: {r.project_path}\n   {r.content}" for i, r in enumerate(rows, 1))])


def as_report(results: DataFrame, store: DataFrame, query: str, mode: str, contents: bool = True, chars: int = 500) -> str:
    """Results with all that is known of each, for a closer look."""
    known = ("project_path", "content_type", "language", "role", "lines_count", "updated_at")
    rows = _shown(results, store, "file_path", *known, text.shortened(F.col("content"), chars).alias("content"))
    out = [f'{mode.capitalize()} search for "{query}": {len(rows)} found']
    if not rows:
        out.append("Nothing matches. More general terms or fewer filters may help.")
    for i, r in enumerate(rows, 1):
        out.append(f"{i}. {r.file_path}: {100 * r.score:.2f}%")
        out += [f"   {c}: {r[c]}" for c in known if r[c] is not None]
        if contents and r.content:
            out += ["   | " + x for x in r.content.split("\n")]
    return "\n".join(out)


def as_records(results: DataFrame, store: DataFrame, chars: int = 500) -> list[dict]:
    """Results as plain values, for another program."""
    columns = ("file_path", "project_path", "content_type", "language", "role", text.shortened(F.col("content"), chars).alias("content"))
    return [r.asDict() for r in _shown(results, store, *columns)]
