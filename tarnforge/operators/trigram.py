"""Text predicates by an inverted index of character trigrams, kept on disk.

Texts are lower-cased and marked at both ends, and each of their trigrams has posting lists: the numbers of the rows, part by part, that have it
in a column. Posting lists lie in folders by a hash of the trigram, rows in folders by part. A search reads the lists of its terms' trigrams, intersects
them part by part, reads the contents of the parts where rows are left, and holds those rows against the exact predicate, so its
result is that of a scan. A term that has no whole trigram takes all lists whose trigram has it.

An index is a folder: rows and lists by batch, and one small file that names the batches that are current.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.window import Window

from tarnforge.functions import text as T
from tarnforge.sources import storage

#: Rows of a part, about, and folders of posting lists.
PART_ROWS, SLOTS = 20_000, 64
#: Marks of a text's start and end.
FIRST, LAST = "\x02", "\x03"
#: Candidates up to which they are sent to the rows instead of being dealt with them.
SENT_ROWS = 1_000_000
_LISTS = "gram string, field int, part int, rows array<int>"
_KEYS = StructType().add("_row", IntegerType()).add("_batch", StringType()).add("_part", IntegerType())


def _plain(text: str) -> str:
    """One form of the letter whose lower case depends on what follows it."""
    return text.replace("ς", "σ")


def _grams(text: str) -> set[str]:
    return {text[i : i + 3] for i in range(len(text) - 2)}


@dataclass(frozen=True)
class Index:
    """An index at ``path``: the indexed columns, the schema of the rows, and by batch its number of parts."""

    path: str
    columns: tuple[str, ...]
    schema: StructType
    batches: dict[str, int]

    def lists(self, spark: SparkSession, slots: list[int] | None = None) -> DataFrame:
        """Posting lists, of some slots or of all."""
        folders = [f"{self.path}/lists/batch={b}" for b in self.batches]
        if slots is not None:
            folders = [f for b in folders for s in slots if storage.exists(spark, f := f"{b}/slot={s}")]
        if not folders:
            return spark.createDataFrame([], f"{_LISTS}, batch string")
        return spark.read.schema(f"{_LISTS}, batch string").option("basePath", f"{self.path}/lists").parquet(*folders)

    def rows(self, spark: SparkSession, parts: list[tuple[str, int]] | None = None) -> DataFrame:
        """Rows with their ``_batch, _part, _row``, of some parts or of all."""
        at = f"{self.path}/rows/_batch="
        folders = [f"{at}{b}" for b in self.batches] if parts is None else [f"{at}{b}/_part={p}" for b, p in parts]
        schema = StructType([*self.schema.fields, *_KEYS.fields])
        if not folders:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).option("basePath", f"{self.path}/rows").parquet(*folders)


def _saved(spark: SparkSession, index: Index) -> Index:
    storage.replace(spark, f"{index.path}/index.json", json.dumps({"columns": index.columns, "schema": json.loads(index.schema.json()), "batches": index.batches}))
    return index


def opened(spark: SparkSession, path: str) -> Index:
    """The index that ``build`` has left at ``path``, in this or another session."""
    kept = json.loads(storage.read(spark, f"{path}/index.json"))
    return Index(path, tuple(kept["columns"]), StructType.fromJson(kept["schema"]), kept["batches"])


def _batch(store: DataFrame, path: str, columns: tuple[str, ...], part_rows: int) -> tuple[str, int]:
    """Write rows and posting lists of a batch: its name and number of parts."""
    spark, name = store.sparkSession, uuid.uuid4().hex
    parts = max(1, -(-store.count() // part_rows))
    placed = store.withColumn("_part", F.pmod(F.xxhash64("id", *columns), F.lit(parts)).cast("int"))
    number = F.row_number().over(Window.partitionBy("_part").orderBy("id")).cast("int")
    placed.withColumn("_row", number).write.partitionBy("_part").parquet(f"{path}/rows/_batch={name}")
    rows = spark.read.schema(StructType([*store.schema.fields, _KEYS["_row"], _KEYS["_part"]])).parquet(f"{path}/rows/_batch={name}")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                grams, fields, owners, numbers = [], [], [], []
                for part, row, *texts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    for field, text in enumerate(texts):
                        if text is not None:
                            own = _grams(f"{FIRST}{_plain(text)}{LAST}")
                            grams += own
                            fields += [field] * len(own)
                            owners += [part] * len(own)
                            numbers += [row] * len(own)
                columns = (pa.array(grams, pa.string()), *(pa.array(x, pa.int32()) for x in (fields, owners, numbers)))
                yield pa.RecordBatch.from_arrays(list(columns), ["gram", "field", "part", "row"])

    found = rows.select("_part", "_row", *(F.lower(c) for c in columns)).mapInArrow(split, "gram string, field int, part int, row int")
    lists = found.groupBy("gram", "field", "part").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    lists = lists.withColumn("slot", _slot(F.col("gram")))
    lists.repartition("slot").sortWithinPartitions("slot", "gram").write.partitionBy("slot").parquet(f"{path}/lists/batch={name}")
    return name, parts


def _slot(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(SLOTS)).cast("int")


def build(store: DataFrame, path: str, columns: tuple[str, ...] = ("content", "file_path"), part_rows: int = PART_ROWS) -> Index:
    """Index ``columns`` of all rows of ``store (id, ...)`` into a new folder ``path``, and keep the rows beside.

    Null texts have no trigrams and match nothing; empty ones match what an empty text matches. Repeated rows: each.
    """
    name, parts = _batch(store, path, columns, part_rows)
    return _saved(store.sparkSession, Index(path, columns, store.schema, {name: parts}))


def added(index: Index, store: DataFrame, part_rows: int = PART_ROWS) -> Index:
    """The index with a further batch of rows, in the columns of the first; readers of the index as it was go on undisturbed."""
    batch, parts = _batch(store.select(*(F.col(f"`{c}`") for c in index.schema.names)), index.path, index.columns, part_rows)
    return _saved(store.sparkSession, Index(index.path, index.columns, index.schema, index.batches | {batch: parts}))


def _marked(term: str, prefix: bool = False, suffix: bool = False, substring: bool = True, **_) -> str:
    """The term with the marks of the ends that it has to stand at."""
    if prefix and suffix or substring and not prefix and not suffix:
        return term
    return (FIRST if prefix or not suffix else "") + term + (LAST if suffix or not prefix else "")


def _rows_with(index: Index, spark: SparkSession, term: str, fields: int) -> DataFrame:
    """``batch, part, row``: rows that have all trigrams of ``term`` in one of the first ``fields`` columns."""
    grams = sorted(_grams(term))
    if not grams:  # too short: any trigram that has it
        found = index.lists(spark).where(F.contains("gram", F.lit(term)) & (F.col("field") < fields))
        return found.select("batch", "part", F.explode("rows").alias("row")).distinct()
    slots = sorted({r[0] for r in spark.createDataFrame([(g,) for g in grams], "gram string").select(_slot(F.col("gram"))).collect()})
    found = index.lists(spark, slots).where(F.col("gram").isin(grams) & (F.col("field") < fields))
    met = found.groupBy("batch", "part", "field").agg(F.collect_list("rows").alias("lists")).where(F.size("lists") == len(grams))
    # Shortest first: what is left only shrinks.
    lists = F.array_sort("lists", lambda a, b: F.size(a) - F.size(b))
    rows = F.aggregate(F.slice(lists, 2, len(grams)), lists[0], lambda left, more: F.array_intersect(left, more))
    return met.select("batch", "part", F.explode(rows).alias("row")).distinct()


def candidates(index: Index, spark: SparkSession, query: str, operator: str = "and", in_paths: bool = True, **options) -> DataFrame:
    """``batch, part, row`` of all rows that can match, and of some that don't."""
    fields = len(index.columns) if in_paths else 1
    terms = query.split()
    lowered = spark.range(1).select(*(F.lower(F.lit(t)) for t in terms)).first()
    found = [_rows_with(index, spark, _marked(_plain(t), **options), fields) for t in lowered]
    keys = ["batch", "part", "row"]
    if operator.lower() == "and":
        return reduce(lambda a, b: a.join(b, keys), found)
    return reduce(lambda a, b: a.unionByName(b), found).distinct()


def matching(index: Index, spark: SparkSession, query: str, operator: str = "and", in_paths: bool = True, **options) -> DataFrame:
    """The rows of the store that ``T.text_filter`` would find by a scan of it, in the index's first column or, ``in_paths``, in any.

    Only parts with candidates are read. A query without terms matches all rows.
    """
    columns = [F.col(c) for c in (index.columns if in_paths else index.columns[:1])]
    exact = T.text_filter(columns, query, operator, **options)
    keys = ["_batch", "_part", "_row"]
    if not query.split():
        return index.rows(spark).where(exact).drop(*keys)
    found = candidates(index, spark, query, operator, in_paths, **options).select(*(F.col(c[1:]).alias(c) for c in keys))
    by_part = found.groupBy("_batch", "_part").count().collect()  # one row a part at most
    rows = index.rows(spark, sorted((r["_batch"], r["_part"]) for r in by_part))
    few = sum(r["count"] for r in by_part) <= SENT_ROWS
    return rows.join(F.broadcast(found) if few else found, keys, "left_semi").where(exact).drop(*keys)
