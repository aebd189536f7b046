"""Chunkers and symbols as SQL table functions: ``select * from tf_chunks(table(select id, content, content_type from docs))``.

The functions take a table argument; what columns it has to have, and the type of its id, is looked at when a query is analysed. They run beside the rows, whose
partitioning the query decides, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DataType, IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tarnforge.operators import chunking


def _id_type(rows: AnalyzeArgument, *needed: str) -> DataType:
    if not rows.isTable:
        raise ValueError("the first argument has to be a table")
    missing = [c for c in ("id", *needed) if c not in rows.dataType.names]
    if missing:
        raise ValueError(f"the table has no column {', '.join(missing)}")
    return rows.dataType["id"].dataType


def _numbers(*given: AnalyzeArgument) -> None:
    if any(x.isTable or not isinstance(x.dataType, IntegerType | LongType) for x in given):
        raise ValueError("size and overlap have to be whole numbers")
    size, overlap = ((x.value if x.isConstantExpression else None) for x in (*given, *[AnalyzeArgument(IntegerType(), None, False, False)] * (2 - len(given))))
    if size is not None and (size < 1 or overlap is not None and not 0 <= overlap < size):
        raise ValueError("overlap must be at least 0 and less than size")


def _chunk_schema(kind: DataType) -> AnalyzeResult:
    schema = StructType().add("id", kind).add("chunk_index", IntegerType()).add("total_chunks", IntegerType()).add("chunk", StringType())
    return AnalyzeResult(schema)


class Chunks:
    """``id, chunk_index, total_chunks, chunk`` of the rows of a table with ``id, content, content_type``, by type."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, *limits: AnalyzeArgument) -> AnalyzeResult:
        _numbers(*limits)
        return _chunk_schema(_id_type(rows, "content", "content_type"))

    def eval(self, row: Row, size: int = chunking.SIZE, overlap: int = chunking.OVERLAP) -> Iterator[tuple]:
        parts = chunking.intelligent(row["content"] or "", row["content_type"], size, overlap)
        for i, part in enumerate(parts):
            yield row["id"], i, len(parts), part


class WordChunks:
    """``id, chunk_index, total_chunks, chunk`` of the rows of a table with ``id, content``, by words."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, *limits: AnalyzeArgument) -> AnalyzeResult:
        _numbers(*limits)
        return _chunk_schema(_id_type(rows, "content"))

    def eval(self, row: Row, size: int = chunking.SIZE, overlap: int = chunking.OVERLAP) -> Iterator[tuple]:
        parts = chunking.by_words(row["content"] or "", size, overlap)
        for i, part in enumerate(parts):
            yield row["id"], i, len(parts), part


class Symbols:
    """``id, kind, name, first_line, last_line`` of the declarations in the rows of a table with ``id, content``."""

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        schema = StructType().add("id", _id_type(rows, "content")).add("kind", StringType()).add("name", StringType())
        return AnalyzeResult(schema.add("first_line", IntegerType()).add("last_line", IntegerType()))

    def eval(self, row: Row) -> Iterator[tuple]:
        for found in chunking.symbols(row["content"] or ""):
            yield row["id"], *found


def register(spark: SparkSession) -> list[str]:
    """Make ``tf_chunks``, ``tf_word_chunks`` and ``tf_symbols`` known to the session; returns their names."""
    known = {"tf_chunks": Chunks, "tf_word_chunks": WordChunks, "tf_symbols": Symbols}
    for name, handler in known.items():
        spark.udtf.register(name, udtf(handler, useArrow=True))
    return list(known)
