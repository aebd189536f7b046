"""Small files and folders on whatever file system a path names, through the one that Spark itself uses."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, files = _at(spark, path)
    return files.exists(at)


def make_folder(spark: SparkSession, path: str) -> None:
    at, files = _at(spark, path)
    files.mkdirs(at)


def delete(spark: SparkSession, path: str) -> None:
    at, files = _at(spark, path)
    files.delete(at, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    at, files = _at(spark, path)
    return sorted(x.getPath().getName() for x in files.listStatus(at)) if files.exists(at) else []


def read(spark: SparkSession, path: str) -> str:
    at, files = _at(spark, path)
    stream = files.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def size(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a folder."""
    at, files = _at(spark, path)
    return files.getContentSummary(at).getLength()


def replace(spark: SparkSession, path: str, text: str) -> None:
    """Put a small file in place of the one there, whole: written beside it, then renamed over it."""
    _put(spark, path, text, "OVERWRITE")


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Put a small file where there is none, whole; False, and nothing is done, if one is there."""
    if exists(spark, path):
        return False
    try:
        _put(spark, path, text, "NONE")
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in e.java_exception.getClass().getName():
            raise
        return False
    return True


def _put(spark: SparkSession, path: str, text: str, how: str) -> None:
    jvm = spark.sparkContext._jvm
    at, files = _at(spark, path)
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    stream = files.create(beside, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri() if at.toUri().getScheme() else files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, how)
    try:
        context.rename(files.makeQualified(beside), files.makeQualified(at), options)
    finally:
        if how != "OVERWRITE":
            files.delete(beside, False)


class Versioned:
    """Tables below ``root``, each in a folder of its own for each version; one small file names those that are current.

    A commit changes any number of tables at once, by one rename. Readers of an older version go on with its folders until
    ``swept`` deletes them.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def current(self) -> dict[str, str]:
        """Folder by table."""
        at = f"{self.root}/current.json"
        return json.loads(read(self.spark, at)) if exists(self.spark, at) else {}

    def path(self, name: str) -> str | None:
        folder = self.current().get(name)
        return f"{self.root}/{folder}" if folder else None

    def commit(self, partitioned_by: dict[str, str] | None = None, **tables: DataFrame) -> None:
        """Write the tables, then make all of them current."""
        made = {}
        for name, df in tables.items():
            made[name] = f"{name}-{uuid.uuid4().hex}"
            by = (partitioned_by or {}).get(name)
            writer = df.write.partitionBy(by) if by else df.write
            writer.parquet(f"{self.root}/{made[name]}")
        replace(self.spark, f"{self.root}/current.json", json.dumps(self.current() | made))

    def swept(self) -> int:
        """Delete the folders that are not current; for when no reader of them is left. Returns how many."""
        held = self.current()
        gone = [n for n in names(self.spark, self.root) if n not in held.values() and any(n.startswith(f"{t}-") for t in held)]
        for n in gone:
            delete(self.spark, f"{self.root}/{n}")
        return len(gone)
