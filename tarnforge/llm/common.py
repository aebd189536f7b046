"""What the operators of this subpackage share: scratch tables, Arrow mapping, words."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a function over Arrow data gets at once. What a worker receives at once Spark itself bounds by bytes.
BATCH_ROWS = 512

_own: dict[str, str] = {}
#: Folders that go when the driver's JVM ends.
_going: set[str] = set()
#: By thread, the scratch tables of each open ``scratch`` block.
_open = threading.local()

#: A-Z to a-z, all other bytes as they are.
LOWER = bytes(range(256)).lower()


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in the one that driver and executors share.

    That is ``spark.checkpoint.dir``, else the context's checkpoint folder, else one in the warehouse. A folder of this
    machine serves only a session that runs on this machine alone. What is in it lasts as long as the application, unless it is dropped before.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir() or _own.get(sc.applicationId)
    if not root:
        if sc.master.startswith("local"):
            root = tempfile.mkdtemp(prefix="tarnforge-")
        else:
            root = spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
        _own[sc.applicationId] = root
    folder = f"{root.rstrip('/')}/tarnforge-{sc.applicationId}"
    if folder not in _going:
        at = sc._jvm.org.apache.hadoop.fs.Path(folder)
        files = at.getFileSystem(sc._jsc.hadoopConfiguration())
        files.mkdirs(at)
        files.deleteOnExit(at)
        _going.add(folder)
    return folder


def fresh(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing has used; listed in the open ``scratch`` block, if there is one."""
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    if _blocks():
        _blocks()[-1].append(path)
    return path


def cut(df: DataFrame, what: str = "table") -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it again: later steps survive lost executors."""
    path = fresh(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _blocks() -> list[list[str]]:
    if not hasattr(_open, "blocks"):
        _open.blocks = []
    return _open.blocks


@contextmanager
def scratch() -> Iterator[list[str]]:
    """The paths of the scratch tables that this thread makes in the block.

    Those still there at its end belong to the block around it, if there is one.
    """
    made: list[str] = []
    blocks = _blocks()
    blocks.append(made)
    try:
        yield made
    finally:
        blocks.pop()
        if blocks:
            blocks[-1].extend(made)


def release(spark: SparkSession, made: list[str], *kept: str) -> None:
    """Delete the scratch tables in ``made``, but for ``kept``: their readers have been written out."""
    drop(spark, *(p for p in made if p not in kept))


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        for made in _blocks():
            if p in made:
                made.remove(p)


def map_tasks(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``f`` over the Arrow data of each task, in slices of at most ``BATCH_ROWS`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(b.slice(i, BATCH_ROWS) for b in batches for i in range(0, b.num_rows, BATCH_ROWS))

    return df.mapInArrow(run, schema)


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``f`` over each slice of the Arrow data of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from f(b)

    return map_tasks(df, run, schema)


#: A key that more than this part of the rows share is joined apart from the others; there are fewer such than one in it.
HOT = 1000


def join_hot(rows: DataFrame, values: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``values``, which has one row a ``key``; ``how`` is inner or left.

    Rows of keys that are shared by very many meet a broadcast of those keys' values alone, fewer than ``HOT`` of them, where they are;
    all others are joined by a shuffle. ``rows`` is read three times.
    """
    n = rows.count()
    often = rows.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") * HOT > n) & F.col(key).isNotNull()).select(key)
    often, _ = cut(often, "hot")
    of_often, _ = cut(values.join(F.broadcast(often), key), "hot")
    hot = rows.join(F.broadcast(often), key, "left_semi").join(F.broadcast(of_often), key, how)
    rest = rows.join(F.broadcast(often), key, "left_anti").join(values, key, how)
    return hot.unionByName(rest)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


#: Bytes of input that are worth a task of their own.
TASK_BYTES = 1 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` over more tasks, if its scan has fewer than there are cores: one small file would keep all but one idle.

    Every task has ``TASK_BYTES`` of input at least, so tables of many files, and tiny ones, are left as they are.
    """
    plan = df._jdf.queryExecution()
    size = int(str(plan.optimizedPlan().stats().sizeInBytes()))
    tasks = min(df.sparkSession.sparkContext.defaultParallelism, size // TASK_BYTES)
    return df.repartition(tasks) if plan.toRdd().getNumPartitions() < tasks else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; a null text has none."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (finaliser of a public generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; a shorter, non-empty sequence is one run of its own length."""
    size = min(size, len(h))
    if not size:
        return h
    n = len(h) - size + 1
    s = np.full(n, size, np.uint64)
    for i in range(size):
        s = s * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return mix(s)


WORD = re.compile(r"[^\x20\x09-\x0D]+")
