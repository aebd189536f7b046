"""Scratch folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}
#: Folders that go when the driver's JVM ends.
_going: set[str] = set()


def fresh(spark: SparkSession, what: str) -> str:
    """An unused path in the folder that driver and executors share: the session's, else one in the warehouse.

    A folder of this machine serves only a session that runs on this machine alone. What is there lasts as long as the application.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir() or _own.get(sc.applicationId)
    if not root:
        root = tempfile.mkdtemp(prefix="tarnforge-") if sc.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
        _own[sc.applicationId] = root
    folder = f"{root.rstrip('/')}/tarnforge-engine-{sc.applicationId}"
    if folder not in _going:
        at = sc._jvm.org.apache.hadoop.fs.Path(folder)
        files = at.getFileSystem(sc._jsc.hadoopConfiguration())
        files.mkdirs(at)
        files.deleteOnExit(at)
        _going.add(folder)
    return f"{folder}/{what}-{uuid.uuid4().hex}"
