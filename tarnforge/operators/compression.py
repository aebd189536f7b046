"""gzip and base64 for long contents, in Arrow batches."""

from __future__ import annotations

import base64
import binascii
import gzip
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: UTF-8 bytes from which a content is compressed.
LEAST = 10_240


@F.pandas_udf(StringType())
def zipped(s: pd.Series) -> pd.Series:
    return s.map(lambda t: base64.b64encode(gzip.compress(t.encode(), mtime=0)).decode(), na_action="ignore")


@F.pandas_udf(StringType())
def unzipped(s: pd.Series) -> pd.Series:
    def one(t: str) -> str:
        try:
            return gzip.decompress(base64.b64decode(t, validate=True)).decode()
        except (binascii.Error, OSError, EOFError, zlib.error, UnicodeDecodeError):
            return t  # not ours: as it is

    return s.map(one, na_action="ignore")


def compressed(store: DataFrame) -> DataFrame:
    """``store`` with long contents zipped; only those rows' contents go through Python workers for a result."""
    long = F.octet_length("content") > LEAST
    out = store.withColumn("original_size_bytes", F.when(long, F.octet_length("content"))).withColumn("is_compressed", F.coalesce(long, F.lit(False)))
    return out.withColumn("content", F.when(F.col("is_compressed"), zipped(F.when(F.col("is_compressed"), F.col("content")))).otherwise(F.col("content")))


def decoded(store: DataFrame) -> DataFrame:
    return store.withColumn("content", F.when(F.col("is_compressed"), unzipped(F.when(F.col("is_compressed"), F.col("content")))).otherwise(F.col("content")))
