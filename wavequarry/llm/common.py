"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, few, release, shared_dir, shipped, written

__all__ = ["BROADCAST_ROWS", "SALTS", "ascii_lower", "few", "join_few", "kept_or_written", "prepared", "release", "remainder", "shared_dir", "table", "tidy", "written"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Copies of the small side in a salted join.
SALTS = 64
#: Bytes of texts that go to or come from Python at once, where the session has Spark's default. Rows are as long as texts are, so a
#: number of rows doesn't bound a batch, and each task holds some batches on both sides.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else. lower() does just that where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def remainder(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


def join_few(df: DataFrame, small: DataFrame, on: Column, how: str, salt: Column, bound: int = BROADCAST_ROWS) -> DataFrame:
    """df joined to a table with a row a key: broadcast when that has at most bound rows (counted), else a join in which each key of df is dealt over SALTS tasks by salt."""
    if few(small, bound):
        return df.join(F.broadcast(small), on, how)
    small = small.withColumn("__salt", F.explode(F.array([F.lit(i) for i in range(SALTS)])))
    return df.withColumn("__at", F.pmod(F.hash(salt), F.lit(SALTS))).join(small, on & (F.col("__at") == F.col("__salt")), how).drop("__salt", "__at")


def kept_or_written(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The Parquet table at path if it was written to its end, else what make() returns, written there."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def prepared(query: Callable) -> Callable:
    """A query or stage (spark, ...) that ships the package and bounds batches of texts first."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args, **kwargs):
        if spark.conf.get(BATCH, "64m").lower().rstrip("b") in ("67108864", "64m"):
            spark.conf.set(BATCH, BATCH_BYTES)
        return query(spark, *args, **kwargs)

    return shipped(run)


def tidy() -> None:
    """Give freed memory back to the system at a task's end: the worker lives on beside those of other tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
