"""Making the package importable on the executors."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the executors once an application, for Python functions that run there."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp()) / "wavequarry.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def shipped(query: Callable) -> Callable:
    """A query function (spark, ...) that ships the package first."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args, **kwargs):
        ship(spark)
        return query(spark, *args, **kwargs)

    return run


#: Most rows a side may have to be broadcast.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset and Spark runs in this process alone, /tmp/checkpoints. A cluster without the setting is an error."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "/tmp/checkpoints"
    return f"{root.rstrip('/')}/{context.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives lost executors, and gives later plans true sizes."""
    path = f"{shared_dir(df.sparkSession)}/{re.sub('[^a-z0-9_]', '_', name)}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete what written() has left in the shared folder; frames built on it can't be read afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def few(df: DataFrame, bound: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most bound rows; reads no more than that."""
    return df.limit(bound + 1).count() <= bound
