"""Annotations of traces: trace, type, idx, right_idx, t, right_t, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import BLOCK, with_index

COLUMNS = ("trace", "type", "idx", "right_idx", "t", "right_t", "text")


def features(df: DataFrame, **columns: Column) -> DataFrame:
    """A table of annotations from any rows; columns that aren't given are null, but type and text, which are empty, and trace, which must be given."""
    kinds = {"trace": "string", "type": "string", "idx": "long", "right_idx": "long", "t": "double", "right_t": "double", "text": "string"}
    empty = {"type": F.lit(""), "text": F.lit("")}
    return df.select([F.coalesce(columns.get(c, F.lit(None)).cast(k), empty.get(c, F.lit(None)).cast(k)).alias(c) for c, k in kinds.items()])


def add_features(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables' annotations with their places in each trace by sample (then time, type and text): no trace is in one task."""
    both = old.select(*COLUMNS).unionByName(new.select(*COLUMNS)).withColumn("__at", F.coalesce("idx", F.lit(0)))
    return with_index(both.withColumnRenamed("idx", "sample"), "trace", ["__at", "t", "type", "text", "right_idx"], F.floor(F.col("__at") / BLOCK)).withColumnRenamed("idx", "place").withColumnRenamed("sample", "idx").select(*COLUMNS, "place")


def filter_features(f: DataFrame, types: list[str] | None = None, pattern: str | None = None, left: int | None = None, right: int | None = None) -> DataFrame:
    """Annotations of those types whose text the pattern finds (case ignored) and that reach into samples left to right (right left out); one without a right end is a point."""
    if types is not None:
        f = f.where(F.col("type").isin(types))
    if pattern is not None:
        f = f.where(F.col("text").rlike("(?i)" + pattern))
    if left is not None:
        f = f.where(F.coalesce("right_idx", "idx") >= left)
    return f if right is None else f.where(F.col("idx") < right)
