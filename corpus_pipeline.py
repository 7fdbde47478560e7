"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wavequarry.llm import stages
from wavequarry.llm.common import kept_or_written, written

#: (name, function of (spark, docs, sf_dir)).
STAGES = [
    ("quality", stages.quality_stage),
    ("near_duplicates", stages.dedup_stage),
    ("decontamination", stages.decontamination_stage),
    ("mixing", stages.mixing_stage),
    ("tokens", stages.token_stage),
]
#: SQL can't express the trained classifier of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """The last stage's rows over the documents of sf_dir.

    With a folder, each stage's result is written there under its name, and one that is there complete is read instead of made
    again, so that a run that was stopped goes on where it was. Without one, results go to the shared folder of this application.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        if folder:
            docs = kept_or_written(spark, f"{folder}/{name}", lambda docs=docs, stage=stage: stage(spark, docs, sf_dir))
        else:
            docs = written(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
