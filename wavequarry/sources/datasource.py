"""Generators as a Spark data source: spark.read.format("signal").options(kind="tone", count=1000, hz=50, sps=8000)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Run(InputPartition):
    """Samples from start up to stop."""

    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class SignalReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.kind, self.count = options.get("kind", "tone"), int(options.get("count", 0))
        self.hz, self.sps, self.amplitude = (float(options.get(k, d)) for k, d in (("hz", 1.0), ("sps", 1.0), ("amplitude", 1.0)))
        self.seed, self.run = int(options.get("seed", 0)), int(options.get("run", 1 << 20))
        if self.kind not in ("tone", "noise"):
            raise ValueError(f"no signal {self.kind}")

    def partitions(self) -> list[InputPartition]:
        return [Run(a, min(a + self.run, self.count)) for a in range(0, self.count, self.run)]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        """Batches of a run; noise depends on the seed and the run's start alone."""
        rng = np.random.default_rng([self.seed, partition.start])
        for a in range(partition.start, partition.stop, 1 << 16):
            i = np.arange(a, min(a + (1 << 16), partition.stop))
            x = np.sin(2 * np.pi * self.hz / self.sps * i) if self.kind == "tone" else rng.uniform(-1, 1, len(i))
            yield pa.RecordBatch.from_pydict({"trace": pa.array([self.kind] * len(i)), "idx": pa.array(i, pa.int64()), "value": pa.array(x * self.amplitude)})


class SignalSource(DataSource):
    """Tones and noise, made where they are read."""

    @classmethod
    def name(cls) -> str:
        return "signal"

    def schema(self) -> str:
        return "trace string, idx bigint, value double"

    def reader(self, schema) -> DataSourceReader:
        return SignalReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SignalSource)
