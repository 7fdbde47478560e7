"""Live sources as a streaming data source: tones, noise, or the rows of a table, released at a rate.

spark.readStream.format("live").options(kind="tone", sps=8000, hz=50, origin=...) has a sample for every 1 / sps seconds since
origin (seconds since 1970). How many there are depends on the clock alone and what they are on their places alone, so a query
that starts again reads the rest and sees a batch that it repeats unchanged.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Values of noise that are drawn together; places of one block have the same seed.
BLOCK = 1 << 12


class Places(InputPartition):
    """Rows from start up to stop, of one file where there are files: first is the place of the file's first row."""

    def __init__(self, start: int, stop: int, path: str = "", first: int = 0):
        self.start, self.stop, self.path, self.first = start, stop, path, first


def signal(kind: str, start: int, stop: int, hz: float, sps: float, seed: int) -> np.ndarray:
    """A tone or noise from place start up to stop; any cut of places gives the same values."""
    if kind == "tone":
        return np.sin(2 * np.pi * np.fmod(hz / sps * np.arange(start, stop), 1.0))
    first = start // BLOCK
    blocks = [np.random.default_rng([seed, b]).uniform(-1, 1, BLOCK) for b in range(first, -(-stop // BLOCK))]
    return np.concatenate([*blocks, np.zeros(0)])[start - first * BLOCK : stop - first * BLOCK]


def _at(path: str):
    """File system and path, of local folders and what the reader's libraries know."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if urlparse(path).scheme not in ("", "file") else (fs.LocalFileSystem(), urlparse(path).path)


class LiveReader(DataSourceStreamReader):
    """Offsets are places: row is the number of rows that have been read."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.kind, self.path, self.schema = options.get("kind", "tone"), options.get("path", ""), schema
        self.hz, self.sps, self.origin = (float(options.get(k, d)) for k, d in (("hz", 1.0), ("sps", 1.0), ("origin", 0.0)))
        self.seed, self.run = int(options.get("seed", 0)), int(options.get("run", 1 << 20))
        self.count = int(options["count"]) if "count" in options else None
        if self.kind not in ("tone", "noise", "table") or (self.kind == "table") != bool(self.path):
            raise ValueError(f"no live source {self.kind} {self.path}")

    def files(self) -> list[tuple[str, int]]:
        """The table's files by name, with their numbers of rows, from the footers."""
        from pyarrow import fs

        system, path = _at(self.path)
        info = system.get_file_info(path)
        found = [info] if info.is_file else [f for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file and f.path.endswith(".parquet")]
        return [(f.path, pq.read_metadata(f.path, filesystem=system).num_rows) for f in sorted(found, key=lambda f: f.path)]

    def initialOffset(self) -> dict:
        return {"row": 0}

    def latestOffset(self) -> dict:
        released = max(0, int((time.time() - self.origin) * self.sps))
        most = [x for x in (self.count, sum(n for _, n in self.files()) if self.kind == "table" else None) if x is not None]
        return {"row": min([released, *most])}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        a, b = int(start["row"]), int(end["row"])
        if self.kind != "table":
            return [Places(x, min(x + self.run, b)) for x in range(a, b, self.run)]
        out, first = [], 0
        for path, n in self.files():
            lo, hi = max(a, first), min(b, first + n)
            out += [Places(x, min(x + self.run, hi), path, first) for x in range(lo, hi, self.run)]
            first += n
        return out

    def read(self, partition: Places) -> Iterator[pa.RecordBatch]:
        if self.kind != "table":
            for a in range(partition.start, partition.stop, 1 << 16):
                b = min(a + (1 << 16), partition.stop)
                yield pa.RecordBatch.from_pydict({"trace": pa.array([self.kind] * (b - a)), "idx": pa.array(range(a, b), pa.int64()), "value": pa.array(signal(self.kind, a, b, self.hz, self.sps, self.seed))})
            return
        from pyspark.sql.pandas.types import to_arrow_schema

        system, _ = _at(self.path)
        wanted = to_arrow_schema(self.schema)
        with pq.ParquetFile(system.open_input_file(partition.path)) as f:
            at = partition.first
            for g in range(f.num_row_groups):
                n = f.metadata.row_group(g).num_rows
                if at < partition.stop and at + n > partition.start:  # other row groups aren't read
                    for batch in f.iter_batches(1 << 14, row_groups=[g], columns=wanted.names):
                        lo, hi = max(partition.start - at, 0), min(partition.stop - at, batch.num_rows)
                        if lo < hi:
                            yield from pa.Table.from_batches([batch.slice(lo, hi - lo)]).select(wanted.names).cast(wanted).to_batches()
                        at += batch.num_rows
                else:
                    at += n

    def commit(self, end: dict) -> None:
        """Nothing is kept for what has been read."""


class LiveSource(DataSource):
    """Samples as they come, or rows of a table (give the schema of the columns wanted)."""

    @classmethod
    def name(cls) -> str:
        return "live"

    def schema(self) -> str:
        return "trace string, idx bigint, value double"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return LiveReader(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LiveSource)
