"""Samples of fixed width in files, read by byte ranges and written in order: raw numbers, bits, and WAV.

spark.read.format("samples").options(path=..., kind=...) deals runs of frames (a frame has one sample of each channel) over tasks, so a
file of any size is many tasks and a task holds a few frames at a time. write_samples() writes each trace as files in the order of idx;
only files that the commit lists count, so a task that ran twice or failed leaves nothing behind that is read.
"""

from __future__ import annotations

import json
import posixpath
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .livesource import _at

#: Raw kinds by name, as numbers in little-endian bytes; bits are bytes whose eight bits are a trace each.
RAW = {"u8": "u1", "i16": "<i2", "i32": "<i4", "f32": "<f4", "f64": "<f8", "bits": "u1"}
#: What a written folder holds: the files of each trace, in order.
LISTED = "_files"
#: Frames read at a time.
FRAMES = 1 << 15
#: Frames of short runs that go to one task: a task takes far longer to begin than to read a few thousand.
TOGETHER = 1 << 19


@dataclass
class Layout:
    """Where a file's frames are: from `start` bytes on, `frames` of them, each of `channels` samples of a kind; place is the idx of the first."""

    path: str
    trace: str
    kind: str
    channels: int
    start: int
    frames: int
    sps: float | None = None
    place: int = 0

    @property
    def width(self) -> int:
        return self.channels * (3 if self.kind == "pcm24" else np.dtype(RAW.get(self.kind, self.kind)).itemsize)


@dataclass
class Frames:
    """Frames from first up to stop of a file."""

    layout: Layout
    first: int
    stop: int


class Runs(InputPartition):
    """What one task reads."""

    def __init__(self, runs: list[Frames]):
        self.runs = runs


def wav_layout(f, path: str, size: int) -> Layout:
    """The layout of a WAV file from its chunks' headers; samples that the file doesn't hold to the end don't count."""
    head = f.read(12)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError(f"{path} isn't a WAV file")
    at, form = 12, None
    while at + 8 <= size:
        f.seek(at)
        name, length = struct.unpack("<4sI", f.read(8))
        if name == b"fmt ":
            form = struct.unpack("<HHIIHH", f.read(16))
        elif name == b"data" and form:
            code, channels, rate, _, _, depth = form
            kind = {16: "<i2", 24: "pcm24", 32: "<f4"}.get(depth)
            if kind is None or depth == 32 and code not in (3, 0xFFFE):
                raise ValueError(f"{depth} bits of kind {code} aren't read")
            return Layout(path, path, kind, channels, at + 8, min(length, size - at - 8) // (channels * depth // 8), float(rate))
        at += 8 + length + length % 2
    raise ValueError(f"no samples in {path}")


def values_of(raw: bytes, layout: Layout, wav: bool) -> np.ndarray:
    """Frames by channels. Whole numbers of WAV files are shares of their range."""
    if layout.kind == "pcm24":
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(raw, RAW.get(layout.kind, layout.kind))
        x = x / 32767.0 if wav and layout.kind == "<i2" else x.astype(float) if layout.kind != "bits" else x
    if layout.kind == "bits":
        return np.unpackbits(x.astype(np.uint8)[:, None], axis=1, bitorder="little").astype(float)
    return x.reshape(-1, layout.channels)


class SampleReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.kind, self.channels = options["path"], options.get("kind", "wav"), int(options.get("channels", 1))
        self.sps = float(options["sps"]) if "sps" in options else None
        self.run = int(options.get("frames", 1 << 22))
        if self.kind != "wav" and self.kind not in RAW or self.run < 1:
            raise ValueError(f"no samples of kind {self.kind}")

    def layouts(self) -> list[Layout]:
        """The files' layouts, from their sizes and headers alone."""
        from pyarrow import fs

        system, path = _at(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        listed = posixpath.join(path, LISTED)
        if not info.is_file and system.get_file_info(listed).is_file:
            with system.open_input_file(listed) as f:
                traces = json.loads(f.read())
            named = [(t, posixpath.join(path, name)) for t, names in traces.items() for name in names]
        else:
            found = [info] if info.is_file else [x for x in system.get_file_info(fs.FileSelector(path, recursive=True)) if x.is_file and not x.base_name.startswith(("_", "."))]
            named = [(x.path, x.path) for x in sorted(found, key=lambda x: x.path)]
        out, places = [], {}
        for (trace, name), x in zip(named, system.get_file_info([n for _, n in named]), strict=True):
            if self.kind == "wav":
                with system.open_input_file(name) as f:
                    layout = wav_layout(f, name, x.size)
            else:
                layout = Layout(name, trace, self.kind, self.channels, 0, 0, self.sps)
                layout.frames = x.size // layout.width
            layout.place = places.get(trace, 0)
            places[trace] = layout.place + layout.frames
            out.append(layout)
        return out

    def partitions(self) -> list[InputPartition]:
        """Runs of frames, short ones dealt together; runs that follow one another in a file are one."""
        out: list[Runs] = []
        held = 0
        for x in self.layouts():
            for a in range(0, x.frames, self.run):
                b = min(a + self.run, x.frames)
                if not out or held + b - a > TOGETHER:
                    out.append(Runs([]))
                    held = 0
                held += b - a
                runs = out[-1].runs
                if runs and runs[-1].layout is x:
                    runs[-1].stop = b
                else:
                    runs.append(Frames(x, a, b))
        return out

    def read(self, partition: Runs | None) -> Iterator[pa.RecordBatch]:
        system, _ = _at(self.path)
        for part in partition.runs if partition else []:  # none: no frames at all
            x = part.layout
            with system.open_input_file(x.path) as f:
                for a in range(part.first, part.stop, FRAMES):
                    n = min(FRAMES, part.stop - a)
                    f.seek(x.start + a * x.width)
                    v = values_of(f.read(n * x.width), x, self.kind == "wav")
                    for c in range(v.shape[1]):
                        name = f"{x.trace} bit {c}" if x.kind == "bits" else f"{x.trace}:{c}" if self.kind == "wav" or x.channels > 1 else x.trace
                        yield pa.RecordBatch.from_pydict({"trace": pa.array([name] * n), "idx": pa.array(np.arange(x.place + a, x.place + a + n)), "value": pa.array(np.ascontiguousarray(v[:, c])), "sps": pa.array([x.sps] * n, pa.float64())})


@dataclass
class Written(WriterCommitMessage):
    """(task, trace, file) of a task's files."""

    files: list[tuple[int, str, str]]


class SampleWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.kind = options["path"], options.get("kind", "f64")
        if self.kind not in RAW:
            raise ValueError(f"no raw samples of kind {self.kind}")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, path = _at(self.path)
        system.create_dir(path, recursive=True)
        task, files, at, out = TaskContext.get().partitionId(), [], None, None
        kind = np.dtype(RAW[self.kind])
        try:
            for batch in batches:
                names = np.array(batch.column(batch.schema.get_field_index("trace")).to_pylist(), object)
                x = batch.column(batch.schema.get_field_index("value")).to_numpy(zero_copy_only=False)
                if kind.kind != "f":
                    x = np.clip(np.trunc(x), np.iinfo(kind).min, np.iinfo(kind).max)
                cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
                for a, b in zip(cuts, cuts[1:]):
                    if a < b:
                        if names[a] != at or out is None:
                            if out is not None:
                                out.close()
                            at = names[a]
                            files.append((task, at, f"part-{task:05d}-{uuid.uuid4().hex}.{self.kind}"))
                            out = system.open_output_stream(posixpath.join(path, files[-1][2]))
                        out.write(x[a:b].astype(kind).tobytes())
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        """The list of files, a row a task and trace, makes the folder readable."""
        traces: dict[str, list[str]] = {}
        for _, trace, name in sorted((x for m in messages if m for x in m.files), key=lambda x: x[0]):
            traces.setdefault(trace, []).append(name)
        system, path = _at(self.path)
        system.create_dir(path, recursive=True)
        with system.open_output_stream(posixpath.join(path, LISTED)) as f:
            f.write(json.dumps(traces).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, path = _at(self.path)
        for m in messages:
            for _, _, name in m.files if m else []:
                system.delete_file(posixpath.join(path, name))


class SampleSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "samples"

    def schema(self) -> str:
        return "trace string, idx bigint, value double, sps double"

    def reader(self, schema) -> DataSourceReader:
        return SampleReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> SampleWriter:
        return SampleWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SampleSource)


def write_samples(s: DataFrame, path: str, kind: str = "f64") -> None:
    """Traces as raw files under path (a new folder), by ranges of trace and idx, so that no trace is one task."""
    register(s.sparkSession)
    ordered = s.select("trace", "idx", s["value"].cast("double").alias("value")).repartitionByRange("trace", "idx").sortWithinPartitions("trace", "idx")
    ordered.write.format("samples").mode("append").option("kind", kind).option("path", path).save()


def read_samples(spark: SparkSession, path: str, kind: str = "f64", **options: object) -> DataFrame:
    """trace, idx, value, sps of files of that kind."""
    register(spark)
    return spark.read.format("samples").options(path=path, kind=kind, **options).load()
