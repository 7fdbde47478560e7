"""Files into traces and tables, and back."""

from __future__ import annotations

import csv
import io
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vector import transposed  # noqa: F401  (re-exported for matrix files)

NUMBERS = ("double", "float", "int", "bigint", "smallint", "tinyint", "boolean")


def read_table(spark: SparkSession, path: str, separator: str = ",", line_ends: bool = False) -> DataFrame:
    """A CSV file as texts: short rows are padded, missing cells are "". Spark's reader drops blank lines; read_table_exact keeps them.

    Large files are split over tasks. line_ends says that cells may hold line ends, which takes a file a task. A column whose
    header is empty is left out.
    """
    df = spark.read.csv(path, sep=separator, header=True, multiLine=line_ends, escape='"', mode="PERMISSIVE")
    named = [(i, c) for i, c in enumerate(df.columns)]
    kept = [c for i, c in named if c != f"_c{i}"]  # Spark's name for a column without a header
    return df.select([F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in kept])


def columns_or(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """The columns of those names; a default for those that the table lacks and for null cells."""
    return df.select([F.coalesce(F.col(f"`{c}`"), F.lit(d)).alias(c) if c in df.columns else F.lit(d).alias(c) for c, d in defaults.items()])


def read_table_exact(spark: SparkSession, path: str, columns: list[str], separator: str = ",") -> DataFrame:
    """Rows of whole files, a file a task: file, row, then the columns; blank lines are rows of "", short rows padded, long ones cut; a doubled quote is one quote."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = csv.reader(io.StringIO(data.decode("utf-8-sig"), newline=""), delimiter=separator)
                head = [h for h in next(rows, [])]
                at = [head.index(c) if c in head else -1 for c in columns]
                found = [[r[i] if 0 <= i < len(r) else "" for i in at] for r in rows]
                cols = [pa.array([r[k] for r in found], pa.string()) for k in range(len(columns))]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(range(len(found)), pa.int64()), *cols], names=["file", "row", *columns])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(parse, "file string, row long" + "".join(f", `{c}` string" for c in columns))


def write_table(df: DataFrame, path: str, compression: str | None = None, separator: str = ",") -> None:
    """CSV with a header; null is the text null; quotes are doubled."""
    df.write.csv(path, header=True, sep=separator, nullValue="null", escape='"', compression=compression, emptyValue="")


def cell_text(c: Column, separator: str = ",") -> Column:
    """A value as a CSV cell: null as null; in quotes, doubled within, if it has the separator, a quote or a line end."""
    t = F.coalesce(c.cast("string"), F.lit("null"))
    return F.when(t.rlike("[\"\r\n" + re.escape(separator) + "]"), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)


def table_to_samples(df: DataFrame, order: str, match: str = ".*", drop_nan: bool = False) -> DataFrame:
    """Columns whose name the pattern finds (case ignored) as traces: what is no number becomes NaN; dropped NaN close up, column by column."""
    names = [c for c in df.columns if c != order and re.search(match, c, re.IGNORECASE)]
    texts = df.select(F.col(order).cast("long").alias("idx"), *[F.col(f"`{c}`").cast("string").alias(c) for c in names])
    s = texts.unpivot(["idx"], names, "trace", "text").select("trace", "idx", F.coalesce(F.col("text").try_cast("double"), F.lit(float("nan"))).alias("value"))
    if not drop_nan:
        return s
    from ..model import BLOCK, with_index

    kept = s.where(~F.isnan("value")).withColumnRenamed("idx", "at")
    return with_index(kept, "trace", ["at"], F.floor(F.col("at") / BLOCK)).select("trace", "idx", "value")


def samples_to_wide(s: DataFrame, traces: list[str]) -> DataFrame:
    """idx and a column a trace; shorter traces are null at the end. One aggregate, no joins."""
    return s.where(F.col("trace").isin(traces)).groupBy("idx").agg(*[F.max(F.when(F.col("trace") == t, F.col("value"))).alias(t) for t in traces])


def write_matrix(s: DataFrame, path: str) -> None:
    """A line a trace: its name and its values with blanks between. A line is a row, so each trace must fit in a task."""
    packed = s.groupBy("trace").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("v"))
    packed.select(F.concat_ws(" ", "trace", F.transform("v.value", lambda x: x.cast("string")))).write.text(path)


def write_names(traces: DataFrame, path: str, prefix: str = "", suffix: str = "") -> None:
    """The traces' names, decorated, a line each."""
    traces.select(F.concat(F.lit(prefix), "trace", F.lit(suffix))).distinct().write.text(path)


def export_columns(s: DataFrame, timed: bool) -> DataFrame:
    """Samples in the long form of an export: X.Time and X.Value for traces with times, else X."""
    value = F.struct(F.when(F.lit(timed), F.concat("trace", F.lit(".Value"))).otherwise(F.col("trace")).alias("column"), F.col("value").alias("v"))
    cells = [value, F.struct(F.concat("trace", F.lit(".Time")).alias("column"), F.col("t").alias("v"))] if timed else [value]
    return s.select("idx", F.explode(F.array(*cells)).alias("c")).select("idx", "c.column", F.col("c.v").alias("value"))


#: Columns of the structured log.
LOG = "time double, level string, source string, thread string, type string, name string, text string, value double, file string, line long, data binary"


def filter_log(log: DataFrame, types: list[str] | None = None, pattern: str = "") -> DataFrame:
    """Entries of those types in whose name, source or text the pattern finds something, case ignored."""
    kept = log if types is None else log.where(F.col("type").isin(types))
    return kept.where(F.concat_ws("\n", "name", "source", "text").rlike("(?i)" + pattern)) if pattern else kept


def write_log(entries: DataFrame, path: str, compression: str | None = None) -> None:
    """Log entries (LOG) as CSV, bytes as hexadecimal digits."""
    write_table(entries.withColumn("data", F.hex("data")), path, compression)


def read_numeric(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """A Parquet file's columns as numbers (timestamps in seconds), and why others were left out. Columns' metadata stay: write_numeric keeps rate, offset and length there."""
    from ..model import seconds

    df = spark.read.parquet(path)
    out, left = [], {}
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if kind in NUMBERS or kind.startswith("decimal"):
            out.append(F.col(f"`{f.name}`").cast("double").alias(f.name, metadata=f.metadata))
        elif kind.startswith("timestamp"):
            out.append(seconds(f"`{f.name}`").alias(f.name, metadata=f.metadata))
        else:
            left[f.name] = f"{kind} isn't a number"
    return df.select(out), left


def write_numeric(s: DataFrame, path: str, traces: dict[str, dict]) -> None:
    """Traces as columns by idx, NaN after a shorter one's end, with sps, offset and length as the columns' metadata."""
    wide = samples_to_wide(s, list(traces))
    cols = [F.coalesce(F.col(f"`{t}`"), F.lit(float("nan"))).alias(t, metadata=m) for t, m in traces.items()]
    wide.select("idx", *cols).write.parquet(path)


def pair_times(df: DataFrame, order: str) -> DataFrame:
    """Columns X.Time and X.Value as trace X with times; other columns as traces without."""
    names = [c for c in df.columns if c != order]
    pairs = [c[: -len(".Time")] for c in names if c.endswith(".Time") and c[: -len(".Time")] + ".Value" in names]
    used = {p + x for p in pairs for x in (".Time", ".Value")}
    items = [F.struct(F.lit(p).alias("trace"), F.col(f"`{p}.Time`").cast("double").alias("t"), F.col(f"`{p}.Value`").cast("double").alias("value")) for p in pairs]
    items += [F.struct(F.lit(c).alias("trace"), F.lit(None).cast("double").alias("t"), F.col(f"`{c}`").cast("double").alias("value")) for c in names if c not in used]
    return df.select(F.col(order).cast("long").alias("idx"), F.explode(F.array(*items)).alias("x")).select("x.trace", "idx", "x.t", "x.value")


def decode_wav(data: bytes) -> tuple[int, np.ndarray]:
    """Rate and samples (channels by time) of a WAV file: PCM of 16 or 24 bits, or floats of 32."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", data, at + 8)
        elif name == b"data" and form:
            kind, channels, rate, _, _, depth = form
            raw = data[at + 8 : at + 8 + size]
            if depth == 16:
                x = np.frombuffer(raw, "<i2") / 32767.0
            elif depth == 24:
                b = np.frombuffer(raw[: len(raw) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
                x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)
            elif depth == 32 and kind in (3, 0xFFFE):
                x = np.frombuffer(raw, "<f4").astype(float)
            else:
                raise ValueError(f"{depth} bits of kind {kind} aren't read")
            return rate, x[: len(x) // channels * channels].reshape(-1, channels).T
        at += 8 + size + size % 2
    raise ValueError("no samples")


def encode_wav(channels: np.ndarray, rate: int) -> bytes:
    """16-bit PCM: samples times 32767, cut to whole numbers and clamped."""
    x = np.clip(np.trunc(channels * 32767), -32768, 32767).astype("<i2").T.tobytes()
    n = len(channels)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(x), b"WAVE", b"fmt ", 16, 1, n, rate, rate * n * 2, n * 2, 16, b"data", len(x)) + x


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """WAV files as traces file:channel, with the rate: trace, idx, value, sps. Each file is read by one task in pieces of a batch."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rate, x = decode_wav(data)
                for c, row in enumerate(x):
                    for a in range(0, len(row), 1 << 16):
                        v = row[a : a + (1 << 16)]
                        yield pa.RecordBatch.from_pydict({"trace": pa.array([f"{name}:{c}"] * len(v)), "idx": pa.array(np.arange(a, a + len(v))), "value": pa.array(v), "sps": pa.array(np.full(len(v), float(rate)))})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, "trace string, idx long, value double, sps double")


def bit_traces(s: DataFrame, by: int = 1) -> DataFrame:
    """Traces bit 0 to bit 7 of samples that are byte values: of each run of `by` samples the sum of the bit."""
    byte = F.col("value").cast("int")
    bits = F.explode(F.array(*[F.struct(F.concat(F.col("trace"), F.lit(f" bit {k}")).alias("name"), F.getbit(byte, F.lit(k)).cast("double").alias("b")) for k in range(8)]))
    return s.select("trace", F.floor(F.col("idx") / by).alias("idx"), bits.alias("x")).groupBy(F.col("x.name").alias("trace"), "idx").agg(F.sum("x.b").alias("value"))


def read_features(spark: SparkSession, path: str, sps: float) -> DataFrame:
    """Lines `seconds,text` after a header as annotations: idx and text. Lines without a time are left out."""
    lines = spark.read.csv(path, header=True, schema="seconds string, text string")
    at = F.col("seconds").try_cast("double")
    return lines.where(at.isNotNull()).select((at * sps).cast("long").alias("idx"), at.alias("t"), F.coalesce("text", F.lit("")).alias("text"))


def read_json(spark: SparkSession, path: str, lines: bool | None = None) -> DataFrame:
    """JSON files as a table of texts: objects by the union of their keys (nested values as JSON), other values in a column value.

    lines says that each line is an object, so that a file is split over tasks; otherwise a file is one value, an array of rows
    or an object. Unless it is given, the first line tells: whether it is an object by itself.
    """
    if lines is None:
        first = spark.read.text(path).where("trim(value) <> ''").limit(1).select(F.expr("from_json(value, 'map<string,string>')").alias("m"), F.col("value").rlike(r"^\s*\{.*\}\s*$").alias("one")).first()
        lines = first is not None and bool(first["one"]) and first["m"] is not None
    df = spark.read.json(path, multiLine=not lines, primitivesAsString=True)
    nested = lambda f: f.dataType.simpleString().startswith(("struct", "array"))
    return df.select([(F.to_json(f.name) if nested(f) else F.col(f"`{f.name}`").cast("string")).alias(f.name) for f in df.schema.fields])


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path, ignoreNullFields=False)


#: Readers by suffix.
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    ".csv": read_table, ".tsv": lambda s, p: read_table(s, p, "\t"), ".csv.gz": read_table, ".parquet": lambda s, p: read_numeric(s, p)[0], ".wav": read_wav, ".json": read_json,
}


def read_any(spark: SparkSession, path: str) -> DataFrame:
    for suffix in sorted(READERS, key=len, reverse=True):
        if path.lower().endswith(suffix):
            return READERS[suffix](spark, path)
    raise ValueError(f"no reader for {path}")


def save_state(s: DataFrame, traces: DataFrame, path: str) -> None:
    """Samples and the traces' properties as two tables."""
    s.write.parquet(f"{path}/samples")
    traces.write.json(f"{path}/traces")


def load_state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/samples"), spark.read.json(f"{path}/traces")
