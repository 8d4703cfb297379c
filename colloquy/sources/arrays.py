"""Arrays in .npy and .npz files beside tables: a data source of row ranges, embeddings beside their lines, and bundles.

The data source opens files through pyarrow, so a path may be local or lie in any store that pyarrow knows.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .ordered import numbered_lines

ROWS = "file string, row long, x array<double>"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def npy_files(path: str) -> list[str]:
    """The .npy files at a path: itself, those in a folder, or those below the folder before /**, in order."""
    store, at = opened(path)
    deep = at.endswith("/**")
    info = store.get_file_info(at.removesuffix("/**"))
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [info.path]
    return sorted(f.path for f in store.get_file_info(fs.FileSelector(info.path, recursive=deep)) if f.type == fs.FileType.File and f.path.endswith(".npy"))


def npy_header(stream) -> tuple[tuple[int, ...], np.dtype, int]:
    """(shape, kind, bytes before the data) of an array file; it must hold numbers, row after row."""
    version = np.lib.format.read_magic(stream)
    shape, columns, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(stream)
    if len(shape) != 2 or columns and min(shape) > 1 or kind.kind not in "fiu":
        raise ValueError(f"no matrix of numbers in rows: shape {shape}, {'columns first, ' if columns else ''}{kind}")
    return shape, kind, stream.tell()


@dataclass
class Range(InputPartition):
    """Rows of a file."""

    file: str
    first: int
    n: int
    width: int
    kind: str
    offset: int


class NpyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.rows = options["path"], int(options.get("rowspartition", 100_000))

    def partitions(self) -> list[Range]:
        store, _ = opened(self.path)
        out = []
        for f in npy_files(self.path):
            with store.open_input_file(f) as stream:
                (n, width), kind, offset = npy_header(stream)
            out += [Range(f, lo, min(self.rows, n - lo), width, kind.str, offset) for lo in range(0, n, self.rows)]
        return out or [Range("", 0, 0, 0, "<f8", 0)]

    def read(self, p: Range) -> Iterator[pa.RecordBatch]:
        if not p.n:
            return
        store, kind = opened(self.path)[0], np.dtype(p.kind)
        with store.open_input_file(p.file) as stream:
            stream.seek(p.offset + p.first * p.width * kind.itemsize)
            step = max(1, (8 << 20) // max(1, p.width * kind.itemsize))
            for lo in range(0, p.n, step):
                n = min(step, p.n - lo)
                x = np.frombuffer(stream.read(n * p.width * kind.itemsize), dtype=kind).astype(float)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * p.width, pa.int32()), pa.array(x))
                yield pa.RecordBatch.from_arrays([pa.array([p.file] * n), pa.array(np.arange(p.first + lo, p.first + lo + n)), lists], names=["file", "row", "x"])


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class NpyWriter(DataSourceArrowWriter):
    """A file for each task that has rows; tasks write under names of their own, and what an aborted job wrote is removed."""

    def __init__(self, options: dict, column: str):
        self.path, self.column = options["path"], column

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        parts = [b.column(b.schema.names.index(self.column)) for b in batches if b.num_rows]
        if not parts:
            return Written([])
        x = np.concatenate([p.flatten().to_numpy(zero_copy_only=False).reshape(len(p), -1) for p in parts])
        store, folder = opened(self.path)
        store.create_dir(folder, recursive=True)
        name = f"{folder.rstrip('/')}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.npy"
        held = io.BytesIO()
        np.save(held, x)
        with store.open_output_stream(name) as out:
            out.write(held.getbuffer())
        return Written([name])

    def commit(self, messages: list) -> None:
        pass

    def abort(self, messages: list) -> None:
        store, _ = opened(self.path)
        for m in messages:
            for f in m.files if m else []:
                store.delete_file(f)


class NpySource(DataSource):
    """format("npy"): reads ROWS from .npy files (option rowsPartition: rows that a task reads), writes the array column of a table."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options)

    def writer(self, schema, overwrite: bool) -> NpyWriter:
        arrays = [f.name for f in schema.fields if f.dataType.typeName() == "array"]
        if len(arrays) != 1:
            raise ValueError(f"one column of arrays is written, not {arrays}")
        return NpyWriter(self.options, arrays[0])


def read_npy(spark: SparkSession, path: str, rows: int = 100_000) -> DataFrame:
    spark.dataSource.register(NpySource)
    return spark.read.format("npy").option("rowsPartition", rows).load(path)


def write_npy(df: DataFrame, path: str) -> None:
    df.sparkSession.dataSource.register(NpySource)
    df.write.format("npy").mode("append").save(path)


def stem(file) -> F.Column:
    """A file's path without its scheme and extension."""
    return F.regexp_replace(F.regexp_replace(file, "^[a-z]+:(//)?", ""), r"\.[^./]*$", "")


def with_lines(arrays: DataFrame, lines: DataFrame) -> DataFrame:
    """(file, row, x, value): arrays (ROWS) beside numbered_lines of the same stem. Files of unequal length, or without the other, are an error when rows are read."""
    a, b = arrays.withColumn("file", stem(F.col("file"))), lines.withColumn("file", stem(F.col("file")))
    counts = a.groupBy("file").agg(F.count("*").alias("n")).join(b.groupBy("file").agg(F.count("*").alias("m")), "file", "full")
    differs = F.coalesce("n", F.lit(0)) != F.coalesce("m", F.lit(0))
    told = F.concat(F.lit("rows and lines differ in "), F.col("file"), F.lit(": "), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" and "), F.coalesce("m", F.lit(0)).cast("string"))
    checked = counts.select("file", F.when(differs, F.raise_error(told).cast("boolean")).otherwise(True).alias("ok"))
    # full joins, so that a file that only one side has is seen, too
    return a.join(b, ["file", "row"], "full").join(checked, "file", "full").where("ok").select("file", "row", "x", "value")


def embeddings(spark: SparkSession, arrays: str, lines: str, rows: int = 100_000) -> DataFrame:
    """Vectors of .npy files with the JSON lines of the files beside them."""
    return with_lines(read_npy(spark, arrays, rows), numbered_lines(spark, lines))


def pair_outputs(spark: SparkSession, root: str, name: str = "response_matrix") -> DataFrame:
    """(rollout, questionnaire, row, x, value) of <root>/<rollout>/<questionnaire>/<name>.npy and the lines of the .jsonl beside it."""
    found = with_lines(read_npy(spark, f"{root.rstrip('/')}/**").where(F.col("file").endswith(f"/{name}.npy")), numbered_lines(spark, f"{root.rstrip('/')}/*/*/{name}.jsonl"))
    at = F.split("file", "/")
    return found.select(F.element_at(at, -3).alias("rollout"), F.element_at(at, -2).alias("questionnaire"), "row", "x", "value")


# --- bundles -------------------------------------------------------------------------------------------------------

BUNDLE = "file string, name string, shape array<int>, x array<double>"


def save_bundle(path: str, arrays: dict[str, np.ndarray | None], config: dict | None = None) -> None:
    """A factor solution as <path>.npz and <path>.json: its arrays (those that are None are only named) and its settings. A solution holds no row of the data."""
    store, at = opened(path)
    store.create_dir(at.rpartition("/")[0], recursive=True)
    held = io.BytesIO()
    np.savez_compressed(held, **{k: v for k, v in arrays.items() if v is not None})
    told = {"arrays": [k for k, v in arrays.items() if v is not None], "absent": [k for k, v in arrays.items() if v is None], "config": config}
    for end, content in ((".npz", held.getvalue()), (".json", json.dumps(told, indent=2).encode())):
        with store.open_output_stream(at + end) as out:
            out.write(content)


def read_bundles(spark: SparkSession, pattern: str) -> DataFrame:
    """BUNDLE rows of all .npz files that a pattern matches: each array with its shape, its numbers row after row. Files are read by tasks."""

    def run(batches):
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1)):
                with np.load(io.BytesIO(content.as_py()), allow_pickle=False) as held:
                    for name in held.files:
                        x = held[name]
                        yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([name]), pa.array([list(x.shape)], pa.list_(pa.int32())), pa.array([x.astype(float).ravel().tolist()], pa.list_(pa.float64()))], names=["file", "name", "shape", "x"])

    return spark.read.format("binaryFile").load(pattern).select("path", "content").mapInArrow(run, BUNDLE)


def bundle_configs(spark: SparkSession, pattern: str) -> DataFrame:
    """(file, config as VARIANT, absent) of the .json beside each bundle."""
    own = spark.read.schema("arrays array<string>, absent array<string>, config variant").option("multiLine", True).json(pattern)
    return own.select(F.col("_metadata.file_path").alias("file"), "config", "absent")
