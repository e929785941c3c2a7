"""Raw typed array files as a Spark data source.

A file holds nothing but numbers; the count follows from its size. Reading cuts
files into byte ranges, one task each. Writing produces segments whose names
carry the first row number: concatenated in name order they are the plain file,
and the reader accepts such a folder as one array.

    spark.dataSource.register(RawArraySource)
    spark.read.format("rawarray").option("dtype", "float32").option("width", "3").load(path)
"""

from __future__ import annotations

import re
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage,
)

from fieldloom.operators.ranking import with_rank

# Element types of raw files and their Spark names.
DTYPES = {"float32": "float", "float64": "double", "int32": "int", "int64": "bigint"}
RENAMES = 32
"""Segments renamed at a time on commit."""
SEGMENT = re.compile(r"seg-(\d+)$")
STEP_FILE = re.compile(r"([^/]+)\.dat\.(\d+)(?:/seg-\d+)?$")


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def _files(path: str) -> list[tuple[str, int, int]]:
    """(name, size, first row) of a file, or of all files below a folder.

    Only names and sizes are listed, one entry per file or segment.
    """
    fs, inner = _open(path)
    info = fs.get_file_info(inner)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [(info.path, info.size, 0)]
    out = []
    for f in sorted(fs.get_file_info(pafs.FileSelector(inner, recursive=True)), key=lambda f: f.path):
        if f.type == pafs.FileType.File and not f.base_name.startswith(("_", ".")):
            seg = SEGMENT.search(f.base_name)
            out.append((f.path, f.size, int(seg.group(1)) if seg else 0))
    return out


@dataclass
class ByteRanges(InputPartition):
    """(file, first row, byte offset, rows) pieces read by one task."""

    pieces: list[tuple[str, int, int, int]]


class RawArrayReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.dtype = np.dtype(options.get("dtype", "float32")).newbyteorder("<")
        self.width = int(options.get("width", "1"))
        self.task_bytes = int(options.get("taskBytes", str(64 << 20)))
        self.tasks = int(options.get("tasks", "1"))
        self.steps = options.get("steps") == "true"

    def partitions(self) -> list[ByteRanges]:
        row = self.dtype.itemsize * self.width
        files = _files(self.path)
        # small arrays are spread over all cores, large ones cut at taskBytes
        even = -(-sum(size for _, size, _ in files) // self.tasks)
        per_task = max(1, min(self.task_bytes, even) // row)
        tasks: list[ByteRanges] = [ByteRanges([])]
        room = per_task
        for name, size, first in files:
            if size % row:
                raise ValueError(f"{name}: {size} bytes is no multiple of {row}")
            at, rows = 0, size // row
            while at < rows:  # cut large files, pack small ones
                n = min(room, rows - at)
                tasks[-1].pieces.append((name, first + at, at * row, n))
                at, room = at + n, room - n
                if room == 0:
                    tasks.append(ByteRanges([]))
                    room = per_task
        return tasks

    def read(self, part: ByteRanges):
        fs, _ = _open(self.path)
        row = self.dtype.itemsize * self.width
        for file, first, offset, rows in part.pieces:
            labels, names = [pa.array([file])], ["file"]
            if self.steps:  # variable and step once per piece, not per row
                found = STEP_FILE.search(file)
                if found is None:
                    raise ValueError(f"{file} is not named <var>.dat.<t>")
                labels, names = [pa.array([found[1]]), pa.array([int(found[2])], pa.int32())], ["var", "t"]
            with fs.open_input_file(file) as f:
                for done in range(0, rows, 1 << 16):
                    n = min(1 << 16, rows - done)
                    data = np.frombuffer(f.read_at(n * row, offset + done * row), self.dtype)
                    ends = np.arange(0, len(data) + 1, self.width, dtype=np.int32)
                    same = pa.array(np.zeros(n, np.int64))
                    idx = pa.array(np.arange(first + done, first + done + n))
                    vals = pa.ListArray.from_arrays(ends, pa.array(data))
                    columns = [*[label.take(same) for label in labels], idx, vals]
                    yield pa.RecordBatch.from_arrays(columns, names=[*names, "idx", "vals"])


@dataclass
class Segments(WriterCommitMessage):
    moves: list[tuple[str, str]]


class RawArrayWriter(DataSourceArrowWriter):
    """Segments under temporary names, renamed on commit, so a retried task leaves no trace.

    Rows come sorted by (file, idx); a new segment starts with every file.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"]
        self.dtype = np.dtype(options.get("dtype", "float32")).newbyteorder("<")

    def write(self, batches) -> Segments:
        fs, folder = _open(self.path)
        moves: list[tuple[str, str]] = []
        out, current, expected = None, None, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            coded = table.column("file").combine_chunks().dictionary_encode()
            names, labels = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            idx = table.column("idx").to_numpy()
            cuts = np.flatnonzero(names[1:] != names[:-1]) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(names)]):
                if lo == hi:
                    continue
                if labels[names[lo]] != current:
                    if out is not None:
                        out.close()
                    current, expected = labels[names[lo]], int(idx[lo])
                    home = f"{folder}/{current}" if current else folder
                    fs.create_dir(home, recursive=True)
                    moves.append((f"{home}/_tmp-{uuid.uuid4().hex}", f"{home}/seg-{expected:018d}"))
                    out = fs.open_output_stream(moves[-1][0])
                run = idx[lo:hi]
                if run[0] != expected or (np.diff(run) != 1).any():
                    raise ValueError("rows of a segment must be consecutive by idx")
                expected = int(run[-1]) + 1
                vals = table.column("vals").slice(lo, hi - lo).combine_chunks().flatten()
                out.write(vals.to_numpy(zero_copy_only=False).astype(self.dtype).tobytes())
        if out is not None:
            out.close()
        return Segments(moves)

    def commit(self, messages) -> None:
        fs, _ = _open(self.path)
        moves = [move for m in messages if m for move in m.moves]
        with ThreadPoolExecutor(RENAMES) as pool:  # renames wait for the store, not for this process
            list(pool.map(lambda move: fs.move(*move), moves))

    def abort(self, messages) -> None:
        fs, _ = _open(self.path)
        for m in messages:
            for temporary, _final in m.moves if m else ():
                fs.delete_file(temporary)


class RawArraySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rawarray"

    def schema(self) -> str:
        label = "var string, t int" if self.options.get("steps") == "true" else "file string"
        return f"{label}, idx bigint, vals array<{DTYPES[self.options.get('dtype', 'float32')]}>"

    def reader(self, schema) -> RawArrayReader:
        return RawArrayReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> RawArrayWriter:
        return RawArrayWriter(dict(self.options), overwrite)


def read_raw(spark: SparkSession, path: str, dtype: str = "float32", width: int = 1, steps: bool = False) -> DataFrame:
    """(file, idx, vals) of one file or of all files and segments below a folder; with
    ``steps`` (var, t, idx, vals) of files named <var>.dat.<t>."""
    spark.dataSource.register(RawArraySource)
    options = dict(path=path, dtype=dtype, width=str(width), tasks=str(spark.sparkContext.defaultParallelism))
    return spark.read.format("rawarray").options(**options, steps=str(steps).lower()).load()


def _write(rows: DataFrame, path: str, dtype: str) -> None:
    """Write (file, idx, vals); every task gets a consecutive range of (file, idx)."""
    spark = rows.sparkSession
    spark.dataSource.register(RawArraySource)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.select("file", "idx", "vals").repartitionByRange(n, "file", "idx")
    ranged = ranged.sortWithinPartitions("file", "idx")
    ranged.write.format("rawarray").mode("append").options(path=path, dtype=dtype).save()


def write_raw(df: DataFrame, path: str, dtype: str = "float32", order: str = "idx") -> None:
    """Write (order column, vals) as consecutive segments in ascending order."""
    ranked = with_rank(df.select(F.col(order).alias("_o"), "vals"), ["_o"], "idx")
    _write(ranked.withColumn("file", F.lit("")), path, dtype)


def write_steps(field: DataFrame, folder: str, dtype: str = "float32") -> None:
    """Write (var, vid, vals-per-step) as <var>.dat.<t>, all steps in one job.

    Vertex ids must be 0..n-1; the writer rejects gaps.
    """
    long = field.select("var", F.col("vid").alias("idx"), F.posexplode("vals").alias("t", "val"))
    named = F.concat("var", F.lit(".dat."), F.col("t").cast("string"))
    _write(long.select(named.alias("file"), "idx", F.array("val").alias("vals")), folder, dtype)


def read_steps(spark: SparkSession, folder: str, dtype: str = "float32") -> DataFrame:
    """(var, t, vid, val) of all <var>.dat.<t> arrays in a folder."""
    return read_raw(spark, folder, dtype, steps=True).select(
        "var", "t", F.col("idx").alias("vid"), F.col("vals")[0].alias("val")
    )
