"""Helpers the operators share: Arrow text buffers, bounded slices, free column names, files."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.session import ship_package

SLICE_BYTES = 1 << 20
"""Text that one numpy step holds at a time; a single longer text is one slice of its own."""


STEP = 0x9E3779B97F4A7C15
"""Odd base of the polynomial hashes; its inverse modulo 2**64 exists."""
CHUNK = 1 << 20
"""Values under one prefix sum; a single longer span has one of its own."""


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, row offsets, valid) of a string array, without copying; a null row is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    valid = np.asarray(texts.is_valid())
    if not valid.all():  # a null slot may still own bytes
        if (np.diff(at)[~valid] > 0).any():
            return utf8(texts.fill_null(""))[:2] + (valid,)
    return raw, at, valid


def slices(at: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows whose bytes fit ``limit``; a larger row comes alone."""
    n, lo = len(at) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def codepoints(raw: np.ndarray, at: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(code points, row offsets) of rows lo..hi."""
    part = raw[at[lo] : at[hi]]
    points = np.frombuffer(part.tobytes().decode("utf-8").encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
    return points, starts[at[lo : hi + 1] - at[lo]]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of STEP and of its inverse modulo 2**64."""
    out = []
    for base in (STEP, pow(STEP, -1, 1 << 64)):
        p = np.full(n + 1, base, np.uint64)
        p[0] = 1
        with np.errstate(over="ignore"):
            out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for ascending spans, from one prefix sum per chunk."""
    out = np.empty(len(starts), np.uint64)
    lo = 0
    with np.errstate(over="ignore"):
        while lo < len(starts):
            hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + CHUNK, side="right")))
            a, b = int(starts[lo]), int(ends[hi - 1])
            up, down = _powers(CHUNK) if b - a <= CHUNK else _powers.__wrapped__(b - a)
            prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[a:b] * up[: b - a], dtype=np.uint64)])
            s, e = starts[lo:hi] - a, ends[lo:hi] - a
            out[lo:hi] = (prefix[e] - prefix[s]) * down[s] + (e - s).astype(np.uint64)
            lo = hi
    return mix64(out)


_WS = np.zeros(256, bool)
_WS[[32, 9, 10, 11, 12, 13]] = True


def word_spans(b: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the words of rows of UTF-8 text, cut at ASCII white space;
    ``at`` are byte offsets from 0, and no word runs on into the next row."""
    word = ~_WS[b]
    cut = np.zeros(len(b) + 1, bool)
    cut[at] = True
    starts = np.flatnonzero(word & (~np.concatenate([[False], word[:-1]]) | cut[:-1]))
    ends = np.flatnonzero(word & (~np.concatenate([word[1:], [False]])[: len(b)] | cut[1:])) + 1
    return starts, ends, np.searchsorted(at, starts, side="right") - 1


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name in taken:
        name += "_"
    return name


def with_result(df: DataFrame, result: Column, stem: str) -> tuple[DataFrame, str]:
    """``df`` with ``result`` under a free name, and that name."""
    name = free_name(df, stem)
    return df.withColumn(name, result), name


def asset(spark: SparkSession, path: str, most: int = 64 << 20):
    """Broadcast of a fixed vocabulary file, whose size is checked first."""
    size = os.path.getsize(path)
    if size > most:
        raise ValueError(f"{path} has {size} bytes; at most {most} are sent to every executor")
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


BATCH_ROWS = 1000
"""Rows per Arrow batch where the session leaves Spark's default (10,000): with texts of some
kilobytes, larger batches only make every Python worker and its JVM buffers larger."""


def prepare(spark: SparkSession) -> None:
    """Send the package to the workers, and choose batches that suit texts."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def text(col: str | Column) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("string")
