"""Line dedup over a whole corpus by range-partitioned line hashes.

A line's key is the line with white space stripped at both ends and A-Z lower-cased. Keys
of at least ``MIN_POINTS`` code points become two 64-bit hashes, and rows (hashes, document,
line number) are range-partitioned and sorted with the largest document first. One stream
over a range sees all lines of a key together: the first document is the one that keeps
them, and the key's documents are counted as they pass. A key that may run on into a
neighbouring range (the first and the last of a range) is left open; its parts, two per
range at most, are put together afterwards. So a key that holds most of the lines is spread
over many ranges, and no text is moved: the result is a compressed bitmap per document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from fieldloom.llm.common import free_name, text
from fieldloom.session import broadcast_if_small, materialize

MIN_POINTS = 20
MIN_DOCS = 3
BLANKS = "\t\n\x0b\x0c\r "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(texts: Column) -> Column:
    r"""The lines of a text, split at \n; a null text is one empty line."""
    return F.split(F.coalesce(texts, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _print(texts: Column) -> Column:
    """What tells the texts of one id apart (rows of equal id and text have equal lines)."""
    return F.xxhash64(F.coalesce(texts, F.lit("")))


def hashed_lines(docs: DataFrame, id_col: str, text_col: str, min_points: int) -> DataFrame:
    """(doc, fp, pos, h1, h2): every line whose key is long enough."""
    said = text(text_col)
    lines = docs.select(F.col(id_col).alias("doc"), _print(said).alias("fp"), F.posexplode(lines_of(said)).alias("pos", "line"))
    keyed = lines.where(F.length("line") >= min_points).select("doc", "fp", "pos", key_of(F.col("line")).alias("k"))
    long_enough = keyed.where(F.length("k") >= min_points)
    return long_enough.select("doc", "fp", "pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(1), "k").alias("h2"))


DROP, OPEN, PART = 0, 1, 2
"""Rows of a stream: a line to drop; a line of an open key, undecided; an open key of a
range with its first and last document and their number."""


class _Key:
    """The key a stream stands in. A border key may have begun in an earlier range."""

    def __init__(self, h1: int, h2: int, first, border: bool):
        self.h1, self.h2, self.first, self.border = h1, h2, first, border
        self.last, self.n = first, 0
        self.held: list[tuple] = []  # lines after the first document's, while the key is not yet common


def _changes(values: pa.Array) -> np.ndarray:
    """Where a value differs from the one before it (null equals null); the first does."""
    out = np.ones(len(values), bool)
    unlike = pc.fill_null(pc.not_equal(values[1:], values[:-1]), False).to_numpy(zero_copy_only=False)
    gone = values.is_null().to_numpy(zero_copy_only=False)
    out[1:] = unlike | (gone[1:] != gone[:-1])
    return out


def stream(batches: Iterator[pa.RecordBatch], schema: pa.Schema, min_docs: int, place: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``schema`` for one range of lines sorted by key, document (largest first)
    and line. Memory holds one batch and, of one key, the lines of fewer than ``min_docs`` documents."""

    def told(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([r | {"range": place} for r in rows], schema=schema)

    def part(k: _Key) -> dict:
        return {"kind": PART, "h1": k.h1, "h2": k.h2, "doc": k.first, "last": k.last, "n": k.n}

    def picked(batch: pa.RecordBatch, at: np.ndarray, kind: int) -> pa.RecordBatch:
        taken = batch.take(pa.array(at))
        fixed = {"kind": pa.array(np.full(len(at), kind, np.int32)), "range": pa.array(np.full(len(at), place, np.int32))}
        have = {c: taken.column(c) for c in taken.schema.names}
        return pa.RecordBatch.from_arrays([fixed.get(f.name, have.get(f.name, pa.nulls(len(at), f.type))) for f in schema], schema=schema)

    now: _Key | None = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        h1, h2, doc = batch.column("h1").to_numpy(), batch.column("h2").to_numpy(), batch.column("doc")
        runs_on = now is not None and (now.h1, now.h2) == (h1[0], h2[0])
        new_key = _changes(batch.column("h1")) | _changes(batch.column("h2"))
        new_doc = new_key | _changes(doc)
        new_doc[0] = not runs_on or now.last != doc[0].as_py()
        starts = np.flatnonzero(new_key)
        ends = np.append(starts[1:], n)
        key = np.cumsum(new_key) - 1
        seen = np.cumsum(new_doc)
        base = seen[starts] - 1
        if runs_on:
            base[0] = -now.n
        count = seen - base[key]  # documents of the key up to a row
        total = count[ends - 1]
        if now is not None and not runs_on and now.border:
            yield told([part(now)])
        if runs_on and now.held and total[0] >= min_docs:
            yield told(now.held)
            now.held = []
        drop = (count > 1) & (total[key] >= min_docs)
        open_first = now is None or runs_on and now.border
        if open_first:
            drop[: ends[0]] = False
            yield picked(batch, np.arange(ends[0]), OPEN)
        yield picked(batch, np.flatnonzero(drop), DROP)
        for i in dict.fromkeys((0, len(starts) - 1)):  # the first key may be a border, the last runs on
            at, end = int(starts[i]), int(ends[i])
            k = now if i == 0 and runs_on else _Key(int(h1[at]), int(h2[at]), doc[at].as_py(), i == 0 and open_first)
            k.n, k.last = int(total[i]), doc[end - 1].as_py()
            if i < len(starts) - 1:
                if k.border:
                    yield told([part(k)])
                continue
            if not k.border and k.n < min_docs:
                late = (at + np.flatnonzero(count[at:end] > 1)).tolist()
                k.held += [{"kind": DROP, **{c: batch.column(c)[j].as_py() for c in ("h1", "h2", "doc", "fp", "pos")}} for j in late]
            now = k
    if now is not None:
        yield told([{**r, "kind": OPEN} for r in now.held] + [part(now)])


def dropped_lines(docs: DataFrame, id_col: str, text_col: str, min_points: int, min_docs: int) -> DataFrame:
    """(doc, fp, pos) of the lines to drop."""
    spark = docs.sparkSession
    lines = hashed_lines(docs, id_col, text_col, min_points)
    order = ["h1", "h2", F.desc_nulls_last("doc"), "fp", "pos"]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    doc = lines.schema["doc"].dataType
    fields = [
        ("kind", IntegerType()), ("range", IntegerType()), ("h1", LongType()), ("h2", LongType()), ("doc", doc),
        ("fp", LongType()), ("pos", IntegerType()), ("last", doc), ("n", LongType()),
    ]
    out = StructType([StructField(n, t) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None

        def typed() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        first = next(iter(batches), None)
        if first is not None:
            kind = first.schema.field("doc").type
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), kind, pa.int64(), pa.int32(), kind, pa.int64()]
            schema = pa.schema(list(zip((n for n, _ in fields), types)))
            yield from stream(typed(), schema, min_docs, TaskContext.get().partitionId())

    sorted_lines = lines.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    rows = materialize(sorted_lines.mapInArrow(run, out), "lines")
    by_key = Window.partitionBy("h1", "h2").orderBy("range")
    parts = rows.where(F.col("kind") == PART).select(
        "h1", "h2", "range", "doc", "n", (F.row_number().over(by_key) > 1).alias("later"), F.lag("last").over(by_key).eqNullSafe(F.col("doc")).alias("same")
    )
    keys = parts.groupBy("h1", "h2").agg(
        (F.sum("n") - F.count_if(F.col("later") & F.col("same"))).alias("docs"), F.min_by(F.struct("doc"), "range").alias("keeper")
    )
    common = keys.where(F.col("docs") >= min_docs).select("h1", "h2", "keeper")
    undecided = rows.where(F.col("kind") == OPEN).join(broadcast_if_small(common), ["h1", "h2"])
    late = undecided.where(~F.col("doc").eqNullSafe(F.col("keeper.doc"))).select("doc", "fp", "pos")
    return rows.where(F.col("kind") == DROP).select("doc", "fp", "pos").unionByName(late)


@F.arrow_udf(BinaryType())
def _bitmap(positions: pa.Array) -> pa.Array:
    def one(at: np.ndarray) -> bytes:
        keep = np.ones(int(at.max()) + 1, bool)
        keep[at] = False
        return zlib.compress(np.packbits(keep, bitorder="little").tobytes() + bytes([-len(keep) % 8]))

    return pa.array([one(p.values.to_numpy()) for p in positions], pa.binary())


def keep_flags(bitmap: bytes, n: int) -> np.ndarray:
    """Which of ``n`` lines stay; lines beyond the bitmap do."""
    data = zlib.decompress(bitmap)
    bits = np.unpackbits(np.frombuffer(data[:-1], np.uint8), bitorder="little")[: 8 * (len(data) - 1) - data[-1]]
    out = np.ones(n, bool)
    out[: len(bits)] = bits
    return out


def bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(id_col, fp, n_dropped, keep): one row per id and text that loses lines.

    Keys of at least ``min_points`` code points in at least ``min_docs`` documents lose their
    lines except in the largest id that holds them, where all stay. ``keep`` is a compressed
    bitmap up to the last dropped line (``keep_flags``), ``fp`` the 64-bit hash of the text.
    Rows that share an id are one document, and a null id is one document smaller than all
    others; rows equal in id and text share a row here. Null and empty texts are one empty
    line. Texts are split whole, however long. Other columns are ignored.
    """
    gone = dropped_lines(docs, id_col, text_col, min_points, min_docs)
    per = gone.groupBy("doc", "fp").agg(F.collect_set("pos").alias("at"))
    marked = per.select(F.col("doc").alias(id_col), "fp", F.size("at").cast("long").alias("n_dropped"), _bitmap("at").alias("keep"))
    return materialize(marked, "line-bitmaps")


@F.arrow_udf(StringType())
def _kept(texts: pa.Array, keeps: pa.Array) -> pa.Array:
    def one(said: str, keep: bytes) -> str:
        lines = said.split("\n")
        return "\n".join(x for x, stays in zip(lines, keep_flags(keep, len(lines)).tolist()) if stays)

    return pa.array([None if k.as_py() is None else one(t.as_py(), k.as_py()) for t, k in zip(texts, keeps)], pa.string())


def apply(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows and columns of ``docs`` with the lines of ``text_col`` that ``found`` (from
    ``bitmaps``) keeps, and columns n_lines (before) and n_dropped, replaced if there.

    A null text that loses nothing stays null.
    """
    fp = free_name(docs, "lines")
    said = text(text_col)
    slim = found.select(F.col(id_col).alias("_doc"), F.col("fp").alias("_fp"), F.col("n_dropped").alias("_n"), F.col("keep").alias("_keep"))
    mine = docs.withColumn(fp, _print(said)).alias("d")
    both = mine.join(slim.alias("f"), F.col(f"d.{id_col}").eqNullSafe(F.col("f._doc")) & (F.col(f"d.{fp}") == F.col("f._fp")), "left")
    said, keep = text(F.col(f"d.{text_col}")), F.col("f._keep")
    left = F.when(keep.isNotNull(), _kept(F.when(keep.isNotNull(), said), keep)).otherwise(said)
    columns = {c: F.col(f"d.{c}") for c in docs.columns}
    columns |= {text_col: left, "n_lines": F.size(lines_of(said)).cast("long"), "n_dropped": F.coalesce(F.col("f._n"), F.lit(0))}
    return both.select(*[v.alias(c) for c, v in columns.items()])
