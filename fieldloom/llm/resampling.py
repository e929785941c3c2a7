"""Importance resampling towards a target distribution, ranked by a distributed radix sort.

Features are hashed into buckets, counted over the source and the target, and every
document is scored with the mean log ratio of its buckets plus Gumbel noise from its id.
The highest scores are a draw without replacement.

Features are hashed in numpy: the CRC-32 of two words and a blank follows from those of the
words, since appending n bytes acts on the register as a linear map that depends on n only.

The sort is least-significant-digit first. A pass is a stable counting sort: rows per
(digit, block of positions) are counted, exclusive prefix sums over digits and blocks give
where each run starts, and a row's destination is its place inside the run behind that.
Blocks are consecutive positions, so runs stay in order. Destinations of the last pass are
the ranks. Digits all rows share are not sorted by: the key's span decides on the passes.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, LongType, StructField, StructType

from fieldloom.llm.common import slices, text, utf8
from fieldloom.session import materialize

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 25
SEED = 7

DIGIT_BITS = 12
BLOCK = 1 << 20
"""Most positions in a block of a sort pass; smaller tables have as many blocks as tasks."""
LEAST_BLOCK = 1 << 12
LONG_WORD = 64
"""Bytes of a word that are hashed column by column; longer words are hashed one by one."""

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_TABLE = np.array([zlib.crc32(bytes([i ^ 0xFF])) ^ 0xFF000000 for i in range(256)], np.uint32)


@lru_cache(1)
def _appended() -> np.ndarray:
    """[n, byte of the register, value]: the register after n more bytes, for one byte of it."""
    out = np.empty((LONG_WORD + 1, 4, 256), np.uint32)
    for n in range(LONG_WORD + 1):
        zeros = bytes(n)
        base = zlib.crc32(zeros)
        out[n] = [[zlib.crc32(zeros, v << 8 * k) ^ base for v in range(256)] for k in range(4)]
    return out


def _word_crcs(b: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of every word, one byte of all of them at a time."""
    by = np.argsort(-size, kind="stable")
    at, n = starts[by], size[by]
    whole = int(np.searchsorted(-n, -LONG_WORD))  # words before that are longer
    c = np.full(len(by), 0xFFFFFFFF, np.uint32)
    at, short = at[whole:], n[whole:]
    for j in range(int(short[0]) if len(short) else 0):
        live = int(np.searchsorted(-short, -j))
        part = c[whole : whole + live]
        c[whole : whole + live] = _TABLE[(part ^ b[at[:live] + j]) & 0xFF] ^ (part >> np.uint32(8))
    out = np.empty(len(by), np.uint32)
    out[by] = ~c
    for i in by[:whole].tolist():
        out[i] = zlib.crc32(b[starts[i] : starts[i] + size[i]])
    return out


def features(raw: np.ndarray, at: np.ndarray, lo: int, hi: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words of every row's end, buckets of the words; pairs of every row's end, buckets of the pairs)."""
    b = raw[at[lo] : at[hi]]
    upper = (b >= 0x41) & (b <= 0x5A)
    b = np.where(upper, b | 0x20, b)
    word = _WORD[b]
    cut = np.zeros(len(b) + 1, bool)
    cut[at[lo : hi + 1] - at[lo]] = True
    starts = np.flatnonzero(word & (~np.concatenate([[False], word[:-1]]) | cut[:-1]))
    ends = np.flatnonzero(word & (~np.concatenate([word[1:], [False]])[: len(b)] | cut[1:])) + 1
    size = ends - starts
    one = _word_crcs(b, starts, size)
    words = np.searchsorted(starts, at[lo : hi + 1] - at[lo])
    blank = ~(_TABLE[(~one[:-1] ^ np.uint32(32)) & 0xFF] ^ (~one[:-1] >> np.uint32(8)))  # of a word and a blank
    tail = size[1:]
    tables, n = _appended(), np.minimum(tail, LONG_WORD)
    two = one[1:].copy()
    for k in range(4):
        two ^= tables[n, k, (blank >> np.uint32(8 * k)) & 0xFF]
    for i in np.flatnonzero(tail > LONG_WORD).tolist():
        two[i] = zlib.crc32(b[starts[i + 1] : ends[i + 1]], int(blank[i]))
    inside = np.ones(max(0, len(starts) - 1), bool)
    border = words[(words > 0) & (words < len(starts))] - 1
    inside[border] = False
    pairs = np.concatenate([[0], np.cumsum(inside)])[np.clip(words - 1, 0, None)] if len(starts) > 1 else np.zeros(len(words), np.int64)
    # the pair that would straddle a row's end is not inside, so counting up to the last word of a row is right
    return words, (one % np.uint32(buckets)).astype(np.int64), pairs, (two[inside] % np.uint32(buckets)).astype(np.int64)


def bucket_counts(texts: DataFrame, text_col: str, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over a whole table: one dense vector per task, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            raw, at, _ = utf8(batch.column(0))
            for lo, hi in slices(at):
                _, one, _, two = features(raw, at, lo, hi, buckets)
                total += np.bincount(one, minlength=buckets) + np.bincount(two, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": seen, "n": total[seen]})

    rows = texts.select(text(text_col)).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(((t + 1) / (T + buckets)) / ((s + 1) / (S + buckets)))) of every bucket."""
    k, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    ratio = ((target + 1.0) * (s_all + k)) / ((source + 1.0) * (t_all + k))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio.tolist()], np.int64)


def noise(key: str, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, from the first 32 bits of a hash of the id."""
    h = int(sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str, seed: int) -> DataFrame:
    """(uid, id, n_words, n_features, weight, score), written once; uid ascends within a task."""
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), text(text_col).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(gain)  # one number per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = held.value
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, keys, texts = batch.columns
            raw, at, _ = utf8(texts)
            for lo, hi in slices(at):
                words, one, pairs, two = features(raw, at, lo, hi, len(gain))
                total = sum(np.diff(np.concatenate([[0], np.cumsum(gain[f])])[ends]) for f, ends in ((one, words), (two, pairs)))
                n = np.diff(words) + np.diff(pairs)
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                luck = np.array([noise(k, seed) for k in keys[lo:hi].to_pylist()], np.int64)
                columns = [np.arange(uid, uid + hi - lo), ids[lo:hi], np.diff(words), n, weight, weight + luck]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["uid", "id", *_SCORED])
                uid += hi - lo

    kinds = [StructField(c, LongType()) for c in ("uid", *_SCORED)]
    return materialize(slim.mapInArrow(run, StructType([kinds[0], slim.schema["id"], *kinds[1:]])), "resampling")


_SCORED = ("n_words", "n_features", "weight", "score")


def _span(lo: int, hi: int, value: Column, up: bool) -> tuple[Column, int]:
    """``value`` as a key from 0 (``up``: ascending), and the number of its bits."""
    if hi - lo < 1 << 63:
        return (value - F.lit(lo) if up else F.lit(hi) - value), (hi - lo).bit_length()
    flipped = value.bitwiseXOR(F.lit(-(1 << 63)))
    return (flipped if up else F.bitwise_not(flipped)), 64


def radix_ranks(rows: DataFrame, order: list[tuple[str, bool]], digit_bits: int = DIGIT_BITS, block: int | None = None) -> tuple[DataFrame, int]:
    """(uid, rank) from 1 in the order of integer columns, (name, ascending) with the most
    significant first and nulls last, and the number of rows; equal rows keep the order of ``uid``."""
    spans = [a for c, _ in order for a in (F.min(c), F.max(c), F.count_if(F.col(c).isNull()))]
    lo_hi = rows.agg(F.count(F.lit(1)), *spans).first()
    total = lo_hi[0]
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = block or min(BLOCK, max(LEAST_BLOCK, total // tasks))
    keys, passes = [], []  # passes: (column, shift), least significant first
    for i, (c, up) in enumerate(order):
        lo, hi, nulls = lo_hi[1 + 3 * i : 4 + 3 * i]
        if lo is None:
            continue
        key, bits = _span(lo, hi, F.col(c), up)
        keys += [F.coalesce(key, F.lit(0)).alias(f"k{i}"), F.col(c).isNull().cast("bigint").alias(f"null{i}")]
        mine = [(f"k{i}", s) for s in range(0, bits, digit_bits)] + ([(f"null{i}", 0)] if nulls else [])
        passes = mine + passes
    now = rows.select("uid", F.shiftrightunsigned("uid", 40).alias("block"), F.col("uid").alias("pos"), *keys)
    for column, shift in passes or [(F.lit(0), 0)]:
        value = F.col(column) if isinstance(column, str) else column
        digit = F.shiftrightunsigned(value, shift).bitwiseAND(F.lit((1 << digit_bits) - 1)).cast("int")
        marked = now.withColumn("digit", digit)
        counts = marked.groupBy("digit", "block").agg(F.count(F.lit(1)).alias("n"))
        before = Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        inner = counts.select("digit", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("inner"))
        # one row per digit, 2 ** digit_bits at most
        smaller = Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
        sums = marked.groupBy("digit").agg(F.count(F.lit(1)).alias("n"))
        outer = sums.select("digit", F.coalesce(F.sum("n").over(smaller), F.lit(0)).alias("outer"))
        offsets = inner.join(F.broadcast(outer), "digit").select("digit", "block", (F.col("inner") + F.col("outer")).alias("start"))
        run = Window.partitionBy("digit", "block").orderBy("pos")
        placed = marked.withColumn("place", F.row_number().over(run) - 1).join(offsets, ["digit", "block"])
        pos = F.col("start") + F.col("place")
        kept = [c for c in now.columns if c not in ("block", "pos")]
        now = materialize(placed.select(*kept, F.floor(pos / F.lit(block)).cast("bigint").alias("block"), pos.alias("pos")), "radix")
    return now.select("uid", (F.col("pos") + 1).alias("rank")), total


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
    buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """(id_col, n_features, weight, score, rank): one row per row of ``docs``.

    Of the documents with at least ``min_words`` words, ``percent`` in a hundred are drawn:
    those of the highest scores, ties to the smaller id; ``rank`` counts them from 1 and is
    null for others. Features are the words and pairs of neighbouring words of whole texts,
    repeats included; null, empty and wordless texts have none and weight 0. Ids are integers.
    A null id is hashed as an empty string and comes after all others in a tie; rows that
    share id and score take their ranks in the order they are read. Other columns are ignored.
    """
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} is not an integer column")
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_text, buckets))
    rows = scored(docs, gain, id_col, text_col, seed)
    ranks, total = radix_ranks(rows.where(F.col("n_words") >= min_words), [("score", False), ("id", True)])
    drawn = ranks.where(F.col("rank") <= percent * total // 100)
    out = rows.join(drawn, "uid", "left")
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", F.col("rank").cast("bigint").alias("rank"))
