"""Nearest neighbours by multi-index hashing over learned rotated binary codes.

Vectors are lifted so that the largest inner product becomes the smallest angle, and
coded by the signs of learned rotations (iterative quantisation on a bounded sample).
A code is cut into substrings, each with its own index. By the pigeonhole principle a
code within ``radius`` bits of the query has a substring within radius / substrings
bits, so probing every index up to there retrieves every code in the radius; whole codes
are then verified and the vectors behind them reranked in double precision.

The index is dealt into blocks of rows, and so are the queries; every query block meets
every index block in a task of its own, so neither side is collected and the work
spreads over blocks x blocks tasks. Each task hands on at most k rows a query. The
radius is learned too: within it lie RECALL of the nearest neighbours of sampled queries.
A query that has fewer than k codes in the radius is searched in full within the block,
so the bound never costs it neighbours.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.session import materialize

SAMPLE = 8192
"""Vectors (of smallest hash) that rotations and radius are learned from."""
PROBES = 256
"""Sampled vectors whose exact neighbours within the sample set the radius."""
RECALL = 0.985
BITS = 128
SUBSTRING = 16
ROUNDS = 15
BLOCK = 16384
"""Rows of an index block."""
QUERY_BLOCK = 1024


@dataclass
class Coder:
    """Learned codes: lifting bound and the rotations side by side."""

    bound: float
    rotation: np.ndarray
    radius: int = 0

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        """One more coordinate that makes all indexed norms equal; 0 for a query."""
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.bound**2 - (x * x).sum(axis=1), 0.0))
        return np.column_stack([x, extra])

    def codes(self, x: np.ndarray, query: bool) -> np.ndarray:
        """(rows, BITS / 16) unsigned 16-bit substrings."""
        y = self.lift(x, query)
        if query:  # queries are scored by direction only
            y = y * (self.bound / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300))
        bits = y @ self.rotation > 0  # signs about the origin keep angles
        return np.packbits(bits, axis=1, bitorder="little").view("<u2")


@lru_cache(1)
def _popcount() -> np.ndarray:
    return np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


@lru_cache(8)
def ball(radius: int) -> np.ndarray:
    """All 16-bit masks of at most ``radius`` bits."""
    return np.flatnonzero(_popcount() <= radius).astype(np.uint16)


def learn(sample: np.ndarray, bound: float, k: int, seed: int = 7) -> Coder:
    """Rotations by iterative quantisation, and the radius for the k nearest."""
    lifted = Coder(bound, np.zeros(0)).lift(sample, False)
    width = lifted.shape[1]
    rng = np.random.default_rng(seed)
    rotations, have = [], 0
    while have < BITS:
        take = min(width, BITS - have)
        r = np.linalg.qr(rng.standard_normal((width, width)))[0][:, :take]
        for _ in range(ROUNDS):
            b = np.where(lifted @ r > 0, 1.0, -1.0)
            u, _, vt = np.linalg.svd(lifted.T @ b, full_matrices=False)
            r = u @ vt
        rotations.append(r)
        have += take
    coder = Coder(bound, np.concatenate(rotations, axis=1))
    probes = sample[:PROBES]
    scores = probes @ sample.T
    np.fill_diagonal(scores[:, : len(probes)], -np.inf)
    near = min(k, len(sample) - 1)
    if near < 1:
        coder.radius = BITS
        return coder
    top = np.argpartition(-scores, near - 1, axis=1)[:, :near]
    q, c = coder.codes(probes, True), coder.codes(sample, False)
    distance = _popcount()[q[:, None, :] ^ c[top]].sum(axis=2, dtype=np.int64)
    coder.radius = int(np.quantile(distance, RECALL))
    return coder


class Index:
    """Substring indexes of one block."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(codes[:, s], kind="stable") for s in range(codes.shape[1])]
        self.values, self.starts = [], []
        for s, order in enumerate(self.order):
            values, starts = np.unique(codes[order, s], return_index=True)
            self.values.append(values)
            self.starts.append(np.append(starts, len(codes)))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code differs from ``code`` in at most ``radius`` bits, all of them."""
        parts = self.codes.shape[1]
        least = radius // parts
        hit = np.zeros(len(self.codes), bool)
        for s in range(parts):
            # the shorter of two walks: the masks of the ball, or the values that occur
            if len(ball(least)) < len(self.values[s]):
                probe = ball(least) ^ code[s]
                at = np.searchsorted(self.values[s], probe)
                at = at[self.values[s][np.minimum(at, len(self.values[s]) - 1)] == probe]
            else:
                at = np.flatnonzero(_popcount()[self.values[s] ^ code[s]] <= least)
            a, n = self.starts[s][at], self.starts[s][at + 1] - self.starts[s][at]
            spot = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            hit[self.order[s][spot]] = True
        rows = np.flatnonzero(hit)
        distance = _popcount()[self.codes[rows] ^ code].sum(axis=1, dtype=np.int64)
        return rows[distance <= radius]


def search(coder: Coder, ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int):
    """(query_id, vec_id, score) of the k best of one block for each query; rows sorted by id."""
    index, codes = Index(coder.codes(x, False)), coder.codes(q, True)
    for i, vector in enumerate(q):
        rows = index.within(codes[i], coder.radius)
        rows = rows[ids[rows] != query_ids[i]]
        if len(rows) < k:
            rows = np.flatnonzero(ids != query_ids[i])
        score = np.einsum("ij,j->i", x[rows], vector)
        if len(rows) > k:
            edge = np.partition(score, len(rows) - k)[len(rows) - k]
            keep = score >= edge  # ties at the edge all go on
            rows, score = rows[keep], score[keep]
        best = np.lexsort((ids[rows], -score))[:k]
        yield query_ids[i], ids[rows[best]], score[best]


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) with doubles, without rows that take no part."""
    vec = F.col(vec_col).cast("array<double>")
    bad = F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    some = F.exists("vec", lambda v: v != 0)
    return (
        vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))
        .where("id is not null and vec is not null and size(vec) > 0")
        .where(~bad & some)
    )


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(-1, width)


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of every query row.

    Queries are the rows that ``is_query`` (over column ``id``) picks; candidates are all rows but
    those of the query's own id. Ranks go by score in double precision, ties by smaller id;
    with fewer candidates all are returned. Rows with a null id, or a vector that is null,
    empty, zero or holds a null or non-finite component take no part. All vectors must
    have one length. Of rows repeated under one id the smallest vector counts.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col).groupBy("id").agg(F.min("vec").alias("vec"))
    rows = materialize(rows, "hamming-rows")
    facts = rows.agg(
        F.max(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v)).alias("square"),
        F.min(F.size("vec")).alias("least"),
        F.max(F.size("vec")).alias("width"),
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(is_query, 1)).alias("q"),
    ).first()
    empty = "query_id long, rank int, vec_id long, score double"
    if not facts["n"]:
        return spark.createDataFrame([], empty)
    if facts["least"] != facts["width"]:
        raise ValueError("vectors differ in length")
    width = facts["width"]
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()  # SAMPLE * width doubles at most
    coder = spark.sparkContext.broadcast(learn(_matrix(drawn["vec"], width), float(np.sqrt(facts["square"])), k))

    blocks, query_blocks = -(-facts["n"] // BLOCK), -(-facts["q"] // QUERY_BLOCK)
    index = rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), "id", "vec")
    asked = rows.where(is_query).select(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(max(query_blocks, 1))).alias("part"), "id", "vec")
    index = index.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(query_blocks, 1) - 1).cast("long"))))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left) and len(right):
            ids = np.asarray(left["id"])
            order = np.argsort(ids)
            found = search(
                coder.value, ids[order], _matrix(left["vec"], width)[order], np.asarray(right["id"]), _matrix(right["vec"], width), k
            )
            out = [(np.full(len(v), q), v, s) for q, v, s in found]
        if not out:
            return _FOUND.empty_table()
        return pa.table([np.concatenate(c) for c in zip(*out)], schema=_FOUND)

    keys = ["block", "part"]
    found = (
        index.groupBy(*keys)
        .cogroup(asked.groupBy(*keys))
        .applyInArrow(meet, "query_id long, vec_id long, score double")
    )
    # at most k rows a query and block; each map task hands on its best k of a query
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(*_COLUMNS)


_COLUMNS = ("query_id", "rank", "vec_id", "score")
