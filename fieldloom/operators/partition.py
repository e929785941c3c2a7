"""Balanced parts of bounded size along a space-filling curve."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.scalars import morton
from fieldloom.operators.ranking import exclusive_prefix, with_rank
from fieldloom.session import broadcast_if_small, materialize


def curve_bits(n: int, d: int) -> int:
    """Bits per axis: far more cells than vertices, within a 62-bit code."""
    return min(max(10, math.ceil(math.log2(max(n, 1)) / d) + 4), 62 // d)


def locality_key(positions: DataFrame, n: int, bits: int | None = None) -> DataFrame:
    """Positions plus ``cell``, the Morton code of ``n`` vertices over their bounding box.

    Only the 2d bounding-box numbers come back to the driver.
    """
    d = len(positions.select("pos").head()[0])
    bits = curve_bits(n, d) if bits is None else bits
    axes = [F.col("pos")[i] for i in range(d)]
    box = positions.agg(
        *[F.min(a).alias(f"lo{i}") for i, a in enumerate(axes)],
        *[F.max(a).alias(f"hi{i}") for i, a in enumerate(axes)],
    ).head()
    lows, highs = [box[f"lo{i}"] for i in range(d)], [box[f"hi{i}"] for i in range(d)]
    return positions.withColumn("cell", morton(axes, lows, highs, bits))


def assign_parts(positions: DataFrame, part_size: int) -> DataFrame:
    """Split vertices into ceil(n / part_size) parts of equal size (vid, part)."""
    n = positions.count()
    keyed = locality_key(positions, n).select("vid", "cell")
    nparts = max(1, -(-n // part_size))
    ranked = with_rank(keyed, ["cell", "vid"])
    part = F.floor(F.col("rank") * nparts / F.lit(n)).cast("bigint")
    return ranked.select("vid", part.alias("part"))


# Multiplier and modulus of the hash that says in which rounds a vertex may move.
MULTIPLIER = 2654435761
MODULUS = 1 << 32


def refine(parts: DataFrame, edges: DataFrame, rounds: int, slack: float = 0.05) -> DataFrame:
    """(vid, part) with fewer cut edges: label propagation within capacities.

    In a round, every second vertex (by a hash of its id, so neighbours rarely swap places)
    asks for the part that holds most of its neighbours, if that holds more than its own.
    Requests are ranked by gain, and admitted while the part asked for has room and the part
    left stays large enough: sizes stay within ``slack`` of the mean, or where they began.
    ``edges`` (src, dst) hold both directions. Neighbours are counted map-side, so a vertex
    that neighbours a third of all others sends a row per part and task.
    """
    sizes = part_counts(parts)
    total = sizes.agg(F.sum("n"), F.count(F.lit(1))).first()
    if not total[1]:
        return parts
    mean = total[0] / total[1]
    most, least = math.ceil(mean * (1 + slack)), math.floor(mean * (1 - slack))
    half = F.floor(F.pmod(F.pmod(F.col("src"), F.lit(1 << 31)) * F.lit(MULTIPLIER), F.lit(MODULUS)) / F.lit(MODULUS // 2))
    for r in range(rounds):
        # edges of vertices that may move meet the other end's part; the own part joins the counts
        near = edges.where(half == r % 2).join(parts.select(F.col("vid").alias("dst"), "part"), "dst")
        votes = near.groupBy(F.col("src").alias("vid"), "part").agg(F.count(F.lit(1)).alias("n"))
        counts = votes.join(parts.withColumnRenamed("part", "own"), "vid")
        other = F.max(F.when(F.col("part") != F.col("own"), F.struct("n", (-F.col("part")).alias("part"))))
        mine = F.coalesce(F.max(F.when(F.col("part") == F.col("own"), F.col("n"))), F.lit(0))
        asks = counts.groupBy("vid", "own").agg(other.alias("best"), mine.alias("mine"))
        asks = asks.select("vid", "own", (-F.col("best.part")).alias("part"), (F.col("best.n") - F.col("mine")).alias("gain")).where("gain > 0")
        sizes = part_counts(parts)
        room = broadcast_if_small(sizes.select("part", (F.lit(most) - F.col("n")).alias("room")))
        spare = broadcast_if_small(sizes.select(F.col("part").alias("own"), (F.col("n") - F.lit(least)).alias("spare")))
        arrives = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("gain"), "vid"))
        leaves = F.row_number().over(Window.partitionBy("own").orderBy(F.desc("gain"), "vid"))
        ranked = asks.withColumn("arrives", arrives).withColumn("leaves", leaves).join(room, "part").join(spare, "own")
        moves = ranked.where("arrives <= room and leaves <= spare").select("vid", F.col("part").alias("to"))
        parts = materialize(parts.join(moves, "vid", "left").select("vid", F.coalesce("to", "part").alias("part")), "refined")
    return parts


def cut_edges(parts: DataFrame, edges: DataFrame) -> DataFrame:
    """(part_a, part_b, edges): undirected edges within (a = b) and between parts."""
    a = parts.select(F.col("vid").alias("src"), F.col("part").alias("a"))
    b = parts.select(F.col("vid").alias("dst"), F.col("part").alias("b"))
    ends = edges.where("src < dst").join(a, "src").join(b, "dst")
    return ends.groupBy(F.least("a", "b").alias("part_a"), F.greatest("a", "b").alias("part_b")).agg(F.count(F.lit(1)).alias("edges"))


def part_counts(parts: DataFrame) -> DataFrame:
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


def part_slots(parts: DataFrame) -> DataFrame:
    """Global slot of every vertex in (part, vid) order, parts being bounded."""
    offsets = exclusive_prefix(part_counts(parts), "part", "n").select("part", "offset")
    inside = F.row_number().over(Window.partitionBy("part").orderBy("vid")) - 1
    return (
        parts.withColumn("local", inside)
        .join(offsets, "part")
        .select("vid", "part", (F.col("offset") + F.col("local")).alias("slot"))
    )


def loads_from_offsets(offsets: DataFrame, total: int) -> DataFrame:
    """Inverse of the prefix sum: (part, offset) back to (part, n)."""
    ranked = with_rank(offsets, ["part"])
    following = ranked.select((F.col("rank") - 1).alias("rank"), F.col("offset").alias("upper"))
    return ranked.join(following, "rank", "left").select(
        "part", (F.coalesce("upper", F.lit(total)) - F.col("offset")).alias("n")
    )
