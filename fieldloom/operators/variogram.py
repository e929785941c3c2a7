"""Empirical semivariograms of neighbour lists, and kriging weights per vertex."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import kriged


def neighbour_lists(near: DataFrame, positions: DataFrame, field: DataFrame) -> DataFrame:
    """(src, pos, l): up to k neighbours with id, position and value, nearest first."""
    there = positions.join(field, "vid").select(
        F.col("vid").alias("dst"), F.col("pos").alias("npos"), F.col("val").cast("double").alias("nval")
    )
    rows = near.join(there, "dst").groupBy("src").agg(
        F.array_sort(F.collect_list(F.struct("rn", "dst", "npos", "nval"))).alias("l")
    )
    return rows.join(positions.withColumnRenamed("vid", "src"), "src")


def semivariogram_pairs(lists: DataFrame, fewest: int = 3) -> DataFrame:
    """(src, j, k, lag, half): half squared differences of all neighbour pairs j < k.

    A list has at most k entries, so the fan-out per vertex is a constant.
    """
    spots = lists.where(F.size("l") >= fewest).select("src", "l", F.posexplode("l").alias("j", "a"))
    later = F.slice("l", F.col("j") + 2, F.size("l"))
    pairs = spots.select("src", "j", "a", F.posexplode(later).alias("o", "b"))
    lag = F.sqrt(
        F.aggregate(
            F.zip_with("a.npos", "b.npos", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v
        )
    )
    diff = F.col("a.nval") - F.col("b.nval")
    return pairs.select(
        "src", "j", (F.col("j") + 1 + F.col("o")).alias("k"), lag.alias("lag"), (diff * diff / 2.0).alias("half")
    )


def weights_per_vertex(lists: DataFrame) -> DataFrame:
    """(src, m, reach, sill, lambda): variogram fit and ordinary-kriging weights of every vertex with
    three or four neighbours; ``lambda`` is null where the system is not usable."""
    spot = [F.get("l", F.lit(i)) for i in range(kriged.K)]
    apart = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    shaped = lists.where(F.size("l") >= kriged.FEWEST).select(
        "src", F.size("l").alias("m"),
        F.array(*[apart(s["npos"], F.col("pos")) for s in spot]).alias("near"),
        F.array(*[apart(spot[i]["npos"], spot[j]["npos"]) for i in range(kriged.K) for j in range(i + 1, kriged.K)]).alias("pair"),
        kriged.half_squares([s["nval"] for s in spot]).alias("half"),
    )
    solved = kriged.let(
        kriged.fit(F.col("pair"), F.col("half")), lambda f: F.struct(f.alias("f"), kriged.weights(F.col("near"), F.col("pair"), f["reach"]).alias("w"))
    )
    return shaped.select("src", "m", solved.alias("s")).select("src", "m", "s.f.reach", "s.f.sill", F.col("s.w").alias("lambda"))
