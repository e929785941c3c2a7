"""Nearest neighbours, inverse-distance weights and open-loop predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.scalars import distance


def with_distance(edges: DataFrame, positions: DataFrame) -> DataFrame:
    """Attach the length of every edge.

    The last join is on ``dst``, so the window by ``src`` that usually follows
    exchanges rows again: Spark then limits each map task to k rows per vertex
    before the shuffle, and a vertex of huge degree does not pile up in one task.
    """
    s = positions.select(F.col("vid").alias("src"), F.col("pos").alias("ps"))
    d = positions.select(F.col("vid").alias("dst"), F.col("pos").alias("pd"))
    return (
        edges.join(s, "src")
        .join(d, "dst")
        .select(*[c for c in edges.columns], distance(F.col("ps"), F.col("pd")).alias("dist"))
    )


def nearest(edges: DataFrame, k: int, key: str | list[str] = "src") -> DataFrame:
    """The k nearest neighbours of every vertex; ties go to the smaller id."""
    w = Window.partitionBy(key).orderBy("dist", "dst")
    return edges.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def inverse_distance_weights(near: DataFrame, key: str | list[str] = "src") -> DataFrame:
    """Normalized weights of a (bounded, k per vertex) neighbour list.

    Coincident neighbours share the whole weight equally, the others get none.
    """
    w = Window.partitionBy(key)
    here = F.sum(F.when(F.col("dist") == 0, 1.0)).over(w)
    total = F.sum(F.when(F.col("dist") > 0, 1.0 / F.col("dist"))).over(w)
    weight = (
        F.when(here.isNotNull(), F.when(F.col("dist") == 0, 1.0 / here).otherwise(0.0))
        .otherwise(1.0 / F.col("dist") / total)
    )
    return near.withColumn("w", weight)


def raw_weight() -> Column:
    """Un-normalized weight of one edge: 1/distance, a huge finite value if coincident."""
    return F.when(F.col("dist") > 0, 1.0 / F.col("dist")).otherwise(F.lit(1e300))


def open_loop(weights: DataFrame, field: DataFrame, vertices: DataFrame) -> DataFrame:
    """Weighted sum of the original neighbour values; 0 without neighbours.

    The value side is unique per vertex, so a popular neighbour only repeats on
    the weight side, where the sum by ``src`` is pre-aggregated map-side.
    """
    vals = field.select(F.col("vid").alias("dst"), F.col("val").cast("double").alias("nv"))
    pred = (
        weights.join(vals, "dst").groupBy("src").agg(F.sum(F.col("w") * F.col("nv")).alias("pred"))
    )
    return (
        vertices.select("vid")
        .join(pred.withColumnRenamed("src", "vid"), "vid", "left")
        .select("vid", F.coalesce("pred", F.lit(0.0)).alias("pred"))
    )


def padded_table(near: DataFrame, positions: DataFrame, columns: int) -> DataFrame:
    """Neighbour table (vid, nbrs): 1-based ids in distance order, 0 = padding."""
    lists = near.groupBy(F.col("src").alias("vid")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rn", "dst"))), lambda s: (s["dst"] + 1).cast("int")
        ).alias("ids")
    )
    pads = F.array_repeat(F.lit(0), columns)
    ids = F.coalesce("ids", F.array().cast("array<int>"))
    return positions.select("vid").join(lists, "vid", "left").select(
        "vid", F.slice(F.concat(ids, pads), 1, columns).alias("nbrs")
    )
