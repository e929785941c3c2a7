"""Row permutations: an order is a table (vid, rank), applied and undone by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reorder(df: DataFrame, order: DataFrame) -> DataFrame:
    """Renumber rows: ``vid`` becomes the rank of the old id."""
    rest = [c for c in df.columns if c != "vid"]
    return df.join(order.select("vid", "rank"), "vid").select(F.col("rank").alias("vid"), *rest)


def reorder_back(df: DataFrame, order: DataFrame) -> DataFrame:
    """Undo :func:`reorder`."""
    rest = [c for c in df.columns if c != "vid"]
    back = order.select(F.col("vid").alias("old"), F.col("rank").alias("vid"))
    return df.join(back, "vid").select(F.col("old").alias("vid"), *rest)


def reorder_cells(cells: DataFrame, order: DataFrame) -> DataFrame:
    """Rewrite the corner ids of every cell, keeping the corner positions."""
    corners = cells.select("cid", F.posexplode("verts").alias("corner", "vid"))
    moved = corners.join(order.select("vid", "rank"), "vid")
    ordered = F.array_sort(F.collect_list(F.struct("corner", "rank")))
    return moved.groupBy("cid").agg(F.transform(ordered, lambda s: s["rank"]).alias("verts"))


def reorder_edges(edges: DataFrame, order: DataFrame) -> DataFrame:
    s = order.select(F.col("vid").alias("src"), F.col("rank").alias("rs"))
    d = order.select(F.col("vid").alias("dst"), F.col("rank").alias("rd"))
    return edges.join(s, "src").join(d, "dst").select(F.col("rs").alias("src"), F.col("rd").alias("dst"))
