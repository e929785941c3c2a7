"""Connected components by joins, in a logarithmic number of rounds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.ranking import with_rank
from fieldloom.session import materialize, sorted_side


def components(vertices: DataFrame, edges: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(vid, root): the smallest id of every component; edges hold both directions. ``pairs`` are
    the same edges one way, distinct and stored, where a caller has them.

    Each vertex keeps a parent and a grandparent. A round takes the smallest
    grandparent seen over the edges, hooks both the vertex and its parent to it
    and shortens paths; minima are pre-aggregated map-side, so a root that
    gathers a third of all vertices receives one row per map task. Looking up
    the parent's parent is a join with a unique right side, which adaptive
    execution splits when one root is popular.
    """
    edges = materialize(edges.where("src < dst").select("src", "dst").distinct(), "cc-edges") if pairs is None else pairs
    state = materialize(
        vertices.select("vid", F.col("vid").alias("f"), F.col("vid").alias("g")), "cc"
    )
    while True:
        g = sorted_side(state.select("vid", "g"))
        touched = (
            edges.join(g.withColumnRenamed("vid", "src").withColumnRenamed("g", "gs"), "src")
            .join(g.withColumnRenamed("vid", "dst").withColumnRenamed("g", "gd"), "dst")
            .where("gs <> gd")
        )
        offers = touched.select(
            F.explode(
                F.array(
                    F.struct(F.col("src").alias("vid"), F.col("gd").alias("m")),
                    F.struct(F.col("dst").alias("vid"), F.col("gs").alias("m")),
                )
            ).alias("o")
        ).select("o.vid", "o.m")
        seen = materialize(offers.groupBy("vid").agg(F.min("m").alias("m")), "cc-offers")
        if seen.isEmpty():
            break
        with_f = state.join(sorted_side(seen), "vid").select("vid", "f", "m")
        hooks = with_f.groupBy(F.col("f").alias("vid")).agg(F.min("m").alias("h"))
        moved = (
            state.join(sorted_side(seen), "vid", "left")
            .join(sorted_side(hooks), "vid", "left")
            .select("vid", F.least("f", "g", "m", "h").alias("f"))
        )
        moved = moved.persist()  # read by both sides of the self-join, then dropped
        lookup = moved.select(F.col("vid").alias("f"), F.col("f").alias("g"))
        state = materialize(moved.join(sorted_side(lookup), "f").select("vid", "f", "g"), "cc")
        moved.unpersist()
    # g is constant on every component and no larger than its smallest id
    return state.select("vid", F.col("g").alias("root"))


def _fresh(found: DataFrame, frontiers: list[DataFrame]) -> DataFrame:
    """Without what the last two frontiers hold. Edges go both ways, so a neighbour of level
    L is of level L - 1, L or L + 1: nothing older can turn up."""
    for seen in frontiers[-2:]:
        found = found.join(seen.select("vid"), "vid", "left_anti")
    return found


def _together(frontiers: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frontiers)


def breadth_first_levels(vertices: DataFrame, edges: DataFrame, start: int) -> DataFrame:
    """(vid, level) from one start, frontier by frontier; unreached vertices are absent.

    A frontier is joined with the edges once, and compared with two frontiers only.
    """
    first = vertices.where(F.col("vid") == start).select("vid", F.lit(0).alias("level"))
    frontiers = [materialize(first, "bfs")]
    while not frontiers[-1].isEmpty():
        found = edges.join(frontiers[-1].select(F.col("vid").alias("src")), "src").select(F.col("dst").alias("vid")).distinct()
        frontiers.append(materialize(_fresh(found, frontiers).withColumn("level", F.lit(len(frontiers))), "bfs"))
    return _together(frontiers)


def breadth_first_order(vertices: DataFrame, edges: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(vid, level, rank): the exact queue order over the whole mesh; ``pairs`` as in ``components``.

    A queue visits a level in the order of the parents' positions and, below one
    parent, in ascending id. So a level is ranked by (smallest parent position,
    id), and all components advance together; each starts at its smallest id and
    components follow one another by that id.
    """
    roots = materialize(components(vertices, edges, pairs), "bfs-roots")
    first = with_rank(roots.where("vid = root").select("vid", "root"), ["root"], "pos")
    frontiers = [materialize(first.select("vid", "root", "pos", F.lit(0).alias("level")), "bfs")]
    while True:
        level = F.lit(1) + F.col("level")
        parents = frontiers[-1].select(F.col("vid").alias("src"), "root", "level", F.col("pos").alias("parent"))
        found = (
            edges.join(parents, "src")
            .groupBy(F.col("dst").alias("vid"))
            .agg(F.min("parent").alias("parent"), F.first("root").alias("root"), F.first(level).alias("level"))
        )
        fresh = materialize(_fresh(found, frontiers), "bfs-fresh")
        if fresh.isEmpty():
            break
        ranked = with_rank(fresh, ["parent", "vid"], "pos").select("vid", "root", "pos", "level")
        frontiers.append(materialize(ranked, "bfs"))
    return with_rank(_together(frontiers), ["root", "level", "pos"], "rank").select("vid", "level", "rank")
