"""Level-set regions: set decomposition of a scalar field and its recovery."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.components import components
from fieldloom.operators.ranking import as_of, grouped_lag, grouped_running_sum, with_rank
from fieldloom.session import materialize, sorted_side


def level_set_starts(field: DataFrame, eb: float) -> DataFrame:
    """(x): first values of the greedy level sets, each at most ``eb`` wide.

    A set ends where a value exceeds its first value by more than eb, so the next
    start is a function of the current one. That successor is found for every
    distinct value at once by an as-of lookup; the chain from the minimum is then
    walked by pointer doubling, log2(number of sets) rounds. Repeated values
    collapse before any of this.
    """
    values = materialize(field.select(F.col("val").cast("double").alias("x")).distinct(), "values")
    ahead = as_of(values, values.select((F.col("x") + eb).alias("x"), F.col("x").alias("at")), "after")
    jump = materialize(ahead.where("hit is not null").select("at", "hit"), "jump")
    reached = materialize(values.agg(F.min("x").alias("x")), "starts")
    while True:
        landed = reached.join(jump, F.col("x") == F.col("at")).select(F.col("hit").alias("x"))
        fresh = materialize(landed.join(reached, "x", "left_anti"), "starts")
        if fresh.isEmpty():
            return reached
        reached = reached.unionByName(fresh)
        step = jump.select(F.col("at").alias("hit"), F.col("hit").alias("far"))
        jump = materialize(jump.join(step, "hit").select("at", F.col("far").alias("hit")), "jump")


def level_sets(field: DataFrame, eb: float) -> DataFrame:
    """(vid, val, set_id), sets numbered by ascending value."""
    starts = with_rank(level_set_starts(field, eb), ["x"], "set_id")
    distinct = field.select(F.col("val").cast("double").alias("x")).distinct()
    owner = as_of(starts.select("x"), distinct, "upto").join(
        starts.select(F.col("x").alias("hit"), "set_id"), "hit"
    )
    return field.join(
        owner.select("x", "set_id"), F.col("val").cast("double") == F.col("x")
    ).select("vid", "val", "set_id")


@dataclass
class Decomposition:
    """Stored form of a field: all tables are columnar and delta-coded."""

    regions: DataFrame  # rid, mean, members, nb, ni
    boundary: DataFrame  # rid, turn, delta
    seeds: DataFrame  # rid, turn, delta
    labels: DataFrame  # vid, val, rid (not stored; for evaluation)


def label_regions(sets: DataFrame, edges: DataFrame) -> DataFrame:
    """(vid, val, set_id, rid): components inside each set, numbered by (set, smallest id)."""
    s = sorted_side(sets.select(F.col("vid").alias("src"), F.col("set_id").alias("ss")))
    d = sorted_side(sets.select(F.col("vid").alias("dst"), F.col("set_id").alias("sd")))
    inside = edges.join(s, "src").join(d, "dst").where("ss = sd").select("src", "dst")
    roots = components(sets.select("vid"), inside)
    placed = sets.join(sorted_side(roots), "vid")
    numbered = with_rank(placed.where("vid = root").select("set_id", "root"), ["set_id", "root"], "rid")
    return placed.join(numbered.select("root", "rid"), "root").select("vid", "val", "set_id", "rid")


def region_means(labels: DataFrame) -> DataFrame:
    return labels.groupBy("rid").agg(
        F.avg(F.col("val").cast("double")).cast("float").alias("mean"), F.count(F.lit(1)).alias("members")
    )


def boundary_vertices(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(vid, rid) of vertices with a neighbour in another region."""
    s = sorted_side(labels.select(F.col("vid").alias("src"), F.col("rid").alias("rs")))
    d = sorted_side(labels.select(F.col("vid").alias("dst"), F.col("rid").alias("rd")))
    cut = edges.join(s, "src").join(d, "dst").where("rs <> rd")
    return cut.select(F.col("src").alias("vid"), F.col("rs").alias("rid")).distinct()


def interior_components(vertices: DataFrame, boundary: DataFrame, edges: DataFrame) -> DataFrame:
    """(vid, root) over the vertices that are not on a boundary."""
    interior = vertices.select("vid").join(sorted_side(boundary.select("vid")), "vid", "left_anti")
    interior = materialize(interior, "interior")
    kept = edges.join(sorted_side(interior.withColumnRenamed("vid", "src")), "src", "left_semi").join(
        sorted_side(interior.withColumnRenamed("vid", "dst")), "dst", "left_semi"
    )
    return components(interior, kept)


def delta_encode(ids: DataFrame) -> DataFrame:
    """(rid, turn, delta): sorted ids of every region as differences."""
    ranked = with_rank(ids.select("rid", "vid"), ["rid", "vid"], "turn")
    lagged = grouped_lag(ranked, ["rid"], "vid", "before")
    return lagged.select("rid", "turn", (F.col("vid") - F.coalesce("before", F.lit(0))).alias("delta"))


def delta_decode(coded: DataFrame) -> DataFrame:
    """(rid, vid) back from the differences."""
    return grouped_running_sum(coded, ["rid"], "turn", "delta", "vid").select("rid", "vid")


def decompose(field: DataFrame, edges: DataFrame, eb: float) -> Decomposition:
    """Level sets, their components, means, boundary and one seed per interior piece."""
    labels = materialize(label_regions(materialize(level_sets(field, eb), "sets"), edges), "labels")
    boundary = materialize(boundary_vertices(labels, edges), "boundary")
    roots = interior_components(labels, boundary, edges)
    seeds = materialize(
        roots.where("vid = root").join(labels.select("vid", "rid"), "vid").select("rid", "vid"), "seeds"
    )
    nb = boundary.groupBy("rid").agg(F.count(F.lit(1)).alias("nb"))
    ni = seeds.groupBy("rid").agg(F.count(F.lit(1)).alias("ni"))
    zero = F.lit(0).cast("bigint")
    regions = (
        region_means(labels)
        .join(nb, "rid", "left")
        .join(ni, "rid", "left")
        .select("rid", "mean", "members", F.coalesce("nb", zero).alias("nb"), F.coalesce("ni", zero).alias("ni"))
    )
    return Decomposition(regions, delta_encode(boundary), delta_encode(seeds), labels)


def recompose(stored: Decomposition, vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(vid, dec) from means, boundary ids and seeds: interiors follow their seed."""
    boundary = materialize(delta_decode(stored.boundary), "boundary")
    roots = interior_components(vertices, boundary, edges)
    seeds = delta_decode(stored.seeds).withColumnRenamed("vid", "seed")
    owner = seeds.join(roots.select(F.col("vid").alias("seed"), "root"), "seed").select("root", "rid")
    interior = roots.join(owner, "root").select("vid", "rid")
    return (
        interior.unionByName(boundary.select("vid", "rid"))
        .join(stored.regions.select("rid", "mean"), "rid")
        .select("vid", F.col("mean").alias("dec"))
    )
