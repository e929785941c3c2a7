"""Adjacency as a distinct directed edge table (src, dst), both directions present."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.scalars import distance

# The nine edges of a wedge with triangles (0,1,2), (3,4,5) and
# verticals (0,3), (1,4), (2,5).
WEDGE_EDGES = ((0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5), (0, 3), (1, 4), (2, 5))


def simplex_edges(corners: int) -> tuple[tuple[int, int], ...]:
    return tuple((i, j) for i in range(corners) for j in range(i + 1, corners))


def _explode_template(cells: DataFrame, template: tuple[tuple[int, int], ...]) -> DataFrame:
    """One narrow explode per cell; the fan-out is the fixed size of the template."""

    def pair(i: int, j: int) -> Column:
        a, b = F.col("verts")[i], F.col("verts")[j]
        return F.struct(a.alias("src"), b.alias("dst"))

    pairs = [pair(i, j) for i, j in template] + [pair(j, i) for i, j in template]
    return cells.select(F.explode(F.array(*pairs)).alias("e")).select("e.src", "e.dst")


def from_cells(cells: DataFrame, corners: int) -> DataFrame:
    """Edges of simplices with ``corners`` vertices (3 = triangles, 4 = tetrahedra)."""
    return _clean(_explode_template(cells, simplex_edges(corners)))


def from_wedges(wedges: DataFrame) -> DataFrame:
    return _clean(_explode_template(wedges, WEDGE_EDGES))


def both_ways(pairs: DataFrame) -> DataFrame:
    """Both directions of pairs (src, dst, ...), other columns repeated: nothing is exchanged."""
    rest = [c for c in pairs.columns if c not in ("src", "dst")]
    both = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return pairs.select(F.explode(both).alias("e"), *rest).select("e.src", "e.dst", *rest)


def from_pairs(pairs: DataFrame) -> DataFrame:
    """Edges from an undirected pair list (src, dst)."""
    return _clean(both_ways(pairs))


def from_cells_and_wedges(cells: DataFrame, corners: int, wedges: DataFrame) -> DataFrame:
    both = _explode_template(cells, simplex_edges(corners)).unionByName(
        _explode_template(wedges, WEDGE_EDGES)
    )
    return _clean(both)


def from_padded_table(table: DataFrame, symmetric: bool = True) -> DataFrame:
    """Edges from a padded 1-based neighbour table (vid, nbrs), 0 = padding."""
    directed = (
        table.select(F.col("vid").alias("src"), F.explode("nbrs").alias("n"))
        .where("n > 0")
        .select("src", (F.col("n") - 1).cast("bigint").alias("dst"))
    )
    return from_pairs(directed) if symmetric else _clean(directed)


def _clean(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst").distinct()


def causal(edges: DataFrame) -> DataFrame:
    """Keep neighbours that come earlier in id order."""
    return edges.where("dst < src")


def causal_under(edges: DataFrame, order: DataFrame) -> DataFrame:
    """Keep neighbours that come earlier in the order (vid, rank)."""
    s = order.select(F.col("vid").alias("src"), F.col("rank").alias("rs"))
    d = order.select(F.col("vid").alias("dst"), F.col("rank").alias("rd"))
    return edges.join(s, "src").join(d, "dst").where("rd < rs").select("src", "dst")


def within_parts(edges: DataFrame, layout: DataFrame) -> DataFrame:
    """Keep edges whose ends share a part; adds the part."""
    s = layout.select(F.col("vid").alias("src"), F.col("part"))
    d = layout.select(F.col("vid").alias("dst"), F.col("part").alias("pd"))
    kept = edges.join(s, "src").join(d, "dst").where("part = pd")
    return kept.select("part", *edges.columns)


def local_with_distance(edges: DataFrame, placed: DataFrame) -> DataFrame:
    """(part, src, dst, dist) of edges inside a part, from vertices (vid, part, pos).

    All edges meet the parts alone; the few that stay inside one are then measured. Edges that
    have a column ``part`` are those inside a part already.
    """
    kept = edges if "part" in edges.columns else within_parts(edges.select("src", "dst"), placed.select("vid", "part"))
    s = placed.select(F.col("vid").alias("src"), F.col("pos").alias("ps"))
    d = placed.select(F.col("vid").alias("dst"), F.col("pos").alias("pt"))
    return kept.join(s, "src").join(d, "dst").select("part", "src", "dst", distance(F.col("ps"), F.col("pt")).alias("dist"))


def induced(edges: DataFrame, sample: DataFrame) -> DataFrame:
    """Sub-graph on the sampled vertices (vid, idx), re-indexed by sample position."""
    s = sample.select(F.col("vid").alias("src"), F.col("idx").alias("src_idx"))
    d = sample.select(F.col("vid").alias("dst"), F.col("idx").alias("dst_idx"))
    return (
        edges.join(s, "src").join(d, "dst").select(F.col("src_idx").alias("src"), F.col("dst_idx").alias("dst"))
    )


def incidence(cells: DataFrame) -> DataFrame:
    """Vertex to (cell, corner) lists in long form."""
    return cells.select("cid", F.posexplode("verts").alias("corner", "vid")).select("vid", "cid", "corner")


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("vid")).agg(F.count(F.lit(1)).alias("degree"))
