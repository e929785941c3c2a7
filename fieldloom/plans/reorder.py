"""Renumber a whole mesh, its connectivity and its fields by one visiting order."""

from __future__ import annotations

from pyspark.sql import DataFrame

from fieldloom.operators import permute
from fieldloom.operators.ranking import with_rank
from fieldloom.session import materialize


def order_from_layout(mesh: DataFrame) -> DataFrame:
    """(vid, rank): parts one after another, each in its visiting order."""
    ranked = with_rank(mesh.select("vid", "part", "slot"), ["part", "slot"])
    return materialize(ranked.select("vid", "rank"), "order")


def reorder_mesh(
    positions: DataFrame, cells: DataFrame, field: DataFrame, order: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Positions, cells and fields under the new ids, ready to be written as raw arrays."""
    return (
        permute.reorder(positions, order),
        permute.reorder_cells(cells, order),
        permute.reorder(field, order),
    )
