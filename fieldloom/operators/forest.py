"""Depth-first numbering of a spanning forest over the whole mesh, without a serial stack.

The forest is the breadth-first one: a vertex hangs below the neighbour that a queue reaches
it from. Its Euler tour is a linked list of an entry and an exit per vertex, and the list is
ranked by pointer doubling: after r rounds an item knows the item 2^r further on. So the
rounds are those of the breadth-first search plus the logarithm of twice the largest tree.
This numbers that forest depth-first; it is not the order in which a stack walks the mesh.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.components import breadth_first_order
from fieldloom.operators.ranking import grouped_lag, with_rank
from fieldloom.session import materialize


def breadth_first_forest(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(vid, level, rank, parent): the queue order of the mesh, and whom the queue came from; null for roots."""
    order = materialize(breadth_first_order(vertices, edges), "forest-order")
    offers = edges.join(order.select(F.col("vid").alias("src"), F.col("rank").alias("at")), "src")
    # no neighbour comes earlier in the queue than the one that a vertex was reached from
    first = offers.groupBy(F.col("dst").alias("vid")).agg(F.min(F.struct("at", "src")).alias("s"))
    parent = F.when(F.col("level") > 0, F.col("s.src")).alias("parent")
    return order.join(first, "vid", "left").select("vid", "level", "rank", parent)


def ranked_lists(items: DataFrame) -> DataFrame:
    """(id, steps, last) of linked lists (id, next): how many items follow, and the list's last item.

    Both sides of a round's join are unique, so no key is hot; an item whose list is done is
    carried along unjoined.
    """
    done = F.col("next").isNull()
    state = materialize(
        items.select("id", "next", F.when(done, 0).otherwise(1).cast("bigint").alias("steps"), F.coalesce("next", "id").alias("last")), "lists"
    )
    while not state.where("next is not null").isEmpty():
        there = state.select(F.col("id").alias("next"), F.col("next").alias("far"), F.col("steps").alias("more"), F.col("last").alias("end"))
        going = state.where("next is not null").join(there, "next")
        moved = going.select("id", F.col("far").alias("next"), (F.col("steps") + F.col("more")).alias("steps"), F.col("end").alias("last"))
        state = materialize(moved.unionByName(state.where("next is null")), "lists")
    return state.select("id", "steps", "last")


def depth_first_numbers(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(vid, parent, level, pre, post): entry and exit numbers from 0, children in ascending id,
    trees by their smallest id. A vertex is above another if it enters before and leaves after it.

    ``edges`` go both ways; isolated vertices are trees of their own, no vertex gives no row.
    """
    forest = materialize(breadth_first_forest(vertices, edges), "forest")
    enter, leave = (F.col("rank") * 2).alias("id"), (F.col("rank") * 2 + 1).alias("id")
    children = forest.where("parent is not null").select("vid", "parent", "rank")
    above = forest.select(F.col("vid").alias("parent"), F.col("rank").alias("up"))
    # after entering: the smallest child, or out again
    eldest = children.groupBy("parent").agg(F.min(F.struct("vid", "rank")).alias("s")).select(F.col("parent").alias("vid"), F.col("s.rank").alias("down"))
    inward = forest.join(eldest, "vid", "left").select(enter, F.coalesce(F.col("down") * 2, F.col("rank") * 2 + 1).alias("next"))
    # after leaving: the next sibling, or out of the parent
    siblings = materialize(grouped_lag(children, ["parent"], "vid", "before"), "siblings")
    after = siblings.where("before is not null").select(F.col("before").alias("vid"), F.col("rank").alias("beside"))
    outward = (
        forest.join(after, "vid", "left").join(above, "parent", "left")
        .select(leave, F.coalesce(F.col("beside") * 2, F.col("up") * 2 + 1).alias("next"))
    )
    ranked = materialize(ranked_lists(inward.unionByName(outward)), "tour")
    place = ranked.select(F.floor(F.col("id") / 2).alias("rank"), (F.col("id") % 2).alias("side"), "last", (-F.col("steps")).alias("at"))
    pre = with_rank(place.where("side = 0").select("rank", "last", "at"), ["last", "at"], "pre").select("rank", "pre")
    post = with_rank(place.where("side = 1").select("rank", "last", "at"), ["last", "at"], "post").select("rank", "post")
    return forest.join(pre, "rank").join(post, "rank").select("vid", "parent", "level", "pre", "post")
