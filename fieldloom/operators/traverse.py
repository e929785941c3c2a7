"""Visiting orders inside bounded parts.

A depth-first style order is one long dependency chain, so it is taken per part:
parts have a fixed largest size, every part is one group of one task, and a mesh
that fits one part gets exactly the order of a serial traversal. Disconnected
pieces restart at the smallest unvisited id.
"""

from __future__ import annotations

import heapq
from enum import IntEnum

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.session import spread


class Order(IntEnum):
    IDENTITY = 0
    PRIORITY_DEPTH = 1
    DEPTH = 2
    BREADTH = 3
    PRIORITY_BREADTH = 4
    PRIORITY_CHAIN = 5
    """Depth with priority but without backtracking: after a dead end the walk
    restarts at the smallest unvisited id."""


def visit_order(n: int, adj: list[np.ndarray], how: Order) -> np.ndarray:
    """Vertices 0..n-1 in visiting order; ``adj`` lists are ascending."""
    if how == Order.IDENTITY:
        return np.arange(n)
    seen = np.zeros(n, bool)
    done = np.zeros(n, np.int64)  # processed neighbours so far
    out: list[int] = []

    def take(v: int) -> None:
        seen[v] = True
        out.append(v)

    def busiest(v: int) -> int:
        free = adj[v][~seen[adj[v]]]
        return int(free[np.argmax(done[free])]) if len(free) else -1

    for start in range(n):
        if seen[start]:
            continue
        if how == Order.BREADTH:
            take(start)
            head = len(out) - 1
            while head < len(out):
                for u in adj[out[head]]:
                    if not seen[u]:
                        take(int(u))
                head += 1
        elif how == Order.DEPTH:
            stack = [start]
            while stack:
                v = stack.pop()
                if not seen[v]:
                    take(v)
                    stack.extend(int(u) for u in adj[v] if not seen[u])
        elif how == Order.PRIORITY_BREADTH:
            heap = [(0, start)]
            while heap:
                count, v = heapq.heappop(heap)
                if seen[v] or -count != done[v]:
                    continue  # stale entry
                take(v)
                for u in adj[v]:
                    done[u] += 1
                    if not seen[u]:
                        heapq.heappush(heap, (-int(done[u]), int(u)))
        else:
            take(start)
            stack = [start]
            while stack:
                v = stack[-1]
                done[adj[v]] += 1
                u = busiest(v)
                if u < 0 or how == Order.PRIORITY_CHAIN:
                    stack.pop()
                if u >= 0:
                    take(u)
                    stack.append(u)
    return np.asarray(out)


def local_adjacency(n: int, src: np.ndarray, dst: np.ndarray) -> list[np.ndarray]:
    by = np.lexsort((dst, src))
    return np.split(dst[by], np.cumsum(np.bincount(src, minlength=n))[:-1])


def order_parts(parts: DataFrame, local_edges: DataFrame, how: Order) -> DataFrame:
    """(part, src, dst, dist, src_slot, dst_slot) plus one row per vertex with dst NULL.

    Vertices and part-local edges travel together in one shuffle by part, so the
    slots of both edge ends are known without joining the order back.
    """
    if "dist" not in local_edges.columns:
        local_edges = local_edges.withColumn("dist", F.lit(None).cast("double"))
    rows = parts.select(
        "part",
        F.col("vid").alias("src"),
        F.lit(None).cast("bigint").alias("dst"),
        F.lit(None).cast("double").alias("dist"),
    ).unionByName(local_edges.select("part", "src", "dst", "dist"))
    kind = Order(how)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(group.src[group.dst.isna()].to_numpy())
        src = np.searchsorted(ids, group.src.to_numpy())
        is_edge = group.dst.notna().to_numpy()
        dst = np.searchsorted(ids, group.dst[is_edge].to_numpy().astype(np.int64))
        order = visit_order(len(ids), local_adjacency(len(ids), src[is_edge], dst), kind)
        slot = np.empty(len(ids), np.int32)
        slot[order] = np.arange(len(ids), dtype=np.int32)
        ends = pd.array([pd.NA] * len(group), dtype="Int32")
        ends[is_edge] = slot[dst]
        return group.assign(src_slot=slot[src], dst_slot=ends)

    schema = "part bigint, src bigint, dst bigint, dist double, src_slot int, dst_slot int"
    return spread(rows, "part").groupBy("part").applyInPandas(run, schema)
