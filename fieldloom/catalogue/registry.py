"""Query registry and the SQL fragments shared by the DuckDB equivalents."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldloom.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

PART_SIZE = 512
"""Vertices per part in the registered queries."""


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[fn.__name__] = run
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return register


def cells_cte(name: str, corners: int) -> str:
    return f"""{name} AS (
  SELECT l_orderkey * 65536 + i - 1 AS cid, list_slice(parts, i, i + {corners - 1}) AS verts
  FROM (SELECT l_orderkey, parts, unnest(range(1, len(parts) - {corners} + 2)) AS i
        FROM (SELECT l_orderkey, list_sort(list_distinct(list(l_partkey))) AS parts FROM lineitem GROUP BY l_orderkey)
        WHERE len(parts) >= {corners}))"""


SHORT = """short AS (
  SELECT l_orderkey, l_partkey FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
  WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_partkey) < 4))"""
TETS = cells_cte("tets", 4)
CORNERS = """corners AS (
  SELECT cid, unnest(verts) AS vid, generate_subscripts(verts, 1) - 1 AS corner FROM tets)"""
EDGES = f"""{TETS}, {CORNERS}, {SHORT}, edges AS (
  SELECT a.vid AS src, b.vid AS dst FROM corners a JOIN corners b ON a.cid = b.cid AND a.vid <> b.vid
  UNION
  SELECT a.l_partkey, b.l_partkey FROM short a JOIN short b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey)"""
CELL_EDGES = f"""{TETS}, {CORNERS}, edges AS (
  SELECT DISTINCT a.vid AS src, b.vid AS dst FROM corners a JOIN corners b ON a.cid = b.cid AND a.vid <> b.vid)"""
POS = "pos AS (SELECT p_partkey AS vid, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part)"
DIST = """dists AS (
  SELECT e.src, e.dst, sqrt((s.x - d.x) * (s.x - d.x) + (s.y - d.y) * (s.y - d.y)) AS dist
  FROM edges e JOIN pos s ON s.vid = e.src JOIN pos d ON d.vid = e.dst)"""


def near_cte(k: int, causal: bool = True) -> str:
    where = "WHERE dst < src" if causal else ""
    return f"""near AS (
  SELECT * FROM (SELECT src, dst, dist,
           row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rn FROM dists {where})
  WHERE rn <= {k})"""


WEIGHTS = """weights AS (
  SELECT src, dst, dist, rn,
         CASE WHEN sum(CASE WHEN dist = 0 THEN 1.0::DOUBLE END) OVER (PARTITION BY src) IS NOT NULL
              THEN CASE WHEN dist = 0
                        THEN 1.0 / sum(CASE WHEN dist = 0 THEN 1.0::DOUBLE END) OVER (PARTITION BY src)
                        ELSE 0.0 END
              ELSE 1.0 / dist / sum(CASE WHEN dist > 0 THEN 1.0 / dist END) OVER (PARTITION BY src)
         END AS w
  FROM near)"""
STATIC = """field AS (
  SELECT p_partkey AS vid,
         coalesce(CAST((SELECT sum(l_quantity) FROM lineitem WHERE l_partkey = p_partkey) AS FLOAT),
                  CAST(-99999 AS FLOAT)) AS val
  FROM part)"""
OPEN_LOOP = """pred AS (
  SELECT f.vid, coalesce(sum(w.w * CAST(n.val AS DOUBLE)), 0.0) AS pred
  FROM field f LEFT JOIN weights w ON w.src = f.vid LEFT JOIN field n ON n.vid = w.dst
  GROUP BY f.vid)"""


def parts_cte(size: int = PART_SIZE, source: str = "pos") -> str:
    """Morton code over the bounding box, rank, equal parts."""
    bits = " | ".join(
        f"((({c} >> {b}) & 1) << {2 * b + i})" for i, c in enumerate(("cx", "cy")) for b in range(24)
    )
    top = "(pow(2, greatest(10, ceil(log2(n) / 2) + 4)) - 1)"
    return f"""box AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, count(*) AS n
         FROM {source}),
grid AS (SELECT vid, n, CAST(floor((x - lx) / (hx - lx) * {top}) AS BIGINT) AS cx,
                CAST(floor((y - ly) / (hy - ly) * {top}) AS BIGINT) AS cy FROM {source}, box),
parts AS (SELECT vid, CAST(floor((row_number() OVER (ORDER BY {bits}, vid) - 1)
                 * CAST(ceil(n / {size}.0) AS BIGINT) / n::DOUBLE) AS BIGINT) AS part FROM grid)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
