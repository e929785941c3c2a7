"""Vector fields: critical points, margins, log-space coding, preservation."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.catalogue import mesh as mq
from fieldloom.catalogue.registry import CORNERS, EDGES, TETS, query, with_
from fieldloom.functions import scalars
from fieldloom.operators import adjacency, critical, locate, neighbours
from fieldloom.plans import critical as cp
from fieldloom.plans.sweeps import MODULUS, MULTIPLIER
from fieldloom.sources import tables

VECTORS = """vectors AS (
  SELECT p_partkey AS vid, CAST(coalesce(u, 0) AS DOUBLE) AS u, CAST(coalesce(v, 0) AS DOUBLE) AS v,
         CAST(coalesce(w, 0) AS DOUBLE) AS w
  FROM part LEFT JOIN (
    SELECT l_partkey, sum(round(l_discount * 100) - 5) AS u, sum(round(l_tax * 100) - 4) AS v,
           sum(l_quantity - 25) AS w FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey)"""
PLACES = """places AS (SELECT p_partkey AS vid, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y,
  CAST(p_partkey * 37 % 97 AS DOUBLE) AS z FROM part)"""


def gather_sql(order: str = "corner") -> str:
    cols = ",\n    ".join(
        f"max(CASE WHEN corner = {i} THEN {c} END) AS {c}{i}" for c in ("u", "v", "w", "x", "y", "z") for i in range(4)
    )
    return f"""g AS (SELECT cid,
    {cols},
    max(CASE WHEN corner = 0 THEN c.vid END) AS id0, max(CASE WHEN corner = 1 THEN c.vid END) AS id1,
    max(CASE WHEN corner = 2 THEN c.vid END) AS id2, max(CASE WHEN corner = 3 THEN c.vid END) AS id3
  FROM corners c JOIN vectors f ON f.vid = c.vid JOIN places p ON p.vid = c.vid GROUP BY cid)"""


def minors_sql(source: str, a: str = "0", b: str = "1", c: str = "2", d: str = "3") -> str:
    """Signed 3x3 determinants of the corner vectors, leaving one corner out."""

    def det(i, j, k):
        return (f"(u{i} * (v{j} * w{k} - v{k} * w{j}) - v{i} * (u{j} * w{k} - u{k} * w{j})"
                f" + w{i} * (u{j} * v{k} - u{k} * v{j}))")

    return f"""SELECT *, m0 + m1 + m2 + m3 AS m FROM (
  SELECT *, -{det(b, c, d)} AS m0, {det(a, c, d)} AS m1, -{det(a, b, d)} AS m2, {det(a, b, c)} AS m3 FROM {source})"""


FOUND = f"""minors AS ({minors_sql('g')}),
found AS (SELECT * FROM minors WHERE m <> 0
  AND (m0 = 0 OR m / m0 > 1) AND (m1 = 0 OR m / m1 > 1) AND (m2 = 0 OR m / m2 > 1) AND (m3 = 0 OR m / m3 > 1))"""

# Roots of the characteristic polynomial of the 3x3 Jacobian, entry by entry.
KINDS = """edges3 AS (SELECT cid, m, m0, m1, m2, m3, x0, x1, x2, x3, y0, y1, y2, y3, z0, z1, z2, z3,
    x0-x3 AS a1, y0-y3 AS a2, z0-z3 AS a3, x1-x3 AS b1, y1-y3 AS b2, z1-z3 AS b3, x2-x3 AS c1, y2-y3 AS c2, z2-z3 AS c3,
    u0-u3 AS p1, v0-v3 AS p2, w0-w3 AS p3, u1-u3 AS q1, v1-v3 AS q2, w1-w3 AS q3, u2-u3 AS r1, v2-v3 AS r2, w2-w3 AS r3
  FROM found),
inv AS (SELECT *, a1*(b2*c3-b3*c2) - a2*(b1*c3-b3*c1) + a3*(b1*c2-b2*c1) AS dx FROM edges3),
jac AS (SELECT *,
    ((b2*c3-b3*c2)*p1 + (b3*c1-b1*c3)*p2 + (b1*c2-b2*c1)*p3) / nullif(dx, 0) AS j11,
    ((b2*c3-b3*c2)*q1 + (b3*c1-b1*c3)*q2 + (b1*c2-b2*c1)*q3) / nullif(dx, 0) AS j12,
    ((b2*c3-b3*c2)*r1 + (b3*c1-b1*c3)*r2 + (b1*c2-b2*c1)*r3) / nullif(dx, 0) AS j13,
    ((c2*a3-c3*a2)*p1 + (c3*a1-c1*a3)*p2 + (c1*a2-c2*a1)*p3) / nullif(dx, 0) AS j21,
    ((c2*a3-c3*a2)*q1 + (c3*a1-c1*a3)*q2 + (c1*a2-c2*a1)*q3) / nullif(dx, 0) AS j22,
    ((c2*a3-c3*a2)*r1 + (c3*a1-c1*a3)*r2 + (c1*a2-c2*a1)*r3) / nullif(dx, 0) AS j23,
    ((a2*b3-a3*b2)*p1 + (a3*b1-a1*b3)*p2 + (a1*b2-a2*b1)*p3) / nullif(dx, 0) AS j31,
    ((a2*b3-a3*b2)*q1 + (a3*b1-a1*b3)*q2 + (a1*b2-a2*b1)*q3) / nullif(dx, 0) AS j32,
    ((a2*b3-a3*b2)*r1 + (a3*b1-a1*b3)*r2 + (a1*b2-a2*b1)*r3) / nullif(dx, 0) AS j33 FROM inv),
poly AS (SELECT *, -(j11+j22+j33) AS cb,
    j11*j22-j12*j21 + j11*j33-j13*j31 + j22*j33-j23*j32 AS cc,
    -(j11*(j22*j33-j23*j32) - j12*(j21*j33-j23*j31) + j13*(j21*j32-j22*j31)) AS cd FROM jac),
qr AS (SELECT *, (3*cc - cb*cb)/9 AS q, (-27*cd + cb*(9*cc - 2*cb*cb))/54 AS r FROM poly),
dd AS (SELECT *, q*q*q + r*r AS disc FROM qr),
kinds AS (SELECT *, CASE
    WHEN disc IS NULL OR abs(disc) < pow(2, -52) THEN 0
    WHEN disc > 0 THEN 2 + 2 * (
      CASE WHEN -cb/3 + cbrt(r+sqrt(disc)) + cbrt(r-sqrt(disc)) < 0 THEN 1 ELSE 0 END
      + 2 * CASE WHEN -cb/3 - (cbrt(r+sqrt(disc)) + cbrt(r-sqrt(disc)))/2 < 0 THEN 1 ELSE 0 END)
    ELSE 1 + 2 * (
      CASE WHEN 2*sqrt(-q)*cos(acos(greatest(-1, least(1, r/sqrt(-q*q*q))))/3) - cb/3 < 0 THEN 1 ELSE 0 END
      + CASE WHEN 2*sqrt(-q)*cos((acos(greatest(-1, least(1, r/sqrt(-q*q*q)))) + 2*pi())/3) - cb/3 < 0 THEN 1 ELSE 0 END
      + CASE WHEN 2*sqrt(-q)*cos((acos(greatest(-1, least(1, r/sqrt(-q*q*q)))) + 4*pi())/3) - cb/3 < 0 THEN 1 ELSE 0 END)
    END AS kind FROM dd)"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return tables.once(spark, sf, "vectors", lambda: tables.order_vectors(spark, sf))


@query(with_(TETS, CORNERS, VECTORS, PLACES, gather_sql(), FOUND, KINDS) + """
SELECT cid, floor((m0*x0 + m1*x1 + m2*x2 + m3*x3) / m * 10000 + 0.5) / 10000 AS x,
       floor((m0*y0 + m1*y1 + m2*y2 + m3*y3) / m * 10000 + 0.5) / 10000 AS y,
       floor((m0*z0 + m1*z1 + m2*z2 + m3*z3) / m * 10000 + 0.5) / 10000 AS z, CAST(kind AS INTEGER) AS kind FROM kinds""")
def critical_points(spark, sf):
    """Zeros of the vector field on the order tetrahedra: place and class."""
    found = critical.extract(tables.tets(spark, sf), vectors(spark, sf), tables.positions3(spark, sf))
    # floor, not round: engines break decimal ties of doubles differently
    near = [(F.floor(F.col(c) * 10000 + 0.5) / 10000).alias(c) for c in "xyz"]
    return found.select("cid", *near, "kind")



PROBES = """probes AS (SELECT s_suppkey AS pid, CAST(1 + s_suppkey * 13 % 49 AS DOUBLE) + 0.25::DOUBLE AS px,
  900.0::DOUBLE + CAST(s_suppkey * 29 % 1000 AS DOUBLE) AS py, CAST(s_suppkey * 41 % 96 AS DOUBLE) + 0.5::DOUBLE AS pz FROM supplier)"""
BOXED = " AND ".join(f"p{a} BETWEEN least({a}0, {a}1, {a}2, {a}3) AND greatest({a}0, {a}1, {a}2, {a}3)" for a in "xyz")
VOLUMES = ", ".join(f"{v} AS s{i}" for i, v in enumerate(locate.signed_volumes()))


@query(with_(TETS, CORNERS, VECTORS, PLACES, gather_sql(), PROBES) + f""", held AS (
  SELECT pid, cid, {", ".join(f"(s0 * {n}0 + s1 * {n}1 + s2 * {n}2 + s3 * {n}3) / (s0 + s1 + s2 + s3) AS {n}" for n in "uvw")}
  FROM (SELECT *, {VOLUMES} FROM probes JOIN (SELECT * FROM g WHERE {locate.solid()}) ON {BOXED}) WHERE {locate.INSIDE}
  QUALIFY row_number() OVER (PARTITION BY pid ORDER BY cid) = 1)
SELECT p.pid, h.cid, {", ".join(f"floor(h.{n} * 10000 + 0.5) / 10000 AS {n}" for n in "uvw")}
FROM probes p LEFT JOIN held h ON h.pid = p.pid""")
def locate_points(spark, sf):
    """Smallest order tetrahedron around a point of every supplier, and the vector there."""
    corners = tables.once(spark, sf, "flat-corners", lambda: locate.flat_corners(
        critical.gather_corners(tables.tets(spark, sf), vectors(spark, sf), tables.positions3(spark, sf))))
    key = F.col("s_suppkey")
    points = tables.read(spark, sf, "supplier").select(
        key.alias("pid"), ((1 + key * 13 % 49).cast("double") + 0.25).alias("px"),
        (F.lit(900.0) + (key * 29 % 1000).cast("double")).alias("py"), ((key * 41 % 96).cast("double") + 0.5).alias("pz"),
    )
    found = locate.interpolate(points, locate.locate(points, corners), corners)
    near = [(F.floor(F.col(n) * 10000 + 0.5) / 10000).alias(n) for n in "uvw"]
    return points.select("pid").join(found.select("pid", "cid", *near), "pid", "left")


@query(with_(TETS, CORNERS, VECTORS, PLACES, gather_sql(), FOUND, KINDS) + """,
coarse AS (SELECT vid, round(u / 8) * 8 AS u, round(v / 8) * 8 AS v, round(w / 8) * 8 AS w FROM vectors),
was AS (SELECT cid, kind FROM kinds),
""" + gather_sql().replace("g AS", "g2 AS").replace("JOIN vectors f", "JOIN coarse f") + ", "
       + FOUND.replace("minors AS", "minors2 AS").replace("found AS", "found2 AS").replace("FROM g)", "FROM g2)")
       .replace("FROM minors ", "FROM minors2 ") + ", "
       + KINDS.replace("edges3", "edges32").replace("FROM found)", "FROM found2)").replace("inv AS", "inv2 AS")
       .replace("jac AS", "jac2 AS").replace("FROM inv)", "FROM inv2)").replace("poly AS", "poly2 AS")
       .replace("FROM jac)", "FROM jac2)").replace("qr AS", "qr2 AS").replace("FROM poly)", "FROM poly2)")
       .replace("dd AS", "dd2 AS").replace("FROM qr)", "FROM qr2)").replace("kinds AS", "kinds2 AS")
       .replace("FROM dd)", "FROM dd2)") + """
SELECT CAST(count(a.cid) AS BIGINT) AS truth,
  CAST(count(*) FILTER (WHERE a.kind = b.kind) AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE a.cid IS NULL) AS BIGINT) AS fp,
  CAST(count(*) FILTER (WHERE b.cid IS NULL) AS BIGINT) AS fn, CAST(count(*) FILTER (WHERE a.kind <> b.kind) AS BIGINT) AS ft
FROM was a FULL JOIN kinds2 b ON a.cid = b.cid""")
def critical_point_comparison(spark, sf):
    """Critical points lost, gained or changed by plain rounding to multiples of 8."""
    v = vectors(spark, sf)
    coarse = v.select("vid", *[(F.round(F.col(c) / 8) * 8).cast("float").alias(c) for c in "uvw"])
    pos, cells = tables.positions3(spark, sf), tables.tets(spark, sf)
    return critical.counts(
        critical.compare(critical.extract(cells, v, pos), critical.extract(cells, coarse, pos))
    )


def _margin_sql() -> str:
    """The corner margins with each corner in turn as the changing one."""
    turns = []
    for last in range(4):
        a, b, c = [i for i in range(4) if i != last]
        cols = ", ".join(f"{n}{s} AS {n}{t}" for n in "uvw" for s, t in ((a, 0), (b, 1), (c, 2), (last, 3)))
        turns.append(f"SELECT cid, id{last} AS vid, {cols} FROM g")
    terms = []
    for i, (s, t) in enumerate(((1, 2), (2, 0), (0, 1))):
        terms += [
            f"-u3 * (v{s} * w{t} - w{s} * v{t}) AS e{i}0", f"-v3 * (w{s} * u{t} - u{s} * w{t}) AS e{i}1",
            f"-w3 * (u{s} * v{t} - v{s} * u{t}) AS e{i}2",
        ]

    def margin(parts, fixed="0"):
        a, b, c = parts
        return (f"CASE WHEN {a} = 0 AND {b} = 0 AND {c} = 0 THEN 1 "
                f"ELSE abs({a} + {b} + {c} + {fixed}) / (abs({a}) + abs({b}) + abs({c})) END")

    def inside(i):
        return f"(m{i} = 0 OR m / m{i} > 1)"

    cases = []
    for i in range(3):
        j, k = [o for o in range(3) if o != i]
        both = [f"(e{j}{c} + e{k}{c})" for c in range(3)]
        cases.append(f"CASE WHEN {inside(i)} THEN 0 ELSE least({margin([f'e{i}{c}' for c in range(3)])}, {margin(both, 'm3')}) END")
    every = [f"(e0{c} + e1{c} + e2{c})" for c in range(3)]
    cases.append(f"CASE WHEN {inside(3)} THEN 0 ELSE {margin(every)} END")
    one_sided = " OR ".join(
        f"({' AND '.join(f'{n}{i} {op} 0' for i in range(4))})" for n in "uvw" for op in (">", "<")
    )
    return f"""turned AS ({' UNION ALL '.join(turns)}),
terms AS (SELECT *, {', '.join(terms)}, u0 * (v1 * w2 - w1 * v2) + v0 * (w1 * u2 - u1 * w2) + w0 * (u1 * v2 - v1 * u2) AS m3 FROM turned),
ms AS (SELECT *, e00 + e01 + e02 AS m0, e10 + e11 + e12 AS m1, e20 + e21 + e22 AS m2 FROM terms),
tot AS (SELECT *, m0 + m1 + m2 + m3 AS m FROM ms),
margins AS (SELECT cid, vid, CASE
    WHEN m = 0 THEN CASE WHEN {one_sided} THEN 1.0 ELSE 0.0 END
    WHEN {' AND '.join(inside(i) for i in range(4))} THEN 0.0
    ELSE greatest({', '.join(cases)}) END AS margin FROM tot)"""


@query(with_(TETS, CORNERS, VECTORS, PLACES, gather_sql(), _margin_sql()) + """
SELECT vid, round(least(min(margin), 0.05), 7) AS margin FROM margins GROUP BY vid""")
def preservation_margin(spark, sf):
    """Relative change every vertex tolerates before a critical point appears or goes."""
    m = critical.vertex_margins(tables.tets(spark, sf), vectors(spark, sf), 0.05)
    return m.select("vid", F.round("margin", 7).alias("margin"))


@query(with_(TETS, CORNERS, VECTORS, PLACES, gather_sql(), _margin_sql()) + """,
low AS (SELECT vid, log2(1 + least(min(margin), 0.05)) AS eb FROM margins GROUP BY vid)
SELECT vid, CAST(CASE WHEN eb <= pow(2, -23) THEN 0 ELSE floor(log2(eb / pow(2, -23))) END AS INTEGER) AS level,
  CASE WHEN eb <= pow(2, -23) THEN 0.0 ELSE pow(2, floor(log2(eb / pow(2, -23)))) * pow(2, -23) END AS bound,
  CAST(floor(eb / 0.001) AS INTEGER) AS linear FROM low""")
def bound_levels(spark, sf):
    """Margins in log space, rounded down to the exponential and the linear grid."""
    m = critical.vertex_margins(tables.tets(spark, sf), vectors(spark, sf), 0.05)
    rows = m.select("vid", F.log2(1.0 + F.col("margin")).alias("eb"))
    rows = rows.withColumn("e", scalars.exponential_bound(F.col("eb")))
    return rows.select(
        "vid", F.col("e.id").alias("level"), F.col("e.eb").alias("bound"),
        scalars.linear_bound(F.col("eb"), 0.001)["id"].alias("linear"),
    )


@query(with_(VECTORS) + """SELECT vid, round(CASE WHEN u <> 0 THEN log2(abs(u)) ELSE -100 END, 6) AS lu,
  round(CASE WHEN v <> 0 THEN log2(abs(v)) ELSE -100 END, 6) AS lv,
  round(CASE WHEN w <> 0 THEN log2(abs(w)) ELSE -100 END, 6) AS lw,
  CAST(sign(u) AS INTEGER) AS su, CAST(sign(v) AS INTEGER) AS sv, CAST(sign(w) AS INTEGER) AS sw FROM vectors""")
def log_transform(spark, sf):
    """Magnitudes in log space with explicit signs (zero keeps sign 0)."""
    rows = vectors(spark, sf)
    for c in "uvw":
        rows = rows.withColumn(f"l_{c}", scalars.log_magnitude(F.col(c)))
    return rows.select(
        "vid", *[F.round(F.col(f"l_{c}.lg"), 6).alias(f"l{c}") for c in "uvw"],
        *[F.col(f"l_{c}.sgn").alias(f"s{c}") for c in "uvw"],
    )


@query(with_(TETS, CORNERS, VECTORS, PLACES, gather_sql()) + """
SELECT cid, (u0 > 0 AND u1 > 0 AND u2 > 0 AND u3 > 0) OR (u0 < 0 AND u1 < 0 AND u2 < 0 AND u3 < 0) AS u,
  (v0 > 0 AND v1 > 0 AND v2 > 0 AND v3 > 0) OR (v0 < 0 AND v1 < 0 AND v2 < 0 AND v3 < 0) AS v,
  (w0 > 0 AND w1 > 0 AND w2 > 0 AND w3 > 0) OR (w0 < 0 AND w1 < 0 AND w2 < 0 AND w3 < 0) AS w FROM g""")
def same_direction(spark, sf):
    """Cells in which a component has one sign at all corners (so no zero inside)."""
    rows = critical.gather_corners(tables.tets(spark, sf), vectors(spark, sf))
    return rows.select(
        "cid", *[scalars.same_direction([F.col("c")[i][n] for i in range(4)]).alias(n) for n in "uvw"]
    )


REL = 0.05
CODE_K = 4
ROUNDS = 6
"""Colours that the equivalent unrolls; the tables it is run on need fewer."""


def embedding_distances(spark: SparkSession, sf: str) -> DataFrame:
    cells, pos = tables.embedding_tets(spark, sf), tables.embedding_positions(spark, sf)
    return tables.once(spark, sf, "embedding-distances", lambda: neighbours.with_distance(adjacency.from_cells(cells, 4), pos))


def order_distances(spark: SparkSession, sf: str) -> DataFrame:
    """Lengths of the order mesh's edges in space."""
    pos = tables.positions3(spark, sf)
    return tables.once(spark, sf, "distances3", lambda: neighbours.with_distance(mq.edges(spark, sf), pos))


def _coded(spark: SparkSession, sf: str, name: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(cells, positions, field, blob, decoded) of the embedding or the order mesh."""
    if name == "embedding":
        cells, pos, field = (f(spark, sf) for f in (tables.embedding_tets, tables.embedding_positions, tables.embedding_vectors))
        dist = embedding_distances(spark, sf)
    else:
        cells, pos, field = tables.tets(spark, sf), tables.positions3(spark, sf), vectors(spark, sf)
        dist = order_distances(spark, sf)
    blob = tables.once(spark, sf, f"{name}-cp-blob", lambda: cp.compress(cells, field, dist, REL, CODE_K))
    decoded = tables.once(spark, sf, f"{name}-cp-decoded", lambda: cp.decompress(blob, dist, CODE_K))
    return cells, pos, field, blob, decoded


ETETS = """tets AS (SELECT vec_id // 4 AS cid, list(vec_id ORDER BY vec_id) AS verts FROM embeddings
  GROUP BY 1 HAVING count(*) = 4)"""
EVECTORS = """vectors AS (SELECT vec_id AS vid, CAST(embedding[1] AS DOUBLE) AS u, CAST(embedding[2] AS DOUBLE) AS v,
  CAST(embedding[3] AS DOUBLE) AS w FROM embeddings)"""
EPLACES = """places AS (SELECT vec_id AS vid, CAST(embedding[4] AS DOUBLE) AS x, CAST(embedding[5] AS DOUBLE) AS y,
  CAST(embedding[6] AS DOUBLE) AS z FROM embeddings)"""
EEDGES = """edges AS (
  SELECT DISTINCT a.vid AS src, b.vid AS dst FROM corners a JOIN corners b ON a.cid = b.cid AND a.vid <> b.vid)"""
DIST3 = """dists AS (
  SELECT e.src, e.dst, sqrt((s.x - d.x) * (s.x - d.x) + (s.y - d.y) * (s.y - d.y) + (s.z - d.z) * (s.z - d.z)) AS dist
  FROM edges e JOIN places s ON s.vid = e.src JOIN places d ON d.vid = e.dst)"""


def _renamed(sql: str, suffix: str) -> str:
    return re.sub(r"\b(g|turned|terms|ms|tot|margins)\b(?=\)| AS \(|,| GROUP|$| UNION)", rf"\1{suffix}", sql)


def _coding_sql() -> str:
    """Colours and then, colour by colour, allowances, predictions and coded vectors."""
    log = lambda c: f"CAST(CASE WHEN {c} <> 0 THEN log2(abs({c})) ELSE -100 END AS FLOAT)"
    out = [
        _renamed(gather_sql(), "_0"), _renamed(_margin_sql(), "_0"),
        f"""free AS MATERIALIZED (
  SELECT v.vid, ((v.vid % 2147483648) * {MULTIPLIER} % {MODULUS}) AS turn
  FROM vectors v LEFT JOIN (SELECT vid, min(margin) AS margin FROM margins_0 GROUP BY vid) m ON m.vid = v.vid
  WHERE coalesce(margin, {REL}) >= {cp.SMALLEST}),
left0 AS (SELECT vid, turn FROM free)""",
    ]
    for c in range(ROUNDS):
        out.append(f"""left{c + 1} AS MATERIALIZED (SELECT DISTINCT vid, turn FROM (
  SELECT l.vid, l.turn, row_number() OVER (PARTITION BY cid ORDER BY turn, l.vid) AS n FROM corners JOIN left{c} l ON l.vid = corners.vid) WHERE n > 1)""")
    painted = " UNION ALL ".join(f"(SELECT vid, {c} AS c FROM left{c} EXCEPT SELECT vid, {c} FROM left{c + 1})" for c in range(ROUNDS))
    out.append(f"""painted AS MATERIALIZED ({painted}),
paint AS MATERIALIZED (SELECT v.vid, coalesce(p.c, -1) AS c FROM vectors v LEFT JOIN painted p ON p.vid = v.vid),
near AS MATERIALIZED (
  SELECT src, c, dst, rn, CASE WHEN dist > 0 THEN 1.0::DOUBLE / dist ELSE 1e300::DOUBLE END AS w
  FROM (SELECT d.src, a.c, d.dst, d.dist, row_number() OVER (PARTITION BY d.src ORDER BY d.dist, d.dst) AS rn
        FROM dists d JOIN paint a ON a.vid = d.src AND a.c >= 0 JOIN paint b ON b.vid = d.dst WHERE b.c < a.c) WHERE rn <= {CODE_K}),
cur0 AS (SELECT vid, u, v, w FROM vectors)""")
    for c in range(ROUNDS):
        held = f"(SELECT * FROM corners WHERE cid IN (SELECT cid FROM corners JOIN painted USING (vid) WHERE c = {c})) c"
        at = f"_{c + 1}"
        pick = lambda what: " + ".join(f"coalesce(max(CASE WHEN rn = {j} THEN {what} END), 0.0::DOUBLE)" for j in range(1, CODE_K + 1))
        sums = ", ".join(f"{pick(f'n.w * CAST({log(f'k.{p}')} AS DOUBLE)')} AS n{p}" for p in "uvw")
        means = ", ".join(f"CASE WHEN d.den > 0 THEN d.n{p} / d.den ELSE 0.0::DOUBLE END AS p{p}" for p in "uvw")
        half = lambda p: f"CASE WHEN l{p} > p{p} THEN floor((abs(l{p} - p{p}) / eb + 1) / 2) ELSE -floor((abs(l{p} - p{p}) / eb + 1) / 2) END"
        fits = " AND ".join(
            f"abs(l{p} - p{p}) / eb + 1 < {scalars.CAPACITY} AND abs(CAST(d{p} AS DOUBLE) - l{p}) < eb"
            f" AND abs(CAST(CAST(sign({p}) * pow(2, CAST(d{p} AS DOUBLE)) AS FLOAT) AS DOUBLE) - {p}) <= rel * abs({p})" for p in "uvw"
        )
        out.append(_renamed(gather_sql(), at).replace("corners c JOIN vectors f", f"{held} JOIN cur{c} f"))
        out.append(_renamed(_margin_sql(), at))
        out.append(f"""pred{c} AS (SELECT n.src AS vid, {pick("n.w")} AS den, {sums} FROM near n JOIN cur{c} k ON k.vid = n.dst WHERE n.c = {c} GROUP BY n.src),
rel{c} AS (
  SELECT v.*, {means}, least(coalesce(m.margin, {REL}), {REL}::DOUBLE) AS rel
  FROM painted q JOIN vectors v ON v.vid = q.vid AND q.c = {c} LEFT JOIN pred{c} d ON d.vid = q.vid
       LEFT JOIN (SELECT vid, min(margin) AS margin FROM margins{at} GROUP BY vid) m ON m.vid = q.vid),
lev{c} AS (
  SELECT *, CASE WHEN rel < {cp.SMALLEST} OR log2(1 + rel) <= pow(2, -23) THEN 0 ELSE CAST(floor(log2(log2(1 + rel) / pow(2, -23))) AS INTEGER) END AS level,
         {", ".join(f"CAST({log(p)} AS DOUBLE) AS l{p}" for p in "uvw")} FROM rel{c}),
eb{c} AS (SELECT *, pow(2, level) * pow(2, -23) AS eb FROM lev{c}),
half{c} AS (SELECT *, {", ".join(f"{half(p)} AS h{p}" for p in "uvw")} FROM eb{c}),
dec{c} AS (SELECT *, {", ".join(f"CAST(p{p} + 2.0::DOUBLE * h{p} * eb AS FLOAT) AS d{p}" for p in "uvw")} FROM half{c}),
code{c} AS MATERIALIZED (
  SELECT vid, level > 0 AND {fits} AS good, level, {scalars.RADIUS} * 3 + hu + hv + hw AS q,
         {", ".join(f"CAST(CAST(sign({p}) * pow(2, CAST(d{p} AS DOUBLE)) AS FLOAT) AS DOUBLE) AS {p}" for p in "uvw")} FROM dec{c}),
cur{c + 1} AS MATERIALIZED (
  SELECT k.vid, {", ".join(f"CASE WHEN d.good THEN d.{p} ELSE k.{p} END AS {p}" for p in "uvw")} FROM cur{c} k LEFT JOIN code{c} d ON d.vid = k.vid)""")
    every = " UNION ALL ".join(f"SELECT * FROM code{c}" for c in range(ROUNDS))
    out.append(f"code AS ({every})")
    return ",\n".join(out)


PER_VERTEX = f""" SELECT v.vid, p.c AS colour, CAST(CASE WHEN d.good THEN d.level ELSE 0 END AS INTEGER) AS level,
  CAST(CASE WHEN d.good THEN d.q END AS BIGINT) AS q, CAST(floor(k.u * 1000 + 0.5) AS BIGINT) AS u, CAST(floor(k.v * 1000 + 0.5) AS BIGINT) AS v, CAST(floor(k.w * 1000 + 0.5) AS BIGINT) AS w, true AS ok
FROM vectors v JOIN paint p ON p.vid = v.vid LEFT JOIN code d ON d.vid = v.vid JOIN cur{ROUNDS} k ON k.vid = v.vid"""
TRUTH = f""", held AS (SELECT CAST(count(*) AS BIGINT) AS truth FROM found)
SELECT truth, truth AS tp, CAST(0 AS BIGINT) AS fp, CAST(0 AS BIGINT) AS fn, CAST(0 AS BIGINT) AS ft,
  (SELECT count(*) FROM free) AS free, (SELECT count(*) FROM code WHERE good) AS coded,
  (SELECT count(*) FROM cur0 a JOIN cur{ROUNDS} b ON a.vid = b.vid WHERE a.u <> b.u OR a.v <> b.v OR a.w <> b.w) AS changed,
  (SELECT CAST(coalesce(sum(level), 0) AS BIGINT) FROM code WHERE good) AS level_sum, (SELECT CAST(coalesce(sum(q), 0) AS BIGINT) FROM code WHERE good) AS q_sum
FROM held"""
EMBEDDED = with_(ETETS, CORNERS, EVECTORS, EPLACES, EEDGES, DIST3, gather_sql(), FOUND, _coding_sql())
ORDERED = with_(EDGES, VECTORS, PLACES, DIST3, gather_sql(), FOUND, _coding_sql())


def _per_vertex(spark: SparkSession, sf: str, name: str) -> DataFrame:
    _, _, field, blob, decoded = _coded(spark, sf, name)
    dec = decoded.select("vid", *[F.col(c).alias(f"d{c}") for c in "uvw"])
    ok = F.lit(True)
    for c in "uvw":
        x, d = F.col(c).cast("double"), F.col(f"d{c}").cast("double")
        ok = ok & (F.abs(d - x) <= REL * F.abs(x))
    q = F.aggregate(F.transform("q", lambda x: x.cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return field.join(dec, "vid").join(blob, "vid").select(
        "vid", "colour", "level", q.alias("q"), *[F.floor(F.col(f"d{c}").cast("double") * 1000 + 0.5).alias(c) for c in "uvw"], ok.alias("ok")
    )


def _preserved(spark: SparkSession, sf: str, name: str) -> DataFrame:
    cells, pos, field, blob, decoded = _coded(spark, sf, name)
    counts = critical.counts(critical.compare(critical.extract(cells, field, pos), critical.extract(cells, decoded, pos)))
    dec = decoded.select("vid", *[F.col(c).alias(f"d{c}") for c in "uvw"])
    moved = field.join(dec, "vid").agg(F.count_if(~(F.col("u").eqNullSafe(F.col("du")) & F.col("v").eqNullSafe(F.col("dv")) & F.col("w").eqNullSafe(F.col("dw")))).alias("changed"))
    q = F.aggregate(F.transform("q", lambda x: x.cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    coded = blob.agg(
        F.count_if(F.col("colour") >= 0).alias("free"), F.count_if(F.col("level") > 0).alias("coded"),
        F.sum(F.col("level").cast("bigint")).alias("level_sum"), F.coalesce(F.sum(q), F.lit(0)).alias("q_sum"),
    )
    # three tables of one row each
    keyed = [t.withColumn("_one", F.lit(1)) for t in (counts, moved, coded)]
    return keyed[0].join(keyed[1], "_one").join(keyed[2], "_one").select("truth", "tp", "fp", "fn", "ft", "free", "coded", "changed", "level_sum", "q_sum")


@query(EMBEDDED + PER_VERTEX)
def roundtrip_critical(spark, sf):
    """Critical-point preserving round trip: colour, bound level, index sum and decoded vector (in thousandths) of every vertex."""
    return _per_vertex(spark, sf, "embedding")


@query(EMBEDDED + TRUTH)
def preserved_critical_points(spark, sf):
    """Critical points before and after the preserving round trip: none lost, new or changed."""
    return _preserved(spark, sf, "embedding")


@query(ORDERED + TRUTH)
def preserved_critical_points_across_parts(spark, sf):
    """The same on the connected order mesh, coded over the whole mesh."""
    return _preserved(spark, sf, "order")
