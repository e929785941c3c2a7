"""Critical points (zeros) of a piecewise linear vector field on tetrahedra."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import tetra


def gather_corners(cells: DataFrame, vectors: DataFrame, positions: DataFrame | None = None) -> DataFrame:
    """(cid, c): the four corners in order, each with u, v, w and optionally pos.

    Every vertex is looked up by id; a group of the final aggregation has four rows.
    """
    attrs = vectors if positions is None else vectors.join(positions, "vid")
    names = [c for c in attrs.columns if c != "vid"]
    long = cells.select("cid", F.posexplode("verts").alias("corner", "vid")).join(attrs, "vid")
    return long.groupBy("cid").agg(
        F.array_sort(F.collect_list(F.struct("corner", "vid", *names))).alias("c")
    )


def settle(rows: DataFrame) -> DataFrame:
    """Evaluate the columns so far exactly once.

    Long formulas reuse intermediate columns many times. A one-element explode is
    a boundary the optimizer neither inlines projections nor pushes filters
    through, so each step stays small enough to be compiled.
    """
    return rows.select(F.explode(F.array(F.struct("*"))).alias("r")).select("r.*")


def _with_weights(rows: DataFrame) -> tuple[DataFrame, list, list, object, list, object]:
    """Add corner weights to rows with columns u0..w3; returns the handles too."""
    p = [tuple(F.col(f"{n}{i}") for n in "uvw") for i in range(4)]
    terms, last = tetra.face_terms(p)
    rows = settle(rows).withColumns(
        {f"e{i}{c}": terms[i][c] for i in range(3) for c in range(3)} | {"m3": last}
    )
    terms = [tuple(F.col(f"e{i}{c}") for c in range(3)) for i in range(3)]
    m, _ = tetra.totals(terms, F.col("m3"))
    rows = rows.withColumns({f"m{i}": m[i] for i in range(3)})
    m = [F.col(f"m{i}") for i in range(4)]
    rows = settle(rows.withColumn("m", m[0] + m[1] + m[2] + m[3]))
    return rows, p, terms, F.col("m3"), m, F.col("m")


# Fixed values of the class of a zero: 0 is degenerate; otherwise
# 1 + 2 * (number of eigenvalues with negative real part), plus one when two
# eigenvalues are complex.
DEGENERATE = 0


def with_kind(rows: DataFrame) -> DataFrame:
    """Add ``kind`` to rows with corner vectors u0..w3 and positions x0..z3.

    With edge matrices X (positions) and U (vectors) the Jacobian is inv(X) U up to
    a change of basis. Its characteristic polynomial is solved in closed form.
    """
    edges = {f"d{n}{i}": F.col(f"{n}{i}") - F.col(f"{n}3") for n in "uvwxyz" for i in range(3)}
    rows = settle(rows.withColumns(edges))
    ex = [tuple(F.col(f"d{n}{i}") for n in "xyz") for i in range(3)]
    ep = [tuple(F.col(f"d{n}{i}") for n in "uvw") for i in range(3)]
    pairs = ((1, 2), (2, 0), (0, 1))
    normals = [tetra.cross(ex[a], ex[b]) for a, b in pairs]
    rows = rows.withColumns({f"cx{i}{axis}": normals[i][axis] for i in range(3) for axis in range(3)})
    cx = [tuple(F.col(f"cx{i}{axis}") for axis in range(3)) for i in range(3)]
    rows = settle(rows.withColumn("det_x", tetra.dot(ex[0], cx[0])))
    jacobian = {
        f"j{i}{k}": F.try_divide(tetra.dot(cx[i], ep[k]), F.col("det_x")) for i in range(3) for k in range(3)
    }
    rows = settle(rows.withColumns(jacobian))
    j = [[F.col(f"j{i}{k}") for k in range(3)] for i in range(3)]
    det = (
        j[0][0] * (j[1][1] * j[2][2] - j[1][2] * j[2][1])
        - j[0][1] * (j[1][0] * j[2][2] - j[1][2] * j[2][0])
        + j[0][2] * (j[1][0] * j[2][1] - j[1][1] * j[2][0])
    )
    rows = rows.withColumns(
        {
            "pb": -(j[0][0] + j[1][1] + j[2][2]),
            "pc": j[0][0] * j[1][1] - j[0][1] * j[1][0] + j[0][0] * j[2][2] - j[0][2] * j[2][0]
            + j[1][1] * j[2][2] - j[1][2] * j[2][1],
            "pd": -det,
        }
    )
    rows = settle(rows)
    b, c, d = F.col("pb"), F.col("pc"), F.col("pd")
    rows = rows.withColumns(
        {"cq": (3.0 * c - b * b) / 9.0, "cr": (-27.0 * d + b * (9.0 * c - 2.0 * b * b)) / 54.0}
    )
    q, r, shift = F.col("cq"), F.col("cr"), -b / 3.0
    rows = rows.withColumn("disc", q * q * q + r * r).withColumns(
        {"root": F.sqrt(F.greatest(F.col("disc"), F.lit(0.0))), "size": F.sqrt(F.greatest(-q, F.lit(0.0)))}
    )
    size = F.col("size")
    cosine = F.coalesce(F.try_divide(r, size * size * size), F.lit(0.0))
    rows = rows.withColumns(
        {
            "s": F.cbrt(r + F.col("root")) + F.cbrt(r - F.col("root")),
            "angle": F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0))),
        }
    )
    rows = settle(rows)
    s, angle = F.col("s"), F.col("angle")
    two_complex = (shift + s < 0).cast("int") + 2 * (shift - s / 2.0 < 0).cast("int")
    three_real = sum(
        ((2.0 * size * F.cos((angle + F.lit(2.0 * math.pi * k)) / 3.0) + shift < 0).cast("int") for k in range(3)),
        F.lit(0),
    )
    disc = F.col("disc")
    kind = (
        F.when(disc.isNull() | (F.abs(disc) < 2.0**-52), F.lit(DEGENERATE))
        .when(disc > 0, 2 + 2 * two_complex)
        .otherwise(1 + 2 * three_real)
    )
    return rows.withColumn("kind", kind.cast("int"))


def extract(cells: DataFrame, vectors: DataFrame, positions: DataFrame) -> DataFrame:
    """(cid, x, y, z, kind) of every tetrahedron that holds a zero."""
    rows = gather_corners(cells, vectors, positions).select(
        "cid",
        *[F.col("c")[i][n].cast("double").alias(f"{n}{i}") for n in "uvw" for i in range(4)],
        *[F.col("c")[i]["pos"][a].alias(f"{n}{i}") for a, n in enumerate("xyz") for i in range(4)],
    )
    rows, _, _, _, m, total = _with_weights(rows)
    hit = with_kind(rows.where(tetra.contains_zero(m, total)))
    place = [sum((m[i] * F.col(f"{n}{i}") for i in range(1, 4)), m[0] * F.col(f"{n}0")) / total for n in "xyz"]
    return hit.select("cid", *[e.alias(n) for e, n in zip(place, "xyz")], "kind")


def corner_margins(cells: DataFrame, vectors: DataFrame) -> DataFrame:
    """(vid, cid, margin): how far each corner may change before a zero appears or goes.

    Every cell is turned four times so that each corner comes last once.
    """
    c = F.col("c")
    turns = [
        F.struct(*[c[i].alias(f"t{place}") for place, i in enumerate([j for j in range(4) if j != last] + [last])])
        for last in range(4)
    ]
    turned = gather_corners(cells, vectors).select("cid", F.explode(F.array(*turns)).alias("t"))
    rows = turned.select(
        "cid", F.col("t.t3.vid").alias("vid"),
        *[F.col(f"t.t{i}.{n}").cast("double").alias(f"{n}{i}") for n in "uvw" for i in range(4)],
    )
    rows, p, terms, last, m, total = _with_weights(rows)
    margin = tetra.change_margin(tetra.Columns, p, terms, last, m, total)
    return rows.select("vid", "cid", margin.alias("margin"))


def vertex_margins(cells: DataFrame, vectors: DataFrame, cap: float) -> DataFrame:
    """(vid, margin): smallest margin over the incident cells, at most ``cap``."""
    low = corner_margins(cells, vectors).groupBy("vid").agg(F.min("margin").alias("m"))
    return low.select("vid", F.least("m", F.lit(cap)).alias("margin"))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per cell: kept (tp), lost (fn), new (fp) or changed class (ft)."""
    a = before.select("cid", F.col("kind").alias("was"))
    b = after.select("cid", F.col("kind").alias("now"))
    verdict = (
        F.when(F.col("was").isNull(), "fp")
        .when(F.col("now").isNull(), "fn")
        .when(F.col("was") == F.col("now"), "tp")
        .otherwise("ft")
    )
    return a.join(b, "cid", "full").select("cid", verdict.alias("verdict"))


def counts(comparison: DataFrame) -> DataFrame:
    v = F.col("verdict")
    return comparison.agg(
        F.count_if(v.isin("tp", "fn", "ft")).alias("truth"),
        *[F.count_if(v == n).alias(n) for n in ("tp", "fp", "fn", "ft")],
    )
