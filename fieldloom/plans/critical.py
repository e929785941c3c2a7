"""Compression of a vector field that keeps every critical point, over a whole mesh.

A vertex may change as far as its cells allow without a zero appearing or going. On a cell
that holds a zero no corner may change, so most vertices of a field full of zeros are
stored as they are, and only the *free* ones take part in what follows.

Two corners of one cell must not change at once, since the allowance of each holds for the
others as they stand. So free vertices are coloured: a vertex takes the round's colour if it
comes first, by the hash of its id, among the uncoloured free corners of all its cells.
Colour after colour, allowances are worked out again on what earlier colours decoded to, and
the vertices are coded in log space from their nearest neighbours of smaller colours. No
part cuts a cell, and every step is joins and aggregations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.scalars import dequantize, exponential_bound, log_magnitude, quantize
from fieldloom.operators import critical
from fieldloom.operators.neighbours import nearest, raw_weight
from fieldloom.plans.sweeps import MODULUS, MULTIPLIER
from fieldloom.session import materialize

SMALLEST = 1e-10
"""Fixed value: smaller relative bounds mean "store verbatim"."""

PARTS = ("u", "v", "w")
FROZEN = -1
"""Colour of the vertices that are stored as they are and known to all others."""


def _turn(vid: str = "vid") -> Column:
    """Order in which free vertices take colours."""
    return F.pmod(F.pmod(F.col(vid), F.lit(1 << 31)) * F.lit(MULTIPLIER), F.lit(MODULUS))


def free_vertices(cells: DataFrame, vectors: DataFrame, max_rel: float) -> DataFrame:
    """(vid) of the vertices that may change at all, those on no cell included."""
    margins = critical.vertex_margins(cells, vectors, max_rel)
    allowed = vectors.select("vid").join(margins, "vid", "left")
    return allowed.where(F.coalesce("margin", F.lit(max_rel)) >= SMALLEST).select("vid")


def exclusive_colours(cells: DataFrame, free: DataFrame) -> DataFrame:
    """(vid, colour) of the ``free`` vertices; no two corners of a cell share a colour.

    A round is one pass: what is not first in all its cells waits for the next. Rounds end
    when none is left, and every round colours at least the first vertex of all.
    """
    corners = materialize(cells.select("cid", F.explode("verts").alias("vid")).distinct().join(free, "vid"), "cp-corners")
    left, done = materialize(free, "cp-free"), []
    while not left.isEmpty():
        mine = corners.join(left, "vid").select("cid", "vid", F.struct(_turn().alias("turn"), "vid").alias("s"))
        first = mine.groupBy("cid").agg(F.min("s").alias("first"))
        waits = materialize(mine.join(first, "cid").where(F.col("s") != F.col("first")).select("vid").distinct(), "cp-waits")
        done.append(left.join(waits, "vid", "left_anti").withColumn("colour", F.lit(len(done))))
        left = waits
    none = free.limit(0).withColumn("colour", F.lit(0))
    return materialize(reduce(DataFrame.unionByName, done, none), "cp-colours")


def _causal(distances: DataFrame, paint: DataFrame, k: int) -> DataFrame:
    """(vid, colour, rn, raw, src): the nearest neighbours of a smaller colour."""
    here = paint.where(F.col("colour") > FROZEN).select(F.col("vid").alias("src"), F.col("colour").alias("to"))
    there = paint.select(F.col("vid").alias("dst"), F.col("colour").alias("at"))
    earlier = distances.join(here, "src").join(there, "dst").where("at < to")
    near = nearest(earlier, k).select(F.col("src").alias("vid"), F.col("to").alias("colour"), "rn", raw_weight().alias("raw"), F.col("dst").alias("src"))
    return materialize(near, "cp-causal")


def _log(value: Column) -> Column:
    return log_magnitude(value)["lg"].cast("float")


def _predicted(near: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """(vid, p_u, p_v, p_w): weighted mean of the neighbours' logarithms, nearest first."""
    values = known.select(F.col("vid").alias("src"), *[_log(F.col(c)).cast("double").alias(c) for c in PARTS])
    pick = lambda j, c: F.coalesce(F.max(F.when(F.col("rn") == j, c)), F.lit(0.0))
    total = lambda c: reduce(lambda a, b: a + b, [pick(j, c) for j in range(1, k + 1)])
    sums = near.join(values, "src").groupBy("vid").agg(total(F.col("raw")).alias("den"), *[total(F.col("raw") * F.col(c)).alias(c) for c in PARTS])
    return sums.select("vid", *[F.when(F.col("den") > 0, F.col(c) / F.col("den")).otherwise(0.0).alias(f"p_{c}") for c in PARTS])


def _now(vectors: DataFrame, coded: DataFrame | None) -> DataFrame:
    """The field with what is decoded so far in place."""
    if coded is None:
        return vectors.select("vid", *PARTS)
    dec = coded.select("vid", *[F.col(c).alias(f"d_{c}") for c in PARTS])
    return vectors.join(dec, "vid", "left").select("vid", *[F.coalesce(f"d_{c}", c).alias(c) for c in PARTS])


def _value(sign: Column, log: Column) -> Column:
    return (sign * F.pow(F.lit(2.0), log.cast("double"))).cast("float")


def _bound(level: Column) -> Column:
    return exponential_bound(F.pow(F.lit(2.0), level) * F.lit(2.0**-23))["eb"]


def compress(cells: DataFrame, vectors: DataFrame, distances: DataFrame, max_rel: float, k: int = 4) -> DataFrame:
    """(vid, colour, level, q, sgn, raw): one row per vertex of ``vectors`` (vid, u, v, w).

    ``level`` names the bound of a coded vertex (``exponential_bound`` in log space), ``q``
    and ``sgn`` its three indices and signs; level 0 keeps the vector in ``raw``. ``distances``
    (src, dst, dist) hold both directions.
    """
    vectors = materialize(vectors.select("vid", *[F.col(c).cast("float").alias(c) for c in PARTS]), "cp-vectors")
    colours = exclusive_colours(cells, free_vertices(cells, vectors, max_rel))
    paint = vectors.select("vid").join(colours, "vid", "left").select("vid", F.coalesce("colour", F.lit(FROZEN)).alias("colour"))
    near = _causal(distances, paint, k)
    last = colours.agg(F.max("colour")).first()[0]
    coded = None
    for c in range(0 if last is None else last + 1):
        mine = colours.where(F.col("colour") == c)
        known = _now(vectors, coded)
        held = cells.select("cid", F.explode("verts").alias("vid")).join(mine, "vid").select("cid").distinct()
        margins = critical.corner_margins(cells.join(held, "cid", "left_semi"), known).join(mine.select("vid"), "vid")
        low = margins.groupBy("vid").agg(F.min("margin").alias("margin"))
        rows = mine.join(vectors, "vid").join(low, "vid", "left").join(_predicted(near.where(F.col("colour") == c), known, k), "vid", "left")
        rel = F.least(F.coalesce("margin", F.lit(max_rel)), F.lit(max_rel))
        rows = rows.withColumn("rel", F.when(rel >= SMALLEST, rel).otherwise(0.0))
        # each step is evaluated once, or the formulas would be copied into one another
        rows = critical.settle(rows.withColumns({"b": exponential_bound(F.log2(1.0 + F.col("rel"))), **{f"l_{p}": log_magnitude(F.col(p)) for p in PARTS}}))
        logs = {p: quantize(F.col(f"l_{p}.lg").cast("float"), F.coalesce(f"p_{p}", F.lit(0.0)), F.col("b.eb")) for p in PARTS}
        rows = critical.settle(rows.withColumns({f"s_{p}": logs[p] for p in PARTS}))
        rows = critical.settle(rows.withColumns({f"d_{p}": _value(F.col(f"l_{p}.sgn"), F.col(f"s_{p}.dec")) for p in PARTS}))
        near_enough = [F.abs(F.col(f"d_{p}").cast("double") - F.col(p).cast("double")) <= F.col("rel") * F.abs(F.col(p).cast("double")) for p in PARTS]
        good = reduce(lambda a, b: a & b, [F.col("b.id") > 0, *[F.col(f"s_{p}.q") > 0 for p in PARTS], *near_enough])
        out = critical.settle(rows.withColumn("good", good)).select(
            "vid", "colour", F.when(F.col("good"), F.col("b.id")).otherwise(0).alias("level"),
            F.when(F.col("good"), F.array(*[F.col(f"s_{p}.q") for p in PARTS])).alias("q"),
            F.when(F.col("good"), F.array(*[F.col(f"l_{p}.sgn") for p in PARTS])).alias("sgn"),
            F.when(~F.col("good"), F.array(*PARTS)).alias("raw"),
            *[F.when(F.col("good"), F.col(f"d_{p}")).otherwise(F.col(p)).alias(p) for p in PARTS],
        )
        out = materialize(out, f"cp-colour-{c}")
        coded = out if coded is None else coded.unionByName(out)
    kept = paint.where(F.col("colour") == FROZEN).join(vectors, "vid").select(
        "vid", "colour", F.lit(0).alias("level"), F.lit(None).cast("array<int>").alias("q"), F.lit(None).cast("array<int>").alias("sgn"), F.array(*PARTS).alias("raw")
    )
    return kept if coded is None else kept.unionByName(coded.drop(*PARTS))


def decompress(blob: DataFrame, distances: DataFrame, k: int = 4) -> DataFrame:
    """(vid, u, v, w) from the blob and the mesh alone, colour after colour."""
    paint = blob.select("vid", "colour")
    near = _causal(distances, paint, k)
    verbatim = [F.col("raw")[i].alias(c) for i, c in enumerate(PARTS)]
    done = materialize(blob.where(F.col("colour") == FROZEN).select("vid", *verbatim), "cp-known")
    last = blob.agg(F.max("colour")).first()[0]
    for c in range(0 if last is None else last + 1):
        rows = blob.where(F.col("colour") == c).join(_predicted(near.where(F.col("colour") == c), done, k), "vid", "left")
        eb = _bound(F.col("level"))
        out = []
        for i, p in enumerate(PARTS):
            log = dequantize(F.col("q")[i], F.coalesce(f"p_{p}", F.lit(0.0)), eb, F.lit(None).cast("float"))
            out.append(F.when(F.col("level") > 0, _value(F.col("sgn")[i], log)).otherwise(F.col("raw")[i]).alias(p))
        done = done.unionByName(materialize(rows.select("vid", *out), f"cp-decoded-{c}"))
    return done
