"""Per-part least squares from sums, and its quantized coefficients."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.ranking import grouped_lag, grouped_running_sum

COEFFICIENT_BOUND = 0.1
"""Fixed value: coefficients are kept within 0.1 / (d + 1), whatever the field's bound."""


def design_row(pos: Column) -> Column:
    """[1, x1..xd]."""
    return F.concat(F.array(F.lit(1.0)), pos)


def _pseudo_inverse(moments: pd.Series) -> pd.Series:
    flat = np.stack(moments.to_list())
    d = int(round(flat.shape[1] ** 0.5))
    inv = np.linalg.pinv(flat.reshape(-1, d, d), rcond=1e-12, hermitian=True)
    return pd.Series(list(inv.reshape(len(flat), -1)))


def fit_parts(laid: DataFrame, mesh: DataFrame, d: int) -> DataFrame:
    """(part, tb, var, i, n, coefs): [mean, slopes] around the part's centre.

    One map-side combined aggregation of sums per (part, step, variable). The
    d x d moments depend on the mesh only; collinear parts get the pseudo-inverse.
    """
    pairs = [(a, b) for a in range(d) for b in range(d)]
    moments = mesh.groupBy("part").agg(
        F.array(*[F.sum(F.col("pos")[a] * F.col("pos")[b]) for a, b in pairs]).alias("m")
    )
    inverse = moments.select("part", F.pandas_udf(_pseudo_inverse, "array<double>")("m").alias("inv"))
    long = laid.join(mesh.select("vid", "pos"), "vid").select(
        "part", "tb", "var", "pos", F.posexplode("vals").alias("i", "val")
    )
    val = F.col("val").cast("double")
    sums = long.groupBy("part", "tb", "var", "i").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(val).alias("mean"),
        *[F.sum(val * F.col("pos")[a]).alias(f"s{a}") for a in range(d)],
    )
    slopes = [
        sum((F.col("inv")[a * d + b] * F.col(f"s{b}") for b in range(d)), F.lit(0.0)) for a in range(d)
    ]
    return sums.join(inverse, "part").select(
        "part", "tb", "var", "i", "n", F.array("mean", *slopes).alias("coefs")
    )


def quantize_coefficients(fits: DataFrame, d: int) -> DataFrame:
    """Add ``grid`` (whole steps) and ``kept`` (recovered coefficients).

    Delta-coding a coefficient against the previous *recovered* one with a uniform
    step is the same as rounding every coefficient to the step's grid and taking
    differences of grid numbers: the recovered values are grid points by
    induction. So parts do not have to wait for each other.
    """
    step = 2.0 * COEFFICIENT_BOUND / (d + 1)
    grid = F.transform("coefs", lambda c: F.floor(c / F.lit(step) + 0.5).cast("bigint"))
    return fits.withColumn("grid", grid).withColumn(
        "kept", F.transform("grid", lambda g: g * F.lit(step))
    )


def coefficient_deltas(fits: DataFrame) -> DataFrame:
    """Grid differences against the previous part of the same step and variable."""
    lagged = grouped_lag(fits, ["tb", "var", "i"], "part", "before", value="grid")
    zeros = F.transform("grid", lambda g: g * 0)
    return lagged.withColumn(
        "delta", F.zip_with("grid", F.coalesce("before", zeros), lambda a, b: a - b)
    ).drop("before")


def coefficients_from_deltas(deltas: DataFrame, d: int) -> DataFrame:
    """Grid numbers back from their differences: a running sum over the parts."""
    out = deltas
    for a in range(d + 1):
        out = grouped_running_sum(
            out.withColumn("_d", F.col("delta")[a]), ["tb", "var", "i"], "part", "_d", f"g{a}"
        ).drop("_d")
    return out.withColumn("restored", F.array(*[F.col(f"g{a}") for a in range(d + 1)])).drop(
        *[f"g{a}" for a in range(d + 1)]
    )


def predicted(kept: Column, pos: Column, d: int) -> Column:
    """Design row times coefficients, term by term."""
    row = design_row(pos)
    return sum((kept[a] * row[a] for a in range(1, d + 1)), kept[0])


def as_side_rows(fits: DataFrame, flag: Column) -> DataFrame:
    """(part, tb, var, aux): [flag, coefficients] of all steps of a block, flattened."""
    row = F.concat(F.array(flag.cast("double")), F.col("kept"))
    ordered = F.array_sort(F.collect_list(F.struct("i", row.alias("row"))))
    return fits.groupBy("part", "tb", "var").agg(
        F.flatten(F.transform(ordered, lambda s: s["row"])).alias("aux")
    )


def sampled(slot: Column, smallest: Column, size: Column) -> Column:
    """Evenly spread sample positions below the smallest block size."""
    return (slot < smallest) & ((slot * size) % smallest < size)


def compare_predictors(
    laid: DataFrame, mesh: DataFrame, fits: DataFrame, k: int, sampling: float, d: int
) -> DataFrame:
    """Fits plus ``nbr_err``, ``reg_err`` and ``use_fit``: which predictor a block prefers.

    Both absolute errors are summed over the same sampled slots, with original
    neighbour values; ties go to the neighbours.
    """
    sizes = mesh.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    smallest = sizes.agg(F.min("n")).head()[0]
    size = max(1, int(smallest * sampling))
    spots = mesh.where(sampled(F.col("slot").cast("bigint"), F.lit(smallest), F.lit(size)))
    wide = F.transform("nbr_raw", lambda r: r / F.aggregate("nbr_raw", F.lit(0.0), lambda a, b: a + b))
    near = spots.select(
        "part", "slot", F.slice("nbr_slots", 1, k).alias("nbr_slots"), F.slice("nbr_raw", 1, k).alias("nbr_raw")
    ).select("part", "slot", F.explode(F.arrays_zip("nbr_slots", wide.alias("w"))).alias("z"))
    links = near.select("part", "slot", F.col("z.nbr_slots").alias("from"), F.col("z.w").alias("w"))
    values = laid.select("part", "tb", "var", F.col("slot").alias("from"), "vals")
    nbr = (
        links.join(values, ["part", "from"])
        .select("part", "slot", "tb", "var", "w", F.posexplode("vals").alias("i", "nv"))
        .groupBy("part", "tb", "var", "i", "slot")
        .agg(F.sum(F.col("w") * F.col("nv").cast("double")).alias("p"))
    )
    own = (
        laid.join(spots.select("vid", "pos"), "vid")
        .select("part", "tb", "var", "slot", "pos", F.posexplode("vals").alias("i", "val"))
    )
    both = own.join(nbr, ["part", "tb", "var", "i", "slot"], "left").join(
        fits.select("part", "tb", "var", "i", "kept"), ["part", "tb", "var", "i"]
    )
    val = F.col("val").cast("double")
    errors = both.groupBy("part", "tb", "var", "i").agg(
        F.sum(F.abs(val - F.coalesce("p", F.lit(0.0)))).alias("nbr_err"),
        F.sum(F.abs(val - predicted(F.col("kept"), F.col("pos"), d))).alias("reg_err"),
    )
    return fits.join(errors, ["part", "tb", "var", "i"]).withColumn(
        "use_fit", F.col("nbr_err") > F.col("reg_err")
    )
