"""Scalar and array expressions, all JVM-side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the linear quantizer: index RADIUS means "no correction",
# index 0 means "stored verbatim".
RADIUS = 32768
CAPACITY = 65536

# Fixed value: single-precision machine epsilon, the unit of the exponential
# error-bound grid.
FLOAT_EPS = 2.0**-23


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two coordinate arrays of equal length."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, s: acc + s))


def inverse_distance(dist: Column) -> Column:
    """1/distance; NULL for coincident points (see operators.neighbours)."""
    return F.when(dist > 0, 1.0 / dist)


def valid(val: Column, sentinel: float) -> Column:
    """The value, or NULL when it is the missing-sample marker."""
    return F.when(val != F.lit(sentinel).cast("float"), val)


def normalize(val: Column, lo: Column, span: Column) -> Column:
    return F.try_divide(val - lo, span)


def quantize(val: Column, pred: Column, eb: Column) -> Column:
    """Struct (q, dec) of the error-bounded linear quantizer.

    ``dec`` is single precision and strictly closer to ``val`` than ``eb``
    unless q = 0, where the value itself is kept.
    """
    diff = val.cast("double") - pred
    steps = F.try_divide(F.abs(diff), eb) + 1.0
    half = F.floor(steps / 2.0)
    signed = F.when(diff > 0, half).otherwise(-half)
    dec = (pred + 2.0 * signed * eb).cast("float")
    fits = (steps < CAPACITY) & (F.abs(dec.cast("double") - val.cast("double")) < eb)
    return F.struct(
        F.when(fits, signed + RADIUS).otherwise(0).cast("int").alias("q"),
        F.when(fits, dec).otherwise(val.cast("float")).alias("dec"),
    )


def dequantize(q: Column, pred: Column, eb: Column, raw: Column) -> Column:
    dec = pred + 2.0 * (q - RADIUS) * eb
    return F.when(q == 0, raw).otherwise(dec.cast("float"))


def exponential_bound(eb: Column, base: float = 2.0) -> Column:
    """Struct (id, eb): the bound rounded down to the grid base^id * epsilon.

    Bounds up to epsilon get id 0 and bound 0. ``eb / epsilon`` is an exact
    power-of-two scaling, so ids agree between engines.
    """
    ratio = eb / F.lit(FLOAT_EPS)
    idx = F.when(eb <= FLOAT_EPS, F.lit(0)).otherwise(
        F.floor(F.log2(ratio) / F.log2(F.lit(base)))
    )
    bound = F.when(eb <= FLOAT_EPS, F.lit(0.0)).otherwise(F.pow(F.lit(base), idx) * FLOAT_EPS)
    return F.struct(idx.cast("int").alias("id"), bound.alias("eb"))


def linear_bound(eb: Column, unit: float) -> Column:
    """Struct (id, eb): the bound rounded down to a multiple of ``unit``."""
    idx = F.floor(eb / F.lit(unit))
    return F.struct(idx.cast("int").alias("id"), (idx * F.lit(unit)).alias("eb"))


def log_magnitude(val: Column) -> Column:
    """Struct (lg, sgn): log2 of the magnitude, -100 for zero, and the sign."""
    v = val.cast("double")
    return F.struct(
        F.when(v != 0, F.log2(F.abs(v))).otherwise(F.lit(-100.0)).alias("lg"),
        F.signum(v).cast("int").alias("sgn"),
    )


def same_direction(parts: list[Column]) -> Column:
    """All components share one non-zero sign."""
    return reduce(lambda a, b: a & b, [p > 0 for p in parts]) | reduce(
        lambda a, b: a & b, [p < 0 for p in parts]
    )


def gaussian_variogram(lag: Column, reach: Column, sill: Column) -> Column:
    return sill * (1.0 - F.exp(-(lag * lag) / (reach * reach)))


def psnr(lo: Column, hi: Column, mse: Column) -> Column:
    """Peak signal-to-noise ratio; NULL when the error (or the range) is zero."""
    span = hi - lo
    return F.when((mse > 0) & (span > 0), 20.0 * F.log10(span / F.sqrt(mse)))


def compression_ratio(values: Column, stored: Column, width: int = 4) -> Column:
    return F.try_divide(values * width, stored)


def morton(coords: list[Column], lows: list[float], highs: list[float], bits: int = 10) -> Column:
    """Interleaved cell number of a point on a 2^bits grid over the bounding box."""
    d = len(coords)
    top = (1 << bits) - 1
    code: Column = F.lit(0).cast("bigint")
    for axis, (c, lo, hi) in enumerate(zip(coords, lows, highs)):
        span = hi - lo
        cell = F.floor((c - F.lit(lo)) / F.lit(span) * top) if span > 0 else F.lit(0)
        cell = cell.cast("bigint")
        for b in range(bits):
            bit = F.shiftright(cell, b).bitwiseAND(F.lit(1))
            code = code.bitwiseOR(F.shiftleft(bit, d * b + axis))
    return code


def interleaved_slot(slot: Column, n: Column, stride: Column) -> Column:
    """Strided visiting order: phase-major over ``stride`` phases, tail unchanged."""
    phase = F.floor(n / stride).cast("bigint")
    moved = F.floor(slot / stride).cast("bigint") + (slot % stride) * phase
    return F.when(slot < phase * stride, moved).otherwise(slot)
