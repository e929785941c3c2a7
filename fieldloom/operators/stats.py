"""Quality statistics of a reconstruction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.scalars import psnr, valid


def value_range(field: DataFrame, keys: list[str], sentinel: float | None = None) -> DataFrame:
    """Min, max and span of the valid values per key."""
    seen = (F.col("val") if sentinel is None else valid(F.col("val"), sentinel)).cast("double")
    lo, hi = F.min(seen), F.max(seen)
    return field.groupBy(*keys).agg(lo.alias("lo"), hi.alias("hi"), (hi - lo).alias("span"))


def absolute_bound(span: Column, eb: float, relative: bool = True) -> Column:
    return F.coalesce(span, F.lit(0.0)) * eb if relative else F.lit(float(eb))


def error_stats(pairs: DataFrame, keys: list[str], sentinel: float | None = None) -> DataFrame:
    """Statistics of (vid, val, dec) rows per key.

    ``worst_vid`` is the first position of the largest error. With a sentinel,
    the range ignores missing samples while ``mse_all`` and the largest error
    still cover every row; ``mse_valid`` covers the valid ones.
    """
    val, dec = F.col("val").cast("double"), F.col("dec").cast("double")
    err = F.abs(dec - val)
    ok = F.lit(True) if sentinel is None else F.col("val") != F.lit(sentinel).cast("float")
    agg = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(ok, val)).alias("lo"),
        F.max(F.when(ok, val)).alias("hi"),
        F.max(err).alias("max_err"),
        F.min_by("vid", F.struct((-err).alias("e"), F.col("vid"))).alias("worst_vid"),
        F.avg(err * err).alias("mse_all"),
        F.avg(F.when(ok, err * err)).alias("mse_valid"),
    )
    return agg.withColumn("psnr", psnr(F.col("lo"), F.col("hi"), F.col("mse_all")))


def symbol_histogram(symbols: DataFrame, keys: list[str]) -> DataFrame:
    return symbols.groupBy(*keys, "q").agg(F.count(F.lit(1)).alias("freq"))


def entropy_bits(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """Shannon bound (bits) on the entropy-coded size per key.

    Uses sum f*log2(n/f) = n*log2(n) - sum f*log2(f), one aggregation.
    """
    f = F.col("freq").cast("double")
    total = F.sum(f)
    bits = total * F.log2(total) - F.sum(f * F.log2(f))
    return histogram.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("symbols"), F.sum("freq").alias("n"), bits.alias("bits")
    )
