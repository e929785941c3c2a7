"""Global ranks, lags, running sums and as-of lookups without a one-task window.

Everything here range-partitions rows by a unique key, freezes the partition
number in a scratch table, runs the window inside one range partition at a
time, and carries a value per range partition across the borders. Ranges are
balanced because the sort key is unique, whatever the value distribution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.session import materialize

MAX_RANGES = 4096
"""Upper bound on range partitions, hence on the carry table."""


def _ranges(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    spark = df.sparkSession
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), MAX_RANGES)
    cut = df.repartitionByRange(n, *keys).withColumn("_range", F.spark_partition_id())
    return materialize(cut, name)


def with_rank(df: DataFrame, keys: list[str], out: str = "rank") -> DataFrame:
    """0-based position in the total order of ``keys`` (which must be unique).

    One range shuffle and a sort inside each range; the position within a range
    is the low part of monotonically_increasing_id, its base comes from the
    (at most MAX_RANGES) range counts.
    """
    spark = df.sparkSession
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), MAX_RANGES)
    cut = materialize(
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_m", F.monotonically_increasing_id()),
        "rank",
    )
    piece = F.shiftright("_m", 33)
    inside = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    counts = cut.groupBy(piece.alias("_range")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return (
        cut.withColumn("_range", piece)
        .join(F.broadcast(bases), "_range")
        .withColumn(out, (F.col("_base") + inside).cast("bigint"))
        .drop("_range", "_base", "_m")
    )


def exclusive_prefix(df: DataFrame, key: str, size: str, out: str = "offset") -> DataFrame:
    """Sum of ``size`` over all rows with a smaller (unique) ``key``."""
    cut = _ranges(df, [key], "prefix")
    totals = cut.groupBy("_range").agg(F.sum(size).alias("_n"))
    bases = totals.select(
        "_range",
        F.coalesce(
            F.sum("_n").over(
                Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("_base"),
    )
    before = Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return (
        cut.withColumn("_in", F.coalesce(F.sum(size).over(before), F.lit(0)))
        .join(F.broadcast(bases), "_range")
        .withColumn(out, (F.col("_base") + F.col("_in")).cast("bigint"))
        .drop("_range", "_base", "_in")
    )


def grouped_lag(
    df: DataFrame, group: list[str], key: str, out: str, value: str | None = None, span: int = 1 << 16
) -> DataFrame:
    """Previous ``value`` (default: the key) by ``key`` inside ``group``.

    One group may hold most of the rows: windows run over (group, key div span),
    at most ``span`` rows each since keys are distinct integers, and the first row
    of a block takes the last value of the previous non-empty block of its group.
    """
    value = value or key
    b = df.withColumn("_b", F.floor(F.col(key) / span).cast("bigint"))
    inner = Window.partitionBy(*group, "_b").orderBy(key)
    lasts = b.groupBy(*group, "_b").agg(F.max_by(value, key).alias("_last"))
    carried = lasts.select(
        *group, "_b", F.lag("_last").over(Window.partitionBy(*group).orderBy("_b")).alias("_carry")
    )
    return (
        b.withColumn("_prev", F.lag(value).over(inner))
        .join(carried, [*group, "_b"])
        .withColumn(out, F.coalesce("_prev", "_carry"))
        .drop("_b", "_prev", "_carry")
    )


def grouped_running_sum(
    df: DataFrame, group: list[str], order: str, value: str, out: str, span: int = 1 << 16
) -> DataFrame:
    """Running sum of ``value`` by integer ``order`` inside ``group``, blockwise."""
    b = df.withColumn("_b", F.floor(F.col(order) / span).cast("bigint"))
    inner = (
        Window.partitionBy(*group, "_b")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    sums = b.groupBy(*group, "_b").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*group, "_b", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_carry"))
    return (
        b.withColumn("_in", F.sum(value).over(inner))
        .join(carried, [*group, "_b"])
        .withColumn(out, F.col("_carry") + F.col("_in"))
        .drop("_b", "_in", "_carry")
    )


def as_of(values: DataFrame, probes: DataFrame, side: str) -> DataFrame:
    """For every probe ``x``: the smallest value > x (side="after") or the largest
    value <= x (side="upto"), as column ``hit`` (NULL when there is none).

    ``values`` has one column ``x`` of distinct numbers, ``probes`` a unique ``x``
    plus a payload. Both are merged into one range-partitioned stream, so a dense
    cluster of values or probes spreads over many ranges.
    """
    payload = [c for c in probes.columns if c != "x"]
    # at equal x a value sorts before a probe: "upto" sees it, "after" does not
    stream = values.select("x", F.lit(0).alias("_k"), F.col("x").alias("_v"))
    asks = probes.withColumn("_k", F.lit(1)).withColumn("_v", F.lit(None).cast("double"))
    cut = _ranges(stream.unionByName(asks, allowMissingColumns=True), ["x", "_k"], "asof")
    agg = F.min("_v") if side == "after" else F.max("_v")
    edges = cut.groupBy("_range").agg(agg.alias("_edge"))
    if side == "after":
        far = Window.orderBy("_range").rowsBetween(1, Window.unboundedFollowing)
        near = Window.partitionBy("_range").orderBy("x", "_k").rowsBetween(1, Window.unboundedFollowing)
        beyond, local = F.min("_edge").over(far), F.min("_v").over(near)
    else:
        far = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        near = Window.partitionBy("_range").orderBy("x", "_k").rowsBetween(Window.unboundedPreceding, 0)
        beyond, local = F.max("_edge").over(far), F.max("_v").over(near)
    carry = edges.select("_range", beyond.alias("_carry"))
    return (
        cut.withColumn("_local", local)
        .where("_k = 1")
        .join(F.broadcast(carry), "_range")
        .select("x", *payload, F.coalesce("_local", "_carry").alias("hit"))
    )
