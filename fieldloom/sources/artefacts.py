"""Tables a workflow keeps between runs: variable lists, parts, critical points, blobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_variables(spark: SparkSession, path: str) -> DataFrame:
    """(var): one variable name per line, blank lines skipped."""
    return spark.read.text(path).select(F.trim("value").alias("var")).where("var <> ''")


def reuse_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read the table at ``path``; when there is none, build and write it first.

    Used for critical points of an original field, part assignments and meshes.
    """
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    build().write.parquet(path)
    return spark.read.parquet(path)


def write_blobs(blob: DataFrame, path: str) -> None:
    """Compressed blocks as a table, pruned by variable and window on reading.

    Payloads are zstd frames already, so the file format does not compress again.
    """
    rows = blob.withColumn("bytes", F.length("payload"))
    rows.write.option("compression", "none").partitionBy("var", "tb").parquet(path)
