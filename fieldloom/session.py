"""Session helpers: shared scratch tables and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_scratch: dict[str, str] = {}
_shipped: set[str] = set()

BROADCAST_ROWS = 200_000
"""Largest table (in rows of a few scalars) that is ever sent to all executors."""


def build_session(app: str = "fieldloom", cpus: str = "*", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="fieldloom-code-"), "fieldloom.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def scratch_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the cluster names in spark.checkpoint.dir.

    A machine-local folder is used only by local[...] sessions that name none;
    on a cluster the setting is required, since other executors must see the files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="fieldloom-")
    return _local_scratch[app]


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back.

    Cuts lineage in a way that outlives a lost executor, freezes anything that
    depends on physical placement (range partition ids), gives the next plan
    real sizes, and keeps column pruning and filter push-down. With ``by``, a column
    of few values, a filter on it reads the files of its values alone.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only when ``df`` is known to have at most ``rows`` rows.

    The check reads at most ``rows + 1`` rows; beyond the bound the plain
    DataFrame is returned and the join shuffles.
    """
    if df.limit(rows + 1).count() <= rows:
        return F.broadcast(df)
    return df


def sorted_side(df: DataFrame) -> DataFrame:
    """A side with a row per vertex, to be joined by exchange and sort.

    Spark goes by the size of the files, and these columns compress well: it would send tables of
    a million rows through the driver in every round of a loop.
    """
    return df.hint("merge")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` into exactly spark.sql.shuffle.partitions tasks.

    For groups that are heavy on CPU but small in bytes: adaptive execution would
    merge them into few tasks, and it leaves an explicit partition count alone.
    The grouped operator that follows reuses this partitioning.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)
