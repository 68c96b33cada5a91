"""Session helpers shared by tests, the benchmark and operators that cut lineage."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, memory: str = "8g", app: str = "titlegrain") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably in the session's checkpoint folder.

    The folder comes from ``spark.checkpoint.dir``; only where a session has none
    (tests, one machine) a temporary one is set.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "titlegrain-checkpoints"))
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of every executor, once per application."""
    context = spark.sparkContext
    if getattr(context, "_titlegrain_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="titlegrain-")) / "titlegrain.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._titlegrain_shipped = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: No side above this many bytes is broadcast by an explicit hint.
BROADCAST_LIMIT = 64 << 20


def small_enough(df: DataFrame, limit: int = BROADCAST_LIMIT) -> bool:
    """Whether Catalyst's size estimate of ``df`` is below ``limit``."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit
