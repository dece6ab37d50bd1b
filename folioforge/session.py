"""Session factory for local runs, tests and the bench; on a cluster the submitted configuration wins."""

from __future__ import annotations

import atexit
import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | None = None, shuffle_partitions: int | None = None, app: str = "folioforge") -> SparkSession:
    cpus = cpus or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; one of our own only on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = "file:///tmp/checkpoints/folioforge"
    return found.rstrip("/")


_KEPT: list[tuple[SparkSession, str]] = []


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder: lineage ends there. Removed when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/folioforge-{name}-{uuid.uuid4().hex[:12]}"
    _KEPT.append((spark, path))
    df.write.parquet(path)
    return spark.read.parquet(path)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    _KEPT.append((spark, path))


@atexit.register
def _sweep() -> None:
    for spark, path in _KEPT:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the JVM may be gone at exit
            return
