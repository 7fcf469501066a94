"""Session settings that every plan of this library relies on."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(cpus: int | None = None, shuffle_partitions: int | None = None, app: str = "waymark") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster pass your own session instead."""
    n = cpus or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def read_table(spark: SparkSession, sf_dir: str, name: str):
    """One of the driver's tables, read by Spark so that any file system it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go to the folder named in spark.checkpoint.dir. Where that is unset, to one of our own on a local
    master (tests); on a cluster, whose machines would not share it, ValueError."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """The URI of a new folder of that name in the shared checkpoint folder; nothing is made yet."""
    ensure_checkpoint_dir(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{re.sub(r'^(file:)?/(?!/)', 'file:///', root).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def forget(spark: SparkSession, *folders: str) -> None:
    """Delete folders of shared_folder()."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
