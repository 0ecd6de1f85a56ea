"""Session settings the library relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which executors share; a local session without one gets a folder of its own.

    On a cluster a folder of one machine would be read by others in vain, so there the setting must be given.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: give it a folder that all executors share")
        top = tempfile.mkdtemp(prefix="larkstream-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(top)
    return top


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the folder of spark.checkpoint.dir."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def measured_cut(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """df cut as by `cut`, and the values of aggregates over it, which are observed while it is written: no second job."""
    seen = Observation()
    return cut(df.observe(seen, *[c.alias(name) for name, c in metrics.items()])), seen.get


def local_session(cores: int = 8, partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("larkstream")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one in spark.checkpoint.dir, which executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/larkstream/{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
