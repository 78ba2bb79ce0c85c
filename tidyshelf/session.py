"""Session defaults for local runs and tests; a cluster brings its own."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | None = None, partitions: int | None = None, memory: str = "8g") -> SparkSession:
    n = cpus or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName("tidyshelf")
        .config("spark.sql.shuffle.partitions", str(partitions or n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.python.filterPushdown.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the driver's tables; Spark's own reader, so any store that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share, as a URI; on one machine a folder of our own where none is named."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("a cluster has to name a folder that all its machines share in spark.checkpoint.dir")
        shared = tempfile.mkdtemp(prefix="tidyshelf-")
        spark.sparkContext.setCheckpointDir(shared)
    path = spark._jvm.org.apache.hadoop.fs.Path(shared)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return re.sub(r"^file:/(?!/)", "file:///", path.makeQualified(store.getUri(), store.getWorkingDirectory()).toString())


def fixed(df: DataFrame) -> DataFrame:
    """df written to spark.checkpoint.dir and read from there: it stays as it is, whatever happens to its sources or executors."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)
