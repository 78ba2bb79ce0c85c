"""What the operators share: reading, stable intermediate results, places in the shared folder."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that contracts call white space.
SPACE = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\f\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def text_of(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def remainder(id_col: str, k: int) -> Column:
    """crc32 of the id as text, mod k: the split that learners hold out by."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % k


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and all runs on one machine. A full URI."""
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_to:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("a cluster has to name a folder that all its machines share in spark.checkpoint.dir")
        set_to = "file://" + tempfile.mkdtemp(prefix="tidyshelf-")
        spark.sparkContext.setCheckpointDir(set_to)
    if "://" not in set_to:  # a path of the cluster's default store, or file:/ with one slash
        path = spark._jvm.org.apache.hadoop.fs.Path(set_to)
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        set_to = path.makeQualified(store.getUri(), store.getWorkingDirectory()).toString()
    return re.sub(r"^file:/(?!/)", "file:///", set_to)


def give_back() -> None:
    """At the end of a worker's task: memory that Arrow and the C library keep for reuse goes back, as tasks share an executor.

    Workers live on between tasks; what they keep would stand beside the JVM's heap through stages that need no Python at all.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def new_dir(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def drop_dir(spark: SparkSession, path: str) -> None:
    """Remove a folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder and go on from there: computed once, and lineage ends. For narrow rows."""
    shared_dir(df.sparkSession)
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def table_at(df: DataFrame, path: str) -> DataFrame:
    """Write df as Parquet and reread it: for results with wider rows."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def matching(df: DataFrame, ids: DataFrame, id_col: str, how: str, most: int = 500_000) -> DataFrame:
    """df joined (``how``) with ids, whose first column is the id, sent to every task only if counted to be at most ``most``."""
    ids = ids.toDF("__matching_id", *ids.columns[1:])
    small = ids.limit(most + 1).count() <= most
    return df.join(F.broadcast(ids) if small else ids, df[id_col] == F.col("__matching_id"), how)
