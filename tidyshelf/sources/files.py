"""Libraries as tables: files, routing rules, progress logs. Archives and their documents: ``archives``; changes: ``events``."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names as N
from ..functions import patterns as P
from ..operators.routing import Rule
from ..session import fixed
from .archives import entries, metadata  # noqa: F401  sources of the library like the others

ARCHIVES = "*.[cC][bB][zZ]"


def scan(spark: SparkSession, root: str, glob: str = ARCHIVES, recursive: bool = True) -> DataFrame:
    """(path, dir_path, dir_name, parent_path, name, stem, ext, size, mtime); content is never read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    return described(reader.load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime")))


def described(files: DataFrame) -> DataFrame:
    """Adds the parts of ``path``."""
    name = F.substring_index("path", "/", -1)
    out = files.withColumns({"name": name, "dir_path": F.regexp_replace("path", r"/[^/]*$", "")})
    return out.withColumns({
        "dir_name": F.substring_index("dir_path", "/", -1), "parent_path": F.regexp_replace("dir_path", r"/[^/]*$", ""), "stem": N.stem(F.col("name")), "ext": F.lower(N.suffix(F.col("name"))),
    })


def to_backslashes(path: Column) -> Column:
    """Network paths written with slashes."""
    return F.when(path.startswith("//"), F.translate(path, "/", "\\")).otherwise(path)


def is_image(ext: Column, kind: str = "ranges") -> Column:
    return F.lower(ext).isin(*P.IMAGE_EXTENSIONS[kind])


def stale(name: Column) -> Column:
    """Left behind by an interrupted rewrite."""
    return name.endswith(".tmp.cbz") | name.endswith(".bak.cbz")


def pages(listed: DataFrame) -> DataFrame:
    """Image entries with their place in entry order."""
    return listed.where(is_image(F.col("ext"))).select("path", "entry", "ext", "size", "compress_type")


def routing(path: str) -> tuple[list[Rule], dict[str, str], str]:
    """(rules, destinations, default) from a JSON file; entries without a pattern are remarks."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    rules = [Rule(r.get("match", "source"), r["pattern"], r.get("dest", "")) for r in found.get("rules", []) if "pattern" in r]
    return rules, found.get("destinations", {}), found.get("default", "")


PROGRESS = T.StructType([T.StructField("p", T.StringType()), T.StructField("session", T.StringType()), T.StructField("v", T.IntegerType()), T.StructField("bad", T.StringType())])


def progress(spark: SparkSession, path: str) -> DataFrame:
    """(p): the distinct paths of a line-by-line log; blank, bad and other lines are passed over."""
    rows = spark.read.schema(PROGRESS).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad").json(path)
    return rows.where("p is not null").select("p").distinct()


def log_progress(done: DataFrame, path: str) -> None:
    done.select("p").write.mode("append").json(path)


def start_log(spark: SparkSession, path: str, session: str) -> None:
    """A new session's line."""
    spark.createDataFrame([(session, 2)], "session string, v int").coalesce(1).write.mode("append").json(path)


def clear_progress(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], "p string").write.mode("overwrite").json(path)


def compact_progress(spark: SparkSession, path: str) -> None:
    """The log with each path once: written beside the old lines, which go afterwards, so that an interruption loses nothing."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    old = [f.getPath() for f in store.listStatus(at) if f.isFile() and not f.getPath().getName().startswith(("_", "."))]
    fixed(progress(spark, path)).write.mode("append").json(path)
    for f in old:
        store.delete(f, False)


ARRIVAL = "path string, modificationTime timestamp, length long, content binary"


def arrivals(spark: SparkSession, root: str, per_batch: int = 10_000) -> DataFrame:
    """The stream of archives under a root, those already there first: (path, event_type, event_time, dir_ctime, at_root).

    A file's time stands for its directory's, which Spark's readers do not tell. at_root: dropped beside the
    directories instead of into one; such files are processed all the same.
    """
    reader = spark.readStream.format("binaryFile").schema(ARRIVAL).option("pathGlobFilter", ARCHIVES).option("recursiveFileLookup", "true")
    found = reader.option("maxFilesPerTrigger", per_batch).load(root)
    time = F.col("modificationTime")
    plain = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    at_root = F.ltrim(F.regexp_replace(F.regexp_replace("path", "^[a-z]+:", ""), r"/[^/]*$", ""), F.lit("/")) == plain
    return found.select("path", F.lit("created").alias("event_type"), time.alias("event_time"), time.alias("dir_ctime"), at_root.alias("at_root"))


REPORT = ("series", "first_issue", "last_issue", "total_found", "gap_count", "missing", "unnumbered", "path")


def report_path(folder: str, at: datetime) -> str:
    return f"{folder.rstrip('/')}/gaps_{at:%Y%m%d_%H%M%S}"


def write_report(report: DataFrame, path: str) -> None:
    """The gap report as one CSV file with a header: its columns alone, whatever else the rows hold."""
    report.select(*(c for c in REPORT if c in report.columns)).coalesce(1).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)
