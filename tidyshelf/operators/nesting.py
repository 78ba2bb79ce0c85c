"""Directories inside directories, as intervals: each path is the range of all paths below it in a preorder of the tree.

Paths are written so that the separator sorts before every other character; then what lies in a directory follows it without
a gap, two directories' ranges are nested or apart, and whether one holds another is a comparison. Rows are sorted by ranges of
that order, and a running maximum of ends (minimum of starts) over the rows before (after) tells what a row lies in (holds). What
crosses from one range of rows to the next is one value each, so no path is taken apart into its ancestors and no directory's rows
meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import fixed

LOWEST, HIGHEST = "\x01", "\U0010ffff"


def start(path: Column) -> Column:
    return F.concat(F.translate(F.rtrim(path, F.lit("/")), "/", LOWEST), F.lit(LOWEST))


def end(path: Column) -> Column:
    return F.concat(start(path), F.lit(HIGHEST))


def swept(rows: DataFrame, path: str, mark: str) -> DataFrame:
    """rows with ``inside`` (a marked row before it in the order, or of equal path, holds it) and ``holds`` (a marked row after it lies in it)."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.where(F.col(path).isNotNull()).withColumns({"__start": start(F.col(path)), "__end": end(F.col(path))})
    placed = fixed(keyed.repartitionByRange(parts, "__start").withColumn("__part", F.spark_partition_id()))
    ends, starts = F.when(F.col(mark), F.col("__end")), F.when(F.col(mark), F.col("__start"))
    edges = {r["__part"]: r for r in placed.groupBy("__part").agg(F.max(ends).alias("high"), F.min(starts).alias("low")).collect()}  # a row a range
    carried, high = {}, None
    for k in sorted(edges):
        carried[k] = high
        high = max(filter(None, (high, edges[k]["high"])), default=None)
    table, low = [], None
    for k in sorted(edges, reverse=True):
        table.append((k, carried[k], low))
        low = min(filter(None, (low, edges[k]["low"])), default=None)
    carry = F.broadcast(rows.sparkSession.createDataFrame(table, "__part int, __high string, __low string"))
    w = W.partitionBy("__part").orderBy("__start", F.desc(mark))
    before, after = F.max(ends).over(w.rowsBetween(W.unboundedPreceding, -1)), F.min(starts).over(w.rowsBetween(1, W.unboundedFollowing))
    out = placed.withColumns({"__before": before, "__after": after}).join(carry, "__part")
    inside = F.col("__start") < F.greatest("__before", "__high")  # greatest and least pass over nulls
    holds = F.least("__after", "__low") < F.col("__end")
    return out.select(*rows.columns, F.coalesce(inside, F.lit(False)).alias("inside"), F.coalesce(holds, F.lit(False)).alias("holds"))


def outermost(dirs: DataFrame, path: str) -> DataFrame:
    """The distinct paths that lie in no other one of them."""
    own = dirs.select(F.regexp_replace(path, "(?<=.)/+$", "").alias(path)).distinct().withColumn("__mark", F.lit(True))
    return swept(own, path, "__mark").where("not inside").select(path)


def apart(rows: DataFrame, busy: DataFrame, path: str) -> DataFrame:
    """The rows whose path no path of busy equals, holds or lies in; rows without a path stay."""
    own = rows.select(path).where(F.col(path).isNotNull()).distinct().withColumn("__mark", F.lit(False))
    marks = busy.select(F.col(busy.columns[0]).alias(path)).where(F.col(path).isNotNull()).distinct().withColumn("__mark", F.lit(True))
    met = swept(own.unionByName(marks), path, "__mark").where("not __mark and (inside or holds)").select(path)
    return rows.join(met, path, "left_anti").select(*rows.columns)
