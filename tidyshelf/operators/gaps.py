"""Missing numbers in series: runs between neighbours, before the first, and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names as N


def runs(numbers: DataFrame, series: str, number: str) -> DataFrame:
    """(series, lo, hi, first, last, missing): one row a run of missing numbers; numbers distinct in a series.

    From lo up in steps of 1 below hi; before the first number from 1. One window a series, no row for each missing number.
    """
    n = F.col(number)
    w = W.partitionBy(series).orderBy(number)
    around = numbers.select(series, F.lead(n).over(w).alias("hi"), n.alias("lo"), F.row_number().over(w).alias("nth"))
    between = around.where(F.col("hi") - F.col("lo") > 1).select(series, "lo", "hi", (F.col("lo") + 1).alias("first"), (F.col("lo") + F.ceil(F.col("hi") - F.col("lo")) - 1).alias("last"))
    before = around.where((F.col("nth") == 1) & (F.col("lo") >= 2)).select(series, F.lit(0.0).alias("lo"), F.col("lo").alias("hi"), F.lit(1.0).alias("first"), (F.floor("lo") - 1).alias("last"))
    both = before.unionByName(between).withColumns({c: F.col(c).cast("double") for c in ("lo", "hi", "first", "last")})
    return both.withColumn("missing", label(F.col("first"), F.col("last")))


def label(first: Column, last: Column) -> Column:
    return F.when(first == last, N.format_number(first)).otherwise(N.range_text(first, last))


def report(files: DataFrame, series: str, number: Column, name: str, at_least: int = 2) -> DataFrame:
    """(series, first_issue, last_issue, total_found, gap_count, missing, unnumbered, has_gaps) of each series.

    Of files with the same number the first by name counts; series with fewer than ``at_least`` numbers are left out. One
    scan: numbers are made distinct first, then one shuffle by series serves both the window and the summary.
    """
    rows = files.select(F.col(series).alias("series"), number.cast("double").alias("n"), F.col(name).alias("name"))
    distinct = rows.groupBy("series", "n").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("files"))
    w = W.partitionBy("series").orderBy(F.col("n").asc_nulls_last())
    lo, hi = F.col("n"), F.col("hi")
    around = distinct.withColumns({"hi": F.lead("n").over(w), "nth": F.row_number().over(w)})
    before = F.when((F.col("nth") == 1) & (lo >= 2), F.struct(F.lit(0.0).alias("at"), label(F.lit(1.0), F.floor(lo) - 1).alias("missing")))
    between = F.when(hi - lo > 1, F.struct(lo.alias("at"), label(lo + 1, lo + F.ceil(hi - lo) - 1).alias("missing")))
    out = around.groupBy("series").agg(
        F.count("n").alias("total_found"), F.coalesce(F.sum(F.when(lo.isNull(), F.col("files"))), F.lit(0)).alias("unnumbered"), F.min("n").alias("lo"), F.max("n").alias("hi"),
        F.array_sort(F.concat(F.collect_list(before), F.collect_list(between))).alias("gaps"),
    )
    count = F.size("gaps").cast("long")
    return out.where(F.col("total_found") >= at_least).select(
        "series", N.format_number(F.col("lo")).alias("first_issue"), N.format_number(F.col("hi")).alias("last_issue"), "total_found", count.alias("gap_count"),
        F.array_join(F.transform("gaps", lambda x: x["missing"]), ", ").alias("missing"), "unnumbered", (count > 0).alias("has_gaps"),
    )


def in_report_order(gaps: DataFrame) -> DataFrame:
    """Series with gaps first, most gaps first, then by name."""
    return gaps.orderBy(F.desc("has_gaps"), F.desc("gap_count"), F.lower("series"))
