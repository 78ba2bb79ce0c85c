"""Archives that hold a range of chapters: overlap with single ones, pages, and numbers that look like ranges.

A range is never listed to find which of its numbers exist: it meets the few numbers of its series as they are, and where they
are many it is cut into aligned intervals whose lengths are powers of two,
at most two of a length, and a single number falls into one interval of each length. So a range of ten thousand million
numbers costs some sixty keys, and what an equi-join on those keys returns are the numbers that do exist. Their count
against the range's own decides whether it is whole; runs that are missing lie between neighbours.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names as N
from ..session import fixed

#: Numbers of a series and class up to which ranges meet them one by one.
FEW = 64

#: Numbers of a range that may be listed one by one where a list is asked for.
LISTED = 100_000


def steps_of(start: Column, end: Column) -> Column:
    """How many steps of 1 a range has; null where a long does not hold it."""
    return F.floor(end - start + 0.001).try_cast("long")


def expanded(ranges: DataFrame, start: str = "start", end: str = "end", block: int = 10_000) -> DataFrame:
    """One row a number of the range, in steps of 1, rounded to one decimal; made in blocks, so that none is a long array."""
    ok = ranges.withColumn("__steps", steps_of(F.col(start), F.col(end))).where(F.col(start).isNotNull() & (F.col("__steps") >= 0))
    ok = ok.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__steps"), F.lit(block).cast("long"))))
    ok = ok.withColumn("__step", F.explode(F.sequence(F.col("__block"), F.least(F.col("__steps"), F.col("__block") + (block - 1)))))
    return ok.withColumn("number", F.round(F.col(start) + F.col("__step"), 1)).drop("__step", "__block", "__steps")


def tenths(number: Column) -> Column:
    """The number at one decimal, as a whole number of tenths."""
    return F.round(F.round(number, 1) * 10).try_cast("long")


def intervals(first: Column, last: Column) -> Column:
    """The aligned intervals that make up the whole numbers from first to last: an array of (level, place), 2**level long."""
    none = F.array().cast("array<struct<level:int,place:bigint>>")
    start = F.struct(first.alias("lo"), (last + 1).alias("hi"), none.alias("out"))

    def up(s: Column, level: Column) -> Column:
        lo, hi, out = s["lo"], s["hi"], s["out"]
        cell = lambda place: F.array(F.struct(level.alias("level"), place.alias("place")))
        low = (lo < hi) & (F.pmod(lo, F.lit(2)) == 1)
        high = (F.when(low, lo + 1).otherwise(lo) < hi) & (F.pmod(hi, F.lit(2)) == 1)
        out = F.concat(out, F.when(low, cell(lo)).otherwise(none), F.when(high, cell(hi - 1)).otherwise(none))
        return F.struct(F.shiftright(F.when(low, lo + 1).otherwise(lo), 1).alias("lo"), F.shiftright(F.when(high, hi - 1).otherwise(hi), 1).alias("hi"), out.alias("out"))

    levels = F.length(F.bin(last - first + 1))  # as long as the longest interval that fits
    return F.aggregate(F.sequence(F.lit(0), levels), start, up, lambda s: s["out"])


def members(ranges: DataFrame, singles: DataFrame, series: str, few: int = FEW) -> DataFrame:
    """(series, id, first, last, class, q, number, path): the numbers of each range that exist singly.

    ranges: (series, id, start, end); singles: (series, number, path), of equal numbers the last path counts. Numbers are
    q + class tenths; first and last are the range's own q. Ranges that a long does not hold have no members. Series of at most
    ``few`` numbers of a class meet their ranges as they are, which compares no more than a long range has intervals; only the
    others go by intervals. singles are read twice, first to count them.
    """
    spans = ranges.withColumns({"__t": tenths(F.col("start")), "__steps": steps_of(F.col("start"), F.col("end"))}).where("__t is not null and __steps >= 0")
    first = F.floor(F.col("__t") / 10).cast("long")
    spans = spans.select(series, "id", F.pmod("__t", F.lit(10)).alias("class"), first.alias("first"), F.try_add(first, F.col("__steps")).alias("last")).where("last is not null")
    own = singles.where(F.col("number") == F.round("number", 1)).withColumn("__t", tenths(F.col("number"))).where("__t is not null")
    own = own.select(series, F.pmod("__t", F.lit(10)).alias("class"), F.floor(F.col("__t") / 10).cast("long").alias("q"), "number", "path")
    crowds = fixed(own.groupBy(series, "class").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > few).select(series, "class"))
    own = own.groupBy(series, "class", "q").agg(F.max("number").alias("number"), F.max("path").alias("path"))
    columns = [series, "id", "first", "last", "class", "q", "number", "path"]
    direct = lambda spans, own: spans.join(own, [series, "class"]).where("q between first and last").select(*columns)
    if not crowds.limit(1).count():
        return direct(spans, own)
    key = [series, "class"]
    crowded = by_intervals(spans.join(crowds, key, "left_semi"), own.join(crowds, key, "left_semi"), series).select(*columns)
    return direct(spans.join(crowds, key, "left_anti"), own.join(crowds, key, "left_anti")).unionByName(crowded)


def by_intervals(spans: DataFrame, own: DataFrame, series: str) -> DataFrame:
    """Spans with the numbers inside them, as an equi-join on aligned intervals."""
    cells = spans.withColumn("cell", F.explode(intervals(F.col("first"), F.col("last")))).select("*", "cell.level", "cell.place").drop("cell")
    levels = cells.groupBy(series, "class").agg(F.collect_set("level").alias("levels"))  # at most 63 a series and class
    keyed = own.join(levels, [series, "class"]).withColumn("level", F.explode("levels")).drop("levels")
    keyed = keyed.withColumn("place", F.floor(F.col("q") / F.pow(F.lit(2.0), "level")).cast("long"))
    return cells.join(keyed, [series, "class", "level", "place"])


def of_range(series: str) -> WindowSpec:
    return W.partitionBy(series, "class", "id", "first", "last")


def whole(found: DataFrame, series: str) -> DataFrame:
    """The rows of ranges all of whose numbers exist; found: as ``members`` gives them."""
    counted = found.withColumn("__n", F.count(F.lit(1)).over(of_range(series)))
    return counted.where(F.col("__n") == F.col("last") - F.col("first") + 1).drop("__n")


def with_runs(found: DataFrame, series: str) -> DataFrame:
    """found with ``runs``: the (a, b) that are missing after each member of a range, and before its first."""
    w = of_range(series).orderBy("q")
    rows = found.withColumns({"__next": F.lead("q").over(w), "__previous": F.lag("q").over(w)})
    before = F.when(F.col("__previous").isNull() & (F.col("q") > F.col("first")), F.struct(F.col("first").alias("a"), (F.col("q") - 1).alias("b")))
    open_ = (F.col("q") < F.col("last")) & (F.col("__next").isNull() | (F.col("__next") > F.col("q") + 1))
    after = F.when(open_, F.struct((F.col("q") + 1).alias("a"), F.coalesce(F.col("__next") - 1, "last").alias("b")))
    return rows.withColumn("runs", F.array_compact(F.array(before, after))).drop("__next", "__previous")


def missing_runs(found: DataFrame, series: str) -> DataFrame:
    """(series, id, from, to, missing): the runs of numbers of each range that do not exist singly; only ranges of which some do.

    found: as ``members`` gives them. A run lies between two members that follow each other, or at an end of the range.
    """
    runs = with_runs(found, series).select(series, "id", "class", F.explode("runs").alias("r"))
    runs = runs.select(series, "id", (F.col("r.a") + F.col("class") / 10).alias("from"), (F.col("r.b") + F.col("class") / 10).alias("to"))
    return runs.withColumn("missing", F.when(F.col("from") == F.col("to"), N.format_number(F.col("from"))).otherwise(N.range_text(F.col("from"), F.col("to"))))


def overlap(ranges: DataFrame, singles: DataFrame, series: str) -> DataFrame:
    """(series, range id, found, missing, runs): which numbers of each range exist singly; only ranges of which some do.

    missing is null where more than LISTED numbers are missing; the runs, arrays of (from, to), are always there.
    """
    rows = with_runs(members(ranges, singles, series), series)
    number = lambda c: c + F.col("class") / 10
    rows = rows.withColumn("runs", F.transform("runs", lambda r: F.struct(number(r["a"]).alias("from"), number(r["b"]).alias("to"))))
    out = rows.groupBy(series, "id").agg(F.array_sort(F.collect_list("number")).alias("found"), F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"))
    total = F.aggregate("runs", F.lit(0.0), lambda n, r: n + r["to"] - r["from"] + 1)
    listed = F.flatten(F.transform("runs", lambda r: F.transform(F.sequence(F.lit(0), F.round(r["to"] - r["from"]).cast("int")), lambda k: F.round(r["from"] + k, 1))))
    return out.withColumn("missing", F.when(total <= LISTED, listed)).select(series, "id", "found", "missing", "runs")


def page_plan(range_pages: DataFrame, single_pages: DataFrame, group: str) -> DataFrame:
    """Page by page the better of a range's and its singles' pages, by position; groups whose counts differ are left out.

    Both: (group, order, entry, ext, size). A PNG beats another type, else the strictly larger page, else what is there.
    """
    page = F.struct("entry", "ext", "size").alias("page")
    sides = (df.select(group, F.lit(mine).alias("mine"), "order", "entry", page) for df, mine in ((range_pages, True), (single_pages, False)))
    return better_pages(reduce(DataFrame.unionByName, sides), group)


def better_pages(pages: DataFrame, group: str) -> DataFrame:
    """``page_plan`` of both sides' pages in one table: (group, mine, order, entry, page); they are shuffled once, by group."""
    every = W.partitionBy(group)
    rows = pages.where(F.col(group).isNotNull()).withColumns({"a": F.count_if("mine").over(every), "b": F.count_if(~F.col("mine")).over(every)}).where("a = b")
    rows = rows.withColumn("pos", F.row_number().over(W.partitionBy(group, "mine").orderBy("order", "entry")))
    side = lambda mine: F.max(F.when(F.col("mine") == mine, F.col("page")))
    rows = rows.groupBy(group, "pos").agg(side(True).alias("now"), side(False).alias("other"), F.max("a").alias("total_pages"))
    now_png, other_png = F.col("now.ext") == ".png", F.col("other.ext") == ".png"
    wins = F.when(now_png != other_png, other_png).otherwise(F.col("other.size") > F.col("now.size"))
    rows = rows.withColumn("upgraded", wins)
    winner = F.when(F.col("upgraded"), F.col("other")).otherwise(F.col("now"))
    name = F.format_string("page_%04d%s", F.col("pos"), winner["ext"])
    return rows.select(group, F.col("pos").cast("long").alias("pos"), winner["entry"].alias("winner_entry"), name.alias("new_name"), "upgraded", "total_pages")


def suspects(numbers: DataFrame, series: str, number: str) -> DataFrame:
    """(series, suspect, start, end): the largest number of a series, where it reads as two of its numbers run together.

    It must lie more than twice the median gap (more than 2, with one other number) above the rest, and its text must be
    a smaller number's text followed by a whole number from 1 to the rest's largest; the largest such start counts.
    """
    rows = numbers.select(series, F.col(number).cast("double").alias("n")).where("n is not null").distinct()
    top = rows.groupBy(series).agg(F.max("n").alias("suspect"))
    others = rows.join(top, series).where("n < suspect")
    gap = F.lead("n").over(W.partitionBy(series).orderBy("n")) - F.col("n")
    others = others.withColumn("gap", gap)
    stats = others.groupBy(series).agg(F.max("n").alias("rest_max"), F.median("gap").alias("median_gap"))
    rows = others.join(stats, series).where(F.col("suspect") - F.col("rest_max") > 2 * F.coalesce("median_gap", F.lit(1.0)))
    whole, head = N.format_number(F.col("suspect")), N.format_number(F.col("n"))
    tail = F.when(whole.startswith(head), whole.substr(F.length(head) + 1, F.length(whole)))
    rows = rows.withColumn("tail", tail).where(F.col("tail").rlike(r"^\d+$"))
    rows = rows.withColumn("end", F.col("tail").try_cast("double")).where((F.col("end") >= 1) & (F.col("end") <= F.col("rest_max")))
    return rows.groupBy(series, "suspect").agg(F.max("n").alias("start"), F.max_by("end", "n").alias("end"))
