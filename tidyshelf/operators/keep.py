"""Which of several files stays: duplicates, collisions and merges, as rows of planned actions."""

from __future__ import annotations

from functools import reduce
from itertools import pairwise
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import fixed

#: Rows of one task, about, where an order is kept in memory.
SHARE = 500_000


def largest(files: DataFrame, keys: list[str], size: str, name: str, salts: int = 16) -> DataFrame:
    """Groups of two or more: rank 1 (the largest, then the first name) stays. Adds rank, members, keep. Null keys are a group.

    Rows of groups are dealt to ranges of the whole order and numbered inside each, so that a group that holds most files is
    ranked by many tasks. Only the group that a range begins in the middle of is shifted, by its counts in the ranges before.
    """
    same = lambda other: reduce(and_, (F.col(k).eqNullSafe(F.col(f"__{other}{i}")) for i, k in enumerate(keys)))
    renamed = lambda df, to: df.withColumnsRenamed({k: f"__{to}{i}" for i, k in enumerate(keys)})
    groups = renamed(files.groupBy(*keys).agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "g")
    groups = groups.withColumn("__place", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = files.withColumn("__salt", F.pmod(F.xxhash64(name, size), F.lit(salts)).cast("int"))
    rows = fixed(rows.join(groups, same("g") & (F.col("__salt") == F.col("__place"))).select(*files.columns, "members"))  # ranges are sampled from these
    order = [F.desc(size), F.asc(name)]
    rows = fixed(rows.repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id()))
    earlier = W.partitionBy(*keys).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    shifts = rows.groupBy(*keys, "__range").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.sum("__n").over(earlier)).where("__before > 0")
    shifts = F.broadcast(renamed(shifts.drop("__n").withColumnRenamed("__range", "__r"), "s"))  # at most one row a range
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys, "__range").orderBy(*order)))
    rows = rows.join(shifts, same("s") & (F.col("__range") == F.col("__r")), "left").withColumn("rank", F.col("rank") + F.coalesce("__before", F.lit(0)))
    return rows.select(*files.columns, "members", "rank", (F.col("rank") == 1).alias("keep"))


def losers(files: DataFrame, keys: list[str], size: str, name: str, salts: int = 16) -> DataFrame:
    """The files that ``largest`` would not keep, without ranking: for plans over groups of any size.

    Winners are aggregated before the shuffle and sent to ``salts`` places, so that a key that holds most files is spread.
    """
    best = files.groupBy(*keys).agg(F.max(F.col(size)).alias("__size"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    spread = lambda df: df.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = files.withColumn("__salt", F.pmod(F.xxhash64(name, size), F.lit(salts)).cast("int"))

    def met(rows: DataFrame, table: DataFrame) -> DataFrame:  # a null key is a key like others
        table = table.toDF(*(f"__k_{c}" if c in keys else c for c in table.columns[:-1]), "__s")
        return rows.join(table, reduce(and_, (F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys), F.col("__salt") == F.col("__s"))).drop("__s", *(f"__k_{k}" for k in keys))

    rows = met(rows, spread(best))
    first = rows.where(F.col(size) == F.col("__size")).groupBy(*keys).agg(F.min(name).alias("__name"))
    return met(rows, spread(first)).where((F.col(size) < F.col("__size")) | (F.col(name) != F.col("__name"))).select(*files.columns)


def merged(existing: DataFrame, incoming: DataFrame, keys: list[str], size: str, order: str) -> DataFrame:
    """One row a key: an incoming file replaces what is there only if it is strictly larger; of equals the first comes first.

    Aggregated before the shuffle, so that a directory that many files collide in is no hot spot.
    """
    cols = [c for c in existing.columns if c not in keys]
    both = existing.withColumn("is_existing", F.lit(1)).unionByName(incoming.withColumn("is_existing", F.lit(0)))
    best = F.min_by(F.struct(*cols, "is_existing"), F.struct(-F.col(size), -F.col("is_existing"), F.col(order)))
    out = both.groupBy(*keys).agg(best.alias("best"), F.count(F.lit(1)).alias("contenders"))
    return out.select(*keys, "best.*", "contenders").withColumn("replaced", (F.col("is_existing") == 0) & (F.col("contenders") > 1))


def suffixed(rows: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """Names that collide get `` (1)``, `` (2)``, ... from the second on, in order."""
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(order))
    return rows.withColumn("nth", nth).withColumn("new_name", F.when(F.col("nth") == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit(" ("), F.col("nth") - 1, F.lit(")"))))


def free_suffix(wanted: DataFrame, taken: DataFrame, name: str, keys: list[str] | None = None, order: str | None = None, most: int = 99) -> DataFrame:
    """The first free `` (i)``, i up to ``most``, against names already taken in the destination (keys); null if none is.

    With ``order``, rows that want one name take the free ones in that order.
    """
    keys = keys or []
    bases = F.array_distinct(F.array(F.col(name), F.regexp_extract(name, r"^(.*?)(?: \((\d+)\))?$", 1)))
    used = taken.select(*keys, name, F.explode(bases).alias("__base")).groupBy(*keys, "__base").agg(F.collect_set(name).alias("__used")).withColumnRenamed("__base", name)
    out = wanted.join(used, [*keys, name], "left")
    options = F.concat(F.array(F.col(name)), F.transform(F.sequence(F.lit(1), F.lit(most)), lambda i: F.concat(F.col(name), F.lit(" ("), i.cast("string"), F.lit(")"))))
    free = F.array_except(options, F.coalesce("__used", F.array().cast("array<string>")))
    nth = F.row_number().over(W.partitionBy(*keys, name).orderBy(order)) - 1 if order else F.lit(0)
    return out.withColumn("__nth", nth).withColumn("new_name", F.get(free, F.col("__nth"))).drop("__used", "__nth")


def generic_numbering(files: DataFrame, directory: str, order: str, generic: Column, dir_name: Column) -> DataFrame:
    """Files without a telling name take their directory's, numbered in order if there are several."""
    rows = files.where(generic)
    w = W.partitionBy(directory)
    nth, several = F.row_number().over(w.orderBy(order)), F.count(F.lit(1)).over(w) > 1
    return rows.withColumns({"nth": nth, "new_name": F.when(several, F.concat(dir_name, F.lit(" "), nth)).otherwise(dir_name)})


def tasks_for(rows: DataFrame, share: int = SHARE) -> int:
    """How many tasks rows need of which each gets about ``share``; as many as the session's shuffles have, at least."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // share))


def renamed_one_by_one(files: DataFrame, whole: int = 1000) -> DataFrame:
    """(dir_path, name, new_name, size) -> (…, outcome): renames in name order, where later files see earlier ones.

    Outcomes: unchanged, renamed, renamed over smaller (the file that had the name goes), discarded (it goes itself), replaced
    (its own name, which it was to keep, has gone to an earlier and larger file). Names and the names they are to get make a
    graph, and files of different components never meet. Components in which no file is to take the name of another one are a
    window over the files that want one name; only the others go through Python, each by itself, in order. Directories of at
    most ``whole`` files are walked as they are, which comes to the same.
    """
    rows = files.select("dir_path", "name", "new_name", F.col("size").cast("long").alias("size"))
    n = tasks_for(rows)
    rows = rows.repartition(n, "dir_path")
    held = F.struct("name", F.lit(True).alias("has"))
    sought = F.when(F.col("new_name") != F.col("name"), F.struct(F.col("new_name").alias("name"), F.lit(False).alias("has")))
    names = rows.where("dir_path is not null").select("dir_path", F.explode(F.array_compact(F.array(held, sought))).alias("x")).select("dir_path", "x.name", "x.has")
    met = names.where("name is not null").groupBy("dir_path", "name").agg(F.bool_or("has").alias("has"), F.bool_and("has").alias("only"))
    taken = met.where("has and not only").select("dir_path", "name")
    chained = fixed(taken.select("dir_path").distinct())
    w = W.partitionBy("dir_path", "new_name").orderBy("name")
    largest_before = F.max("size").over(w.rowsBetween(W.unboundedPreceding, -1))
    outcome = F.when(F.col("name") == F.col("new_name"), "unchanged").when(largest_before.isNull(), "renamed").when(F.col("size") > largest_before, "renamed over smaller").otherwise("discarded")
    plain = rows.join(chained, "dir_path", "left_anti")
    if not chained.limit(1).count():
        return plain.withColumn("outcome", outcome)
    crowds = rows.join(chained, "dir_path", "left_semi").groupBy("dir_path").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > whole).select("dir_path")
    crowds = fixed(crowds)
    few = rows.join(chained.join(crowds, "dir_path", "left_anti"), "dir_path", "left_semi").withColumn("component", F.lit(""))
    if not crowds.limit(1).count():
        return plain.withColumn("outcome", outcome).unionByName(in_turn(few.repartition(n, "dir_path", "component")))
    named = fixed(in_components(rows.join(crowds, "dir_path", "left_semi")))
    walked = named.select("dir_path", "name", "component").join(taken, ["dir_path", "name"], "left_semi").select("dir_path", "component").distinct()
    apart = named.join(walked, ["dir_path", "component"], "left_anti").select(*rows.columns)
    return plain.unionByName(apart).withColumn("outcome", outcome).unionByName(in_turn(few.unionByName(named.join(walked, ["dir_path", "component"], "left_semi").select(*few.columns)).repartition(n, "dir_path", "component")))


def in_components(rows: DataFrame) -> DataFrame:
    """rows with ``component``: the name at which the way from name to new name ends, or the least name of the circle it runs into.

    Pointers are doubled in each round until all ways have ended and circles have been seen whole, so a way of n names takes
    log n rounds; rounds are written to the checkpoint folder.
    """
    way = fixed(rows.where("new_name <> name").select("dir_path", "name", F.col("new_name").alias("at"), F.least("name", "new_name").alias("least")))
    open_before = -1
    while True:
        ahead = way.select("dir_path", F.col("name").alias("at"), F.col("at").alias("far"), F.col("least").alias("far_least"))
        both = way.join(ahead, ["dir_path", "at"], "left")
        going, less = F.col("far").isNotNull(), F.coalesce(F.col("far_least") < F.col("least"), F.lit(False))
        after = fixed(both.select("dir_path", "name", F.coalesce("far", "at").alias("at"), F.least("least", F.coalesce("far_least", "least")).alias("least"), going.alias("going"), less.alias("less")))
        seen = after.agg(F.count_if("going").alias("n"), F.count_if("less").alias("less")).first()
        way = after.select("dir_path", "name", "at", "least")
        if seen["n"] == open_before and not seen["less"] or not seen["n"]:
            break
        open_before = seen["n"]
    circle = way.select("dir_path", F.col("name").alias("at"), F.col("least").alias("round"))
    found = way.join(circle, ["dir_path", "at"], "left").select("dir_path", "name", F.coalesce("round", "at").alias("component"))
    return rows.join(found, ["dir_path", "name"], "left").withColumn("component", F.coalesce("component", "name"))


def walk(names: list[str], wanted: list[str], sizes: list[int]) -> list[str]:
    """The outcomes of one component's files, in the order of names."""
    holder, lost, out = dict(zip(names, sizes, strict=True)), set(), []
    for name, new in zip(names, wanted, strict=True):
        if new == name:
            outcome = "replaced" if name in lost else "unchanged"
        elif new not in holder:
            outcome, holder[new] = "renamed", holder.pop(name)
        elif holder[name] > holder[new]:
            outcome, holder[new] = "renamed over smaller", holder.pop(name)
            lost.add(new)
        else:
            outcome = "discarded"
            holder.pop(name)
        out.append(outcome)
    return out


def in_turn(rows: DataFrame) -> DataFrame:
    """Components, each in one partition, walked in the order of names; rows are streamed, and only one component is held."""
    columns = ["dir_path", "name", "new_name", "size"]

    def run(batches):
        held: list[pd.DataFrame] = []
        for pdf in batches:
            pdf = pd.concat([*held, pdf], ignore_index=True)
            turn = (pdf["dir_path"].ne(pdf["dir_path"].shift()) | pdf["component"].ne(pdf["component"].shift())).to_numpy().nonzero()[0]
            held = [pdf.iloc[turn[-1] :]]  # may go on in the next batch
            yield settled(pdf.iloc[: turn[-1]], turn)
        for pdf in held:
            yield settled(pdf, [0, len(pdf)])

    def settled(pdf: pd.DataFrame, bounds) -> pd.DataFrame:
        names, wanted, sizes = (pdf[c].tolist() for c in columns[1:])
        out = [o for a, b in pairwise(bounds) for o in walk(names[a:b], wanted[a:b], sizes[a:b])]
        return pdf[columns].assign(outcome=pd.Series(out, index=pdf.index, dtype=object))

    ordered = rows.sortWithinPartitions("dir_path", "component", "name")
    return ordered.mapInPandas(run, "dir_path string, name string, new_name string, size long, outcome string")


def outcomes(rows: DataFrame, outcome: Column) -> DataFrame:
    return rows.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def actions(rows: DataFrame, op: Column | str, src: Column, dest: Column | None, reason: Column | str, size: Column | None = None) -> DataFrame:
    """The planned action of each row: (op, src, dest, reason, size). Nothing is touched until a sink applies them."""
    text = lambda x: x if isinstance(x, Column) else F.lit(x)
    return rows.select(
        text(op).alias("op"), src.cast("string").alias("src"), (F.lit(None) if dest is None else dest).cast("string").alias("dest"),
        text(reason).alias("reason"), (F.lit(None) if size is None else size).cast("long").alias("size"),
    )
