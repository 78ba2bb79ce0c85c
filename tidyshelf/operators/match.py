"""Names that are nearly the same: candidates by a prefix-filtered join, the ratio by Arrow, and who absorbs whom in rounds.

A ratio of t or more needs t / 2 of both names' letters in common. Letters with their occurrence number (the second e, the
first k) make a name a set; ordered by rarity, two names that have enough in common share one of their first few letters, a third of
them at 0.8. Only those are joined on. A pair that shares several is taken at the first of them, so nothing is made distinct,
and letters that many names of a parent share are dealt to several tasks.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names as N
from ..functions import patterns as P
from ..session import fixed

#: Names of one bucket that meet in one task, and rows of a table that is sent to every task.
PER_TASK, MOST_SENT = 2048, 100_000


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Not symmetric: a stands first in sorted order."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def letters(key: Column) -> Column:
    """How often each character occurs, as an array of (character, count)."""
    chars = F.array_sort(F.split(key, ""))
    return F.transform(F.array_distinct(chars), lambda c: F.struct(c.alias("c"), F.size(F.filter(chars, lambda x: x == c)).alias("n")))


def lettered(dirs: DataFrame, parent: str, name: str) -> DataFrame:
    """(parent, name, key, len, tokens): tokens are the key's letters with their occurrence numbers, the rarest of all names first."""
    rows = dirs.select(F.col(parent).alias("parent"), F.col(name).alias("name"), N.compare_key(F.col(name)).alias("key")).where("key <> ''")
    rows = rows.withColumn("letters", letters(F.col("key")))
    each = F.flatten(F.transform("letters", lambda x: F.transform(F.sequence(F.lit(1), x["n"]), lambda k: F.struct(x["c"].alias("c"), k.alias("k")))))
    rows = fixed(rows.select("parent", "name", "key", F.length("key").alias("len"), each.alias("tokens")))
    rarity = fixed(rows.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")))
    rarity = F.broadcast(rarity) if rarity.limit(MOST_SENT + 1).count() <= MOST_SENT else rarity
    told = rows.withColumn("t", F.explode("tokens")).join(rarity, "t")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda x: F.concat(x["t"]["c"], x["t"]["k"].cast("string")))
    return told.groupBy("parent", "name", "key", "len").agg(ordered.alias("tokens"))


def candidates(dirs: DataFrame, parent: str, name: str, least: float = P.REPORT_RATIO) -> DataFrame:
    """Pairs a < b of one parent whose lengths and letters allow a ratio of ``least``."""
    share = least / (2 - least)  # a partner's length is at least this much of a name's, and so are the letters in common
    rows = lettered(dirs, parent, name)
    rows = fixed(rows.withColumn("prefix", F.slice("tokens", 1, F.greatest(F.lit(1), F.col("len") - F.ceil(F.col("len") * share - 1e-9).cast("int") + 1))))
    keyed = rows.withColumn("token", F.explode("prefix"))
    crowds = keyed.groupBy("parent", "token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").withColumn("parts", F.ceil(F.col("c") / PER_TASK).cast("int"))
    keyed = keyed.join(crowds.select("parent", "token", "parts"), ["parent", "token"])
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("name", "key", "len", "tokens", "prefix")]
    a = keyed.select("parent", "token", F.pmod(F.xxhash64("name"), "parts").cast("int").alias("part"), *side("a"))
    b = keyed.select("parent", "token", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *side("b"))
    near = F.least("len_a", "len_b") * 2 >= least * (F.col("len_a") + F.col("len_b")) - 1e-9
    pairs = a.join(b, ["parent", "token", "part"]).where((F.col("name_a") < F.col("name_b")) & near)
    pairs = pairs.where(F.get(F.array_intersect("prefix_a", "prefix_b"), F.lit(0)) == F.col("token"))  # the first that both have
    return pairs.where(F.size(F.array_intersect("tokens_a", "tokens_b")) * 2 >= least * (F.col("len_a") + F.col("len_b")) - 1e-9).select("parent", "name_a", "name_b", "key_a", "key_b")


def matches(dirs: DataFrame, parent: str, name: str, least: float = P.REPORT_RATIO, auto: float = P.AUTO_RATIO) -> DataFrame:
    """(parent, name_a, name_b, ratio, decision) of pairs of ratio ``least`` or more."""
    pairs = candidates(dirs, parent, name, least).withColumn("ratio", ratio("key_a", "key_b")).where(F.col("ratio") >= least)
    return pairs.select("parent", "name_a", "name_b", "ratio", F.when(F.col("ratio") >= auto, "auto").otherwise("review").alias("decision"))


def edit_matches(dirs: DataFrame, parent: str, name: str, least: float = P.REPORT_RATIO) -> DataFrame:
    """The same with 1 - edit distance / longer length, which SQL engines share; all pairs of one parent's bands."""
    pairs = candidates(dirs, parent, name, least - 1e-9)  # common letters are at least the longer length less the distance
    likeness = 1 - F.levenshtein("key_a", "key_b") / F.greatest(F.length("key_a"), F.length("key_b"))
    return pairs.withColumn("likeness", likeness).where(F.col("likeness") >= least).select("parent", "name_a", "name_b", "likeness")


def greedy(pairs: DataFrame, counts: DataFrame, auto: float = P.AUTO_RATIO) -> DataFrame:
    """Pairs by falling ratio; a pair of which one side was absorbed is passed over, an auto pair absorbs its secondary.

    counts: (parent, name, files). Primary: more files, then the longer name, then the first name. Which side would go is
    thus known beforehand, and a pair is threatened only by better pairs in which one of its names would go. Each round settles
    all auto pairs that no open pair threatens, those of a name that absorbs thousands at once, and drops the later pairs of
    names that have gone; rounds are written to the checkpoint folder until none is open. Review pairs come after all auto ones.
    """
    side = lambda x: counts.select("parent", F.col("name").alias(f"name_{x}"), F.col("files").alias(f"files_{x}"))
    rows = pairs.join(side("a"), ["parent", "name_a"], "left").join(side("b"), ["parent", "name_b"], "left").fillna(0, ["files_a", "files_b"])
    strength = lambda x: F.struct(-F.col(f"files_{x}"), -F.length(f"name_{x}"), F.col(f"name_{x}"))
    first = strength("a") < strength("b")
    rows = rows.select(
        "parent", "ratio", F.struct(-F.col("ratio"), "name_a", "name_b").alias("rank"),
        F.when(first, F.col("name_a")).otherwise(F.col("name_b")).alias("primary_name"), F.when(first, F.col("name_b")).otherwise(F.col("name_a")).alias("secondary_name"),
    )
    rows = fixed(rows)
    open_ = rows.where(F.col("ratio") >= auto)
    settled: list[DataFrame] = []
    while open_.limit(1).count():
        threat = open_.groupBy("parent", "secondary_name").agg(F.min("rank").alias("threat"))
        own = threat.withColumnRenamed("threat", "best")
        other = threat.withColumnRenamed("secondary_name", "primary_name")
        looked = open_.join(own, ["parent", "secondary_name"]).join(other, ["parent", "primary_name"], "left")
        now = fixed(looked.where((F.col("rank") == F.col("best")) & (F.col("threat").isNull() | (F.col("rank") < F.col("threat")))).select(*rows.columns))
        settled.append(now)
        gone = now.select("parent", F.col("secondary_name").alias("gone"), F.col("rank").alias("since"))
        left = open_
        for name in ("primary_name", "secondary_name"):
            at = gone.withColumnRenamed("gone", name)
            left = left.join(at, ["parent", name], "left").where(F.col("since").isNull() | (F.col("rank") < F.col("since"))).drop("since")
        open_ = fixed(left.select(*rows.columns))
    review = rows.where(F.col("ratio") < auto)
    out = [review.withColumn("decision", F.lit("review"))]
    if settled:
        done = settled[0]
        for more in settled[1:]:
            done = done.unionByName(more)
        gone = fixed(done.select("parent", F.col("secondary_name").alias("gone")))
        for name in ("primary_name", "secondary_name"):
            out[0] = out[0].join(gone.withColumnRenamed("gone", name), ["parent", name], "left_anti")
        out.append(done.withColumn("decision", F.lit("auto")))
    names = ("parent", "primary_name", "secondary_name", "ratio", "decision")
    found = out[0].select(*names).unionByName(out[1].select(*names)) if len(out) > 1 else out[0].select(*names)
    return found.orderBy("parent", F.desc("ratio"), F.least("primary_name", "secondary_name"), F.greatest("primary_name", "secondary_name"))  # as they are walked
