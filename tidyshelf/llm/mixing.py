"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Sources in code-point order, null last, weigh 1, 2, 3, 1, ... and share all words; a target stops at ``most`` times its
source's words and the excess is shared again by weight. The mix is a number of blocks of ``block`` words, dealt to
``shards``. For each mix shard, blocks go to sources by highest quotient target / (2 k - 1), so that quotas are integers and
the shards' quotas add up to the apportionment of the whole. A source's documents stand in an order that a seed fixes and
form one stream of words, cut into blocks and repeated as often as it takes (``most`` times at most); each shard takes its
quota of blocks from where the shard before it stopped. Rows tell which shards take how many of their words.

Positions in a stream come from two sums: documents are dealt to 4,096 buckets by a hash of their id, added up there, and
shifted by the buckets before; a source's quotas travel with its buckets' shifts. A source that holds most rows is thus spread
over thousands of partitions; only one row for each source and bucket, or source and shard, meets in one place. Targets and
quotas are windows over one row a source (and shard).

Null and empty texts have no words and are never taken. Rows that repeat an id stand next to each other and each count.
Sources without words get the target 0. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, documents, text_of

#: Fixed value: a word of the contract.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def measured(df: DataFrame, seed: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    order = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    return df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(text_of(text_col)).alias("size"), order.alias("order"))


def targets(rows: DataFrame, most: int = 3) -> DataFrame:
    """(source, nth, source_size, target) by weights 1, 2, 3 repeating; one row a source."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = sources.withColumn("nth", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    sources = sources.withColumns({"weight": (F.col("nth") - 1) % 3 + 1, "cap": most * F.col("source_size")})
    everything, earlier = W.partitionBy(F.lit(0)), W.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), "nth").rowsBetween(W.unboundedPreceding, -1)
    total, weights = F.sum("source_size").over(everything), F.sum("weight").over(everything)
    level = (total - F.coalesce(F.sum("cap").over(earlier), F.lit(0))) / (weights - F.coalesce(F.sum("weight").over(earlier), F.lit(0)))
    sources = sources.withColumn("capped", level > F.col("cap") / F.col("weight"))
    left, sharing = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(everything), total - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(sharing / left * F.col("weight"))
    return sources.select("source", "nth", "source_size", target.alias("target"))


def apportioned(sources: DataFrame, block: int, shards: int) -> DataFrame:
    """(source, shard, quota): blocks by highest quotients, for each of the mix's shards.

    The apportionment of the first h shards' blocks, less that of the first h - 1, is what shard h gets; Sainte-Laguë never
    takes a seat back when there are more seats. A source's seats stay within S p / 2 + 1 of its rounded share p of them,
    S being the number of sources, so only those seats are ranked.
    """
    everything = W.partitionBy(F.lit(0))
    s = sources.withColumns({"total": F.sum("target").over(everything), "n": F.count(F.lit(1)).over(everything)}).where("target > 0")
    s = s.withColumn("house", F.explode(F.sequence(F.lit(1), F.lit(shards))))
    seats = F.ceil(F.col("total") / block)
    s = s.withColumn("seats", F.floor(seats * F.col("house") / shards))
    share = F.col("target") / F.col("total")
    s = s.withColumns({"near": F.floor(share * F.col("seats") + 0.5), "spread": F.ceil(share * F.col("n") / 2) + 1})
    s = s.withColumn("sure", F.greatest(F.lit(0), F.col("near") - F.col("spread")))
    of_house = W.partitionBy("house")
    s = s.withColumn("open", F.col("seats") - F.sum("sure").over(of_house))
    ranked = s.withColumn("k", F.explode(F.sequence(F.col("sure") + 1, F.col("near") + F.col("spread"))))
    ranked = ranked.withColumn("rank", F.row_number().over(of_house.orderBy((F.col("target") / (2 * F.col("k") - 1)).desc(), "nth", "k")))
    upto = ranked.groupBy("nth", "source", "house").agg((F.max("sure") + F.sum(F.when(F.col("rank") <= F.col("open"), 1).otherwise(0))).alias("upto"))
    before = F.coalesce(F.lag("upto").over(W.partitionBy("nth").orderBy("house")), F.lit(0))
    return upto.select("source", (F.col("house") - 1).alias("shard"), (F.col("upto") - before).cast("long").alias("quota"))


def positions(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows with ``start``, the words before each in its source's seeded stream, and what plan (s, ...) holds of its source."""
    rows = rows.withColumn("bucket", F.substring("order", 1, 3))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("size"))
    before = F.coalesce(F.sum("size").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.withColumn("before", before).join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("source", "size").withColumnRenamed("bucket", "b")
    inside = F.sum("size").over(W.partitionBy("source", "bucket").orderBy("order", "id", "size").rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = rows.withColumn("upto", inside)
    rows = rows.join(offsets, rows.source.eqNullSafe(offsets.s) & (rows.bucket == offsets.b))
    return rows.withColumn("start", F.col("before") + F.col("upto") - F.col("size")).drop("s", "b", "before", "upto", "bucket")


def of_shards(block: int, most: int) -> Column:
    """(shard, words) of the shards that take from a row: in pass r of the stream the blocks from r n on are its blocks again."""
    n, start, end = F.col("n"), F.col("start"), F.col("start") + F.col("size")

    def words(upto: Column, shard: Column) -> Column:
        first = F.when(shard == 0, F.lit(0)).otherwise(F.get("ends", shard - 1))
        inside = lambda x, r: F.least(F.greatest(x - r * n, F.lit(0)), n) * block
        parts = [F.greatest(F.lit(0), F.least(end, inside(upto, r)) - F.greatest(start, inside(first, r))) for r in range(most)]
        return F.struct(shard.cast("int").alias("shard"), sum(parts[1:], parts[0]).cast("long").alias("words"))

    return F.filter(F.transform("ends", words), lambda x: x["words"] > 0)


def mix(df: DataFrame, seed: str = "mix", block: int = 32, most: int = 3, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """For each row: id, source, size, source_size, target, taken (words of it in the mix), copies (whole ones) and shards
    (which mix shards take how many of those words)."""
    rows = cut(measured(df, seed, id_col, text_col, source_col))
    goals = targets(rows, most)
    upto = F.sum("quota").over(W.partitionBy("source").orderBy("shard"))
    ends = apportioned(goals, block, shards).withColumn("upto", upto).groupBy("source").agg(F.array_sort(F.collect_list("upto")).alias("ends"))
    # one row a source, with its stream's length in blocks and the block at which each shard stops
    plan = goals.alias("g").join(ends.alias("q"), F.col("g.source").eqNullSafe(F.col("q.source")), "left").select(
        F.col("g.source").alias("s"), "source_size", "target", F.coalesce("ends", F.array(F.lit(0).cast("long"))).alias("ends"), F.greatest(F.lit(1), F.ceil(F.col("source_size") / block)).alias("n")
    )
    plan = plan.withColumn("ends", F.transform("ends", lambda x: F.least(x, most * F.col("n"))))
    quota = F.element_at("ends", -1)
    plan = plan.withColumns({"whole": F.floor(quota / F.col("n")), "more": quota % F.col("n") * block})
    rows = positions(rows, plan).withColumn("shards", of_shards(block, most))
    taken = F.aggregate("shards", F.lit(0).cast("long"), lambda total, x: total + x["words"])
    once_more = taken - F.col("whole") * F.col("size")
    copies = (F.col("whole") + ((2 * once_more >= F.col("size")) & (F.col("size") > 0) & (F.col("more") > 0)).cast("int")).cast("int")
    return rows.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", taken.alias("taken"), F.when(F.col("size") > 0, copies).otherwise(0).alias("copies"), "shards")


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    words_of = F.array_join(F.transform("shards", lambda x: F.concat_ws(":", x["shard"], x["words"])), ",")
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", words_of.alias("shard_words"))


OP8_SQL = r"""
WITH r AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')) AS ord
  FROM documents
), s0 AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM r GROUP BY source
), s1 AS (SELECT *, (nth - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM s0
), s2 AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER e, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER e, 0)) > cap / weight AS capped
  FROM s1 WINDOW e AS (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), s3 AS (
  SELECT source, nth, source_size,
         CASE WHEN capped THEN CAST(cap AS DOUBLE)
              ELSE (sum(source_size) OVER () - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () * weight END AS target
  FROM s2
), h AS (
  SELECT *, sum(target) OVER () AS total, count(*) OVER () AS n, ceil(sum(target) OVER () / 32) AS seats FROM s3
), c AS (
  SELECT source, nth, target, seats, k FROM h, generate_series(1, CAST(floor(target / total * seats + 0.5) + ceil(target / total * n / 2) + 1 AS BIGINT)) g(k) WHERE target > 0
), k AS (SELECT source, seats, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, nth, k) AS rank FROM c
), q AS (
  SELECT source, list(upto ORDER BY shard) AS ends
  FROM (SELECT source, shard, count(*) FILTER (rank <= floor(seats * (shard + 1) / 16)) AS upto FROM k, generate_series(0, 15) g(shard) GROUP BY ALL) GROUP BY source
), p AS (
  SELECT s3.source, source_size, target, CAST(greatest(1, ceil(source_size / 32)) AS BIGINT) AS n, coalesce(ends, list_value(0)) AS ends
  FROM s3 LEFT JOIN q ON s3.source IS NOT DISTINCT FROM q.source
), w AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY ord, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start FROM r
), x AS (
  SELECT doc_id, size, source_size, target, list_transform(range(0, len(ends)), lambda h: CAST(list_sum(list_transform([0, 1, 2], lambda r:
           greatest(0, least(start + size, least(greatest(least(ends[h + 1], 3 * n) - r * n, 0), n) * 32)
                       - greatest(start, least(greatest(CASE WHEN h = 0 THEN 0 ELSE least(ends[h], 3 * n) END - r * n, 0), n) * 32)))) AS BIGINT)) AS taken_of
  FROM w JOIN p ON w.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target, CAST(list_sum(taken_of) AS BIGINT) AS taken,
       array_to_string(list_transform(list_filter(range(0, len(taken_of)), lambda h: taken_of[h + 1] > 0), lambda h: h || ':' || taken_of[h + 1]), ',') AS shard_words
FROM x
"""
