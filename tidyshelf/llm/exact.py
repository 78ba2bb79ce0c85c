"""Exact duplicates by progressive refinement: length, then a hash of a prefix, then a hash of everything.

Texts are equal when identical after white space is deleted. One scan takes each text's length, a hash of its first
characters and, where asked for, its digest, and writes those narrow rows; texts themselves are never shuffled. Then rows
whose length no other row has are settled, of the rest those whose (length, prefix hash) no other row has, and only what
is left is compared by full digest. Counts are aggregated before they are shuffled, so a group that holds a third of all
rows arrives as one row a task.

Of equal texts the one with the most code points stays, then the smallest id (a null id last), then the first of rows
that repeat an id. Null texts are empty, and empty texts are equal. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, cut, documents, text_of


def squeezed(text: Column) -> Column:
    return F.translate(text, SPACES, "")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64, also: tuple[str, ...] = ()) -> DataFrame:
    """The narrow rows: row, id, points (code points of the original), length and prefix hash and digest of the rest; also: columns that come along."""
    bare = squeezed(text_of(text_col))
    rows = df.select(F.col(id_col).alias("id"), F.length(text_of(text_col)).alias("points"), bare.alias("bare"), *also)
    return rows.select(
        *also, F.monotonically_increasing_id().alias("row"), "id", "points", F.octet_length("bare").alias("size"),
        F.xxhash64(F.substring("bare", 1, prefix)).alias("prefix"), F.unhex(F.sha2(F.col("bare").cast("binary"), 256)).alias("digest"),
    )


SALTS = 8


def salted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))


def everywhere(keys: DataFrame) -> DataFrame:
    """Each key in SALTS places; a row looks in one of them, so that rows of one key do not meet in one task."""
    return keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def shared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys some other row has too."""
    twice = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys)
    return rows.join(everywhere(twice), [*keys, "salt"], "left_semi")


def duplicate_groups(rows: DataFrame) -> DataFrame:
    """(size, prefix, digest, keep_id, keep_row, group_size) of every group of two rows or more."""
    left = shared(shared(rows, ["size"]), ["size", "prefix"])
    best = F.min(F.struct(-F.col("points"), F.col("id").isNull(), "id", "row")).alias("best")
    groups = left.groupBy("size", "prefix", "digest").agg(F.count(F.lit(1)).alias("group_size"), best).where("group_size > 1")
    return groups.select("size", "prefix", "digest", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size")


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64, also: tuple[str, ...] = ()) -> DataFrame:
    """For each row: id, keep_id, group_size, kept, text_sha256 of the squeezed text, and the columns named in also."""
    rows = salted(cut(digests(df, id_col, text_col, prefix, also)))
    out = rows.join(everywhere(duplicate_groups(rows)), ["size", "prefix", "digest", "salt"], "left")
    return out.select(
        F.col("id").alias(id_col), F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (F.col("group_size").isNull() | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), *also,
    )


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


OP10_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS text_sha256
  FROM documents
), w AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST) AS keep_id,
         row_number() OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST) AS rn,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, text_sha256 FROM w
"""
