"""Stages of the corpus pipeline: each takes documents and returns the documents that go on.

Decisions are made and applied by row, not by id: a row is named by its place (file and row of it) in the written table that the
stage before has left; documents that do not come from such a table are written first. So rows that repeat an id with
other texts, or have none, are each kept or dropped for their own sake. All columns of the input are returned, whatever
they are called; null texts count as empty, very long texts are read whole, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exact, language, mixing, neardup, packing
from .common import cut, matching, new_dir, table_at, text_of

ROW = "__row"


def by_row(docs: DataFrame) -> DataFrame:
    """docs with ROW, a number of its own for each row, the same whenever the table is read."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        docs = table_at(docs, new_dir(docs.sparkSession, "rows"))
    paths = sorted(r[0] for r in docs.select("_metadata.file_path").distinct().collect())  # as many as the table has files
    files = docs.sparkSession.createDataFrame(list(enumerate(paths)), "__file long, __path string")
    placed = docs.select(*docs.columns, F.col("_metadata.file_path").alias("__at"), F.col("_metadata.row_index").alias("__nth"))
    placed = placed.join(F.broadcast(files), F.col("__at") == F.col("__path"))
    return placed.select(*(placed[c] for c in docs.columns), (F.shiftleft("__file", 40) + F.col("__nth")).alias(ROW))


def without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """rows but for those whose ROW is the first column of dropped."""
    return matching(rows, cut(dropped), ROW, "left_anti").drop(ROW)


def keep_languages(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """Without documents that have no letter or in which no language holds ``least`` of the weight.

    Where no row is labelled there is nothing to learn, and only texts without a letter go.
    """
    book = language.learn(docs)
    if not book.languages:
        return docs.where(text_of("text").rlike(r"\p{L}"))
    rows = by_row(docs)
    found = language.predict(rows, book, id_col=ROW)
    return without(rows, found.where((F.col("lang_pred") == "und") | (F.col("score") < least)).select(ROW))


def keep_first_copies(docs: DataFrame) -> DataFrame:
    """One document of each group of equal texts, whatever their ids; the one that exact dedup keeps."""
    rows = by_row(docs)
    return without(rows, exact.exact_duplicates(rows, also=(ROW,)).where("not kept").select(ROW))


def keep_one_of_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each class of near duplicates: of the smallest id (none last), then the first row.

    A text of fewer than five words has no near copies; equal texts that are left are one class.
    """
    rows = by_row(docs)
    members = cut(neardup.near_duplicates(rows, id_col=ROW).where("class_size > 1").select(ROW, "class_id"))
    named = matching(rows.select(ROW, "doc_id"), members, ROW, "inner").select(ROW, "class_id", "doc_id")
    best = named.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW)).alias("best")).select(F.col(f"best.{ROW}").alias(ROW))
    return without(rows, members.select(ROW).join(best, ROW, "left_anti"))


def to_target_mix(docs: DataFrame, most: int = 500_000) -> DataFrame:
    """Each document as often as the mix takes it, most of a document counting as all of it; rows of one id go alike.

    Null, empty and blank texts are never taken; a very long text is taken whole or not. Ties of quotients go to the first source.
    """
    taken = cut(mixing.mix(docs).groupBy("doc_id").agg(F.max("copies").alias("__copies"))).withColumnRenamed("doc_id", "__mix_id")
    small = taken.limit(most + 1).count() <= most
    joined = docs.join(F.broadcast(taken) if small else taken, docs["doc_id"].eqNullSafe(F.col("__mix_id")))
    repeated = joined.withColumn("__copies", F.explode(F.array_repeat(F.lit(1), F.col("__copies"))))
    return repeated.select(*(docs[c] for c in docs.columns))


def packed(docs: DataFrame) -> DataFrame:
    """Pieces of documents in sequences; a null or empty text is one piece of the end id alone, a very long one many pieces."""
    return packing.pack(docs)
