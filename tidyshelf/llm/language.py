"""Language identification by error-correcting output codes.

Each language has a codeword of bits. One binary classifier a bit, over hashed byte n-grams of the whole lower-case text,
predicts that bit; a text gets the language whose codeword has the least summed logistic loss against the bits' margins.
Up to five languages have the exhaustive code of 2**(n-1) - 1 bits; more have random codewords, of which the draw with the
widest least distance is kept.

Every label that occurs is a language. Learning takes at most ``per_language`` rows of each, fewer (8 at least) where that
would be more than ``sample_rows`` in all (bounds by parameter; the rows of lowest hash, so that the choice is the same at every
run), and only rows whose crc32 of the id mod 4 is not 2. Examples reach the driver as sparse counts and are fitted in slices: sample_rows of them, or
8 a language where there are more languages than that.
Prediction reads every text whole, in one pass without a shuffle.

Null texts and texts without a letter are ``und`` with score 0. With no labelled rows every text is ``und``. Equal
distances go to the first language by name. Repeated rows are predicted each; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .bytesview import gram_counts
from .common import cut, documents, give_back, remainder, text_of

SIZES, BITS = (1, 2, 3, 4), 12


@dataclass
class Codebook:
    languages: list[str]
    code: np.ndarray  # languages x bits, of 1 and -1
    weights: np.ndarray  # n-grams x bits
    bias: np.ndarray


def codewords(n: int, seed: int = 7) -> np.ndarray:
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        columns = range(1, 1 << (n - 1))
        return np.array([[1 if i == 0 or not c >> (i - 1) & 1 else -1 for c in columns] for i in range(n)], float)
    draws, best = np.random.default_rng(seed), None
    for _ in range(max(1, min(200, 200_000_000 // n**2))):
        code = np.where(draws.random((n, max(15, int(np.ceil(10 * np.log2(n)))))) < 0.5, -1.0, 1.0)
        apart = (code.shape[1] - code @ code.T) / 2 + np.eye(n) * code.shape[1]
        if best is None or apart.min() > best[0]:
            best = apart.min(), code
    return best[1]


def scaled(counts: np.ndarray) -> np.ndarray:
    """Square roots of counts, each row of length 1."""
    x = np.sqrt(counts, dtype=np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


class Sparse:
    """Rows of scaled counts: the n-grams each has and their values, made dense a slice at a time."""

    def __init__(self, grams: np.ndarray, values: np.ndarray, ends: np.ndarray, width: int, step: int = 1024):
        self.grams, self.values, self.ends, self.width, self.step = grams, values, ends, width, step

    def __len__(self) -> int:
        return len(self.ends) - 1

    def slices(self) -> Iterator[tuple[slice, np.ndarray]]:
        for s in range(0, len(self), self.step):
            e = min(len(self), s + self.step)
            a, b = self.ends[s], self.ends[e]
            x = np.zeros((e - s, self.width), np.float32)
            x[np.repeat(np.arange(e - s), np.diff(self.ends[s : e + 1])), self.grams[a:b]] = self.values[a:b]
            yield slice(s, e), x


def fitted(rows: Sparse, y: np.ndarray, penalty: float = 3e-4, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regressions for all columns of y (1 and -1) at once, by accelerated gradient steps."""
    w, b = np.zeros((rows.width, y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    seen_w, seen_b, step = w, b, 2.0
    whole = list(rows.slices()) if len(rows) <= 4 * rows.step else None  # few slices stay dense
    for t in range(rounds):
        m = t / (t + 3)
        at_w, at_b = w + m * (w - seen_w), b + m * (b - seen_b)
        slope, level = penalty * at_w, np.zeros_like(b)
        for s, x in whole or rows.slices():
            g = (-y[s] / (1 + np.exp(np.clip(y[s] * (x @ at_w + at_b), -30, 30))) / len(rows)).astype(np.float32)
            slope, level = slope + x.T @ g, level + g.sum(0)
        seen_w, seen_b = w, b
        w, b = at_w - step * slope, at_b - step * level
    return w, b


def framed(text_col: str):
    return F.concat(F.lit(" "), F.lower(text_of(text_col)), F.lit(" ")).cast("binary")


def sample(df: DataFrame, id_col: str, lang_col: str, per_language: int, sample_rows: int) -> DataFrame:
    """(id, language) of the rows to learn from: per_language a language, or as many as sample_rows allow, but 8."""
    rows = df.select(F.col(id_col).alias("id"), F.col(lang_col).alias("language")).where(F.col("language").isNotNull() & (remainder("id", 4) != 2))
    rows = rows.withColumn("draw", F.shiftrightunsigned(F.xxhash64("id"), 11) / float(1 << 53))
    counts = cut(rows.groupBy("language").agg(F.count(F.lit(1)).alias("n")))
    languages = counts.count()
    each = max(min(8, per_language), min(per_language, sample_rows // max(1, languages)))
    likely = rows.join(F.broadcast(counts) if languages <= 100_000 else counts, "language").where(F.col("draw") * F.col("n") < 4 * each + 64)
    nth = F.row_number().over(W.partitionBy("language").orderBy("draw", "id"))
    return likely.withColumn("nth", nth).where(F.col("nth") <= each).select("id", "language")


def learn(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 512, sample_rows: int = 16_384, most_sent: int = 500_000) -> Codebook:
    chosen = cut(sample(df, id_col, lang_col, per_language, sample_rows).distinct())
    rows = df.select(F.col(id_col).alias("id"), F.col(lang_col).alias("language"), framed(text_col).alias("raw"))
    small = chosen.limit(most_sent + 1).count() <= most_sent
    rows = rows.join(F.broadcast(chosen) if small else chosen, ["id", "language"]).select("language", "raw")  # a namesake of another language is no example

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams, values = [], []
            for _, _, counts in gram_counts(b.column(1), SIZES, BITS):
                for row, x in zip(counts, scaled(counts), strict=True):
                    grams.append(np.flatnonzero(row).astype(np.int16))
                    values.append(x[grams[-1]])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(grams, pa.list_(pa.int16())), pa.array(values, pa.list_(pa.float32()))], names=["language", "grams", "scaled"])

    found = rows.mapInArrow(count, "language string, grams array<short>, scaled array<float>").toArrow().combine_chunks()
    spoken = found["language"].to_pylist()
    names = sorted(set(spoken))
    code = codewords(len(names))
    if len(names) < 2:
        return Codebook(names, code, np.zeros((1 << BITS, code.shape[1]), np.float32), np.ones(code.shape[1], np.float32))
    grams, values = (found[c].combine_chunks() for c in ("grams", "scaled"))
    ends = np.concatenate([[0], np.cumsum(grams.value_lengths().to_numpy(zero_copy_only=False))])
    x = Sparse(grams.flatten().to_numpy(zero_copy_only=False), values.flatten().to_numpy(zero_copy_only=False), ends, 1 << BITS)
    place = {name: i for i, name in enumerate(names)}
    w, b = fitted(x, code[[place[s] for s in spoken]].astype(np.float32))
    return Codebook(names, code, w, b)


def predict(df: DataFrame, book: Codebook, id_col: str = "doc_id", text_col: str = "text", sure: float = 0.6) -> DataFrame:
    """For each row: id, lang_pred, score, ambiguous (the best language has less than ``sure`` of the weight)."""
    names, code, weights, bias = book.languages, book.code, book.weights, book.bias

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            best, score, ambiguous = np.full(n, -1), np.zeros(n), np.zeros(n, bool)
            if names:
                for first, last, counts in gram_counts(b.column(2), SIZES, BITS):
                    margin = scaled(counts) @ weights + bias
                    loss = np.logaddexp(0, -margin) @ (code > 0).T + np.logaddexp(0, margin) @ (code < 0).T
                    share = np.exp(loss.min(1, keepdims=True) - loss)
                    best[first:last] = loss.argmin(1)
                    score[first:last] = 1 / share.sum(1)
            letters = np.asarray(b.column(1).to_numpy(zero_copy_only=False), bool)
            best[~letters], score[~letters] = -1, 0
            ambiguous = (best >= 0) & (score < sure)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(["und" if i < 0 else names[i] for i in best], pa.string()), pa.array(score), pa.array(ambiguous)],
                names=["id", "lang_pred", "score", "ambiguous"],
            )
        give_back()

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), text_of(text_col).rlike(r"\p{L}").alias("letters"), framed(text_col).alias("raw"))
    return rows.mapInArrow(decode, f"id {kind}, lang_pred string, score double, ambiguous boolean").withColumnRenamed("id", id_col)


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = predict(docs, learn(docs))
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))  # rows without an id are in neither part
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")
