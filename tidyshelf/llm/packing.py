"""Packing documents into sequences by cutting-stock column generation.

A document is its token ids and one end id. It is cut into pieces of ``capacity`` ids and a rest; full pieces are sequences
of their own. The rests' lengths, in classes of ``unit`` ids, make a histogram of at most capacity / unit numbers, which is
all that the driver sees of the corpus. A linear program over patterns (how many rests of each class share a sequence)
covers the histogram with the fewest sequences: a knapsack by dynamic programming prices new patterns from the dual values
until none helps. Pattern counts are rounded down, and the few rests that leaves are packed first-fit by falling length.
Rests are ranked inside their class (dealt to buckets by a hash of the id, numbered there, shifted by the buckets before),
and a rank falls to one pattern, instance and place by comparison with a table of bounded size.

Ids are those of the byte-level vocabulary. Texts whose characters all lie below U+0250 and whose words are shorter than 1,000 are encoded from its
rank file, other texts by the vocabulary's own library; both give the same ids. Long texts are encoded in pieces cut where the
tokenizer always cuts. Token ids never leave the worker; a piece keeps its checksum.

Null and empty texts are one piece with only the end id. Repeated rows are packed each. An empty table gives no rows.
Further columns are ignored.
"""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, documents, give_back, text_of
from .tokens import VOCABULARY, pieces, vocabulary_path

END_ID = 1


def special_strings(path: str) -> dict[str, int]:
    """The strings that the vocabulary file names as tokens of their own."""
    with open(path, encoding="utf-8") as f:
        return {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}


def encoder(path: str | None = None, special: dict[str, int] | None = None):
    """A function from a text to its ids; path: the .json file, with its ranks beside it as .tiktoken.

    The library is loaded only for a text that needs it.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = path or vocabulary_path(VOCABULARY)
    with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    special = special_strings(path) if special is None else special
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    beyond, library = re.compile("[^\x00-ɏ]|\\S{1000}|\\s{1000}"), []  # on long runs the fast way takes quadratic time

    def ids(text: str) -> np.ndarray:
        if beyond.search(text):
            if not library:
                library.append(Tokenizer.from_file(path))
            return np.array(library[0].encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(fast.encode(text, allowed_special="all"), np.uint32)

    return ids


def cut_up(parts: Iterator[np.ndarray], capacity: int) -> tuple[list[int], list[int]]:
    """(lengths, checksums) of the pieces of a document given as runs of ids."""
    lengths, sums, held, crc = [], [], 0, 0
    for ids in parts:
        at = 0
        while at < len(ids):
            take = ids[at : at + capacity - held]
            crc, held, at = zlib.crc32(take.astype("<u4").tobytes(), crc), held + len(take), at + len(take)
            if held == capacity:
                lengths.append(held)
                sums.append(crc)
                held = crc = 0
    if held:
        lengths.append(held)
        sums.append(crc)
    return lengths, sums


def token_pieces(df: DataFrame, capacity: int, id_col: str, text_col: str, path: str | None, piece_bytes: int = 1 << 16) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens), one row a piece."""

    special = special_strings(path or vocabulary_path(VOCABULARY))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path, special), np.array([END_ID], np.uint32)

        def runs(text: str) -> Iterator[np.ndarray]:
            for piece in pieces(text, piece_bytes) if text else ():
                yield encode(piece)
            yield end

        for b in batches:
            rows = [cut_up(runs(x.as_py()), capacity) for x in b.column(1)]
            owner = np.repeat(np.arange(len(rows)), [len(n) for n, _ in rows])
            lengths = np.array([x for n, _ in rows for x in n], np.int64)
            starts = np.array([i * capacity for n, _ in rows for i in range(len(n))], np.int64)
            total = np.array([sum(n) for n, _ in rows], np.int64)[owner] if rows else np.zeros(0, np.int64)
            sums = np.array([c for _, s in rows for c in s], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner, pa.int64())), pa.array(starts), pa.array(lengths), pa.array(sums), pa.array(total)], names=["id", "start", "length", "ids_crc32", "doc_tokens"])
        give_back()

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


# ---- the cutting-stock program, on numbers of bounded count


def best_pattern(sizes: np.ndarray, values: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack: the pattern of most value that fits."""
    best, choice = np.zeros(room + 1), np.full(room + 1, -1)
    for w in range(1, room + 1):
        fits = sizes <= w
        got = np.where(fits, best[np.maximum(w - sizes, 0)] + values, -1.0)
        k = int(got.argmax())
        best[w], choice[w] = (got[k], k) if got[k] > best[w - 1] else (best[w - 1], -2)
    pattern, w = np.zeros(len(sizes), np.int64), room
    while w > 0 and choice[w] != -1:
        if choice[w] == -2:
            w -= 1
        else:
            pattern[choice[w]] += 1
            w -= sizes[choice[w]]
    return float(best[room]), pattern


def inverted(a: np.ndarray) -> np.ndarray:
    """The inverse by Gauss-Jordan steps. (Threaded LAPACK can hang in a process that has forked, as Spark's driver has.)"""
    n = len(a)
    both = np.hstack([a, np.eye(n)])
    for i in range(n):
        p = i + int(np.abs(both[i:, i]).argmax())
        both[[i, p]] = both[[p, i]]
        both[i] /= both[i, i]
        factors = both[:, i].copy()
        factors[i] = 0
        both -= np.outer(factors, both[i])
    return both[:, n:]


def cover(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = 5e-4, rounds: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, real counts) of least total that cover demand, by revised simplex with priced columns.

    Stops when no pattern has a reduced cost below zero, or the total is within ``gap`` of a bound: the sizes' sum over the
    room, or what the dual values and the best pattern's value give.
    """
    m = len(sizes)
    columns = np.diag(room // sizes).astype(float)  # of the basis; a surplus column is minus a unit vector
    cost = np.ones(m)
    inverse = np.diag(1 / np.diag(columns))
    x = inverse @ demand
    for step in range(rounds):
        dual = cost @ inverse
        if dual.min() < -1e-9:
            entering, price = -np.eye(m)[int(dual.argmin())], 0.0
        else:
            value, pattern = best_pattern(sizes, dual, room)
            bound = max(dual @ demand / value, sizes @ demand / room)
            if value <= 1 + 1e-9 or bound >= x @ cost * (1 - gap):
                break
            entering, price = pattern.astype(float), 1.0
        direction = inverse @ entering
        up = direction > 1e-9
        ratio = np.where(up, np.maximum(x, 0) / np.where(up, direction, 1), np.inf)
        out = int(ratio.argmin())
        x = x - ratio[out] * direction
        x[out] = ratio[out]
        columns[:, out], cost[out] = entering, price
        row = inverse[out] / direction[out]
        inverse -= np.outer(direction, row)
        inverse[out] = row
        if step % 200 == 199:  # against rounding errors
            inverse = inverted(columns)
            x = inverse @ demand
    real = cost > 0
    return columns[:, real].T.round().astype(np.int64), np.maximum(x[real], 0)


def plan(histogram: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """(pattern, count) that together hold exactly the histogram's rests, class -> number; sizes are the classes."""
    sizes = np.array(sorted(histogram), np.int64)
    if not len(sizes):
        return []
    left = np.array([histogram[s] for s in sizes], np.int64)
    out: list[tuple[dict[int, int], int]] = []
    patterns, counts = cover(sizes, left.astype(float), room)
    for pattern, n in zip(patterns, np.floor(counts + 1e-9).astype(np.int64), strict=True):
        used = pattern > 0
        n = min(int(n), int((left[used] // pattern[used]).min()) if used.any() else 0)
        if n > 0:
            out.append(({int(s): int(a) for s, a in zip(sizes[used], pattern[used], strict=True)}, n))
            left = left - n * pattern
    while left.any():  # first fit by falling length; a pattern that fits several times over is used so often
        free, pattern = room, np.zeros(len(sizes), np.int64)
        for i in range(len(sizes) - 1, -1, -1):
            pattern[i] = min(int(left[i]), free // int(sizes[i]))
            free -= pattern[i] * sizes[i]
        used = pattern > 0
        n = int((left[used] // pattern[used]).min())
        out.append(({int(s): int(a) for s, a in zip(sizes[used], pattern[used], strict=True)}, n))
        left = left - n * pattern
    return out


def places(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(class, from rank, to rank, first sequence, rests of the class in each of the pattern's sequences)."""
    out, ranks, sequence = [], {}, 0
    for pattern, n in patterns:
        for size, each in pattern.items():
            start = ranks.get(size, 0)
            out.append((size, start, start + n * each, sequence, each))
            ranks[size] = start + n * each
        sequence += n
    return out


def pack(df: DataFrame, capacity: int = 2048, unit: int = 8, buckets: int = 1024, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """For each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = df.sparkSession
    rows = cut(token_pieces(df, capacity, id_col, text_col, path)).withColumn("class", F.ceil(F.col("length") / unit).cast("int"))
    rests = rows.where(F.col("length") < capacity)
    histogram = {r["class"]: r["count"] for r in rests.groupBy("class").count().collect()}  # at most capacity / unit rows
    patterns = plan(histogram, capacity // unit)
    n_sequences = sum(n for _, n in patterns)
    table = spark.createDataFrame(places(patterns), "class int, low long, high long, first long, each long")

    rests = rests.withColumn("bucket", F.pmod(F.xxhash64("id", "start"), F.lit(buckets)).cast("int"))
    nth = F.row_number().over(W.partitionBy("class", "bucket").orderBy("id", "start", "ids_crc32"))
    counts = rests.groupBy("class", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("class").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = rests.withColumn("nth", nth).join(counts.select("class", "bucket", before.alias("before")), ["class", "bucket"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("nth") - 1)
    # a few rows for each pattern and class, bounded by capacity / unit: small enough to send to every task
    placed = ranked.join(F.broadcast(table), (ranked["class"] == table["class"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))).drop(table["class"])
    placed = placed.withColumn("sequence_id", F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("each")))
    in_sequence = W.partitionBy("sequence_id").orderBy(F.desc("length"), "id", "start", "rank").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(in_sequence), F.lit(0)))
    full = rows.where(F.col("length") == capacity).withColumns({"sequence_id": F.monotonically_increasing_id() + n_sequences, "offset": F.lit(0).cast("long")})
    names = [F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return full.select(*names).unionByName(placed.select(*names))


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
