"""Best-fit packing by sums of squares: whole rests of documents share sequences, as few as can be.

A document is its token ids and one end id; only documents over ``capacity`` ids are cut, into full pieces and a rest. Full
pieces are sequences of their own. Rests are packed by the sum-of-squares rule: each goes where the sum over all residual
gaps of (number of open bins with that gap) squared becomes smallest, a new bin being one of the choices; of equal choices an
open bin before a new one, then the tighter. Rests come in falling length.

Rests are dealt by a hash of their row to buckets of about ``per_bucket``, and each bucket is packed by itself. Bins that are
filled to the last id stay as they are; the rests of all other bins are dealt again, to fewer buckets, until one bucket holds
what is left. About a tenth goes on each time, so the work is little more than that of the first round, a task holds one
bucket of narrow rows, and only the very last bins can have gaps. Every round is written to the checkpoint folder.

Ids are those of the vocabulary's own library. It drops white space and never joins across words, so ids of words are looked
up once a worker and kept (a bounded number of them); texts with characters from U+0250 on, with control characters whose
class differs between libraries or with special strings go through the library whole. Long texts are encoded in pieces that
end where a word must end. Token ids never leave the worker; a piece keeps its checksum.

Null and empty texts are one piece with only the end id. Repeated rows are packed each. An empty table gives no rows.
Further columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, documents, give_back, text_of
from .packing import cut_up, special_strings
from .tokens import IDEOGRAPHS, vocabulary_path

VOCABULARY = "word_bpe_49k.json"
END_ID = 0
#: Characters that libraries may class or fold in different ways.
BEYOND = re.compile("[^\x00-ɏ]|[\x1c-\x1f\x85\xa0]")
LETTERS = "".join(c for c in map(chr, range(0x250)) if c.isalpha())
NUMBERS = "".join(c for c in map(chr, range(0x250)) if c.isnumeric())
#: The vocabulary's own rule for words of other characters, after texts are lower case.
WORD = re.compile(rf"[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")
#: Where a word always ends: before white space, after a digit, a letter before a mark, and full-width marks before letters.
SAFE = re.compile(rf"(?=[ \t\n\r])|[0-9](?=[ -~])|[a-zA-Z](?=[.,;:!?()])|[。、！？，；：](?=[{IDEOGRAPHS}])")
MOST_WORDS, MOST_LETTERS = 1 << 18, 64


def byte_letters() -> dict[int, str]:
    """The letters in which byte-level vocabularies write bytes: visible ones as they are, the others from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in seen} | {b: chr(0x100 + i) for i, b in enumerate(sorted(set(range(256)) - set(seen)))}


class Words(dict):
    """Ids of words as little-endian bytes, looked up when first asked for; short words are kept."""

    def __init__(self, ids):
        self.ids = ids

    def __missing__(self, word: str) -> bytes:
        found = self.ids(word).tobytes()
        if len(word) <= MOST_LETTERS:
            if len(self) >= MOST_WORDS:
                self.clear()
            self[word] = found
        return found


def pieces(text: str, most: int) -> Iterator[str]:
    """The text cut where words end, each piece at least ``most`` characters unless the text ends."""
    start = 0
    while len(text) - start > most and (m := SAFE.search(text, start + most)):
        yield text[start : m.end()]
        start = m.end()
    yield text[start:]


@lru_cache(maxsize=1)
def encoder(path: str | None = None):
    """A function from a text to its ids; path: the .json file. Kept for the next task of a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    path = path or vocabulary_path(VOCABULARY)
    library, special, letters = Tokenizer.from_file(path), special_strings(path), byte_letters()
    merge = library.model.tokenize

    def word_ids(word: str) -> np.ndarray:
        return np.array([t.id for t in merge(word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(letters))], "<u4")

    words, split = Words(word_ids), WORD.findall

    def ids(text: str) -> np.ndarray:
        if BEYOND.search(text) or any(s in text for s in special):
            return np.array(library.encode(text, add_special_tokens=False).ids, "<u4")
        return np.frombuffer(b"".join(map(words.__getitem__, split(text.lower()))), "<u4")

    return ids


def token_pieces(df: DataFrame, capacity: int, id_col: str, text_col: str, path: str | None, piece_chars: int = 1 << 16) -> DataFrame:
    """(id, piece, start, length, ids_crc32), one row a piece of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path), np.array([END_ID], "<u4")

        def runs(text: str) -> Iterator[np.ndarray]:
            yield from map(encode, pieces(text, piece_chars))
            yield end

        for b in batches:
            rows = [cut_up(runs(x.as_py()), capacity) for x in b.column(1)]
            owner = np.repeat(np.arange(len(rows)), [len(n) for n, _ in rows])
            lengths = np.array([x for n, _ in rows for x in n], np.int64)
            piece = np.array([i for n, _ in rows for i in range(len(n))], np.int32)
            sums = np.array([c for _, s in rows for c in s], np.int64)
            columns = [b.column(0).take(pa.array(owner, pa.int64())), pa.array(piece), pa.array(piece.astype(np.int64) * capacity), pa.array(lengths), pa.array(sums)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "piece", "start", "length", "ids_crc32"])
        give_back()

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each length, offset there, fill of each bin); lengths from 1 to capacity, placed in the order given."""
    having = np.zeros(capacity + 1, np.int64)  # open bins by gap
    opened: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fills: list[int] = []
    for i, s in enumerate(lengths.tolist()):
        left = np.nonzero(having[s:])[0]  # gaps that the choices would leave, the tightest first
        best = -1
        if len(left):
            change = np.where(left > 0, 2 * having[left] + 1, 0) + 1 - 2 * having[left + s]
            k = int(change.argmin())
            if change[k] <= (2 * having[capacity - s] + 1 if s < capacity else 0):
                best = int(left[k])
        if best < 0:
            b, offset, best = len(fills), 0, capacity - s
            fills.append(s)
        else:
            b, offset = opened[best + s].pop(), capacity - best - s
            having[best + s] -= 1
            fills[b] += s
        bins[i], offsets[i] = b, offset
        if best:
            having[best] += 1
            opened[best].append(b)
    return bins, offsets, np.array(fills, np.int64)


def packed_buckets(rests: DataFrame, capacity: int) -> DataFrame:
    """rests, of which each bucket is packed by itself, with bin, offset and gap (of its bin)."""

    def pack_one(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("row", "ascending")])
        bins, offsets, fills = sum_of_squares(table.column("length").to_numpy(), capacity)
        for name, values in (("bin", bins), ("offset", offsets), ("gap", capacity - fills[bins])):
            table = table.append_column(name, pa.array(values, pa.int64()))
        return table

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rests.schema)
    return rests.groupBy("bucket").applyInArrow(pack_one, f"{kinds}, bin long, offset long, gap long")


def pack(df: DataFrame, capacity: int = 2048, per_bucket: int = 4096, most_rounds: int = 8, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """For each piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = cut(token_pieces(df, capacity, id_col, text_col, path).withColumn("row", F.monotonically_increasing_id()))
    full = rows.where(F.col("length") == capacity).withColumns({"sequence_id": F.col("row") * 2, "offset": F.lit(0).cast("long")})
    rests = rows.where(F.col("length") < capacity)
    names = [F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    out = full.select(*names)
    for r in range(most_rounds):
        buckets = -(-rests.count() // per_bucket)
        dealt = rests.withColumn("bucket", F.pmod(F.xxhash64("row", F.lit(r)), F.lit(max(1, buckets))).cast("long"))
        done = cut(packed_buckets(dealt, capacity))
        number = ((F.shiftleft("bucket", 24) + F.col("bin")) * most_rounds + r) * 2 + 1
        last = buckets <= 1 or r == most_rounds - 1
        out = out.unionByName((done if last else done.where("gap = 0")).withColumn("sequence_id", number).select(*names))
        if last:
            break
        rests = done.where("gap > 0").select(*rests.columns)
    return out


def op11_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
