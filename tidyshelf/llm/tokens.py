"""Token counts and token ids by public tokenizers, in Arrow batches.

Only lengths (or digests of ids) leave the Python workers. Inside a worker, texts are encoded in batches of about
``batch_bytes`` of UTF-8; a text over ``piece_bytes`` characters goes as several pieces, cut where the tokenizer itself always
cuts: before a single space or line end between two visible characters, and after a full-width stop or comma before a kana
or ideograph. No alternative of the byte-level pattern runs from a visible character into white space or from such a mark
into a letter, and no special string holds a space, a line end or such a mark, so the pieces' ids are the text's ids. A long
text without such a place stays whole.

Null and empty texts have 0 tokens. Repeated rows are counted each. Further columns of the input are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, give_back, text_of

VOCABULARY = "byte_bpe_50k.json"
IDEOGRAPHS = "\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff"
SAFE = re.compile(rf"[!-~\u00c0-\u024f\u0370-\u03ff\u0400-\u04ff{IDEOGRAPHS}](?=[ \n][!-~\u00c0-\u024f\u0370-\u03ff\u0400-\u04ff{IDEOGRAPHS}])|[。、！？，；：](?=[{IDEOGRAPHS}])")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(text: str, most: int) -> list[str]:
    """The text cut at safe places, each piece at least ``most`` characters unless the text ends."""
    if len(text) <= most:
        return [text]
    out, start = [], 0
    while len(text) - start > most and (m := SAFE.search(text, start + most - 1)):
        out.append(text[start : m.end()])
        start = m.end()
    out.append(text[start:])
    return out


def load(path: str | None, name: str):
    """A function from texts to token counts; the path is looked up on the worker unless given."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is the only one it owns
    path = path or vocabulary_path(name)
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]


def lengths(texts: Iterator[str], count, batch_bytes: int, piece_bytes: int) -> list[int]:
    """Token counts of texts, encoded in batches of about batch_bytes."""
    out: list[int] = []
    batch: list[str] = []
    owner: list[int] = []
    held = 0

    def flush() -> None:
        for i, n in zip(owner, count(batch), strict=True):
            out[i] += n
        batch.clear()
        owner.clear()

    for text in texts:
        out.append(0)
        for piece in pieces(text, piece_bytes) if text else ():
            size = len(piece.encode())
            if batch and held + size > batch_bytes:
                flush()
                held = 0
            batch.append(piece)
            owner.append(len(out) - 1)
            held += size
    if batch:
        flush()
    return out


def count_tokens(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 1024,
    vocabulary: str = VOCABULARY,
    path: str | None = None,
    batch_bytes: int = 1 << 20,
    piece_bytes: int = 1 << 16,
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row; one narrow pass without a shuffle.

    A sentencepiece model joins words differently at cut places, so its texts are never cut.
    """
    piece = piece_bytes if vocabulary.endswith(".json") else 1 << 62

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = load(path, vocabulary)
        for b in batches:
            texts = (x.as_py() for x in b.column(2))
            n = lengths(texts, count, batch_bytes, piece)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])
        give_back()

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.octet_length(text_of(text_col)).cast("long").alias("n_bytes"), text_of(text_col).alias("text"))
    counted = rows.mapInArrow(encode, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))
