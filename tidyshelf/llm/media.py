"""Media columns: payloads live content-addressed in tar shards, rows carry digest, shard, offset and length.

A text's bytes, padded with 0 to a positive multiple of 64, are stored losslessly as an 8-bit grey PNG of width 64. Each
writing task fills tar shards of its own under one folder and puts every distinct payload into a shard once, under the
name ``<sha256>.png``; its rows point there. A task that is run again writes new files, and only the rows of the attempt
that succeeded are ever read, so a lost executor costs nothing but the work. Metadata columns come from range reads of
the first 33 bytes of a member, without its body.

Null texts are empty: 64 zero bytes. Repeated rows share a payload. Further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import os
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, give_back, new_dir, table_at, text_of

WIDTH = 64
#: PNG's signature, and the length of signature and first chunk together.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33


def png_chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes, level: int) -> bytes:
    """payload as grey samples, WIDTH in a row."""
    height = len(payload) // WIDTH
    rows = np.zeros((height, WIDTH + 1), np.uint8)  # each row begins with filter 0
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)
    return SIGNATURE + png_chunk(b"IHDR", head) + png_chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + png_chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height, bits a sample, from the first HEADER_BYTES."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR" or struct.unpack(">I", head[29:33])[0] != zlib.crc32(head[12:29]):
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", head[16:25])


def from_png(data: bytes) -> np.ndarray:
    """The samples; every chunk's checksum is verified."""
    width, height, _ = png_header(data[:HEADER_BYTES])
    at, body = 8, []
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        if zlib.crc32(data[at + 4 : at + 8 + n]) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged PNG chunk")
        if kind == b"IDAT":
            body.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    return np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)[:, 1:].ravel()


def features(samples: np.ndarray) -> str:
    """Whole-number features of samples, so that they are the same everywhere."""
    seen = np.bincount(samples, minlength=256)
    steps = int(np.abs(np.diff(samples.astype(np.int32))).sum())
    return f"n={samples.size};sum={int(samples.sum(dtype=np.int64))};distinct={int((seen > 0).sum())};mode={int(seen.argmax())};zeros={int(seen[0])};high={int(seen[128:].sum())};steps={steps}"


class Shards:
    """One task's tar shards; each distinct payload goes into a shard once."""

    def __init__(self, folder: str, shard_bytes: int, level: int):
        self.store, self.root = pafs.FileSystem.from_uri(folder)
        self.limit, self.level = shard_bytes, level
        self.out = None

    def put(self, payload: bytes) -> tuple[str, int, int, bytes]:
        if self.out is not None and self.at >= self.limit:
            self.close()
        if self.out is None:
            self.name, self.at, self.known = f"shard-{uuid.uuid4().hex}.tar", 0, {}
            self.out = self.store.open_output_stream(f"{self.root}/{self.name}")
        key = hashlib.sha256(payload).digest()
        if key not in self.known:
            data = to_png(payload, self.level)
            digest = hashlib.sha256(data)
            member = tarfile.TarInfo(f"{digest.hexdigest()}.png")
            member.size = len(data)
            head = member.tobuf(tarfile.USTAR_FORMAT if len(data) < 8 << 30 else tarfile.GNU_FORMAT)
            self.out.write(head + data + bytes(-len(data) % 512))
            self.known[key] = (self.name, self.at + len(head), len(data), digest.digest())
            self.at += len(head) + len(data) + -len(data) % 512
        return self.known[key]

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.out = None


def write_media(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 256 << 20, level: int = 6) -> DataFrame:
    """Store the payloads of df under ``folder``; the manifest (id, n_bytes, digest, shard, offset, length), kept there too."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(folder, shard_bytes, level)
        for b in batches:
            found, sizes = [], []
            for x in b.column(1):
                raw = x.as_py()
                sizes.append(len(raw))
                found.append(shards.put(raw + bytes(WIDTH - len(raw) if not raw else -len(raw) % WIDTH)))
            names, offsets, sizes_stored, digests = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(names, pa.string()), pa.array(offsets, pa.int64()), pa.array(sizes_stored, pa.int64())],
                names=["id", "n_bytes", "digest", "shard", "offset", "length"],
            )
        shards.close()
        give_back()

    store, root = pafs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), text_of(text_col).cast("binary").alias("raw"))
    manifest = rows.mapInArrow(write, f"id {kind}, n_bytes long, digest binary, shard string, offset long, length long")
    return table_at(manifest, os.path.join(folder, "manifest")).withColumnRenamed("id", id_col)


def extended(df: DataFrame, more: str) -> T.StructType:
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(more).fields])


def range_reader(folder: str):
    """A function (shard, offset, length) -> bytes that keeps the last shard open."""
    store, root = pafs.FileSystem.from_uri(folder)
    held: list = [None, None]

    def read(shard: str, offset: int, length: int) -> bytes:
        if held[0] != shard:
            if held[1] is not None:
                held[1].close()
            held[:] = [shard, store.open_input_file(f"{root}/{shard}")]
        return held[1].read_at(length, offset)

    return read


def with_media_header(manifest: DataFrame, folder: str) -> DataFrame:
    """Adds width, height and bits by reading only the members' first bytes."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, memo, held = range_reader(folder), {}, None
        for b in batches:
            out = []
            for shard, offset in zip(b.column("shard").to_pylist(), b.column("offset").to_pylist(), strict=True):
                if shard != held:
                    memo, held = {}, shard
                if offset not in memo:
                    memo[offset] = png_header(read(shard, offset, HEADER_BYTES))
                out.append(memo[offset])
            columns = [pa.array([x[i] for x in out], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], names=[*b.schema.names, "width", "height", "bits"])

    return manifest.mapInArrow(fill, extended(manifest, "width long, height long, bits long"))


def with_media_features(rows: DataFrame, folder: str) -> DataFrame:
    """Adds payload_bytes, payload_sha256, tail_crc32, media_sha256 and feature from the stored bytes.

    Rows of a shard follow one another, so a member that several rows share is decoded once in a task.
    """
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_sha256", "feature"]

    def look(data: bytes) -> tuple:
        samples = from_png(data)
        raw = samples.tobytes()
        return len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-WIDTH:]), hashlib.sha256(data).hexdigest(), features(samples)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, memo, held = range_reader(folder), {}, None
        for b in batches:
            out = []
            for shard, offset, length, digest in zip(*(b.column(c).to_pylist() for c in ("shard", "offset", "length", "digest")), strict=True):
                if shard != held:
                    memo, held = {}, shard
                if offset not in memo:
                    memo[offset] = look(read(shard, offset, length))
                    if memo[offset][3] != digest.hex():
                        raise ValueError(f"{shard} at {offset} does not hold its digest")
                out.append(memo[offset])
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], names=[*b.schema.names, *names])

    return rows.mapInArrow(fill, extended(rows, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string, feature string"))


def op2_media_columns(spark, sf_dir: str) -> DataFrame:
    folder = new_dir(spark, "media")
    rows = with_media_features(with_media_header(write_media(documents(spark, sf_dir), folder), folder), folder)
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.col("length").alias("media_bytes"), "media_sha256", "feature", "width", "height", "bits", "shard", "offset")
