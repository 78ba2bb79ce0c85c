"""Archives as one Python data source: entries and documents from one opening of each archive.

``spark.read.format("library_archives").schema(...).load(root)``: partitions are planned from the listing, by what has to be
read (an archive's directory and, where asked for, its document), not by the archives' own sizes. Only columns named in the
schema are made: without ``xml`` no document is read, and with neither ``entry`` nor ``ord`` an archive is one row, found by its
directory alone. Filters on ``path`` drop archives before they are planned, those on ``entry`` before rows are made. An archive
that cannot be opened is one row with ok false. The suffix counts in any case.
"""

from __future__ import annotations

import zipfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import names as N
from .stores import Stores

SCHEMA = "path string, archive_size long, entry string, size long, compress_type int, ord int, ok boolean, document string, xml string"
DOCUMENT = "comicinfo.xml"
#: What a damaged, truncated, encrypted or oddly packed archive raises.
BAD_ARCHIVE = (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError, zlib.error, EOFError, ValueError, UnicodeDecodeError)
#: Bytes read of an archive, about: its directory, and a document where one is asked for.
DIRECTORY_BYTES, DOCUMENT_BYTES = 64 << 10, 16 << 10


def document_of(names: list[str]) -> str | None:
    """The first name in archive order that is the document's in any case; of names that differ only in case the last."""
    real = {n.lower(): n for n in names}
    return next((real[k] for k in real if k.rpartition("/")[2] == DOCUMENT), None)


@dataclass
class Share(InputPartition):
    """Archives that one task reads."""

    archives: list[tuple[str, int]]


def test_of(f: Filter):
    """A check of one value, or None where the filter is of another kind."""
    if isinstance(f, EqualTo):
        return lambda x: x == f.value
    if isinstance(f, In):
        return lambda x: x in f.value
    if isinstance(f, StringStartsWith):
        return lambda x: x is not None and x.startswith(f.value)
    if isinstance(f, StringEndsWith):
        return lambda x: x is not None and x.endswith(f.value)
    return None


class ArchiveReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.root = schema, options["path"]
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.suffix = options.get("suffix", ".cbz").lower()
        self.share = int(options.get("partitionbytes", 16 << 20))
        self.of_path: list[Filter] = []
        self.of_entry: list[Filter] = []
        self.wanted = set(schema.names)
        self.one_row = not self.wanted & {"entry", "size", "compress_type", "ord"}

    def partitions(self) -> list[Share]:
        tests = [test_of(f) for f in self.of_path]
        found = sorted((p, n) for p, n, _ in Stores().files(self.root, self.recursive) if p.lower().endswith(self.suffix) and all(t(p) for t in tests))
        cost = DIRECTORY_BYTES + (DOCUMENT_BYTES if "xml" in self.wanted else 0)
        shares, held = [Share([])], 0
        for p, n in found:
            if held >= self.share:
                shares.append(Share([]))
                held = 0
            shares[-1].archives.append((p, n))
            held += min(n, cost)
        return shares

    def rows(self, stores: Stores, path: str, size: int, tests: list) -> list[dict]:
        nothing = {"path": path, "archive_size": size, "entry": None, "size": None, "compress_type": None, "ord": None, "document": None, "xml": None}
        try:
            with stores.open(path) as f, zipfile.ZipFile(f) as z:
                infos = z.infolist()
                name = document_of([i.filename for i in infos]) if self.wanted & {"document", "xml"} else None
                xml = z.read(name).decode("utf-8", errors="replace") if name and "xml" in self.wanted else None
        except BAD_ARCHIVE:
            return [nothing | {"ok": False}] if all(t(None) for t in tests) else []
        if self.one_row:
            return [nothing | {"ok": True, "document": name, "xml": xml}]
        out, last = [], max((n for n, i in enumerate(infos) if i.filename == name), default=-1)
        for n, i in enumerate(infos):
            if all(t(i.filename) for t in tests):
                here = n == last
                out.append({"path": path, "archive_size": size, "entry": i.filename, "size": i.file_size, "compress_type": i.compress_type, "ord": n, "ok": True, "document": name, "xml": xml if here else None})
        return out

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        stores, tests = Stores(), [test_of(f) for f in self.of_entry]
        kind = to_arrow_schema(self.schema)
        held: list[dict] = []
        for path, size in partition.archives:
            held += self.rows(stores, path, size, tests)
            if len(held) >= 4096:
                yield pa.RecordBatch.from_pylist(held, kind)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, kind)


class FilteringReader(ArchiveReader):
    """For sessions in which ``spark.sql.python.filterPushdown.enabled`` is set; Spark refuses it in others."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("path",) and test_of(f):
                self.of_path.append(f)
            elif getattr(f, "attribute", None) == ("entry",) and test_of(f) and not self.one_row:
                self.of_entry.append(f)
            else:
                yield f


class LibraryArchives(DataSource):
    @classmethod
    def name(cls) -> str:
        return "library_archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ArchiveReader:
        return (FilteringReader if self.options.get("pushdown") == "true" else ArchiveReader)(schema, self.options)


def archives(spark: SparkSession, root: str, columns: str = SCHEMA, recursive: bool = True) -> DataFrame:
    """Rows of the source with the columns named, as ``name kind, ...``."""
    spark.dataSource.register(LibraryArchives)
    reader = spark.read.format("library_archives").schema(columns).option("recursive", str(recursive).lower())
    return reader.option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).load(root)


def entries(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(path, entry, size, compress_type, ord, ok, ext): what archives list."""
    found = archives(spark, root, "path string, entry string, size long, compress_type int, ord int, ok boolean", recursive)
    return found.withColumn("ext", F.lower(N.suffix(F.substring_index("entry", "/", -1))))


def metadata(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(path, entry_name, xml, ok): each archive's document, whatever the case of its name; null without one. Bad bytes are replaced."""
    return archives(spark, root, "path string, document string, xml string, ok boolean", recursive).withColumnRenamed("document", "entry_name")


def contents(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """Entries with the archive's document (its text on its own entry): one pass for both."""
    found = archives(spark, root, recursive=recursive)
    return found.withColumn("ext", F.lower(N.suffix(F.substring_index("entry", "/", -1))))
