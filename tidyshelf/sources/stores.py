"""Files of any store that pyarrow reaches, by paths as Spark lists them (``/a``, ``file:/a``, ``hdfs://host/a``, ``s3a://bucket/a``)."""

from __future__ import annotations

import io
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs

PATH = re.compile(r"^(?:([a-zA-Z][a-zA-Z0-9+.-]*):(//[^/]*)?)?(/.*)$", re.S)


class Unreachable(ValueError):
    """A path in a store that cannot be reached from here."""


def prefix_of(path: str) -> str:
    """What comes before the path inside its store, as Spark writes it: nothing for plain paths."""
    at = PATH.match(path)
    if at is None:
        raise Unreachable(f"not an absolute path: {path}")
    return f"{at[1]}:{'' if at[1] == 'file' else at[2] or ''}" if at[1] else ""


class Stores:
    """Stores by scheme and authority, each looked up once."""

    def __init__(self):
        self.known: dict[str, tuple[pafs.FileSystem, str]] = {}

    def at(self, path: str) -> tuple[pafs.FileSystem, str]:
        """(store, path inside it)."""
        prefix, rest = prefix_of(path), PATH.match(path)[3]
        if prefix not in self.known:
            if prefix in ("", "file:"):
                self.known[prefix] = pafs.LocalFileSystem(), ""
            else:
                try:
                    self.known[prefix] = pafs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", prefix) + "/")
                except (pa.ArrowException, OSError, ImportError, ValueError) as e:
                    raise Unreachable(f"{prefix} cannot be reached: {e}") from e
        store, root = self.known[prefix]
        return store, root.rstrip("/") + rest

    def open(self, path: str) -> pa.NativeFile | io.BytesIO:
        """For reads of ranges; small files come whole, as readers may look before their start, which only Python's own files allow."""
        store, at = self.at(path)
        f = store.open_input_file(at)
        if f.size() >= 4096:
            return f
        with f:
            return io.BytesIO(f.read())

    def info(self, path: str) -> pafs.FileInfo:
        store, at = self.at(path)
        return store.get_file_info(at)

    def exists(self, path: str) -> bool:
        return self.info(path).type != pafs.FileType.NotFound

    def is_file(self, path: str) -> bool:
        return self.info(path).type == pafs.FileType.File

    def is_dir(self, path: str) -> bool:
        return self.info(path).type == pafs.FileType.Directory

    def make_dir(self, path: str) -> None:
        store, at = self.at(path)
        store.create_dir(at, recursive=True)

    def move(self, src: str, dest: str) -> None:
        """In one step where the store has it; what is at dest gives way."""
        store, a = self.at(src)
        other, b = self.at(dest)
        if store is not other and not store.equals(other):
            raise Unreachable(f"{src} and {dest} are in different stores")
        store.create_dir(b.rpartition("/")[0] or "/", recursive=True)
        store.move(a, b)

    def remove(self, path: str) -> None:
        store, at = self.at(path)
        store.delete_file(at)

    def remove_dir(self, path: str) -> None:
        store, at = self.at(path)
        store.delete_dir(at)

    def dirs(self, root: str) -> Iterator[str]:
        """The directories in a directory; none where it does not exist. On this machine no file is looked at."""
        store, at = self.at(root)
        inside = self.known[prefix_of(root)][1].rstrip("/")
        if isinstance(store, pafs.LocalFileSystem):
            if os.path.isdir(at):
                with os.scandir(at) as found:
                    yield from (prefix_of(root) + x.path for x in found if x.is_dir())
            return
        for i in store.get_file_info(pafs.FileSelector(at, allow_not_found=True)):
            if i.type == pafs.FileType.Directory:
                yield prefix_of(root) + i.path.removeprefix(inside).rstrip("/")

    def files(self, root: str, recursive: bool = True) -> Iterator[tuple[str, int, int]]:
        """(path, size, mtime in microseconds) of the files under a directory; none where it does not exist."""
        store, at = self.at(root)
        inside = self.known[prefix_of(root)][1].rstrip("/")
        for i in store.get_file_info(pafs.FileSelector(at, recursive=recursive, allow_not_found=True)):
            if i.type == pafs.FileType.File:
                yield prefix_of(root) + i.path.removeprefix(inside), i.size, (i.mtime_ns or 0) // 1000
