"""What happens under a watched root, as a stream: a Python data source whose offsets are numbers of listings.

``events.found(spark, root, state)`` gives (event_type, path, dest_path, event_time, dir_ctime, size). Each trigger lists the root
once and compares with the listing before: files that are new are ``created``, those of another size or time ``modified``, those
gone ``deleted``, and one gone with another new of equal size and time is ``moved`` to dest_path (of several such, in the order of
their paths). Nothing is known before the first listing, so what is there at the start comes first. With ``samples`` set to n,
files that have just come or changed are told again, as ``polled`` with their size, in each of the next n listings.

The driver's worker looks for the directories of the upper levels only, deals them out in groups and notes them in the state
folder; tasks list the files of their group and compare them with what the group held before. A group's listing is a Parquet
file in the folder of its number: a batch that is repeated reads what it listed first, and a restart goes on where it was. Whether
anything has changed is known to the tasks only, so every trigger is a batch; leave some time between triggers. The source
(``library_events``) tells a move as ``deleted`` and ``created``: the two may lie in different groups, and are brought together by
a shuffle by size and time. A directory that comes while a listing is under way may come with the next one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from .stores import Stores

SCHEMA = "event_type string, path string, dest_path string, event_time timestamp, dir_ctime timestamp, size long"
LISTED = ["path", "size", "mtime", "left"]
CHANGES = pa.schema([("event_type", pa.string()), ("path", pa.string()), ("dest_path", pa.string()), ("mtime", pa.int64()), ("size", pa.int64())])


def paired(gone: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
    """(path, dest_path, size, mtime): files gone and new with equal size and time, one to one in the order of paths."""
    sides = []
    for x in (gone, new):
        x = x.sort_values("path")
        sides.append(x.assign(nth=x.groupby(["size", "mtime"]).cumcount()))
    return sides[0].merge(sides[1], on=["size", "mtime", "nth"], suffixes=("", "_new")).rename(columns={"path_new": "dest_path"})[["path", "dest_path", "size", "mtime"]]


def differences(before: pd.DataFrame, now: pd.DataFrame) -> pd.DataFrame:
    """The rows between two listings, moves as deleted and created, sorted by path within each kind; before and now: (path, size, mtime, left)."""
    both = before.merge(now, on="path", how="outer", suffixes=("_was", ""), indicator="side")
    gone = both[both["side"] == "left_only"][["path", "size_was", "mtime_was"]].set_axis(["path", "size", "mtime"], axis=1)
    new = both[both["side"] == "right_only"][["path", "size", "mtime"]]
    same = both[both["side"] == "both"]
    edited = same[(same["size"] != same["size_was"]) | (same["mtime"] != same["mtime_was"])]
    polled = same[(same["left_was"] > 0)]
    return told(("created", new), ("modified", edited), ("deleted", gone), ("polled", polled))


def told(*found: tuple[str, pd.DataFrame]) -> pd.DataFrame:
    rows = [x.assign(event_type=kind, dest_path=x["dest_path"] if "dest_path" in x else None).sort_values("path")[CHANGES.names] for kind, x in found if len(x)]
    return pd.concat(rows) if rows else pd.DataFrame(columns=CHANGES.names)


def with_moves(rows: pd.DataFrame) -> pd.DataFrame:
    """Differences with what is deleted and created brought together as moved."""
    of = {kind: rows[rows["event_type"] == kind] for kind in ("created", "modified", "deleted", "polled")}
    moves = paired(*(of[kind][["path", "size", "mtime"]] for kind in ("deleted", "created")))
    new, gone = of["created"][~of["created"]["path"].isin(moves["path" if moves.empty else "dest_path"])], of["deleted"][~of["deleted"]["path"].isin(moves["path"])]
    return told(("created", new), ("modified", of["modified"]), ("moved", moves), ("deleted", gone), ("polled", of["polled"]))


def changes(before: pd.DataFrame, now: pd.DataFrame) -> pd.DataFrame:
    """What the stream tells between two listings, in one table."""
    return with_moves(differences(before, now))


def left(before: pd.DataFrame, now: pd.DataFrame, samples: int) -> pd.Series:
    """How often each file is still to be sampled; one that has changed is sampled anew."""
    known = now[LISTED[:3]].merge(before, on=LISTED[:3], how="left")["left"]
    return (known - 1).clip(lower=0).fillna(samples).astype("int64")


#: Directories are opened by the driver's worker until there are so many; also the number of groups up to which each new directory gets its own.
WIDE = 64
#: Directories of a group, once there are WIDE groups.
OF_GROUP = 16

Groups = dict[str, list[tuple[str, bool]]]  # directories by group, and whether what lies below belongs to them


def walked(stores: Stores, root: str, known: dict[str, bool]) -> dict[str, bool]:
    """The directories of the upper levels: True for those listed with all below them, False for those of which the next level was opened."""
    out: dict[str, bool] = {}
    level = [root]
    while level:
        wide = len(out) + len(level) >= WIDE
        opened = [d for d in level if not known.get(d, wide and d != root)]
        out.update(dict.fromkeys(level, True))
        out.update(dict.fromkeys(opened, False))
        level = sorted(x for d in opened for x in stores.dirs(d))
    return out


def dealt(found: dict[str, bool], before: Groups) -> Groups:
    """found in groups: a directory stays in its group; groups that have just lost their last one are kept, to tell what is gone."""
    out: Groups = {g: [(d, found[d]) for d, _ in held if d in found] for g, held in before.items() if held}
    known = {d for held in out.values() for d, _ in held}
    new = [d for d in found if d not in known]
    most = min(len(found), max(WIDE, len(found) // OF_GROUP))
    number = max(map(int, before), default=-1)
    by_size = sorted(out, key=lambda g: (len(out[g]), int(g)))
    fresh = [str(number + 1 + i) for i in range(max(0, min(len(new), most - len(out))))]
    places = fresh or by_size
    for i, d in enumerate(new):
        out.setdefault(places[i % len(places)], []).append((d, found[d]))
    return out


@dataclass
class Group(InputPartition):
    """Directories that one task lists, and where their files stand in the listing before and in this one."""

    held: list[tuple[str, bool]]
    before: str | None
    now: str


class EventReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.state = options["path"], options["state"].rstrip("/")
        self.suffix, self.samples = options.get("suffix", ".cbz").lower(), int(options.get("samples", 0))

    def folder(self, n: int) -> str:
        return f"{self.state}/listing-{n:012d}"

    def listings(self, stores: Stores) -> list[int]:
        names = (d.rpartition("/")[2] for d in stores.dirs(self.state))
        return sorted(int(x.removeprefix("listing-")) for x in names if x.startswith("listing-"))

    def groups(self, stores: Stores, n: int) -> Groups:
        with stores.open(f"{self.folder(n)}/groups.json") as f:
            return json.loads(f.read())

    def in_one_step(self, stores: Stores, path: str, write: Callable) -> None:
        """Under another name first."""
        store, at = stores.at(path)
        store.create_dir(at.rpartition("/")[0], recursive=True)
        part = f"{at}.{uuid.uuid4().hex}.part"
        with store.open_output_stream(part) as f:
            write(f)
        store.move(part, at)

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        return {"listing": max(self.listings(Stores()), default=0) + 1}

    def partitions(self, start: dict, end: dict) -> list[Group]:
        stores, first, last = Stores(), start["listing"], end["listing"]
        before = self.groups(stores, first) if first else {}
        if not stores.exists(f"{self.folder(last)}/groups.json"):  # else the batch is repeated
            found = walked(stores, self.root, {d: deep for held in before.values() for d, deep in held})
            text = json.dumps(dealt(found, before)).encode()
            self.in_one_step(stores, f"{self.folder(last)}/groups.json", lambda f: f.write(text))
        at = lambda n, g: f"{self.folder(n)}/{g}.parquet"
        return [Group(held, at(first, g) if g in before else None, at(last, g)) for g, held in self.groups(stores, last).items()]

    def listed(self, stores: Stores, path: str | None) -> pd.DataFrame:
        if path is None:
            return self.table([])
        with stores.open(path) as f:
            return pq.read_table(f).to_pandas()

    def table(self, rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=LISTED).astype({"path": "str", "size": "int64", "mtime": "int64", "left": "int64"})

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        stores = Stores()
        before = self.listed(stores, partition.before)
        if not stores.exists(partition.now):  # else a task is repeated
            now = self.table([(*x, 0) for d, deep in partition.held for x in stores.files(d, recursive=deep) if x[0].lower().endswith(self.suffix)])
            now["left"] = left(before, now, self.samples).to_numpy()
            self.in_one_step(stores, partition.now, lambda f: pq.write_table(pa.Table.from_pandas(now, preserve_index=False), f))
        t = pa.Table.from_pandas(differences(before, self.listed(stores, partition.now)), CHANGES, preserve_index=False)
        yield from as_events(t, "UTC")

    def commit(self, end: dict) -> None:
        """What lies before is not asked for again; the last listing stays."""
        stores = Stores()
        for n in self.listings(stores):
            if n < end["listing"]:
                stores.remove_dir(self.folder(n))


def as_events(t: pa.Table, zone: str) -> list[pa.RecordBatch]:
    """Rows of CHANGES as the stream has them."""
    time = t.column("mtime").cast(pa.timestamp("us", zone))
    return pa.table([t.column("event_type"), t.column("path"), t.column("dest_path"), time, time, t.column("size")], names=["event_type", "path", "dest_path", "event_time", "dir_ctime", "size"]).combine_chunks().to_batches()


class LibraryEvents(DataSource):
    @classmethod
    def name(cls) -> str:
        return "library_events"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> EventReader:
        return EventReader(self.options)


def at_root(path: Column, root: str) -> Column:
    """Dropped beside the directories instead of into one; such files are processed all the same."""
    plain = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    return F.ltrim(F.regexp_replace(F.regexp_replace(path, "^[a-z0-9+.-]+:", ""), r"/[^/]*$", ""), F.lit("/")) == plain


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Moves among rows that hold all files of their sizes and times; only what is created or deleted waits for the end."""
    sides: dict[str, list[pa.RecordBatch]] = {"created": [], "deleted": []}
    for b in batches:
        kind = b.column("event_type")
        yield b.filter(pc.invert(pc.is_in(kind, pa.array(list(sides)))))
        for k, held in sides.items():
            held.append(b.filter(pc.equal(kind, k)))
    if not all(any(len(b) for b in held) for held in sides.values()):
        yield from (b for held in sides.values() for b in held)
        return
    t = pa.Table.from_batches([b for held in sides.values() for b in held])
    rows = t.append_column("mtime", t.column("event_time").cast(pa.int64())).select(CHANGES.names).to_pandas()
    yield from as_events(pa.Table.from_pandas(with_moves(rows), CHANGES, preserve_index=False), t.schema.field("event_time").type.tz)


def found(spark: SparkSession, root: str, state: str, samples: int = 0, tasks: int | None = None) -> DataFrame:
    """The stream of differences; moves are found by so many tasks, each of which holds its share of a listing's new and gone files."""
    spark.dataSource.register(LibraryEvents)
    rows = spark.readStream.format("library_events").option("state", state).option("samples", samples).load(root)
    keys = [F.col("size"), F.col("event_time")]
    return (rows.repartition(tasks, *keys) if tasks else rows.repartition(*keys)).mapInArrow(met, SCHEMA)


def events(spark: SparkSession, root: str, state: str, samples: int = 0, tasks: int | None = None) -> DataFrame:
    """The stream with where each event counts: (event_type, path, event_time, dir_ctime, size, dir_path, at_root).

    A move counts as a deletion where the file was and as ``moved`` where it is; a file's time stands for its directory's,
    which listings of stores do not tell.
    """
    here = F.struct("event_type", F.when(F.col("event_type") == "moved", F.col("dest_path")).otherwise(F.col("path")).alias("path"))
    left = F.struct(F.lit("deleted").alias("event_type"), "path")
    each = F.explode(F.when(F.col("event_type") == "moved", F.array(left, here)).otherwise(F.array(here))).alias("e")
    rows = found(spark, root, state, samples, tasks).select(each, "event_time", "dir_ctime", "size").select("e.event_type", "e.path", "event_time", "dir_ctime", "size")
    return rows.withColumns({"dir_path": F.regexp_replace("path", r"/[^/]*$", ""), "at_root": at_root(F.col("path"), root)})
