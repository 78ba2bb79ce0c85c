"""The sink that carries out planned actions: a data source writer that stages in tasks and swaps when all tasks are done.

Tasks do what costs: they read archives and write new ones beside their targets, under names that only their attempt uses
(``*.tmp.cbz``, which the plan for leftovers removes). Nothing of the library changes until all of them have ended. Then jobs
take the tasks' lists in order of kinds: new archives in, deletions, files aside, files into place (so chains and swaps are safe),
packed folders away, directories from the deepest up. A task that is lost or fails while staging leaves the library as it was. A
swap that is cut off can be followed by the same plan again: what is done already is found to be done.

Plans may be of millions of rows: lists are files in the report folder, the driver sees only their names, and each row's outcome
is written there: ``done``, ``already`` (an earlier run did it), ``kept`` (a file as large was there, so only the source went), ``absent``
(neither source nor result is there), ``skipped`` or ``failed`` with the reason. Any store that pyarrow reaches will do; a path in another
raises before anything is changed.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions import patterns as P
from ..session import fixed, shared_folder
from .archives import BAD_ARCHIVE, DOCUMENT
from .stores import Stores, Unreachable

ARCHIVE_ENTRY = re.compile(r"(?is)^(.*?\.cbz)!(.*)$")
PLAN = "op string, src string, dest string, reason string, size long, pages array<struct<archive: string, entry: string, name: string>>"
OUTCOME = "op string, src string, dest string, outcome string, why string"
LINE = "op string, src string, dest string, side string, outcome string, why string, task int, nth long"
OPS = ("rename", "move", "merge_dir", "delete", "rewrite", "pack", "skip", "rebuild")
THREADS = 16
STAGED = "staged.txt"
#: Lines that one task of a swap gets, about; more lines make more tasks.
SHARE = 100_000


# ---- what tasks write


def side_of(path: str, attempt: str) -> str:
    return re.sub(r"(?i)\.cbz$", "", path) + f".{attempt}.tmp.cbz"


def written(stores: Stores, side: str, fill: Callable[[zipfile.ZipFile], None]) -> None:
    """A new archive under a name of its own; gone again if it cannot be finished."""
    store, at = stores.at(side)
    store.create_dir(at.rpartition("/")[0] or "/", recursive=True)
    try:
        with store.open_output_stream(at) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as new:
            fill(new)
    except BaseException:
        if stores.is_file(side):
            stores.remove(side)
        raise


def copied(stores: Stores, path: str, new: zipfile.ZipFile, keep: Callable[[str], bool]) -> None:
    with stores.open(path) as f, zipfile.ZipFile(f) as old:
        for info in old.infolist():
            if keep(info.filename):
                new.writestr(info, old.read(info), compress_type=info.compress_type)


def rewritten(stores: Stores, path: str, entry: str | None, xml: str, side: str) -> None:
    """One entry replaced (or added); the others keep their bytes and compression."""

    def fill(new: zipfile.ZipFile) -> None:
        copied(stores, path, new, lambda name: name != entry)
        new.writestr(entry or "ComicInfo.xml", xml, compress_type=zipfile.ZIP_DEFLATED)

    written(stores, side, fill)


def in_page_order(name: str) -> tuple:
    """Metadata first, then names with their numbers by value."""
    return name.lower() != DOCUMENT, [(0, int(x), "") if x.isdigit() else (1, 0, x.lower()) for x in re.split(r"(\d+)", name)]


def packed(stores: Stores, folder: str, side: str) -> None:
    """A folder's files as an archive without compression."""
    found = sorted((p for p, _, _ in stores.files(folder, recursive=False)), key=lambda p: in_page_order(p.rpartition("/")[2]))

    def fill(new: zipfile.ZipFile) -> None:
        for path in found:
            with stores.open(path) as f:
                new.writestr(path.rpartition("/")[2], f.read())

    written(stores, side, fill)


def is_page(name: str) -> bool:
    return ("." + name.rpartition(".")[2]).lower() in P.IMAGE_EXTENSIONS["ranges"]


def rebuilt(stores: Stores, path: str, pages: list, side: str) -> bool:
    """A range archive from its plan: its other entries first, then its pages in order. False where an earlier run did it."""
    with stores.open(path) as f, zipfile.ZipFile(f) as old:
        mine = set(old.namelist())
    lost = any(p.archive == path and p.entry not in mine for p in pages)
    if lost and {n for n in mine if is_page(n)} == {p.name for p in pages}:
        return False

    def fill(new: zipfile.ZipFile) -> None:
        copied(stores, path, new, lambda name: not is_page(name))
        for p in pages:
            with stores.open(p.archive) as f, zipfile.ZipFile(f) as z:
                new.writestr(p.name, z.read(p.entry), compress_type=z.getinfo(p.entry).compress_type)

    written(stores, side, fill)
    return True


def staged(stores: Stores, row: Row, attempt: str) -> dict:
    """The row's line for the commit; the work on bytes is done here."""
    line = {"op": row.op, "src": row.src, "dest": row.dest, "side": None, "outcome": None, "why": None}
    for path in (row.src, row.dest if row.op in ("rename", "move", "merge_dir", "pack") else None):
        if path is not None and row.op != "skip":
            stores.at(path)  # raises where it is out of reach
    try:
        if row.op == "rewrite" and row.dest is None:
            line |= {"outcome": "skipped", "why": "its page plan does it"}
        elif row.op in ("rewrite", "rebuild"):
            side = side_of(row.src, attempt)
            fresh = rebuilt(stores, row.src, row.pages, side) if row.op == "rebuild" else rewritten(stores, row.src, row.dest, row.reason, side)
            line |= {"outcome": "already"} if fresh is False else {"side": side}
        elif row.op == "pack" and stores.is_dir(row.src) and not stores.exists(row.dest):
            line["side"] = side_of(row.dest, attempt)
            packed(stores, row.src, line["side"])
        elif row.op == "pack":
            line["outcome"] = "already" if stores.exists(row.dest) else "absent"
        elif row.op == "skip":
            line["outcome"] = "skipped"
    except Unreachable:
        raise
    except (KeyError, *BAD_ARCHIVE) as e:
        line |= {"side": None, "outcome": "failed", "why": f"{type(e).__name__}: {e}"}
    return line


# ---- what the commit does


def put(stores: Stores, src: str, dest: str) -> str:
    """src as dest; a file that is there gives way only to a strictly larger one, and never to itself."""
    if src == dest:
        return "already"
    there = stores.info(dest)
    if there.is_file and stores.info(src).size <= there.size:
        stores.remove(src)
        return "kept"
    stores.move(src, dest)
    return "done"


def waiting(src: str, dest: str) -> str:
    return f"{dest}.{hashlib.md5(src.encode()).hexdigest()[:12]}.moving"


def swap_in(stores: Stores, x: dict) -> str:
    stores.move(x["side"], x["src"])
    return "done"


def delete(stores: Stores, x: dict) -> str:
    if not stores.is_file(x["src"]):
        return "already"
    stores.remove(x["src"])
    return "done"


def set_aside(stores: Stores, x: dict) -> None:
    if stores.is_file(x["src"]) and x["src"] != x["dest"]:
        stores.move(x["src"], waiting(x["src"], x["dest"]))


def file_in_place(stores: Stores, x: dict) -> str | None:
    """None for a directory, which is for later."""
    if stores.is_file(aside := waiting(x["src"], x["dest"])):
        return put(stores, aside, x["dest"])
    if stores.is_dir(x["src"]):
        return None
    return "already" if stores.exists(x["dest"]) else "absent"


def directory_left(stores: Stores, x: dict) -> str | None:
    return "directory" if stores.is_dir(x["src"]) else None


def finish_pack(stores: Stores, x: dict) -> str:
    stores.move(x["side"], x["dest"])
    stores.remove_dir(x["src"])
    return "done"


def merge(stores: Stores, x: dict) -> str:
    """A directory under its new name, or into the one that has it, file by file."""
    src, dest = x["src"], x["dest"]
    if not stores.is_dir(src) or src == dest:
        return "already" if stores.exists(dest) else "absent"
    if not stores.exists(dest):
        stores.move(src, dest)
        return "done"
    for path, _, _ in list(stores.files(src)):
        put(stores, path, dest + path.removeprefix(src))
    stores.remove_dir(src)
    return "done"


def tried(work: Callable, stores: Stores, x: dict) -> tuple[str | None, str | None]:
    try:
        return work(stores, x), None
    except OSError as e:
        return "failed", f"{type(e).__name__}: {e}"


def in_tasks(lines: DataFrame, by: Column, works: dict[str, Callable], order: list[str], silent: tuple[str, ...] = ()) -> DataFrame:
    """The outcome of works[op] on each line. Lines with one ``by`` come to one task, one after another in ``order``."""
    names = ["op", "src", "dest", "side"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stores = Stores()
        for b in batches:
            out = []
            for row in b.astype(object).where(b.notna(), None)[names].itertuples(index=False, name=None):
                x = dict(zip(names, row, strict=True))
                outcome, why = tried(works[x["op"]], stores, x)
                if x["op"] not in silent or outcome == "failed":
                    out.append((x["op"], x["src"], x["dest"], outcome, why))
            yield pd.DataFrame(out, columns=["op", "src", "dest", "outcome", "why"], dtype=object)

    wanted = lines.where(F.col("op").isin(*works)).withColumn("by", by)
    n = max(1, wanted.sparkSession.sparkContext.defaultParallelism, wanted.count() // SHARE)
    return wanted.repartition(n, "by").sortWithinPartitions("by", *order).select(*names).mapInPandas(run, OUTCOME)


def swapped(lines: DataFrame, tell: Callable[[DataFrame], None]) -> None:
    """What tasks have staged becomes the library, kind after kind. lines: as tasks left them; tell: writes outcomes.

    Archives come in, files go, and files to be moved are set aside in one pass, as each of these touches only its own source.
    Then files are put in place, those of one destination in the order of the plan, then folders and directories end, from the
    deepest up. Each pass is a job whose tasks can be repeated: what is done already is found to be done.
    """
    open_ = lines.where("outcome is null")
    tell(lines.where("outcome is not null").select("op", "src", "dest", "outcome", "why"))
    kind = F.when(F.col("op").isin("rewrite", "rebuild"), 0).when(F.col("op") == "delete", 1).otherwise(2)
    moves = open_.where("op in ('rename', 'move')")
    tell(in_tasks(open_.withColumn("kind", kind), F.col("src"), {"rewrite": swap_in, "rebuild": swap_in, "delete": delete, "rename": set_aside, "move": set_aside}, ["kind", "task", "nth"], ("rename", "move")))
    tell(in_tasks(moves, F.coalesce("dest", "src"), {"rename": file_in_place, "move": file_in_place}, ["task", "nth"]).where("outcome is not null"))
    tell(in_tasks(open_, F.coalesce("dest", "src"), {"pack": finish_pack}, ["task", "nth"]))
    ends = fixed(in_tasks(moves, F.coalesce("dest", "src"), {"rename": directory_left, "move": directory_left}, ["task", "nth"]).where("outcome is not null"))
    trees = fixed(ends.select("op", "src", "dest", F.lit(0).alias("late")).unionByName(open_.where("op = 'merge_dir'").select("op", "src", "dest", F.lit(1).alias("late"))))
    trees = trees.withColumns({"depth": F.length("src") - F.length(F.replace("src", F.lit("/"))), "side": F.lit(None).cast("string")})
    for n, late in sorted((tuple(r) for r in trees.select("depth", "late").distinct().collect()), key=lambda x: (-x[0], x[1])):  # as many as the tree is deep
        tell(in_tasks(trees.where((F.col("depth") == n) & (F.col("late") == late)), F.coalesce("dest", "src"), {"rename": merge, "move": merge, "merge_dir": merge}, ["src"]))


@dataclass
class Listed(WriterCommitMessage):
    """Where a task's lines are."""

    path: str


class ActionWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.folder, self.jobs = options["path"], options.get("swap") == "jobs"

    def write(self, iterator: Iterator[Row]) -> Listed:
        stores, attempt = Stores(), uuid.uuid4().hex[:12]
        lines = f"{self.folder}/lists/{attempt}.jsonl"
        store, at = stores.at(lines)
        store.create_dir(at.rpartition("/")[0], recursive=True)
        sides: list[str] = []
        try:
            with store.open_output_stream(at) as out:
                task = TaskContext.get()
                for nth, row in enumerate(iterator):
                    line = staged(stores, row, attempt) | {"task": task.partitionId() if task else 0, "nth": nth}
                    if line["side"]:
                        sides.append(line["side"])
                    out.write((json.dumps(line) + "\n").encode())
        except BaseException:
            for side in sides:
                if stores.is_file(side):
                    stores.remove(side)
            raise
        return Listed(lines)

    def lines(self, stores: Stores, messages: list) -> Iterator[dict]:
        for m in filter(None, messages):
            with stores.open(m.path) as f:
                held = b""
                while chunk := f.read(1 << 20):
                    *whole, held = (held + chunk).split(b"\n")
                    yield from map(json.loads, filter(None, whole))

    def commit(self, messages: list) -> None:
        """The lists that count are named in one file, a line for each task; ``carried_out`` swaps by them, in jobs of its own."""
        stores = Stores()
        store, at = stores.at(f"{self.folder}/{STAGED}")
        store.create_dir(at.rpartition("/")[0], recursive=True)
        with store.open_output_stream(at) as out:
            for m in filter(None, messages):
                out.write((m.path + "\n").encode())
        if not self.jobs:
            self.swap_here(messages)

    def swap_here(self, messages: list) -> None:
        """The swap on the driver, for writes of the data source by itself."""
        stores = Stores()
        _, at = stores.at(f"{self.folder}/outcomes/part-{uuid.uuid4().hex}.jsonl")
        store = stores.at(self.folder)[0]
        store.create_dir(at.rpartition("/")[0], recursive=True)
        with store.open_output_stream(at) as out, ThreadPoolExecutor(THREADS) as pool:

            def tell(x: dict, outcome: str, why: str | None = None) -> None:
                out.write((json.dumps({"op": x["op"], "src": x["src"], "dest": x["dest"], "outcome": outcome, "why": why}) + "\n").encode())

            def tried(work: Callable, share: list[dict]) -> list[tuple[dict, str | None, str | None]]:
                done = []
                for x in share:
                    try:
                        done.append((x, work(stores, x), None))
                    except OSError as e:
                        done.append((x, "failed", f"{type(e).__name__}: {e}"))
                return done

            def each(wanted: Iterable[dict], work: Callable, silent: bool = False) -> None:
                """work on every line, those of one destination one after another; a bounded number of lines at a time."""

                def run(held: list[dict]) -> None:
                    shares: list[list[dict]] = [[] for _ in range(THREADS)]
                    for x in held:
                        shares[hash(x["dest"] or x["src"]) % THREADS].append(x)
                    for done in pool.map(lambda s: tried(work, s), shares):
                        for x, outcome, why in done:
                            if not silent or outcome == "failed":
                                tell(x, outcome, why)

                held: list[dict] = []
                for x in wanted:
                    held.append(x)
                    if len(held) >= 20_000:
                        run(held)
                        held = []
                run(held)

            open_ = lambda *ops: (x for x in self.lines(stores, messages) if x["op"] in ops and x["outcome"] is None)
            for x in self.lines(stores, messages):
                if x["outcome"]:
                    tell(x, x["outcome"], x["why"])
            each(open_("rewrite", "rebuild"), swap_in)
            each(open_("delete"), delete)
            each(open_("rename", "move"), set_aside, silent=True)
            depth = lambda x: x["src"].count("/")
            files = lambda x: stores.is_file(waiting(x["src"], x["dest"])) or not stores.is_dir(x["src"])
            each((x for x in open_("rename", "move") if files(x)), file_in_place)
            each(open_("pack"), finish_pack)
            for n in sorted({depth(x) for x in open_("rename", "move", "merge_dir")}, reverse=True):  # as many as the tree is deep
                each((x for x in open_("rename", "move") if depth(x) == n and stores.is_dir(x["src"])), merge)
                each((x for x in open_("merge_dir") if depth(x) == n), merge)

    def abort(self, messages: list) -> None:
        """Nothing has been swapped; what finished tasks have written goes."""
        stores = Stores()
        for x in self.lines(stores, messages):
            if x["side"] and stores.is_file(x["side"]):
                stores.remove(x["side"])


class LibraryActions(DataSource):
    @classmethod
    def name(cls) -> str:
        return "library_actions"

    def schema(self) -> str:
        return PLAN

    def writer(self, schema: StructType, overwrite: bool) -> ActionWriter:
        return ActionWriter(self.options)


def carried_out(plan: DataFrame, report: str | None = None) -> DataFrame:
    """Carry out a plan of actions; (op, src, dest, outcome, why) of each. report: a new folder for lists and outcomes."""
    spark: SparkSession = plan.sparkSession
    report = report or f"{shared_folder(spark)}/actions-{uuid.uuid4().hex}"
    plan = fixed(plan)  # carrying it out changes what it was made from
    if odd := plan.where(~F.col("op").isin(*OPS)).limit(1).collect():
        raise ValueError(f"no such action: {odd[0].op}")
    if "pages" not in plan.columns:
        plan = plan.withColumn("pages", F.lit(None).cast("array<struct<archive: string, entry: string, name: string>>"))
    spark.dataSource.register(LibraryActions)
    plan.select("op", "src", "dest", "reason", F.col("size").cast("long").alias("size"), "pages").write.format("library_actions").option("swap", "jobs").mode("append").save(report)
    stores = Stores()
    with stores.open(f"{report}/{STAGED}") as f:
        lists = f.read().decode().split()  # as many as the plan had tasks
    if lists:
        swapped(spark.read.schema(LINE).json(lists), lambda df: df.write.mode("append").parquet(f"{report}/outcomes"))
    return spark.read.schema(OUTCOME).parquet(f"{report}/outcomes") if lists else spark.createDataFrame([], OUTCOME)


def failures(outcomes: DataFrame) -> int:
    return outcomes.where("outcome in ('failed', 'absent')").count()


def apply(actions: DataFrame) -> int:
    """Carry out a plan; the number of actions that failed."""
    return failures(carried_out(actions))


def page_actions(plan: DataFrame) -> DataFrame:
    """A page plan as actions: one a range archive of which some page is better elsewhere."""
    at = lambda k: F.regexp_extract("winner_entry", ARCHIVE_ENTRY.pattern, k)
    page = F.struct("pos", F.struct(at(1).alias("archive"), at(2).alias("entry"), F.col("new_name").alias("name")).alias("page"))
    found = plan.groupBy("group").agg(F.sort_array(F.collect_list(page)).alias("p"), F.bool_or("upgraded").alias("any")).where("any")
    none = F.lit(None).cast("string")
    return found.select(F.lit("rebuild").alias("op"), F.col("group").alias("src"), none.alias("dest"), none.alias("reason"), F.lit(None).cast("long").alias("size"), F.col("p.page").alias("pages"))


def apply_pages(plan: DataFrame) -> int:
    """Rebuild the range archives of a page plan; before the actions of that plan. The number that failed."""
    return failures(carried_out(page_actions(plan)))
