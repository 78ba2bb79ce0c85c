"""Data sources: archives, events, the committing sink; stores that cannot be reached."""

import os
import shutil
import time
import zipfile

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidyshelf.sources import apply, archives, events, files
from tidyshelf.sources.stores import Stores, Unreachable, prefix_of
from tidyshelf.streaming import live

PLAN = "op string, src string, dest string, reason string, size long"


def archive(path, *entries, xml=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w") as z:
        for name, content in entries:
            z.writestr(name, content)
        if xml is not None:
            z.writestr("in/COMICINFO.xml", xml)


def tree_of(root):
    return sorted(str(p.relative_to(root)) for p in root.rglob("*") if p.is_file())


def test_paths_and_stores(tmp_path):
    assert [prefix_of(p) for p in ("/a", "file:/a", "file:///a", "hdfs://h:1/a", "s3a://b/a")] == ["", "file:", "file:", "hdfs://h:1", "s3a://b"]
    for bad in ("a/b", "odd://x/y"):
        with pytest.raises(Unreachable):
            Stores().at(bad)
    (tmp_path / "a").write_text("x")
    assert list(Stores().files(f"file://{tmp_path}"))[0][:2] == (f"file:{tmp_path}/a", 1) and list(Stores().files(f"{tmp_path}/none")) == []


def test_archives_in_one_pass(spark, tmp_path):
    archive(tmp_path / "S/x1.cbz", ("1.jpg", "a"), ("2.PNG", "bb"), xml="<x>1</x>")
    archive(tmp_path / "S/x2.CBZ", ("1.jpg", "a"))
    archive(tmp_path / "S/deep/x3.Cbz")
    (tmp_path / "S/bad.cbz").write_bytes(b"no zip")
    (tmp_path / "S/note.txt").write_text("x")
    root = f"file://{tmp_path}"
    got = {(r.path.rpartition("/")[2], r.entry, r.ord, r.ok, r.document, r.xml) for r in archives.contents(spark, root).collect()}
    assert got == {("x1.cbz", "1.jpg", 0, True, "in/COMICINFO.xml", None), ("x1.cbz", "2.PNG", 1, True, "in/COMICINFO.xml", None), ("x1.cbz", "in/COMICINFO.xml", 2, True, "in/COMICINFO.xml", "<x>1</x>"), ("x2.CBZ", "1.jpg", 0, True, None, None), ("bad.cbz", None, None, False, None, None)}
    assert {r.name for r in files.scan(spark, root).collect()} == {"x1.cbz", "x2.CBZ", "x3.Cbz", "bad.cbz"}
    assert {r.path.rpartition("/")[2] for r in archives.metadata(spark, root, recursive=False).collect()} == set()
    assert {r.path.rpartition("/")[2] for r in archives.metadata(spark, f"{root}/S", recursive=False).collect()} == {"x1.cbz", "x2.CBZ", "bad.cbz"}
    assert archives.entries(spark, f"{root}/none").count() == 0
    assert archives.entries(spark, root).where("entry = '1.jpg' and path like '%.CBZ'").count() == 1


def test_archives_filters_and_shares(tmp_path):
    """Filters on paths drop archives before they are planned, those on entries before rows are made; no xml asked, none read."""
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringEndsWith, StringStartsWith
    from pyspark.sql.types import StructType

    for i in range(40):
        archive(tmp_path / f"S{i % 2}/x{i}.cbz", ("1.jpg", "a" * 100_000), ("2.png", "b"), xml="<x/>")
    schema = archives.LibraryArchives({"path": str(tmp_path)}).schema()
    kinds = StructType.fromDDL
    reader = archives.FilteringReader(kinds(schema), {"path": str(tmp_path), "partitionbytes": "300000"})
    rest = [EqualTo(("size",), 1), GreaterThan(("path",), "a")]
    left = list(reader.pushFilters([StringStartsWith(("path",), f"{tmp_path}/S1"), StringEndsWith(("entry",), ".png"), In(("entry",), ("2.png", "3.png")), *rest]))
    assert left == rest
    shares = reader.partitions()
    assert len(shares) > 3 and sum(len(s.archives) for s in shares) == 20
    rows = [r for s in shares for b in reader.read(s) for r in b.to_pylist()]
    assert len(rows) == 20 and {r["entry"] for r in rows} == {"2.png"}
    lean = archives.ArchiveReader(kinds("path string, ok boolean"), {"path": str(tmp_path)})
    rows = [r for s in lean.partitions() for b in lean.read(s) for r in b.to_pylist()]
    assert len(rows) == 40 and set(rows[0]) == {"path", "ok"}


def listing(*rows):
    return pd.DataFrame(rows, columns=events.LISTED)


def test_differences_of_listings():
    before = listing(("a", 1, 10, 0), ("b", 2, 20, 1), ("c", 3, 30, 0), ("d", 3, 30, 0), ("e", 5, 50, 0))
    now = listing(("a", 1, 10, 0), ("b", 2, 20, 0), ("x/d", 3, 30, 0), ("x/c", 3, 30, 0), ("e", 6, 51, 0), ("n", 9, 90, 0))
    got = [(r.event_type, r.path, r.dest_path) for r in events.changes(before, now).itertuples()]
    assert got == [("created", "n", None), ("modified", "e", None), ("moved", "c", "x/c"), ("moved", "d", "x/d"), ("polled", "b", None)]
    assert len(events.changes(before, before.assign(left=0))) == 1 and len(events.changes(now, now)) == 0
    assert list(events.changes(before, before.iloc[:0])["event_type"]) == ["deleted"] * 5


def test_event_stream(spark, tmp_path):
    """Creations, a move, an edit and a deletion; a restart repeats nothing."""
    root, state = tmp_path / "w", f"file://{tmp_path}/state"
    archive(root / "S/a.cbz", ("1", "x"))
    archive(root / "S/b.CBZ", ("1", "x"))
    archive(root / "loose.cbz", ("1", "xyz"))

    def run():
        stream = events.events(spark, f"file://{root}", state)
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        rows = spark.read.parquet(str(tmp_path / "out")).collect()
        got = {(r.event_type, r.path.removeprefix(f"file:{root}/"), r.at_root) for r in rows}
        assert len(got) == len(rows)
        return got

    first = run()
    assert first == {("created", "S/a.cbz", False), ("created", "S/b.CBZ", False), ("created", "loose.cbz", True)}
    (root / "T").mkdir()
    os.rename(root / "S/a.cbz", root / "T/a2.cbz")
    archive(root / "S/b.CBZ", ("1", "longer now"))
    (root / "loose.cbz").unlink()
    assert run() - first == {("deleted", "S/a.cbz", False), ("moved", "T/a2.cbz", False), ("modified", "S/b.CBZ", False), ("deleted", "loose.cbz", True)}
    assert len(run()) == 7
    assert len([n for n in os.listdir(tmp_path / "state") if n.startswith("listing")]) <= 2


def test_listings_by_tasks(tmp_path):
    """Tasks list groups of directories; what a batch has listed it tells again, and what a directory held that is gone too."""
    root = tmp_path / "w"
    for d in ("S/a", "S/b", "T"):
        archive(root / d / "1.cbz", ("1", d))
    archive(root / "0.cbz", ("1", "x"))
    reader = events.EventReader({"path": str(root), "state": f"{tmp_path}/state", "samples": "1"})

    def told(start, end):
        parts = reader.partitions({"listing": start}, {"listing": end})
        rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
        return len(parts), sorted((r["event_type"], r["path"].removeprefix(f"{root}/")) for r in rows)

    assert reader.latestOffset() == {"listing": 1}
    first = (5, [("created", x) for x in ("0.cbz", "S/a/1.cbz", "S/b/1.cbz", "T/1.cbz")])
    assert told(0, 1) == first
    shutil.move(root / "S/a", root / "U")
    archive(root / "S/b/2.cbz", ("1", "new"))
    assert told(0, 1) == first and reader.latestOffset() == {"listing": 2}
    second = [("created", "S/b/2.cbz"), ("created", "U/1.cbz"), ("deleted", "S/a/1.cbz"), ("polled", "0.cbz"), ("polled", "S/b/1.cbz"), ("polled", "T/1.cbz")]
    assert told(1, 2)[1] == second
    (root / "0.cbz").unlink()
    assert told(1, 2)[1] == second
    assert told(2, 3)[1] == [("deleted", "0.cbz"), ("polled", "S/b/2.cbz"), ("polled", "U/1.cbz")]
    assert told(3, 4)[1] == []
    reader.commit({"listing": 4})
    assert os.listdir(tmp_path / "state") == ["listing-000000000004"]


def test_directories_stay_in_their_group():
    many = {f"d{i}": True for i in range(3000)}
    groups = events.dealt(many, {})
    assert len(groups) == 3000 // events.OF_GROUP and max(len(held) for held in groups.values()) <= events.OF_GROUP + 1
    fewer = {d: True for d in many if d not in ("d5", "d6")} | {"new": True}
    after = events.dealt(fewer, groups)
    where = lambda x: {d: g for g, held in x.items() for d, _ in held}
    assert set(where(after)) == set(fewer) and all(where(groups)[d] == g for d, g in where(after).items() if d != "new")
    gone = events.dealt({"r": False}, {"0": [["r", False]], "1": [["x", True]], "2": []})
    assert gone == {"0": [("r", False)], "1": []}


def test_moves_of_any_time_zone():
    schema = pa.schema([("event_type", pa.string()), ("path", pa.string()), ("dest_path", pa.string()), *((c, pa.timestamp("us", "America/New_York")) for c in ("event_time", "dir_ctime")), ("size", pa.int64())])
    rows = [("created", "b", None, 5, 5, 1), ("deleted", "a", None, 5, 5, 1), ("polled", "c", None, 5, 5, 1), ("created", "n", None, 6, 6, 1)]
    batches = [pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(r, schema, strict=True)], schema=schema) for r in rows]
    got = pa.Table.from_batches(list(events.met(iter(batches))), schema)
    assert sorted((r["event_type"], r["path"], r["dest_path"]) for r in got.to_pylist()) == [("created", "n", None), ("moved", "a", "b"), ("polled", "c", None)]
    assert pa.Table.from_batches(list(events.met(iter(batches[:1]))), schema).num_rows == 1


def test_sink_outcomes(spark, tmp_path):
    archive(tmp_path / "a.cbz", ("1.jpg", "x"))
    (tmp_path / "small").write_text("1")
    (tmp_path / "large").write_text("12345")
    (tmp_path / "gone").write_text("x")
    at = lambda n: f"{tmp_path}/{n}"
    rows = [("rewrite", at("a.cbz"), "ComicInfo.xml", "<x/>", 1), ("move", at("small"), at("large"), "", 1), ("delete", at("gone"), None, "", 1), ("delete", at("never"), None, "", 1), ("rename", at("no"), at("where"), "", 1), ("skip", "r", None, "", None), ("rewrite", at("none.cbz"), "x", "<x/>", 1)]
    plan = spark.createDataFrame(rows, PLAN)
    got = {(r.src.rpartition("/")[2], r.outcome) for r in apply.carried_out(plan).collect()}
    assert got == {("a.cbz", "done"), ("small", "kept"), ("gone", "done"), ("never", "already"), ("no", "absent"), ("r", "skipped"), ("none.cbz", "failed")}
    assert tree_of(tmp_path) == ["a.cbz", "large"] and (tmp_path / "large").read_text() == "12345"
    again = {(r.src.rpartition("/")[2], r.outcome) for r in apply.carried_out(plan.where("op in ('delete', 'move')")).collect()}
    assert again == {("small", "already"), ("gone", "already"), ("never", "already")}


def test_sink_out_of_reach(spark, tmp_path):
    """A path in a store that cannot be reached raises, and nothing is changed."""
    (tmp_path / "a").write_text("x")
    archive(tmp_path / "b.cbz", ("1", "x"))
    rows = [("delete", f"{tmp_path}/a", None, "", 1), ("rewrite", f"{tmp_path}/b.cbz", "c.xml", "<x/>", 1), ("move", "odd://x/a", "odd://x/b", "", 1)]
    with pytest.raises(PySparkException):
        apply.carried_out(spark.createDataFrame(rows, PLAN).coalesce(1))
    assert tree_of(tmp_path) == ["a", "b.cbz"]


def test_a_lost_attempt_changes_nothing(spark, tmp_path):
    archive(tmp_path / "b.cbz", ("1", "x"))
    before = (tmp_path / "b.cbz").read_bytes()
    row = spark.createDataFrame([("rewrite", f"{tmp_path}/b.cbz", "c.xml", "<x/>", 1, None)], apply.PLAN).collect()[0]
    writer = apply.ActionWriter({"path": f"{tmp_path}/report"})
    killed = writer.write(iter([row]))  # staged, never committed
    assert (tmp_path / "b.cbz").read_bytes() == before and files.stale(F.lit("")) is not None
    done = writer.write(iter([row]))
    writer.commit([done])
    assert zipfile.ZipFile(tmp_path / "b.cbz").namelist() == ["1", "c.xml"]
    assert len([n for n in tree_of(tmp_path) if n.endswith(".tmp.cbz")]) == 1  # the killed attempt's, for the plan of leftovers
    writer.abort([killed, None])
    assert not [n for n in tree_of(tmp_path) if n.endswith(".tmp.cbz")]

    def broken():
        yield row
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(broken())
    assert not [n for n in tree_of(tmp_path) if n.endswith(".tmp.cbz")]


def test_live_settling(spark, tmp_path):
    """One directory and nothing after it; a young one waits for the exact rest of its age; files are waited for until stable."""
    rows = [("w/last", "a", "created", -1000.0, 1), ("w/young", "b", "created", 0.0, 1), ("w/copying", "c", "created", -1000.0, 1), ("w/copying", "c", "polled", 0.0, 5), ("w/last", "a", "polled", 0.0, 7), ("w/last", "a", "polled", 0.0, 7), ("w/idle", "z", "polled", 0.0, 7), (None, "n", "created", 0.0, 1)]
    began = time.time()
    df = spark.createDataFrame([(d, p, k, 0.0, began + age, s) for d, p, k, age, s in rows], "dir_path string, path string, event_type string, t double, born double, size long")
    df.select("dir_path", "path", "event_type", F.col("born").cast("timestamp").alias("dir_ctime"), "size").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = live.started(live.settled(stream.where("dir_path <> 'w/copying' or dir_path is null"), quiet=1, age=12, polls=2), str(tmp_path / "out"), str(tmp_path / "cp"), every=0.3)
    young = live.started(live.settled(stream.where("event_type <> 'polled'"), quiet=1, age=12), str(tmp_path / "out2"), str(tmp_path / "cp2"), every=0.3)
    live.drained(young, 90)
    got = {r.dir_path: r for r in spark.read.parquet(str(tmp_path / "out2")).collect()}
    assert set(got) == {"w/last", "w/young", "w/copying"}
    assert got["w/young"].ready_at.timestamp() >= began + 12 and got["w/last"].events == 1
    deadline = time.time() + 30
    while time.time() < deadline and not (os.path.isdir(tmp_path / "out") and spark.read.schema(live.READY).parquet(str(tmp_path / "out")).count()):
        time.sleep(0.3)
    q.stop()
    assert [(r.dir_path, r.files, r.stable) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("w/last", 1, True)]


def test_actions_are_carried_out_by_tasks(spark, tmp_path):
    """Swaps, chains, several of one destination and directories, with the swap as jobs: no action runs on the driver."""
    for n, x in (("a", "1"), ("b", "22"), ("c", "333"), ("w1", "4444"), ("w2", "55555"), ("w3", "6"), ("d/e/f", "7"), ("d/g", "8"), ("k/g", "99")):
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text(x)
    at = lambda n: f"{tmp_path}/{n}"
    moves = [("a", "b"), ("b", "a"), ("c", "d2"), ("w1", "w"), ("w2", "w"), ("w3", "w"), ("d/e", "d/h")]
    rows = [("rename", at(a), at(b), "", 1) for a, b in moves] + [("merge_dir", at("d"), at("k"), "", None)]
    report = f"{tmp_path}-report"
    got = {(r.src.removeprefix(f"{tmp_path}/"), r.outcome) for r in apply.carried_out(spark.createDataFrame(rows, PLAN).repartition(3), report).collect()}
    assert sum(1 for _ in open(f"{report}/staged.txt")) == 3  # all that the driver was told: a list for each task
    assert {o for s, o in got if s[0] != "w"} == {"done"} and len(got) == 8
    left = {n: (tmp_path / n).read_text() for n in tree_of(tmp_path)}
    assert left == {"a": "22", "b": "1", "d2": "333", "w": "55555", "k/h/f": "7", "k/g": "99"}
