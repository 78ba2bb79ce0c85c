"""Whole plans on small libraries."""

import zipfile

from pyspark.sql import functions as F

from tidyshelf.operators.routing import Rule
from tidyshelf.plans import library
from tidyshelf.sources import apply, files as sources
from tidyshelf.sources.files import described
from tidyshelf.sources.stores import Stores


def shelf(spark, *rows):
    return described(spark.createDataFrame(list(rows), "path string, size long"))


def plan_rows(df):
    return {(r.op, r.src, r.dest) for r in df.collect()}


META = "path string, entry_name string, xml string"


def test_clean(spark):
    files = shelf(spark, ("r/Bat [x]/Bat ch. 005.cbz", 9), ("r/Bat [x]/Bat ch. 5 (y).cbz", 3), ("r/Ok/a.cbz", 0), ("r/Ok/Own.cbz", 2))
    meta = spark.createDataFrame([("r/Ok/Own.cbz", "c.xml", "<Title>Own</Title>")], META)
    done = spark.createDataFrame([("r/none",)], "p string")
    got = plan_rows(library.clean(files, meta, done, profile="batch"))
    assert ("rename", "r/Bat [x]", "r/Bat") in got and ("rename", "r/Bat [x]/Bat ch. 005.cbz", "r/Bat [x]/Bat ch. 5.cbz") in got
    assert ("delete", "r/Bat [x]/Bat ch. 5 (y).cbz", None) in got and ("rewrite", "r/Bat [x]/Bat ch. 005.cbz", "ComicInfo.xml") in got
    assert not any("Ok" in r[1] for r in got)
    assert plan_rows(library.clean(files, meta, spark.createDataFrame([(r.path,) for r in files.collect()], "p string"))) == set()


def test_range_names(spark):
    files = shelf(spark, *[(f"r/S/S ch. {n}.cbz", n) for n in (1, 2, 3, 4, 5, 15)])
    assert plan_rows(library.range_names(files)) == {("rename", "r/S/S ch. 15.cbz", "r/S/S ch. 1-5.cbz")}


def test_duplicates_and_folders(spark):
    files = shelf(spark, ("r/S/A - Ch. 1.cbz", 5), ("r/S/A Ch.1.cbz", 9), ("r/S/A ch 1.cbr", 99), ("r/S/x.cbr", 1), ("r/P/1.jpg", 1), ("r/P/comicinfo.xml", 1), ("r/Q/1.jpg", 1), ("r/Q/n.txt", 1), ("r/T/1.png", 1), ("r/T.cbz", 1))
    assert plan_rows(library.deduplicate(files)) == {("delete", "r/S/A - Ch. 1.cbz", None), ("delete", "r/S/A ch 1.cbr", None)}
    assert plan_rows(library.pack_folders(files, "r")) == {("pack", "r/P", "r/P.cbz")}
    assert plan_rows(library.strip_repeats(shelf(spark, ("r/a ch. 1 ch.1.cbz", 1), ("r/b.cbz", 1)))) == {("rename", "r/a ch. 1 ch.1.cbz", "r/a ch. 1.cbz")}


def test_groups_and_pairs(spark):
    files = shelf(spark, ("r/Bat ch. 1/Bat 1.cbz", 1), ("r/BAT ch. 2/Chapter 2.cbz", 2), ("r/BAT ch. 2/Bat 1.cbz", 1), ("r/Solo/x.cbz", 1))
    got = plan_rows(library.merge_groups(files))
    assert ("move", "r/BAT ch. 2/Chapter 2.cbz", "r/BAT/BAT ch. 2.cbz") in got and sum(op == "delete" for op, _, _ in got) == 1 and len(got) == 3
    files = shelf(spark, ("r/Batman One/1.cbz", 1), ("r/Batman: One/1.cbz", 1), ("r/Batman: One/2.cbz", 1))
    assert plan_rows(library.match_series(files)) == {("merge_dir", "r/Batman One", "r/Batman: One")}
    files = shelf(spark, ("r/X (Uncensored)/1.cbz", 1), ("r/x!/1.cbz", 1), ("r/Y uncensored/1.cbz", 1))
    assert plan_rows(library.separate_marked(files)) == {("move", "r/X (Uncensored)", "r/_Check/X (Uncensored)"), ("move", "r/x!", "r/_Check/x!")}


def test_ranges(spark):
    files = shelf(spark, ("r/S/S ch. 1-2.cbz", 9), ("r/S/S ch. 1.cbz", 1), ("r/S/S ch. 2.cbz", 1), ("r/S/S ch. 3-4.cbz", 1))
    pages = [("r/S/S ch. 1-2.cbz", "a.jpg", ".jpg", 5), ("r/S/S ch. 1-2.cbz", "b.jpg", ".jpg", 5), ("r/S/S ch. 1.cbz", "z.jpg", ".jpg", 9), ("r/S/S ch. 2.cbz", "a.jpg", ".jpg", 1)]
    plan, actions = library.resolve_ranges(files, spark.createDataFrame(pages, "path string, entry string, ext string, size long"))
    assert [r.winner_entry for r in plan.orderBy("pos").collect()] == ["r/S/S ch. 1.cbz!z.jpg", "r/S/S ch. 1-2.cbz!b.jpg"]
    assert plan_rows(actions) == {("rewrite", "r/S/S ch. 1-2.cbz", None), ("move", "r/S/S ch. 1.cbz", "r/S/Processed/S ch. 1.cbz"), ("move", "r/S/S ch. 2.cbz", "r/S/Processed/S ch. 2.cbz")}


def test_tags_gaps_routes_and_leftovers(spark, tmp_path):
    files = shelf(spark, ("r/S/a ch 1.cbz", 1), ("r/S/a ch 4.cbz", 1), ("r/S/x.tmp.cbz", 1))
    meta = spark.createDataFrame([("r/S/a ch 1.cbz", "c.xml", "<Number>1</Number>"), ("r/S/a ch 4.cbz", "c.xml", "<Number>9</Number>")], META)
    assert plan_rows(library.tag_numbers(files, meta)) == {("rewrite", "r/S/a ch 4.cbz", "c.xml")}
    assert [(r.series, r.missing) for r in library.gap_report(files, "r").collect()] == [("S", "2-3")]
    assert plan_rows(library.leftovers(files)) == {("delete", "r/S/x.tmp.cbz", None)}
    dirs = spark.createDataFrame([("w/Webtoons X/Batman [1]",), ("w/Other/Y",)], "dir_path string")
    rules, places = [Rule("source", "webtoons*", "m")], {"m": "M", "c": "C"}
    assert plan_rows(library.route(dirs, "w", rules, places, "c")) == {("move", "w/Webtoons X/Batman [1]", "M/Batman"), ("move", "w/Other/Y", "C/Y")}
    dirs.write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(dirs.schema).parquet(str(tmp_path / "in"))
    job = library.ingest(stream, lambda b: library.route(b, "w", rules, places, "c"), lambda plan: seen.extend(r.dest for r in plan.collect()), str(tmp_path / "cp"))
    job.trigger(availableNow=True).start().awaitTermination()
    assert sorted(seen) == ["C/Y", "M/Batman"] and dirs.select(F.lit(1)).count() == 2


def archive(path, *entries, xml=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w") as z:
        for name, data in entries:
            z.writestr(name, data)
        if xml is not None:
            z.writestr("ComicInfo.xml", xml)


def tree_of(root):
    return sorted(str(p.relative_to(root)) for p in root.rglob("*") if p.is_file())


def entry(path, name):
    with zipfile.ZipFile(path) as z:
        return z.read(name).decode()


def test_live_collisions_keep_their_names(spark):
    files = shelf(spark, ("r/Bat/Bat ch. 005.cbz", 9), ("r/Bat/Bat ch. 5.cbz", 3), ("r/Bat/Bat ch. 05.cbz", 4))
    meta = spark.createDataFrame([(r.path, "c.xml", "<Title>x y</Title>") for r in files.collect()], META)
    assert plan_rows(library.clean(files, meta, profile="live")) == set()
    got = plan_rows(library.clean(files, meta, rules=frozenset({"number_tokens"}), profile="batch"))
    assert got == {("rename", "r/Bat/Bat ch. 005.cbz", "r/Bat/Bat ch. 5.cbz"), ("delete", "r/Bat/Bat ch. 5.cbz", None), ("delete", "r/Bat/Bat ch. 05.cbz", None)}


def test_each_file_is_renamed_once(spark):
    files = shelf(spark, *[(f"r/S {b}/S ch. 0{n} [z].cbz", n) for b, ns in (("[a]", (1, 2, 3)), ("(b)", (4, 5, 15))) for n in ns])
    got = library.clean(files, spark.createDataFrame([], META), profile="batch").where("op <> 'rewrite'").collect()
    assert len({r.src for r in got}) == len(got) == 8
    assert {(r.op, r.src, r.dest) for r in got if r.src.count("/") == 1} == {("rename", "r/S (b)", "r/S"), ("merge_dir", "r/S [a]", "r/S")}
    assert {r.dest for r in got} >= {"r/S (b)/S ch. 1-5.cbz", "r/S [a]/S ch. 1.cbz"}


def test_a_cleaned_library_on_disk(spark, tmp_path):
    root = tmp_path / "lib"
    for n in (1, 2, 3):
        archive(root / f"S [a]/S ch. 0{n}.cbz", ("1.jpg", "x" * n), xml="<ComicInfo><Title>S [q]</Title><Series>S [q]</Series></ComicInfo>")
    archive(root / "S (b)/S ch. 2.cbz", ("1.jpg", "x" * 900))
    archive(root / "S (b)/S ch. 13.cbz", ("1.jpg", "x"), xml="<ComicInfo><Number>13</Number></ComicInfo>")
    files, meta = sources.scan(spark, f"file://{root}"), sources.metadata(spark, f"file://{root}")
    assert apply.apply(library.clean(files, meta, profile="batch")) == 0
    assert tree_of(root) == ["S/S ch. 1-3.cbz", "S/S ch. 1.cbz", "S/S ch. 2.cbz", "S/S ch. 3.cbz"]
    assert "<Number>1-3</Number>" in entry(root / "S/S ch. 1-3.cbz", "ComicInfo.xml") and "<Series>S</Series>" in entry(root / "S/S ch. 3.cbz", "ComicInfo.xml")
    assert len(entry(root / "S/S ch. 2.cbz", "1.jpg")) == 900
    assert library.clean(sources.scan(spark, f"file://{root}"), sources.metadata(spark, f"file://{root}"), profile="batch").where("op <> 'rewrite'").count() == 0


def test_merged_groups_on_disk(spark, tmp_path):
    root = tmp_path / "lib"
    archive(root / "Bat ch. 1/Chapter 1.cbz", ("1.jpg", "x"))
    archive(root / "BAT ch. 2/deep/Own v3 ch. 2.cbz", ("1.jpg", "x"), xml="<ComicInfo>\n</ComicInfo>")
    files, meta = sources.scan(spark, f"file://{root}"), sources.metadata(spark, f"file://{root}")
    assert apply.apply(library.merge_groups(files, meta)) == 0
    assert tree_of(root) == ["BAT/Bat ch. 1.cbz", "BAT/Own v3 ch. 2.cbz"]
    xml = entry(root / "BAT/Own v3 ch. 2.cbz", "ComicInfo.xml")
    assert all(x in xml for x in ("<Series>BAT</Series>", "<Title>Own v3 ch. 2</Title>", "<Volume>3</Volume>\n  <Number>2</Number>"))
    assert "<Title>Bat ch. 1</Title>" in entry(root / "BAT/Bat ch. 1.cbz", "ComicInfo.xml")


def test_rebuilt_ranges_and_packed_folders_on_disk(spark, tmp_path):
    root = tmp_path / "lib"
    archive(root / "S/S ch. 1-2.cbz", ("b.jpg", "old b"), ("a.jpg", "a"), xml="<x/>")
    archive(root / "S/S ch. 1.cbz", ("p.jpg", "better a"))
    archive(root / "S/S ch. 2.cbz", ("p.jpg", "b"))
    url = f"file://{root}"
    plan, actions = library.resolve_ranges(sources.scan(spark, url), sources.entries(spark, url).where("ok"))
    plan, actions = plan.persist(), actions.persist()
    assert actions.count() == 3
    assert apply.apply_pages(plan) == 0 and apply.apply_pages(plan) == 0 and apply.apply(actions) == 0
    assert tree_of(root) == ["S/Processed/S ch. 1.cbz", "S/Processed/S ch. 2.cbz", "S/S ch. 1-2.cbz"]
    with zipfile.ZipFile(root / "S/S ch. 1-2.cbz") as z:
        assert z.namelist() == ["ComicInfo.xml", "page_0001.jpg", "page_0002.jpg"] and z.read("page_0001.jpg") == b"better a" and z.read("page_0002.jpg") == b"old b"
    folder = tmp_path / "pics/P"
    folder.mkdir(parents=True)
    for name in ("10.jpg", "9.jpg", "ComicInfo.xml"):
        (folder / name).write_text(name)
    pics = sources.scan(spark, f"file://{tmp_path}/pics", glob="*")
    assert apply.apply(library.pack_folders(pics)) == 0 and tree_of(tmp_path / "pics") == ["P.cbz"]
    with zipfile.ZipFile(tmp_path / "pics/P.cbz") as z:
        assert z.namelist() == ["ComicInfo.xml", "9.jpg", "10.jpg"]


def test_the_sink_takes_chains_and_repeats(spark, tmp_path):
    for name in "abc":
        (tmp_path / name).write_text(name)
    rows = [("rename", f"{tmp_path}/a", f"{tmp_path}/b", "", 1), ("rename", f"{tmp_path}/b", f"{tmp_path}/a", "", 1), ("rename", f"{tmp_path}/c", f"{tmp_path}/d/e", "", 1), ("delete", f"{tmp_path}/none", None, "", 1)]
    plan = spark.createDataFrame(rows, "op string, src string, dest string, reason string, size long")
    assert apply.apply(plan) == 0
    assert [(tmp_path / n).read_text() for n in ("a", "b", "d/e")] == ["b", "a", "c"]
    bad = spark.createDataFrame([("rewrite", f"{tmp_path}/none.cbz", "c.xml", "<x/>", 1)], plan.schema)
    assert apply.apply(bad) == 1


def test_marked_names_that_are_taken(spark):
    files = shelf(spark, ("r/X (Uncensored)/1.cbz", 1), ("r/x!/1.cbz", 1), ("r/_Check/x!/1.cbz", 1), ("r/_Check/x! (1)/1.cbz", 1))
    assert plan_rows(library.separate_marked(files)) == {("move", "r/X (Uncensored)", "r/_Check/X (Uncensored)"), ("move", "r/x!", "r/_Check/x! (2)")}


def test_risky_duplicates(spark):
    files = shelf(spark, ("r/S/A Ch. 1.5.cbz", 5), ("r/S/A Ch. 15.cbz", 9))
    assert [r.reason for r in library.deduplicate(files).collect()] == ["smaller duplicate, numbers differ"]


def test_arrivals_and_logs(spark, tmp_path):
    archive(tmp_path / "w/S/a.cbz", ("1.jpg", "x"))
    archive(tmp_path / "w/loose.cbz", ("1.jpg", "x"))
    stream = sources.arrivals(spark, f"file://{tmp_path}/w").select("path", "at_root")
    q = stream.writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.path.rpartition("/")[2], r.at_root) for r in spark.table("arrived").collect()} == {("a.cbz", False), ("loose.cbz", True)}
    log = f"file://{tmp_path}/log"
    sources.start_log(spark, log, "now")
    sources.log_progress(spark.createDataFrame([("a",)], "p string"), log)
    assert [r.p for r in sources.progress(spark, log).collect()] == ["a"]
    sources.clear_progress(spark, log)
    assert sources.progress(spark, log).count() == 0


def test_names_that_clean_to_nothing_stay(spark):
    files = shelf(spark, ("r/漫画/第一話.cbz", 9), ("r/漫画/第二話.cbz", 3), ("r/漫画/漫画.cbz", 1), ("r/Foo/012 - Foo ch. 3 -.cbz", 1))
    meta = spark.createDataFrame([], META)
    rules = library.P.RULES - {"comicinfo"}
    assert plan_rows(library.clean(files, meta, rules=rules, profile="batch")) == {("rename", "r/Foo/012 - Foo ch. 3 -.cbz", "r/Foo/Foo ch. 3.cbz")}
    assert plan_rows(library.clean(files, meta, rules=rules)) == set()
    numbered = plan_rows(library.clean(files, meta, rules=rules, number_nameless=True))
    assert numbered == {("rename", f"r/漫画/{a}.cbz", f"r/漫画/漫画 {i}.cbz") for i, a in enumerate(sorted(("第一話", "第二話", "漫画")), 1)}
    dirs = spark.createDataFrame([("w/A/漫画",), ("w/B/Batman",)], "dir_path string")
    assert plan_rows(library.route(dirs, "w", [Rule("source", "a", "m")], {"m": "/out"}, "none")) == {("move", "w/A/漫画", "/out/漫画"), ("skip", "w/B/Batman", None)}
    rows = library.route(spark.createDataFrame([("w/X (EN)/T",)], "dir_path string"), "w", [Rule("source", "* (en)", "m")], {"m": "M", "c": "C"}, "c", cleaned=True)
    assert plan_rows(rows) == {("move", "w/X (EN)/T", "C/T")}


def test_no_plan_deletes_another_work(spark):
    """Whatever is deleted has a file with its key beside it that stays, or the reason says that numbers differ."""
    names = ["Bat ch. 005", "Bat ch. 5", "Bat ch. 05 (x)", "Chapter 1", "Chapter 2", "漫画 1", "漫画 2", "漫", "第", "[a]", "(b)", "012 - Bat ch. 5 -", "Other"]
    files = shelf(spark, *[(f"r/Bat/{n}.cbz", i + 1) for i, n in enumerate(names)])
    for profile in ("live", "batch"):
        plan = library.clean(files, spark.createDataFrame([], META), rules=library.P.RULES - {"comicinfo"}, profile=profile).collect()
        gone = [r for r in plan if r.op == "delete"]
        assert profile == "batch" or not gone
        assert {r.src.rpartition("/")[2] for r in gone if "differ" not in r.reason} <= {f"{n}.cbz" for n in names[:3]} | {"012 - Bat ch. 5 -.cbz"}


def test_merges_plan_what_they_leave_behind(spark):
    files = shelf(spark, ("r/Bat ch. 1/Bat 1.cbz", 1), ("r/BAT ch. 2/Chapter 2.cbz", 2), ("r/BAT ch. 2/notes.txt", 1), ("r/Solo/n.txt", 1))
    got = plan_rows(library.merge_groups(files))
    assert ("delete", "r/BAT ch. 2/notes.txt", None) in got and not any("Solo" in r[1] for r in got)
    assert [(r.to, r.directories, r.archives, r.generic) for r in library.group_counts(files).collect()] == [("r/BAT", 2, 2, 1)]


def test_damaged_archives_are_rows(spark, tmp_path):
    archive(tmp_path / "l/S/good.cbz", ("1.jpg", "x"), xml="<x/>")
    whole = (tmp_path / "l/S/good.cbz").read_bytes()
    (tmp_path / "l/S/cut.cbz").write_bytes(whole[: len(whole) // 2])
    locked = bytearray(whole)
    for at in range(len(locked) - 4):  # the encryption bit of each entry, in its header and in the directory
        if locked[at : at + 4] in (b"PK\x03\x04", b"PK\x01\x02"):
            locked[at + (6 if locked[at + 2] == 3 else 8)] |= 1
    (tmp_path / "l/S/locked.cbz").write_bytes(bytes(locked))
    url = f"file://{tmp_path}/l"
    listed = {(r.path.rpartition("/")[2], r.entry, r.ok) for r in sources.entries(spark, url).collect()}
    assert listed == {("good.cbz", "1.jpg", True), ("good.cbz", "ComicInfo.xml", True), ("locked.cbz", "1.jpg", True), ("locked.cbz", "ComicInfo.xml", True), ("cut.cbz", None, False)}
    read = {r.path.rpartition("/")[2]: (r.xml, r.ok) for r in sources.metadata(spark, url).collect()}
    assert read == {"good.cbz": ("<x/>", True), "locked.cbz": (None, False), "cut.cbz": (None, False)}
    assert {r.src.rpartition("/")[2] for r in library.clean(sources.scan(spark, url), sources.metadata(spark, url)).collect()} <= {"good.cbz"}


def test_a_file_is_never_put_over_itself(tmp_path):
    (tmp_path / "a").write_text("x")
    apply.put(Stores(), str(tmp_path / "a"), str(tmp_path / "a"))
    assert (tmp_path / "a").read_text() == "x"


def test_merged_trees_name_every_file(spark, tmp_path):
    """Chains, directories inside moving ones, a swap, collisions; then the same on disk."""
    root = tmp_path / "l"
    sizes = {"A/1.cbz": 5, "A/in/2.cbz": 3, "B/1.cbz": 5, "B/3.cbz": 1, "C/1.cbz": 4, "C/in/2.cbz": 3, "S/x.cbz": 1, "T/x.cbz": 2, "O/deep/f.cbz": 1, "N/f.cbz": 9, "Z/z.cbz": 1}
    for name, n in sizes.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x" * n)
    files = spark.createDataFrame([(f"{root}/{n}", s) for n, s in sizes.items()], "path string, size long")
    moves = [("A", "B"), ("B", "C"), ("S", "T"), ("T", "S"), ("O/deep", "O/flat"), ("O", "P")]
    plan = library.merge_trees(files, spark.createDataFrame([(f"{root}/{a}", f"{root}/{b}") for a, b in moves], "src string, dest string"))
    short = lambda p: p and p.removeprefix(f"{root}/")
    got = {(r.op, short(r.src), short(r.dest)) for r in plan.collect() if r.op != "merge_dir"}
    assert got == {("move", "A/1.cbz", "C/1.cbz"), ("delete", "B/1.cbz", None), ("delete", "C/1.cbz", None), ("delete", "A/in/2.cbz", None), ("move", "B/3.cbz", "C/3.cbz"), ("move", "S/x.cbz", "T/x.cbz"), ("move", "T/x.cbz", "S/x.cbz"), ("move", "O/deep/f.cbz", "P/flat/f.cbz")}
    assert {(short(r.src), short(r.dest)) for r in plan.where("op = 'merge_dir'").collect()} == {("A", "C"), ("B", "C"), ("S", "T"), ("T", "S"), ("O/deep", "O/flat"), ("O", "P")}
    apply.apply(plan.where("op <> 'merge_dir'"))
    assert {n: len((root / n).read_text()) for n in tree_of(root)} == {"C/1.cbz": 5, "C/3.cbz": 1, "C/in/2.cbz": 3, "T/x.cbz": 1, "S/x.cbz": 2, "P/flat/f.cbz": 1, "N/f.cbz": 9, "Z/z.cbz": 1}
