"""Small cases of the operators, against results worked out by hand or by plain Python."""

import random
import zipfile
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from tidyshelf.functions import names as N
from tidyshelf.operators import gaps, keep, match, ranges, routing, tree
from tidyshelf.sources import apply, files
from tidyshelf.streaming import settle


def as_sets(df):
    return {tuple(r) for r in df.collect()}


def test_gaps(spark):
    rows = [("a", n) for n in (1.0, 2.0, 4.0, 5.0, 9.0)] + [("b", 3.0), ("b", 4.0), ("c", 2.0), ("c", 3.0), ("d", 1.5), ("d", 3.0), ("e", 1.0), ("f", None), ("f", 1.0), ("f", 2.0)]
    found = gaps.report(spark.createDataFrame([(s, n, str(n)) for s, n in rows], "s string, n double, name string"), "s", F.col("n"), "name")
    got = {r.series: (r.missing, r.gap_count, r.unnumbered) for r in found.collect()}
    assert got == {"a": ("3, 6-8", 2, 0), "b": ("1-2", 1, 0), "c": ("1", 1, 0), "d": ("2.5", 1, 0), "f": ("", 0, 1)}


def test_larger_wins_and_ties_keep_what_is_there(spark):
    old = spark.createDataFrame([("k", 5, "old", 0), ("m", 1, "old", 0)], "k string, size long, name string, ord int")
    new = spark.createDataFrame([("k", 5, "new", 1), ("m", 2, "first", 1), ("m", 2, "second", 2), ("n", 1, "only", 1)], "k string, size long, name string, ord int")
    got = {r.k: (r.name, r.replaced) for r in keep.merged(old, new, ["k"], "size", "ord").collect()}
    assert got == {"k": ("old", False), "m": ("first", True), "n": ("only", False)}


def test_free_suffix(spark):
    taken = spark.createDataFrame([("a",), ("a (1)",)], "name string")
    got = {r.name: r.new_name for r in keep.free_suffix(spark.createDataFrame([("a",), ("b",)], "name string"), taken, "name").collect()}
    assert got == {"a": "a (2)", "b": "b"}


def test_renames_see_earlier_ones(spark):
    rows = [("d", "a", "b", 5), ("d", "b", "c", 3), ("d", "c", "c", 9), ("e", "a", "a", 1), ("e", "x", "a", 1)]
    got = {(r.dir_path, r.name): r.outcome for r in keep.renamed_one_by_one(spark.createDataFrame(rows, "dir_path string, name string, new_name string, size long")).collect()}
    assert got == {("d", "a"): "renamed over smaller", ("d", "b"): "discarded", ("d", "c"): "unchanged", ("e", "a"): "unchanged", ("e", "x"): "discarded"}


def test_suspects(spark):
    cases = {"a": (1, 2, 3, 4, 5, 15), "b": (1, 2, 3, 4, 5, 7), "c": (1, 2, 3, 4, 5, 51), "d": (1, 12), "e": (7,), "f": (1, 2, 99)}
    df = spark.createDataFrame([(k, float(n)) for k, v in cases.items() for n in v], "s string, n double")
    assert as_sets(ranges.suspects(df, "s", "n")) == {("a", 15.0, 1.0, 5.0), ("c", 51.0, 5.0, 1.0)}


def test_overlap_and_pages(spark):
    spans = spark.createDataFrame([("s", "r", 1.0, 3.0), ("t", "q", 1.5, 2.0)], "series string, id string, start double, end double")
    singles = spark.createDataFrame([("s", 1.0, "p1"), ("s", 3.0, "p3"), ("s", 3.0, "p4")], "series string, number double, path string")
    assert [(r.id, r.found, r.missing) for r in ranges.overlap(spans, singles, "series").collect()] == [("r", [1.0, 3.0], [2.0])]
    schema = "g string, order int, entry string, ext string, size long"
    a = spark.createDataFrame([("x", 1, "a", ".jpg", 99), ("x", 1, "b", ".jpg", 5), ("x", 1, "c", ".png", 1), ("y", 1, "a", ".jpg", 1)], schema)
    b = spark.createDataFrame([("x", 1, "1", ".png", 10), ("x", 2, "2", ".jpg", 5), ("x", 3, "3", ".jpg", 9)], schema)
    plan = ranges.page_plan(a, b, "g").orderBy("pos").collect()
    assert [(r.winner_entry, r.new_name, r.upgraded) for r in plan] == [("1", "page_0001.png", True), ("b", "page_0002.jpg", False), ("c", "page_0003.png", False)]


def test_globs():
    import re

    for glob, yes, no in (("bat*", "batman", "abat"), ("m.?", "m.x", "m.xy"), ("[ab]c", "ac", "cc"), ("[!ab]c", "cc", "ac"), ("a[", "a[", "ab"), ("x (en)", "x (en)", "x en")):
        assert re.match(routing.glob_regex(glob), yes) and not re.match(routing.glob_regex(glob), no)


def test_routing_takes_the_first_match(spark):
    rules = [routing.Rule("source", "Webtoons*", "manga"), routing.Rule("title", "batman*", "comics"), routing.Rule("source", "w*", "lost")]
    df = spark.createDataFrame([("Webtoons X", "Batman"), ("other", "BATMAN 2"), ("wx", "y"), ("z", "y")], "s string, t string")
    dest = routing.routed(rules, {"source": F.col("s"), "title": F.col("t")}, {"comics": "C", "manga": "M"}, "comics")
    assert [r[0] for r in df.select(dest).collect()] == ["M", "C", "C", "C"]


def test_fuzzy_pairs_equal_a_double_loop(spark):
    random.seed(3)
    words = ["alpha", "alphas", "alpha one", "alpha 1", "beta", "betas two", "gamma ray", "gamma rays", "x"]
    names = [(str(p), random.choice(words) + random.choice(["", "!", " x", "s"])) for p in range(3) for _ in range(25)]
    df = spark.createDataFrame(sorted(set(names)), "parent string, name string")
    clean = lambda s: " ".join("".join(c if c.isalnum() or c.isspace() or c == "_" else " " for c in s.lower()).split())
    want = {(p, a, b) for p, a in set(names) for q, b in set(names) if p == q and a < b and SequenceMatcher(None, clean(a), clean(b)).ratio() >= 0.8}
    got = match.matches(df, "parent", "name")
    assert {(r.parent, r.name_a, r.name_b) for r in got.collect()} == want


def test_greedy_absorbs_only_the_secondary(spark):
    pairs = spark.createDataFrame([("p", "a", "b", 0.99), ("p", "a", "c", 0.95), ("p", "b", "c", 0.93), ("p", "a", "d", 0.85)], "parent string, name_a string, name_b string, ratio double")
    counts = spark.createDataFrame([("p", "a", 5), ("p", "b", 2), ("p", "c", 9), ("p", "d", 1)], "parent string, name string, files long")
    got = [(r.primary_name, r.secondary_name, r.decision) for r in match.greedy(pairs, counts).collect()]
    assert got == [("a", "b", "auto"), ("c", "a", "auto")]


def test_trees(spark):
    df = spark.createDataFrame([("r/a",), ("r/a/b",), ("r/c/d",), ("r/c/d/e/f",)], "dir_path string")
    assert {r[0] for r in tree.series_dirs(df, "dir_path").collect()} == {"r/a", "r/c/d"}
    assert [r[0] for r in spark.createDataFrame([("b10",), ("b9",), ("ComicInfo.xml",), ("A1",)], "x string").orderBy(tree.natural_key(F.col("x"))).collect()] == ["ComicInfo.xml", "A1", "b9", "b10"]
    units = spark.createDataFrame([("b", 1), ("A", 2), ("c", 3)], "dir_name string, mtime int")
    assert ["".join(r.dir_name for r in tree.in_order(units, m).collect()) for m in tree.ORDERS] == ["cAb", "bAc", "Abc", "cbA"]
    dirs = spark.createDataFrame([("l", "Batman ch. 1"), ("l", "BATMAN ch. 2"), ("l", "Solo 1")], "p string, n string")
    assert [tuple(r) for r in tree.groups_by_base(dirs, "p", "n").collect()] == [("l", "batman", 2, "BATMAN")]


def test_places_in_each_order(spark):
    """All rows are placed, over many ranges, with ties and nulls, as the whole sort would number them."""
    rows = [(None if i % 50 == 7 else float(i * 37 % 11), f"{'Ab'[i % 2]}{i % 90:02}", i) for i in range(1500)]
    units = spark.createDataFrame(rows, "mtime double, dir_name string, nr int")
    for sampled in (2000, 300):
        for m in tree.ORDERS:
            want = [r.nr for r in tree.in_order(units, m, tie="nr").collect()]
            got = tree.placed(units, m, tie="nr", ranges=8, sampled=sampled).collect()
            assert [r.nr for r in sorted(got, key=lambda r: r.place)] == want and sorted(r.place for r in got) == list(range(1, 1501))
    assert tree.placed(units.limit(0), "newest").count() == 0


def test_archives(spark, tmp_path):
    (tmp_path / "S").mkdir()
    with zipfile.ZipFile(tmp_path / "S/a ch. 1.cbz", "w") as z:
        z.writestr("2.png", b"xx")
        z.writestr("1.jpg", b"x")
        z.writestr("COMICINFO.xml", b"<ComicInfo><Title>\xff</Title></ComicInfo>")
    (tmp_path / "S/bad.cbz").write_bytes(b"no zip")
    root = f"file://{tmp_path}"
    scanned = files.scan(spark, root).collect()
    assert {(r.stem, r.ext, r.dir_name) for r in scanned} == {("a ch. 1", ".cbz", "S"), ("bad", ".cbz", "S")}
    listed = files.entries(spark, root)
    assert [(r.entry, r.size) for r in files.pages(listed).orderBy("entry").collect()] == [("1.jpg", 1), ("2.png", 2)]
    assert listed.where("not ok").count() == 1
    xml = {r.path.rpartition("/")[2]: r.xml for r in files.metadata(spark, root).collect()}
    assert "�" in xml["a%20ch.%201.cbz" if "a%20ch.%201.cbz" in xml else "a ch. 1.cbz"] and xml["bad.cbz"] is None
    rewriting = spark.createDataFrame([("rewrite", str(tmp_path / "S/a ch. 1.cbz"), "COMICINFO.xml", "<new/>", 1)], "op string, src string, dest string, reason string, size long")
    assert [r.outcome for r in apply.carried_out(rewriting).collect()] == ["done"]
    with zipfile.ZipFile(tmp_path / "S/a ch. 1.cbz") as z:
        assert z.read("COMICINFO.xml") == b"<new/>" and z.namelist()[:2] == ["2.png", "1.jpg"]
    plan = keep.actions(spark.createDataFrame([(str(tmp_path / "S/bad.cbz"),)], "p string"), "delete", F.col("p"), None, "bad")
    apply.apply(plan)
    assert not (tmp_path / "S/bad.cbz").exists()


def test_progress_and_report(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"p": "a"}\n\nnot json\n{"session": "x", "v": 2}\n{"p": "a"}\n{"p": "b"}\n')
    done = files.progress(spark, f"file://{tmp_path}/log.jsonl")
    assert {r.p for r in done.collect()} == {"a", "b"}
    assert [r.p for r in tree.not_done(spark.createDataFrame([("a",), ("c",)], "p string"), done, "p").collect()] == ["c"]


def test_settling_in_batch_and_stream(spark, tmp_path):
    import datetime as dt

    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [("a", t(0), t(-1000)), ("a", t(3), t(-1000)), ("b", t(1), t(0)), ("z", t(5000), t(0))]
    events = spark.createDataFrame(rows, "dir_path string, event_time timestamp, dir_ctime timestamp")
    got = {(r.dir_path, r.events) for r in settle.sessions(events, "dir_path", "event_time").collect()}
    assert got == {("a", 2), ("b", 1), ("z", 1)}
    for i in range(len(rows)):
        spark.createDataFrame(rows[i : i + 1], events.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = settle.ready_directories(stream).writeStream.format("memory").queryName("ready").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    ready = {r.dir_path: (r.ready_at, r.events) for r in spark.table("ready").collect()}
    assert ready["a"] == (t(8), 2) and ready["b"] == (t(300), 1) and "z" not in ready


def test_stability(spark):
    df = spark.createDataFrame([("a", i, s) for i, s in enumerate((1, 2, 2, 2, 3))] + [("b", 0, 1), ("b", 1, 1)], "k string, n int, size int")
    assert as_sets(settle.stable_at(df, "k", "n", "size")) == {("a", 3), ("b", None)}


def test_events_under_work_are_left_out(spark):
    ev = spark.createDataFrame([("w/a/b",), ("w/a",), ("w/ab",)], "dir_path string")
    assert {r[0] for r in settle.outside(ev, spark.createDataFrame([("w/a",)], "dir_path string")).collect()} == {"w/ab"}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "s string, n double, name string")
    assert gaps.report(empty, "s", F.col("n"), "name").count() == 0 and ranges.suspects(empty, "s", "n").count() == 0
    assert match.matches(empty, "s", "name").count() == 0 and tree.series_dirs(empty, "s").count() == 0
    assert empty.select(N.sanitize(F.col("name"))).count() == 0


def test_ranges_of_any_length(spark):
    """Against listing every number; halves, hot series, and a range that no list could hold."""
    import random

    rng = random.Random(11)
    spans, singles = [], []
    for k in range(60):
        s = "hot" if k % 3 else f"s{k % 5}"
        start = rng.choice((0.0, 1.0, 2.5, 7.0, 100.0))
        spans.append((s, f"r{k}", start, start + rng.choice((0, 1, 3, 8, 31, 64, 0.5))))
    spans.append(("hot", "back", 5.0, 3.0))
    for s in ("hot", "s0", "s3"):
        singles += [(s, float(n), f"p{n}") for n in range(0, 140) if rng.random() < 0.9] + [(s, n + 0.5, f"h{n}") for n in range(30)] + [(s, 3.0, "p3b"), (s, 1.25, "odd")]
    a = spark.createDataFrame(spans, "series string, id string, start double, end double")
    b = spark.createDataFrame(singles, "series string, number double, path string")
    has = {}
    for s, n, p in singles:
        has[s, n] = max(p, has.get((s, n), ""))
    want = {}
    for s, i, x, y in spans:
        numbers = [round(x + k, 1) for k in range(int(y - x + 0.001) + 1)] if y >= x else []
        found = [n for n in numbers if (s, n) in has]
        if found:
            want[s, i] = (found, [n for n in numbers if (s, n) not in has])
    got = {(r.series, r.id): (r.found, r.missing) for r in ranges.overlap(a, b, "series").collect()}
    assert got == want
    rows = ranges.members(a, b, "series")
    assert {(r.series, r.id) for r in ranges.whole(rows, "series").collect()} == {k for k, (_, m) in want.items() if not m}
    assert all(r.path == has[r.series, r.number] for r in rows.collect())
    huge = spark.createDataFrame([("s0", "h", 1.0, 9999999999.0), ("s0", "far", 1e300, 2e300), ("s0", "none", 5e5, 6e5)], a.schema)
    few = spark.createDataFrame([("s0", 3.0, "x"), ("s0", 4.0, "y"), ("s0", 9.0, "z")], b.schema)
    [r] = ranges.overlap(huge, few, "series").collect()
    assert (r.found, r.missing, [(x["from"], x["to"]) for x in r.runs]) == ([3.0, 4.0, 9.0], None, [(1.0, 2.0), (5.0, 8.0), (10.0, 9999999999.0)])


def test_a_huge_range_does_not_end_a_plan(spark):
    from tidyshelf.plans import library

    rows = [("l/S/S ch. 1-9999999999.cbz", 1), ("l/S/S ch. 1-2.cbz", 1), ("l/S/S ch. 1.cbz", 1), ("l/S/S ch. 2.cbz", 1)]
    found = files.described(spark.createDataFrame(rows, "path string, size long"))
    entries = spark.createDataFrame([("l/S/S ch. 1-2.cbz", "a.jpg", ".jpg", 1), ("l/S/S ch. 1-2.cbz", "b.jpg", ".jpg", 1), ("l/S/S ch. 1.cbz", "a.jpg", ".jpg", 2), ("l/S/S ch. 2.cbz", "a.jpg", ".jpg", 1)], "path string, entry string, ext string, size long")
    plan, actions = library.resolve_ranges(found, entries)
    assert plan.count() == 2 and sorted(r.op for r in actions.collect()) == ["move", "move", "rewrite"]
    assert [(r.id, r.missing) for r in library.incomplete_ranges(found).collect()] == [("l/S/S ch. 1-9999999999.cbz", "3-9999999999")]


def walked(pairs, files, auto=0.9):
    """The walk over pairs, one after another."""
    gone, out = set(), []
    for ratio, a, b in sorted(pairs, key=lambda x: (-x[0], x[1], x[2])):
        if a in gone or b in gone:
            continue
        p, s = sorted((a, b), key=lambda n: (-files.get(n, 0), -len(n), n))
        if ratio >= auto:
            gone.add(s)
        out.append((p, s, ratio, "auto" if ratio >= auto else "review"))
    return out


def test_absorption_in_rounds_equals_the_walk(spark):
    """Random graphs with ties, and a name that absorbs hundreds in one round."""
    import random

    rng = random.Random(4)
    pairs, counts, want = [], [], set()
    for k in range(12):
        names = [f"n{i}{'x' * rng.randrange(3)}" for i in range(25)]
        files = {n: rng.choice((0, 1, 1, 2, 9)) for n in names if rng.random() < 0.9}
        own = {(a, b): rng.choice((0.8, 0.85, 0.9, 0.92, 0.92, 0.95, 1.0)) for a in names for b in names if a < b and rng.random() < 0.3}
        pairs += [(f"p{k}", a, b, r) for (a, b), r in own.items()]
        counts += [(f"p{k}", n, c) for n, c in files.items()]
        want |= {(f"p{k}", *x) for x in walked([(r, a, b) for (a, b), r in own.items()], files)}
    hub = [(0.9 + i / 10_000, "hub", f"s{i:03}") for i in range(300)]
    pairs += [("h", a, b, r) for r, a, b in hub]
    counts.append(("h", "hub", 5))
    want |= {("h", *x) for x in walked(hub, {"hub": 5})}
    got = match.greedy(spark.createDataFrame(pairs, "parent string, name_a string, name_b string, ratio double"), spark.createDataFrame(counts, "parent string, name string, files long"))
    rows = got.collect()
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want


def test_candidates_lose_nothing_and_are_few(spark, monkeypatch):
    """Equal to the double loop, with crowds dealt to several tasks; far fewer pairs than all."""
    import random
    from difflib import SequenceMatcher

    rng = random.Random(12)
    monkeypatch.setattr(match, "PER_TASK", 7)
    words = ["".join(rng.choice("etaoinshrdlucmfwypvbgkqjxz") for _ in range(rng.randrange(3, 9))) for _ in range(150)]
    names = {" ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))) for _ in range(300)}
    for n in list(names)[:120]:
        at = rng.randrange(len(n))
        names.add(n[:at] + rng.choice("abc ") + n[at + 1 :])
    names |= {"a", "b", "ab", "aa", "é", "日本語の名前"}
    df = spark.createDataFrame([("p", n) for n in sorted(names)], "parent string, name string")
    key = {r.name: r.key for r in df.select("name", N.compare_key(F.col("name")).alias("key")).collect() if r.key}
    want = {(a, b) for a in key for b in key if a < b and SequenceMatcher(None, key[a], key[b]).ratio() >= 0.8}
    assert {(r.name_a, r.name_b) for r in match.matches(df, "parent", "name").collect()} == want
    found = match.candidates(df, "parent", "name")
    assert found.count() == found.distinct().count() < len(key) * (len(key) - 1) / 2 / 20


def test_outermost_directories_and_those_apart(spark):
    """Against all pairs; names that sort between a directory and what lies in it, one directory a third of all rows."""
    import random

    from tidyshelf.operators import nesting

    rng = random.Random(7)
    parts = ["a", "b", "a b", "a!", "a-b", "é", "ab", "z"]
    paths = {"/".join(["w", *(rng.choice(parts) for _ in range(rng.randrange(0, 5)))]) for _ in range(150)} - {"w"}
    inside = lambda x, y: x == y or x.startswith(y + "/")
    rows = [(p,) for p in paths] + [("w/a/b/hot",)] * 80 + [(None,)]
    df = spark.createDataFrame(rows, "d string").repartition(5)
    every = paths | {"w/a/b/hot"}
    assert {r.d for r in nesting.outermost(df, "d").collect()} == {p for p in every if not any(q != p and inside(p, q) for q in every)}
    assert nesting.outermost(df.union(spark.createDataFrame([("w/",)], "d string")), "d").collect()[0].d == "w"
    for k in (0, 1, 12):
        busy = rng.sample(sorted(every), k)
        got = [r.d for r in nesting.apart(df, spark.createDataFrame([(b,) for b in busy], "x string"), "d").collect()]
        assert sorted(got, key=str) == sorted((d for (d,) in rows if d is None or not any(inside(d, b) or inside(b, d) for b in busy)), key=str)


def test_only_chained_files_are_walked(spark, monkeypatch):
    """Components against the walk over whole directories; chains, circles and trees into them; only theirs go to Python."""
    import random

    rng = random.Random(9)
    rows = []
    for d in range(25):
        names = [f"f{i:02}" for i in range(14)]
        rows += [(f"d{d}", n, rng.choice([*names, "x", "y", n, n, n]), rng.randrange(1, 6)) for n in names if rng.random() < 0.8]
    rows += [("circle", f"c{i:02}", f"c{(i + 1) % 12:02}", i) for i in range(12)] + [("circle", "into", "c03", 9), ("circle", "own", "own", 1), ("circle", "free", "new", 1)]
    rows += [("long", f"{i:04}", f"{i + 1:04}", i % 7) for i in range(200)] + [("large", f"n{i}", f"m{i % 50}", i % 11) for i in range(400)] + [("large", "p", "q", 1), ("large", "q", "r", 2)]

    def walk(files):
        holder, lost, out = {n: s for n, _, s in files}, set(), {}
        for n, new, s in sorted(files):
            if new == n:
                out[n] = "replaced" if n in lost else "unchanged"
            elif new not in holder:
                out[n], holder[new] = "renamed", holder.pop(n)
            elif holder[n] > holder[new]:
                out[n], holder[new] = "renamed over smaller", holder.pop(n)
                lost.add(new)
            else:
                out[n] = "discarded"
                holder.pop(n)
        return out

    want = {(d, n, o) for d in {r[0] for r in rows} for n, o in walk([r[1:] for r in rows if r[0] == d]).items()}
    walked = []
    real = keep.in_turn
    monkeypatch.setattr(keep, "in_turn", lambda df: (walked.append(df), real(df))[1])
    df = spark.createDataFrame(rows, "dir_path string, name string, new_name string, size int")
    for whole in (0, 20, 1000):
        got = {(r.dir_path, r.name, r.outcome) for r in keep.renamed_one_by_one(df, whole).collect()}
        assert got == want
    assert [w.where("dir_path = 'large'").count() for w in walked] == [2, 2, 402]


def test_resumed_runs_skip_what_is_done(spark, monkeypatch):
    """By bitmaps, few and many hits, and by the plain join; null paths, repeated lines, an empty log."""
    todo = spark.createDataFrame([(f"p/{i}", i) for i in range(3000)] + [(None, -1), ("p/7", 7)], "path string, __bits int")
    done = spark.createDataFrame([(f"p/{i}",) for i in range(0, 9000, 3)] + [("p/3",), (None,)], "path string")
    want = sorted([(f"p/{i}", i) for i in range(3000) if i % 3] + [(None, -1), ("p/7", 7)], key=str)
    for name, most in (("MOST_PATHS", 100_000), ("MOST_PATHS", 10), ("MOST_BITMAPS", 0)):
        monkeypatch.setattr(tree, name, most)
        got = tree.not_done(todo.withColumnRenamed("__bits", "n"), done, "path")
        assert got.columns == ["path", "n"] and sorted(map(tuple, got.collect()), key=str) == want
    assert tree.not_done(todo.withColumnRenamed("__bits", "n"), done.limit(0), "path").count() == todo.count()


def test_compacted_logs(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    for _ in range(3):
        files.log_progress(spark.createDataFrame([("a",), ("b",)], "p string"), log)
    files.compact_progress(spark, log)
    assert sorted(r.p for r in files.progress(spark, log).collect()) == ["a", "b"] and spark.read.text(log).count() == 2


def test_long_digit_runs_and_null_keys(spark):
    names = ["a2", "a10", "a" + "0" * 30 + "3", "a" + "1" * 23, "a" + "1" * 22 + "2", "a" + "9" * 21, "a-1", "b1", "ComicInfo.xml"]
    df = spark.createDataFrame([(n,) for n in names], "n string").withColumn("k", tree.natural_key(F.col("n")))
    assert [r.n for r in df.orderBy("k").collect()] == ["ComicInfo.xml", "a-1", "a2", "a" + "0" * 30 + "3", "a10", "a" + "9" * 21, "a" + "1" * 23, "a" + "1" * 22 + "2", "b1"]
    rows = spark.createDataFrame([(None, "x", 1), (None, "y", 2), ("k", "z", 1)], "key string, name string, size int")
    assert [r.name for r in keep.losers(rows, ["key"], "size", "name").collect()] == ["x"]


def test_few_and_crowded_series_alike(spark):
    """Series with few numbers meet their ranges as they are, crowded ones by intervals; neither way shuffles more than once for each step."""
    rng = random.Random(11)
    spans = [(f"s{s}", f"r{i}", float(a), float(a + rng.randrange(30))) for s in range(3) for i in range(20) for a in [rng.randrange(-5, 60)]] + [("s0", "big", 0.0, 9999999999.0)]
    numbers = [(f"s{s}", float(n), f"p{n}") for s in range(3) for n in rng.sample(range(80), (5, 30, 60)[s])]
    a, b = spark.createDataFrame(spans, "series string, id string, start double, end double"), spark.createDataFrame(numbers, "series string, number double, path string")
    found = [sorted(map(tuple, ranges.members(a, b, "series", few=few).collect())) for few in (64, 40, 0)]
    assert found[0] == found[1] == found[2] and found[0]
    want = sorted((s, i, n) for s, i, x, y in spans for t, n, _ in numbers if s == t and x <= n <= y)
    assert sorted((r[0], r[1], r[6]) for r in found[0]) == want
    plan = ranges.missing_runs(ranges.members(a, b, "series"), "series")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "explode(aggregate" not in plan  # it was five joins, and some sixty cells for the big range


def test_tasks_of_renames_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(keep.tasks_for, "__defaults__", (10,))
    df = spark.createDataFrame([(f"d{i % 50}", f"{i:04d}", f"{i + 50:04d}", i) for i in range(400)], "dir_path string, name string, new_name string, size long")
    out = keep.renamed_one_by_one(df)
    assert out.count() == 400
    assert ", 40), REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()  # it was the session's number, whatever the rows
