"""Whole jobs over a library, as plans: tables in, actions out (op, src, dest, reason, size).

files: as ``sources.files.scan`` gives them; metadata: (path, entry_name, xml); entries: as ``sources.files.entries``. A plan
describes the state it was given; a sink carries it out. Each function is one tool's work; options are keyword arguments.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import patterns as P
from ..functions import tags as G
from ..operators import gaps, keep, match, nesting, ranges, routing, tree
from ..session import fixed
from ..sources.files import is_image, stale
from ..streaming import settle


def union(*plans: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, plans)


def under(directory: Column, name: Column) -> Column:
    return F.concat(directory, F.lit("/"), name)


def or_else(cleaned: Column, name: Column | str) -> Column:
    """The cleaned name, or the old one where cleaning leaves nothing."""
    return F.coalesce(F.nullif(cleaned, F.lit("")), name)


def with_new_name(rows: DataFrame, rules: frozenset[str], profile: str, number_nameless: bool = False) -> DataFrame:
    """Adds new_dir and new_name. Steps are columns of their own, so that each is computed once.

    A file of whose stem nothing is left keeps its name; with ``number_nameless`` it takes its directory's, numbered by name
    where there are several such files.
    """
    rows = rows.withColumn("new_dir", N.clean_directory(F.col("dir_name"))).withColumn("__stem", N.sanitize(F.col("stem"), rules))
    rows = rows.withColumns({"new_dir": or_else(F.col("new_dir"), "dir_name"), "__nameless": F.col("__stem") == ""})
    if "leading_nums" in rules and profile == "batch":
        rows = rows.withColumn("__stem", N.strip(N.without(F.col("__stem"), P.LEADING_NUMBER[profile])))
    if "normalize_stem" in rules:
        rows = rows.withColumn("__stem", N.normal_stem(F.col("__stem"), F.col("new_dir"), profile))
    if "number_tokens" in rules:
        rows = rows.withColumn("__stem", N.number_tokens(F.col("__stem")))
    if "trailing_junk" in rules and profile == "batch":
        rows = rows.withColumn("__stem", N.strip(N.without(F.col("__stem"), P.TRAILING_JUNK)))
    kept = F.when(F.col("__nameless") | (F.col("__stem") == ""), F.col("name")).otherwise(F.concat("__stem", "ext"))
    if number_nameless:
        w = W.partitionBy("dir_path", "__nameless")
        nth, several = F.row_number().over(w.orderBy("name")), F.count(F.lit(1)).over(w) > 1
        kept = F.when(F.col("__nameless"), F.concat("new_dir", F.when(several, F.concat(F.lit(" "), nth)).otherwise(""), "ext")).otherwise(kept)
    return rows.withColumn("new_name", kept).drop("__stem", "__nameless")


def contested(rows: DataFrame, directory: str, profile: str = "batch") -> DataFrame:
    """Adds ``stays`` and settles new_name where several files of a directory would take one name.

    batch: the largest gets it, of equals the file that has it, then the first; the others do not stay. live: the file that
    has the name, else the first, gets it; the others keep their own names.
    """
    has_it, by_name = (F.col("name") == F.col("new_name")).desc(), [F.lower("name"), F.col("name"), F.col("path")]
    order = [F.desc("size"), has_it, *by_name] if profile == "batch" else [has_it, *by_name]
    first = F.row_number().over(W.partitionBy(directory, "new_name").orderBy(*order)) == 1
    rows = rows.withColumn("stays", first)
    if profile == "batch":  # a name that says nothing may stand for several numbers
        of_name = W.partitionBy(directory, "new_name")
        number = N.chapter(F.col("stem"))
        rows = rows.withColumn("risky", F.coalesce(F.min(number).over(of_name) < F.max(number).over(of_name), F.lit(False)))
    if profile == "live":
        rows = rows.withColumns({"new_name": F.when(F.col("stays"), F.col("new_name")).otherwise(F.col("name")), "stays": F.lit(True)})
    return rows


def name_actions(rows: DataFrame) -> DataFrame:
    """Renames inside directories, and the files that lose theirs to a larger one."""
    moves = rows.where("stays and name <> new_name")
    return union(
        keep.actions(moves, "rename", F.col("path"), under(F.col("dir_path"), F.col("new_name")), "cleaned name", F.col("size")),
        keep.actions(rows.where("not stays"), "delete", F.col("path"), None, smaller_reason(rows), F.col("size")),
    )


def smaller_reason(rows: DataFrame) -> Column:
    plain = F.lit("smaller file of the same name")
    return F.when(F.col("risky"), F.lit("smaller file of the same name, numbers differ")).otherwise(plain) if "risky" in rows.columns else plain


def with_ranges(rows: DataFrame, directory: str) -> DataFrame:
    """Adds start and end; files whose number reads as a range of their directory's numbers get the range's name.

    Judged by new_name. Of files with one number the last counts; a file that has the range's name already wins over an
    equally large one. rows: contested; those that do not stay take no part.
    """
    rows = fixed(rows.withColumn("number", F.when(F.col("stays"), N.chapter(N.stem(F.col("new_name"))))))
    numbered = rows.where("number is not null")
    last = numbered.groupBy(directory, "number").agg(F.max_by("path", F.struct("new_name", "path")).alias("path"))
    found = ranges.suspects(last, directory, "number").withColumnRenamed("suspect", "number").join(last, [directory, "number"]).select("path", "start", "end")
    rows = rows.join(found, "path", "left")
    name = F.concat(N.renamed_for_range(N.stem(F.col("new_name")), F.col("start"), F.col("end")), N.suffix(F.col("new_name")))
    rows = rows.withColumn("new_name", F.when(F.col("start").isNull(), F.col("new_name")).otherwise(name))
    again = W.partitionBy(directory, "new_name", "stays").orderBy(F.desc("size"), F.col("start").isNull().desc(), "path")
    return rows.withColumn("stays", F.col("stays") & (F.row_number().over(again) == 1)).drop("number")


def directory_actions(files: DataFrame, dirs: DataFrame) -> DataFrame:
    """dirs: (dir_path, to). The first directory takes a free name; the others, and those whose name is taken, are merged."""
    taken = files.select(F.col("dir_path").alias("to")).distinct().withColumn("taken", F.lit(True))
    moved = dirs.where("to <> dir_path").join(taken, "to", "left")
    nth = F.row_number().over(W.partitionBy("to").orderBy("dir_path"))
    op = F.when(F.col("taken").isNull() & (nth == 1), "rename").otherwise("merge_dir")
    return keep.actions(moved.withColumn("op", op), F.col("op"), F.col("dir_path"), F.col("to"), "cleaned directory")


def clean(files: DataFrame, metadata: DataFrame, done: DataFrame | None = None, rules: frozenset[str] = P.RULES, profile: str = "live", number_nameless: bool = False) -> DataFrame:
    """Clean names and metadata: directories, then files in them, then documents, then numbers that are ranges.

    The live profile deletes nothing. In the batch profile files of a directory that come to one name contest it, and the
    reason says where their numbers differ; a name that cleans to nothing stays (see ``with_new_name``).

    Names are settled as the directories will be once they are renamed and merged. Each file has at most one rename or
    delete and one rewrite, by its path of now; the live profile looks for no ranges. Files of size 0, and those an earlier
    run has done, are left alone. Names and who keeps them are worked out once, and written to the checkpoint folder.
    """
    todo = files.where((F.col("size") > 0) & (F.col("ext") == ".cbz"))
    if done is not None:
        todo = tree.not_done(todo, done.withColumnRenamed("p", "path"), "path")
    todo = fixed(with_new_name(todo, rules, profile, number_nameless).withColumn("to", under(F.col("parent_path"), F.col("new_dir"))))
    rows = contested(todo, "to", profile)
    rows = fixed(with_ranges(rows, "to")) if profile == "batch" else rows.withColumns({"start": F.lit(None).cast("double"), "end": F.lit(None).cast("double")})
    plans = [directory_actions(files, todo.select("dir_path", "to").distinct()), name_actions(rows)]
    if "comicinfo" in rules:
        rows = rows.where("stays").join(readable(metadata), "path", "left").where("readable is null or readable").drop("readable")
        rows = G.retagged(rows, "xml", "stem", "new_dir", profile, rules)
        plans.append(rewrites(rows.withColumn("new_xml", F.coalesce("new_xml", "xml"))))
    return union(*plans)


def readable(metadata: DataFrame) -> DataFrame:
    """(path, entry_name, xml, readable): damaged archives are told apart from those without a document, which get one."""
    ok = F.col("ok") if "ok" in metadata.columns else F.lit(True)
    return metadata.select("path", "entry_name", "xml", ok.alias("readable"))


def rewrites(rows: DataFrame) -> DataFrame:
    """Documents that change, those of range archives with the range as their number. rows: (path, size, entry_name, xml, new_xml, start, end).

    The condition on a row number keeps the filter above the steps, where Catalyst would else repeat them in it.
    """
    xml = F.when(F.col("start").isNull() | F.col("new_xml").isNull(), F.col("new_xml")).otherwise(G.set_range(F.col("new_xml"), F.col("start"), F.col("end")))
    rows = rows.withColumn("new_xml", xml).withColumn("__row", F.monotonically_increasing_id())
    changed = rows.where((F.col("__row") >= 0) & F.col("new_xml").isNotNull() & ~F.col("new_xml").eqNullSafe(F.col("xml")))
    return keep.actions(changed, "rewrite", F.col("path"), F.coalesce("entry_name", F.lit("ComicInfo.xml")), F.col("new_xml"), F.col("size"))


def range_names(files: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """Files whose number reads as a range get the range's name, and with metadata the range as their document's number."""
    rows = with_ranges(files.withColumns({"new_name": F.col("name"), "stays": F.lit(True)}), "dir_path")
    if metadata is None:
        return name_actions(rows)
    marked = rows.where("stays and start is not null").join(metadata.select("path", "entry_name", "xml"), "path")
    return union(name_actions(rows), rewrites(marked.withColumn("new_xml", F.col("xml"))))


def strip_repeats(files: DataFrame) -> DataFrame:
    """Names with repeated tokens, cleaned."""
    rows = files.where(F.col("ext") == ".cbz").withColumn("new_name", F.concat(N.without_repeats(F.col("stem")), F.col("ext")))
    holders = rows.select("dir_path", "new_name").where(F.col("new_name") != "").distinct()
    return name_actions(contested(rows.join(holders, ["dir_path", "new_name"], "left_semi"), "dir_path"))


def deduplicate(files: DataFrame) -> DataFrame:
    """Of archives with one key in a directory the largest stays; old-format files whose key exists as .cbz go.

    The key drops dots and hyphens, so 1.5 and 15 are one; the reason says where numbers differ.
    """
    rows = files.withColumn("key", N.dedup_key(F.col("stem")))
    archives = rows.where(F.col("ext") == ".cbz").withColumn("number", N.chapter_text(F.col("stem")))
    smaller = keep.losers(archives, ["dir_path", "key"], "size", "name")
    several = archives.groupBy("dir_path", "key").agg(F.min("number").alias("a"), F.max("number").alias("b")).where("a <> b").select("dir_path", "key", F.lit(True).alias("risky"))
    smaller = smaller.join(several, ["dir_path", "key"], "left")
    reason = F.when(F.col("risky"), "smaller duplicate, numbers differ").otherwise("smaller duplicate")
    old = tree.format_pairs(rows, "dir_path", "key", "ext", ".cbr", ".cbz")
    return union(
        keep.actions(smaller, "delete", F.col("path"), None, reason, F.col("size")), keep.actions(old, "delete", F.col("path"), None, "exists as .cbz", F.col("size"))
    )


def pack_folders(files: DataFrame, root: str | None = None) -> DataFrame:
    """Bare image folders become archives beside them, unless one is there; with a root only its own children."""
    rows = files.withColumns({"image": is_image(F.col("ext"), "dedup"), "meta": F.lower("name") == "comicinfo.xml"})
    has_children = files.select(F.col("parent_path").alias("dir_path")).distinct()
    folders = tree.image_folders(rows, "dir_path", F.lit(False), F.col("image"), F.col("meta")).join(has_children, "dir_path", "left_anti")
    if root is not None:
        folders = folders.where(F.regexp_replace("dir_path", r"/[^/]*$", "") == root)
    folders = folders.withColumn("to", F.concat("dir_path", F.lit(".cbz")))
    folders = folders.join(files.select(F.col("path").alias("to")), "to", "left_anti")
    return keep.actions(folders, "pack", F.col("dir_path"), F.col("to"), F.concat("entries", F.lit(" entries")))


def merged_directories(files: DataFrame) -> DataFrame:
    """(dir_path, up, top_name, to, canonical): directories in or below one of a group of siblings, and where they go."""
    dirs = files.select("dir_path").distinct().select("dir_path", F.explode(F.concat(tree.ancestors(F.col("dir_path")), F.array("dir_path"))).alias("up")).where("up <> ''")
    split = {"parent_path": F.regexp_replace("up", r"/[^/]*$", ""), "top_name": F.substring_index("up", "/", -1)}
    dirs = dirs.withColumns(split).withColumn("base", N.base_name(F.col("top_name"))).where("base is not null")
    groups = tree.groups_by_base(dirs.select("parent_path", "top_name").distinct(), "parent_path", "top_name").withColumnRenamed("parent", "parent_path")
    found = dirs.join(groups, ["parent_path", "base"]).withColumn("to", under(F.col("parent_path"), F.col("canonical")))
    return found.groupBy("dir_path").agg(F.min_by(F.struct("up", "top_name", "to", "canonical"), F.length("up")).alias("top")).select("dir_path", "top.*")


def group_counts(files: DataFrame) -> DataFrame:
    """(to, directories, archives, generic): what a merge of each group would take together, without doing it."""
    inside = merged_directories(files)
    generic = N.is_generic_stem(F.col("stem")) & (F.col("dir_path") == F.col("up"))
    rows = files.where(F.col("ext") == ".cbz").join(inside, "dir_path")
    return rows.groupBy("to").agg(F.countDistinct("up").alias("directories"), F.count(F.lit(1)).alias("archives"), F.count_if(generic).alias("generic"))


def merge_groups(files: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """Sibling directories that differ by a number token become one; generic files take their directory's name first.

    Files of directories below go along, all into the one directory. The directory that has the name already keeps its
    names; of equal names the largest file stays, of equals the one that is there. Then numbers that read as ranges, and
    with metadata the documents: series, title, volume and number by the names that files have in the merged directory.
    Only archives are merged: each other file of a directory that ends is a deletion of its own.
    """
    inside = fixed(merged_directories(files))
    rows = files.where(F.col("ext") == ".cbz").join(inside, "dir_path")
    generic = N.is_generic_stem(F.col("stem")) & (F.col("dir_path") == F.col("up")) & (F.col("up") != F.col("to"))
    w = W.partitionBy("dir_path", generic)
    nth, several = F.row_number().over(w.orderBy("name")), F.count(F.lit(1)).over(w) > 1
    named = F.when(generic, F.concat("top_name", F.when(several, F.concat(F.lit(" "), nth)).otherwise(""), F.col("ext"))).otherwise(F.col("name"))
    best = W.partitionBy("to", "new_name").orderBy(F.desc("size"), (F.col("dir_path") == F.col("to")).desc(), "path")
    rows = rows.withColumn("new_name", named).withColumn("stays", F.row_number().over(best) == 1)
    rows = fixed(with_ranges(rows.withColumn("merged_stem", N.stem(F.col("new_name"))), "to").withColumn("dest", under(F.col("to"), F.col("new_name"))))
    plans = [
        keep.actions(rows.where("stays and path <> dest"), "move", F.col("path"), F.col("dest"), "merged series", F.col("size")),
        keep.actions(rows.where("not stays"), "delete", F.col("path"), None, "smaller file of the same name", F.col("size")),
        keep.actions(files.where(F.col("ext") != ".cbz").join(inside.where("up <> to"), "dir_path"), "delete", F.col("path"), None, "left in a merged directory", F.col("size")),
    ]
    if metadata is not None:
        tagged = rows.where("stays").join(readable(metadata), "path", "left").where("readable is null or readable")
        plans.append(rewrites(G.series_tags(tagged, "xml", "merged_stem", "canonical")))
    return union(*plans)


def final_targets(moves: DataFrame) -> DataFrame:
    """(src, dest): where directories end that move into one that moves itself; on a circle each moves one step.

    moves: (src, dest), each src once.
    """
    way = moves.where("src <> dest").select(F.lit("").alias("dir_path"), F.col("src").alias("name"), F.col("dest").alias("new_name"), F.lit(0).cast("long").alias("size"))
    found = fixed(keep.in_components(way))
    sources = found.select(F.col("name").alias("component"), F.lit(True).alias("moves"))
    ends = F.when(F.col("moves").isNull(), F.col("component")).otherwise(F.col("new_name"))
    return found.join(sources, "component", "left").select(F.col("name").alias("src"), ends.alias("dest"))


def merge_trees(files: DataFrame, moves: DataFrame, depth: int = 16) -> DataFrame:
    """Directories merged into others, as a row for each file that moves, gives way or stays behind.

    files: (path, size) of everything that may be met; moves: (src, dest). A file goes by its relative path with the innermost
    directory that moves, then with those around it. Of all files that come to one path, moved or there already, the largest stays, of
    equals the one that is there, then the first; the others are deletions. Directories follow as merge_dir rows, empty by then.
    """
    targets = fixed(final_targets(moves))
    rows = files.select("path", "size", F.col("path").alias("at"), F.lit(None).cast("string").alias("last"))
    for _ in range(depth):  # one round for each directory that moves around another
        up = F.explode(tree.ancestors(F.col("at"))).alias("src")
        inner = rows.select("path", "last", up).join(targets, "src").where(F.col("last").isNull() | (F.col("last").startswith(F.concat("src", F.lit("/")))))
        inner = inner.groupBy("path").agg(F.max_by(F.struct("src", "dest"), F.length("src")).alias("m"))
        step = rows.join(inner, "path", "left")
        moved = F.concat(F.col("m")["dest"], F.col("at").substr(F.length(F.col("m")["src"]) + 1, F.length("at")))
        after = fixed(step.select("path", "size", F.coalesce(moved, "at").alias("at"), F.coalesce(F.col("m")["src"], "last").alias("last"), F.col("m").isNotNull().alias("went")))
        rows = after.drop("went")
        if not after.where("went").limit(1).count():
            break
    stays = F.col("path") == F.col("at")
    best = rows.groupBy("at").agg(F.min_by("path", F.struct(-F.col("size"), ~stays, "path")).alias("winner"), F.count(F.lit(1)).alias("n"))
    met = rows.join(best, "at")
    lost = F.col("path") != F.col("winner")
    return union(
        keep.actions(met.where(~lost & ~stays), "move", F.col("path"), F.col("at"), "merged directory", F.col("size")),
        keep.actions(met.where(lost), "delete", F.col("path"), None, F.when(stays, "a larger file takes its place").otherwise("a file as large has its place"), F.col("size")),
        keep.actions(targets, "merge_dir", F.col("src"), F.col("dest"), "merged directory"),
    )


def tag_numbers(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """The number tag from each file's name; files without a number are not read, unchanged documents not written."""
    rows = files.withColumn("number", N.chapter_text(F.col("stem"))).where("number is not null").join(metadata.where("xml is not null"), "path")
    rows = rows.withColumn("new_xml", G.set_number(F.col("xml"), F.col("number"))).where("new_xml <> xml")
    return keep.actions(rows, "rewrite", F.col("path"), F.col("entry_name"), F.col("new_xml"), F.col("size"))


def match_series(files: DataFrame, auto: float = P.AUTO_RATIO) -> DataFrame:
    """Sibling directories of nearly the same name: merged by themselves, or listed for review."""
    counts = files.where(F.col("ext") == ".cbz").groupBy(F.col("parent_path").alias("parent"), F.col("dir_name").alias("name")).agg(F.count(F.lit(1)).alias("files"))
    pairs = match.greedy(match.matches(counts, "parent", "name", auto=auto), counts, auto)
    op = F.when(F.col("decision") == "auto", "merge_dir").otherwise("skip")
    return keep.actions(pairs, op, under(F.col("parent"), F.col("secondary_name")), under(F.col("parent"), F.col("primary_name")), F.format_string("ratio %.3f", F.col("ratio")))


def resolve_ranges(files: DataFrame, entries: DataFrame, processed: str = "Processed") -> tuple[DataFrame, DataFrame]:
    """(page plans, actions): range archives rebuilt from the better pages, the single archives moved away.

    Only where every number of the range exists singly and the page counts agree. What files and pages a plan is made of is
    written to the checkpoint folder once.
    """
    start, end = N.number_range(F.col("stem"))
    rows = files.where(F.col("ext") == ".cbz").select("dir_path", "path", start.alias("start"), end.alias("end"), N.chapter(F.col("stem")).alias("number"))
    rows = fixed(rows)
    spans = rows.where("start is not null").select(F.col("dir_path").alias("series"), F.col("path").alias("id"), "start", "end")
    singles = rows.where("start is null and number is not null").select(F.col("dir_path").alias("series"), "number", "path")
    parts = fixed(ranges.whole(ranges.members(spans, singles, "series"), "series").select("series", "id", "number", "path"))
    theirs = parts.select("path", F.col("id").alias("group"), F.lit(False).alias("mine"), F.col("number").alias("order"))
    sides = theirs.unionByName(parts.select(F.col("id").alias("path"), F.col("id").alias("group"), F.lit(True).alias("mine"), F.lit(0.0).alias("order")).distinct())
    pages = entries.where(is_image(F.col("ext"))).join(sides, "path").withColumn("entry", F.concat_ws("!", "path", "entry"))
    plan = fixed(ranges.better_pages(pages.select("group", "mine", "order", "entry", F.struct("entry", "ext", "size").alias("page")), "group"))
    better = plan.groupBy("group").agg(F.count_if("upgraded").alias("upgraded"), F.max("total_pages").alias("pages"))
    rebuilt = keep.actions(better.where("upgraded > 0"), "rewrite", F.col("group"), None, F.format_string("%d of %d pages", F.col("upgraded"), F.col("pages")))
    name = F.substring_index("path", "/", -1)
    moved = keep.actions(parts.join(better.select(F.col("group").alias("id")), "id"), "move", F.col("path"), F.concat_ws("/", "series", F.lit(processed), name), "in a range archive")
    return plan, union(rebuilt, moved)


def incomplete_ranges(files: DataFrame) -> DataFrame:
    """(series, id, missing): runs of chapters that a range archive holds and no single archive does, where some single one does."""
    start, end = N.number_range(F.col("stem"))
    rows = files.where(F.col("ext") == ".cbz").select(F.col("dir_path").alias("series"), F.col("path").alias("id"), start.alias("start"), end.alias("end"), N.chapter(F.col("stem")).alias("number"))
    rows = fixed(rows)
    singles = rows.where("start is null and number is not null").select("series", "number", F.col("id").alias("path"))
    return ranges.missing_runs(ranges.members(rows.where("start is not null"), singles, "series"), "series").select("series", "id", "missing")


def separate_marked(files: DataFrame, check: str = "_Check", side: str = "both") -> DataFrame:
    """Directories with a marker word and their plain twins, moved together for a look: marked, plain or both.

    Names that are taken there, or wanted twice, get a number.
    """
    every = files.select("dir_path", "parent_path", "dir_name").distinct()
    dirs = every.where((F.col("dir_name") != check) & (F.substring_index("parent_path", "/", -1) != check))
    pairs = tree.marker_pairs(dirs, "dir_name").where("plain is not null")
    names = {"marked": ["marked"], "plain": ["plain"], "both": ["marked", "plain"]}[side]
    chosen = union(*(pairs.select(F.col(n).alias("dir_name")) for n in names)).distinct()
    rows = dirs.join(chosen, "dir_name").withColumn("to_dir", F.concat_ws("/", "parent_path", F.lit(check)))
    taken = every.where(F.substring_index("parent_path", "/", -1) == check).select(F.col("parent_path").alias("to_dir"), "dir_name")
    rows = keep.free_suffix(rows, taken, "dir_name", ["to_dir"], "dir_path").where("new_name is not null")
    return keep.actions(rows, "move", F.col("dir_path"), F.concat_ws("/", "to_dir", "new_name"), "marked pair")


def gap_report(files: DataFrame, root: str | None = None, mode: str = "mixed") -> DataFrame:
    """Gaps of every series directory, in report order.

    mode: ``series`` takes the root as one series, ``folder`` the series in it, ``mixed`` both.
    """
    archives = files.where(F.col("ext") == ".cbz")
    series = tree.series_dirs(archives, "dir_path", root)
    if root is not None:
        own = archives.where(F.col("dir_path") == root).select("dir_path").distinct()
        series = {"series": own, "folder": series, "mixed": series.union(own)}[mode]
    rows = files.where(F.col("ext") == ".cbz").join(series, "dir_path", "left_semi")
    found = gaps.report(rows, "dir_path", N.issue_number(F.col("stem")), "name")
    return gaps.in_report_order(found.withColumns({"path": F.col("series"), "series": F.substring_index("series", "/", -1)}))


def leftovers(files: DataFrame) -> DataFrame:
    return keep.actions(files.where(stale(F.col("name"))), "delete", F.col("path"), None, "left by an interrupted rewrite", F.col("size"))


def route(dirs: DataFrame, root: str, rules: list[routing.Rule], destinations: dict[str, str], default: str, cleaned: bool = False) -> DataFrame:
    """Settled directories to their destination, by the raw names of the source they came from and of themselves.

    With ``cleaned`` rules see cleaned names. A name that cleans to nothing stays; without a destination nothing moves.
    Of directories inside each other the outermost moves, and the others with it; repeated ones move once.
    """
    raw = F.substring_index("dir_path", "/", -1)
    rows = nesting.outermost(dirs, "dir_path").withColumns({"__title": raw, "__source": routing.source_name(F.col("dir_path"), root)})
    rows = rows.withColumn("__name", or_else(N.clean_directory(F.col("__title")), F.col("__title")))
    if cleaned:
        rows = rows.withColumns({"__title": F.col("__name"), "__source": or_else(N.clean_directory(F.col("__source")), F.col("__source"))})
    dest = routing.routed(rules, {"source": F.col("__source"), "title": F.col("__title")}, destinations, default)
    rows = rows.withColumn("__dest", F.nullif(dest, F.lit("")))
    known = F.col("__dest").isNotNull()
    reason = F.when(known, "routed").otherwise("no destination")
    return keep.actions(rows, F.when(known, "move").otherwise("skip"), F.col("dir_path"), under(F.col("__dest"), F.col("__name")), reason)


def ingest(ready: DataFrame, plan: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame], None], checkpoint: str, busy: Callable[[], DataFrame] | None = None):
    """The streaming job: each batch of settled directories through a plan to a sink. Restarts go on from the checkpoint.

    busy: gives (dir_path) of directories that other jobs work on; batches go on without those that overlap them.
    """
    free = lambda batch: batch if busy is None else settle.outside(batch, busy())
    return ready.writeStream.foreachBatch(lambda batch, _: sink(plan(free(batch)))).option("checkpointLocation", checkpoint).outputMode("append")
