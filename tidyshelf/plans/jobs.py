"""Whole jobs and file sources as queries: libraries are made up from the driver's tables, plans are compared with SQL.

Parts are files and brands their directories; names are dressed up so that every rule has something to do.
"""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import patterns as P
from ..functions import tags as G
from ..operators import keep, nesting, routing, tree
from ..session import shared_folder, table
from ..sources import files as sources
from ..streaming import settle
from . import library
from .catalog import GAPS_SQL, query


def part_key() -> Column:
    return F.col("p_partkey")


def part_size() -> Column:
    return F.col("p_size")


def price() -> Column:
    return F.floor(F.col("p_retailprice") * 10)


def text(*parts) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def one_of(number: Column, *choices) -> Column:
    """The choice of each remainder of number."""
    out = F.when(number % len(choices) == 0, choices[0])
    for i, c in enumerate(choices[1:-1], 1):
        out = out.when(number % len(choices) == i, c)
    return out.otherwise(choices[-1])


def shelf(rows: DataFrame, directory: Column, name: Column, size: Column) -> DataFrame:
    """Files as a scan gives them; of rows with one path the largest."""
    found = rows.select(text(directory, "/", name).alias("path"), size.cast("long").alias("size"))
    return sources.described(found.groupBy("path").agg(F.max("size").alias("size")))


# ---- cleaning, routing, merging

CLEAN_FILES_SQL = """
  SELECT p_brand AS b, 'lib/' || p_brand || CASE WHEN p_size % 2 = 0 THEN ' (y)' ELSE ' [x]' END AS d, CAST(floor(p_retailprice * 10) AS BIGINT) AS size,
         CASE p_partkey % 5 WHEN 0 THEN '[' || p_partkey || '] 漫画' WHEN 1 THEN '012 - Solo ' || p_partkey || 'x -' WHEN 2 THEN 'Dup [' || p_partkey || '] tale ' || p_size % 7 || 'x'
                            WHEN 3 THEN 'Same ' || p_partkey || 'x' ELSE '[' || p_partkey || '] TEMP_deadbeef01' END || '.cbz' AS name,
         CASE p_partkey % 5 WHEN 0 THEN '[' || p_partkey || '] 漫画' WHEN 1 THEN 'Solo ' || p_partkey || 'x' WHEN 2 THEN 'Dup tale ' || p_size % 7 || 'x'
                            WHEN 3 THEN 'Same ' || p_partkey || 'x' ELSE p_brand END || '.cbz' AS new
  FROM part
"""


@query(f"""
WITH f AS ({CLEAN_FILES_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY b, new ORDER BY size DESC, name = new DESC, lower(name), name, d) AS rn FROM f),
d AS (SELECT b, d, row_number() OVER (PARTITION BY b ORDER BY d) AS rn FROM (SELECT DISTINCT b, d FROM f))
SELECT CASE WHEN rn = 1 THEN 'rename' ELSE 'merge_dir' END AS op, d AS src, 'lib/' || b AS dest, 'cleaned directory' AS reason, CAST(NULL AS BIGINT) AS size FROM d
UNION ALL SELECT 'rename', d || '/' || name, d || '/' || new, 'cleaned name', size FROM r WHERE rn = 1 AND name <> new
UNION ALL SELECT 'delete', d || '/' || name, NULL, 'smaller file of the same name', size FROM r WHERE rn > 1
""")
def clean_plan(spark, sf_dir):
    names = (text("[", part_key(), "] 漫画"), text("012 - Solo ", part_key(), "x -"), text("Dup [", part_key(), "] tale ", part_size() % 7, "x"), text("Same ", part_key(), "x"), text("[", part_key(), "] TEMP_deadbeef01"))
    directory = text("lib/", F.col("p_brand"), F.when(part_size() % 2 == 0, " (y)").otherwise(" [x]"))
    files = shelf(table(spark, sf_dir, "part"), directory, text(one_of(part_key(), *names), ".cbz"), price())
    none = spark.createDataFrame([], "path string, entry_name string, xml string")
    return library.clean(files, none, rules=P.RULES - {"comicinfo"}, profile="batch")


@query("""
WITH f AS (
  SELECT *, upper(p_type) LIKE '%' AND p_size % 2 = 0 AS en, CASE WHEN p_partkey % 3 = 0 THEN '漫画[' || p_partkey || ']' ELSE p_name || ' [z] ' || p_partkey END AS title FROM part
), r AS (
  SELECT 'w/' || p_type || CASE WHEN en THEN ' (EN)' ELSE '' END || '/' || title AS src, CASE WHEN en THEN '/english/' WHEN p_partkey % 3 <> 0 AND p_name LIKE 'small%' THEN '/small/' END
         || CASE WHEN p_partkey % 3 = 0 THEN title ELSE p_name || ' ' || p_partkey END AS dest FROM f
)
SELECT CASE WHEN dest IS NULL THEN 'skip' ELSE 'move' END AS op, src, dest, CASE WHEN dest IS NULL THEN 'no destination' ELSE 'routed' END AS reason, CAST(NULL AS BIGINT) AS size FROM r
""")
def route_plan(spark, sf_dir):
    title = F.when(part_key() % 3 == 0, text("漫画[", part_key(), "]")).otherwise(text(F.col("p_name"), " [z] ", part_key()))
    dirs = table(spark, sf_dir, "part").select(text("w/", F.col("p_type"), F.when(part_size() % 2 == 0, " (EN)").otherwise(""), "/", title).alias("dir_path"))
    rules = [routing.Rule("source", "* (en)", "english"), routing.Rule("title", "Small*", "small")]
    return library.route(dirs, "w", rules, {"english": "/english", "small": "/small"}, "nowhere")


@query("""
WITH f AS (
  SELECT p_brand AS d, p_name || CASE p_partkey % 3 WHEN 0 THEN ' - Ch. ' WHEN 1 THEN ' ch.' ELSE ' CH ' END || p_size % 5 AS stem, CASE WHEN p_partkey % 4 = 0 THEN '.cbr' ELSE '.cbz' END AS ext,
         replace(p_name, ' ', '') || 'ch' || p_size % 5 AS key, max(CAST(floor(p_retailprice * 10) AS BIGINT)) AS size
  FROM part GROUP BY ALL
)
SELECT 'delete' AS op, 'lib/' || d || '/' || stem || ext AS src, CAST(NULL AS VARCHAR) AS dest, CASE ext WHEN '.cbz' THEN 'smaller duplicate' ELSE 'exists as .cbz' END AS reason, size
FROM (SELECT *, row_number() OVER (PARTITION BY d, key, ext ORDER BY size DESC, stem) AS rn, bool_or(ext = '.cbz') OVER (PARTITION BY d, key) AS has FROM f)
WHERE CASE ext WHEN '.cbz' THEN rn > 1 ELSE has END
""")
def deduplicate_plan(spark, sf_dir):
    name = text(F.col("p_name"), one_of(part_key(), F.lit(" - Ch. "), F.lit(" ch."), F.lit(" CH ")), part_size() % 5, F.when(part_key() % 4 == 0, ".cbr").otherwise(".cbz"))
    return library.deduplicate(shelf(table(spark, sf_dir, "part"), text("lib/", F.col("p_brand")), name, price()))


MERGE_SQL = """
  SELECT p_name AS base, p_name || ' ch. ' || (p_size % 8 + 1) AS d, CASE WHEN p_partkey % 2 = 0 THEN 'Chapter ' ELSE 'Own x' END || p_partkey || '.cbz' AS name, p_partkey % 2 = 0 AS generic, CAST(floor(p_retailprice * 10) AS BIGINT) AS size
  FROM part WHERE p_name IN (SELECT p_name FROM part GROUP BY 1 HAVING count(DISTINCT p_size % 8) > 1)
"""


def numbered_folders(spark, sf_dir) -> DataFrame:
    name = text(F.when(part_key() % 2 == 0, "Chapter ").otherwise("Own x"), part_key(), ".cbz")
    return shelf(table(spark, sf_dir, "part"), text("lib/", F.col("p_name"), " ch. ", part_size() % 8 + 1), name, price())


@query(f"""
SELECT 'move' AS op, 'lib/' || d || '/' || name AS src, 'lib/' || base || '/' || CASE WHEN NOT generic THEN name WHEN n > 1 THEN d || ' ' || nth || '.cbz' ELSE d || '.cbz' END AS dest, 'merged series' AS reason, size
FROM (SELECT *, count(*) OVER (PARTITION BY d, generic) AS n, row_number() OVER (PARTITION BY d, generic ORDER BY name) AS nth FROM ({MERGE_SQL}))
""")
def merge_plan(spark, sf_dir):
    return library.merge_groups(numbered_folders(spark, sf_dir))


@query(f"SELECT 'lib/' || base AS \"to\", count(DISTINCT d) AS directories, count(*) AS archives, count(*) FILTER (generic) AS generic FROM ({MERGE_SQL}) GROUP BY 1")
def merge_counts(spark, sf_dir):
    return library.group_counts(numbered_folders(spark, sf_dir))


@query("""
WITH f AS (SELECT p_brand AS b, p_size % 3 AS k, p_name AS name, max(CAST(floor(p_retailprice * 10) AS BIGINT)) AS size FROM part GROUP BY ALL),
p AS (SELECT *, 'lib/' || b || CASE k WHEN 0 THEN '' WHEN 1 THEN ' (x)' ELSE ' [y]' END AS d FROM f),
r AS (SELECT *, d || '/' || name || '.cbz' AS path, row_number() OVER (PARTITION BY b, name ORDER BY size DESC, k = 0 DESC, d || '/' || name || '.cbz') AS rn FROM p)
SELECT 'move' AS op, path AS src, 'lib/' || b || '/' || name || '.cbz' AS dest, 'merged directory' AS reason, size FROM r WHERE rn = 1 AND k > 0
UNION ALL SELECT 'delete', path, NULL, CASE WHEN k = 0 THEN 'a larger file takes its place' ELSE 'a file as large has its place' END, size FROM r WHERE rn > 1
UNION ALL SELECT 'merge_dir', 'lib/' || p_brand || s, 'lib/' || p_brand, 'merged directory', NULL FROM (SELECT DISTINCT p_brand FROM part), (VALUES (' (x)'), (' [y]')) v(s)
""")
def merge_trees_plan(spark, sf_dir):
    """One directory moves into a second, which moves into a third: every file that moves or gives way has its row."""
    parts = table(spark, sf_dir, "part")
    directory = text("lib/", F.col("p_brand"), one_of(part_size(), F.lit(""), F.lit(" (x)"), F.lit(" [y]")))
    files = shelf(parts, directory, text(F.col("p_name"), ".cbz"), price())
    to = lambda a, b: F.struct(text("lib/", F.col("p_brand"), a).alias("src"), text("lib/", F.col("p_brand"), b).alias("dest"))
    moves = parts.select("p_brand").distinct().select(F.explode(F.array(to(" (x)", ""), to(" [y]", " (x)"))).alias("m")).select("m.src", "m.dest")
    return library.merge_trees(files, moves)


@query("""
SELECT 'rewrite' AS op, 'lib/' || p_brand || '/T' || p_partkey || ' ch. ' || p_size || '.cbz' AS src, 'ComicInfo.xml' AS dest, '<ComicInfo><Number>' || p_size || '</Number></ComicInfo>' AS reason, CAST(floor(p_retailprice * 10) AS BIGINT) AS size
FROM part WHERE p_size % 2 = 1 AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0
""")
def tag_plan(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    directory, name = text("lib/", F.col("p_brand")), text("T", part_key(), F.when(part_key() % 7 == 0, " x").otherwise(text(" ch. ", part_size())), ".cbz")
    xml = F.when(part_key() % 5 != 0, text("<ComicInfo><Number>", F.floor(part_size() / 2) * 2, "</Number></ComicInfo>"))
    metadata = parts.select(text(directory, "/", name).alias("path"), F.lit("ComicInfo.xml").alias("entry_name"), xml.alias("xml"))
    return library.tag_numbers(shelf(parts, directory, name, price()), metadata)


def range_library(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """An archive of two pages for each line number of an order, and one of the range of them all."""
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber is not null").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("long").alias("size"))
    directory = text("lib/o", F.col("l_orderkey"))
    jpg = F.lit(".jpg").alias("ext")
    singles = lines.select(text(directory, "/S ch. ", F.col("l_linenumber"), ".cbz").alias("path"), F.explode(F.array(F.lit("p.jpg"), F.lit("q.jpg"))).alias("entry"), jpg, "size")
    last = lines.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("n"))
    pages = last.where("n > 1").select(text(directory, "/S ch. 1-", F.col("n"), ".cbz").alias("path"), F.explode(F.sequence(F.lit(1), F.col("n").cast("int") * 2)).alias("k"))
    pages = pages.select("path", text(F.lpad(F.col("k").cast("string"), 2, "0"), ".jpg").alias("entry"), jpg, F.lit(20).cast("long").alias("size"))
    entries = pages.unionByName(singles)
    return sources.described(entries.groupBy("path").agg(F.sum("size").alias("size"))), entries


RANGES_SQL = """
WITH s AS (SELECT 'lib/o' || l_orderkey AS d, l_linenumber AS n, CAST(max(l_quantity) AS BIGINT) AS q FROM lineitem WHERE l_linenumber IS NOT NULL GROUP BY ALL),
g AS (SELECT d, max(n) AS m FROM s GROUP BY 1 HAVING max(n) > 1 AND count(*) = max(n)),
p AS (SELECT s.*, m, q > 20 AS up, d || '/S ch. 1-' || m || '.cbz' AS r, CAST((n - 1) * 2 + e AS BIGINT) AS pos, e FROM s JOIN g USING (d), (VALUES (1), (2)) v(e))
"""


@query(RANGES_SQL + """
SELECT 'rewrite' AS op, r AS src, CAST(NULL AS VARCHAR) AS dest, count(*) FILTER (up) || ' of ' || 2 * m || ' pages' AS reason, CAST(NULL AS BIGINT) AS size FROM p GROUP BY r, m HAVING bool_or(up)
UNION ALL SELECT 'move', d || '/S ch. ' || n || '.cbz', d || '/Processed/S ch. ' || n || '.cbz', 'in a range archive', NULL FROM p WHERE e = 1
""")
def resolve_plan(spark, sf_dir):
    return library.resolve_ranges(*range_library(spark, sf_dir))[1]


@query(RANGES_SQL + """
SELECT r AS "group", pos, CASE WHEN up THEN d || '/S ch. ' || n || '.cbz!' || chr(111 + e) || '.jpg' ELSE r || '!' || lpad(CAST(pos AS VARCHAR), 2, '0') || '.jpg' END AS winner_entry, 'page_' || lpad(CAST(pos AS VARCHAR), 4, '0') || '.jpg' AS new_name, up AS upgraded FROM p
""")
def resolve_pages(spark, sf_dir):
    return library.resolve_ranges(*range_library(spark, sf_dir))[0].select("group", "pos", "winner_entry", "new_name", "upgraded")


@query("""
WITH s AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS n FROM lineitem WHERE l_linenumber % 2 = 1 OR l_orderkey % 3 = 0),
r AS (SELECT o, n, lead(n) OVER (PARTITION BY o ORDER BY n) AS nx, row_number() OVER (PARTITION BY o ORDER BY n) AS k FROM s),
m AS (SELECT o, n + 1 AS a, coalesce(nx - 1, 9999999999) AS b FROM r WHERE nx IS NULL OR nx > n + 1 UNION ALL SELECT o, 0, n - 1 FROM r WHERE k = 1)
SELECT 'lib/o' || o AS series, CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END AS missing FROM m
""")
def range_missing(spark, sf_dir):
    """Each order is a range of ten thousand million numbers, of which a few exist."""
    lines = table(spark, sf_dir, "lineitem")
    directory = text("lib/o", F.col("l_orderkey"))
    singles = lines.where("l_linenumber % 2 = 1 or l_orderkey % 3 = 0").select(text(directory, "/S ch. ", F.col("l_linenumber"), ".cbz").alias("path"))
    spans = lines.select(text(directory, "/S ch. 0-9999999999.cbz").alias("path"))
    files = sources.described(singles.unionByName(spans).distinct().withColumn("size", F.lit(1).cast("long")))
    return library.incomplete_ranges(files).select("series", "missing")


@query("""
WITH f AS (SELECT DISTINCT 'lib/o' || l_orderkey AS d, CASE l_returnflag WHEN 'A' THEN 'ComicInfo.xml' ELSE l_linenumber || '-' || l_partkey || CASE l_returnflag WHEN 'R' THEN '.JPG' ELSE '.txt' END END AS name FROM lineitem)
SELECT 'pack' AS op, d AS src, d || '.cbz' AS dest, count(*) || ' entries' AS reason, CAST(NULL AS BIGINT) AS size FROM f GROUP BY d HAVING bool_or(name LIKE '%.JPG') AND NOT bool_or(name LIKE '%.txt')
""")
def pack_plan(spark, sf_dir):
    flag = F.col("l_returnflag")
    page = text(F.col("l_linenumber"), "-", F.col("l_partkey"), F.when(flag == "R", ".JPG").otherwise(".txt"))
    files = shelf(table(spark, sf_dir, "lineitem"), text("lib/o", F.col("l_orderkey")), F.when(flag == "A", "ComicInfo.xml").otherwise(page), F.lit(1))
    return library.pack_folders(files, "lib")


@query("""
WITH n AS (SELECT p_name, bool_or(p_size % 3 = 0) AS marked, bool_or(p_size % 3 = 1) AS plain FROM part GROUP BY 1)
SELECT 'move' AS op, 'lib/' || p_name || s AS src, 'lib/_Check/' || p_name || s AS dest, 'marked pair' AS reason, CAST(NULL AS BIGINT) AS size
FROM n, (VALUES (' (Uncensored)'), ('!')) v(s) WHERE marked AND plain
""")
def separate_plan(spark, sf_dir):
    name = text(F.col("p_name"), one_of(part_size(), F.lit(" (Uncensored)"), F.lit("!"), F.lit(" x")))
    return library.separate_marked(shelf(table(spark, sf_dir, "part"), text("lib/", name), text("1.cbz"), F.lit(1)))


@query("""
WITH n AS (SELECT p_name, bool_or(p_size % 3 = 0) AS marked, bool_or(p_size % 3 = 1) AS plain FROM part GROUP BY 1)
SELECT side, 'lib/' || p_name || s AS src, 'lib/_Check/' || p_name || s AS dest FROM n, (VALUES ('marked', ' (Uncensored)'), ('plain', '!')) v(side, s) WHERE marked AND plain
""")
def separate_sides(spark, sf_dir):
    """Only the marked, and only the plain ones, of each pair."""
    name = text(F.col("p_name"), one_of(part_size(), F.lit(" (Uncensored)"), F.lit("!"), F.lit(" x")))
    files = shelf(table(spark, sf_dir, "part"), text("lib/", name), text("1.cbz"), F.lit(1))
    moved = lambda side: library.separate_marked(files, side=side).select(F.lit(side).alias("side"), "src", "dest")
    return moved("marked").unionByName(moved("plain"))


@query("""
SELECT 'delete' AS op, 'lib/' || p_brand || '/' || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '.tmp.cbz' ELSE '.bak.cbz' END AS src, CAST(NULL AS VARCHAR) AS dest, 'left by an interrupted rewrite' AS reason, CAST(floor(p_retailprice * 10) AS BIGINT) AS size
FROM part WHERE p_partkey % 4 < 2
""")
def leftover_plan(spark, sf_dir):
    name = text(part_key(), one_of(part_key(), F.lit(".tmp.cbz"), F.lit(".bak.cbz"), F.lit(".cbz"), F.lit("tmp.cbz")))
    return library.leftovers(shelf(table(spark, sf_dir, "part"), text("lib/", F.col("p_brand")), name, price()))


@query("""
SELECT 'rename' AS op, 'lib/' || p_brand || '/' || p_name || ' ch. 5 ch.5 x' || p_partkey || '.cbz' AS src, 'lib/' || p_brand || '/' || p_name || ' ch. 5 x' || p_partkey || '.cbz' AS dest, 'cleaned name' AS reason, CAST(floor(p_retailprice * 10) AS BIGINT) AS size
FROM part WHERE p_partkey % 2 = 0
""")
def strip_repeats_plan(spark, sf_dir):
    name = text(F.col("p_name"), F.when(part_key() % 2 == 0, " ch. 5 ch.5 x").otherwise(" ch. 5 x"), part_key(), ".cbz")
    return library.strip_repeats(shelf(table(spark, sf_dir, "part"), text("lib/", F.col("p_brand")), name, price()))


@query("SELECT DISTINCT 'rename' AS op, 'lib/' || p_brand || '/S ch. 15.cbz' AS src, 'lib/' || p_brand || '/S ch. 1-5.cbz' AS dest, 'cleaned name' AS reason, CAST(15 AS BIGINT) AS size FROM part")
def range_names_plan(spark, sf_dir):
    number = F.explode(F.array(*(F.lit(n) for n in (1, 2, 3, 4, 5, 15))))
    rows = table(spark, sf_dir, "part").select("p_brand").distinct().select("p_brand", number.alias("n"))
    return library.range_names(shelf(rows, text("lib/", F.col("p_brand")), text("S ch. ", F.col("n"), ".cbz"), F.col("n")))


LIBRARY_ROWS = "SELECT DISTINCT 'lib/' || p_brand AS series, CAST(p_size AS DOUBLE) AS n FROM part UNION ALL SELECT DISTINCT 'lib', CAST(p_size AS DOUBLE) FROM part WHERE p_size % 3 = 0"


@query(GAPS_SQL.format(rows=LIBRARY_ROWS) + "SELECT regexp_extract(series, '[^/]*$') AS series, first_issue, last_issue, total_found, gap_count, missing, unnumbered, has_gaps, series AS path FROM report")
def gap_library(spark, sf_dir):
    return library.gap_report(series_and_root(spark, sf_dir), "lib")


def series_and_root(spark, sf_dir) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    files = shelf(parts, text("lib/", F.col("p_brand")), text("x ch. ", part_size(), ".cbz"), F.lit(1))
    return files.unionByName(shelf(parts.where("p_size % 3 = 0"), F.lit("lib"), text("r issue ", part_size(), ".cbz"), F.lit(1)))


@query(GAPS_SQL.format(rows=LIBRARY_ROWS) + "SELECT CASE series WHEN 'lib' THEN 'series' ELSE 'folder' END AS mode, total_found, gap_count, missing, series AS path FROM report")
def gap_modes(spark, sf_dir):
    """The root as one series, and the series in it."""
    files = series_and_root(spark, sf_dir)
    found = lambda mode: library.gap_report(files, "lib", mode).select(F.lit(mode).alias("mode"), "total_found", "gap_count", "missing", "path")
    return found("series").unionByName(found("folder"))


# ---- names, documents, lists


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_brand || ' Chapter 0' || p_size || ' extra' WHEN 1 THEN p_brand || ' Chapter ' || p_size WHEN 2 THEN p_brand || ' Ch. ' || p_size ELSE p_brand END AS stem FROM part
""")
def stem_batch(spark, sf_dir):
    stem = one_of(part_key(), text("Unknown Chapter 0", part_size(), " - extra"), text("# chapter ", part_size()), text("12. ch. - ", part_size()), text("Chapter ", part_size()))
    return table(spark, sf_dir, "part").select("p_partkey", N.normal_stem(stem, F.col("p_brand"), "batch").alias("stem"))


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS \"start\", CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size + 3 AS DOUBLE) ELSE p_size + 3.5 END AS \"end\" FROM part")
def range_extract(spark, sf_dir):
    start, end = N.number_range(text(F.col("p_name"), " Chapter ", part_size(), F.when(part_key() % 2 == 0, " – ").otherwise("-"), part_size() + 3, F.when(part_key() % 2 == 0, "").otherwise(".5")))
    return table(spark, sf_dir, "part").select("p_partkey", start.alias("start"), end.alias("end"))


@query("SELECT p_partkey, p_name || ' é–A' || chr(8230) || ' © ' || p_size || ' &x; <' || chr(9786) || '&' || p_brand AS name FROM part")
def entity_names(spark, sf_dir):
    """Entities by name, by number, by old names without a semicolon; unknown ones stay."""
    name = text(F.col("p_name"), " &eacute;&#8211;&#x41;&hellip; &copy ", part_size(), " &x; &lt;&#x263A;&amp", F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", N.unescape(name).alias("name"))


@query("SELECT p_partkey, p_partkey % 5 <> 3 AS generic FROM part")
def generic_stems(spark, sf_dir):
    stem = one_of(part_key(), text(" Chapter ", part_size()), text("ep. ", part_size()), text(part_size()), text(F.col("p_name"), " ", part_size()), text("Vol.", part_size(), " "))
    return table(spark, sf_dir, "part").select("p_partkey", N.is_generic_stem(stem).alias("generic"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN '0comicinfo.xml' ELSE '1p' || lpad(CAST(p_size AS VARCHAR), 20, '0') || '_' || lpad(CAST(p_partkey AS VARCHAR), 20, '0') || '.jpg' END AS key FROM part")
def natural_order(spark, sf_dir):
    name = F.when(part_key() % 50 == 0, "ComicInfo.XML").otherwise(text("P", part_size(), "_", part_key(), ".jpg"))
    return table(spark, sf_dir, "part").select("p_partkey", tree.natural_key(name).alias("key"))


TEMPLATE_SQL = "'" + P.TEMPLATE.replace("'", "''") + "'"


@query(f"""
SELECT p_partkey, replace(replace(replace({TEMPLATE_SQL}, '<Title></Title>', '<Title>' || p_name || '</Title>'), '<Series></Series>', '<Series>' || p_brand || '</Series>' || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE chr(10) || '  <Volume>' || p_size || '</Volume>' END),
       '<Number></Number>', '  <Number>' || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END || '</Number>') AS xml FROM part
""")
def template_documents(spark, sf_dir):
    number, volume = F.when(part_key() % 2 != 0, part_size().cast("string")), F.when(part_key() % 3 != 0, part_size().cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", G.from_template(F.col("p_name"), F.col("p_brand"), number, volume).alias("xml"))


@query("""
SELECT p_partkey, '<ComicInfo>' || chr(10) || '<Series>' || p_brand || '</Series>' || chr(10) || '  <Volume>2</Volume>' || chr(10) || '<Title>' || p_name || ' v2 ch. ' || p_size || '</Title>' || chr(10) || '  <Number>' || p_size || '</Number>' || chr(10) || '</ComicInfo>' AS xml
FROM part
""")
def retag_series(spark, sf_dir):
    """Series and title are cleaned and decided, volume and number are added."""
    xml = text("<ComicInfo>\n<Series>", F.col("p_brand"), " [scan]</Series>\n<Title>Chapter ", part_size(), "</Title>\n</ComicInfo>")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", xml.alias("xml"), text(F.col("p_name"), " v2 ch. ", part_size()).alias("stem"))
    return G.retagged(rows, "xml", "stem", "p_brand").select("p_partkey", F.col("new_xml").alias("xml"))


@query("""
WITH w AS (SELECT p_partkey, p_name || ' ' || p_size % 10 AS name, p_size FROM part), t AS (SELECT DISTINCT name FROM w WHERE p_size % 3 = 0),
r AS (SELECT p_partkey, w.name, t.name IS NOT NULL AS taken, row_number() OVER (PARTITION BY w.name ORDER BY p_partkey) AS nth FROM w LEFT JOIN t USING (name))
SELECT p_partkey, CASE WHEN taken AND nth > 99 OR nth > 100 THEN NULL WHEN taken THEN name || ' (' || nth || ')' WHEN nth = 1 THEN name ELSE name || ' (' || (nth - 1) || ')' END AS new_name FROM r
""")
def free_names(spark, sf_dir):
    wanted = table(spark, sf_dir, "part").select("p_partkey", text(F.col("p_name"), " ", part_size() % 10).alias("name"), "p_size")
    taken = wanted.where("p_size % 3 = 0").select("name").distinct()
    return keep.free_suffix(wanted.drop("p_size"), taken, "name", order="p_partkey").select("p_partkey", "new_name")


@query("""
WITH f AS (SELECT 'order ' || l_orderkey AS dir_path, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS n, CAST(trunc(l_extendedprice) AS BIGINT) AS size FROM lineitem)
SELECT dir_path, lpad(CAST(n AS VARCHAR), 3, '0') AS name, lpad(CAST(n + 1 AS VARCHAR), 3, '0') AS new_name, size,
       CASE WHEN lead(size) OVER w IS NULL THEN 'renamed' WHEN max(size) OVER w > lead(size) OVER w THEN 'renamed over smaller' ELSE 'discarded' END AS outcome
FROM f WINDOW w AS (PARTITION BY dir_path ORDER BY n)
""")
def rename_chains(spark, sf_dir):
    """Every file takes the name of the next, as it is by then."""
    from pyspark.sql import Window as W

    nth = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    name = lambda n: F.lpad(n.cast("string"), 3, "0")
    lines = table(spark, sf_dir, "lineitem")
    files = lines.repartition(keep.tasks_for(lines), "l_orderkey").withColumn("n", nth)
    return keep.renamed_one_by_one(files.select(text("order ", F.col("l_orderkey")).alias("dir_path"), name(F.col("n")).alias("name"), name(F.col("n") + 1).alias("new_name"), F.col("l_extendedprice").cast("long").alias("size")))


@query("SELECT page_id, replace(regexp_replace(url, '^https?:', ''), '/', chr(92)) AS path FROM pages")
def network_paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", sources.to_backslashes(F.regexp_replace("url", "^https?:", "")).alias("path"))


NESTED = """SELECT DISTINCT 'w/' || p_brand || CASE WHEN p_size = 7 AND p_partkey % 2 = 0 THEN '' WHEN p_size % 3 = 0 THEN '/' || p_type ELSE '/' || p_type || '/' || p_name END AS dir_path FROM part"""


def nested_directories(spark, sf_dir) -> DataFrame:
    deep = text("/", F.col("p_type"), F.when(part_size() % 3 == 0, "").otherwise(text("/", F.col("p_name"))))
    return table(spark, sf_dir, "part").select(text("w/", F.col("p_brand"), F.when((part_size() == 7) & (part_key() % 2 == 0), "").otherwise(deep)).alias("dir_path"))


@query(f"WITH d AS ({NESTED}) SELECT dir_path FROM d WHERE NOT EXISTS (FROM d o WHERE starts_with(d.dir_path, o.dir_path || '/'))")
def outermost_directories(spark, sf_dir):
    """Directories inside each other are processed once, by the outermost."""
    return nesting.outermost(nested_directories(spark, sf_dir), "dir_path")


@query(f"""
WITH d AS ({NESTED}), b AS (SELECT dir_path FROM d WHERE length(dir_path) % 9 = 0)
SELECT dir_path FROM d WHERE NOT EXISTS (FROM b WHERE b.dir_path = d.dir_path OR starts_with(d.dir_path, b.dir_path || '/') OR starts_with(b.dir_path, d.dir_path || '/'))
""")
def apart_from_busy(spark, sf_dir):
    dirs = nested_directories(spark, sf_dir).distinct()
    return nesting.apart(dirs, dirs.where(F.length("dir_path") % 9 == 0), "dir_path")


@query("SELECT p_partkey, p_size % 3 <> 2 AS inside, p_size % 3 <> 2 AS overlap, true AS below FROM part")
def inside_directories(spark, sf_dir):
    child = one_of(part_size(), text("lib/", F.col("p_brand")), text("lib/", F.col("p_brand"), "/", F.col("p_name")), text("lib/", F.col("p_brand"), "x/", F.col("p_name")))
    parent = text("lib/", F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", routing.is_inside(child, parent).alias("inside"), routing.overlap(parent, child).alias("overlap"), routing.overlap(F.lit("lib"), child).alias("below"))


@query("SELECT p_partkey, p_size % 4 < 2 AS ranges, p_size % 4 < 3 AS dedup FROM part")
def image_types(spark, sf_dir):
    ext = one_of(part_size(), F.lit(".JPG"), F.lit(".tif"), F.lit(".avif"), F.lit(".txt"))
    return table(spark, sf_dir, "part").select("p_partkey", sources.is_image(ext).alias("ranges"), sources.is_image(ext, "dedup").alias("dedup"))


# ---- events, logs, archives


@query("""
SELECT event_id, CASE WHEN event_type = 'click' THEN 'm' ELSE 'd' END || user_id AS dir_path FROM events WHERE event_type = 'click' OR event_id % 4 <> 0
""")
def archive_arrivals(spark, sf_dir):
    moved = F.col("event_type") == "click"
    path = text("d", F.col("user_id"), "/f", F.col("event_id"), F.when(F.col("event_id") % 4 == 0, ".txt").otherwise(".CBZ"))
    events = table(spark, sf_dir, "events").select("event_id", F.when(moved, "moved").otherwise("created").alias("event_type"), path.alias("path"), text("m", F.col("user_id"), "/g.cbz").alias("dest_path"))
    return settle.archive_events(events).select("event_id", "dir_path")


@query("SELECT event_id FROM events WHERE user_id % 3 <> 0 AND event_id % 10 <> 9")
def events_outside(spark, sf_dir):
    """Events that no directory under work equals, holds or lies in."""
    directory = F.when(F.col("event_id") % 10 == 9, "w").otherwise(text("w/u", F.col("user_id"), F.when(F.col("event_id") % 2 == 0, "/deep").otherwise("")))
    events = table(spark, sf_dir, "events").select("event_id", directory.alias("dir_path"), "user_id")
    busy = events.where("user_id % 3 = 0").select(text("w/u", F.col("user_id")).alias("dir_path")).distinct()
    return settle.outside(events.drop("user_id"), busy).select("event_id")


@query("SELECT DISTINCT 'p/' || doc_id AS p FROM labels WHERE doc_id IS NOT NULL")
def progress_log(spark, sf_dir):
    """A log is started, written twice and read."""
    log = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    done = table(spark, sf_dir, "labels").where("doc_id is not null").select(text("p/", F.col("doc_id")).alias("p"))
    sources.start_log(spark, log, "now")
    sources.log_progress(done, log)
    sources.log_progress(done.where("substr(p, -1) = '1'"), log)
    return sources.progress(spark, log)


def archives_of(spark, sf_dir) -> str:
    """One archive for each brand, each part a page of it; written by tasks into the shared folder."""
    folder = f"{shared_folder(spark)}/library-{uuid.uuid4().hex}"
    store, root = pafs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)

    def write(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        store, root = pafs.FileSystem.from_uri(folder)
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            for r in pdf.sort_values("p_partkey").itertuples():
                z.writestr(f"{r.p_partkey}.jpg", r.p_name)
            if len(pdf) % 2 == 0:
                z.writestr("in/comicInfo.XML", f"<x>{key[0]}</x>")
        with store.open_output_stream(f"{root}/{key[0].replace('#', ' ')}.cbz") as f:
            f.write(held.getvalue())
        return pdf[["p_partkey"]]

    table(spark, sf_dir, "part").groupBy("p_brand").applyInPandas(write, "p_partkey long").write.format("noop").mode("overwrite").save()
    return folder


@query("""
SELECT replace(p_brand, '#', ' ') || '.cbz' AS name, p_partkey || '.jpg' AS entry, '.jpg' AS ext, CAST(length(p_name) AS BIGINT) AS size, true AS ok FROM part
UNION ALL SELECT replace(p_brand, '#', ' ') || '.cbz', 'in/comicInfo.XML', '.xml', length(p_brand) + 7, true FROM part GROUP BY p_brand HAVING count(*) % 2 = 0
""")
def archive_entries(spark, sf_dir):
    return sources.entries(spark, archives_of(spark, sf_dir)).select(F.substring_index("path", "/", -1).alias("name"), "entry", "ext", "size", "ok")


@query("SELECT replace(p_brand, '#', ' ') || '.cbz' AS name, CASE WHEN count(*) % 2 = 0 THEN 'in/comicInfo.XML' END AS entry_name, CASE WHEN count(*) % 2 = 0 THEN '<x>' || p_brand || '</x>' END AS xml FROM part GROUP BY p_brand")
def archive_metadata(spark, sf_dir):
    return sources.metadata(spark, archives_of(spark, sf_dir)).select(F.substring_index("path", "/", -1).alias("name"), "entry_name", "xml")


@query("SELECT replace(p_brand, '#', ' ') || '.cbz' AS name, replace(p_brand, '#', ' ') AS stem, '.cbz' AS ext, true AS has_size FROM part GROUP BY p_brand")
def archive_scan(spark, sf_dir):
    return sources.scan(spark, archives_of(spark, sf_dir)).select("name", "stem", "ext", (F.col("size") > 0).alias("has_size"))
