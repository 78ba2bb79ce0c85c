"""Queries over the driver's tables, each with the same result as DuckDB SQL where SQL can express it.

The tables hold no archives, so each query applies an operator to a stand-in: brands as series and sizes as issue numbers,
page addresses as paths, orders as directories and their lines as files.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import tags as G
from ..operators import gaps, keep, match, ranges, routing, tree
from ..session import fixed, table
from ..streaming import settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    from . import jobs, store_jobs  # noqa: F401  add their own

    return QUERIES


def oracle_sql() -> dict:
    return SQL if queries() else {}


# ---- missing numbers

GAPS_SQL = """
WITH r AS ({rows}), c AS (
  SELECT series, count(DISTINCT n) AS total_found, count(*) FILTER (n IS NULL) AS unnumbered, min(n) AS lo, max(n) AS hi FROM r GROUP BY series HAVING count(DISTINCT n) >= 2
), w AS (
  SELECT series, n AS lo, lead(n) OVER (PARTITION BY series ORDER BY n) AS hi, row_number() OVER (PARTITION BY series ORDER BY n) AS nth FROM (SELECT DISTINCT series, n FROM r WHERE n IS NOT NULL)
), g AS (
  SELECT series, 0.0 AS lo, 1 AS f, CAST(floor(lo) - 1 AS BIGINT) AS l FROM w WHERE nth = 1 AND lo >= 2
  UNION ALL SELECT series, lo, CAST(lo + 1 AS BIGINT), CAST(lo + ceil(hi - lo) - 1 AS BIGINT) FROM w WHERE hi - lo > 1
), t AS (
  SELECT series, count(*) AS gap_count, string_agg(CASE WHEN f = l THEN CAST(f AS VARCHAR) ELSE f || '-' || l END, ', ' ORDER BY lo) AS missing FROM g GROUP BY series
), report AS (
  SELECT series, CAST(CAST(lo AS BIGINT) AS VARCHAR) AS first_issue, CAST(CAST(hi AS BIGINT) AS VARCHAR) AS last_issue, total_found,
         coalesce(gap_count, 0) AS gap_count, coalesce(missing, '') AS missing, unnumbered, coalesce(gap_count, 0) > 0 AS has_gaps
  FROM c LEFT JOIN t USING (series)
)
"""
BRAND_ROWS = "SELECT p_brand AS series, CAST(p_size AS DOUBLE) AS n FROM part"


def brand_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.report(table(spark, sf_dir, "part"), "p_brand", F.col("p_size"), "p_name")


@query(GAPS_SQL.format(rows=BRAND_ROWS) + "SELECT * FROM report")
def gap_report(spark, sf_dir):
    return gaps.in_report_order(brand_gaps(spark, sf_dir))


@query(GAPS_SQL.format(rows=BRAND_ROWS) + "SELECT series, gap_count, missing FROM report ORDER BY gap_count DESC, series LIMIT 10")
def gap_top10(spark, sf_dir):
    return brand_gaps(spark, sf_dir).orderBy(F.desc("gap_count"), "series").limit(10).select("series", "gap_count", "missing")


@query(GAPS_SQL.format(rows=BRAND_ROWS) + "SELECT count(*) FILTER (has_gaps) AS with_gaps, count(*) FILTER (NOT has_gaps) AS complete, count(*) AS total FROM report")
def gap_summary_counts(spark, sf_dir):
    return brand_gaps(spark, sf_dir).agg(F.count_if("has_gaps").alias("with_gaps"), F.count_if(~F.col("has_gaps")).alias("complete"), F.count(F.lit(1)).alias("total"))


@query(GAPS_SQL.format(rows="SELECT l_orderkey AS series, CAST(l_linenumber AS DOUBLE) AS n FROM lineitem") + "SELECT * FROM report")
def gap_lineitem(spark, sf_dir):
    return gaps.report(table(spark, sf_dir, "lineitem"), "l_orderkey", F.col("l_linenumber"), "l_partkey")


# ---- duplicates and conflicts


@query(r"""
SELECT doc_id, n_chars, row_number() OVER w AS "rank", count(*) OVER (PARTITION BY k) AS members, row_number() OVER w = 1 AS keep
FROM (SELECT *, regexp_replace(lower(text), '[\s\-_.,!?''"]+', '', 'g') AS k FROM documents)
WINDOW w AS (PARTITION BY k ORDER BY n_chars DESC, doc_id) QUALIFY count(*) OVER (PARTITION BY k) > 1
""")
def dedup_keep_largest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.sha2(N.dedup_key(F.col("text")), 256).alias("key"))
    return keep.largest(fixed(docs), ["key"], "n_chars", "doc_id").select("doc_id", "n_chars", F.col("rank").cast("long").alias("rank"), "members", "keep")


@query("""
SELECT p_partkey, row_number() OVER w AS "rank", count(*) OVER (PARTITION BY p_name) AS members, row_number() OVER w = 1 AS keep
FROM part WINDOW w AS (PARTITION BY p_name ORDER BY p_retailprice DESC, p_partkey) QUALIFY count(*) OVER (PARTITION BY p_name) > 1
""")
def dedup_part_names(spark, sf_dir):
    rows = keep.largest(table(spark, sf_dir, "part"), ["p_name"], "p_retailprice", "p_partkey")
    return rows.select("p_partkey", F.col("rank").cast("long").alias("rank"), "members", "keep")


@query("SELECT conv_id, turn FROM conversations u WHERE role = 'user' AND EXISTS (SELECT 1 FROM conversations a WHERE a.conv_id = u.conv_id AND a.role = 'assistant' AND a.turn // 4 = u.turn // 4)")
def format_pair_semi(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("key", F.floor(F.col("turn") / 4))
    return tree.format_pairs(rows, "conv_id", "key", "role", "user", "assistant").select("conv_id", "turn")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti(spark, sf_dir):
    return tree.not_done(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT DISTINCT doc_id FROM labels WHERE doc_id IS NOT NULL")
def progress_distinct(spark, sf_dir):
    return table(spark, sf_dir, "labels").where("doc_id is not null").select("doc_id").distinct()


@query("""
WITH b AS (
  SELECT c_nationkey AS nation, c_name AS name, c_acctbal AS size, c_custkey AS ord, 1 AS old FROM customer
  UNION ALL SELECT s_nationkey, s_name, s_acctbal, s_suppkey, 0 FROM supplier
)
SELECT nation, name, size, count(*) OVER (PARTITION BY nation) AS contenders, old = 0 AND count(*) OVER (PARTITION BY nation) > 1 AS replaced
FROM b QUALIFY row_number() OVER (PARTITION BY nation ORDER BY size DESC, old DESC, ord) = 1
""")
def conflict_merge(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("size"), F.col("c_custkey").alias("ord"))
    new = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("size"), F.col("s_suppkey").alias("ord"))
    return keep.merged(old, new, ["nation"], "size", "ord").select("nation", "name", "size", "contenders", "replaced")


@query("""
SELECT o_orderkey, CASE WHEN n = 1 THEN k ELSE k || ' (' || (n - 1) || ')' END AS new_name
FROM (SELECT o_orderkey, o_custkey || ' ' || strftime(o_orderdate, '%Y-%m-%d') AS k, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey) AS n FROM orders)
""")
def collision_suffix(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("name", F.concat_ws(" ", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd")))
    return keep.suffixed(rows, ["o_custkey", "o_orderdate"], "o_orderkey", "name").select("o_orderkey", "new_name")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN count(*) OVER (PARTITION BY l_orderkey) > 1 THEN 'Order ' || l_orderkey || ' ' || row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) ELSE 'Order ' || l_orderkey END AS new_name
FROM lineitem WHERE l_returnflag = 'R'
""")
def generic_numbering(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("place", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    out = keep.generic_numbering(rows, "l_orderkey", "place", F.col("l_returnflag") == "R", F.concat(F.lit("Order "), "l_orderkey"))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "new_name")


@query("SELECT CASE WHEN l.doc_id IS NULL THEN 'unlabelled' WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'kept' ELSE 'dropped' END AS outcome, count(*) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1")
def outcome_counts(spark, sf_dir):
    marks = table(spark, sf_dir, "labels").withColumn("seen", F.lit(True))
    rows = table(spark, sf_dir, "documents").select("doc_id").join(marks, "doc_id", "left")
    return keep.outcomes(rows, F.when(F.col("seen").isNull(), "unlabelled").when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "kept").otherwise("dropped"))


@query("SELECT 'delete' AS op, CAST(p_partkey AS VARCHAR) AS src, CAST(NULL AS VARCHAR) AS dest, 'smaller duplicate' AS reason, CAST(p_retailprice AS BIGINT) AS size FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_retailprice DESC, p_partkey) AS k FROM (SELECT p_partkey, p_name, floor(p_retailprice) AS p_retailprice FROM part)) WHERE k > 1")
def delete_actions(spark, sf_dir):
    rows = keep.losers(table(spark, sf_dir, "part").withColumn("p_retailprice", F.floor("p_retailprice")), ["p_name"], "p_retailprice", "p_partkey")
    return keep.actions(rows, "delete", F.col("p_partkey"), None, "smaller duplicate", F.col("p_retailprice"))


@query("""
WITH f AS (
  SELECT 'order ' || l_orderkey AS dir_path, l_linenumber || '-' || l_partkey || '-' || l_suppkey AS name, CAST(l_linenumber AS VARCHAR) AS new_name, max(CAST(trunc(l_extendedprice) AS BIGINT)) AS size
  FROM lineitem GROUP BY ALL
)
SELECT *, CASE WHEN row_number() OVER w = 1 THEN 'renamed' WHEN size > max(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'renamed over smaller' ELSE 'discarded' END AS outcome
FROM f WINDOW w AS (PARTITION BY dir_path, new_name ORDER BY name)
""")
def rename_in_order(spark, sf_dir):
    files = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("order "), "l_orderkey").alias("dir_path"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("name"),
        F.col("l_linenumber").cast("string").alias("new_name"), F.col("l_extendedprice").cast("long").alias("size"),
    )
    return keep.renamed_one_by_one(files.groupBy("dir_path", "name", "new_name").agg(F.max("size").alias("size")))


# ---- routing

RULES = [routing.Rule("source", "m.*", "mobile"), routing.Rule("source", "*.org", "org"), routing.Rule("title", "/fr/*", "french"), routing.Rule("title", "/[de]?/*", "other"), routing.Rule("none", "*", "never")]
PLACES = {"mobile": "/m", "org": "/org", "french": "/fr", "other": "/de", "rest": "/rest"}


@query(r"""
SELECT page_id, CASE WHEN h LIKE 'm.%' THEN '/m' WHEN h LIKE '%.org' THEN '/org' WHEN p LIKE '/fr/%' THEN '/fr' WHEN regexp_full_match(p, '/[de]./.*') THEN '/de' ELSE '/rest' END AS dest
FROM (SELECT page_id, lower(regexp_extract(url, '^https?://([^/]+)', 1)) AS h, lower(regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1)) AS p FROM pages)
""")
def route_first_match(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    subjects = {"source": F.regexp_extract("url", "^https?://([^/]+)", 1), "title": F.regexp_extract("url", "^https?://[^/]+(/[^?#]*)", 1)}
    return pages.select("page_id", routing.routed(RULES, subjects, PLACES, "rest").alias("dest"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'a' WHEN 'view' THEN 'a' WHEN 'purchase' THEN 'b' ELSE 'c' END AS dest FROM events")
def route_case(spark, sf_dir):
    rules = [routing.Rule("source", "click", "first"), routing.Rule("source", "v?ew", "first"), routing.Rule("source", "purch*", "second")]
    dest = routing.routed(rules, {"source": F.col("event_type")}, {"first": "a", "second": "b", "rest": "c"}, "rest")
    return table(spark, sf_dir, "events").select("event_id", dest.alias("dest"))


# ---- metadata


@query("SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1, 'is') AS title FROM pages")
def title_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", G.get_tag(F.col("html"), "Title").alias("title"))


@query("SELECT page_id, md5(regexp_replace(html, '<title>.*?</title>', '<title>Page ' || page_id || '</title>', 'is')) AS digest FROM pages")
def tag_set(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(G.set_tag(F.col("html"), "title", F.concat(F.lit("Page "), "page_id"))).alias("digest"))


DOCUMENT_SQL = "'<ComicInfo>' || chr(10) || '  <Title>' || p_name || '</Title>' || chr(10) || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '  <number> ' || p_size || ' </number>' || chr(10) END || '</ComicInfo>'"


def documents_of(parts: DataFrame) -> DataFrame:
    number = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("  <number> "), "p_size", F.lit(" </number>\n")))
    return parts.withColumn("xml", F.concat(F.lit("<ComicInfo>\n  <Title>"), "p_name", F.lit("</Title>\n"), number, F.lit("</ComicInfo>")))


@query(f"""
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN replace(xml, '</ComicInfo>', '  <Number>' || n || '</Number>' || chr(10) || '</ComicInfo>')
       WHEN p_size = n THEN xml ELSE regexp_replace(xml, '<number>.*?</number>', '<Number>' || n || '</Number>', 'is') END AS xml,
       p_partkey % 3 = 0 OR p_size <> n AS changed
FROM (SELECT *, {DOCUMENT_SQL} AS xml, p_size // 2 * 2 AS n FROM part)
""")
def number_tag(spark, sf_dir):
    rows = documents_of(table(spark, sf_dir, "part"))
    new = G.set_number(F.col("xml"), (F.floor(F.col("p_size") / 2) * 2).cast("string"))
    return rows.select("p_partkey", new.alias("xml"), (new != F.col("xml")).alias("changed"))


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN replace(xml, '</ComicInfo>', '  <Number>1-' || p_size || '</Number>' || chr(10) || '</ComicInfo>') ELSE regexp_replace(xml, '<number>.*?</number>', '<Number>1-' || p_size || '</Number>', 'is') END AS xml FROM (SELECT *, {DOCUMENT_SQL} AS xml FROM part)")
def range_tag(spark, sf_dir):
    rows = documents_of(table(spark, sf_dir, "part"))
    return rows.select("p_partkey", G.set_range(F.col("xml"), F.lit(1.0), F.col("p_size").cast("double")).alias("xml"))


TITLE_SQL = r"""
SELECT page_id, CASE WHEN title = host AND NOT fg THEN stem WHEN title = host THEN NULL WHEN g AND NOT fg THEN stem WHEN g THEN host END AS new_title
FROM (SELECT *, regexp_matches(title, 'manga_chapter|^#\s*english|^#\s*chapter|^chapter|^part\s+\d+|^doujinshi[\s_]chapter|^unknown[\s_]chapter', 'i')
               OR regexp_matches(title, '^(?:TEMP[\s_-]*[0-9a-f]{8,}|[0-9a-f]{16,})$', 'i') AS g,
             regexp_matches(stem, '^chapter|^part\s+\d+', 'i') AS fg
      FROM (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host,
                   CASE page_id % 4 WHEN 0 THEN 'Chapter ' || page_id WHEN 1 THEN regexp_extract(url, '^https?://([^/]+)', 1) WHEN 2 THEN 'TEMP_0123456789abcdef' ELSE 'A title' END AS title,
                   CASE page_id % 3 WHEN 0 THEN 'part ' || page_id ELSE 'page ' || page_id END AS stem FROM pages))
"""


@query(TITLE_SQL)
def title_decision(spark, sf_dir):
    i, host = F.col("page_id"), F.regexp_extract("url", "^https?://([^/]+)", 1)
    title = F.when(i % 4 == 0, F.concat(F.lit("Chapter "), i)).when(i % 4 == 1, host).when(i % 4 == 2, "TEMP_0123456789abcdef").otherwise("A title")
    stem = F.when(i % 3 == 0, F.concat(F.lit("part "), i)).otherwise(F.concat(F.lit("page "), i))
    return table(spark, sf_dir, "pages").select("page_id", G.decided_title(title, host, stem, "batch").alias("new_title"))


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN replace(xml, '</ComicInfo>', '  <Number>' || p_size || '</Number>' || chr(10) || '</ComicInfo>') ELSE regexp_replace(xml, '<number>.*?</number>', '<Number>' || p_size || '</Number>', 'is') END AS xml FROM (SELECT *, {DOCUMENT_SQL} AS xml FROM part)")
def retag(spark, sf_dir):
    rows = documents_of(table(spark, sf_dir, "part")).withColumn("stem", F.concat("p_name", F.lit(" v2 ch. "), "p_size"))
    return G.retagged(rows, "xml", "stem", "p_brand").select("p_partkey", F.col("new_xml").alias("xml"))


@query("SELECT page_id, replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&') AS title FROM (SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1, 'is') AS t FROM pages)")
def entity_decode(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", N.unescape(G.get_tag(F.col("html"), "title"), full=False).alias("title"))


# ---- names

URL_SQL = r"'(?:https?://\S+)|(?:www\.\S+)|(?:\b[\w-]+\.(?:com|net|org|io|co|info|biz|tv|me|cc|us|uk|ca|au)(?:/\S*)?)'"


@query(rf"SELECT p_partkey, regexp_replace(p_name || ' www.x.com/a b.org http://c.d/e ' || p_size, {URL_SQL}, '', 'gi') AS name FROM part")
def url_strip(spark, sf_dir):
    from ..functions import patterns as P

    name = F.concat("p_name", F.lit(" www.x.com/a b.org http://c.d/e "), "p_size")
    return table(spark, sf_dir, "part").select("p_partkey", N.without(name, P.URL).alias("name"))


def sanitized_sql(x: str) -> str:
    x = rf"regexp_replace(regexp_replace({x}, {URL_SQL}, '', 'gi'), '\b[\w-]*scans?\b|\b[\w-]*scanners?\b|\b[\w-]*scanlations?\b', '', 'gi')"
    x = rf"regexp_replace(regexp_replace({x}, '[\s/]+$', ''), '[\s\-]*\bG\d{{3,5}}$', '')"
    x = rf"regexp_replace({x}, '[^\x{{0000}}-\x{{024F}}\x{{0370}}-\x{{03FF}}\x{{2000}}-\x{{206F}}\x{{2600}}-\x{{27BF}}\x{{FE00}}-\x{{FE0F}}\x{{1F300}}-\x{{1FAFF}}]+', '', 'g')"
    x = rf"regexp_replace(regexp_replace({x}, '\[[^\]]*\]|\([^)]*\)', '', 'g'), '[\[\]()]', '', 'g')"
    return rf"regexp_replace(regexp_replace(replace({x}, '_', ' '), ' {{2,}}', ' ', 'g'), '^\s+|\s+$', '', 'g')"


@query("SELECT p_partkey, " + sanitized_sql("p_name || ' [G] (x) 漫画 my-scans_ch. ' || p_size || ') a.com - G' || (1000 + p_size)") + " AS name FROM part")
def sanitize_names(spark, sf_dir):
    name = F.concat("p_name", F.lit(" [G] (x) 漫画 my-scans_ch. "), "p_size", F.lit(") a.com - G"), F.col("p_size") + 1000)
    return table(spark, sf_dir, "part").select("p_partkey", N.sanitize(name, full_entities=False).alias("name"))


@query(r"SELECT p_partkey, trim(regexp_replace(trim(regexp_replace(regexp_replace(" + sanitized_sql("'# ' || p_brand || ' - ch #'") + r", '^#+\s*', ''), '\s*#+$', '')), '[\s_\-]*(?:part|v|ch(?:ap(?:ter)?)?)\s*$', '', 'i')) AS name FROM part")
def clean_dir(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", N.clean_directory(F.concat(F.lit("# "), "p_brand", F.lit(" - ch #")), full_entities=False).alias("name"))


@query("SELECT p_partkey, " + sanitized_sql("p_name || ' [x].v' || p_size") + " || '.cbz' AS name FROM part")
def clean_file(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", N.clean_filename(F.concat("p_name", F.lit(" [x].v"), "p_size", F.lit(".cbz")), full_entities=False).alias("name"))


NAME_SQL = "p_name || CASE p_partkey % 5 WHEN 0 THEN ' ch. ' WHEN 1 THEN ' Episode ' WHEN 2 THEN ' issue' WHEN 3 THEN ' #' ELSE ' vol. ' END || p_size || CASE WHEN p_partkey % 2 = 0 THEN '.50' ELSE ' v7 end' END"


def numbered_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("p_partkey")
    token = F.when(i % 5 == 0, " ch. ").when(i % 5 == 1, " Episode ").when(i % 5 == 2, " issue").when(i % 5 == 3, " #").otherwise(" vol. ")
    return table(spark, sf_dir, "part").withColumn("name", F.concat("p_name", token, "p_size", F.when(i % 2 == 0, ".50").otherwise(" v7 end")))


NUMBER_SQL = "CASE WHEN x = floor(x) THEN CAST(CAST(x AS BIGINT) AS VARCHAR) ELSE CAST(x AS VARCHAR) END"


@query(rf"SELECT p_partkey, x AS chapter, {NUMBER_SQL} AS chapter_text FROM (SELECT p_partkey, TRY_CAST(nullif(regexp_extract({NAME_SQL}, '(?:ch(?:ap(?:ter)?)?p?\.?\s*|issue\s*|ep(?:isode)?\.?\s*|#\s*)(\d[\d.]*)', 1, 'i'), '') AS DOUBLE) AS x FROM part)")
def chapter_extract(spark, sf_dir):
    return numbered_names(spark, sf_dir).select("p_partkey", N.chapter(F.col("name")).alias("chapter"), N.chapter_text(F.col("name")).alias("chapter_text"))


@query(rf"SELECT p_partkey, {NUMBER_SQL} AS volume FROM (SELECT p_partkey, TRY_CAST(coalesce(nullif(regexp_extract({NAME_SQL}, 'vol(?:ume)?\.?\s*(\d[\d.]*)', 1, 'i'), ''), nullif(regexp_extract({NAME_SQL}, 'v(\d[\d.]*)(?:\s|ch|ep|$)', 1, 'i'), '')) AS DOUBLE) AS x FROM part)")
def volume_extract(spark, sf_dir):
    return numbered_names(spark, sf_dir).select("p_partkey", N.volume_text(F.col("name")).alias("volume"))


@query(r"SELECT p_partkey, TRY_CAST(regexp_extract(p_name || ' ' || p_size || CASE WHEN p_partkey % 2 = 0 THEN '.5 ' ELSE '' END, '[^\d](\d{1,4}(?:\.\d+)?)\s*$', 1) AS DOUBLE) AS number FROM part")
def bare_number(spark, sf_dir):
    name = F.concat("p_name", F.lit(" "), "p_size", F.when(F.col("p_partkey") % 2 == 0, ".5 ").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", N.issue_number(name).alias("number"))


@query("SELECT p_partkey, p_name || ' ch. ' || p_size || ' vol.3' AS name FROM part")
def number_normalise(spark, sf_dir):
    name = F.concat("p_name", F.lit(" ch. 00"), "p_size", F.lit(".0 vol.03"))
    return table(spark, sf_dir, "part").select("p_partkey", N.number_tokens(name).alias("name"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_brand || ' Ch. ' || p_size || ' extra' WHEN 1 THEN p_brand || ' Ch ' || p_size WHEN 2 THEN p_brand || ' Ch. ' || p_size ELSE p_name END AS stem FROM part")
def stem_normal(spark, sf_dir):
    i = F.col("p_partkey")
    stem = F.when(i % 4 == 0, F.concat(F.lit("Unknown Chapter 0"), "p_size", F.lit(" - extra"))).when(i % 4 == 1, F.concat(F.lit("ch "), "p_size")).when(i % 4 == 2, F.concat(F.lit("12. ch. - "), "p_size")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", N.normal_stem(stem, F.col("p_brand"), "live").alias("stem"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' ch. 1-' || p_size || ' x ch. 9' ELSE p_name || ' 1-' || p_size END AS name FROM part")
def range_rename(spark, sf_dir):
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(" ch. 15 x ch. 9"))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", N.renamed_for_range(name, F.lit(1.0), F.col("p_size").cast("double")).alias("name"))


@query("SELECT lower(p_name) AS base, count(DISTINCT p_size) AS members FROM part GROUP BY 1 HAVING count(DISTINCT p_size) >= 2")
def group_base(spark, sf_dir):
    dirs = table(spark, sf_dir, "part").select(F.lit("lib").alias("parent"), F.concat("p_name", F.lit(" ch. "), "p_size").alias("name")).distinct()
    return tree.groups_by_base(dirs, "parent", "name").select("base", "members")


@query("SELECT lower(p_name) AS base, CASE WHEN bool_or(p_size % 2 = 0) THEN upper(min(p_name)) ELSE min(p_name) END AS canonical FROM part GROUP BY 1 HAVING count(DISTINCT p_size) >= 2")
def canonical_name(spark, sf_dir):
    name = F.concat(F.when(F.col("p_size") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")), F.lit(" ch. "), "p_size")
    dirs = table(spark, sf_dir, "part").select(F.lit("lib").alias("parent"), name.alias("name")).distinct()
    return tree.groups_by_base(dirs, "parent", "name").select("base", "canonical")


@query("SELECT p_partkey, p_name || ' ch. ' || p_size || ' Wow!! 9 word-end' AS name FROM part")
def dup_tokens(spark, sf_dir):
    name = F.concat("p_name", F.lit(" ch. "), "p_size", F.lit(" ch."), "p_size", F.lit(" Wow! ! 9 9 word -end"))
    return table(spark, sf_dir, "part").select("p_partkey", N.without_repeats(name).alias("name"))


# ---- ranges and pages


@query("""
WITH s AS (SELECT l_orderkey, min(l_linenumber) AS a, max(l_linenumber) AS b FROM lineitem GROUP BY 1),
e AS (SELECT l_orderkey, unnest(generate_series(a, b)) AS number FROM s)
SELECT e.l_orderkey, CAST(e.number AS DOUBLE) AS number, d.l_orderkey IS NOT NULL AS present
FROM e LEFT JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) d ON d.l_orderkey = e.l_orderkey AND d.l_linenumber = e.number
""")
def range_expand(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("double").alias("number"))
    spans = lines.groupBy("l_orderkey").agg(F.min("number").alias("start"), F.max("number").alias("end"))
    have = lines.distinct().withColumn("present", F.lit(True))
    return ranges.expanded(spans).join(have, ["l_orderkey", "number"], "left").select("l_orderkey", "number", F.coalesce("present", F.lit(False)).alias("present"))


@query("""
WITH d AS (SELECT DISTINCT l_orderkey AS series, l_linenumber AS n FROM lineitem), e AS (SELECT series, unnest(generate_series(1, 7)) AS n FROM (SELECT DISTINCT series FROM d))
SELECT e.series, count(d.n) AS found, count(*) - count(d.n) AS missing FROM e LEFT JOIN d ON d.series = e.series AND d.n = e.n GROUP BY 1
""")
def range_overlap(spark, sf_dir):
    singles = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("series"), F.col("l_linenumber").cast("double").alias("number"), F.col("l_partkey").alias("path"))
    spans = singles.select("series").distinct().select("series", F.lit("1-7").alias("id"), F.lit(1.0).alias("start"), F.lit(7.0).alias("end"))
    return ranges.overlap(spans, singles, "series").select("series", F.size("found").cast("long").alias("found"), F.size("missing").cast("long").alias("missing"))


@query("""
WITH n AS (SELECT DISTINCT p_brand AS series, CAST(p_size AS DOUBLE) AS n FROM part), g AS (SELECT series, n, lead(n) OVER (PARTITION BY series ORDER BY n) - n AS gap FROM n)
SELECT series, CAST(150 AS DOUBLE) AS suspect, CAST(1 AS DOUBLE) AS "start", CAST(50 AS DOUBLE) AS "end" FROM g GROUP BY series
HAVING max(n) >= 50 AND bool_or(n = 1) AND 150 - max(n) > 2 * coalesce(median(gap), 1)
""")
def range_suspect(spark, sf_dir):
    sizes = table(spark, sf_dir, "part").select("p_brand", "p_size")
    numbers = sizes.unionByName(sizes.withColumn("p_size", F.lit(150)))
    return ranges.suspects(numbers, "p_brand", "p_size").select(F.col("p_brand").alias("series"), "suspect", "start", "end")


PAGES_SQL = """
WITH a AS (SELECT l_orderkey AS g, l_partkey AS entry, CASE WHEN l_returnflag = 'R' THEN '.png' ELSE '.jpg' END AS ext, CAST(l_quantity AS BIGINT) AS size, l_linestatus = 'F' AS old,
  row_number() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos, count(*) OVER (PARTITION BY l_orderkey, l_linestatus) AS k FROM lineitem)
SELECT x.g AS "group", x.pos, CASE WHEN w THEN y_entry ELSE x.entry END AS winner_entry, 'page_' || lpad(CAST(x.pos AS VARCHAR), 4, '0') || CASE WHEN w THEN y_ext ELSE x.ext END AS new_name, w AS upgraded
FROM (SELECT o.*, n.entry AS y_entry, n.ext AS y_ext, CASE WHEN (o.ext = '.png') <> (n.ext = '.png') THEN n.ext = '.png' ELSE n.size > o.size END AS w
      FROM a o JOIN a n ON o.g = n.g AND o.pos = n.pos AND o.k = n.k AND o.old AND NOT n.old) x
"""


@query(PAGES_SQL)
def page_best_of(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("group"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("order"), F.col("l_partkey").alias("entry"),
        F.when(F.col("l_returnflag") == "R", ".png").otherwise(".jpg").alias("ext"), F.col("l_quantity").cast("long").alias("size"), "l_linestatus",
    )
    plan = ranges.page_plan(rows.where("l_linestatus = 'F'"), rows.where("l_linestatus = 'O'"), "group")
    return plan.select("group", "pos", "winner_entry", "new_name", "upgraded")


# ---- trees, pairs


@query(r"""
WITH d AS (SELECT DISTINCT regexp_replace(regexp_extract(url, '^https?://([^?#]*)', 1), '/[^/]*$', '') AS dir_path FROM pages)
SELECT dir_path FROM d WHERE NOT EXISTS (SELECT 1 FROM d u WHERE starts_with(d.dir_path, u.dir_path || '/'))
""")
def series_dirs(spark, sf_dir):
    files = table(spark, sf_dir, "pages").select(F.regexp_replace(F.regexp_extract("url", "^https?://([^?#]*)", 1), r"/[^/]*$", "").alias("dir_path"))
    return tree.series_dirs(files, "dir_path")


@query("SELECT parent, count(DISTINCT name) AS siblings FROM (SELECT regexp_extract(url, '^https?://([^/?#]+)/([^/?#]+)', 1) AS parent, regexp_extract(url, '^https?://([^/?#]+)/([^/?#]+)', 2) AS name FROM pages) GROUP BY 1 HAVING count(DISTINCT name) >= 2")
def sibling_groups(spark, sf_dir):
    dirs = table(spark, sf_dir, "pages").select(*(F.regexp_extract("url", "^https?://([^/?#]+)/([^/?#]+)", i).alias(n) for i, n in ((1, "parent"), (2, "name"))))
    return tree.sibling_groups(dirs, "parent", "name")


@query("SELECT l_orderkey, count(*) AS entries FROM lineitem GROUP BY 1 HAVING bool_or(l_returnflag = 'R') AND bool_and(l_linestatus <> 'O' AND l_returnflag IN ('R', 'A'))")
def image_folder(spark, sf_dir):
    flag = F.col("l_returnflag")
    return tree.image_folders(table(spark, sf_dir, "lineitem"), "l_orderkey", F.col("l_linestatus") == "O", flag == "R", flag == "A")


@query("""
WITH n AS (SELECT DISTINCT p_name || CASE WHEN p_size % 3 = 0 THEN ' (Uncensored)' WHEN p_size % 3 = 1 THEN '!' ELSE ' x' END AS name FROM part),
k AS (SELECT name, trim(regexp_replace(regexp_replace(lower(regexp_replace(name, '\\b(uncensored|decensored)\\b', '', 'gi')), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS key, regexp_matches(name, '\\b(uncensored|decensored)\\b', 'i') AS m FROM n)
SELECT a.name AS marked, (SELECT max_by(b.name, lower(b.name)) FROM k b WHERE NOT b.m AND b.key = a.key) AS plain, a.key FROM k a WHERE a.m
""")
def marker_pairs(spark, sf_dir):
    size = F.col("p_size") % 3
    names = table(spark, sf_dir, "part").select(F.concat("p_name", F.when(size == 0, " (Uncensored)").when(size == 1, "!").otherwise(" x")).alias("name")).distinct()
    return tree.marker_pairs(names, "name", decompose=False)


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    both = parts.select("p_type", "p_name").union(parts.where("p_size % 7 = 0").select("p_type", F.concat("p_name", F.lit("s"))))
    return both.distinct().toDF("parent", "name")


@query("""
WITH n AS (SELECT DISTINCT p_type AS parent, p_name AS name FROM part UNION SELECT DISTINCT p_type, p_name || 's' FROM part WHERE p_size % 7 = 0)
SELECT a.parent, a.name AS name_a, b.name AS name_b, 1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)) AS likeness
FROM n a JOIN n b ON a.parent = b.parent AND a.name < b.name WHERE 1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)) >= 0.8
""")
def fuzzy_edit(spark, sf_dir):
    return match.edit_matches(part_names(spark, sf_dir), "parent", "name")


def block_sql(a: str, b: str, alo: str, ahi: str, blo: str, bhi: str) -> str:
    """The longest block that a[alo:ahi] and b[blo:bhi] share, of those the first in a: a struct (k, i) with i negative."""
    part = f"substr({b}, CAST({blo} AS BIGINT) + 1, CAST({bhi} - {blo} AS BIGINT))"
    return (
        f"list_max(flatten(list_transform(range({alo}, {ahi}), lambda i: list_transform(range(1, least({ahi} - i, {bhi} - {blo}) + 1),"
        f" lambda k: CASE WHEN contains({part}, substr({a}, i + 1, k)) THEN struct_pack(k := k, i := -i) END))))"
    )


#: The matching blocks of each pair, split left and right of the longest again and again.
FUZZY_SQL = f"""
WITH RECURSIVE n AS (SELECT DISTINCT p_type AS parent, p_name AS name FROM part UNION SELECT DISTINCT p_type, p_name || 's' FROM part WHERE p_size % 7 = 0),
c AS (SELECT a.parent, a.name AS a, b.name AS b FROM n a JOIN n b ON a.parent = b.parent AND a.name < b.name WHERE 2.0 * least(length(a.name), length(b.name)) / (length(a.name) + length(b.name)) >= 0.8),
s AS (
  SELECT parent, a, b, CAST(0 AS BIGINT) AS alo, CAST(length(a) AS BIGINT) AS ahi, CAST(0 AS BIGINT) AS blo, CAST(length(b) AS BIGINT) AS bhi, {block_sql("a", "b", "0", "length(a)", "0", "length(b)")} AS m FROM c
  UNION ALL
  SELECT parent, a, b, x.alo, x.ahi, x.blo, x.bhi, {block_sql("a", "b", "x.alo", "x.ahi", "x.blo", "x.bhi")} FROM (
    SELECT parent, a, b, unnest([struct_pack(alo := alo, ahi := -m.i, blo := blo, bhi := j), struct_pack(alo := m.k - m.i, ahi := ahi, blo := j + m.k, bhi := bhi)]) AS x
    FROM (SELECT *, blo + strpos(substr(b, blo + 1, bhi - blo), substr(a, 1 - m.i, m.k)) - 1 AS j FROM s WHERE m IS NOT NULL)
  ) WHERE x.alo < x.ahi AND x.blo < x.bhi
), r AS (SELECT parent, a AS name_a, b AS name_b, 2.0 * sum(m.k) / (length(a) + length(b)) AS ratio FROM s WHERE m IS NOT NULL GROUP BY parent, a, b HAVING 2.0 * sum(m.k) / (length(a) + length(b)) >= 0.8)
"""


@query(FUZZY_SQL + "SELECT parent, name_a, name_b, CAST(ratio AS DOUBLE) AS ratio, CASE WHEN ratio >= 0.9 THEN 'auto' ELSE 'review' END AS decision FROM r")
def fuzzy_match(spark, sf_dir):
    return match.matches(part_names(spark, sf_dir), "parent", "name")


@query(FUZZY_SQL + """, f AS (SELECT p_type AS parent, p_name AS name, count(*) AS files FROM part GROUP BY 1, 2),
o AS (
  SELECT r.parent, ratio, name_a, name_b, row_number() OVER (PARTITION BY r.parent ORDER BY ratio DESC, name_a, name_b) AS k,
         coalesce(x.files, 0) > coalesce(y.files, 0) OR coalesce(x.files, 0) = coalesce(y.files, 0) AND (length(name_a) > length(name_b) OR length(name_a) = length(name_b) AND name_a < name_b) AS first
  FROM r LEFT JOIN f x ON x.parent = r.parent AND x.name = name_a LEFT JOIN f y ON y.parent = r.parent AND y.name = name_b
), w AS (
  SELECT parent, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS gone, CAST(NULL AS VARCHAR) AS primary_name, CAST(NULL AS VARCHAR) AS secondary_name, CAST(NULL AS DOUBLE) AS ratio FROM (SELECT DISTINCT parent FROM o)
  UNION ALL
  SELECT o.parent, o.k, CASE WHEN passed OR o.ratio < 0.9 THEN gone ELSE list_append(gone, s) END, CASE WHEN NOT passed THEN p END, CASE WHEN NOT passed THEN s END, o.ratio
  FROM (SELECT w.gone, o.*, list_contains(w.gone, name_a) OR list_contains(w.gone, name_b) AS passed, CASE WHEN first THEN name_a ELSE name_b END AS p, CASE WHEN first THEN name_b ELSE name_a END AS s
        FROM w JOIN o ON o.parent = w.parent AND o.k = w.k + 1) o
)
SELECT parent, primary_name, secondary_name, ratio, CASE WHEN ratio >= 0.9 THEN 'auto' ELSE 'review' END AS decision FROM w WHERE primary_name IS NOT NULL
""")
def fuzzy_greedy(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    counts = parts.groupBy(F.col("p_type").alias("parent"), F.col("p_name").alias("name")).agg(F.count(F.lit(1)).alias("files"))
    return match.greedy(match.matches(part_names(spark, sf_dir), "parent", "name"), counts)


# ---- events


@query("""
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 6 HOUR AS settled, count(*) AS events FROM g GROUP BY user_id, k
""")
def settle_sessions(spark, sf_dir):
    return settle.sessions(table(spark, sf_dir, "events"), "user_id", "ts", "6 hours")


@query("""
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
SELECT user_id, min(ts) AS started, greatest(max(ts) + INTERVAL 6 HOUR, min(ts) + INTERVAL 12 HOUR) AS ready_at FROM g GROUP BY user_id, k
""")
def settle_ready(spark, sf_dir):
    return settle.ready(settle.sessions(table(spark, sf_dir, "events"), "user_id", "ts", "6 hours"), "started", 12 * 3600).select("user_id", "started", "ready_at")


@query("""
WITH r AS (SELECT user_id, event_id, value > 20 AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)
SELECT user_id, min(CASE WHEN q AND k >= 3 THEN event_id END) AS stable_at
FROM (SELECT *, v = lag(v) OVER w AND lag(v) OVER w = lag(v, 2) OVER w AS q FROM r WINDOW w AS (PARTITION BY user_id ORDER BY k)) WHERE k <= 30 GROUP BY 1
""")
def stability(spark, sf_dir):
    samples = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") > 20).cast("int").alias("size"))
    return settle.stable_at(samples, "user_id", "event_id", "size")


# ---- sorting, logs, configuration


MODES = {"newest": ("c_acctbal", True), "oldest": ("c_acctbal", False), "alpha": ("name", False), "alpha-reverse": ("name", True)}
MODES_SQL = " UNION ALL ".join(
    f"SELECT '{mode}' AS mode, row_number() OVER (ORDER BY {key} {'DESC' if down else 'ASC'}, c_custkey) AS place, c_custkey FROM (SELECT *, lower(c_name) AS name FROM customer)"
    for mode, (key, down) in MODES.items()
)


@query(MODES_SQL)
def sort_modes(spark, sf_dir):
    """Every unit with its place in each order."""
    rows = table(spark, sf_dir, "customer")
    out = (tree.placed(rows, mode, "c_acctbal", "c_name", "c_custkey").select(F.lit(mode).alias("mode"), "place", "c_custkey") for mode in MODES)
    return reduce(DataFrame.unionByName, out)


@query(MODES_SQL)
def sort_modes_whole(spark, sf_dir):
    return sort_modes(spark, sf_dir)


@query("SELECT conv_id, turn, CASE WHEN t LIKE '%error%' OR t LIKE '%failed%' THEN 'error' WHEN t LIKE '%warning%' OR t LIKE '%warn%' OR t LIKE '%skipping%' THEN 'warn' WHEN t LIKE '%complete%' OR t LIKE '%done%' OR t LIKE '%success%' THEN 'success' ELSE 'info' END AS severity FROM (SELECT *, lower(text) AS t FROM conversations)")
def log_classify(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", N.log_severity(F.col("text")).alias("severity"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT 'both' AS side, count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT 'only documents', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)")
def rule_sets(spark, sf_dir):
    a, b = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    count = lambda df, side: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(side).alias("side"), "n")
    return count(a.intersect(b), "both").unionByName(count(a.subtract(b), "only documents"))
