"""Fill-in-the-middle arrangements of texts, in Spark SQL expressions alone.

A text is a row of units, runs of ASCII letters and single other characters. Two draws from the id's hash cut it into prefix,
middle and suffix between units; two more pick the form: ``plain``, ``psm`` (prefix, suffix, middle) or ``spm`` (suffix,
prefix, middle), each part behind its sentinel. ``restored`` takes an arrangement apart at its sentinels and gives the text.

Units are extracted a block at a time (some 1,024 characters, ending where a unit ends): one pass counts the units of each
block, and only the two blocks in which a cut falls become arrays that are sliced and joined. So a text of many megabytes
costs a few times its size, not an object for each character. All of it is one narrow pass without a shuffle.

Null texts are empty, and empty texts stay plain, as do texts that hold a sentinel. A null id is hashed as an empty one.
Repeated rows get equal arrangements. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, text_of

UNIT = "([A-Za-z]+|[^A-Za-z])"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def units(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(UNIT), F.lit(1))


def unit_count(text: Column) -> Column:
    """How many units, without making them: the characters once each run of letters is one."""
    return F.length(F.regexp_replace(text, "[A-Za-z]+", "a")).cast("long")


def blocks(text: Column, size: int = 1024) -> Column:
    """The text in pieces of ``size`` code points, each going on to the end of its last run of letters."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{size}}}[A-Za-z]*)"), F.lit(1))


def draws(id_col: Column, seed: int) -> list[Column]:
    """Four numbers below 2**32 from the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def place(counts: Column, cut: Column) -> Column:
    """(block, left): how many whole blocks lie before the cut, and how many units of the next one."""
    start = F.struct(F.lit(0).alias("block"), cut.alias("left"), F.lit(False).alias("found"))

    def on(s: Column, n: Column) -> Column:
        found = s["found"] | (s["left"] < n)
        return F.struct(F.when(found, s["block"]).otherwise(s["block"] + 1).alias("block"), F.when(found, s["left"]).otherwise(s["left"] - n).alias("left"), found.alias("found"))

    return F.aggregate(counts, start, on)


def joined(parts: Column, start: Column, n: Column) -> Column:
    return F.array_join(F.slice(parts, start, n), "")


def arranged(form: Column, prefix: Column, middle: Column, suffix: Column, text: Column) -> Column:
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    return F.when(form == "plain", text).when(form == "psm", psm).otherwise(spm)


def restored(output: Column, form: Column) -> Column:
    """The text of an arrangement. No sentinel can arise across a joint, as each begins and ends with its own bracket."""
    psm = F.regexp_replace(output, f"(?s)^{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*)$", "$1$3$2")
    spm = F.regexp_replace(output, f"(?s)^{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*)$", "$2$3$1")
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def fill_in_middle(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, block: int = 1024
) -> DataFrame:
    """For each row: id, n (units), form, prefix, middle, suffix (null where plain), output."""
    rows = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    rows = rows.withColumn("blocks", blocks(F.col("text"), block))
    rows = rows.withColumn("counts", F.transform("blocks", unit_count))
    rows = rows.withColumn("n", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x))
    h1, h2, h3, h4 = draws(F.col("id"), seed)
    a, b = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    rows = rows.withColumns({"first": place(F.col("counts"), F.least(a, b)), "last": place(F.col("counts"), F.greatest(a, b))})
    holds = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    form = F.when((F.col("text") == "") | holds | (h3 % 100 >= 100 - plain_percent), "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.withColumn("form", form)

    def at(cut: str) -> Column:  # the units of the block that a cut falls in
        return units(F.coalesce(F.get("blocks", F.col(cut)["block"]), F.lit("")))

    cut = F.col("form") != "plain"
    rows = rows.withColumn("first_units", F.when(cut, at("first")))
    cut_in = rows.withColumn("last_units", F.when(F.col("first")["block"] != F.col("last")["block"], at("last")).otherwise(F.col("first_units")))
    c = {k: (F.col(k)["block"], F.col(k)["left"].cast("int")) for k in ("first", "last")}
    one = F.lit(1)
    (p, i), (q, j) = c["first"], c["last"]
    head = F.concat(joined(F.col("blocks"), one, p), joined(F.col("first_units"), one, i))
    same = joined(F.col("first_units"), i + 1, j - i)
    apart = F.concat(joined(F.col("first_units"), i + 1, F.size("first_units")), joined(F.col("blocks"), p + 2, q - p - 1), joined(F.col("last_units"), one, j))
    tail = F.concat(joined(F.col("last_units"), j + 1, F.size("last_units")), joined(F.col("blocks"), q + 2, F.size("blocks")))
    parts = cut_in.select(
        "id", "text", "n", "form", F.when(cut, head).alias("prefix"), F.when(cut, F.when(p == q, same).otherwise(apart)).alias("middle"), F.when(cut, tail).alias("suffix")
    )
    output = arranged(F.col("form"), F.col("prefix"), F.col("middle"), F.col("suffix"), F.col("text"))
    return parts.select(F.col("id").alias(id_col), "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return fill_in_middle(documents(spark, sf_dir)).select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


OP13_SQL = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents
), h AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS b,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS h4 FROM t
), f AS (
  SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (
  SELECT *, array_to_string(u[1:least(a, b)], '') AS prefix, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS middle, array_to_string(u[greatest(a, b) + 1:], '') AS suffix FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
