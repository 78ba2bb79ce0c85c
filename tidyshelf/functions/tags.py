"""Metadata documents as columns: tags are read and set in the text, other content stays as it is.

Values are spliced in with concat, never as replacement patterns, so ``$`` and backslashes in titles are safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import names as N
from . import patterns as P


def text_of(c: Column | str) -> Column:
    return c if isinstance(c, Column) else F.lit(c)


def get_tag(xml: Column, tag: str) -> Column:
    """The first such tag's content; null without the tag."""
    pattern = rf"(?is)<{tag}>(.*?)</{tag}>"
    return F.when(xml.rlike(pattern), F.regexp_extract(xml, pattern, 1))


def escaped(value: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        value = F.replace(value, F.lit(char), F.lit(entity))
    return value


def _spliced(xml: Column, pattern: str, middle: Column) -> Column:
    """xml with the first match of pattern replaced by middle."""
    found = F.regexp_extract(xml, f"(?is)({pattern})", 1)
    at = F.length(F.regexp_extract(xml, rf"(?is)^(.*?){pattern}", 1))
    return F.concat(xml.substr(F.lit(1), at), middle, xml.substr(at + F.length(found) + 1, F.length(xml)))


def set_tag(xml: Column, tag: str, value: Column | str, after: str | None = None, escape: bool = False) -> Column:
    """The tag's first occurrence set; else inserted after another tag; else before the end of the document."""
    value = escaped(text_of(value)) if escape else text_of(value)
    new = F.concat(F.lit(f"<{tag}>"), value, F.lit(f"</{tag}>"))
    pattern = rf"<{tag}>.*?</{tag}>"
    out = F.when(xml.rlike(f"(?is){pattern}"), _spliced(xml, pattern, new))
    if after:
        anchor = F.regexp_extract(xml, f"(?i)(</{after}>)", 1)
        out = out.when(anchor != "", _spliced(xml, f"</{after}>", F.concat(anchor, F.lit("\n  "), new)))
    return out.otherwise(F.replace(xml, F.lit("</ComicInfo>"), F.concat(F.lit("  "), new, F.lit("\n</ComicInfo>"))))


def set_number(xml: Column, number: Column) -> Column:
    """The number tag set, unless its trimmed content is the number already."""
    return F.when(N.strip(get_tag(xml, "Number")).eqNullSafe(number), xml).otherwise(set_tag(xml, "Number", number))


def set_range(xml: Column, start: Column, end: Column) -> Column:
    return set_tag(xml, "Number", N.range_text(start, end))


def decided_title(title: Column, parent: Column, stem: Column, profile: str = "batch") -> Column:
    """The title that replaces a cleaned one; null where it stays.

    A title that repeats the directory, or is generic, gives way to a telling file name, a generic one with a generic file
    name to the directory's name.
    """
    generic = N.is_generic(title, profile) | (N.is_gibberish(title) if profile == "batch" else F.lit(False))
    file_generic = N.is_generic(stem, profile)
    return (
        F.when((title == parent) & ~file_generic, stem)
        .when(title == parent, F.lit(None).cast("string"))
        .when(generic & ~file_generic, stem)
        .when(generic, parent)
    )


def from_template(title: Column, series: Column, number: Column, volume: Column) -> Column:
    """A new document for archives without one."""
    xml = F.lit(P.TEMPLATE)
    xml = F.replace(xml, F.lit("<Title></Title>"), F.concat(F.lit("<Title>"), title, F.lit("</Title>")))
    xml = F.replace(xml, F.lit("<Series></Series>"), F.concat(F.lit("<Series>"), series, F.lit("</Series>")))
    xml = F.replace(xml, F.lit("<Number></Number>"), F.concat(F.lit("  <Number>"), F.coalesce(number, F.lit("")), F.lit("</Number>")))
    return F.when(volume.isNull(), xml).otherwise(set_tag(xml, "Volume", volume, after="Series"))


def retagged(rows: DataFrame, xml: str, stem: str, parent: str, profile: str = "batch", rules: frozenset[str] = P.RULES, only_changed: bool = False) -> DataFrame:
    """Adds ``new_xml``: what an archive's document becomes; null where nothing is to be written.

    The batch profile also sets number and volume; series alone being cleaned is not written. Documents that are missing
    (null) are made from the template, empty in the live profile. Steps are columns of their own, so that each is computed
    once. Filter with ``only_changed``: a row number in its condition keeps it above the steps, where Catalyst would else
    write them out into the condition again and again.
    """
    x, name, up = F.col(xml), F.col(stem), F.col(parent)
    r = rows.withColumns({"__series": N.strip(get_tag(x, "Series")), "__title": F.coalesce(N.strip(get_tag(x, "Title")), F.lit("")), "__bare": N.bare_title(name, rules, profile)})
    r = r.withColumns({"__clean": N.sanitize(F.col("__series")), "__title": N.sanitize(F.col("__title"))})
    r = r.withColumns({"__title": N.bare_title(F.col("__title"), rules, profile), "__xml": F.when(F.col("__clean") != F.col("__series"), set_tag(x, "Series", F.col("__clean"))).otherwise(x)})
    r = r.withColumn("__new", decided_title(F.col("__title"), up, F.col("__bare"), profile))
    r = r.withColumn("__xml", F.when(F.col("__new").isNotNull() & get_tag(F.col("__xml"), "Title").isNotNull(), set_tag(F.col("__xml"), "Title", F.col("__new"))).otherwise(F.col("__xml")))
    if profile == "live":
        out = F.when(x.isNull(), F.lit(P.TEMPLATE)).when(F.col("__new").isNotNull(), F.col("__xml"))
    else:
        r = r.withColumns({"__number": N.chapter_text(name), "__volume": N.volume_text(name)})
        r = r.withColumn("__xml", F.when(F.col("__number").isNotNull(), set_tag(F.col("__xml"), "Number", F.col("__number"))).otherwise(F.col("__xml")))
        placed = get_tag(F.col("__xml"), "Volume").isNotNull() | get_tag(F.col("__xml"), "Series").isNotNull()
        r = r.withColumn("__xml", F.when(F.col("__volume").isNotNull() & placed, set_tag(F.col("__xml"), "Volume", F.col("__volume"), after="Series")).otherwise(F.col("__xml")))
        title = F.when(~N.is_generic(F.col("__bare")) & ~N.is_gibberish(F.col("__bare")), F.col("__bare")).otherwise(up)
        changed = F.col("__new").isNotNull() | F.col("__number").isNotNull() | F.col("__volume").isNotNull()
        out = F.when(x.isNull(), from_template(title, up, F.col("__number"), F.col("__volume"))).when(changed, F.col("__xml"))
    r = r.withColumn("new_xml", out)
    if only_changed:
        r = r.withColumn("__row", F.monotonically_increasing_id())
        r = r.where((F.col("__row") >= 0) & F.col("new_xml").isNotNull() & ~F.col("new_xml").eqNullSafe(x))
    return r.select(*rows.columns, "new_xml")


def series_tags(rows: DataFrame, xml: str, stem: str, series: str) -> DataFrame:
    """Adds ``new_xml`` for files of a merged series: series and title always, volume and number where the name has them.

    A number of 0 is not written. Documents that are missing (null) are made from the short template.
    """
    name = F.col(stem)
    r = rows.withColumn("new_xml", F.coalesce(F.col(xml), F.lit(P.SHORT_TEMPLATE))).withColumns({"__volume": N.volume_text(name), "__number": N.chapter(name)})
    r = r.withColumn("new_xml", set_tag(F.col("new_xml"), "Series", F.col(series), after="Title")).withColumn("new_xml", set_tag(F.col("new_xml"), "Title", name))
    r = r.withColumn("new_xml", F.when(F.col("__volume").isNull(), F.col("new_xml")).otherwise(set_tag(F.col("new_xml"), "Volume", F.col("__volume"), after="Series")))
    number, old = N.format_number(F.col("__number")), F.col("new_xml")
    numbered = F.when(F.col("__volume").isNull(), set_tag(old, "Number", number, after="Series")).otherwise(set_tag(old, "Number", number, after="Volume"))
    return r.withColumn("new_xml", F.when(F.col("__number") != 0, numbered).otherwise(old)).drop("__volume", "__number")
