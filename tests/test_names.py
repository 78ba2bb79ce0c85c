"""Golden rows of the name, number and tag functions."""

import pytest
from pyspark.sql import functions as F

from tidyshelf.functions import names as N
from tidyshelf.functions import tags as G


def values(spark, column, rows, *names):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{n} string" for n in names or ("x",)))
    return [r[0] for r in df.orderBy("i").select(column).collect()]


REPEATS = [
    ("My Comic ver. 9 ver.9", "My Comic ver. 9"), ("Title ch. 12 ch.12", "Title ch. 12"), ("Story chapter 5 Chapter 5", "Story chapter 5"),
    ("Vol. 3 vol.3 Extra", "Vol. 3 Extra"), ("Episode 7 ep.7", "Episode 7"), ("Part 2 pt.2", "Part 2"), ("Something 9 9", "Something 9"),
    ("A 12 12 B", "A 12 B"), ("Wow! !", "Wow!!"), ("Wait.. .", "Wait..."), ("Really?  ?  ?", "Really???"), ("word -next", "word-next"),
    ("word- next", "word-next"), ("word - next", "word - next"), ("ch. 5 ch.5 Wow! ! word -end", "ch. 5 Wow!! word-end"),
    ("ch. 1 ch.12", "ch. 1 ch.12"), ("", ""),
]


def test_repeated_tokens(spark):
    assert values(spark, N.without_repeats(F.col("x")), [a for a, _ in REPEATS]) == [b for _, b in REPEATS]


def test_sanitize_and_directories(spark):
    assert values(spark, N.sanitize(F.col("x")), ["Batman G1234", "A &amp; B [x] (y) z", "a_b  c", "My-Scans Title www.x.com", None]) == ["Batman", "A & B z", "a b c", "Title", None]
    assert values(spark, N.clean_directory(F.col("x")), ["# Batman", "Batman #", "Series v", "Batman - ch", "Dev"]) == ["Batman", "Batman", "Series", "Batman", "De"]
    assert values(spark, N.clean_directory(F.col("x"), strict=True), ["Dev", "Batman - ch"]) == ["Dev", "Batman"]
    assert values(spark, N.clean_filename(F.col("x")), ["a [x].cbz", ".cbz", "noext"]) == ["a.cbz", ".cbz", "noext"]


def test_rules_are_chosen_by_name(spark):
    assert N.chosen_rules("url, nothing") == {"url"} and N.chosen_rules("") == N.P.RULES and N.chosen_rules("nothing") == set()
    assert values(spark, N.sanitize(F.col("x"), N.chosen_rules("url")), ["[a] www.b.com"]) == ["[a]"]


@pytest.mark.parametrize("f, cases", [
    (N.chapter_text, [("Batch 5", "5"), ("Step 3", "3"), ("Vol. 2", None), ("x ch 1.2.3", None), ("x ch. 012.50", "12.5"), ("# 7", "7"), ("ch 12345678.5", "12345678.5")]),
    (N.volume_text, [("x v2 y", "2"), ("Vol. 3", "3"), ("v2x", None), ("av10", "10")]),
    (lambda c: N.issue_number(c).cast("string"), [("x 12", "12.0"), ("ep 12345", None), ("12", None), ("issue 4", "4.0")]),
    (N.dedup_key, [("Batman - Ch. 12", "batmanch12"), ("Batman Ch.12", "batmanch12")]),
    (N.base_name, [("Batman ch. 1", "batman"), ("batman ch2", "batman"), ("Batman Chapter 7", "batman"), ("Batman", None), ("12", None)]),
    (N.compare_key, [("Batman: Year One", "batman year one"), ("Batman Year  One", "batman year one")]),
    (N.marker_key, [("Café (Uncensored)!", "cafe"), ("CAFE", "cafe")]),
    (N.number_tokens, [("x ch. 005", "x ch. 5"), ("v1.50", "v1.5"), ("ch 1.2.3", "ch 1.2.3"), ("vol 02 ep 3.0", "vol 2 ep 3")]),
    (N.log_severity, [("Failed!", "error"), ("warned", "warn"), ("all DONE", "success"), ("x", "info")]),
])
def test_keys_and_numbers(spark, f, cases):
    assert values(spark, f(F.col("x")), [a for a, _ in cases]) == [b for _, b in cases]


def test_stems_by_profile(spark):
    rows = [("Chapter 5", "Batman"), ("0123456789abcdef", "Batman"), ("Unknown Chapter 07 - x", "Batman"), ("ch - 3", "Batman"), ("Own name", "Batman"), ("manga chapter", "Batman")]
    live = values(spark, N.normal_stem(F.col("x"), F.col("d"), "live"), rows, "x", "d")
    assert live == ["Batman Ch. 5", "Batman", "Batman Ch. 7 x", "Batman Ch. 3", "Own name", "Batman"]
    batch = values(spark, N.normal_stem(F.col("x"), F.col("d"), "batch"), rows, "x", "d")
    assert batch == ["Batman", "Batman", "Batman Chapter 07 x", "Batman Ch. 3", "Own name", "manga chapter"]


def test_ranges(spark):
    start, end = N.number_range(F.col("x"))
    assert values(spark, F.concat_ws("|", start, end), ["Batman Ch. 1-5", "Batman ch 3 – 4.5", "ch 3"]) == ["1.0|5.0", "3.0|4.5", ""]
    assert values(spark, N.renamed_for_range(F.col("x"), F.lit(1.0), F.lit(5.5)), ["A ch. 15 ch. 2", "A$ 15"]) == ["A ch. 1-5.5 ch. 2", "A$ 15 1-5.5"]


def test_tags(spark):
    xml = "<ComicInfo>\n  <title>a$1\\b</title>\n</ComicInfo>"
    assert values(spark, G.get_tag(F.col("x"), "Title"), [xml, "<a/>"]) == ["a$1\\b", None]
    assert values(spark, G.set_tag(F.col("x"), "Title", "$2\\"), [xml]) == ["<ComicInfo>\n  <Title>$2\\</Title>\n</ComicInfo>"]
    assert values(spark, G.set_tag(F.col("x"), "Volume", "2", after="Title"), [xml]) == [xml.replace("</title>", "</title>\n  <Volume>2</Volume>")]
    assert values(spark, G.set_tag(F.col("x"), "Number", "a<b", escape=True), [xml]) == [xml.replace("</ComicInfo>", "  <Number>a&lt;b</Number>\n</ComicInfo>")]
    assert values(spark, G.set_number(F.col("x"), F.lit("5")), ["<Number> 5 </Number>"]) == ["<Number> 5 </Number>"]


def test_retagging(spark):
    xml = "<ComicInfo>\n  <Title>Chapter 5</Title>\n  <Series>Bat [x]</Series>\n</ComicInfo>"
    rows = spark.createDataFrame([(1, xml, "Own v2 ch. 5", "Bat"), (2, None, "Chapter 3", "Bat"), (3, "<Title>Own</Title>", "plain", "Bat")], "i int, xml string, stem string, parent string")
    batch = {r.i: r.new_xml for r in G.retagged(rows, "xml", "stem", "parent").collect()}
    assert batch[1] == "<ComicInfo>\n  <Title>Own v2 ch. 5</Title>\n  <Series>Bat</Series>\n  <Volume>2</Volume>\n  <Number>5</Number>\n</ComicInfo>"
    assert "<Title>Bat</Title>" in batch[2] and "<Number>3</Number>" in batch[2] and batch[3] is None
    live = {r.i: r.new_xml for r in G.retagged(rows, "xml", "stem", "parent", "live").collect()}
    assert "<Volume>" not in live[1] and "<Title></Title>" in live[2] and live[3] is None


def test_entities_as_html_readers_see_them(spark):
    import html
    import random

    rng = random.Random(2)
    names = ["amp", "lt;", "gt", "quot;", "copy", "copyx", "notit;", "notin;", "nbsp;", "Aacute", "hellip;", "fjlig;", "bne;", "zz;", "no", "AMP", "CounterClockwiseContourIntegral;", "not", "&", ""]
    codes = ["#38;", "#038", "#x26;", "#X26", "#0;", "#x0", "#128;", "#x80;", "#129;", "#13;", "#11;", "#1;", "#55296;", "#xD800;", "#1114112;", "#99999999999999999999;", "#xFFFFFFFFFF;", "#x1F642;", "#65534;", "#x1FFFE;", "#64976;", "#", "#x", "#x;", "#;", "#12a"]
    texts = [f"a &{x} b" for x in names + codes] + ["&amp;lt;", "&&amp;&", "no entity", "", "x&", None]
    texts += ["".join(rng.choice(["&", "amp", ";", "#", "x", "4", "1", "lt", "copy", " ", "é", "<", "n"]) for _ in range(rng.randrange(12))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", N.unescape(F.col("t")).alias("u")).collect():
        assert r.u == (html.unescape(r.t) if r.t is not None else None), r.t
    assert "Python" not in df.select(N.sanitize(F.col("t")))._jdf.queryExecution().executedPlan().toString()


def test_tokens_rewritten_one_by_one(spark):
    """Against replacing with a function, match by match."""
    import random
    import re

    from tidyshelf.functions import patterns as P

    token = re.compile(P.NUMBER_TOKEN.replace("(?iU)", ""), re.IGNORECASE)
    label = re.compile(rf"({P.LABEL}\.?\s*\d+(?:\.\d+)?)\s+{P.LABEL}\.?\s*(\d+(?:\.\d+)?)", re.IGNORECASE)

    def plain(m):
        try:
            n = float(m[2])
        except ValueError:
            return m[0]
        return m[1] + (str(int(n)) if n == int(n) else str(n))

    once = lambda m: m[1] if re.search(r"\d+(?:\.\d+)?", m[1])[0] == m[2] else m[0]
    rng = random.Random(3)
    texts = ["".join(rng.choice(["ch", "Ch.", " ", "  ", "v", "vol", "ep ", "part", "0", "00", "5", "12", ".", ".50", "x", "-", "issue", "１２", "٥"]) for _ in range(rng.randrange(14))) for _ in range(600)] + ["", None, "ch 1 ch 2 ch 2", "v1 v1 v1", "ch. 99999999999999999999"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", N.number_tokens(F.col("t")).alias("n"), N.label_once(F.col("t")).alias("l")).collect():
        if r.t is None or len(re.sub(r"\D", "", r.t)) < 16:
            assert r.n == (token.sub(plain, r.t) if r.t is not None else None), r.t
        assert r.l == (label.sub(once, r.t) if r.t is not None else None), r.t
