"""Properties that hold for any input, each over many random cases in one job."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidyshelf.functions import names as N
from tidyshelf.operators import gaps, keep
from tidyshelf.operators.routing import glob_regex

PIECES = ["Batman", " ", "ch. 5", "ch.5", "[x]", "(y", "_", "www.a.com", "&amp;", "G1234", "!", "? ?", " -a", "é", "漫", "12 12", "#", "v2", "/", "scans"]


def names(n=400):
    rng = random.Random(11)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randrange(0, 8))) for _ in range(n)]


def test_found_and_missing_cover_every_number(spark):
    rng = random.Random(1)
    series = {f"s{i}": sorted(rng.sample(range(1, 40), rng.randrange(2, 20))) for i in range(60)}
    df = spark.createDataFrame([(s, float(n), str(n)) for s, ns in series.items() for n in ns], "s string, n double, name string")
    for r in gaps.report(df, "s", F.col("n"), "name").collect():
        missing = set()
        for run in filter(None, r.missing.split(", ")):
            a, _, b = run.partition("-")
            missing |= set(range(int(a), int(b or a) + 1))
        assert sorted(missing | set(series[r.series])) == list(range(1, series[r.series][-1] + 1)) and not missing & set(series[r.series])


def test_the_largest_is_never_lost(spark):
    rng = random.Random(2)
    rows = [(f"k{rng.randrange(20)}", rng.randrange(6), f"f{i}", i) for i in range(300)]
    schema = "k string, size long, name string, ord int"
    got = {r.k: r["size"] for r in keep.merged(spark.createDataFrame(rows[:150], schema), spark.createDataFrame(rows[150:], schema), ["k"], "size", "ord").collect()}
    assert got == {k: max(s for x, s, _, _ in rows if x == k) for k in {r[0] for r in rows}}
    kept = keep.largest(spark.createDataFrame(rows, schema), ["k"], "size", "name").where("keep").collect()
    assert all(r["size"] == got[r.k] for r in kept)
    lost = keep.losers(spark.createDataFrame(rows, schema), ["k"], "size", "name").collect()
    assert sorted(r.name for r in lost) == sorted({r[2] for r in rows} - {r.name for r in kept} - {r[2] for r in rows if sum(x[0] == r[0] for x in rows) == 1})


def test_ranks_of_a_group_that_holds_most_rows(spark):
    rng = random.Random(4)
    rows = [(None if i % 50 == 0 else "hot" if i % 3 else f"k{i % 400}", rng.randrange(40), f"f{i:04}") for i in range(3000)]
    want = {}
    for key in {r[0] for r in rows}:
        group = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))
        want.update({r[2]: (n, len(group), n == 1) for n, r in enumerate(group, 1) if len(group) > 1})
    df = spark.createDataFrame(rows, "k string, size long, name string")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    for adaptive in ("true", "false"):  # with and without small ranges put together
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        got = keep.largest(df, ["k"], "size", "name").collect()
        assert len(got) == len(want) and {r.name: (r["rank"], r.members, r.keep) for r in got} == want
    spark.conf.set("spark.sql.adaptive.enabled", before)


def test_cleaning_settles(spark):
    df = spark.createDataFrame([(x,) for x in names()], "x string")
    once = df.select(N.without_repeats(N.without_repeats(F.col("x"))).alias("x"))
    assert once.where(N.without_repeats(F.col("x")) != F.col("x")).count() <= 0.02 * df.count()
    clean = df.select(N.sanitize(F.col("x")).alias("x"))
    assert clean.where(F.col("x").rlike(r"[\[\]()_]|  |^ | $")).count() == 0
    assert df.where(N.dedup_key(N.dedup_key(F.col("x"))) != N.dedup_key(F.col("x"))).count() == 0
    assert df.where(F.concat(N.stem(F.col("x")), N.suffix(F.col("x"))) != F.col("x")).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text("ab*?.[]!-", max_size=6), st.text("ab.-", max_size=5))
def test_globs_match_as_the_shell_does(glob, text):
    from fnmatch import fnmatchcase

    try:
        ours = re.fullmatch(glob_regex(glob)[5:-1], text, re.DOTALL) is not None
    except re.error:
        return
    assert ours == fnmatchcase(text, glob)
