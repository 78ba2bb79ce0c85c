import hashlib
import re

from pyspark.sql import functions as F

from tidyshelf.llm import infilling

HOLDS = re.compile("<[PSM]>")


def arranged(doc_id, text):
    """Brute force: (n, form, prefix, middle, suffix, output)."""
    text = text or ""
    u = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or HOLDS.search(text) or h3 % 100 >= 90:
        return len(u), "plain", None, None, None, text
    if h4 % 100 < 20:
        return len(u), "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}"


def held(df, **options):
    got = infilling.fill_in_middle(df, **options).withColumn("back", infilling.restored(F.col("output"), F.col("form"))).collect()
    texts = [(r.doc_id, r.text) for r in df.collect()]
    key = lambda x: tuple(map(str, x))
    want = sorted(((i, *arranged(i, t), t or "") for i, t in texts), key=key)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix, r.middle, r.suffix, r.output, r.back) for r in got), key=key) == want
    return got


def test_arrangements(docs, odd, none):
    assert {r.form for r in held(docs)} == {"plain", "psm", "spm"}
    held(odd)
    held(odd.select("doc_id", "text"), block=3)  # cuts at, before and behind every kind of joint
    assert infilling.fill_in_middle(none).count() == 0


def test_blocks_of_any_size_and_sentinels(spark):
    texts = ["", "a", "ab cd", "<P>", "<P", "<", "x<S>y", "<M", "M>", "a🙂b\n\nc\r\n", "é" * 9, "<" * 7 + ">" * 7, "$1 \\2 $", "ab" * 40 + " " + "1" * 40]
    df = spark.createDataFrame([(i, t) for i in range(40) for t in texts], "doc_id long, text string").repartition(2)
    for block in (1, 2, 7, 1024):
        held(df, block=block)


def test_long_texts(spark):
    df = spark.createDataFrame([(1, "12 " * 700_000), (2, "abc" * 700_000), (3, "a1" * 300_000)], "doc_id long, text string").repartition(1)
    held(df)


def test_other_draws(spark):
    df = spark.createDataFrame([(i, "one two three") for i in range(50)], "doc_id long, text string")
    assert {r.form for r in infilling.fill_in_middle(df, plain_percent=0, spm_percent=100).collect()} == {"spm"}
    assert {r.form for r in infilling.fill_in_middle(df, plain_percent=100).collect()} == {"plain"}
    once, again = (sorted(infilling.fill_in_middle(df, seed=s).collect()) for s in (1, 2))
    assert once != again
