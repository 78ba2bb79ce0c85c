import random
import subprocess
import sys

import corpus_pipeline
from tidyshelf.llm import language, stages

from .conftest import SCHEMA


def corpus(n=160):
    rng = random.Random(5)
    words = {"en": "the of and that which there".split(), "fr": "les des pour dans une avec".split()}
    rows = []
    for i in range(n):
        lang = rng.choice(("en", "fr"))
        text = " ".join(rng.choice(words[lang]) + rng.choice(("", "", str(rng.randrange(30)))) + rng.choice("abcdefgh") for _ in range(rng.randrange(20, 120)))
        rows.append((i, text, lang, f"s{i % 4}", len(text)))
    out = list(rows)
    for k, r in enumerate(rng.sample(rows, 20)):
        out.append((1000 + k, r[1].replace(" ", "  "), r[2], r[3], 0))  # equal but for spaces
        w = r[1].split()
        w[-1] = "changed"
        out.append((2000 + k, " ".join(w), r[2], r[3], 0))
    return [*out, (3000, "12 !! 34", None, "s1", 0), (3001, None, None, None, None), (3002, "", "en", "s1", 0), out[0]]


def test_run_keeps_what_it_should(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    a = stages.keep_languages(docs).cache()
    assert a.columns == docs.columns and {r.doc_id for r in docs.collect()} - {r.doc_id for r in a.collect()} == {3000, 3001, 3002}
    b = stages.keep_first_copies(a).cache()
    bare = ["".join((r.text or "").split()) for r in b.collect()]
    assert len(set(bare)) == len(bare) and set(bare) == {"".join((r.text or "").split()) for r in a.collect()}
    c = stages.keep_one_of_near_copies(b).cache()
    assert {r.doc_id for r in c.collect()} == {r.doc_id for r in b.collect() if r.doc_id < 2000 or r.doc_id not in range(2000, 2020)} - {r.doc_id for r in b.collect() if r.doc_id in range(2000, 2020)}  # every near copy links to a lower id
    d = stages.to_target_mix(c)
    assert d.columns == docs.columns and {r.doc_id for r in d.collect()} <= {r.doc_id for r in c.collect()}
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert packed.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and {r.doc_id for r in packed.collect()} == {r.doc_id for r in d.collect()}


def test_stages_take_odd_and_empty_tables(spark, odd, none):
    for _, stage in corpus_pipeline.STAGES:
        for docs in (odd, none):
            out = stage(spark, docs, "")
            assert out.count() >= 0 and (stage is corpus_pipeline.packing or out.columns == docs.columns)


def test_rows_are_dropped_for_their_own_sake(spark, tmp_path):
    """Ids that repeat with several texts, and null ids: no copy passes, and no clean row goes with its namesake."""
    filler = [(100 + i, f"a clean text number {i} of its own with many words {'ab'[i % 2] * (i + 3)} and more", "en", "s", 0) for i in range(20)]
    rows = [(1, "alpha beta", "en", "s", 0), (1, "gamma delta", "en", "s", 0), (0, "gamma delta", "en", "s", 0), (None, "gamma  delta", "en", "s", 0), (None, "own text here", "en", "s", 0), (None, "12 34", "en", "s", 0), (100, "56 78", "en", "s", 0), *filler]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    df.write.parquet(str(tmp_path / "docs"))
    for docs in (df, spark.read.parquet(str(tmp_path / "docs"))):
        assert docs.columns == stages.keep_languages(docs).columns
        left = {(r.doc_id, r.text) for r in stages.keep_languages(docs).collect()}
        assert (None, "12 34") not in left and (100, "56 78") not in left and (None, "own text here") in left and (100, filler[0][1]) in left
        once = [(r.doc_id, r.text) for r in stages.keep_first_copies(docs).collect()]
        assert sorted(once, key=str) == sorted({(r[0], r[1]) for r in rows} - {(1, "gamma delta"), (0, "gamma delta")}, key=str)  # the longer original stays
    long = " ".join(f"word{i}" for i in range(200))
    near = [(5, long, "en", "s", 0), (4, long + " tail", "en", "s", 0), (4, "quite another text than that with words of its own", "en", "s", 0), (None, "x " + long, "en", "s", 0), (None, "short", "en", "s", 0)]
    kept = {(r.doc_id, r.text) for r in stages.keep_one_of_near_copies(spark.createDataFrame(near, SCHEMA)).collect()}
    assert kept == {(4, long + " tail"), (4, near[2][1]), (None, "short")}


def test_row_numbers(spark, tmp_path, odd):
    spark.range(1000).repartition(7).write.parquet(str(tmp_path / "t"))
    for docs in (spark.read.parquet(str(tmp_path / "t")), odd):
        rows = stages.by_row(docs)
        assert rows.columns == [*docs.columns, stages.ROW] and rows.select(stages.ROW).distinct().count() == docs.count()


def test_five_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"] and language is not None


def test_an_idle_worker_keeps_no_freed_memory():
    """In a process of its own: freed blocks below one that lives go back too."""
    code = """
import re
import numpy as np
from tidyshelf.llm.common import give_back
held = lambda: int(re.search(r"VmRSS:\\s+(\\d+)", open("/proc/self/status").read())[1]) // 1024
before = held()
blocks = [np.ones(12_500) for _ in range(2000)]  # 100 KB each: from the heap, not mapped
last = blocks[-1]
del blocks
give_back()
print(held() - before)
"""
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) < 60
