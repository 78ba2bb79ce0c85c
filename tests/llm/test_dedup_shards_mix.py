import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import accumulate

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidyshelf.llm import catalog, exact, mixing, neardup, sharding

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_queries_equal_their_sql(spark, tmp_path, name):
    catalog.queries()[name](spark, DATA).write.parquet(str(tmp_path / "out"))
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    sql, got = f"({catalog.oracle_sql()[name]})", f"'{tmp_path}/out/*.parquet'"
    cols = ", ".join(f'"{x[0]}"' for x in sorted(c.sql(f"DESCRIBE SELECT * FROM {sql}").fetchall()))
    for a, b in ((sql, got), (got, sql)):
        assert c.sql(f"SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b}").fetchall() == []


def test_exact_groups(odd, none):
    groups = defaultdict(list)
    rows = [(r.doc_id, r.text or "") for r in odd.collect()]
    bare = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
    for i, t in rows:
        groups[bare(t)].append((-len(t), i is None, i))
    want = Counter((i, min(groups[bare(t)])[2], len(groups[bare(t)]), hashlib.sha256(bare(t).encode()).hexdigest()) for i, t in rows)
    got = exact.exact_duplicates(odd).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = Counter(r.doc_id for r in got if r.kept)
    assert kept == Counter(min(g)[2] for g in groups.values())
    assert exact.exact_duplicates(none).count() == 0


def test_exact_groups_by_name(spark):
    rows = [("b", "x y"), ("a", "xy"), ("c", "x  y"), ("d", "x  y"), (None, "x  y"), ("e", None)]
    got = {(r.doc_id, r.keep_id, r.kept) for r in exact.exact_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {("a", "c", False), ("b", "c", False), ("c", "c", True), ("d", "c", False), (None, "c", False), ("e", "e", True)}


def smallest(sizes, shards):
    """Brute force: the least possible largest shard."""
    best = {0: 0}
    for _ in range(shards):
        best = {j: min(max(best[i], sum(sizes[i:j])) for i in best if i <= j) for j in range(len(sizes) + 1)}
    return best[len(sizes)]


def test_smallest_capacity_is_exact():
    rng = random.Random(2)
    for _ in range(20):
        sizes = [rng.choice((1, 3, 50, rng.randrange(1, 200))) for _ in range(rng.randrange(1, 25))]
        ends = [0, *accumulate(sizes)]
        c = sharding.smallest_capacity(ends, 4, max(max(sizes), -(-sum(sizes) // 4)))
        assert c == smallest(sizes, 4)
        cuts = sharding.balanced(ends, c, 4)
        assert len(cuts) == 5 and all(ends[b] - ends[a] <= c for a, b in zip(cuts, cuts[1:], strict=False))


def test_shards(spark, docs, odd, none):
    many = docs.select("doc_id", "text").unionByName(spark.range(1000, 1400).select(F.col("id").alias("doc_id"), F.lit("one hot text").alias("text")))
    for df, n in ((docs, 16), (odd, 16), (many, 5)):
        got = sharding.shard_documents(df, n).collect()
        assert len(got) == df.count()
        slots, of_text = defaultdict(list), defaultdict(set)
        text = {r.doc_id: r.text or "" for r in df.collect()}
        for r in got:
            slots[r.shard].append(r.slot)
            of_text[text[r.doc_id]].add(r.shard)
            assert r["size"] == len(text[r.doc_id].encode()) + 1
        assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and all(len(x) == 1 for x in of_text.values())
    # the exact least largest shard, over groups in the order of their hashes
    groups = many.groupBy(F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit("")).cast("binary")), 1).alias("key")).agg(F.sum(F.octet_length("text") + 1).alias("size")).orderBy("key").collect()
    loads = Counter()
    for r in sharding.shard_documents(many, 5).collect():
        loads[r.shard] += r["size"]
    sizes = [g["size"] for g in groups]
    ends = [0, *accumulate(sizes)]
    assert max(loads.values()) == next(c for c in range(max(sizes), sum(sizes) + 1) if (x := sharding.greedy(ends, c, 5)) and len(x) <= 6)
    assert sharding.shard_documents(none).count() == 0


def test_seats_by_highest_quotients(spark):
    rng = random.Random(4)
    targets = [rng.random() * 10 ** rng.randrange(1, 5) for _ in range(12)] + [0.0]
    df = spark.createDataFrame([(f"s{i:02}", i + 1, t) for i, t in enumerate(targets)], "source string, nth long, target double")
    got = mixing.apportioned(df, 32, 4)
    seats = int(np.ceil(sum(targets) / 32))
    quotas = Counter()
    for _ in range(seats):
        quotas[max(range(13), key=lambda i: (targets[i] / (2 * quotas[i] + 1), -i))] += 1
    total = {r.source: r.q for r in got.groupBy("source").agg(F.sum("quota").alias("q")).collect()}
    assert {int(s[1:]): q for s, q in total.items() if q} == dict(quotas)
    assert got.where("quota < 0").count() == 0 and {r.n for r in got.groupBy("shard").agg(F.sum("quota").alias("n")).collect()} <= {seats // 4, seats // 4 + 1}


def test_shards_of_the_mix_hold_their_quotas(docs):
    """Each shard's words of a source are its quota of blocks, those of the stream's short last block aside."""
    rows = mixing.mix(docs).collect()
    size, words = Counter(), Counter()
    for r in rows:
        size[r.source] += r["size"]
        assert sum(x.words for x in r.shards) == r.taken and [x.shard for x in r.shards] == sorted({x.shard for x in r.shards})
        for x in r.shards:
            words[r.source, x.shard] += x.words
    quotas = mixing.apportioned(mixing.targets(mixing.measured(docs, "mix", "doc_id", "text", "source")), 32, 16).collect()
    assert len(quotas) == 16 * len({q.source for q in quotas})
    upto = Counter()
    for q in sorted(quotas, key=lambda q: q.shard):
        n = -(-size[q.source] // 32)
        blocks = range(min(upto[q.source], 3 * n), min(upto[q.source] + q.quota, 3 * n))
        assert words[q.source, q.shard] == sum(min(32, size[q.source] - b % n * 32) for b in blocks)
        upto[q.source] += q.quota


def test_mix(odd, none, docs):
    for df in (odd, docs):
        rows = mixing.mix(df).collect()
        assert len(rows) == df.count()
        taken, goal, size = Counter(), {}, Counter()
        for r in rows:
            assert 0 <= r.taken <= 3 * r["size"]
            taken[r.source] += r.taken
            size[r.source] += r["size"]
            goal[r.source] = r.target
        assert abs(sum(goal.values()) - sum(size.values())) < 1e-6 * (1 + sum(size.values()))
        assert all(abs(taken[s] - goal[s]) <= 5 * 32 and goal[s] <= 3 * size[s] + 1e-9 for s in goal)
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    assert mixing.mix(none).count() == 0


# ---- near duplicates


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def classes(rows):
    """Brute force: connected components of similarity 0.8."""
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)), key=lambda k: rows[k][0])
                parent[b] = a
    return {rows[i][0]: rows[root(i)][0] for i in range(len(rows))}


def test_near_classes_equal_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(3, 200))] + (passage if g % 2 else [])
        for _ in range(rng.randrange(1, 12)):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(w)))
    chain = [rng.choice(vocabulary) for _ in range(120)]  # each near the next, the ends far apart
    for _ in range(20):
        chain = list(chain)
        chain[rng.randrange(120)] = rng.choice(vocabulary)
        rows.append((len(rows), " ".join(chain)))
    rng.shuffle(rows)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(sorted(rows))


def test_buckets_that_the_hub_does_not_settle(spark):
    """Two groups of copies that share a long passage fall into the same buckets; links beyond the hub are still found."""
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(80)]
    rows = []
    for _ in range(8):
        own = passage + [rng.choice(vocabulary) for _ in range(30)]
        for _ in range(6):
            w = list(own)
            w[rng.randrange(80, 110)] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(w)))
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(rows)


def test_repeats_inside_a_text_do_not_hide_its_copies(spark):
    """Texts pasted twice or four times, or with a passage repeated, against a slightly edited single copy."""
    rng = random.Random(12)
    vocabulary = [f"u{i}" for i in range(5000)]
    rows = []
    for g in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(90, 200))]
        edited = list(base)
        edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
        pasted = (base * 2, base * 4, base[:70] * 6 + base[70:])[g % 3]
        rows += [(len(rows), " ".join(edited)), (len(rows) + 1, " ".join(pasted))]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(rows) and len(set(got.values())) == 60


def test_near_duplicates_of_odd_rows(odd, none):
    got = {(r.doc_id, r.class_id, r.class_size) for r in neardup.near_duplicates(odd).collect()}
    assert {(1, 1, 1), (2, 2, 1), (3, 3, 1), (4, 4, 3), (5, 4, 3), (6, 4, 3), (7, 7, 2), (12, 7, 2), (11, 11, 2), (None, None, 1)} <= got
    same = odd.where("doc_id = 8 or doc_id is null").withColumn("text", F.lit("one two three four five six"))
    assert {(r.doc_id, r.class_id, r.class_size, r.kept) for r in neardup.near_duplicates(same).collect()} == {(8, 8, 2, True), (None, 8, 2, False)}
    assert neardup.near_duplicates(none).count() == 0


def test_ids_with_two_texts_and_names_for_ids(spark):
    rng = random.Random(3)
    text = lambda: " ".join(f"t{rng.randrange(900)}" for _ in range(60))
    a, b, c = text(), text(), text()
    rows = [("k1", a), ("k1", b), ("k2", a + " end"), ("k3", b + " end"), ("k4", c), ("k4", c), ("k5", c + " end")]
    got = sorted((r.doc_id, r.class_id, r.class_size) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect())
    assert got == [("k1", "k1", 4), ("k1", "k1", 4), ("k2", "k1", 4), ("k3", "k1", 4), ("k4", "k4", 3), ("k4", "k4", 3), ("k5", "k4", 3)]


def test_links_of_the_tables_are_found(spark):
    """Every link of similarity 0.8 between documents of a table lies inside a class, whatever the partitioning."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets, holders = {i: shingles(t) for i, t in rows}, defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    common = Counter()
    for held in holders.values():
        common.update((a, b) for n, a in enumerate(held) for b in held[n + 1 :])
    links = [(a, b) for (a, b), n in common.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    got = {r.doc_id: (r.class_id, r.class_size) for r in neardup.near_duplicates(docs).collect()}
    assert len(links) > 50 and all(got[a] == got[b] for a, b in links)
    assert {i: c for i, (c, _) in got.items() if c != i}.keys() <= {i for link in links for i in link}
    assert {r.doc_id: (r.class_id, r.class_size) for r in neardup.near_duplicates(docs.repartition(13)).collect()} == got


def test_signatures_agree_as_often_as_weights_overlap():
    rng = np.random.default_rng(3)
    shared, t = rng.integers(1, 1 << 62, 300).astype(np.uint64), 600
    wx, wy = rng.choice([1.0, 1.5, 2.0, 3.7], 300), rng.choice([1.0, 1.5, 2.0, 3.7], 300)
    s = neardup.signatures(np.repeat([0, 1], 300), np.concatenate([shared, shared]), np.concatenate([wx, wy]), 3, t)
    assert abs((s[0] == s[1]).mean() - np.minimum(wx, wy).sum() / np.maximum(wx, wy).sum()) < 0.08
    assert (s[2] == 0).all() and (s[:2] != 0).all()
    text, element = np.sort(rng.integers(0, 40, 900)), rng.integers(1, 1 << 62, 900).astype(np.uint64)
    weight = 1 + rng.random(900)
    assert (neardup.sliced_signatures(text, element, weight, 41, 50, most=7) == neardup.signatures(text, element, weight, 41, 50)).all()


def test_common_counts_are_intersections():
    rng = np.random.default_rng(2)
    x, y = ([np.unique(rng.integers(0, 90, rng.integers(1, 60))) for _ in range(k)] for k in (5, 7))
    assert neardup.common_counts(x, y, step=16).tolist() == [[len(np.intersect1d(a, b)) for b in y] for a in x]
