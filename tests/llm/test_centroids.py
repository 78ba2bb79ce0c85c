import hashlib
import math

import numpy as np
import pytest

from tidyshelf.llm import centroids as C

SCHEMA = "vec_id long, embedding array<float>, label int"


def lloyd(rows, clusters, rounds, dims, scale=64):
    """Brute force on Python's whole numbers: (sorted (id, cluster, distance), centroids)."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, tuple(min(max(math.floor(float(x) * scale), -C.LARGEST), C.LARGEST) for x in v)))
    hashed = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    c = [v for _, v in sorted(kept, key=hashed)[:clusters]]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda v: min((distance(v, x), k) for k, x in enumerate(c))
    for _ in range(rounds):
        of = [[] for _ in c]
        for _, v in kept:
            of[best(v)[1]].append(v)
        c = [tuple(sum(x) // len(members) for x in zip(*members, strict=True)) if members else old for members, old in zip(of, c, strict=True)]
    return sorted(((i, *reversed(best(v))) for i, v in kept), key=str), c


def held(df, dims, clusters=16, rounds=3, **options):
    want, c = lloyd([(r.vec_id, r.embedding) for r in df.collect()], clusters, rounds, dims)
    placed, got = C.cluster(df, clusters=clusters, rounds=rounds, dims=dims, **options)
    rows = placed.collect()
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in rows), key=str) == want
    assert got.tolist() == [list(x) for x in c]
    return placed, got, want


def test_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    placed, got, want = held(df, 64)
    rows = C.with_inertia(placed, got).collect()
    for r in rows:
        assert r.inertia == sum(d for _, _, d in want) and r.cluster_inertia == sum(d for _, k, d in want if k == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, got[r.cluster].tolist())).encode()).hexdigest()


def test_odd_vectors(spark):
    """Nulls, other lengths, non-finite and huge components, repeated rows, ties, one vector a third of all, clashing columns."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 3)]) for i in range(150)]
    rows += [(1000 + i, [1.0, 1.0, 1.0]) for i in range(100)] + [(7, rows[7][1])] * 3 + [(7, [0.5, 0.0, 0.0])]
    rows += [(None, [0.25, 0.0, 0.0]), (2000, None), (2001, []), (2002, [1.0, 2.0]), (2003, [1.0, None, 2.0]), (2004, [1.0, float("nan"), 2.0]), (2005, [1.0, float("-inf"), 2.0])]
    df = spark.createDataFrame([(i, v, 5, 6, b"t") for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance long, tree binary").repartition(3)
    for block, leaf in ((4096, 16), (7, 1), (50, 4)):
        held(df, 3, clusters=12, block_rows=block, leaf_rows=leaf)
    held(df, 3, clusters=1000, rounds=1)  # more clusters than vectors, some equal
    huge = df.selectExpr("vec_id", "embedding").unionByName(spark.createDataFrame([(3000, [1e30, -1e30, 0.0]), (3001, [-1e30, 1e30, 5.0]), (3002, [1e6, 1e6, 1e6])], "vec_id long, embedding array<double>"))
    placed, got, _ = held(huge, 3, clusters=300)
    assert C.with_inertia(placed, got).count() == placed.count()


def test_no_vectors(spark):
    placed, got = C.cluster(spark.createDataFrame([], SCHEMA))
    assert placed.columns == ["vec_id", "cluster", "distance"] and C.with_inertia(placed, got).count() == 0
    placed, got = C.cluster(spark.createDataFrame([(1, [1.0], 0)], SCHEMA))
    assert placed.count() == 0 and len(got) == 0


@pytest.mark.parametrize("leaf_rows", [1, 3, 16])
def test_trees_cover(leaf_rows):
    rng = np.random.default_rng(8)
    for n in (1, 2, 40, 300):
        x = rng.integers(-4, 5, (n, 3)).astype(float)
        order, tree = C.cover_tree(x, leaf_rows)
        assert sorted(order.tolist()) == list(range(n))
        w = x[order]
        again = C.Tree.unpacked(tree.packed())
        assert all((getattr(again, k) == getattr(tree, k)).all() for k in ("centre", "radius", "start", "end", "child", "children"))
        assert (tree.start[0], tree.end[0]) == (0, n)
        for i in range(len(tree.centre)):
            rows = w[tree.start[i] : tree.end[i]]
            assert C.far(rows, w[tree.centre[i]]).max() <= tree.radius[i] + 1e-9 and tree.start[i] <= tree.centre[i] < tree.end[i]
            below = range(tree.child[i], tree.child[i] + tree.children[i])
            assert not below or [tree.start[i], *(tree.end[c] for c in below)] == [*(tree.start[c] for c in below), tree.end[i]]


def test_far_groups_are_settled_by_nodes():
    """Tight groups far apart: whole nodes go to a centroid, and few vectors are compared one by one."""
    rng = np.random.default_rng(9)
    middles = rng.integers(-500, 500, (8, 16))
    v = middles[rng.integers(0, 8, 2000)] + rng.integers(-2, 3, (2000, 16))
    order, tree = C.cover_tree(v.astype(float), 16)
    v = v[order]
    met = [0]
    (start, end, k), leaves = C.assigned(v, tree, middles, C.centroid_tree(middles), met)
    assert (end - start).sum() == len(v) and not leaves and met[0] < 400
    assert (C.clusters_of(v, tree, middles, C.centroid_tree(middles)) == C.nearest(v, middles)[0]).all()
