"""Clusters around centroids by Lloyd's rounds over two trees, in exact integers.

Vectors are dealt to blocks of about ``block_rows`` as they are read, and each block gets a cover tree once: nodes of a level
have centres (vectors of the block) further apart than the level's radius, every vector lies within it of its centre, a centre
stays one in all finer levels, and radii at least halve from level to level, but for the last one, which ends with a centre for
each ``leaf_rows`` vectors. Rows are stored in the tree's order, so that a node is a range of rows; the tree travels with its block.

A round builds a cover tree over the centroids, at most ``clusters`` of them, and sends both to every block. From the root
downwards, a node of vectors is paired with nodes of centroids; a pair is dropped when the least distance between their
members is above the largest distance from the node's vectors to some centroid already met, by more than the bounds' rounding.
A node left with one centroid goes to it as a whole; a leaf left with several has its vectors compared with each of those
in whole numbers. A block gives sums and counts by centroid, which are added up before they are shuffled; the driver
holds one row for each centroid and component.

A component x is floor(scale * x), held to 2**27 in size so that squared distances are longs (only vectors beyond a
million in some component are touched by that), and sums of distances to the largest long. Vectors of another length, or with a null or non-finite component, are left
out. Distances are compared exactly; of equal ones the smaller number wins. Repeated rows are vectors each. A null id is
hashed as an empty one; of first vectors with one id, the smaller in its components comes first. With fewer vectors than
clusters each is a centroid; an empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, give_back

LARGEST = 1 << 27


def kept_vectors(df: DataFrame, dims: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): whole-number components of the vectors that count."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != F.lit(float("inf"))))
    whole = F.transform(x, lambda c: F.greatest(F.least(F.floor(c.cast("double") * scale), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))
    return df.where((F.size(x) == dims) & F.coalesce(finite, F.lit(False))).select(F.col(id_col).alias("id"), whole.alias("v"))


# ---- trees, on the rows of one block or on the centroids


@dataclass
class Tree:
    """Nodes in breadth-first order: centre (a row), radius, rows [start, end), children [child, child + children)."""

    centre: np.ndarray
    radius: np.ndarray
    start: np.ndarray
    end: np.ndarray
    child: np.ndarray
    children: np.ndarray

    def packed(self) -> bytes:
        return np.stack([self.centre, self.radius, self.start, self.end, self.child, self.children]).astype("<f8").tobytes()

    @staticmethod
    def unpacked(data: bytes) -> Tree:
        c, r, *rest = np.frombuffer(data, "<f8").reshape(6, -1)
        start, end, child, children = (x.astype(np.int64) for x in rest)
        return Tree(c.astype(np.int64), r, start, end, child, children)


def far(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    d = x - p
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def cover_tree(x: np.ndarray, leaf_rows: int) -> tuple[np.ndarray, Tree]:
    """(order of the rows, tree over the ordered rows) of at least one row; x: float64."""
    n = len(x)
    near = far(x, x[0])
    centres, of = [0], np.zeros(n, np.int64)
    parents = []  # of each finer level: its centres' coarser ones, by number
    while near.max() > 0 and len(centres) * leaf_rows < n:
        radius = near.max() / 2  # or what the last level reaches with as many centres as it may have
        centres_, near_, of_ = list(centres), near.copy(), of.copy()
        while near_.max() > radius and len(centres_) * leaf_rows < n:  # the farthest row is the next centre
            q = int(near_.argmax())
            d = far(x, x[q])
            closer = d < near_
            near_[closer], of_[closer] = d[closer], len(centres_)
            centres_.append(q)
        parent = of[centres_]  # the coarser centre that a centre belongs to; its own for those that stay
        parents.append(parent)
        centres, near, of = centres_, near_, of_
    # a row's path is that of its finest centre: its centre, that one's parent, and so on
    path = [of]
    for parent in reversed(parents):
        path.append(parent[path[-1]])
    path.reverse()
    order = np.lexsort(tuple(reversed(path)))
    path = [p[order] for p in path]
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    node_centre, node_start, node_end, first_child, n_children = [], [], [], [], []
    below = 0
    for level, p in enumerate(path):
        starts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        ends = np.r_[starts[1:], n]
        below += len(starts)
        if level + 1 < len(path):
            finer = np.flatnonzero(np.r_[True, path[level + 1][1:] != path[level + 1][:-1]])
            lo, hi = np.searchsorted(finer, starts), np.searchsorted(finer, ends)
        else:
            lo = hi = np.zeros(len(starts), np.int64)
        node_centre.append(place[np.array(centres)[p[starts]]])
        node_start.append(starts)
        node_end.append(ends)
        first_child.append(lo + below)
        n_children.append(hi - lo)
    centre, start, end = np.concatenate(node_centre), np.concatenate(node_start), np.concatenate(node_end)
    ordered = x[order]
    radii = [np.maximum.reduceat(far(ordered, ordered[np.repeat(c, e - s)]), s) for c, s, e in zip(node_centre, node_start, node_end, strict=True)]
    return order, Tree(centre, np.concatenate(radii), start, end, np.concatenate(first_child), np.concatenate(n_children))


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each row's nearest centroid, in whole numbers; of equal ones the first."""
    most = max(int(np.abs(v).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if v.shape[1] * 4 * most * most < 1 << 53:  # then doubles hold every step exactly
        a, c = v.astype(np.float64), centroids.astype(np.float64)
        d = (a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)
    else:
        d = np.stack([np.square(v - c).sum(1) for c in centroids], 1)
    k = d.argmin(1)
    return k, d[np.arange(len(v)), k].astype(np.int64)


def assigned(v: np.ndarray, tree: Tree, centroids: np.ndarray, over: tuple[np.ndarray, Tree], met: list[int] | None = None) -> tuple[tuple, list]:
    """Ranges (first rows, end rows, centroids) whose nearest centroid is settled, and rows of leaves with the centroids that they have to be compared with.

    over: the tree over the centroids and the order of its rows. met counts the pairs of nodes looked at.
    """
    order, other = over
    x, c = v.astype(np.float64), centroids[order].astype(np.float64)
    slack = 1e-9 * (1 + np.abs(x).max(initial=0) + np.abs(c).max(initial=0)) * np.sqrt(v.shape[1])
    ranges, leaves = [], {}  # leaves with the same centroids left are compared together
    nodes, tops = np.zeros(1, np.int64), np.zeros(1, np.int64)  # pairs of a node of vectors and a node of centroids
    while len(nodes):
        open_q, open_t, closed = nodes, tops, []
        best = np.full(len(tree.centre), np.inf)
        while len(open_q):  # down the tree over the centroids, to single ones
            d = far(x[tree.centre[open_q]], c[other.centre[open_t]])
            np.minimum.at(best, open_q, d + tree.radius[open_q])
            low = d - tree.radius[open_q] - other.radius[open_t]
            if met is not None:
                met[0] += len(d)
            stay = low <= best[open_q] + slack
            open_q, open_t, low = open_q[stay], open_t[stay], low[stay]
            # the larger node of a pair is split; before a leaf of vectors, always that of centroids
            single = (other.children[open_t] == 0) | ((other.radius[open_t] <= tree.radius[open_q]) & (tree.children[open_q] > 0))
            closed.append((open_q[single], open_t[single], low[single]))
            open_q, open_t = open_q[~single], open_t[~single]
            n = other.children[open_t]
            open_q = np.repeat(open_q, n)
            open_t = np.repeat(other.child[open_t], n) + spread(n)
        q, t, low = (np.concatenate(p) for p in zip(*closed, strict=True))
        stay = low <= best[q] + slack
        q, t = q[stay], t[stay]
        by = np.argsort(q, kind="stable")
        q, t = q[by], t[by]
        counts = np.zeros(len(tree.centre), np.int64)
        np.add.at(counts, q, other.end[t] - other.start[t])
        alone = counts[q] == 1
        ranges.append((tree.start[q[alone]], tree.end[q[alone]], order[other.start[t[alone]]]))
        q, t = q[~alone], t[~alone]
        leaf = tree.children[q] == 0
        for node, held in grouped(q[leaf], t[leaf]):
            among = np.sort(np.concatenate([order[other.start[i] : other.end[i]] for i in held]))
            leaves.setdefault(among.tobytes(), (among, []))[1].append(np.arange(tree.start[node], tree.end[node]))
        q, t = q[~leaf], t[~leaf]
        n = tree.children[q]
        nodes = np.repeat(tree.child[q], n) + spread(n)
        tops = np.repeat(t, n)
    start, end, k = (np.concatenate(p) for p in zip(*ranges, strict=True))
    return (start, end, k), [(np.concatenate(rows), among) for among, rows in leaves.values()]


def grouped(keys: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The values of each key; keys sorted."""
    if len(keys):
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        yield from zip(keys[first].tolist(), np.split(values, first[1:]), strict=True)


def spread(n: np.ndarray) -> np.ndarray:
    """0, 1, ... below each number of n, one after another."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def clusters_of(v: np.ndarray, tree: Tree, centroids: np.ndarray, over: tuple[np.ndarray, Tree]) -> np.ndarray:
    """The nearest centroid of each row."""
    (start, end, k), leaves = assigned(v, tree, centroids, over)
    out = np.full(len(v), -1, np.int64)
    out[np.repeat(start, end - start) + spread(end - start)] = np.repeat(k, end - start)
    for rows, among in leaves:
        out[rows] = among[nearest(v[rows], centroids[among])[0]]
    return out


# ---- rounds


def planted(vectors: DataFrame, dims: int, block_rows: int, leaf_rows: int) -> DataFrame:
    """(id, v, tree): rows in the order of their block's tree, which its first row carries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, block_rows):
                part = b.slice(at, block_rows)
                v = part.column("v").flatten().to_numpy().reshape(-1, dims)
                order, tree = cover_tree(v.astype(np.float64), leaf_rows)
                rows = part.take(pa.array(order))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([tree.packed()] + [None] * (len(order) - 1), pa.binary())], names=["id", "v", "tree"])
        give_back()

    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.mapInArrow(run, f"id {kind}, v array<int>, tree binary")


def blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray, Tree]]:
    """(ids, vectors, tree) of each block, put together from batches that may end inside it."""
    held: list[pa.RecordBatch] = []

    def whole() -> tuple[pa.Array, np.ndarray, Tree]:
        t = pa.Table.from_batches(held).combine_chunks()
        v = t.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dims).astype(np.int64)
        return t.column("id").combine_chunks(), v, Tree.unpacked(held[0].column("tree")[0].as_py())

    for b in batches:
        first = np.flatnonzero(b.column("tree").is_valid().to_numpy(zero_copy_only=False))
        for lo, hi in zip(np.r_[0, first], np.r_[first, b.num_rows], strict=True):
            if lo < hi:
                if held and b.column("tree")[int(lo)].is_valid:
                    yield whole()
                    held = []
                held.append(b.slice(int(lo), int(hi - lo)))
    if held:
        yield whole()


def centroid_tree(centroids: np.ndarray) -> tuple[np.ndarray, Tree]:
    return cover_tree(centroids.astype(np.float64), 1)


def sums(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, dim, total, n) of the vectors nearest to each centroid, added up over all blocks."""
    dims, over = centroids.shape[1], centroid_tree(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for _, v, tree in blocks(batches, dims):
            (start, end, k), leaves = assigned(v, tree, centroids, over)
            before = np.vstack([np.zeros((1, dims), np.int64), np.cumsum(v, 0)])  # sums of whole nodes without their rows
            np.add.at(total, k, before[end] - before[start])
            np.add.at(n, k, end - start)
            for rows, among in leaves:
                k = among[nearest(v[rows], centroids[among])[0]]
                np.add.at(total, k, v[rows])
                np.add.at(n, k, 1)
        some = np.flatnonzero(n)
        columns = [np.repeat(some, dims).astype(np.int32), np.tile(np.arange(dims, dtype=np.int32), len(some)), total[some].ravel(), np.repeat(n[some], dims)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cluster", "dim", "total", "n"])
        give_back()

    found = rows.mapInArrow(run, "cluster int, dim int, total long, n long")
    return found.groupBy("cluster", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid at the floor of its vectors' mean; one without vectors stays."""
    out = centroids.copy()
    for r in sums(rows, centroids).collect():  # clusters times dims rows at most
        out[r["cluster"], r["dim"]] = r["total"] // r["n"]
    return out


def settled(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of every vector."""
    dims, over = centroids.shape[1], centroid_tree(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, v, tree in blocks(batches, dims):
            k = clusters_of(v, tree, centroids, over)
            d = np.square(v - centroids[k]).sum(1)
            yield pa.RecordBatch.from_arrays([ids, pa.array(k.astype(np.int32)), pa.array(d)], names=["id", "cluster", "distance"])
        give_back()

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, cluster int, distance long")


def first_centroids(vectors: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors whose ids have the smallest hashes."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    return np.array([r["v"] for r in vectors.orderBy(digest, "v").limit(clusters).collect()], np.int64)


def cluster(
    df: DataFrame, clusters: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 4096, leaf_rows: int = 16
) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of every vector that counts, and the centroids."""
    vectors = kept_vectors(df, dims, scale, id_col, vector_col)
    centroids = first_centroids(vectors, clusters, seed)
    rows = cut(planted(vectors, dims, block_rows, leaf_rows))
    if not len(centroids):
        return rows.select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    for _ in range(rounds):
        centroids = moved(rows, centroids)
    return settled(rows, centroids).withColumnRenamed("id", id_col), centroids


def with_inertia(placed: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Each row with its cluster's inertia, all clusters' and the hash of its centroid."""
    placed = cut(placed)
    by_cluster = {r["cluster"]: r["d"] for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("d")).collect()}  # a row a centroid
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    total, most = int(sum(by_cluster.values())), (1 << 63) - 1
    table = [(k, min(int(d), most), min(total, most), sha[k]) for k, d in by_cluster.items()]
    small = placed.sparkSession.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(small), "cluster")  # one row a centroid, a parameter


def op12_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    placed, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return with_inertia(placed, centroids).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def lloyd_sql(clusters: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> str:
    distance = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = [
        f"e AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})",
        f"v AS (SELECT r, vec_id, list_transform(embedding, lambda x: CAST(greatest(least(floor(CAST(x AS DOUBLE) * {scale}), {LARGEST}), -{LARGEST}) AS BIGINT)) AS v FROM e)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c FROM (SELECT sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM v) ORDER BY h, v LIMIT {clusters})",
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS (SELECT r, k, d FROM (SELECT r, k, d, row_number() OVER (PARTITION BY r ORDER BY d, k) AS nth FROM (SELECT r, k, {distance} AS d FROM v, c{i})) WHERE nth = 1)")
        if i < rounds:
            steps.append(f"s{i} AS (SELECT k, j, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(v) AS x, unnest(range({dims})) AS j FROM a{i} JOIN v USING (r)) GROUP BY k, j)")
            steps.append(f"m{i} AS (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS c FROM s{i} GROUP BY k)")
            steps.append(f"c{i + 1} AS (SELECT k, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (k))")
    return (
        "WITH " + ",\n".join(steps) + f"\nSELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,"
        f" CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN v USING (r) JOIN c{rounds} USING (k)"
    )


OP12_SQL = lloyd_sql()
