"""Near duplicates: DartMinHash signatures, banded, every candidate verified, classes as connected components.

A text's elements are its distinct runs of five words (white-space separated, lower case); a text of one to four words has
one element, all of it. Two texts are linked when the Jaccard similarity of their element sets is ``threshold`` or more,
and classes are the connected components of the links.

Signatures. An element of weight w owns the region [0, w) of a weight axis, in strips of length 1. Each strip throws darts,
the same ones in every text: their ranks are the arrivals of a Poisson process, and a hash gives each dart a coordinate and
a place across the strip. Darts beyond the element's weight miss. A text keeps for each coordinate the dart of least rank,
so two texts agree on a coordinate with the probability of their weighted Jaccard similarity. Every element weighs 1 here,
however often a text has it: that probability is then the very similarity that links are defined by, and texts of equal
element sets have equal signatures. Only darts up to a rank are thrown at all, chosen from the text's total weight so that t ln t + 4 t are
expected for t coordinates, however long the text; where a coordinate stays empty, the rank is doubled.

Candidates. Texts of equal element sets are one representative (least id). Representatives that share a whole band of the
signature meet in a bucket. A bucket's members are first compared with its least member only, which settles buckets of
copies at one comparison a member. Where a bucket still holds unconnected members, each of those is compared with every
other member: bucket and strays are dealt into blocks of about BLOCK, and each pair of blocks is one group that counts
common elements by a matrix product and returns only links that connect something new (fewer than it has members). So no
link between texts that share a band is lost, whatever the bucket's size, and no list of all pairs is ever made.

Null texts and texts without words are each alone. Ids name documents: rows that repeat an id and text share its class, and
those with other texts fall together in one class. A
row without an id belongs to the class of an equal text that has one; else it is alone, with a null class_id and kept.
Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesview import WordHasher, mixed, separators
from .common import documents, drop_dir, give_back, matching, new_dir, table_at, text_of

WORDS, THRESHOLD, BANDS, ROWS = 5, 0.8, 25, 5
BLOCK = 256
SALTS = 16
GOLDEN = 0x9E3779B97F4A7C15


def cut(df: DataFrame) -> DataFrame:
    """df written and reread. Rounds go on from a plain table, so plans do not grow with them as those of checkpoints can."""
    return table_at(df, new_dir(df.sparkSession, "round"))


def elements(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of consecutive texts: (text, element, count), each text's elements distinct and rising."""
    factors = mixed(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(GOLDEN)) | np.uint64(1)
    n = np.diff(bounds)
    owner = np.repeat(np.arange(len(n)), n)
    m = max(0, len(words) - k + 1)
    total = np.zeros(m, np.uint64)
    for i in range(k):
        total += words[i : i + m] * factors[i]
    whole = owner[:m] == owner[k - 1 : k - 1 + m] if m else np.zeros(0, bool)
    text, element = owner[:m][whole], mixed(total[whole])
    if len(short := np.flatnonzero((n > 0) & (n < k))):
        own = np.array([(words[bounds[i] : bounds[i + 1]] * factors[: n[i]]).sum(dtype=np.uint64) + np.uint64(n[i]) for i in short], np.uint64)
        text, element = np.concatenate([text, short]), np.concatenate([element, mixed(own)])
    order = np.lexsort((element, text))
    text, element = text[order], element[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (element[1:] != element[:-1])
    starts = np.flatnonzero(new)
    return text[starts], element[starts], np.diff(np.append(starts, len(text)))


def thrown(strips: np.ndarray, width: np.ndarray, limit: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(strip, coordinate, rank, dart) of the darts of rank at most ``limit`` that land inside each strip's width."""
    out, active, at, base, block = [], np.arange(len(strips)), np.zeros(len(strips)), 0, 2
    while len(active):
        number = (np.arange(base + 1, base + block + 1, dtype=np.uint64) * np.uint64(GOLDEN))[None, :]
        dart = mixed(strips[active][:, None] ^ mixed(number))
        gaps = -np.log(((dart >> np.uint64(11)).astype(float) + 1) * 2.0**-53) / t
        rank = at[active][:, None] + np.cumsum(gaps, axis=1)
        r, c = np.nonzero(rank <= limit[active][:, None])
        strip, dart, landed = active[r], dart[r, c], rank[r, c]
        place = mixed(dart ^ np.uint64(0xD1B54A32D192ED03))
        inside = (place >> np.uint64(40)).astype(float) * 2.0**-24 < width[strip]
        out.append((strip[inside], (place[inside] & np.uint64(0xFFFFFFFF)) % np.uint64(t), landed[inside], dart[inside]))
        at[active] = rank[:, -1]
        active = active[rank[:, -1] <= limit[active]]
        base, block = base + block, min(block * 4, 512)
    if not out:
        return np.zeros(0, int), np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def signatures(text: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, t: int) -> np.ndarray:
    """texts x t: for each coordinate the dart of least rank; rows of texts without elements are 0."""
    n = np.ceil(weight).astype(np.int64)
    first = np.repeat(np.cumsum(n) - n, n)
    level = np.arange(n.sum()) - first
    strips = mixed(np.repeat(element, n) + mixed(level.astype(np.uint64)))
    width = np.minimum(1.0, np.repeat(weight, n) - level)
    owner = np.repeat(text, n)
    total = np.bincount(text, weight, texts)
    limit = (np.log(t) + 4) / np.maximum(total, 1e-9)
    out = np.zeros((texts, t), np.uint64)
    todo = np.flatnonzero(total > 0)
    while len(todo):
        mine = np.isin(owner, todo) if len(todo) < texts else slice(None)
        own, s, w = owner[mine], strips[mine], width[mine]
        strip, coordinate, rank, dart = thrown(s, w, limit[own], t)
        key = own[strip] * t + coordinate.astype(np.int64)
        order = np.argsort(-rank, kind="stable")  # the least rank is written last
        flat, filled = np.zeros(texts * t, np.uint64), np.zeros(texts * t, bool)
        flat[key[order]], filled[key] = dart[order], True
        done = filled.reshape(texts, t).all(1)
        ready = todo[done[todo]]
        out[ready] = flat.reshape(texts, t)[ready]
        todo = todo[~done[todo]]
        limit[todo] *= 2
    return out


def sliced_signatures(text: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, t: int, most: int = 256) -> np.ndarray:
    """signatures of at most ``most`` texts at a time: each throws some t ln t + 4 t darts however short it is. text: rising."""
    cuts = np.searchsorted(text, np.arange(0, texts + most, most))
    return np.concatenate([signatures(text[a:b] - i, element[a:b], weight[a:b], min(most, texts - i), t) for i, a, b in zip(range(0, texts, most), cuts, cuts[1:], strict=False)])


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.repeat(mixed(np.arange(1, bands + 1, dtype=np.uint64))[None, :], len(signature), 0)
    cells = signature.reshape(len(signature), bands, rows)
    for i in range(rows):
        keys = mixed(keys ^ cells[:, :, i])
    return keys


def raw_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.lower(text_of(text_col)).cast("binary").alias("raw"))


def signed(df: DataFrame, id_col: str, text_col: str, words: int, bands: int, rows: int) -> DataFrame:
    """(id, n, a, b, keys): number of elements, fingerprint of their set, band keys; one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = WordHasher(separators(False))
        for batch in batches:
            n, a, b, keys = [], [], [], []
            for first, last, h, bounds in look.runs(batch.column(1)):
                texts = last - first
                text, element, _ = elements(h, bounds, words)
                size = np.bincount(text, minlength=texts)
                n.append(size)
                for out, x in zip((a, b), fingerprints(element, np.cumsum(size), size), strict=True):
                    out.append(x)
                keys.append(band_keys(sliced_signatures(text, element, np.ones(len(element)), texts, bands * rows), bands, rows))
            if not n:
                continue
            flat = np.concatenate(keys).view(np.int64)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, bands), pa.int32()), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.concatenate(x)) for x in (n, a, b)), listed], names=["id", "n", "a", "b", "keys"])
        give_back()

    kind = df.schema[id_col].dataType.simpleString()
    return raw_text(df, id_col, text_col).mapInArrow(run, f"id {kind}, n long, a long, b long, keys array<long>")


def fingerprints(element: np.ndarray, ends: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Two sums over scrambled elements of each text; ends: of each text's elements."""
    out = []
    for salt in (0, 0xA0761D6478BD642F):
        sums = np.zeros(len(element) + 1, np.uint64)
        np.cumsum(mixed(element ^ np.uint64(salt)), dtype=np.uint64, out=sums[1:])
        out.append((sums[ends] - sums[ends - size]).view(np.int64))
    return out


def element_sets(df: DataFrame, words: int) -> DataFrame:
    """(id, raw, a, b) -> (id, set, a): the distinct elements of each text that has the fingerprint a, b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = WordHasher(separators(False))
        for batch in batches:
            for first, last, h, bounds in look.runs(batch.column(1)):
                text, element, _ = elements(h, bounds, words)
                size = np.bincount(text, minlength=last - first)
                ends = np.cumsum(size)
                a, b = fingerprints(element, ends, size)
                mine = (a == batch.column(2).slice(first, last - first).to_numpy()) & (b == batch.column(3).slice(first, last - first).to_numpy())
                listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(element.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), listed, pa.array(a)], names=["id", "set", "a"]).filter(pa.array(mine))
        give_back()

    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, set array<long>, a long")


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (p, q) with their similarity. The set of q travels with its pair, that of p meets the pairs where they are."""
    p, q = (sets.select(F.col("id").alias(x), F.col("set").alias(f"{x}_set")) for x in ("p", "q"))
    both = pairs.join(q, "q").join(p, "p")
    common = F.size(F.array_intersect("p_set", "q_set"))
    return both.select("p", "q", (common / (F.size("p_set") + F.size("q_set") - common)).alias("alike"))


def components(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(id, label): the least id that edges (p, q) connect each id to; for ids that have edges.

    Each round takes the least label among neighbours, then the label of that label, and is written to the checkpoint folder.
    """
    both = cut(edges.select("p", "q").union(edges.select("q", "p")).distinct())
    now = both.groupBy(F.col("p").alias("id")).agg(F.least(F.min("q"), F.first("p")).alias("label"))
    now = cut(now)
    while True:
        near = both.join(now.select(F.col("id").alias("q"), "label"), "q").groupBy("p").agg(F.min("label").alias("near"))
        moved = now.join(near, now.id == near.p).select("id", F.least("label", "near").alias("new"), F.col("label").alias("old"))
        far = now.select(F.col("id").alias("new"), F.col("label").alias("far"))
        after = cut(moved.join(far, "new", "left").select("id", F.least("new", F.coalesce("far", "new")).alias("label"), (F.least("new", F.coalesce("far", "new")) < F.col("old")).alias("changed")))
        if not after.where("changed").limit(1).count():
            return after.select("id", "label")
        now = after.select("id", "label")


def labelled(rows: DataFrame, labels: DataFrame, on: str) -> DataFrame:
    found = labels.select(F.col("id").alias(on), F.col("label").alias("found"))
    return rows.join(found, on, "left").withColumn("label", F.coalesce("found", on)).drop("found")


def common_counts(x: list[np.ndarray], y: list[np.ndarray], step: int = 4096) -> np.ndarray:
    """How many elements each set of x shares with each of y; sets are of distinct numbers."""
    nx, owner = len(x), np.repeat(np.arange(len(x) + len(y)), [len(e) for e in (*x, *y)])
    every, at, seen = np.unique(np.concatenate([*x, *y]), return_inverse=True, return_counts=True)
    keep = seen[at] > 1
    owner, at = owner[keep], (np.cumsum(seen > 1) - 1)[at[keep]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    out = np.zeros((nx, len(y)), np.float32)
    for start in range(0, int((seen > 1).sum()), step):
        a, b = np.searchsorted(at, [start, start + step])
        m = np.zeros((nx + len(y), step), np.float32)
        m[owner[a:b], at[a:b] - start] = 1
        out += m[:nx] @ m[nx:].T
    return out


def sets_of(column: pa.ChunkedArray) -> list[np.ndarray]:
    lists = column.combine_chunks()
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(lists.flatten().to_numpy(zero_copy_only=False), ends[:-1])


def new_links(group: pa.Table, threshold: float) -> pa.Table:
    """Of one pair of blocks: links between strays and members that connect labels not connected yet."""
    strays, members = group.filter(group["stray"]), group.filter(pc.invert(group["stray"]))
    p, q = [], []
    if strays.num_rows and members.num_rows:
        x, y = sets_of(strays["set"]), sets_of(members["set"])
        label_x, label_y, rep_x, rep_y = (side[c].to_pylist() for c in ("label", "rep") for side in (strays, members))
        shared = common_counts(x, y)
        sizes = np.array([len(e) for e in x])[:, None] + np.array([len(e) for e in y])[None, :]
        parent: dict = {}

        def root(v):
            while parent.setdefault(v, v) != v:
                parent[v] = v = parent[parent[v]]
            return v

        for i, j in np.argwhere(shared >= threshold * (sizes - shared) - 1e-6):
            a, b = root(label_x[i]), root(label_y[j])
            if a != b:
                parent[b] = a
                p.append(rep_x[i])
                q.append(rep_y[j])
    kind = group.schema.field("rep").type
    if group.nbytes > 1 << 20:
        give_back()
    return pa.table({"p": pa.array(p, kind), "q": pa.array(q, kind)})


def links_left(left: DataFrame, sets: DataFrame, threshold: float, kind: str) -> DataFrame:
    """(p, q): links inside buckets whose members (key, rep, label) are not all connected."""
    sizes = left.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    mixed_up = sizes.groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.max("c").alias("c"), F.sum("c").alias("size")).where("size > c")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    rows = left.join(mixed_up, "key").withColumns({"across": blocks(F.col("size") - F.col("c")), "down": blocks(F.col("size")), "draw": F.xxhash64("rep")})
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    strays = rows.where(F.col("label") != F.col("main")).select("key", F.pmod("draw", "across").cast("int").alias("xb"), every("down").alias("yb"), F.lit(True).alias("stray"), "rep", "label")
    members = rows.select("key", every("across").alias("xb"), F.pmod("draw", "down").cast("int").alias("yb"), F.lit(False).alias("stray"), "rep", "label")
    wide = strays.unionByName(members).join(sets.withColumnRenamed("id", "rep"), "rep")
    return wide.groupBy("key", "xb", "yb").applyInArrow(lambda group: new_links(group, threshold), f"p {kind}, q {kind}")


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, words: int = WORDS, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """For each row: id, class_id (least id of the class), class_size, kept (it is that id)."""
    kind = df.schema[id_col].dataType.simpleString()
    signs = cut(signed(df, id_col, text_col, words, bands, rows))
    reps = signs.where("n > 0").groupBy("a", "b").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"), F.first("keys").alias("keys"))
    reps = cut(reps.where("rep is not null"))
    # buckets of two representatives or more, each with its least member as hub
    members = reps.select("rep", "n", F.explode("keys").alias("key"))
    hubs = members.groupBy("key").agg(F.min_by(F.struct("rep", "n"), "rep").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = cut(members.join(hubs.select("key", F.col("hub.rep").alias("hub"), F.col("hub.n").alias("hub_n")), "key"))
    possible = F.least("n", "hub_n") >= threshold * F.greatest("n", "hub_n") - 1e-9  # sizes alone let them be alike
    stars = buckets.where((F.col("rep") != F.col("hub")) & possible).select(F.col("hub").alias("p"), F.col("rep").alias("q")).distinct()
    wanted = cut(reps.select(F.col("rep").alias("id"), "a", "b").join(buckets.select(F.col("rep").alias("id")).distinct(), "id", "left_semi"))
    chosen = matching(raw_text(df, id_col, text_col), wanted, "id", "inner")
    store = new_dir(df.sparkSession, "elements")
    sets = element_sets(chosen.select("id", "raw", "a", "b"), words)
    if signs.where("n > 0").join(wanted.select("id", "a", "b"), ["id", "a", "b"], "left_semi").groupBy("id", "a", "b").agg(F.count(F.lit(1)).alias("c")).where("c > 1").limit(1).count():
        sets = sets.dropDuplicates(["id", "a"])  # rows that repeat an id and text; without such rows no text is shuffled
    sets = table_at(sets.drop("a"), store)
    edges = cut(compared(stars, sets).where(F.col("alike") >= threshold - 1e-12).select("p", "q"))
    labels = components(edges)
    more = cut(links_left(labelled(buckets.select("key", "rep"), labels, "rep"), sets, threshold, kind))
    if more.limit(1).count():
        labels = components(edges.union(more))
    drop_dir(df.sparkSession, store)  # links and labels are tables of their own by now

    classes = labelled(reps.select("a", "b", "rep", "copies"), labels, "rep")
    sizes = classes.groupBy("label").agg(F.sum("copies").alias("class_size"))
    # only classes of two rows or more are looked up, each in SALTS places, so that copies of one text do not meet in one task
    classes = classes.join(sizes.where("class_size > 1"), "label").select("a", "b", F.col("label").alias("class_id"), "class_size", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    signs = signs.select("id", "n", "a", "b")
    salt = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")
    out = signs.where("n > 0").withColumn("salt", salt).join(classes, ["a", "b", "salt"], "left").select("id", "class_id", "class_size")
    out = out.unionByName(signs.where("n = 0").select("id", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size")))
    out = out.withColumns({"class_id": F.coalesce("class_id", "id"), "class_size": F.coalesce("class_size", F.lit(1)).cast("long")})
    return out.select(F.col("id").alias(id_col), "class_id", "class_size", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
