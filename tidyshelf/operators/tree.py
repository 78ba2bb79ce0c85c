"""Directories as rows: which hold a series, which are siblings, which are bare image folders; merging trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names as N
from ..session import fixed


def ancestors(path: Column) -> Column:
    """Every proper ancestor of a path, the shortest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def series_dirs(files: DataFrame, dir_path: str, root: str | None = None) -> DataFrame:
    """The shallowest directories that hold archives; with a root, that one is not counted itself."""
    dirs = files.select(F.col(dir_path).alias("dir_path")).distinct()
    if root is not None:
        dirs = dirs.where(F.col("dir_path") != root)
    deep = dirs.where(F.size(F.split("dir_path", "/")) > 1).select("dir_path", F.explode(ancestors(F.col("dir_path"))).alias("above"))
    return dirs.join(deep.join(dirs.select(F.col("dir_path").alias("above")), "above", "left_semi"), "dir_path", "left_anti")


def sibling_groups(dirs: DataFrame, parent: str, name: str, at_least: int = 2) -> DataFrame:
    """Parents with two children or more, and their count."""
    return dirs.select(parent, name).distinct().groupBy(parent).agg(F.count(F.lit(1)).alias("siblings")).where(F.col("siblings") >= at_least)


def groups_by_base(dirs: DataFrame, parent: str, name: str) -> DataFrame:
    """Siblings that differ only by a trailing number token, with the name their merged directory gets.

    The name with most capitals counts, of equals the first.
    """
    rows = dirs.select(F.col(parent).alias("parent"), F.col(name).alias("name"), N.base_name(F.col(name)).alias("base"), N.unnumbered(F.col(name)).alias("bare")).where("base is not null")
    first = F.min_by("bare", F.struct(-N.n_upper(F.col("bare")), F.col("name")))
    out = rows.groupBy("parent", "base").agg(F.count(F.lit(1)).alias("members"), first.alias("best"), F.min("name").alias("first_name")).where("members >= 2")
    return out.select("parent", "base", "members", F.coalesce(F.nullif(N.canonical(F.col("best")), F.lit("")), F.col("first_name")).alias("canonical"))


def image_folders(entries: DataFrame, directory: str, is_dir: Column, is_image: Column, is_meta: Column) -> DataFrame:
    """Directories without subdirectories that hold images, and nothing but images and metadata."""
    out = entries.groupBy(directory).agg(F.bool_or(is_image & ~is_dir).alias("some"), F.bool_and(~is_dir & (is_image | is_meta)).alias("only"), F.count(F.lit(1)).alias("entries"))
    return out.where("some and only").select(directory, "entries")


def format_pairs(files: DataFrame, directory: str, key: str, kind: str, old: str, new: str) -> DataFrame:
    """Files of the old kind whose key exists in the new kind, in the same directory."""
    have = files.where(F.col(kind) == new).select(directory, key).distinct()
    return files.where(F.col(kind) == old).join(have, [directory, key], "left_semi")


def marker_pairs(names: DataFrame, name: str, decompose: bool = True) -> DataFrame:
    """Names with a marker word and the name they repeat without it, if there is one; of several the last by lower case."""
    rows = names.select(F.col(name).alias("name"), N.marker_key(F.col(name), decompose).alias("key"), N.has_marker(F.col(name)).alias("marked")).where("key <> ''")
    plain = rows.where("not marked").groupBy("key").agg(F.max_by("name", F.struct(F.lower("name"), "name")).alias("plain"))
    return rows.where("marked").select(F.col("name").alias("marked"), "key").join(plain, "key", "left").select("marked", "plain", "key")


#: Bits of one of Spark's bitmaps, bits for each path of a log, and the most bitmaps that are sent to every task (32 MB).
BITS, BITS_A_PATH, MOST_BITMAPS = 32_768, 8, 8192
#: Paths that are sent to every task.
MOST_PATHS = 100_000


def not_done(candidates: DataFrame, done: DataFrame, path: str) -> DataFrame:
    """What an interrupted run has left to do; candidates without a path stay.

    Bitmaps of the log's hashed paths tell of most new candidates that the log cannot hold them, without a shuffle. Only
    possible hits meet the log exactly: few are sent to where the log is read, many are joined with it. A log too long for
    bitmaps of a bounded size is joined as a whole.
    """
    log = done.select(path).where(F.col(path).isNotNull())
    buckets = max(1, -(-log.count() * BITS_A_PATH // BITS))
    if buckets > MOST_BITMAPS:
        return candidates.join(log.distinct(), path, "left_anti")
    place = F.pmod(F.xxhash64(F.col(path).cast("string")), F.lit(buckets * BITS))
    bucket, bit = F.floor(place / BITS).cast("int"), place % BITS
    maps = log.groupBy(bucket.alias("__bucket")).agg(F.bitmap_construct_agg(bit).alias("__bits"))
    byte = F.conv(F.hex(F.substring("__bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    rows = candidates.join(F.broadcast(maps), bucket == F.col("__bucket"), "left")
    maybe = F.coalesce(F.getbit(byte, bit % 8) == 1, F.lit(False))
    hits = fixed(rows.where(maybe).select(path).distinct())
    if hits.limit(MOST_PATHS + 1).count() <= MOST_PATHS:
        found = fixed(log.join(F.broadcast(hits), path, "left_semi").distinct())
        return candidates.join(F.broadcast(found), path, "left_anti").select(*candidates.columns)
    rest = rows.where(maybe).join(log.distinct(), path, "left_anti")
    return rows.where(~maybe).select(*candidates.columns).unionByName(rest.select(*candidates.columns))


def natural_key(name: Column) -> Column:
    """Orders names with numbers by value, metadata first: digit runs padded, lower case; runs over 20 digits by their length first."""
    first = F.when(F.lower(name) == "comicinfo.xml", "0").otherwise("1")
    parts = F.split(F.regexp_replace(F.lower(name), r"(\d+)", "\u0001$1\u0001"), "\u0001")
    bare = lambda p: F.regexp_replace(p, r"^0+(?=\d)", "")
    long = lambda p: F.concat(F.lit(":"), F.lpad(F.length(bare(p)).cast("string"), 5, "0"), F.lit(":"), bare(p))  # noqa: E731  a colon sorts behind digits
    padded = lambda p: F.when(~p.rlike(r"^\d+$"), p).when(F.length(bare(p)) <= 20, F.lpad(bare(p), 20, "0")).otherwise(long(p))
    return F.concat(first, F.array_join(F.transform(parts, padded), ""))


ORDERS = ("newest", "oldest", "alpha", "alpha-reverse")


def order_of(mode: str, time: str, name: str, tie: str) -> tuple[Column, bool, list[Column]]:
    """The key of a mode, whether it falls, and the whole order."""
    if mode not in ORDERS:
        raise ValueError(f"no such order: {mode}")
    key, down = F.col(time) if mode in ("newest", "oldest") else F.lower(name), mode in ("newest", "alpha-reverse")
    return key, down, [key.desc() if down else key.asc(), F.col(tie).asc()]


def in_order(dirs: DataFrame, mode: str, time: str = "mtime", name: str = "dir_name", tie: str | None = None) -> DataFrame:
    """Directories in the order they are to be worked on: newest or oldest first, or by name without case, up or down."""
    return dirs.orderBy(*order_of(mode, time, name, tie or name)[2])


def placed(dirs: DataFrame, mode: str, time: str = "mtime", name: str = "dir_name", tie: str | None = None, ranges: int = 32, sampled: int = 2000) -> DataFrame:
    """Every directory with its place (from 1) in ``in_order``.

    Rows are numbered inside ranges of the order, whose bounds come from a sample, and shifted by the counts of the ranges
    before. Rows equal in key and tie share a range.
    """
    tie = tie or name
    key, down, order = order_of(mode, time, name, tie)
    share = min(1.0, sampled / max(1, dirs.count()))
    seen = in_order(dirs.sample(share, seed=1) if share < 1 else dirs, mode, time, name, tie).select(key.alias("k"), F.col(tie).alias("t")).collect()
    step = max(1, len(seen) // ranges)

    def after(bound) -> Column:
        """Whether a row stands at the bound or after it; nulls are least."""
        k, t = F.lit(bound.k), F.lit(bound.t)
        if bound.k is None:
            beyond = F.lit(False) if down else key.isNotNull()
        else:
            beyond = key.isNull() | (key < k) if down else key > k
        same = key.isNull() if bound.k is None else key.eqNullSafe(k)
        later = F.lit(True) if bound.t is None else F.col(tie) >= t
        return F.coalesce(beyond, F.lit(False)) | (same & F.coalesce(later, F.lit(False)))

    number = F.lit(0)
    for bound in seen[step::step]:
        number = number + after(bound).cast("int")
    rows = dirs.withColumn("__range", number)
    counts = dict(rows.groupBy("__range").count().collect())
    before, total = {}, 0
    for r in sorted(counts):
        before[r], total = total, total + counts[r]
    if not counts:
        return dirs.withColumn("place", F.lit(0).cast("long"))
    shift = F.create_map(*[F.lit(x).cast("long") for pair in before.items() for x in pair])
    return rows.withColumn("place", F.row_number().over(W.partitionBy("__range").orderBy(*order)) + shift[F.col("__range").cast("long")]).drop("__range")
