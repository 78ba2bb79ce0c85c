"""Shards of near-equal bytes by minimax contiguous partition, groups of equal texts kept whole.

Groups are ordered by a 63-bit hash of their text. The smallest capacity is sought that lets a greedy pass fill at most
``n_shards`` shards with consecutive groups. The search needs running totals only near its cuts: groups are summed into
65,536 cells of the hash range, the cells' totals give the driver a lower and an upper bound for the capacity, and only
cells in which a cut could still fall are summed again into finer cells, until every such cell is a single group. So the
driver holds a bounded number of cells, the result is the exact minimum over groups, and a row's shard is a comparison of
its hash with 15 constants: no join, and texts are not shuffled.

Slots number the rows of a shard from 0 without gaps: rows are dealt to ``buckets`` by a hash of their id, numbered there,
and shifted by the counts of the buckets before, so a large group of copies is spread like any other rows.

Null texts have no bytes and count as empty. Rows that repeat an id and text get slots of their own. An empty table gives
no rows. Further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import cut, documents, text_of

KEY_BITS = 63
FIRST_BITS, NEXT_BITS = 16, 10


@dataclass(frozen=True)
class Cell:
    """The groups whose keys lie in [start, start + 2**width)."""

    start: int
    width: int
    size: int
    groups: int
    largest: int


def summed(rows: DataFrame, width: int, inside: list[Cell] | None = None) -> list[Cell]:
    """Cells of 2**width keys, or those of them inside wider cells of one width."""
    if inside is not None:
        wide = inside[0].width
        rows = rows.where(F.shiftright("key", wide).isin([c.start >> wide for c in inside]))
    groups = rows.groupBy("key").agg(F.sum("size").alias("size"))
    cells = groups.groupBy(F.shiftright("key", width).alias("cell")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("groups"), F.max("size").alias("largest"))
    return sorted((Cell(r.cell << width, width, r["size"], r.groups, r.largest) for r in cells.collect()), key=lambda c: c.start)


def greedy(ends: list[int], capacity: int, shards: int) -> list[int] | None:
    """ends: running totals, the first 0. The first cell of each shard and the end, or None where capacity is too small."""
    cuts = [0]
    while cuts[-1] < len(ends) - 1:
        if len(cuts) > shards:
            return None
        nxt = bisect_right(ends, ends[cuts[-1]] + capacity) - 1
        if nxt == cuts[-1]:
            return None
        cuts.append(nxt)
    return cuts


def smallest_capacity(ends: list[int], shards: int, low: int) -> int:
    high = ends[-1]
    while low < high:
        mid = (low + high) // 2
        if (cuts := greedy(ends, mid, shards)) is not None and len(cuts) <= shards + 1:
            high = mid
        else:
            low = mid + 1
    return low


def open_cells(cells: list[Cell], shards: int) -> list[Cell]:
    """The cells of several groups in which a cut of the best partition could fall; first those that are large in themselves."""
    ends = [0, *accumulate(c.size for c in cells)]
    low = max(-(-ends[-1] // shards), max(c.largest for c in cells))
    if fat := [c for c in cells if c.groups > 1 and 4 * c.size > low]:
        return fat
    high = smallest_capacity(ends, shards, low)
    found, at = set(), 0
    for j in range(1, shards):
        at = max(at, bisect_right(ends, ends[at] + low) - 1)  # no cut j of a finer greedy pass lies before
        last = min(bisect_right(ends, j * high) - 1, len(cells) - 1)  # nor after
        found.update(range(at, last + 1))
    return [cells[i] for i in sorted(found) if cells[i].groups > 1] if high > low else []


def balanced(ends: list[int], capacity: int, shards: int) -> list[int]:
    """Cuts within capacity, each as near to its even place as the capacity lets it be; the greedy ones if that fails."""
    total, count = ends[-1], len(ends) - 1
    earliest = [0] * (shards + 1)
    earliest[shards] = count
    for j in range(shards - 1, -1, -1):
        need = ends[earliest[j + 1]] - capacity
        earliest[j] = max(0, bisect_right(ends, need - 1)) if need > 0 else 0
    cuts = [0]
    for j in range(1, shards):
        reach = bisect_right(ends, ends[cuts[-1]] + capacity) - 1
        want = bisect_right(ends, j * total // shards) - 1
        if want < count and ends[want + 1] - j * total // shards < j * total // shards - ends[want]:
            want += 1
        cuts.append(max(cuts[-1], min(max(want, earliest[j]), reach)))
    cuts.append(count)
    if all(ends[b] - ends[a] <= capacity for a, b in zip(cuts, cuts[1:], strict=False)):
        return cuts
    cuts = greedy(ends, capacity, shards)
    return cuts + [count] * (shards + 1 - len(cuts))


def cut_keys(rows: DataFrame, shards: int) -> list[int]:
    """The first key of each shard but the first; rows: (key, size)."""
    width = KEY_BITS - FIRST_BITS
    cells = summed(rows, width)
    if not cells:
        return []
    while wanted := open_cells(cells, shards):
        out = {c.start for c in wanted}
        finer = [c for c in cells if c.start not in out]
        for width in {c.width for c in wanted}:
            finer += summed(rows, max(0, width - NEXT_BITS), [c for c in wanted if c.width == width])
        cells = sorted(finer, key=lambda c: c.start)
    ends = [0, *accumulate(c.size for c in cells)]
    low = max(-(-ends[-1] // shards), max(c.largest for c in cells))
    cuts = balanced(ends, smallest_capacity(ends, shards, low), shards)
    return [cells[i].start if i < len(cells) else 1 << KEY_BITS for i in cuts[1:-1]]


def shard_documents(df: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", buckets: int = 1024) -> DataFrame:
    """For each row: id, size, text_crc32, law, shard, slot, grown_shard."""
    raw = text_of(text_col).cast("binary")
    rows = cut(
        df.select(
            F.col(id_col).alias("id"), (F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + 1).cast("long").alias("size"),
            F.crc32(raw).alias("text_crc32"), F.shiftrightunsigned(F.xxhash64(raw), 1).alias("key"),
        )
    )
    shard = F.lit(0)
    for key in cut_keys(rows.select("key", "size"), n_shards):
        shard = shard + (F.col("key") >= F.lit(min(key, (1 << 63) - 1))).cast("int")
    rows = rows.select("*", shard.cast("int").alias("shard"), F.pmod(F.xxhash64("id", "text_crc32"), F.lit(buckets)).cast("int").alias("bucket"))
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # at most n_shards * buckets rows, whatever the input: small enough to send to every task
    numbered = rows.withColumn("nth", F.row_number().over(W.partitionBy("shard", "bucket").orderBy("id", "text_crc32"))).join(F.broadcast(offsets), ["shard", "bucket"])
    return numbered.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("nth") - 1).cast("long").alias("slot"),
        F.lit(None).cast(T.IntegerType()).alias("grown_shard"),
    )


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))
