"""Sharding by longest-processing-time scheduling: groups that must stay together go, largest first, to the least-loaded
shard, taken from a heap.

Groups of one size are interchangeable, so the schedule is made of (size, number of groups): for each size, from the
largest down, it says how many groups each shard gets, which is what the heap would give group by group. Only this
histogram reaches the driver. Its rows are bounded by the bytes: k different sizes add up to k * k / 2 bytes or more, so
100 TB have at most 14 million sizes, whatever the number of groups. Each group then finds its shard by its place
among those of its size."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, join_hot, join_small, ship, staged

#: Rows that one task numbers.
NUMBERED = 250_000


def longest_first(sizes: Iterable[tuple[int, int]], shards: int) -> list[list[int]]:
    """(size, groups) by falling size -> for each size, how many of its groups each shard gets. The least-loaded shard takes the next
    group; of equal loads the lower shard. Once loads differ by less than a size, each shard takes one group a round."""
    heap = [(0, s) for s in range(shards)]
    out = []
    for size, groups in sizes:
        taken = [0] * shards
        while groups:
            load, shard = heap[0]
            most = max(heap)[0] if groups > shards else 0
            if groups > shards and most - load < size:
                rounds = groups // shards
                for s in range(shards):
                    taken[s] += rounds
                heap = [(x + rounds * size, s) for x, s in heap]  # all grow alike, so it stays a heap
                groups -= rounds * shards
            else:
                heapq.heapreplace(heap, (load + size, shard))
                taken[shard] += 1
                groups -= 1
        out.append(taken)
    return out


def assign_shards(docs: DataFrame, shards: int = 24, numbered: int = NUMBERED) -> DataFrame:
    """Returns (doc_id, size, text_crc32, shard, slot), a row per row of docs (doc_id, text; other columns are ignored).

    size: UTF-8 bytes of the text (a null text has none) plus 8. Shards have nearly equal bytes. Rows with equal texts are
    in one shard, however many they are; a null text counts as empty. slot: the row's place in its shard, gapless from 0.
    Rows that repeat a doc_id, or have none, are rows like any others; an empty table gives no rows."""
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("group"))
    rows = staged(rows, "rows")
    groups = staged(rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("copies")), "groups")
    sizes = [(r["bytes"], r["n"]) for r in groups.groupBy("bytes").agg(F.count("*").alias("n")).orderBy(F.desc("bytes")).toLocalIterator()]
    if not sizes:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    schedule = _schedule(sizes, longest_first(sizes, shards))
    schedule = staged(spark.createDataFrame(schedule, "bytes long, ends array<long>"), "schedule")
    placed = _numbered(groups, "bytes", ["group"], "place", sum(n for _, n in sizes), numbered)
    # the first shards of a size have taken `ends` of its groups
    placed = join_small(placed, schedule, ["bytes"], "inner").select("group", "copies", F.size(F.filter("ends", lambda e: e <= F.col("place"))).alias("shard"))
    placed = staged(placed, "placed")
    own = staged(join_hot(rows, placed, "group", "copies").select("doc_id", "size", "text_crc32", "shard"), "sharded")
    discard(rows, groups, schedule, placed)
    return _numbered(own, "shard", ["doc_id", "text_crc32"], "slot", own.count(), numbered).select("doc_id", "size", "text_crc32", "shard", "slot")


def _schedule(sizes: list[tuple[int, int]], taken: list[list[int]]) -> pa.Table:
    """(bytes, ends): ends[k] of a size's groups are in shards 0 to k."""
    ends = []
    for row in taken:
        total = 0
        ends.append([total := total + n for n in row])
    return pa.table({"bytes": pa.array([b for b, _ in sizes], pa.int64()), "ends": pa.array(ends, pa.list_(pa.int64()))})


def _numbered(rows: DataFrame, by: str, order: list[str], name: str, n: int, numbered: int) -> DataFrame:
    """rows (staged) with their place among those of the same `by`, gapless from 0, ordered within parts of about `numbered` rows. A part
    starts where those before it end. Rows are dealt to parts one by one, so equal ones are spread."""
    parts = max(1, math.ceil(n / numbered))
    dealt = staged(rows.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("int")), "dealt") if parts > 1 else rows.withColumn("part", F.lit(0))
    before = Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(by, "part").agg(F.count("*").alias("n_part")).withColumn("first", F.coalesce(F.sum("n_part").over(before), F.lit(0))).drop("n_part")
    place = F.row_number().over(Window.partitionBy(by, "part").orderBy(*order)) - 1
    out = dealt.withColumn(name, place).join(starts, [by, "part"])
    return out.withColumn(name, (F.col(name) + F.col("first")).cast("long")).drop("part", "first")
