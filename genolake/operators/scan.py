"""Scans along an order inside groups, dealt out by tiles of that order.

A window over a whole group is one task, however long the group is. Here a group is cut into tiles of its order column: the window
runs inside a tile, and what the tiles before it hold is carried in. The carries are folds of one row a tile, so the
window over a group sees its tiles only. Folding twice is right as the folds are associative."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged

#: Values of the order column in a tile.
TILE = 1 << 16
#: name: (aggregate, how a carry meets the fold inside the tile).
FOLDS = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "xor": (F.bit_xor, lambda a, b: F.coalesce(a, F.lit(0).cast("long")).bitwiseXOR(F.coalesce(b, F.lit(0).cast("long")))),
}
_FIRST = -(1 << 62)


def _tile(order: str, width: int) -> Column:
    return F.coalesce(F.floor(F.col(order) / width), F.lit(_FIRST)).alias("_tile")


def running(df: DataFrame, group: list[str], order: str, folds: dict[str, tuple[str, Column]], ties: list[str] = (), width: int = TILE, before: bool = False) -> DataFrame:
    """df with a column for each fold {name: (sum, max or xor, column)} over the rows of its group up to it, or (before) ahead of it.

    order: a column of integers, nulls first; rows that share its value go by `ties`, and in any order beyond that. group: columns
    without nulls. A sum over no row is 0, a maximum null. df is read twice, so a dear one is staged by the caller. A task holds
    the rows of one tile; rows crowded on one value of the order stay together."""
    tiled = df.withColumn("_tile", _tile(order, width))
    own = tiled.groupBy(*group, "_tile").agg(*[FOLDS[kind][0](column).alias(f"_{name}") for name, (kind, column) in folds.items()])
    past = Window.partitionBy(*group).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    carry = own.select(*group, "_tile", *[FOLDS[kind][0](f"_{name}").over(past).alias(f"_{name}") for name, (kind, _) in folds.items()])
    inside = Window.partitionBy(*group, "_tile").orderBy(F.col(order).asc_nulls_first(), *ties).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    local = tiled.withColumns({name: FOLDS[kind][0](column).over(inside) for name, (kind, column) in folds.items()})
    out = local.join(carry, [*group, "_tile"], "left")
    return out.select(*[c for c in df.columns if c not in folds], *[FOLDS[kind][1](F.col(f"_{name}"), F.col(name)).alias(name) for name, (kind, _) in folds.items()])


def following(df: DataFrame, group: list[str], order: str, name: str, width: int = TILE) -> DataFrame:
    """df with, in `name`, the least greater value of the order column (integers, no nulls) in its group, null at the last. Rows are
    distinct by group and order."""
    tiled = df.withColumn("_tile", _tile(order, width))
    own = tiled.groupBy(*group, "_tile").agg(F.min(order).alias("_least"))
    carry = own.select(*group, "_tile", F.lead("_least").over(Window.partitionBy(*group).orderBy("_tile")).alias("_next"))
    local = tiled.withColumn("_lead", F.lead(order).over(Window.partitionBy(*group, "_tile").orderBy(order)))
    return local.join(carry, [*group, "_tile"], "left").select(*[c for c in df.columns if c != name], F.coalesce("_lead", "_next").alias(name))


def ranged(df: DataFrame, order: str, count: str, name: str) -> DataFrame:
    """df (one row a value of `order`, any type) with, in `name`, the sum of `count` over all rows of lesser order. Values are dealt out by
    range, summed by part, and scanned inside a part; what lies before a part comes from the parts' sums, one row for all."""
    parts = staged(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = parts.groupBy("_part").agg(F.sum(count).alias("n")).agg(F.collect_list(F.struct("_part", "n")).alias("_sums"))
    past = F.aggregate(F.filter("_sums", lambda s: s["_part"] < F.col("_part")), F.lit(0).cast("long"), lambda a, s: a + s["n"])
    inside = F.sum(count).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return parts.withColumn(name, F.coalesce(inside, F.lit(0))).join(F.broadcast(sums)).withColumn(name, F.col(name) + past).drop("_part", "_sums")
