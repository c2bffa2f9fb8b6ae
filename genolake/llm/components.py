"""Connected components of an edge table, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """pairs: (u, v). Every v beside u moves to the least node beside u (itself included)."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = pairs.join(least, "u")
    if large:
        return moved.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a != b")


def components(edges: DataFrame) -> DataFrame:
    """edges: (a long, b long). Returns (node, root): root is the least node of the component.

    Nodes without an edge don't appear; self loops, repeated edges and nulls are ignored; no edges give no rows.
    Each step is staged in the shared folder, in place of the step before it; the driver sees a count and a checksum only. Path
    lengths are at least halved by a step."""
    now = staged(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before, sums = None, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    while sums != before and sums[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        step = _star(both, True).distinct()
        step = staged(_star(step.select(F.col("a").alias("u"), F.col("b").alias("v")), False).distinct(), "edges")
        discard(now)
        now, before = step, sums
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
