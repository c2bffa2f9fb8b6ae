"""Quality models of both mates and of two populations, reads whose tail is degraded and the others, as sparse tables.

A model is rows of observed transitions; a score that was never left at a position has one row without next score, its uniform share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import ship
from .fit import degraded

POPULATION = ["mate", "degraded"]
ROW = [*POPULATION, "pos", "prev"]


def tensor(reads: DataFrame, window: int = 50, cut: float = 25.0, split: bool = True) -> DataFrame:
    """(mate, degraded, pos, prev, next, n) of reads (mate 1 or 2, scores 0 to 1000): pos is 1-based, prev -1 at the first. Counted in the tasks, so
    that what is shuffled are the distinct transitions of a task. A read too short to be classified is not degraded; without split none is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("scores")
            offsets = column.offsets.to_numpy()
            q = column.values.to_numpy(zero_copy_only=False).astype(np.int64)[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
            long = np.diff(offsets)
            group = batch.column("mate").to_numpy() * 2 + batch.column("degraded").to_numpy(zero_copy_only=False).astype(np.int64)
            pos = np.arange(len(q)) - np.repeat(offsets[:-1], long)
            prev = np.where(pos > 0, np.roll(q, 1), -1)
            found, n = np.unique((np.repeat(group, long) << 56) + (pos << 20) + ((prev + 1) << 10) + q, return_counts=True)
            mate, low = found >> 57, (found >> 56 & 1).astype(bool)
            place = (found >> 20 & ((1 << 36) - 1)) + 1
            yield pa.RecordBatch.from_arrays([pa.array(mate, pa.int64()), pa.array(low), pa.array(place, pa.int64()), pa.array((found >> 10 & 1023) - 1, pa.int32()), pa.array(found & 1023, pa.int32()), pa.array(n, pa.int64())], ["mate", "degraded", "pos", "prev", "next", "n"])

    ship(reads.sparkSession)
    r = reads.where("scores is not null").where(F.size("scores") > 0)
    r = degraded(r, window, cut) if split else r.withColumn("degraded", F.lit(False))
    found = r.select(F.col("mate").cast("long").alias("mate"), F.coalesce("degraded", F.lit(False)).alias("degraded"), "scores").mapInArrow(run, "mate long, degraded boolean, pos long, prev int, next int, n long")
    return found.groupBy(*ROW, "next").agg(F.sum("n").alias("n"))


def covering(counts: DataFrame, split: bool = True) -> DataFrame:
    """counts as they are, or an error if a population's positions fall short of the model's: padded ones would draw invented scores. With
    split, each mate needs both populations."""
    own = counts.groupBy(*POPULATION).agg(F.countDistinct("pos").alias("seen"))
    all_ = own.agg(F.max("seen").alias("positions"), F.countDistinct("mate").alias("mates"), F.count("*").alias("populations"))
    said = F.format_string("mate %d, %s: %d of %d positions were observed", F.col("mate"), F.when(F.col("degraded"), "degraded").otherwise("healthy"), F.col("seen"), F.col("positions"))
    short = F.when(F.col("seen") < F.col("positions"), F.raise_error(said).cast("boolean"))
    lone = F.when(F.col("populations") < F.col("mates") * (2 if split else 1), F.raise_error(F.lit("a mate has no degraded, or no healthy population")).cast("boolean"))
    checked = own.join(F.broadcast(all_)).select(*POPULATION, F.coalesce(short, lone, F.lit(True)).alias("ok"))
    return counts.join(F.broadcast(checked), POPULATION).where("ok").drop("ok")


def shares(counts: DataFrame) -> DataFrame:
    """(mate, degraded, pos, prev, next, share): the share of each observed transition in its row, and for each position of a population one row without
    prev and next: the uniform share over the options, for a score that was never left there. Options are those of all populations."""
    seen = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*ROW))).drop("n")
    options = counts.agg(F.countDistinct("next").alias("options"))
    rest = counts.where("prev >= 0").select(*POPULATION, "pos").distinct().join(F.broadcast(options))
    none = F.lit(None).cast("int")
    return seen.unionByName(rest.select(*POPULATION, "pos", none.alias("prev"), none.alias("next"), (1 / F.col("options")).alias("share")))


def share_of(wanted: DataFrame, model: DataFrame) -> DataFrame:
    """wanted (mate, degraded, pos, prev, next) with `share`: the observed one, 0 if the row was left otherwise, the uniform one if the row wasn't
    seen, null beyond the model's positions."""
    seen = model.where("prev is not null")
    rows = seen.select(*ROW).distinct().withColumn("_row", F.lit(True))
    rest = model.where("prev is null").select(*POPULATION, "pos", F.col("share").alias("_rest"))
    out = wanted.join(seen, [*ROW, "next"], "left").join(rows, ROW, "left").join(F.broadcast(rest), [*POPULATION, "pos"], "left")
    return out.withColumn("share", F.coalesce("share", F.when(F.col("_row"), F.lit(0.0)).otherwise(F.col("_rest")))).drop("_row", "_rest")


def with_mate(first: DataFrame, second: DataFrame) -> DataFrame:
    """A model of the first mate's reads with another one attached for the second; an error if their options differ, as a read draws from one list."""
    options = lambda m: m.where("next is not null").agg(F.array_sort(F.collect_set("next")).alias("o"))
    both = options(first).union(options(second)).agg(F.countDistinct("o").alias("lists"))
    ok = both.select(F.when(F.col("lists") == 1, True).otherwise(F.raise_error(F.lit("the mates' quality options differ")).cast("boolean")).alias("ok"))
    joined = first.withColumn("mate", F.lit(1).cast("long")).unionByName(second.withColumn("mate", F.lit(2).cast("long")))
    return joined.join(F.broadcast(ok)).where("ok").drop("ok")
