"""Model fitting: contexts, indels, structural variants, fragment lengths, GC bias, qualities, error matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import ship, staged
from . import kernel
from .scan import following, running

#: Bases that one row holds when sequence is cut into tiles.
TILE = 4096


def sequence_tiles(contigs: DataFrame, k: int = 1, tile: int = TILE) -> DataFrame:
    """(contig, tile_start, seq): pieces of each contig (contig, seq) that overlap by k - 1 bases, so that each k-mer lies in
    exactly one."""
    return kernel.tiles(contigs, tile, 0, k - 1).where(F.length("seq") >= k).select("contig", F.col("tile_start").cast("int").alias("tile_start"), "seq")


def runs(contigs: DataFrame, unknown: bool = False, tile: int = TILE) -> DataFrame:
    """(contig, start, end): maximal runs of known bases, or of N. Runs are found by tile and joined where they touch."""
    t = sequence_tiles(contigs, 1, tile)
    pieces = F.regexp_extract_all("seq", F.lit("(N+|[^N]+)"), 1)
    step = lambda a, p: F.concat(a, F.array(F.struct((F.coalesce(F.element_at(a, -1)["end"], F.lit(0))).alias("start"), (F.coalesce(F.element_at(a, -1)["end"], F.lit(0)) + F.length(p)).alias("end"), p.startswith("N").alias("unknown"))))
    parts = F.aggregate(pieces, F.array().cast("array<struct<start:int,end:int,unknown:boolean>>"), lambda a, p: F.when(F.size(a) == 0, F.array(F.struct(F.lit(0).alias("start"), F.length(p).alias("end"), p.startswith("N").alias("unknown")))).otherwise(step(a, p)))
    t = t.select("contig", "tile_start", F.explode(parts).alias("r")).where(F.col("r.unknown") == unknown)
    t = t.select("contig", (F.col("tile_start") + F.col("r.start")).alias("start"), (F.col("tile_start") + F.col("r.end")).alias("end"))
    # pieces are disjoint: where one begins and none ends, a run begins, and the runs are the stretches between such places
    edges = t.select("contig", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))).alias("e"))
    edges = edges.groupBy("contig", F.col("e.at").alias("start")).agg(F.sum("e.d").alias("d")).where("d != 0")
    return following(staged(edges, "edges"), ["contig"], "start", "end").where("d = 1").select("contig", "start", "end")


def homopolymers(contigs: DataFrame, cap: int) -> DataFrame:
    """(base, run_length, n): homopolymer runs by length, longer ones counted as `cap`. contigs: seq of a row at most one tile
    long is matched in place."""
    found = F.regexp_extract_all("seq", F.lit(r"((A+)|(C+)|(G+)|(T+))"), 1)
    r = contigs.select(F.explode(found).alias("run"))
    return r.groupBy(F.substring("run", 1, 1).alias("base"), F.least(F.length("run"), F.lit(cap)).alias("run_length")).agg(F.count("*").alias("n"))


def fold_context(frame: Column) -> Column:
    """XYZ -> XNZ."""
    return F.concat(F.substring(frame, 1, 1), F.lit("N"), F.substring(frame, 3, 1))


def row_shares(counts: DataFrame, row: list[str], n: str) -> DataFrame:
    """counts with `share`: n over the total of its row."""
    return counts.withColumn("share", F.col(n) / F.sum(n).over(Window.partitionBy(*row)))


def normalized_matrix(counts: DataFrame) -> DataFrame:
    """(ref, read, share) for all pairs of different bases from (ref, read, n); an empty row gives 1/3 each."""
    spark = counts.sparkSession
    bases = spark.createDataFrame([(a, b) for a in "ACGT" for b in "ACGT" if a != b], "ref string, read string")
    full = bases.join(counts.groupBy("ref", "read").agg(F.sum("n").alias("n")), ["ref", "read"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy("ref"))
    return full.select("ref", "read", F.when(total > 0, F.col("n") / total).otherwise(F.lit(1 / 3)).alias("share"))


def variant_mix(records: DataFrame) -> DataFrame:
    """(snp, ins, del, homozygous) shares of records (type, homozygous). Without any, a third each and 0; without a homozygous
    one, 0.001 / n."""
    of = lambda t: F.sum(F.when(F.col("type") == t, 1).otherwise(0))
    n = of("SNP") + of("INS") + of("DEL")
    homs = F.sum(F.when(F.col("homozygous") & F.col("type").isin("SNP", "INS", "DEL"), 1).otherwise(0))
    share = lambda t: F.when(n > 0, of(t) / n).otherwise(F.lit(1 / 3))
    return records.agg(share("SNP").alias("snp"), share("INS").alias("ins"), share("DEL").alias("del"), F.when(n == 0, F.lit(0.0)).when(homs == 0, 0.001 / n).otherwise(homs / n).alias("homozygous"))


def sv_model(svs: DataFrame, least: int = 2, shortest: int = 50) -> DataFrame:
    """(type, n, probability, mu, sigma, homozygous): log-normal lengths by type (population deviation), of types observed
    `least` times with a length of `shortest` or more."""
    g = svs.where(F.col("length") >= shortest).groupBy("type").agg(F.count("*").alias("n"), F.avg(F.log("length")).alias("mu"), F.stddev_pop(F.log("length")).alias("sigma"), F.avg(F.when(F.col("homozygous"), 1.0).otherwise(0.0)).alias("homozygous"))
    g = g.where(F.col("n") >= least)
    return g.select("type", "n", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).alias("probability"), "mu", "sigma", "homozygous")


def histogram(values: DataFrame, column: str) -> DataFrame:
    """(column, n)"""
    return values.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def histogram_quantile(hist: DataFrame, column: str, q: float) -> DataFrame:
    """One row `x`: the least value whose running count reaches ceil(q * total), at least 1. The window runs over distinct values."""
    running = F.sum("n").over(Window.orderBy(column))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    need = F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("total")))
    h = hist.withColumn("cum", running).withColumn("total", total)
    return h.where(F.col("cum") >= need).agg(F.min(column).alias("x"))


def median_and_mad(hist: DataFrame, column: str) -> DataFrame:
    """One row (median, mad): the histogram quantile 0.5, and that of the absolute deviations from it."""
    median = histogram_quantile(hist, column, 0.5).withColumnRenamed("x", "median")
    dev = hist.join(F.broadcast(median)).select(F.abs(F.col(column) - F.col("median")).alias("dev"), "n").groupBy("dev").agg(F.sum("n").alias("n"))
    return median.join(F.broadcast(histogram_quantile(dev, "dev", 0.5).withColumnRenamed("x", "mad")))


def trimmed(hist: DataFrame, column: str, factor: float = 10.0, mass: float = 1e-5, min_reads: int = 2) -> DataFrame:
    """A total under min_reads is refused. hist up to median + factor * MAD (all of it if the MAD is 0), without ends that hold less than `mass` of the total."""
    h = hist.join(F.broadcast(median_and_mad(hist, column))).where((F.col("mad") == 0) | (F.col(column) <= F.col("median") + F.lit(factor) * F.col("mad")))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    up, down = F.sum("n").over(Window.orderBy(column)), F.sum("n").over(Window.orderBy(F.col(column).desc()))
    h = h.withColumn("total", total).withColumn("up", up).withColumn("down", down)
    enough = F.when(F.sum("n").over(Window.partitionBy(F.lit(0))) >= min_reads, True).otherwise(F.raise_error(F.lit("too few reads")).cast("boolean"))
    h = h.withColumn("enough", enough).where("enough")
    return h.where((F.col("up") >= mass * F.col("total")) & (F.col("down") >= mass * F.col("total"))).select(column, "n")


def weighted_moments(hist: DataFrame, column: str) -> DataFrame:
    """One row (n, mean, sd): the population deviation of a histogram."""
    x, n = F.col(column), F.col("n")
    mean, square = F.sum(x * n) / F.sum(n), F.sum(x * x * n) / F.sum(n)
    return hist.agg(F.sum(n).alias("n"), mean.alias("mean"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("sd"))


def smoothed(hist: DataFrame, column: str, passes: int = 24, least_distinct: int = 10) -> DataFrame:
    """(column, weight) on every value from the least to the greatest: a Gaussian kernel of Silverman's width, widened by 1.6
    until no value is without weight. Fewer than least_distinct values are returned as they are. The histogram has as many rows
    as there are lengths, and the width is found on the driver from its moments."""
    m = weighted_moments(hist, column).first()
    bounds = hist.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count("*").alias("k")).first()
    if bounds["k"] is None or bounds["k"] < least_distinct:
        return hist.select(column, F.col("n").cast("double").alias("weight"))
    width = max(1.06 * m["sd"] * m["n"] ** -0.2, 1e-6)
    dense = hist.sparkSession.range(bounds["lo"], bounds["hi"] + 1).withColumnRenamed("id", "at")
    for _ in range(passes):
        reach = max(1, int(5 * width))
        near = hist.select(F.col(column).alias("x"), "n", F.explode(F.sequence(F.col(column) - reach, F.col(column) + reach)).alias("at"))
        d = (F.col("at") - F.col("x")) / width
        out = dense.join(near.groupBy("at").agg(F.sum(F.col("n") * F.exp(-d * d / 2)).alias("weight")), "at", "left").select(F.col("at").alias(column), F.coalesce("weight", F.lit(0.0)).alias("weight"))
        if not out.where("weight <= 0").limit(1).count():
            break
        width *= 1.6
    return out


def gc_windows(contigs: DataFrame, size: int = 100, stride: int = 100) -> DataFrame:
    """(contig, start, gc): windows of `size` bases with a known one, at every `stride`; gc is a rounded percentage."""
    return kernel.gc_windows(contigs, size, stride)


def window_coverage(windows: DataFrame, depth: DataFrame, size: int) -> DataFrame:
    """windows (contig, start, ...; `size` bases) with `coverage`, the mean depth over their bases; depth: disjoint intervals (contig, start, end,
    depth), 0 elsewhere.

    A window holds what was summed up to its end less what was summed up to its start. Both ends of each window and the runs of depth go
    through one scan along the contig, in which an end sees the sum of the runs before it and the last of them."""
    w = windows.select("contig", F.struct(*windows.columns).alias("window"), F.inline(F.array(F.struct(F.col("start").cast("long").alias("at"), F.lit(-1).alias("sign")), F.struct((F.col("start") + size).cast("long").alias("at"), F.lit(1).alias("sign")))))
    run = F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("depth").cast("long").alias("depth"))
    runs = depth.select("contig", F.col("start").cast("long").alias("at"), F.lit(0).alias("sign"), run.alias("run"), ((F.col("end") - F.col("start")) * F.col("depth")).cast("long").alias("held"))
    both = staged(runs.unionByName(w, allowMissingColumns=True).withColumn("later", F.abs("sign")), "edges")
    seen = running(both, ["contig"], "at", {"total": ("sum", F.col("held")), "last": ("max", F.col("run"))}, ties=["later"]).where("later = 1")
    beyond = F.coalesce(F.greatest(F.col("last.end") - F.col("at"), F.lit(0)) * F.col("last.depth"), F.lit(0))
    g = seen.groupBy("window").agg((F.sum(F.col("sign") * (F.col("total") - beyond)) / size).alias("coverage"))
    return g.select("window.*", "coverage")


def gc_weights(windows: DataFrame, least: int = 10, fitted: bool = False) -> DataFrame:
    """(gc 0..100, weight) from windows (gc, coverage): the median of a percentage with `least` windows or more over the median
    of all windows of such percentages; linear between supported percentages, flat beyond; 1 without any. Medians are those of
    the counts by (gc, coverage), so windows are read once. fitted: with a column that tells the supported percentages."""
    spark = windows.sparkSession
    counts = staged(windows.groupBy("gc", "coverage").agg(F.count("*").alias("n")), "gc_counts")
    supported = counts.groupBy("gc").agg(F.sum("n").alias("total"), F.percentile("coverage", 0.5, F.col("n")).alias("median")).where(F.col("total") >= least)
    pooled = counts.join(F.broadcast(supported.select("gc")), "gc", "left_semi").agg(F.percentile("coverage", 0.5, F.col("n")).alias("pooled"))
    anchors = supported.join(F.broadcast(pooled)).where("pooled > 0").select(F.col("gc").alias("a"), (F.col("median") / F.col("pooled")).alias("w"))
    grid = spark.range(101).select(F.col("id").cast("int").alias("gc")).join(anchors, F.col("gc") == F.col("a"), "left")
    before, after = Window.orderBy("gc").rowsBetween(Window.unboundedPreceding, 0), Window.orderBy("gc").rowsBetween(0, Window.unboundedFollowing)
    for side, w, f in (("lo", before, F.last), ("hi", after, F.first)):
        grid = grid.withColumn(f"{side}_a", f("a", ignorenulls=True).over(w)).withColumn(f"{side}_w", f("w", ignorenulls=True).over(w))
    part = (F.col("gc") - F.col("lo_a")) / (F.col("hi_a") - F.col("lo_a"))
    between = F.when(F.col("lo_a") == F.col("hi_a"), F.col("lo_w")).otherwise(F.col("lo_w") + (F.col("hi_w") - F.col("lo_w")) * part)
    weight = F.coalesce(between, "lo_w", "hi_w", F.lit(1.0)).alias("weight")
    return grid.select("gc", weight, *([F.col("a").isNotNull().alias("fitted")] if fitted else []))


def quality_transitions(reads: DataFrame) -> DataFrame:
    """(pos, prev, next, n) from reads (scores): pos is 1-based, and prev is -1 at the first. Counted in the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("scores")
            offsets, q = column.offsets.to_numpy(), column.values.to_numpy().astype(np.int64)
            q, offsets = q[offsets[0] : offsets[-1]], offsets - offsets[0]
            pos = np.arange(len(q)) - np.repeat(offsets[:-1], np.diff(offsets))
            prev = np.where(pos > 0, np.roll(q, 1), -1)
            found, n = np.unique((pos << 32) + ((prev + 1) << 16) + q, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((found >> 32) + 1, pa.int64()), pa.array((found >> 16 & 0xFFFF) - 1, pa.int32()), pa.array(found & 0xFFFF, pa.int32()), pa.array(n, pa.int64())], ["pos", "prev", "next", "n"])

    ship(reads.sparkSession)
    found = reads.where(F.size("scores") > 0).select("scores").mapInArrow(run, "pos long, prev int, next int, n long")
    return found.groupBy("pos", "prev", "next").agg(F.sum("n").alias("n"))


def degraded(reads: DataFrame, window: int = 50, cut: float = 25.0) -> DataFrame:
    """reads with `degraded`: the mean of the last `window` scores is under `cut`; null for shorter reads."""
    tail = F.slice("scores", F.greatest(F.size("scores") - window + 1, F.lit(1)), F.lit(window))
    mean = F.aggregate(tail, F.lit(0), lambda a, q: a + q) / window
    return reads.withColumn("degraded", F.when(F.size("scores") >= window, mean < cut))


def overlap_matrix(bases: DataFrame) -> DataFrame:
    """(bin, outcome, n) from bases that two mates both read (cycle bin, b1, b2, ref, masked; with `n` a row stands for so many): masked,
    agree, first or second disagrees with the reference, or neither matches."""
    outcome = F.when(F.col("masked"), "masked").when(F.col("b1") == F.col("b2"), "agree").when(F.col("b2") == F.col("ref"), "first_differs").when(F.col("b1") == F.col("ref"), "second_differs").otherwise("neither")
    return bases.groupBy("bin", outcome.alias("outcome")).agg((F.sum("n") if "n" in bases.columns else F.count("*")).alias("n"))
