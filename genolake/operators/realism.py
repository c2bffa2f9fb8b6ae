"""Measures of how real simulated data look: inserts, depth, clipping, spectra, summaries and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_stats(inserts: DataFrame, by: list[str], column: str = "insert") -> DataFrame:
    """(by..., n, mean, sd, skew, p99): population moments; p99 is the value at index floor(0.99 n) mod n in order."""
    x = F.col(column).cast("double")
    g = inserts.groupBy(*by).agg(F.count(column).alias("n"), F.avg(x).alias("mean"), F.avg(x * x).alias("m2"), F.avg(x * x * x).alias("m3"))
    var = F.greatest(F.col("m2") - F.col("mean") * F.col("mean"), F.lit(0.0))
    third = F.col("m3") - 3 * F.col("mean") * F.col("m2") + 2 * F.pow("mean", F.lit(3))
    g = g.select(*by, "n", "mean", F.sqrt(var).alias("sd"), F.when(var > 0, third / F.pow(var, F.lit(1.5))).otherwise(F.lit(0.0)).alias("skew"))
    hist = inserts.groupBy(*by, column).agg(F.count("*").alias("k"))
    cum = F.sum("k").over(Window.partitionBy(*by).orderBy(column))
    at = hist.withColumn("cum", cum).join(g.select(*by, "n"), by).where(F.col("cum") > F.floor(F.lit(0.99) * F.col("n")) % F.col("n"))
    return g.join(at.groupBy(*by).agg(F.min(column).alias("p99")), by)


def depth_stats(runs: DataFrame, by: str = "contig") -> DataFrame:
    """(by, mean, vmr, excess) over the covered bases of depth runs (start, end, depth): vmr = variance / mean, excess
    dispersion = (vmr - 1) / mean."""
    n, x = F.col("end") - F.col("start"), F.col("depth")
    g = runs.groupBy(by).agg(F.sum(n).alias("n"), (F.sum(n * x) / F.sum(n)).alias("mean"), (F.sum(n * x * x) / F.sum(n)).alias("m2"))
    vmr = (F.col("m2") - F.col("mean") * F.col("mean")) / F.col("mean")
    return g.select(by, "n", "mean", vmr.alias("vmr"), ((vmr - 1) / F.col("mean")).alias("excess"))


def autocorrelation(values: DataFrame, by: str, order: str, value: str, lag: int) -> DataFrame:
    """(by, autocorrelation) of a value with the one `lag` rows on; null without variance."""
    v = values.withColumn("later", F.lead(value, lag).over(Window.partitionBy(by).orderBy(order))).where("later is not null")
    return v.groupBy(by).agg(F.corr(value, "later").alias("autocorrelation"))


def clip_breakpoints(reads: DataFrame, least_clip: int = 20, support: int = 3) -> DataFrame:
    """(contig, pos0, n, mean_mapq): positions where `support` reads or more begin after a clip of `least_clip` bases or more."""
    return reads.where(F.col("left_clip") >= least_clip).groupBy("contig", "pos0").agg(F.count("*").alias("n"), F.avg("mapq").alias("mean_mapq")).where(F.col("n") >= support)


def sbs96(kmer: Column, alt: Column) -> Column:
    """The class of a substitution, as a pyrimidine's: A[C>T]G."""
    ref = F.substring(kmer, 2, 1)
    flip = ref.isin("A", "G")
    k = F.when(flip, F.reverse(F.translate(kmer, "ACGT", "TGCA"))).otherwise(kmer)
    a = F.when(flip, F.translate(alt, "ACGT", "TGCA")).otherwise(alt)
    return F.concat(F.substring(k, 1, 1), F.lit("["), F.substring(k, 2, 1), F.lit(">"), a, F.lit("]"), F.substring(k, 3, 1))


def cosine(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """One row `cosine` of two spectra (key, value)."""
    j = a.select(key, F.col(value).alias("x")).join(b.select(key, F.col(value).alias("y")), key, "full").fillna(0, ["x", "y"])
    return j.agg((F.sum(F.col("x") * F.col("y")) / (F.sqrt(F.sum(F.col("x") * F.col("x"))) * F.sqrt(F.sum(F.col("y") * F.col("y"))))).alias("cosine"))


def near(left: DataFrame, right: DataFrame, reach: int, position: str = "pos0") -> DataFrame:
    """(contig, position, r_position): pairs at most `reach` apart. Positions are filed in bins of that width, and the right
    side under its neighbours too."""
    width = max(reach, 1)
    a = left.withColumn("bin", F.floor(F.col(position) / width))
    b = right.select(F.col("contig"), F.col(position).alias("r_position")).withColumn("bin", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda s: F.floor(F.col("r_position") / width) + s)))
    return a.join(b, ["contig", "bin"]).where(F.abs(F.col(position) - F.col("r_position")) <= reach).drop("bin")


def panel(metrics: DataFrame, arms: tuple[str, str]) -> DataFrame:
    """(metric, median, least and greatest of each arm, ratio of the medians) from (metric, arm, value)."""
    g = metrics.groupBy("metric")
    of = lambda arm: F.when(F.col("arm") == arm, F.col("value"))
    aggs = [f(of(arm)).alias(f"{arm}_{name}") for arm in arms for name, f in (("median", F.median), ("min", F.min), ("max", F.max))]
    return g.agg(*aggs).withColumn("ratio", F.try_divide(f"{arms[0]}_median", f"{arms[1]}_median"))


def gate(measured: DataFrame, baseline: DataFrame) -> DataFrame:
    """(metric, value, base, passed): exact; ge2sd: not under base - 2 sd; band: within 2 sd; lepct: at most sd percent more."""
    v, b, s = F.col("value"), F.col("base"), F.col("sd")
    ok = F.when(F.col("gate") == "exact", v == b).when(F.col("gate") == "ge2sd", v >= b - 2 * s).when(F.col("gate") == "band", F.abs(v - b) <= 2 * s).otherwise(v <= b * (1 + s / 100))
    return measured.join(baseline, "metric").withColumn("passed", ok)
