"""Comparison of variant sets: matches, misses, reasons, metrics and allele fractions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vcf
from ..staging import join_small, staged
from .intervals import points_in
from .scan import ranged, running

KEY = ["contig", "pos", "ref", "alt"]


def matched(truth: DataFrame, called: DataFrame) -> DataFrame:
    """The distinct keys of both."""
    return truth.select(*KEY).intersect(called.select(*KEY))


def missed(truth: DataFrame, called: DataFrame) -> DataFrame:
    """Records of truth whose key wasn't called; records that repeat a key all count. Swapped, the false calls."""
    return truth.join(called.select(*KEY).distinct(), KEY, "left_anti")


def rollup_metrics(truth: DataFrame, called: DataFrame) -> DataFrame:
    """(contig, tp, fn, fp, precision, recall, f1) by contig and, with contig TOTAL, for all. A ratio over 0 is null."""
    t, c = F.col("t"), F.col("c")
    sides = [df.select(*KEY, F.lit(int(df is truth)).cast("long").alias("t"), F.lit(int(df is called)).cast("long").alias("c")) for df in (truth, called)]
    keys = sides[0].union(sides[1]).groupBy(*KEY).agg(F.sum("t").alias("t"), F.sum("c").alias("c"))  # both sides meet in one shuffle
    n = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    out = keys.rollup("contig").agg(n(F.when((t > 0) & (c > 0), 1)).alias("tp"), n(F.when(c == 0, t)).alias("fn"), n(F.when(t == 0, c)).alias("fp"), F.grouping("contig").alias("total"))
    precision, recall = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    f1 = F.try_divide(2 * precision * recall, precision + recall)
    return out.select(F.when(F.col("total") == 1, "TOTAL").otherwise(F.col("contig")).alias("contig"), "tp", "fn", "fp", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def with_skip_reason(records: DataFrame, contigs: Column, bed: DataFrame | None = None, homozygous_ref: bool = False, filtered: bool = False) -> DataFrame:
    """records (contig, pos, ref, alt, gt, filter) with skip_reason, the first that holds, or null for records to compare."""
    home = ~F.exists(vcf.alleles(F.col("gt")), lambda a: ~a.isin("0"))
    out = records.withColumn("row", F.monotonically_increasing_id()) if bed is not None else records
    reason = F.when(~contigs, "outside_simulated_contigs").when(~vcf.literal(F.col("alt")), "symbolic")
    if not homozygous_ref:
        reason = reason.when(home, "homozygous_ref")
    if not filtered:
        reason = reason.when(~F.col("filter").isin("PASS", "."), "filtered")
    if bed is None:
        return out.withColumn("skip_reason", reason)
    inside = points_in(out.where("pos >= 1").select("contig", (F.col("pos") - 1).alias("pos0")).distinct(), bed).withColumn("inside", F.lit(True)).select("contig", (F.col("pos0") + 1).alias("pos"), "inside")
    return out.join(inside, ["contig", "pos"], "left").withColumn("skip_reason", reason.when(F.col("inside").isNull(), "outside_target_bed")).drop("inside", "row")


def miss_reasons(misses: DataFrame, contigs: Column, mutation_bed: DataFrame, target_bed: DataFrame) -> DataFrame:
    """misses with `reasons`: outside the simulated contigs, or any of outside the mutation and target BED, or unknown."""
    at = misses.select("contig", "pos").distinct().withColumn("pos0", F.col("pos") - 1)
    for name, bed in (("in_mutation", mutation_bed), ("in_target", target_bed)):
        found = points_in(at.select("contig", "pos0"), bed).withColumn(name, F.lit(True))
        at = at.join(found, ["contig", "pos0"], "left")
    tags = F.array_compact(F.array(F.when(F.col("in_mutation").isNull(), "outside_mutation_bed"), F.when(F.col("in_target").isNull(), "outside_target_bed")))
    tags = F.when(~contigs, F.array(F.lit("outside_simulated_contigs"))).when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("unknown")))
    return misses.join(at, ["contig", "pos"]).withColumn("reasons", tags).drop("pos0", "in_mutation", "in_target")


def input_filter(records: DataFrame) -> DataFrame:
    """records with `drop_reason` (null: kept) and `gt` in which a partial no-call is read as heterozygous."""
    calls = vcf.alleles(F.col("gt"))
    kind = vcf.variant_type(F.col("ref"), F.col("alt"))
    reason = (
        F.when(kind == "Complex", "complex")
        .when(F.col("alt") == F.col("ref"), "alt_is_ref")
        .when(F.forall(calls, lambda a: a == "."), "no_call")
        .when(F.forall(calls, lambda a: a.isin("0", ".")) & F.exists(calls, lambda a: a == "0"), "homozygous_ref")
    )
    partial = F.exists(calls, lambda a: a == ".") & F.exists(calls, lambda a: ~a.isin(".", "0"))
    return records.withColumn("drop_reason", reason).withColumn("gt", F.when(partial, "0/1").otherwise(F.col("gt")))


def merge_origins(tumor: DataFrame, normal: DataFrame) -> DataFrame:
    """tumor's records (origin somatic unless normal has the key, then shared) and normal's own (germline)."""
    keys = normal.select(*KEY).distinct().withColumn("in_normal", F.lit(True))
    t = tumor.join(keys, KEY, "left").withColumn("origin", F.when(F.col("in_normal"), "shared").otherwise("somatic")).drop("in_normal")
    return t.unionByName(normal.join(tumor.select(*KEY).distinct(), KEY, "left_anti").withColumn("origin", F.lit("germline")))


def known_positions(records: DataFrame) -> DataFrame:
    """(contig, pos): every reference position that a record covers, once."""
    last = F.col("pos") + F.greatest(F.length("ref"), F.lit(1)) - 1
    return records.select("contig", F.explode(F.sequence(F.col("pos"), last.cast("long"))).alias("pos")).distinct()


def average_rank(column: str) -> Column:
    """The rank of a value, ties sharing their mean rank. A window over all rows: for summaries, not for corpora."""
    everything = Window.partitionBy(F.lit(0)).orderBy(column)
    return F.rank().over(everything) + (F.count("*").over(Window.partitionBy(column)) - 1) / 2.0


def ranks_by_value(df: DataFrame, column: str) -> DataFrame:
    """(column, rank): average ranks from counts by value, dealt out by ranges of the value."""
    n = df.groupBy(column).agg(F.count("*").alias("n"))
    return ranged(n, column, "n", "before").select(column, (F.col("before") + (F.col("n") + 1) / 2.0).alias("rank"))


def fraction_metrics(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(n, pearson, spearman, mae, rmse, bias) of two columns; a correlation without variance or with n < 2 is null."""
    both = staged(pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b), "pairs")
    ranked = both.join(ranks_by_value(both, a).withColumnRenamed("rank", "rank_a"), a).join(ranks_by_value(both, b).withColumnRenamed("rank", "rank_b"), b)
    d = F.col(b) - F.col(a)

    def correlation(x: str, y: str) -> Column:
        flat = (F.count("*") < 2) | (F.stddev_pop(x) == 0) | (F.stddev_pop(y) == 0)
        return F.when(~flat, F.corr(x, y))

    return ranked.agg(F.count("*").alias("n"), correlation(a, b).alias("pearson"), correlation("rank_a", "rank_b").alias("spearman"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(d).alias("bias"))


def observed_fraction(truth: DataFrame, observed: DataFrame, depth: DataFrame, min_depth: int = 0) -> DataFrame:
    """truth (key, af) with `seen`: the observed af of its key; 0 where only the site has depth; else null."""
    site = depth.where(F.col("dp") > min_depth).select("contig", "pos").distinct().withColumn("covered", F.lit(True))
    out = truth.join(observed.select(*KEY, F.col("af").alias("seen")), KEY, "left").join(site, ["contig", "pos"], "left")
    return out.withColumn("seen", F.coalesce("seen", F.when(F.col("covered"), F.lit(0.0)))).drop("covered")


def deciles(pairs: DataFrame, planted: str, seen: str) -> DataFrame:
    """(bin, planted, scored, unscored, mae) by tenths of the planted fraction."""
    d = F.abs(F.col(seen) - F.col(planted))
    return pairs.groupBy(F.least(F.floor(F.col(planted) * 10), F.lit(9)).alias("bin")).agg(F.count("*").alias("planted"), F.count(seen).alias("scored"), (F.count("*") - F.count(seen)).alias("unscored"), F.avg(d).alias("mae"))


def naming_mismatch(bed: DataFrame, contigs: DataFrame, sample: int = 5) -> DataFrame:
    """(n_unmatched, sample): contigs of the BED that the reference doesn't have, and the first few in order."""
    gone = bed.select("contig").distinct().join(contigs.select("contig").distinct(), "contig", "left_anti")
    first = gone.orderBy("contig").limit(sample).agg(F.array_join(F.array_sort(F.collect_list("contig")), ",").alias("sample"))
    return gone.agg(F.count("*").alias("n_unmatched")).join(F.broadcast(first))


def gated(bins: DataFrame, most: float = 0.10) -> DataFrame:
    """deciles() as they are, or an error if more than `most` of the planted alleles went unscored: a mean error over the rest would
    be one over a part of them only."""
    total = bins.agg((F.sum("unscored") / F.sum("planted")).alias("share"))
    ok = F.when(F.coalesce("share", F.lit(0.0)) <= most, True).otherwise(F.raise_error(F.format_string("%.1f %% of the planted alleles went unscored", F.col("share") * 100)).cast("boolean"))
    return bins.join(F.broadcast(total.select(ok.alias("ok")))).where("ok").drop("ok")


def in_truth_order(merged: DataFrame, contigs: DataFrame) -> DataFrame:
    """merged records with `place` in their contig: by position, then as they came (seq_no). contigs: (contig, ord), in order of first sight."""
    placed = running(merged, ["contig"], "pos", {"place": ("sum", F.lit(1).cast("long"))}, ties=["seq_no"], before=True)
    return join_small(placed, contigs, ["contig"], "inner")


def first_at_position(records: DataFrame, order: list[str]) -> DataFrame:
    """The first record of each (contig, pos) by `order`. Aggregated before the shuffle, so a crowded position is no hot task."""
    rest = [c for c in records.columns if c not in ("contig", "pos", *order)]
    g = records.groupBy("contig", "pos").agg(F.min(F.struct(*order, *rest)).alias("r"))
    return g.select("contig", "pos", "r.*").select(records.columns)


def planted_inputs(germline: DataFrame, somatic: DataFrame, purity: float) -> DataFrame:
    """Both inputs' records (key, af) with their provenance; a somatic fraction is that of the tumor cells, so purity scales it."""
    g = germline.withColumn("provenance", F.lit("input"))
    return g.unionByName(somatic.withColumn("af", F.col("af") * purity).withColumn("provenance", F.lit("somatic_input")))


def breakend_pairs(records: DataFrame) -> DataFrame:
    """(low, high, first, n) of breakends (contig, pos, mate_contig, mate_pos, id): the two records of a junction name it from either end, so ends in order are one
    key. first: the least id, by which the pair is kept once; n: how many records name it. A record without a mate names nothing."""
    own, mate = F.struct("contig", F.col("pos").cast("long").alias("pos")), F.struct(F.col("mate_contig").alias("contig"), F.col("mate_pos").cast("long").alias("pos"))
    r = records.where("contig is not null and pos is not null and mate_contig is not null and mate_pos is not null")
    return r.groupBy(F.least(own, mate).alias("low"), F.greatest(own, mate).alias("high")).agg(F.min("id").alias("first"), F.count("*").alias("n"))
