"""Fitted models as tables: finalizing, writing and reading them, looking weights up, moving parts between models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Version of the tables that write_model() writes. A newer one is refused by read_model().
FORMAT_VERSION = 1


def write_model(parts: dict[str, DataFrame], path: str) -> None:
    """Each part is a table of its own under path, beside a stamp; an existing path is refused. Models are small."""
    spark = next(iter(parts.values())).sparkSession
    spark.createDataFrame([(FORMAT_VERSION, sorted(parts))], "format_version int, parts array<string>").coalesce(1).write.mode("errorifexists").json(f"{path}/stamp")
    for name, part in parts.items():
        part.coalesce(1).write.mode("errorifexists").parquet(f"{path}/{name}")


def read_model(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    stamp = spark.read.schema("format_version int, parts array<string>").json(f"{path}/stamp").first()
    if stamp is None or (stamp["format_version"] or 0) > FORMAT_VERSION:
        raise ValueError(f"{path}: no model, or one of a newer version")
    return {name: spark.read.parquet(f"{path}/{name}") for name in stamp["parts"]}


def grafted(base: dict[str, DataFrame], source: dict[str, DataFrame], part: str) -> dict[str, DataFrame]:
    """base with one part taken from source."""
    if part not in source:
        raise ValueError(f"the source has no {part}")
    return base | {part: source[part]}


def renormalized(part: DataFrame, value: str, by: list[str]) -> DataFrame:
    """part with `value` as shares of its total by group; a group without weight keeps zeros."""
    total = F.sum(value).over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0)))
    return part.withColumn(value, F.when(total > 0, F.col(value) / total).otherwise(F.lit(0.0)))


def variant_shares(mix: DataFrame) -> DataFrame:
    """(type, share) of exactly SNP, INS and DEL; anything else is an error."""
    kinds = mix.agg(F.count("*").alias("n"), F.sum(F.when(F.col("type").isin("SNP", "INS", "DEL"), 1).otherwise(0)).alias("known"), F.countDistinct("type").alias("kinds"))
    ok = F.when((F.col("n") == 3) & (F.col("known") == 3) & (F.col("kinds") == 3), True).otherwise(F.raise_error(F.lit("three variant probabilities: SNP, INS, DEL")).cast("boolean"))
    out = mix.join(F.broadcast(kinds.select(ok.alias("ok")))).where("ok").drop("ok")
    return renormalized(out.withColumn("share", F.col("n").cast("double")), "share", []).select("type", "share")


def with_defaults(fitted: DataFrame, default: DataFrame, by: str) -> DataFrame:
    """fitted (by, ...), and the default's rows of each kind of which nothing was observed."""
    return fitted.unionByName(default.join(fitted.select(by).distinct(), by, "left_anti"))


def folded_transitions(counts: DataFrame) -> DataFrame:
    """(context, from, to, share) of all 16 contexts XNZ and bases from (kmer, alt, n); a row that wasn't observed is a third each."""
    spark = counts.sparkSession
    bases = "ACGT"
    full = spark.createDataFrame([(f"{x}N{z}", a, b) for x in bases for z in bases for a in bases for b in bases if a != b], "context string, from string, to string")
    seen = counts.groupBy(F.concat(F.substring("kmer", 1, 1), F.lit("N"), F.substring("kmer", 3, 1)).alias("context"), F.substring("kmer", 2, 1).alias("from"), F.col("alt").alias("to")).agg(F.sum("n").alias("n"))
    full = full.join(seen, ["context", "from", "to"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy("context", "from"))
    return full.select("context", "from", "to", F.when(total > 0, F.col("n") / total).otherwise(F.lit(1 / 3)).alias("share"))


def options(*populations: DataFrame) -> DataFrame:
    """(score): the scores that any population of reads (scores) holds."""
    return reduce(DataFrame.union, (p.select(F.explode(F.array_distinct("scores")).alias("score")) for p in populations)).distinct()


def untrained(transitions: DataFrame, length: int) -> DataFrame:
    """(pos): the positions 1 to length of which no population row (pos, ...) was observed."""
    wanted = transitions.sparkSession.range(1, length + 1).withColumnRenamed("id", "pos")
    return wanted.join(transitions.select("pos").distinct(), "pos", "left_anti")


def trained_positions(transitions: DataFrame) -> DataFrame:
    """One row `n`: the positions from the first on that were observed, up to the first gap."""
    p = transitions.select(F.col("pos").cast("long").alias("pos")).distinct()
    return p.withColumn("place", F.row_number().over(Window.orderBy("pos"))).where("pos = place").agg(F.count("*").alias("n"))  # a row per position of a read


def finalized_qualities(transitions: DataFrame, scores: DataFrame) -> DataFrame:
    """(pos, prev, next, share): each observed position with all pairs of options; a prev never left is uniform."""
    domain = transitions.where("prev >= 0").select("pos").distinct().join(F.broadcast(scores.withColumnRenamed("score", "prev"))).join(F.broadcast(scores.withColumnRenamed("score", "next")))
    full = domain.join(transitions, ["pos", "prev", "next"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy("pos", "prev")
    total = F.sum("n").over(w)
    return full.select("pos", "prev", "next", F.when(total > 0, F.col("n") / total).otherwise(1 / F.count("*").over(w)).alias("share"))


def per_cycle_spectrum(counts: DataFrame, bases: DataFrame, least: int = 10_000) -> DataFrame:
    """(ref, read, weight) from counts (bin, ref, read, n) and bases (bin, n): neighbouring bins are joined from the first on until a group
    holds `least` errors, a rest goes to the last group; a group's rate counts once for each of its bins. Bins are a handful."""
    errors = bases.withColumnRenamed("n", "bases").join(counts.groupBy("bin").agg(F.sum("n").alias("errors")), "bin", "left")
    row = F.struct("bin", F.coalesce("errors", F.lit(0)).cast("long").alias("errors"), F.col("bases").cast("long").alias("bases"))
    start = F.struct(F.lit(0).alias("group"), F.lit(0).cast("long").alias("held"), F.array().cast("array<struct<bin:bigint,group:int,bases:bigint>>").alias("out"))

    def step(a: Column, b: Column) -> Column:
        full = a["held"] + b["errors"] >= least
        put = F.concat(a["out"], F.array(F.struct(b["bin"].cast("long").alias("bin"), a["group"].alias("group"), b["bases"].alias("bases"))))
        return F.struct((a["group"] + full.cast("int")).alias("group"), F.when(full, F.lit(0).cast("long")).otherwise(a["held"] + b["errors"]).alias("held"), put.alias("out"))

    g = errors.agg(F.aggregate(F.array_sort(F.collect_list(row)), start, step).alias("g"))
    g = g.select(F.explode("g.out").alias("x"), F.greatest(F.col("g.group") - 1, F.lit(0)).alias("last")).select("x.bin", "x.bases", F.least("x.group", "last").alias("group"))
    size = g.groupBy("group").agg(F.sum("bases").alias("bases"), F.count("*").alias("width"))
    c = counts.join(F.broadcast(g.select("bin", "group")), "bin").join(F.broadcast(size), "group").where("bases > 0")
    return c.groupBy("ref", "read").agg(F.sum(F.col("n") / F.col("bases") * F.col("width")).alias("weight"))


def fitted_overlaps(counts: DataFrame, least: int = 10_000) -> DataFrame:
    """(ref, read, share) from the disagreements (ref, read, n) of mates; fewer than `least` of them are refused."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    ok = F.when(F.col("total") >= least, True).otherwise(F.raise_error(F.concat(F.lit("too few disagreements: "), F.col("total").cast("string"))).cast("boolean"))
    from .fit import normalized_matrix

    return normalized_matrix(counts.join(F.broadcast(total.select(ok.alias("ok")))).where("ok").drop("ok"))


def weight_differences(cumulative: DataFrame, order: str = "place") -> DataFrame:
    """cumulative (place, cum) with `weight`, its growth at each place. The window is over a distribution's values."""
    return cumulative.withColumn("weight", F.col("cum") - F.coalesce(F.lag("cum").over(Window.orderBy(order)), F.lit(0.0)))


def is_uniform(weights: DataFrame, column: str = "weight", tolerance: float = 1e-9) -> DataFrame:
    """One row `uniform`: the weights differ by no more than the tolerance, relative to the greatest."""
    return weights.agg((F.max(column) - F.min(column) <= F.lit(tolerance) * F.max(F.abs(column))).alias("uniform"))


def gc_weight(windows: DataFrame, weights: DataFrame) -> DataFrame:
    """windows (gc share from 0 to 1, or null for none known) with `weight` of their percentage, from weights (gc 0..100, weight); what lies
    outside counts as the nearer end, and a window without known bases weighs 1."""
    at = F.least(F.greatest(F.round(F.col("share") * 100), F.lit(0)), F.lit(100)).cast("int")
    out = windows.withColumn("gc_at", at).join(F.broadcast(weights.select(F.col("gc").alias("gc_at"), "weight")), "gc_at", "left")
    return out.withColumn("weight", F.coalesce("weight", F.lit(1.0))).drop("gc_at")


def occupied(kind: Column, pos0: Column, span: Column, end: Column) -> Column:
    """struct<start, end>, 0-based half-open, of an existing structural variant whose anchor is pos0: the anchor itself for INS and BND, else
    the bases after it; null without any."""
    point = kind.isin("INS", "BND")
    start = F.least(F.when(point, pos0).otherwise(pos0 + 1), end)
    stop = F.least(pos0 + F.when(point, F.lit(1)).otherwise(span), end)
    return F.when((point | (span > 0)) & (start < stop), F.struct(start.alias("start"), stop.alias("end")))


def svtype_agrees(kind: Column, svtype: Column) -> Column:
    """Whether SVTYPE names the kind that ALT has; an unknown ALT agrees with anything."""
    return (kind == "UNKNOWN") | (F.upper(svtype) == kind)


#: Geometry of a breakend -> (joined after the base, the mate extends right).
GEOMETRIES = {"deletion_like": (True, True), "duplication_like": (False, False), "head_to_head": (True, False), "tail_to_tail": (False, True)}


def geometry(join_after: Column, mate_extends_right: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, (after, right) in GEOMETRIES.items():
        out = F.when((join_after == after) & (mate_extends_right == right), name).otherwise(out)
    return out


def geometry_flags(name: Column) -> Column:
    """struct<join_after, mate_extends_right> of a geometry's name."""
    table = F.create_map(*[x for n, (a, r) in GEOMETRIES.items() for x in (F.lit(n), F.struct(F.lit(a).alias("join_after"), F.lit(r).alias("mate_extends_right")))])
    return table[name]


def mutation_of_breakpoints(bedpe: DataFrame, shortest: int = 50) -> DataFrame:
    """(contig, pos, alt, info, kind) of breakpoint pairs (chrom1, start1, chrom2, start2, svclass): DEL, DUP and INV (of the two
    junctions of an inversion the head-to-head one) with their span, TRA as BND; other classes, spans over two contigs
    and short ones go."""
    c = F.col
    kind = F.when(c("svclass").isin("DEL", "DUP"), c("svclass")).when(c("svclass").isin("h2hINV", "INV"), "INV").when(c("svclass") == "TRA", "BND")
    r = bedpe.withColumn("kind", kind).where("kind is not null and start1 is not null and start2 is not null")
    pos = F.when(c("kind") == "BND", c("start1") + 1).otherwise(F.least("start1", "start2") + 1)
    end = F.greatest("start1", "start2")
    r = r.withColumn("pos", pos).withColumn("end", end).where((c("kind") == "BND") | ((c("chrom1") == c("chrom2")) & (c("end") - c("pos") + 1 >= shortest)))
    info = F.when(c("kind") == "BND", "SVTYPE=BND").otherwise(F.concat(F.lit("SVTYPE="), c("kind"), F.lit(";END="), c("end").cast("string")))
    return r.select(c("chrom1").alias("contig"), "pos", F.concat(F.lit("<"), c("kind"), F.lit(">")).alias("alt"), info.alias("info"), "kind")


def focal_copy_numbers(segments: DataFrame, neutral: DataFrame, shortest: int, longest: int) -> DataFrame:
    """segments (sample, contig, start, end, cn) of a length within the bounds whose copy number isn't their sample's neutral one: its
    rounded ploidy (sample, ploidy), 2 where none is given."""
    s = segments.join(neutral.select("sample", F.round("ploidy").cast("int").alias("neutral")), "sample", "left")
    n = F.col("end") - F.col("start")
    return s.where((n >= shortest) & (n <= longest) & (F.col("cn") != F.coalesce("neutral", F.lit(2)))).drop("neutral")
