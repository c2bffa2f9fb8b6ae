"""A corpus of structural variants from call sets: breakpoint pairs, copy-number segments and insertions as symbolic VCF records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import staged
from .models import focal_copy_numbers, mutation_of_breakpoints
from .scan import running

RECORD = ["contig", "pos", "alt", "info", "gt"]
_END = ["sample", "chrom1", "lo", "hi"]


def contig_name(name: Column, prefix: str = "chr") -> Column:
    """A contig's name with the prefix, once."""
    bare = F.regexp_replace(name, "(?i)^chr", "")
    return F.concat(F.lit(prefix), bare)


def contig_order(contig: Column) -> Column:
    """Numbers first, by value, then X, Y and M, then the others."""
    bare = F.regexp_replace(contig, "^chr", "")
    return F.when(bare == "X", 100).when(bare == "Y", 101).when(bare == "M", 102).otherwise(F.coalesce(F.when(bare.rlike("^[0-9]+$"), bare.try_cast("int")), F.lit(200)))


def chosen_samples(samples: DataFrame, projects: list[str]) -> DataFrame:
    """(sample) of samples (sample, project) whose project begins with one of the names; no name chooses all."""
    starts = F.lit(not projects)
    for p in projects:
        starts = starts | F.col("project").startswith(p)
    return samples.where(starts).select("sample").distinct()


def reciprocal(junctions: DataFrame, tolerance: int = 500) -> DataFrame:
    """junctions (sample, chrom1, start1, chrom2, start2, svclass) with the two of an inversion made one: head-to-head and tail-to-tail junctions of a sample
    and contig, whose ends are both at most `tolerance` apart, each the nearest of the other by the sum of both distances (ties: the lower lo, then hi).
    Such a pair is one INV from the least to the greatest end; `paired` says so. All other rows stay as they are, a lone tail-to-tail junction too.

    Ends meet in bins of the tolerance, those of one side under the neighbours too. Equal junctions of a sample count as one place for
    the pairing, and the first of them is paired; nulls and spans over two contigs pair with nothing."""
    j = staged(junctions.withColumn("_row", F.monotonically_increasing_id()), "junctions")
    spans = j.where("chrom1 = chrom2 and sample is not null").withColumn("lo", F.least("start1", "start2")).withColumn("hi", F.greatest("start1", "start2")).where("start1 is not null and start2 is not null")
    one = lambda k: spans.where(F.col("svclass") == k).groupBy(*_END).agg(F.min("_row").alias("_row"))
    width = max(tolerance, 1)
    a = one("h2hINV").withColumn("bin", F.floor(F.col("lo") / width))
    b = one("t2tINV").withColumnsRenamed({"lo": "r_lo", "hi": "r_hi", "_row": "r_row"}).withColumn("bin", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda s: F.floor(F.col("r_lo") / width) + s)))
    first, second = F.abs(F.col("lo") - F.col("r_lo")), F.abs(F.col("hi") - F.col("r_hi"))
    pairs = a.join(b, ["sample", "chrom1", "bin"]).where((first <= tolerance) & (second <= tolerance)).withColumn("far", first + second)
    nearest = pairs.groupBy("_row").agg(F.min_by("r_row", F.struct("far", "r_lo", "r_hi")).alias("r_row"))
    back = pairs.groupBy("r_row").agg(F.min_by("_row", F.struct("far", "lo", "hi")).alias("_row"))
    met = pairs.join(nearest.join(back, ["_row", "r_row"]), ["_row", "r_row"], "left_semi")
    events = met.select("_row", F.least("lo", "r_lo").alias("_lo"), F.greatest("hi", "r_hi").alias("_hi"))
    gone = met.select(F.col("r_row").alias("_row"))
    out = j.join(gone, "_row", "left_anti").join(events, "_row", "left").withColumn("paired", F.col("_lo").isNotNull())
    is_event = F.col("paired")
    out = out.withColumn("start1", F.when(is_event, F.col("_lo")).otherwise(F.col("start1"))).withColumn("start2", F.when(is_event, F.col("_hi")).otherwise(F.col("start2"))).withColumn("svclass", F.when(is_event, "INV").otherwise(F.col("svclass")))
    return out.drop("_row", "_lo", "_hi")


def insertions(records: DataFrame, shortest: int = 50) -> DataFrame:
    """(contig, pos, alt, info, gt) of VCF records (contig, pos, info) of type INS with a length of `shortest` bases or more."""
    tag = lambda k: F.nullif(F.regexp_extract("info", rf"(?:^|;){k}=(-?[^;]+)", 1), F.lit(""))
    r = records.where(tag("SVTYPE") == "INS").withColumn("_n", F.abs(tag("SVLEN").try_cast("long"))).where(F.col("_n") >= shortest)
    return r.select("contig", F.col("pos").cast("long").alias("pos"), F.lit("<INS>").alias("alt"), F.concat(F.lit("SVTYPE=INS;SVLEN="), F.col("_n").cast("string")).alias("info"), F.lit("0/1").alias("gt"))


def corpus(junctions: DataFrame, segments: DataFrame, ploidy: DataFrame, inserted: DataFrame, samples: DataFrame, projects: list[str] = (), prefix: str = "chr", shortest: int = 50, longest: int = 3_000_000, tolerance: int = 500) -> DataFrame:
    """(place, contig, pos, alt, info, gt), place counting from 0 in each contig by position: the records of the chosen samples' junctions, paired first,
    and focal segments (sample, contig, start, end, cn), whose copy number is not their sample's neutral one, and of insertions (contig, pos, info), which
    have no sample. A copy number of 0 is homozygous. A paired inversion has EVENTS=2 in its INFO."""
    wanted = F.broadcast(chosen_samples(samples, list(projects)))
    j = reciprocal(junctions.join(wanted, "sample", "left_semi"), tolerance).withColumn("chrom1", contig_name(F.col("chrom1"), prefix)).withColumn("chrom2", contig_name(F.col("chrom2"), prefix))
    rows = [mutation_of_breakpoints(j.where(F.col("paired") == p), shortest).withColumn("info", F.concat("info", F.lit(";EVENTS=2" if p else ""))).withColumn("gt", F.lit("0/1")) for p in (True, False)]
    s = focal_copy_numbers(segments.join(wanted, "sample", "left_semi"), ploidy, shortest, longest)
    info = F.concat(F.lit("SVTYPE=CNV;END="), F.col("end").cast("string"), F.lit(";CN="), F.col("cn").cast("string"))
    rows.append(s.select(contig_name(F.col("contig"), prefix).alias("contig"), (F.col("start") + 1).alias("pos"), F.lit("<CNV>").alias("alt"), info.alias("info"), F.when(F.col("cn") == 0, "1/1").otherwise("0/1").alias("gt")))
    rows.append(insertions(inserted.withColumn("contig", contig_name(F.col("contig"), prefix)), shortest))
    out = None
    for r in rows:
        r = r.select("contig", F.col("pos").cast("long").alias("pos"), "alt", "info", "gt")
        out = r if out is None else out.unionByName(r)
    return running(out, ["contig"], "pos", {"place": ("sum", F.lit(1).cast("long"))}, ties=["alt", "info", "gt"], before=True)
