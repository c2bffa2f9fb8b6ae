"""Aligned reads: filters by flag, blocks and coverage from CIGARs, mates and what both of them read, filters by BED."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import cigar_ops
from ..sources.text import fragment_of_name
from .intervals import depth, overlaps, points_in, touching
from .kernel import reference_bases

# The flag bits of SAM.
PAIRED, UNMAPPED, MATE_UNMAPPED, FIRST, SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 0x1, 0x4, 0x8, 0x40, 0x100, 0x200, 0x400, 0x800


def has(flag: Column, bits: int) -> Column:
    return flag.bitwiseAND(F.lit(bits)) != 0


def countable(flag: Column) -> Column:
    """Mapped, primary and not supplementary."""
    return ~has(flag, UNMAPPED | SECONDARY | SUPPLEMENTARY)


def usable(flag: Column, mapq: Column, same_contig: Column, purpose: str, min_mapq: int = 10) -> Column:
    """Whether a record counts. length: a template's first mate, both mapped to one contig; overlap: either mate, no duplicates or failed
    ones; coverage: any countable record. A min_mapq of 0 asks for none; else mapq must exceed it."""
    if purpose == "coverage":
        return countable(flag)
    mates = countable(flag) & has(flag, PAIRED) & ~has(flag, MATE_UNMAPPED) & same_contig
    if min_mapq:
        mates = mates & (mapq > min_mapq)
    return mates & (has(flag, FIRST) if purpose == "length" else ~has(flag, DUPLICATE | QC_FAIL))


def template_lengths(sam: DataFrame, min_mapq: int = 10) -> DataFrame:
    """(len, n) of the positive template lengths of records (flag, mapq, contig, mate_contig, tlen) that count."""
    same = (F.col("mate_contig") == "=") | (F.col("mate_contig") == F.col("contig"))
    t = sam.where(usable(F.col("flag"), F.col("mapq"), same, "length", min_mapq)).where("tlen > 0")
    return t.groupBy(F.col("tlen").cast("long").alias("len")).agg(F.count("*").alias("n"))


def in_band(column: Column, low: int, high: int) -> Column:
    """Within low and high, both included."""
    if low > high:
        raise ValueError("an empty band")
    return column.between(low, high)


def blocks(cigar: Column, position: Column) -> Column:
    """array<struct<start, end, at>>: the aligned stretches (M, =, X) of a read on the reference, and where each begins in the read."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint,at:bigint>>")
    n = lambda o: o["n"].cast("long")
    here = lambda a, o: F.array(F.struct(a["pos"].alias("start"), (a["pos"] + n(o)).alias("end"), a["at"].alias("at")))
    step = lambda a, o: F.struct(
        (a["pos"] + F.when(o["op"].isin(*"MDN=X"), n(o)).otherwise(F.lit(0).cast("long"))).alias("pos"),
        (a["at"] + F.when(o["op"].isin(*"MIS=X"), n(o)).otherwise(F.lit(0).cast("long"))).alias("at"),
        F.when(o["op"].isin(*"M=X"), F.concat(a["blocks"], here(a, o))).otherwise(a["blocks"]).alias("blocks"),
    )
    return F.aggregate(cigar_ops(cigar), F.struct(position.cast("long").alias("pos"), F.lit(0).cast("long").alias("at"), empty.alias("blocks")), step)["blocks"]


def coverage(reads: DataFrame) -> DataFrame:
    """(contig, start, end, depth) of reads (contig, pos0, cigar): aligned bases count, deletions and skips don't."""
    b = reads.select("contig", F.explode(blocks(F.col("cigar"), F.col("pos0"))).alias("b"))
    return depth(b.select("contig", "b.start", "b.end"))


def mates(reads: DataFrame, keep: list[str]) -> DataFrame:
    """(contig, name, a, b): the first and the second mate (structs of `keep`) of names of which a contig has one of each. One shuffle."""
    record = F.struct(*keep)
    of = lambda first: F.when(F.col("first") == first, record)
    g = reads.groupBy("contig", "name").agg(F.max(of(True)).alias("a"), F.max(of(False)).alias("b"), F.count("*").alias("n"))
    return g.where("n = 2 and a is not null and b is not null").drop("n")


def mate_overlaps(pairs: DataFrame, contigs: DataFrame, bins: int = 5, most: int = 1000) -> DataFrame:
    """(contig, pos0, bin_a, bin_b, base_a, base_b, frame): a row for each reference base that both mates (structs of pos0, cigar, seq, reverse) align, with
    the contig's base there. bin: the cycle at which a mate read it, in `bins` parts of its read; a reverse read's first cycle is its last base.

    Stretches that both align are cut out of both reads and of the contig before they become bases, so that no base's row carries a read. A
    stretch of more than `most` bases is refused."""
    side = lambda s: blocks(F.col(f"{s}.cigar"), F.col(f"{s}.pos0"))
    p = pairs.withColumn("x", side("a")).withColumn("y", side("b")).withColumn("u", F.explode("x")).withColumn("v", F.explode("y"))
    lo, hi = F.greatest("u.start", "v.start"), F.least("u.end", "v.end")
    p = p.withColumn("lo", lo).withColumn("n", (hi - lo).cast("int")).where("n > 0")
    p = p.withColumn("n", F.when(F.col("n") <= most, F.col("n")).otherwise(F.raise_error(F.lit(f"mates share more than {most} bases in a row")).cast("int")))
    at = lambda block: (F.col(f"{block}.at") + F.col("lo") - F.col(f"{block}.start")).cast("int")
    piece = lambda s, block: F.struct(F.substr(F.col(f"{s}.seq"), at(block) + 1, F.col("n")).alias("bases"), at(block).alias("at"), F.length(f"{s}.seq").alias("long"), F.coalesce(F.col(f"{s}.reverse"), F.lit(False)).alias("reverse"))
    p = reference_bases(p.select("contig", "lo", "n", piece("a", "u").alias("a"), piece("b", "v").alias("b")), contigs, "lo", "n", most)

    def cycle(s: str, i: Column) -> Column:
        place = F.col(f"{s}.at") + i
        return F.floor(F.when(F.col(f"{s}.reverse"), F.col(f"{s}.long") - 1 - place).otherwise(place) * bins / F.col(f"{s}.long"))

    base = lambda c, i: F.substr(F.col(c), i + 1, F.lit(1))
    row = lambda i: F.struct((F.col("lo") + i).alias("pos0"), cycle("a", i).alias("bin_a"), cycle("b", i).alias("bin_b"), base("a.bases", i).alias("base_a"), base("b.bases", i).alias("base_b"), base("bases", i).alias("frame"))
    return p.select("contig", F.inline(F.transform(F.sequence(F.lit(0), F.col("n") - 1), row)))


def masked(bases: DataFrame, known: DataFrame, position: str = "pos0") -> DataFrame:
    """bases with `masked`: whether their place is a known site (contig, position)."""
    sites = known.select("contig", position).distinct().withColumn("masked", F.lit(True))
    return bases.join(sites, ["contig", position], "left").withColumn("masked", F.coalesce("masked", F.lit(False)))


def in_bed(names: DataFrame, bed: DataFrame, contig: Column) -> DataFrame:
    """FASTQ records (name, ...) whose name's fragment overlaps an interval of the BED, each once; a name without a fragment, or with an
    empty one, goes."""
    part = fragment_of_name(F.col("name"))
    # as rows of a generator, so that a name is parsed once and not at each use
    f = names.select(F.struct(*names.columns).alias("_record"), F.inline(F.array(F.struct(contig.alias("contig"), part["start"].alias("_start"), part["end"].alias("_end")))))
    return touching(f.where("_start < _end"), bed, F.col("_start"), F.col("_end") - 1).select("_record.*")


def vcf_lines_in_bed(lines: DataFrame, bed: DataFrame) -> DataFrame:
    """VCF lines (text, ...): all header lines, and the records whose position lies in the BED."""
    c = F.split("text", "\t")
    records = lines.where(~F.col("text").startswith("#")).withColumn("contig", F.get(c, F.lit(0))).withColumn("pos0", F.get(c, F.lit(1)).try_cast("long") - 1)
    kept = points_in(records.where("pos0 >= 0"), bed).select(lines.columns)
    return lines.where(F.col("text").startswith("#")).unionByName(kept)


def region_measures(reads: DataFrame, regions: DataFrame, max_tlen: int = 2000) -> DataFrame:
    """(region, n, clip_rate, mapq0_rate, improper_rate, mean_insert) of regions (region, contig, start, end): each record counts in the
    regions that hold its start."""
    r = reads.withColumn("start", F.col("pos0")).withColumn("end", F.col("pos0") + 1)
    hit = overlaps(r, regions)
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    proper = F.col("paired") & F.col("mate_mapped") & F.col("same_ref")
    insert = F.abs("tlen")
    return hit.groupBy(F.col("r_region").alias("region")).agg(F.count("*").alias("n"), share(F.col("left_clip") > 0).alias("clip_rate"), share(F.col("mapq") == 0).alias("mapq0_rate"), share(~proper).alias("improper_rate"), F.avg(F.when(proper & (insert > 0) & (insert <= max_tlen), insert)).alias("mean_insert"))
