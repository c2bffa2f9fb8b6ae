"""Mismatches of reads by their MD tags, without looking at the reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import cigar_ops
from .reads import blocks, masked


def md_changes(md: Column) -> Column:
    """struct(at, off): how many aligned bases a MD tag tells of, and array<struct<at, ref>> of the mismatches among them. A deletion's bases
    are passed over."""
    tokens = F.regexp_extract_all(md, F.lit(r"(\d+|\^[A-Za-z]+|[A-Za-z])"), 1)
    none = F.array().cast("array<struct<at:int,ref:string>>")

    def walk(a: Column, t: Column) -> Column:
        step = F.when(t.rlike("^[0-9]"), t.try_cast("int")).when(t.startswith("^"), 0).otherwise(1)
        off = F.when(t.rlike("^[A-Za-z]"), F.concat(a["off"], F.array(F.struct(a["at"].alias("at"), t.alias("ref"))))).otherwise(a["off"])
        return F.struct((a["at"] + step).alias("at"), off.alias("off"))

    return F.aggregate(tokens, F.struct(F.lit(0).alias("at"), none.alias("off")), walk)


def md_bases(reads: DataFrame) -> DataFrame:
    """(ref, read, n) of the aligned bases of reads (seq, cigar, md) whose MD tag fits; others count as ref STALE."""
    step = lambda a, o: F.struct(F.when(o["op"].isin("M", "=", "X"), F.concat(a["bases"], F.substr("seq", a["at"] + 1, o["n"]))).otherwise(a["bases"]).alias("bases"), (a["at"] + F.when(o["op"].isin("M", "I", "S", "=", "X"), o["n"]).otherwise(0)).alias("at"))
    aligned = F.aggregate(cigar_ops(F.col("cigar")), F.struct(F.lit("").alias("bases"), F.lit(0).alias("at")), step)["bases"]
    r = reads.select("seq", "cigar", "md").withColumn("aligned", aligned).withColumn("w", md_changes(F.col("md")))
    off = F.transform("w.off", lambda x: F.struct(x["ref"].alias("ref"), F.substr("aligned", x["at"] + 1, F.lit(1)).alias("read"), F.lit(1).cast("long").alias("n")))
    changed = lambda b: F.size(F.filter(off, lambda x: x["read"] == b))
    same = F.array(*[F.struct(F.lit(b).alias("ref"), F.lit(b).alias("read"), (F.length("aligned") - F.length(F.replace("aligned", F.lit(b), F.lit(""))) - changed(b)).cast("long").alias("n")) for b in "ACGTN"])
    stale = F.array(F.struct(F.lit("STALE").alias("ref"), F.lit("").alias("read"), F.lit(1).cast("long").alias("n")))
    counts = F.when(F.col("w.at") == F.length("aligned"), F.concat(same, off)).otherwise(stale)
    return r.select(F.explode(counts).alias("x")).where("x.n > 0").groupBy("x.ref", "x.read").agg(F.sum("x.n").alias("n"))


def md_report(reads: DataFrame, known: DataFrame) -> DataFrame:
    """(ref, read, n, masked, stale): mismatches of known bases by the MD tags of reads (contig, pos0, cigar, seq, md): those that count, those at a
    known site (contig, pos0), and those that the read contradicts, as it holds the reference's base there (a tag older than the read).
    Reads without a tag, and mismatches beyond the aligned bases, say nothing.

    A mismatch is a row, a matching base is none. Its number among the aligned bases is carried through the read's blocks to its place in
    the read and on the contig."""
    r = reads.where("md is not null and contig is not null").select("contig", "seq", blocks(F.col("cigar"), F.col("pos0")).alias("blocks"), md_changes(F.col("md"))["off"].alias("off"))
    r = r.where(F.size("off") > 0).select("contig", "seq", "blocks", F.inline("off"))
    start = F.struct(F.col("at").cast("long").alias("left"), F.lit(None).cast("long").alias("pos0"), F.lit(None).cast("long").alias("place"))

    def carry(a: Column, b: Column) -> Column:
        long = b["end"] - b["start"]
        here = a["pos0"].isNull() & (a["left"] < long)
        return F.struct(
            F.when(here | a["pos0"].isNotNull(), a["left"]).otherwise(a["left"] - long).alias("left"),
            F.when(here, b["start"] + a["left"]).otherwise(a["pos0"]).alias("pos0"),
            F.when(here, b["at"] + a["left"]).otherwise(a["place"]).alias("place"),
        )

    at = F.aggregate("blocks", start, carry)
    r = r.select("contig", F.upper("ref").alias("ref"), "seq", at.alias("x")).where("x.pos0 is not null")
    r = r.select("contig", "x.pos0", "ref", F.upper(F.substr("seq", (F.col("x.place") + 1).cast("int"), F.lit(1))).alias("read")).where(F.col("ref").isin(*"ACGT") & F.col("read").isin(*"ACGT"))
    same, hidden = F.col("ref") == F.col("read"), F.col("masked")
    return masked(r, known).groupBy("ref", "read").agg(F.count_if(~same & ~hidden).alias("n"), F.count_if(~same & hidden).alias("masked"), F.count_if(same).alias("stale"))
