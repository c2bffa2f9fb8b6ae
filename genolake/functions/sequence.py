"""Expressions over bases, CIGAR strings and quality strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(seq: Column) -> Column:
    """Upper case; anything but A, C, G, T is N."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "N")


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGTacgt", "TGCAtgca")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def resolve_ambiguity(base: Column, u: Column) -> Column:
    """A base for an IUPAC code, each of its bases equally likely under u in [0, 1)."""
    # The IUPAC nucleotide codes.
    codes = {"R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG"}
    bases = F.when(base.isin("A", "C", "G", "T"), base)
    for code, those in codes.items():
        bases = bases.when(base == code, F.lit(those))
    bases = bases.otherwise(F.lit("N"))
    return F.substr(bases, (F.floor(u * F.length(bases)) + 1).cast("int"), F.lit(1))


def count_of(seq: Column, chars: str) -> Column:
    return F.length(seq) - F.length(F.translate(seq, chars, ""))


def gc_percent(seq: Column) -> Column:
    """round(100 * GC / known bases); null if there is none."""
    known = count_of(seq, "ACGT")
    return F.when(known > 0, F.round(100 * count_of(seq, "GC") / known).cast("int"))


def alignable(seq: Column, most_unknown: float = 0.2) -> Column:
    return count_of(seq, "N") <= most_unknown * F.length(seq)


def cigar_ops(cigar: Column) -> Column:
    """array<struct<n, op>>"""
    return F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHP=X])"), 1), lambda x: F.struct(F.regexp_extract(x, r"\d+", 0).cast("int").alias("n"), F.substring(x, -1, 1).alias("op")))


def _span(cigar: Column, ops: str) -> Column:
    return F.aggregate(F.filter(cigar_ops(cigar), lambda o: o["op"].isin(*ops)), F.lit(0), lambda a, o: a + o["n"])


def reference_span(cigar: Column) -> Column:
    return _span(cigar, "MDN=X")


def query_length(cigar: Column) -> Column:
    return _span(cigar, "MIS=X")


def clip_lengths(cigar: Column) -> tuple[Column, Column]:
    """Soft-clipped bases at the left and right end."""
    size = lambda p: F.coalesce(F.nullif(F.regexp_extract(cigar, p, 1), F.lit("")).cast("int"), F.lit(0))
    return size(r"^(?:\d+H)?(\d+)S"), size(r"(\d+)S(?:\d+H)?$")


def run_lengths(ops: Column) -> Column:
    """A CIGAR string from an array of single operations."""
    step = lambda a, o: F.when((F.size(a) > 0) & (F.element_at(a, -1)["op"] == o), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct((F.element_at(a, -1)["n"] + 1).alias("n"), o.alias("op"))))).otherwise(F.concat(a, F.array(F.struct(F.lit(1).alias("n"), o.alias("op")))))
    runs = F.aggregate(ops, F.array().cast("array<struct<n:int,op:string>>"), step)
    return F.array_join(F.transform(runs, lambda r: F.concat(r["n"].cast("string"), r["op"])), "")


def phred_scores(quality: Column) -> Column:
    """array<int> from a Phred+33 string."""
    return F.transform(F.filter(F.split(quality, ""), lambda c: c != ""), lambda c: F.ascii(c) - 33)


def phred_string(scores: Column) -> Column:
    return F.array_join(F.transform(scores, lambda q: F.char(q + 33)), "")


def error_probability(q: Column) -> Column:
    return F.pow(F.lit(10.0), -q / 10)


def snap(q: Column, bins: list[int]) -> Column:
    """The nearest bin; ties go to the lower."""
    return F.array_min(F.transform(F.array(*[F.lit(b) for b in bins]), lambda b: F.struct(F.abs(b - q).alias("d"), b.alias("b"))))["b"]


def general(x: Column, digits: int = 6) -> Column:
    """A number with so many significant digits and no trailing zeros; with an exponent of two digits if that is under -4 or not under `digits`. (The form
    of %g in C.)"""
    e = F.format_string(f"%.{digits - 1}e", x)
    power = F.split_part(e, F.lit("e"), F.lit(2)).try_cast("int")
    bare = lambda s: F.when(s.contains("."), F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)
    out = F.concat(bare(F.split_part(e, F.lit("e"), F.lit(1))), F.lit("e"), F.split_part(e, F.lit("e"), F.lit(2)))
    for k in range(-4, digits):
        out = F.when(power == k, bare(F.format_string(f"%.{digits - 1 - k}f", x))).otherwise(out)
    return F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").when(x.isNotNull(), out)
