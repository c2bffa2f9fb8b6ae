"""Expressions over the fields of variant records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(alt: Column) -> Column:
    return alt.rlike("^[ACGTNacgtn]+$")


def variant_type(ref: Column, alt: Column) -> Column:
    """SNP, INS, DEL, Complex, or SV for a symbolic ALT."""
    r, a = F.length(ref), F.length(alt)
    return F.when(~literal(alt), "SV").when((r == 1) & (a == 1), "SNP").when((r == 1) & (a > 1), "INS").when((r > 1) & (a == 1), "DEL").otherwise("Complex")


def sv_type(alt: Column) -> Column:
    """The kind of a symbolic ALT, BND for a breakend, else UNKNOWN."""
    kind = F.regexp_extract(F.upper(alt), "^<(DEL|DUP|CNV|INS|INV)(?::[^>]*)?>$", 1)
    return F.when(kind != "", kind).when(alt.rlike(r"[\[\]]"), "BND").otherwise("UNKNOWN")


def breakend(alt: Column) -> Column:
    """struct(mate_contig, mate_pos, join_after, mate_extends_right, inserted) of a breakend ALT; null if it is none.

    t[p[ : joined after t, the mate extends right of p; t]p] : joined after t, the mate extends left;
    ]p]t : joined before t, the mate extends left; [p[t : joined before t, the mate extends right."""
    pattern = r"^([ACGTNacgtn.]*)([\[\]])([^:\[\]]+):(\d+)[\[\]]([ACGTNacgtn.]*)$"
    part = lambda i: F.regexp_extract(alt, pattern, i)
    after = part(1) != ""
    bases = F.upper(F.concat(part(1), part(5)))
    inserted = F.when(after, F.substr(bases, F.lit(2))).otherwise(F.substr(bases, F.lit(1), F.greatest(F.length(bases) - 1, F.lit(0))))
    return F.when(alt.rlike(pattern), F.struct(part(3).alias("mate_contig"), part(4).cast("long").alias("mate_pos"), after.alias("join_after"), (part(2) == "[").alias("mate_extends_right"), inserted.alias("inserted")))


def info_value(info: Column, key: str) -> Column:
    """The value of a key in INFO, the first if it is repeated; null if it is absent or a bare flag."""
    found = F.regexp_extract(info, rf"(?:^|;){key}=([^;]*)", 1)
    return F.when(found != "", found)


def sv_span(pos: Column, info: Column) -> Column:
    """END - POS + 1, else |SVLEN|; an END before POS is ignored."""
    end = info_value(info, "END").try_cast("long")
    return F.when(end >= pos, end - pos + 1).otherwise(F.abs(info_value(info, "SVLEN").try_cast("long")))


def alleles(genotype: Column) -> Column:
    return F.split(genotype, r"[/|]")


def homozygous(genotype: Column) -> Column:
    """Heterozygous if a called allele is 0, homozygous otherwise; no-calls count for nothing."""
    return ~F.exists(alleles(genotype), lambda a: a == "0")


def dosage(genotype: Column) -> Column:
    """Alternate copies / called copies; null without a call."""
    called = F.filter(alleles(genotype), lambda a: a != ".")
    return F.when(F.size(called) > 0, F.size(F.filter(called, lambda a: a != "0")) / F.size(called))


def genotype_string(homozygous: Column, ploidy: int) -> Column:
    """All copies for a homozygous variant, half of them (rounded down, one at least) for a heterozygous one."""
    half = max(1, ploidy // 2)
    return F.when(homozygous, "/".join(["1"] * ploidy)).otherwise("/".join(["1"] * half + ["0"] * (ploidy - half)))


def allele_fractions(format: Column, sample: Column, info: Column, n_alts: Column) -> Column:
    """Fractions by ALT: FORMAT/AF, else INFO/AF, else FORMAT/AD; an arity that doesn't match the ALTs is none at all."""
    at = lambda key: F.get(F.split(sample, ":"), (F.array_position(F.split(format, ":"), key) - 1).cast("int"))
    present = lambda key: F.when(F.array_position(F.split(format, ":"), key) > 0, at(key))
    numbers = lambda text: F.transform(F.split(text, ","), lambda x: x.try_cast("double"))
    whole = lambda values, n: F.when((F.size(values) == n) & ~F.exists(values, lambda v: v.isNull()), values)
    depth = whole(numbers(present("AD")), n_alts + 1)
    total = F.aggregate(depth, F.lit(0.0), lambda a, x: a + x)
    by_depth = F.when(total > 0, F.transform(F.slice(depth, F.lit(2), n_alts), lambda x: x / total))
    return F.coalesce(whole(numbers(present("AF")), n_alts), whole(numbers(info_value(info, "AF")), n_alts), by_depth)


def site_depth(format: Column, sample: Column) -> Column:
    """The sum of FORMAT/AD; null without one, or if any part of it is no number."""
    at = F.array_position(F.split(format, ":"), F.lit("AD"))
    parts = F.transform(F.split(F.when(at > 0, F.get(F.split(sample, ":"), (at - 1).cast("int"))), ","), lambda x: x.try_cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


def renamed_tags(info: Column, names: dict[str, str]) -> Column:
    """INFO with tags renamed; their values and order stay."""
    out = info
    for old, new in names.items():
        out = F.regexp_replace(out, rf"(^|;){old}(=|;|$)", f"$1{new}$2")
    return out
