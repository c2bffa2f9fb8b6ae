"""Generators: variants, fragments, allele draws, haplotypes, reads, qualities, chimeric pieces.

Every draw is a keyed uniform, so a row's result depends on its key and the seed alone."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keyed import key_hash, pick, uniform
from ..functions.sequence import reverse_complement
from ..staging import ship
from .mismatches import md_bases as md_bases  # callers look for it here too
from .scan import running


def _in_cdf(draws: DataFrame, segments: DataFrame, mass: Column) -> DataFrame:
    """draws (contig, u, ...) with the columns of the segment (contig, start, ...) in which u * total mass falls, and lo, hi, x. A
    contig's mass is cut into as many bins as it has segments, and segments are filed under the bins they touch: two each on
    average, however many draws there are."""
    w, all_ = Window.partitionBy("contig").orderBy("start"), Window.partitionBy("contig")
    cdf = segments.withColumn("hi", F.sum(mass).over(w)).withColumn("lo", F.col("hi") - mass).withColumn("total", F.max("hi").over(all_)).withColumn("m", F.count("*").over(all_)).where("hi > lo")
    at = lambda x: F.least(F.floor(x * F.col("m") / F.col("total")), F.col("m"))
    filed = cdf.withColumn("bin", F.explode(F.sequence(at(F.col("lo")), at(F.col("hi"))))).drop("total", "m")
    size = cdf.groupBy("contig").agg(F.max("total").alias("total"), F.max("m").alias("m"))
    d = draws.join(size, "contig").withColumn("x", F.col("u") * F.col("total")).withColumn("bin", at(F.col("x"))).drop("total", "m")
    return d.join(filed, ["contig", "bin"]).where("x >= lo and x < hi").drop("bin")


def place_variants(segments: DataFrame, seed: int) -> DataFrame:
    """(contig, k, pos0): trunc(sum of length * value) positions a contig over its segments (contig, start, end, value; disjoint),
    each in proportion to the value."""
    mass = (F.col("end") - F.col("start")) * F.col("value")
    usable = segments.where("value > 0")
    total = usable.groupBy("contig").agg(F.sum(mass).alias("total")).where("total >= 1")
    draws = total.select("contig", F.explode(F.sequence(F.lit(1).cast("long"), F.col("total").cast("long"))).alias("k"))
    draws = draws.withColumn("u", uniform(seed, "place", F.concat_ws(":", F.col("contig"), F.col("k").cast("string"))))
    hit = _in_cdf(draws, usable, mass)
    return hit.select("contig", "k", F.least(F.col("start") + F.floor((F.col("x") - F.col("lo")) / F.col("value")), F.col("end") - 1).alias("pos0"))


def place_fragments_by_gc(windows: DataFrame, lengths: DataFrame, size: int, coverage: float, read_len: int, paired: bool, seed: int, most: float = 100.0) -> DataFrame:
    """(contig, k, start, end): starts in proportion to the windows' weights (contig, start, weight; `size` bases each). The number of
    draws a contig (contig, length) grows by 1 / mean weight, `most` times at most; fragments are `size` long."""
    mean = windows.groupBy("contig").agg(F.avg("weight").alias("mean")).where("mean > 0")
    n = F.ceil(F.col("length") * F.lit(coverage) / F.lit(read_len * (2 if paired else 1)) * F.least(1 / F.col("mean"), F.lit(most)))
    d = lengths.join(mean, "contig").select("contig", "length", F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("k"))
    key = F.concat_ws(":", F.col("contig"), F.col("k").cast("string"))
    hit = _in_cdf(d.withColumn("u", uniform(seed, "gc", key)), windows, F.col("weight"))
    start = F.col("start") + F.floor((F.col("x") - F.col("lo")) / F.col("weight") * size)
    return hit.select("contig", "k", start.alias("start"), (start + size).alias("end"), "length").where("end <= length").drop("length")


def read_through(fragment: Column, adapter: str, read_len: int) -> tuple[Column, Column]:
    """(bases, cigar) of a read of a fragment: past its end the adapter is read, then A; those bases are soft-clipped."""
    bases = F.rpad(F.concat(fragment, F.lit(adapter)), read_len, "A")
    n = F.least(F.length(fragment), F.lit(read_len))
    cigar = F.concat(n.cast("string"), F.lit("M"), F.when(n < read_len, F.concat((F.lit(read_len) - n).cast("string"), F.lit("S"))).otherwise(""))
    return bases, cigar


def haplotype_sequence(seq: Column, start: Column, variants: Column) -> Column:
    """seq, which begins at `start`, with variants (array<struct<pos0, ref, alt>>) put in: those wholly inside, one after another from
    the right, so that no change moves the ones still to come. Of variants that overlap the left ones are left out."""
    inside = F.filter(variants, lambda v: (v["pos0"] >= start) & (v["pos0"] + F.length(v["ref"]) <= start + F.length(seq)))
    ordered = F.reverse(F.array_sort(inside))

    def put(a: Column, v: Column) -> Column:
        at = (v["pos0"] - start).cast("int")
        changed = F.concat(F.substr(a["seq"], F.lit(1), at), v["alt"], F.substr(a["seq"], at + F.length(v["ref"]) + 1))
        fits = at + F.length(v["ref"]) <= a["limit"]
        return F.struct(F.when(fits, changed).otherwise(a["seq"]).alias("seq"), F.when(fits, at).otherwise(a["limit"]).alias("limit"))

    return F.aggregate(ordered, F.struct(seq.alias("seq"), F.length(seq).alias("limit")), put)["seq"]


def carried(fragments: DataFrame, variants: DataFrame, width: int = 256) -> DataFrame:
    """fragments (id, contig, start, end) with `carried`: the variants (contig, pos0, ref, alt) that lie in them."""
    from .intervals import overlaps

    v = variants.select("contig", F.col("pos0").alias("start"), (F.col("pos0") + F.length("ref")).alias("end"), "ref", "alt")
    hit = overlaps(fragments, v, width).groupBy("id").agg(F.collect_set(F.struct(F.col("r_start").alias("pos0"), F.col("r_ref").alias("ref"), F.col("r_alt").alias("alt"))).alias("carried"))
    return fragments.join(hit, "id", "left").withColumn("carried", F.coalesce("carried", F.array().cast(hit.schema["carried"].dataType)))


def reciprocal_breakends(draws: DataFrame) -> DataFrame:
    """(contig, pos, alt, pair) of translocations (pair, contig_a, pos_a, contig_b, pos_b, base_a, base_b; 1-based): each is a pair
    of mates that name each other."""
    mate = lambda c, p: F.concat(F.lit("["), F.col(c), F.lit(":"), F.col(p).cast("string"), F.lit("["))
    back = lambda c, p: F.concat(F.lit("]"), F.col(c), F.lit(":"), F.col(p).cast("string"), F.lit("]"))
    a = F.struct(F.col("contig_a").alias("contig"), F.col("pos_a").alias("pos"), F.concat("base_a", mate("contig_b", "pos_b")).alias("alt"))
    b = F.struct(F.col("contig_b").alias("contig"), F.col("pos_b").alias("pos"), F.concat(back("contig_a", "pos_a"), F.col("base_b")).alias("alt"))
    return draws.select("pair", F.explode(F.array(a, b)).alias("m")).select("m.contig", "m.pos", "m.alt", "pair")


def place_fragments(contigs: DataFrame, lengths: list[tuple[int, float]], coverage: float, read_len: int, paired: bool, seed: int) -> DataFrame:
    """(contig, k, start, end): ceil(length * coverage / bases a fragment) draws a contig (contig, length); the length first, then
    the start; a fragment longer than its contig is discarded."""
    n = F.ceil(F.col("length") * F.lit(coverage) / F.lit(read_len * (2 if paired else 1)))
    d = contigs.where("length > 0").select("contig", "length", F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("k"))
    key = F.concat_ws(":", F.col("contig"), F.col("k").cast("string"))
    d = d.withColumn("size", pick(uniform(seed, "size", key), lengths)).where("size <= length")
    start = F.floor(uniform(seed, "start", key) * (F.col("length") - F.col("size") + 1))
    return d.select("contig", "k", start.alias("start"), (start + F.col("size")).alias("end"))


def suppressed(fragments: DataFrame, seed: int) -> DataFrame:
    """fragments (id, broken) that survive: one is dropped with probability `broken`."""
    return fragments.where(uniform(seed, "suppress", F.col("id")) >= F.col("broken"))


def allele_draws(pairs: DataFrame, seed: int) -> DataFrame:
    """pairs (fragment, variant, homozygous, af) with `alt`: one draw for both mates; homozygous always, heterozygous half the
    time, or by af where one is given."""
    u = uniform(seed, "allele", F.concat_ws("/", F.col("fragment").cast("string"), F.col("variant").cast("string")))
    return pairs.withColumn("alt", F.when(F.col("af").isNotNull(), u < F.col("af")).when(F.col("homozygous"), F.lit(True)).otherwise(u < 0.5))


def allele_depths(draws: DataFrame) -> DataFrame:
    """(variant, ref_depth, alt_depth, af): af to four places, `.` without depth."""
    g = draws.groupBy("variant").agg(F.sum((~F.col("alt")).cast("long")).alias("ref_depth"), F.sum(F.col("alt").cast("long")).alias("alt_depth"))
    dp = F.col("ref_depth") + F.col("alt_depth")
    return g.withColumn("af", F.when(dp > 0, F.format_string("%.4f", F.round(F.col("alt_depth") / dp, 4))).otherwise("."))


def subclone_draw(variants: DataFrame, key: Column, subclones: list[tuple[float, float]], purity: float, seed: int) -> DataFrame:
    """variants (dosage) with ccf (one draw by weight), af = dosage * ccf and vaf = purity * af."""
    out = variants.withColumn("ccf", pick(uniform(seed, "subclone", key), subclones))
    return out.withColumn("af", F.col("dosage") * F.col("ccf")).withColumn("vaf", F.lit(purity) * F.col("af"))


def haplotype_positions(variants: DataFrame) -> DataFrame:
    """variants (contig, pos0, ref, alt; one a position) with hap_pos: pos0 on the haplotype that carries all of them."""
    shifted = running(variants, ["contig"], "pos0", {"hap_pos": ("sum", F.length("alt") - F.length("ref"))}, before=True)
    return shifted.withColumn("hap_pos", F.col("pos0") + F.col("hap_pos"))


def quality_strings(reads: DataFrame, key: Column, start: list[tuple[int, float]], stay: float, step: int, low: int, high: int, length: int, seed: int) -> DataFrame:
    """reads with `scores`: a chain that begins by `start`, stays with probability `stay` and else moves by `step` up or down
    within [low, high]. One fold over the read's keyed draws."""
    first = pick(uniform(seed, "q0", key), start)
    h = lambda i: key_hash(F.concat_ws("|", F.lit(str(seed)), F.lit("q"), key.cast("string"), i.cast("string"))) / F.lit(float(1 << 48))
    nxt = lambda q, u: F.when(u < stay, q).when(u < stay + (1 - stay) / 2, F.greatest(q - step, F.lit(low))).otherwise(F.least(q + step, F.lit(high)))
    chain = F.aggregate(F.sequence(F.lit(2), F.lit(length)), F.array(first.cast("int")), lambda a, i: F.concat(a, F.array(nxt(F.element_at(a, -1), h(i)).cast("int"))))
    return reads.withColumn("scores", chain)


def read_bases(seq: Column, scores: Column, key: Column, seed: int) -> Column:
    """The bases of a read of `seq`, each replaced by another with its score's error probability."""
    u = lambda i, s: key_hash(F.concat_ws("|", F.lit(str(seed)), F.lit(s), key.cast("string"), i.cast("string"))) / F.lit(float(1 << 48))
    bases = F.filter(F.split(seq, ""), lambda b: b != "")
    other = lambda b, i: F.when(b == "N", b).otherwise(F.get(F.filter(F.array(*[F.lit(x) for x in "ACGT"]), lambda x: x != b), F.floor(u(i, "which") * 3).cast("int")))
    return F.array_join(F.transform(bases, lambda b, i: F.when(u(i, "error") < F.pow(F.lit(10.0), -F.get(scores, i) / 10), other(b, i)).otherwise(b)), "")


def junction_reads(svs: DataFrame, contigs: DataFrame, arm: int) -> DataFrame:
    """(id, type, seq): the sequence across each junction: DEL joins the flanks, DUP its end to its start, INV its start flank to
    its end turned round. svs: id, contig, start, end (0-based), type. contigs: contig, seq, in rows that tasks can hold."""
    s = svs.join(contigs, "contig").where((F.col("start") >= arm) & (F.col("end") + arm <= F.length("seq")) & (F.col("end") - F.col("start") >= arm))
    piece = lambda a: F.substr("seq", (a + 1).cast("int"), F.lit(arm))
    left, right = piece(F.col("start") - arm), piece(F.col("end"))
    inner_start, inner_end = piece(F.col("start")), piece(F.col("end") - arm)
    seq = F.when(F.col("type") == "DEL", F.concat(left, right)).when(F.col("type") == "DUP", F.concat(inner_end, inner_start)).when(F.col("type") == "INV", F.concat(left, reverse_complement(inner_end)))
    return s.where(seq.isNotNull()).select("id", "type", seq.alias("seq"))


def _apply(ref: str, at: int, variants: list[tuple[int, str, str]]) -> str | None:
    """ref (from position `at`) with the variants in it; None if they overlap or don't fit."""
    out, end = [], 0
    for pos, r, a in sorted(variants):
        i = pos - at
        if i < end or ref[i : i + len(r)] != r:
            return None
        out += [ref[end:i], a]
        end = i + len(r)
    return "".join(out) + ref[end:]


def promote_equivalent(candidates: DataFrame) -> DataFrame:
    """(contig, kind, pos0, ref, alt) of misses and false calls that spell the same sequence. candidates: contig, cluster, window,
    window_start, kind (fn, fp), pos0, ref, alt: a cluster's variants lie near each other, and `window` is the reference around
    all of them. False calls are taken by position; one is settled with the misses near it if both sides give the same bases,
    and each miss is used once. A cluster is the unit, so a contig is many tasks. One call at a time, whatever other calls lie near; sets of
    calls are settled by equivalence.equivalent()."""

    def settle(ref: str, at: int, variants: list) -> list[tuple]:
        left = sorted((v["pos0"], v["ref"], v["alt"]) for v in variants if v["kind"] == "fn")
        out = []
        for fp in sorted((v["pos0"], v["ref"], v["alt"]) for v in variants if v["kind"] == "fp"):
            spelled = _apply(ref, at, [fp])
            spans = [left[i : i + n] for n in range(1, len(left) + 1) for i in range(len(left) - n + 1)]
            same = next((x for x in spans if spelled is not None and _apply(ref, at, x) == spelled), None)
            if same:
                out += [("fp", *fp), *(("fn", *v) for v in same)]
                left = [v for v in left if v not in same]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(c, *row) for c, ref, at, v in zip(pdf["contig"], pdf["window"], pdf["window_start"], pdf["variants"], strict=True) for row in settle(ref, int(at), v)]
            yield pd.DataFrame(found, columns=["contig", "kind", "pos0", "ref", "alt"])

    ship(candidates.sparkSession)
    grouped = candidates.groupBy("contig", "cluster").agg(F.first("window").alias("window"), F.first("window_start").alias("window_start"), F.collect_list(F.struct("kind", "pos0", "ref", "alt")).alias("variants"))
    return grouped.drop("cluster").mapInPandas(run, "contig string, kind string, pos0 long, ref string, alt string")


def place_structural(contigs: DataFrame, rate: float, types: dict[str, tuple[float, float, float]], seed: int, retries: int = 10) -> DataFrame:
    """(contig, type, start, end): structural variants that don't overlap, placed one after another in each contig (contig, length);
    types: name -> (probability, mu, sigma) of log-normal lengths. A draw that overlaps or doesn't fit is drawn again, `retries` times."""
    import numpy as np

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        contig, length = pdf["contig"].iloc[0], int(pdf["length"].iloc[0])
        rng = np.random.default_rng([seed, *contig.encode()])
        names = sorted(types)
        p = np.array([types[n][0] for n in names])
        taken: list[tuple[int, int]] = []
        out = []
        for _ in range(rng.poisson(rate * length)):
            name = names[rng.choice(len(names), p=p / p.sum())]
            for _ in range(retries):
                size = max(50, int(rng.lognormal(*types[name][1:])))
                if size >= length:
                    continue
                a = int(rng.integers(0, length - size))
                if all(a + size <= x or y <= a for x, y in taken):
                    taken.append((a, a + size))
                    out.append((contig, name, a, a + size))
                    break
        return pd.DataFrame(out, columns=["contig", "type", "start", "end"])

    return contigs.groupBy("contig").applyInPandas(place, "contig string, type string, start long, end long")
