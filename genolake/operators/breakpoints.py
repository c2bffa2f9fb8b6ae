"""Candidate breakpoints of aligned reads: agreeing clip boundaries, the depth behind them, their class, and their match with truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import clip_lengths, reference_span
from ..staging import staged
from .intervals import depth, overlaps
from .realism import near
from .scan import running


def candidate_sites(reads: DataFrame, least_clip: int = 20, support: int = 3) -> DataFrame:
    """(contig, pos0, side, support, depth, mapq0): places at which `support` reads or more (contig, pos0, cigar, mapq) are clipped by `least_clip` bases
    or more. side L: reads begin there after a clip; R: they end there before one, and pos0 is the first base behind them. depth and mapq0: the
    reads over the site's last base inside, and those of them with a MAPQ of 0.

    Depth is looked up, not counted by site: starts and ends of reads and the sites' bases go through one scan along the contig, in which
    a base sees what began and has not ended. Events at one place are summed before they are dealt out."""
    left, right = clip_lengths(F.col("cigar"))
    r = reads.where("contig is not null and pos0 is not null").select("contig", F.col("pos0").cast("long").alias("start"), (F.col("pos0") + reference_span(F.col("cigar"))).cast("long").alias("end"), (F.col("mapq") == 0).cast("long").alias("low"), left.alias("left"), right.alias("right"))
    edges = F.array(F.when(F.col("left") >= least_clip, F.struct(F.lit("L").alias("side"), F.col("start").alias("pos0"))), F.when(F.col("right") >= least_clip, F.struct(F.lit("R").alias("side"), F.col("end").alias("pos0"))))
    sites = r.select("contig", F.inline(F.array_compact(edges))).groupBy("contig", "side", "pos0").agg(F.count("*").alias("support")).where(F.col("support") >= support)
    event = lambda at, sign: F.struct(F.col(at).alias("at"), F.lit(sign).cast("long").alias("d"), (F.col("low") * sign).alias("m"))
    events = r.where("start < end").select("contig", F.inline(F.array(event("start", 1), event("end", -1)))).groupBy("contig", "at").agg(F.sum("d").alias("d"), F.sum("m").alias("m"))
    probes = sites.select("contig", F.greatest(F.col("pos0") - (F.col("side") == "R").cast("long"), F.lit(0)).alias("at"), F.struct("pos0", "side", "support").alias("site"))
    both = staged(events.unionByName(probes, allowMissingColumns=True).withColumn("later", F.col("site").isNotNull().cast("int")), "clips")
    seen = running(both, ["contig"], "at", {"depth": ("sum", F.col("d")), "mapq0": ("sum", F.col("m"))}, ties=["later"])
    return seen.where("later = 1").select("contig", "site.pos0", "site.side", "site.support", "depth", "mapq0")


def site_class(repeat: float = 0.5, junction: float = 0.3) -> Column:
    """Of a site: whether half the reads over it map anywhere (repeat-like), or many agree on it (junction-like), or neither."""
    share = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("depth").cast("double")), F.lit(0.0))
    return F.when(share("mapq0") >= repeat, "repeat-like").when(share("support") >= junction, "junction-like").otherwise("minority-support")


def mutual_nearest(left: DataFrame, right: DataFrame, reach: int, position: str = "pos0") -> DataFrame:
    """(contig, position, r_position): one-to-one pairs of places (contig, position; distinct) at most `reach` apart, each the nearest of the other;
    of places equally near the lower one counts."""
    pairs = near(left.select("contig", position), right.select("contig", position), reach, position)
    far = F.abs(F.col(position) - F.col("r_position"))
    first = pairs.groupBy("contig", position).agg(F.min(F.struct(far.alias("far"), "r_position")).alias("n")).select("contig", position, "n.r_position")
    back = pairs.groupBy("contig", "r_position").agg(F.min(F.struct(far.alias("far"), position)).alias("n")).select("contig", "r_position", f"n.{position}")
    return first.join(back, ["contig", position, "r_position"])


def near_truth(sites: DataFrame, truth: DataFrame, reach: int = 10) -> DataFrame:
    """(class, sites, near, matched) of sites (contig, pos0, class, ...) and true places (contig, pos0): how many lie within `reach` of one, and how many are
    matched one to one; a last row ALL. The two sides of one place are one place for the match, under the first of their classes."""
    t = truth.select("contig", "pos0").distinct()
    places = sites.groupBy("contig", "pos0").agg(F.min("class").alias("of"))
    close = near(places.select("contig", "pos0"), t, reach).select("contig", "pos0").distinct().withColumn("close", F.lit(1))
    met = mutual_nearest(places, t, reach).select("contig", "pos0").withColumn("met", F.lit(1))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias
    name = F.when(F.col("all") == 1, "ALL").otherwise(F.col("of")).alias("class")
    of_sites = sites.select("contig", "pos0", F.col("class").alias("of")).join(close, ["contig", "pos0"], "left").rollup("of").agg(F.grouping("of").alias("all"), F.count("*").alias("sites"), total("close")("near")).select(name, "sites", "near")
    of_places = places.join(met, ["contig", "pos0"], "left").rollup("of").agg(F.grouping("of").alias("all"), total("met")("matched")).select(name, "matched")
    return of_sites.join(of_places, "class", "left").withColumn("matched", F.coalesce("matched", F.lit(0).cast("long")))


def chance_near(regions: DataFrame, truth: DataFrame, reach: int = 10) -> DataFrame:
    """One row (bases, near, share): of the regions' bases (contig, start, end), how many lie within `reach` of a true place inside a region: what a
    place drawn at random would score. Exact, from the union of the windows."""
    r = staged(depth(regions.select("contig", "start", "end")).select("contig", "start", "end"), "regions")
    inside = overlaps(truth.select("contig", F.col("pos0").alias("start"), (F.col("pos0") + 1).alias("end")).distinct(), r).select("contig", "lo").distinct()
    windows = depth(inside.select("contig", (F.col("lo") - reach).alias("start"), (F.col("lo") + reach + 1).alias("end")))
    windows = staged(windows, "near")
    held = overlaps(windows.select("contig", "start", "end"), r).agg(F.coalesce(F.sum(F.col("hi") - F.col("lo")), F.lit(0)).alias("near"))
    total = r.agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("bases"))
    return total.join(F.broadcast(held)).withColumn("share", F.try_divide("near", "bases"))
