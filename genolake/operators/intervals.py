"""Joins and algebra over half-open genomic intervals (contig, start, end).

Pairs come from equi-joins on (contig, level, bin): an interval is filed at the level whose bins are as long as itself, in two of them at most,
and at the coarser levels that the data have, so that work follows the overlaps, long intervals cost no more rows than short ones, and
a contig is dealt over many tasks. Whether a point lies in any interval, and in which of disjoint segments, comes from
one scan along the contig (scan.py). Segment values are found from events and running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import staged
from .scan import following, running

#: Bases in a bin of the finest level; each level's bins are STEP times as long as those of the level below.
BIN = 256
STEP = 8


def _level(width: int) -> Column:
    """The finest level whose bins are at least as long as the interval."""
    long = F.greatest(F.col("end") - F.col("start"), F.lit(1))
    return sum(((long > width * STEP**k).cast("int") for k in range(12)), F.lit(0))


def _levels(intervals: DataFrame, width: int) -> DataFrame:
    return intervals.where("start < end").select(_level(width).alias("level")).distinct()


def _filed(intervals: DataFrame, levels: DataFrame, width: int) -> DataFrame:
    """intervals with own (level), and a row for each level (one row: array `_at`) from it on and each bin there, two at most."""
    t = intervals.where("start < end").withColumn("own", _level(width)).join(F.broadcast(levels))
    t = t.withColumn("level", F.explode(F.filter("_at", lambda k: k >= F.col("own")))).drop("_at")
    size = F.lit(width).cast("long") * F.pow(F.lit(STEP), F.col("level")).cast("long")
    return t.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))))


def overlaps(left: DataFrame, right: DataFrame, width: int = BIN, longest: int | None = None) -> DataFrame:
    """Pairs of overlapping intervals with the columns of both (right's are prefixed r_), and lo, hi of the overlap. A pair meets at the
    coarser of its two levels. Both sides are read once more for the levels that they have (at most 13), unless the caller knows that no
    interval is longer than `longest`; a dear side is staged by the caller."""
    if longest is None:
        levels = _levels(left, width).union(_levels(right, width)).agg(F.collect_set("level").alias("_at"))
    else:
        steps = next(k for k in range(13) if longest <= width * STEP**k)
        levels = left.sparkSession.range(1).select(F.array(*[F.lit(k) for k in range(steps + 1)]).alias("_at"))
    a = _filed(left, levels, width)
    b = _filed(right, levels, width)
    b = b.withColumnsRenamed({c: f"r_{c}" for c in b.columns})
    same = [F.col(c) == F.col(f"r_{c}") for c in ("contig", "level", "bin")]
    on = [*same, F.col("level") == F.greatest("own", "r_own"), F.col("start") < F.col("r_end"), F.col("r_start") < F.col("end")]
    lo, hi = F.greatest("start", "r_start"), F.least("end", "r_end")
    size = F.lit(width).cast("long") * F.pow(F.lit(STEP), F.col("level")).cast("long")
    # a pair that shares several bins is kept in the bin where its overlap begins
    out = a.join(b, on).withColumn("lo", lo).withColumn("hi", hi).where(F.floor(F.col("lo") / size) == F.col("bin"))
    return out.drop("own", "level", "bin", "r_own", "r_level", "r_bin", "r_contig")


def _scanned(rows: DataFrame, intervals: DataFrame, at: Column, value: Column, name: str) -> DataFrame:
    """rows (contig and `at` not null) with the maximum of value over the intervals of the contig that start at or before `at`, null if none."""
    r = rows.select("contig", at.cast("long").alias("_at"), F.lit(1).alias("_side"), F.struct(*rows.columns).alias("_row"))
    i = intervals.where("contig is not null and start < end").select("contig", F.col("start").cast("long").alias("_at"), F.lit(0).alias("_side"), value.alias("_value"))
    both = r.unionByName(i, allowMissingColumns=True)
    out = running(both, ["contig"], "_at", {name: ("max", F.col("_value"))}, ties=["_side"])
    return out.where("_side = 1").select("_row.*", name)


def touching(rows: DataFrame, intervals: DataFrame, start: Column, last: Column, anti: bool = False) -> DataFrame:
    """rows (contig, ...) whose stretch of bases from start to last (0-based, both included) meets an interval, or (anti) none; each
    once, however many it meets. An interval that starts at or before `last` is met if it ends after `start`; the greatest end of
    those tells. Rows without contig or places meet nothing."""
    known = F.coalesce(F.col("contig").isNotNull() & start.isNotNull() & last.isNotNull(), F.lit(False))
    met = _scanned(rows.where(known), intervals, last, F.col("end").cast("long"), "__reach")
    hit = F.coalesce(F.col("__reach") > start, F.lit(False))
    kept = met.where(~hit if anti else hit).drop("__reach")
    return kept.unionByName(rows.where(~known)) if anti else kept


def points_in(points: DataFrame, intervals: DataFrame, position: str = "pos0", anti: bool = False) -> DataFrame:
    """Points (contig, position; 0-based) that lie in an interval, or (anti) in none; each once, however many hold it."""
    return touching(points, intervals, F.col(position), F.col(position), anti)


def depth(intervals: DataFrame) -> DataFrame:
    """(contig, start, end, depth): maximal runs of equal depth above 0. Two events an interval and a running sum by tiles; no base is
    a row."""
    events = intervals.select("contig", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))).alias("e"))
    events = staged(events.groupBy("contig", F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d")).where("d != 0"), "events")
    runs = following(running(events, ["contig"], "at", {"depth": ("sum", F.col("d"))}), ["contig"], "at", "end")
    return runs.where("depth > 0").select("contig", F.col("at").alias("start"), "end", "depth")


def elementary(*sides: DataFrame) -> DataFrame:
    """(contig, start, end) between neighbouring break points of all sides' intervals."""
    points = None
    for s in sides:
        own = s.select("contig", F.explode(F.array("start", "end")).alias("start"))
        points = own if points is None else points.union(own)
    return following(staged(points.distinct(), "break_points"), ["contig"], "start", "end").where("end is not null")


def _pieces(segments: DataFrame, changes: DataFrame, width: int, *columns: str) -> tuple[DataFrame, DataFrame]:
    """Staged: the stretches (contig, start, end, and the changes' columns) that changes cover of segments, and the segments (with value) cut at their
    ends. A piece's segment is the last that starts at or before it."""
    hit = overlaps(segments.select("contig", "start", "end"), changes, width).select("contig", F.col("lo").alias("start"), F.col("hi").alias("end"), *[F.col(f"r_{c}").alias(c) for c in columns])
    hit = staged(hit, "covered")
    whole = F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("value").alias("value"))
    cut = _scanned(elementary(segments.select("contig", "start", "end"), hit), segments, F.col("start"), whole, "__segment").where(F.col("__segment.end") > F.col("start"))
    return hit, staged(cut.select("contig", "start", "end", F.col("__segment.value").alias("value")), "cut")


def override(segments: DataFrame, changes: DataFrame, width: int = BIN) -> DataFrame:
    """Segments (contig, start, end, value; disjoint) with the value of the last change (greatest seq) that covers a stretch.
    Changes never create coverage where no segment was."""
    hit, base = _pieces(segments, changes, width, "seq", "value")
    last = overlaps(base, hit, width).groupBy("contig", "start", "end").agg(F.max_by("r_value", "r_seq").alias("new"))
    return base.join(last, ["contig", "start", "end"], "left").select("contig", "start", "end", F.coalesce("new", "value").alias("value"))


def multiply(segments: DataFrame, factors: DataFrame, width: int = BIN) -> DataFrame:
    """Segments (contig, start, end, value; disjoint) whose value is multiplied by every factor (contig, start, end, value)
    that covers a stretch."""
    hit, base = _pieces(segments, factors, width, "value")
    of = F.aggregate(F.array_sort(F.collect_list("r_value")), F.lit(1.0), lambda a, x: a * x)
    by = overlaps(base, hit, width).groupBy("contig", "start", "end").agg(of.alias("factor"))
    return base.join(by, ["contig", "start", "end"], "left").select("contig", "start", "end", (F.col("value") * F.coalesce("factor", F.lit(1.0))).alias("value"))


def value_at(points: DataFrame, segments: DataFrame, position: str = "pos0") -> DataFrame:
    """points with `value`: that of the segment (disjoint) that holds them, 0 in gaps. Of the segments that start at or before a point the
    last one is looked up, in one scan along the contig; points have a contig and a place."""
    found = _scanned(points, segments, F.col(position), F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("value").cast("double").alias("value")), "__segment")
    return found.withColumn("value", F.when(F.col("__segment.end") > F.col(position), F.col("__segment.value")).otherwise(F.lit(0.0))).drop("__segment")


def exclude_points(segments: DataFrame, points: DataFrame, position: str = "pos0", width: int = BIN) -> DataFrame:
    """Segments (contig, start, end) without the points' bases."""
    cut = points.select("contig", F.col(position).alias("start"), (F.col(position) + 1).alias("end")).distinct()
    own = segments.select("contig", "start", "end")
    hit = staged(overlaps(own, cut, width).select("contig", F.col("lo").alias("start"), F.col("hi").alias("end")).distinct(), "cut_bases")
    pieces = touching(elementary(own, hit), own, F.col("start"), F.col("start"))
    return pieces.join(hit, ["contig", "start", "end"], "left_anti")


def tiles(contigs: DataFrame, size: int) -> DataFrame:
    """(contig, chunk, start, end): contigs (contig, length) cut into even chunks of at most `size`."""
    n = F.greatest(F.ceil(F.col("length") / size), F.lit(1))
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("chunk")
    return contigs.where("length > 0").select("contig", "length", n.alias("n"), chunk).select("contig", "chunk", F.floor(F.col("chunk") * F.col("length") / F.col("n")).alias("start"), F.floor((F.col("chunk") + 1) * F.col("length") / F.col("n")).alias("end"))


def scaled_coverage(value: Column) -> Column:
    """Rounded half away from zero; 0 for what is not positive and finite."""
    return F.when(value.isNull() | F.isnan(value) | (value <= 0) | (value == float("inf")), F.lit(0).cast("long")).otherwise(F.round(value).cast("long"))
