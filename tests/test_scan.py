"""Scans by tiles and by ranges, and what rests on them, against plain loops."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from genolake.operators import compare, fit, generate, intervals
from genolake.operators.scan import following, ranged, running


@pytest.mark.parametrize("width", [1, 3, 50, 1 << 20])
def test_running_folds(spark, width):
    r = random.Random(width)
    rows = [(g, r.choice([None, *range(-40, 200)]), i, r.choice([None, *range(-5, 9)])) for i, g in enumerate(["a"] * 300 + ["b"] * 40 + ["c"])]
    df = spark.createDataFrame(rows, "g string, at long, i long, v long")
    folds = {"total": ("sum", F.col("v")), "most": ("max", F.col("v")), "mix": ("xor", F.col("v"))}
    for before in (False, True):
        got = {x.i: x for x in running(df, ["g"], "at", folds, ties=["i"], width=width, before=before).collect()}
        assert len(got) == len(rows)
        for g in "abc":
            past = []
            for row in sorted((x for x in rows if x[0] == g), key=lambda x: (x[1] is not None, x[1] or 0, x[2])):
                seen = past if before else [*past, row[3]]
                seen = [v for v in seen if v is not None]
                mix = 0
                for v in seen:
                    mix ^= v
                x = got[row[2]]
                assert (x.total, x.most, x.mix) == (sum(seen), max(seen, default=None), mix)
                past.append(row[3])


@pytest.mark.parametrize("width", [1, 7, 1 << 20])
def test_following(spark, width):
    at = sorted(random.Random(1).sample(range(-300, 900), 200))
    df = spark.createDataFrame([("a", x) for x in at] + [("b", 5)], "g string, at long")
    got = {(x.g, x.at): x.next for x in following(df, ["g"], "at", "next", width).collect()}
    assert got == {("a", x): y for x, y in zip(at, [*at[1:], None], strict=True)} | {("b", 5): None}


def test_ranged_sums_and_ranks(spark):
    r = random.Random(2)
    values = [r.choice([0.25, -1.5, float(i), None]) for i in range(400)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    n = df.where("x is not null").groupBy("x").agg(F.count("*").alias("n"))
    got = {row.x: row.before for row in ranged(n, "x", "n", "before").collect()}
    known = sorted(v for v in values if v is not None)
    assert got == {v: bisect.bisect_left(known, v) for v in known}
    ranks = {row.x: row["rank"] for row in compare.ranks_by_value(df.where("x is not null"), "x").collect()}
    assert ranks == {v: (bisect.bisect_left(known, v) + 1 + bisect.bisect_right(known, v)) / 2 for v in known}


def _spans(r, n):
    """Intervals of one base up to a hundred million, so that many levels meet."""
    out = []
    for i in range(n):
        start = r.choice([r.randrange(3000), r.randrange(10**6), r.randrange(10**8)])
        out.append((r.choice("ab"), start, start + r.choice([0, 1, 2, 255, 256, 257, 5000, 10**5, 10**8, r.randrange(3000)]), i))
    return out


@pytest.mark.parametrize("width", [16, 256])
def test_overlaps_of_mixed_lengths(spark, width):
    r = random.Random(width)
    a, b = _spans(r, 150), _spans(r, 150)
    frames = [spark.createDataFrame(x, "contig string, start long, end long, id long") for x in (a, b)]
    got = sorted((x.id, x.r_id, x.lo, x.hi) for x in intervals.overlaps(*frames, width).collect())
    want = sorted((i, j, max(s, u), min(e, v)) for c, s, e, i in a for d, u, v, j in b if c == d and s < e and u < v and max(s, u) < min(e, v))
    assert got == want and len(want) > 1000


def test_a_long_interval_is_filed_twice_at_most(spark):
    long = spark.createDataFrame([("a", 5, 10**8)], "contig string, start long, end long")
    levels = intervals._levels(long, 256).agg(F.collect_set("level").alias("_at"))
    assert intervals._filed(long, levels, 256).count() <= 2


def test_points_stretches_and_values(spark):
    r = random.Random(4)
    spans = _spans(r, 60) + [(None, 1, 5, 99)]
    points = [(r.choice(["a", "b", "z", None]), r.choice([None, r.randrange(4000), r.randrange(10**8), *(s for _, s, _, _ in spans[:20]), *(e for _, _, e, _ in spans[:20])]), i) for i in range(400)] + [("a", 7, 1000), ("a", 7, 1000)]
    bed = spark.createDataFrame(spans, "contig string, start long, end long, id long")
    df = spark.createDataFrame(points, "contig string, pos0 long, id long")
    hit = lambda c, s, e: any(c == d and u < v and u < e and s < v for d, u, v, _ in spans if d is not None)
    inside = [(c, p, i) for c, p, i in points if c is not None and p is not None and hit(c, p, p + 1)]
    order = lambda rows: sorted(rows, key=str)
    assert order(tuple(x) for x in intervals.points_in(df, bed).collect()) == order(inside)
    outside = [x for x in points if x not in inside]
    assert order(tuple(x) for x in intervals.points_in(df, bed, anti=True).collect()) == order(outside)
    reach = [(c, p, i) for c, p, i in points if c is not None and p is not None and hit(c, p - 100, p + 101)]
    assert order(tuple(x) for x in intervals.touching(df, bed, F.col("pos0") - 100, F.col("pos0") + 100).collect()) == order(reach)
    segments = [("a", 0, 10, 1.5), ("a", 10, 400, 2.5), ("a", 70_000, 200_000, 3.5), ("b", 5, 6, 4.5)]
    at = [x for x in points if x[0] is not None and x[1] is not None]
    got = sorted((x.id, x.value) for x in intervals.value_at(spark.createDataFrame(at, df.schema), spark.createDataFrame(segments, "contig string, start long, end long, value double")).collect())
    assert got == sorted((i, next((v for d, s, e, v in segments if d == c and s <= p < e), 0.0)) for c, p, i in at)


def test_depth_and_break_points_across_tiles(spark):
    r = random.Random(6)
    spans = [("a", s, s + r.choice([1, 30, 200_000])) for s in (r.randrange(400_000) for _ in range(80))]
    df = spark.createDataFrame(spans, "contig string, start long, end long")
    edges = sorted({x for _, s, e in spans for x in (s, e)})
    want = [(s, e, sum(u <= s and e <= v for _, u, v in spans)) for s, e in zip(edges, edges[1:], strict=False)]
    merged = []
    for s, e, d in want:
        if d and merged and merged[-1][1] == s and merged[-1][2] == d:
            merged[-1] = (merged[-1][0], e, d)
        elif d:
            merged.append((s, e, d))
    assert sorted((x.start, x.end, x.depth) for x in intervals.depth(df).collect()) == merged
    assert sorted((x.start, x.end) for x in intervals.elementary(df).collect()) == [(s, e) for s, e, _ in want]


def test_runs_shifts_and_places_across_tiles(spark):
    seq = "N" * 5 + "A" * 90_000 + "N" * 100 + "C" + "N" * 9000 + "G" * 3
    contigs = spark.createDataFrame([("c", seq), ("n", "NNN"), ("k", "ACG")], "contig string, seq string")
    got = sorted((x.contig, x.start, x.end) for x in fit.runs(contigs).collect())
    assert got == [("c", 5, 90_005), ("c", 90_105, 90_106), ("c", 99_106, 99_109), ("k", 0, 3)]
    assert sorted((x.contig, x.start, x.end) for x in fit.runs(contigs, unknown=True).collect()) == [("c", 0, 5), ("c", 90_005, 90_105), ("c", 90_106, 99_106), ("n", 0, 3)]
    v = [("c", p, "A" * (1 + p % 3), "C" * (1 + p % 5)) for p in range(0, 400_000, 977)]
    got = {x.pos0: x.hap_pos for x in generate.haplotype_positions(spark.createDataFrame(v, "contig string, pos0 long, ref string, alt string")).collect()}
    shift = 0
    for _, p, ref, alt in v:
        assert got[p] == p + shift
        shift += len(alt) - len(ref)
    rows = [("c", p % 7 * 40_000, i) for i, p in enumerate(range(300))]
    placed = compare.in_truth_order(spark.createDataFrame(rows, "contig string, pos long, seq_no long"), spark.createDataFrame([("c", 0)], "contig string, ord int")).collect()
    assert [x.seq_no for x in sorted(placed, key=lambda x: x.place)] == [i for _, _, i in sorted(rows)] and [x.place for x in sorted(placed, key=lambda x: x.place)] == list(range(300))
