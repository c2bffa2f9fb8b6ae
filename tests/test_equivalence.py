"""The equivalence sweep against a plain walk along the calls."""

import random

import pytest

from genolake.operators.equivalence import equivalent

KEY = "contig string, pos0 long, ref string, alt string"


def put(window, start, variants):
    shift = 0
    for pos0, ref, alt in variants:
        at = pos0 - start + shift
        if at >= 0 and at + len(ref) <= len(window):
            window = window[:at] + alt + window[at + len(ref) :]
            shift += len(alt) - len(ref)
    return window.upper()


def walk(contigs, misses, calls, reach):
    """One call after the other, as the sweep's order has it."""
    out = []
    for contig, seq in contigs.items():
        fps = sorted((v[1:] for v in calls if v[0] == contig))
        fns = sorted((v[1:] for v in misses if v[0] == contig))
        gone = [set(), set()]
        for k, (pos0, _, _) in enumerate(fps):
            if k in gone[0]:
                continue
            start = max(pos0 - reach, 0)
            window = seq[start : pos0 + reach + 1]
            near = [[i for i, v in enumerate(side) if i not in gone[s] and abs(v[0] - pos0) <= reach] for s, side in enumerate((fps, fns))]
            if near[1] and put(window, start, [fps[i] for i in near[0]]) == put(window, start, [fns[i] for i in near[1]]):
                gone[0] |= set(near[0])
                gone[1] |= set(near[1])
        out += [(contig, kind, *side[i]) for kind, side, left in (("fp", fps, gone[0]), ("fn", fns, gone[1])) for i in left]
    return sorted(out)


def swept(spark, contigs, misses, calls, reach=50):
    got = equivalent(spark.createDataFrame(misses, KEY), spark.createDataFrame(calls, KEY), spark.createDataFrame(list(contigs.items()), "contig string, seq string"), reach)
    return sorted((r.contig, r.kind, r.pos0, r.ref, r.alt) for r in got.collect())


def test_known_cases(spark):
    seq = "ACGTACGTACGTTTTTGGCA"
    cases = {
        # a deletion named from two places of a repeat
        "shift": ([(0, "ACGTA", "A")], [(4, "ACGTA", "A")]),
        # several calls for one miss, and several misses for one call
        "compound": ([(8, "AC", "GT")], [(8, "A", "G"), (9, "C", "T")]),
        "split": ([(8, "A", "G"), (9, "C", "T")], [(8, "AC", "GT")]),
        "case": ([(8, "AC", "gt")], [(8, "a", "G"), (9, "C", "t")]),
        "other": ([(8, "A", "G")], [(8, "A", "T")]),
        "lone": ([], [(8, "A", "T")]),
        # one call too many in the window spoils it
        "spoiled": ([(8, "AC", "GT")], [(8, "A", "G"), (9, "C", "T"), (12, "T", "C")]),
    }
    contigs = {name: seq if name != "case" else seq.lower() for name in cases}
    misses = [(c, *v) for c, (fn, _) in cases.items() for v in fn]
    calls = [(c, *v) for c, (_, fp) in cases.items() for v in fp]
    got = swept(spark, contigs, misses, calls)
    assert got == walk(contigs, misses, calls, 50)
    assert {g[0] for g in got} == {"shift", "compound", "split", "case"}


@pytest.mark.parametrize("seed", range(2))
def test_random_sets_on_both_sides(spark, seed):
    """Dense calls and misses in short windows, so that what one call settles changes the verdict on the next."""
    r = random.Random(seed)
    contigs = {c: "".join(r.choice("ACac") for _ in range(n)) for c, n in (("a", 400), ("b", 60), ("c", 5))}
    misses, calls = [], []
    for c, seq in contigs.items():
        for _ in range(len(seq) // 3):
            p = r.randrange(len(seq))
            ref = seq[p : p + r.choice([1, 1, 2, 3])].upper()
            alt = "".join(r.choice("AC") for _ in range(r.choice([1, 1, len(ref), 2])))
            if alt == ref:
                continue
            misses.append((c, p, ref, alt))
            kind = r.randrange(4)
            if kind == 0 and len(ref) == len(alt):
                calls += [(c, p + i, x, y) for i, (x, y) in enumerate(zip(ref, alt, strict=True)) if x != y]
            elif kind == 1 and p:
                calls.append((c, p - 1, seq[p - 1] + ref, seq[p - 1] + alt))
            elif kind == 2:
                calls.append((c, p, ref, r.choice("ACGT")))
    calls = sorted(set(calls) - set(misses)) + calls[:1]
    misses = sorted(set(misses))
    for reach in (2, 9):
        assert swept(spark, contigs, misses, calls, reach) == walk(contigs, misses, calls, reach)


def test_chains_of_settled_calls(spark):
    """Each settled call frees the window of the next one: the rounds follow the chain to its end."""
    seq = "ACGT" * 60
    misses = [("c", 5 + 4 * i, seq[5 + 4 * i : 7 + 4 * i], "TT") for i in range(15)]
    calls = [("c", p + k, ref[k], "T") for _, p, ref, _ in misses for k in (0, 1)]
    for reach in (1, 5):
        assert swept(spark, {"c": seq}, misses, calls, reach) == walk({"c": seq}, misses, calls, reach)
    assert swept(spark, {"c": seq}, [], calls) == [] and swept(spark, {"c": seq}, misses, []) == []


def test_chains_take_few_jobs(spark):
    """Verdicts that free one another along a contig cost jobs by tiles, not by verdicts: the driver keeps something of each job."""
    seq = "ACGT" * 200
    misses = [("c", 5 + 4 * i, seq[5 + 4 * i : 7 + 4 * i], "TT") for i in range(60)]
    calls = [("c", p + k, ref[k], "T") for _, p, ref, _ in misses for k in (0, 1)]
    context = spark.sparkContext
    context.setJobGroup("few jobs", "")
    try:
        assert swept(spark, {"c": seq}, misses, calls, 5) == walk({"c": seq}, misses, calls, 5)
        assert len(context.statusTracker().getJobIdsForGroup("few jobs")) <= 30
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize(("reach", "tile"), [(2, 1), (3, 16), (9, 20)])
def test_tiles_change_one_another(spark, reach, tile):
    """Calls near the end of a tile settle what the next tile would have used; chains run over many tiles."""
    r = random.Random(reach)
    contigs = {"a": "".join(r.choice("AC") for _ in range(300)), "b": "ACGT" * 30, "short": "AC"}
    misses, calls = [], []
    for c, seq in contigs.items():
        for p in range(0, len(seq) - 2, 2):
            ref = seq[p : p + 2]
            misses.append((c, p, ref, "TT"))
            calls += [(c, p + k, ref[k], "T") for k in (0, 1) if ref[k] != "T" and r.random() < 0.95]
    got = equivalent(*(spark.createDataFrame(x, KEY) for x in (misses, calls)), spark.createDataFrame(list(contigs.items()), "contig string, seq string"), reach, tile)
    want = walk(contigs, misses, calls, reach)
    assert want and sorted((v.contig, v.kind, v.pos0, v.ref, v.alt) for v in got.collect()) == want


def test_calls_beyond_the_contig(spark):
    """A window without bases settles nothing."""
    assert swept(spark, {"c": "ACGT"}, [("c", 60, "A", "C"), ("d", 1, "C", "G")], [("c", 60, "A", "G"), ("d", 1, "C", "A")]) == []
