"""Shared bases of mates, counted in the tasks, against a row for each base."""

import random

import pytest
from pyspark.sql import functions as F

from genolake.operators import fit, kernel, reads
from genolake.operators.mate_counts import overlap_counts
from genolake.plans import reads as plans

SF = "/root/testdata/sf0.001"
MATE = "struct<pos0:long,cigar:string,seq:string,reverse:boolean>"
CIGARS = ["10M", "3S7M", "4M2D6M", "2M3I5M", "5M20N5M", "3=1X6M", "2H8M2S", "10M", "*"]


def test_sites_of_spans_by_hand(spark):
    c = spark.createDataFrame([("x", "ACGTNACGGGT"), ("y", "GGC")], "contig string, seq string")
    sites = spark.createDataFrame([("x", 4), ("x", 4), ("x", 0), ("x", 9), ("x", 50), ("y", 2), ("q", 1)], "contig string, pos0 long")
    spans = spark.createDataFrame([("x", 3, 5), ("x", 9, 5), ("y", 0, 2), ("y", 1, 5), ("x", 0, 1)], "contig string, start long, n long")
    got = {(r.contig, r.start): (r.bases, bytes(r.known)) for r in kernel.reference_bases(spans, c, "start", "n", 5, 4, sites).collect()}
    assert got == {("x", 3): ("TNACG", b"\0\1\0\0\0"), ("x", 9): ("GT", b"\1\0"), ("y", 0): ("GG", b"\0\0"), ("y", 1): ("GC", b"\0\1"), ("x", 0): ("A", b"\1")}


@pytest.mark.parametrize("seed", range(2))
def test_counts_of_rows(spark, seed):
    """Clips, gaps and reverse reads, reads with fewer bases than their CIGAR says, and mates that reach beyond the contig."""
    r = random.Random(seed)
    contigs = {c: "".join(r.choice("ACGTN") for _ in range(n)) for c, n in (("a", 120), ("b", 33))}
    rows = []
    for k in range(150):
        contig = r.choice("ab")
        mate = lambda at, e: (at, r.choice(CIGARS), "".join(r.choice("ACGTN") for _ in range(r.choice([10, 10, 10, 7]))), e)
        at = r.randrange(len(contigs[contig]))
        rows.append((contig, mate(at, False), mate(max(0, at + r.randrange(-12, 12)), r.random() < 0.8)))
    pairs = spark.createDataFrame(rows, f"contig string, a {MATE}, b {MATE}").repartition(3)
    c = spark.createDataFrame(list(contigs.items()), "contig string, seq string")
    sites = spark.createDataFrame([(x, r.randrange(len(s))) for x, s in contigs.items() for _ in range(len(s) // 4)], "contig string, pos0 long")
    key = ["bin_a", "bin_b", "base_a", "base_b", "frame", "masked"]
    want = reads.masked(reads.mate_overlaps(pairs, c), sites).groupBy(*key).agg(F.count("*").alias("n"))
    spans = pairs.withColumn("start", F.least("a.pos0", "b.pos0")).withColumn("long", F.lit(60))
    got = overlap_counts(kernel.reference_bases(spans, c, "start", "long", 60, 16, sites))
    rows = lambda df: sorted(tuple(x) for x in df.select(*key, "n").collect())
    assert rows(got) == rows(want) and got.count() > 100


def test_counts_refuse_and_pass_over(spark):
    one = lambda cigar, seq: (0, cigar, seq, None)
    rows = [(one("4M", "ACGT"), one("4M", "")), (one("4M", "ACGT"), None), (one(None, "ACGT"), one("4M", "ACGT")), (one("4M", "ACGT"), one("2M", "AG"))]
    pairs = spark.createDataFrame(rows, f"a {MATE}, b {MATE}").withColumns({"start": F.lit(0), "bases": F.lit("ACGT"), "known": F.lit(b"\0\1\0\0")})
    assert sorted(tuple(r) for r in overlap_counts(pairs, 2).collect()) == [(0, 0, "A", "A", "A", False, 1), (0, 1, "C", "G", "C", True, 1)]
    with pytest.raises(Exception, match="share more than 1"):
        overlap_counts(pairs, most=1).collect()


def test_overlaps_are_counts(spark):
    """As many rows as there are different counts, however many bases mates share."""
    o = plans._overlaps(spark, SF)
    assert o.agg(F.sum("n")).first()[0] > 20_000
    assert o.count() <= 5 * 5 * 5**3 * 2


@pytest.mark.parametrize("name", ["cycle_spectrum", "overlap_bin_report"])
def test_tables_are_read_once(spark, name):
    """Errors and bases compared come from one table of counts, and not each from the tables."""
    assert not [f for f in plans.QUERIES[name](spark, SF).inputFiles() if f.startswith(f"file://{SF}")]


def test_lengths_are_worked_out_once(spark):
    """Letters are picked out of a text once for its length: a condition on the length would do it again."""
    from genolake.plans.inputs import located

    assert str(located(spark, SF)._jdf.queryExecution().optimizedPlan().toString()).count("regexp_replace") == 1


def test_matrix_of_counts(spark):
    rows = [(0, "A", "A", "A", False, 7), (0, "C", "A", "A", False, 2), (0, "A", "C", "A", False, 3), (0, "A", "C", "A", True, 4), (1, "G", "T", "A", False, 5), (0, "T", "T", "A", False, 1)]
    m = fit.overlap_matrix(spark.createDataFrame(rows, "bin long, b1 string, b2 string, ref string, masked boolean, n long"))
    assert {(r.bin, r.outcome): r.n for r in m.collect()} == {(0, "agree"): 8, (0, "first_differs"): 2, (0, "second_differs"): 3, (0, "masked"): 4, (1, "neither"): 5}
