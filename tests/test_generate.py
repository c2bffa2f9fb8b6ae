"""Generators: known answers, and results that don't depend on how rows are dealt."""

import re

from pyspark.sql import functions as F

from genolake.operators import fit, generate, intervals
from genolake.plans import generate as plans
from genolake.plans import inputs


def test_haplotype_sequence(spark):
    v = [(10, "A", "T"), (13, "AC", "A"), (14, "C", "G"), (18, "T", "TGG"), (2, "A", "C"), (19, "GG", "G")]
    df = spark.createDataFrame([("AACAACGGTG", 10, v)], "seq string, start long, v array<struct<pos0:long,ref:string,alt:string>>")
    # 14 C>G lies right of 13 AC>A, which overlaps it and is left out; 19 GG reaches past the end
    assert df.select(generate.haplotype_sequence(F.col("seq"), F.col("start"), F.col("v")).alias("x")).first().x == "TACAGCGGTGGG"


def test_draws_do_not_depend_on_partitions(spark):
    c = spark.createDataFrame([(f"c{i}", 500 + 37 * i) for i in range(9)], "contig string, length long")
    one = generate.place_fragments(c.coalesce(1), [(100, 1), (300, 1)], 3.0, 50, True, 5)
    many = generate.place_fragments(c.repartition(7), [(100, 1), (300, 1)], 3.0, 50, True, 5)
    assert one.exceptAll(many).count() == many.exceptAll(one).count() == 0 and one.count() > 50
    other = generate.place_fragments(c, [(100, 1), (300, 1)], 3.0, 50, True, 6)
    assert one.exceptAll(other).count() > 0


def test_placement_follows_the_weights(spark):
    s = spark.createDataFrame([("c", 0, 1000, 0.1), ("c", 1000, 2000, 0.4), ("c", 3000, 3500, 0.0), ("d", 0, 3, 0.1)], "contig string, start long, end long, value double")
    got = [r.pos0 for r in generate.place_variants(s, 3).collect()]
    assert len(got) == 500 and all(0 <= p < 2000 for p in got)
    assert 60 < sum(p < 1000 for p in got) < 145


def test_equivalent_calls(spark):
    rows = [("c", 1, "GAAAT", 0, k, p, r, a) for k, p, r, a in (("fn", 0, "GA", "G"), ("fp", 2, "AA", "A"), ("fp", 3, "A", "C"))]
    rows += [("c", 2, "GACT", 10, "fn", 11, "A", "T"), ("c", 2, "GACT", 10, "fn", 12, "C", "G"), ("c", 2, "GACT", 10, "fp", 11, "AC", "TG")]
    df = spark.createDataFrame(rows, "contig string, cluster long, window string, window_start long, kind string, pos0 long, ref string, alt string")
    assert sorted((r.kind, r.pos0) for r in generate.promote_equivalent(df).collect()) == [("fn", 0), ("fn", 11), ("fn", 12), ("fp", 2), ("fp", 11)]


def test_structural_variants_do_not_overlap(spark):
    c = spark.createDataFrame([("a", 200_000), ("b", 90_000)], "contig string, length long")
    rows = generate.place_structural(c, 2e-4, {"DEL": (1.0, 6.0, 0.5), "INV": (1.0, 7.0, 0.5)}, 3).collect()
    assert len(rows) > 20
    for contig in "ab":
        own = sorted((r.start, r.end) for r in rows if r.contig == contig)
        assert all(x[1] <= y[0] for x, y in zip(own, own[1:], strict=False))


def test_md_walk(spark):
    df = spark.createDataFrame([("TTACGT", "2S4M", "1A2"), ("ACGT", "2M1I1M", "3"), ("ACGT", "4M", "9")], "seq string, cigar string, md string")
    got = {(r.ref, r.read): r.n for r in generate.md_bases(df).collect()}
    assert got == {("A", "A"): 2, ("A", "C"): 1, ("G", "G"): 1, ("T", "T"): 2, ("C", "C"): 1, ("STALE", ""): 1}


def test_md_matrix_reads_whole_contigs(spark, tmp_path):
    texts = ["acgtz" * 83 + "ca", "ttg", "a", "", None, "gattaca" * 60]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    c = inputs.contigs(spark, str(tmp_path))
    r = plans.md_reads(c).collect()
    joined = {}
    for x in sorted(r, key=lambda x: x.tile_start):
        joined[x.contig] = joined.get(x.contig, "") + x.seq
    assert joined == {x.contig: x.seq for x in c.collect() if x.seq}
    assert len({(x.cigar, x.md) for x in r}) > 5
    aligned = sum(int(n) for x in r for n in re.findall(r"(\d+)M", x.cigar))
    assert all(sum(map(int, re.findall(r"(\d+)[MIS]", x.cigar))) == len(x.seq) for x in r)
    got = plans.md_mismatch_matrix(spark, str(tmp_path)).collect()
    assert sum(x.n for x in got) == aligned and not any(x.ref == "STALE" for x in got)
    assert sum(x.n for x in got if x.ref != x.read) == len(r)


def test_smoothing_fills_gaps(spark):
    h = spark.createDataFrame([(100 + 7 * i, 1 + i % 3) for i in range(20)], "len long, n long")
    got = fit.smoothed(h, "len").collect()
    assert [r.len for r in sorted(got)] == list(range(100, 234)) and all(r.weight > 0 for r in got)
    assert fit.smoothed(h.limit(3), "len").count() == 3


def test_intervals_by_hand(spark):
    i = spark.createDataFrame([("c", 0, 10), ("c", 5, 700), ("c", 700, 701), ("d", 3, 3)], "contig string, start long, end long")
    assert sorted((r.start, r.end, r.depth) for r in intervals.depth(i).collect()) == [(0, 5, 1), (5, 10, 2), (10, 701, 1)]
    p = spark.createDataFrame([("c", 0), ("c", 700), ("c", 701), ("d", 3)], "contig string, pos0 long")
    assert sorted(r.pos0 for r in intervals.points_in(p, i).collect()) == [0, 700]
    assert sorted(r.pos0 for r in intervals.points_in(p, i, anti=True).collect()) == [3, 701]
    pairs = intervals.overlaps(i.where("start = 5"), i).select("r_start", "lo", "hi").collect()
    assert sorted(map(tuple, pairs)) == [(0, 5, 10), (5, 5, 700)]
    runs = fit.runs(spark.createDataFrame([("c", "NNAC" + "N" * 9000 + "G")], "contig string, seq string"))
    assert sorted((r.start, r.end) for r in runs.collect()) == [(2, 4), (9004, 9005)]
