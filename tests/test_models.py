"""Models as tables, refusals, and numbering of lines, by hand."""

import pytest
from pyspark.sql import functions as F

from genolake.functions.keyed import lognormal, poisson
from genolake.operators import compare, fit, kernel, models, reads
from genolake.sources import sinks, text
from genolake.staging import join_hot, join_small, size_of, staged


def test_cycle_groups_by_hand(spark):
    counts = spark.createDataFrame([(0, "A", "C", 6), (1, "A", "C", 3), (1, "G", "T", 2), (2, "A", "C", 1), (3, "A", "C", 1)], "bin long, ref string, read string, n long")
    bases = spark.createDataFrame([(i, 100) for i in range(4)], "bin long, n long")
    got = {(r.ref, r.read): r.weight for r in models.per_cycle_spectrum(counts, bases, 5).collect()}
    # bin 0 is a group; bin 1 another, to which the rest (2 and 3) goes
    assert got == pytest.approx({("A", "C"): 6 / 100 + 5 / 300 * 3, ("G", "T"): 2 / 300 * 3})
    one = {(r.ref, r.read): r.weight for r in models.per_cycle_spectrum(counts, bases, 1000).collect()}
    assert one == pytest.approx({("A", "C"): 11 / 400 * 4, ("G", "T"): 2 / 400 * 4})


def test_refusals(spark, tmp_path):
    few = spark.createDataFrame([("A", "C", 3)], "ref string, read string, n long")
    with pytest.raises(Exception, match="too few disagreements: 3"):
        models.fitted_overlaps(few).collect()
    bins = spark.createDataFrame([(0, 10, 2, 8, 0.1)], "bin long, planted long, scored long, unscored long, mae double")
    with pytest.raises(Exception, match="80.0 % of the planted"):
        compare.gated(bins).collect()
    assert compare.gated(bins, 0.9).count() == 1
    with pytest.raises(Exception, match="three variant"):
        models.variant_shares(spark.createDataFrame([("SNP", 1), ("INS", 2)], "type string, n long")).collect()
    with pytest.raises(ValueError, match="band"):
        reads.in_band(F.lit(1), 3, 2)
    with pytest.raises(Exception, match="too few reads"):
        fit.trimmed(spark.createDataFrame([(100, 1)], "len long, n long"), "len").collect()
    part = {"rates": spark.createDataFrame([(0.5,)], "rate double")}
    models.write_model(part, str(tmp_path / "m"))
    with pytest.raises(Exception, match="(?i)exists"):
        models.write_model(part, str(tmp_path / "m"))
    assert models.read_model(spark, str(tmp_path / "m"))["rates"].first().rate == 0.5
    spark.createDataFrame([(models.FORMAT_VERSION + 1, ["rates"])], "format_version int, parts array<string>").write.json(str(tmp_path / "n" / "stamp"))
    with pytest.raises(ValueError, match="newer"):
        models.read_model(spark, str(tmp_path / "n"))
    with pytest.raises(ValueError, match="no sv"):
        models.grafted(part, {}, "sv")


def test_positions_up_to_the_first_gap(spark):
    t = spark.createDataFrame([(1, -1, 3, 1), (2, 3, 3, 1), (4, 3, 3, 1)], "pos long, prev int, next int, n long")
    assert models.trained_positions(t).first().n == 2
    assert [r.pos for r in models.untrained(t, 5).orderBy("pos").collect()] == [3, 5]


def test_lines_are_numbered_over_splits(spark, tmp_path):
    lines = [f"line {i}" for i in range(5000)]
    for name in "ab":
        (tmp_path / f"{name}.txt").write_text("\n".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = text.numbered(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for name in "ab":
        own = sorted((r.line_no, r.text) for r in got if r.file.endswith(f"{name}.txt"))
        assert own == list(enumerate(lines))


def test_kernel_by_hand(spark):
    c = spark.createDataFrame([("x", "ACGTNACGGGT"), ("y", "GGC"), ("z", ""), ("w", None)], "contig string, seq string")
    assert {r.kmer: r.n for r in kernel.count_kmers(c, 3).collect()} == {"ACG": 2, "CGT": 1, "CGG": 1, "GGG": 1, "GGT": 1, "GGC": 1}
    assert [(r.contig, r.pos0, r.window) for r in kernel.runs_of(c, 3).collect()] == [("x", 6, "CGGGT")]
    t = kernel.tiles(c, 4, 1, 2).collect()
    assert [(r.contig, r.tile, r.tile_start, r.seq_start, r.seq) for r in t] == [("x", 0, 0, 0, "ACGTNA"), ("x", 1, 4, 3, "TNACGGG"), ("x", 2, 8, 7, "GGGT"), ("y", 0, 0, 0, "GGC")]
    spans = spark.createDataFrame([("x", 3, 5), ("x", 9, 5), ("y", 0, 2), ("q", 0, 1)], "contig string, start long, n long")
    assert {(r.contig, r.start): r.bases for r in kernel.reference_bases(spans, c, "start", "n", 5, 4).collect()} == {("x", 3): "TNACG", ("x", 9): "GT", ("y", 0): "GG"}
    assert [(r.pos0, r.gc) for r in kernel.gc_before(c.where("contig = 'x'"), 4).collect()] == [(0, 0), (4, 2), (8, 4)]


def test_blocks_of_a_cigar(spark):
    df = spark.createDataFrame([("3S4M1I2M5D1M2N3M2H", 100)], "cigar string, pos0 long")
    got = df.select(reads.blocks(F.col("cigar"), F.col("pos0")).alias("b")).first().b
    assert [(b.start, b.end, b.at) for b in got] == [(100, 104, 3), (104, 106, 8), (111, 112, 10), (114, 117, 11)]


def test_missed_header():
    got = sinks.missed_header(["##fileformat=VCFv4.2", "##contig=<ID=a,length=5>"], ["a", "b", "b"])
    assert got[:2] == ["##fileformat=VCFv4.2", "##contig=<ID=a,length=5>"] and got[-2] == "##contig=<ID=b>" and sum("REASON" in x for x in got) == 1


def test_draws(spark):
    u = spark.range(4000).select(((F.col("id") + 0.5) / 4000).alias("u"))
    k = u.select(poisson(F.col("u"), 3.0).alias("k")).agg(F.avg("k").alias("m"), F.var_pop("k").alias("v")).first()
    assert abs(k.m - 3) < 0.01 and abs(k.v - 3) < 0.05
    assert spark.range(1).select(lognormal(F.lit(0.0), F.lit(0.0), 2.0, 1.0).alias("x")).first().x == pytest.approx(7.389056)


def test_joins_by_size_and_by_hot_keys(spark):
    rows = staged(spark.range(5000).select(F.when(F.col("id") < 4000, 7).otherwise(F.col("id") % 50).cast("long").alias("k"), "id"), "rows")
    side = staged(rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top")).where("k != 3"), "side")
    assert 24 * 5000 <= size_of(rows) <= 64 * 5000
    want = rows.join(side, "k").select("k", "id", "top")
    for got in (join_hot(rows, side, "k", "n"), join_small(rows, side, ["k"], "inner"), join_small(rows, side, ["k"], "inner", 0)):
        got = got.select("k", "id", "top")
        assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    assert join_hot(rows, side, "k", "n", "left").count() == 5000
