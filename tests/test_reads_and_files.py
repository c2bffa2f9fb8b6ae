"""FASTA in tiles, clip sites, MD reports, quality populations, folders of files, the corpus of structural variants."""

import random

import pytest
from pyspark.sql import functions as F

from genolake.functions import sequence
from genolake.operators import breakpoints, corpus, kernel, mismatches, qualities, validate
from genolake.sources import sinks, text


def test_fasta_in_tiles(spark, tmp_path):
    r = random.Random(1)
    seqs = {"one": "".join(r.choice("ACGTN") for _ in range(200_003)), "two": "ac" * 30, "none": "", "long": "G" * 61_440}
    with open(tmp_path / "a.fa", "w") as f:
        for name, seq in seqs.items():
            f.write(f">{name} some words\n" + "".join(seq[i : i + 70] + ("\n\n" if i % 700 == 0 else "\r\n" if i % 770 == 0 else "\n") for i in range(0, len(seq), 70)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        tiles = text.fasta_tiles(spark, str(tmp_path / "a.fa"), 4096).collect()
        whole = {x.contig: x.seq for x in text.read_fasta(spark, str(tmp_path / "a.fa")).collect()}
        lengths = {x.contig: x.length for x in text.fasta_lengths(spark, str(tmp_path / "a.fa")).collect()}
        numbered = text.numbered(spark, str(tmp_path / "a.fa")).count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert whole == seqs and lengths == {k: len(v) for k, v in seqs.items()} and numbered > 2000
    assert sorted((x.contig, x.start, x.seq) for x in tiles) == sorted((c, i, s[i : i + 4096]) for c, s in seqs.items() for i in range(0, len(s), 4096))
    assert max(len(x.seq) for x in tiles) == 4096


def test_tiles_are_written_and_read_as_one(spark, tmp_path):
    seqs = {"b": "ACGTN" * 30_000, "a": "T" * 7}
    pieces = [(c, i, s[i : i + 997]) for c, s in seqs.items() for i in range(0, len(s), 997)]
    tiles = text.cut_tiles(spark.createDataFrame(pieces, "contig string, at long, text string"), ["contig"], 1200).withColumn("ord", F.col("contig"))
    sinks.write_fasta_tiles(tiles, str(tmp_path / "g"), 7)
    got = text.fasta_tiles(spark, str(tmp_path / "g"), joined=True).orderBy("ord", "tile").collect()
    assert [(x.contig, x.ord, x.start, x.seq) for x in got if x.contig == "a"] == [("a", 1, 0, "T" * 7)]
    assert "".join(x.seq for x in got if x.contig == "b") == seqs["b"]


def test_large_tiles_serve_as_contigs(spark):
    seq = "".join(random.Random(3).choice("ACGT") for _ in range(30_000))
    contigs = spark.createDataFrame([("c", seq), ("d", "ACGT")], "contig string, seq string")
    large = kernel.tiles(contigs, 12_288).select("contig", "tile", F.col("tile_start").alias("start"), "seq")
    key = lambda df: sorted(tuple(x) for x in df.select("contig", "tile", "tile_start", "seq_start", "seq").collect())
    for before, after in ((0, 0), (3, 5), (0, 100)):
        assert key(kernel.tiles(large, 4096, before, after)) == key(kernel.tiles(contigs, 4096, before, after))
    spans = spark.createDataFrame([("c", p, 60) for p in (0, 4090, 12_280, 24_570, 29_990)], "contig string, at long, n int")
    got = {x["at"]: x.bases for x in kernel.reference_bases(spans, large, "at", "n", 60).collect()}
    assert got == {p: seq[p : p + 60] for p in (0, 4090, 12_280, 24_570, 29_990)}


def test_clip_sites_and_depth(spark):
    r = random.Random(5)
    reads = []
    for _ in range(400):
        p = r.choice([100, 100, 70_000, r.randrange(200)])
        left, right = r.choice([0, 0, 5, 25]), r.choice([0, 0, 30])
        reads.append(("c", p, f"{'2H' if left else ''}{left}S50M2D10M".replace("0S", "", not left) + (f"{right}S" if right else ""), r.choice([0, 60]), left, right))
    df = spark.createDataFrame([x[:4] for x in reads], "contig string, pos0 long, cigar string, mapq int")
    want = {}
    for _, p, _, _, left, right in reads:
        for side, at, clip in (("L", p, left), ("R", p + 62, right)):
            if clip >= 20:
                want[side, at] = want.get((side, at), 0) + 1
    want = {k: n for k, n in want.items() if n >= 3}
    got = breakpoints.candidate_sites(df, 20, 3).withColumn("class", breakpoints.site_class()).collect()
    assert {(x.side, x.pos0): x.support for x in got} == want
    for x in got:
        probe = x.pos0 - (x.side == "R")
        over = [m for _, p, _, m, _, _ in reads if p <= probe < p + 62]
        assert (x.depth, x.mapq0) == (len(over), over.count(0)) and x.support <= x.depth
        assert x["class"] == ("repeat-like" if over.count(0) >= 0.5 * len(over) else "junction-like" if x.support >= 0.3 * len(over) else "minority-support")


def test_mutual_nearest(spark):
    a, b = [10, 14, 40, 100, 200], [12, 45, 36, 103, 98, 900]
    frames = [spark.createDataFrame([("c", p) for p in x] + [("d", 1)], "contig string, pos0 long") for x in (a, b)]
    got = sorted((x.contig, x.pos0, x.r_position) for x in breakpoints.mutual_nearest(*frames, 10).collect())
    # 12 lies two from 10 and from 14, and takes the lower; 40 takes 36 of two equally near
    assert got == [("c", 10, 12), ("c", 40, 36), ("c", 100, 98), ("d", 1, 1)]
    sites = spark.createDataFrame([("c", 10, "x"), ("c", 10, "y"), ("c", 14, "y"), ("c", 200, "x")], "contig string, pos0 long, class string")
    rows = {x["class"]: (x.sites, x.near, x.matched) for x in breakpoints.near_truth(sites, frames[1], 10).collect()}
    assert rows == {"x": (2, 1, 1), "y": (2, 2, 0), "ALL": (4, 3, 1)}
    regions = spark.createDataFrame([("c", 0, 50), ("c", 30, 60), ("e", 0, 10)], "contig string, start long, end long")
    x = breakpoints.chance_near(regions, frames[1], 3).first()
    near = {p for t in (12, 45, 36) for p in range(t - 3, t + 4)}
    assert (x.bases, x.near) == (70, len(near)) and x.share == pytest.approx(len(near) / 70)


def test_md_report(spark):
    rows = [
        # 2S, 5M, 1I, 2M, 2D, 3M: mismatches at the third base, and, behind the insertion and the deletion, at the last
        ("c", 10, "2S5M1I2M2D3M", "TTACGTAGCATTG", "2A4^CC2A"),
        ("c", 10, "4M", "ACGT", "1C2"),
        ("c", 10, "4M", "ANGT", "1G2"),
        ("c", 10, "4M", "ACGT", None),
        ("c", 10, "4M", "ACGT", "9A3"),
        (None, 10, "4M", "ACGT", "0T3"),
    ]
    reads = spark.createDataFrame(rows, "contig string, pos0 long, cigar string, seq string, md string")
    known = spark.createDataFrame([("c", 12), ("c", 12), ("d", 21)], "contig string, pos0 long")
    got = {(x.ref, x.read): (x.n, x.masked, x.stale) for x in mismatches.md_report(reads, known).collect()}
    assert got == {("A", "G"): (1, 1, 0), ("C", "C"): (0, 0, 1)}
    assert {(x.ref, x.read): x.n for x in mismatches.md_report(reads, known.limit(0)).where("n > 0").collect()} == {("A", "G"): 2}


def test_quality_populations(spark):
    r = random.Random(2)
    reads = [(1 + i % 2, [r.choice([3, *range(22, 41)]) if i % 3 else r.randrange(2, 20) for _ in range(60)]) for i in range(300)] + [(1, [40] * 10), (2, None), (1, [])]
    df = spark.createDataFrame(reads, "mate int, scores array<int>")
    got = {(x.mate, x.degraded, x.pos, x.prev, x.next): x.n for x in qualities.tensor(df).collect()}
    want = {}
    for mate, q in reads:
        low = bool(q) and len(q) >= 50 and sum(q[-50:]) / 50 < 25
        for i, s in enumerate(q or []):
            key = (mate, low, i + 1, q[i - 1] if i else -1, s)
            want[key] = want.get(key, 0) + 1
    assert got == want
    model = qualities.shares(qualities.covering(qualities.tensor(df)))
    options = len({k[4] for k in want})
    asked = [(1, False, 5, 40, 40), (1, False, 5, 40, 999), (2, True, 7, 999, 3), (1, False, 61, 2, 2)]
    found = {tuple(x)[:5]: x.share for x in qualities.share_of(spark.createDataFrame(asked, "mate long, degraded boolean, pos long, prev int, next int"), model).collect()}
    row = sum(n for k, n in want.items() if k[:4] == (1, False, 5, 40))
    assert found[asked[0]] == pytest.approx(want[asked[0]] / row) and found[asked[1]] == 0 and found[asked[2]] == pytest.approx(1 / options) and found[asked[3]] is None
    short = spark.createDataFrame([*reads, *[(2, [3] * 70)] * 2], "mate int, scores array<int>")
    with pytest.raises(Exception, match="positions were observed"):
        qualities.covering(qualities.tensor(short)).collect()
    with pytest.raises(Exception, match="no degraded"):
        qualities.covering(qualities.tensor(df.where("mate = 1").limit(1)).where("mate = 1")).collect()
    one, two = (qualities.shares(qualities.tensor(df.where(f"mate = {k}").withColumn("mate", F.lit(1)), split=False)) for k in (1, 2))
    assert {x.mate for x in qualities.with_mate(one, one).select("mate").distinct().collect()} == {1, 2}
    with pytest.raises(Exception, match="options differ"):
        qualities.with_mate(one, two.where("next > 5")).collect()


GOOD = ["##fileformat=VCFv4.3", "##contig=<ID=c1,length=9>", '##INFO=<ID=DP,Number=1,Type=Integer,Description="d">', '##INFO=<ID=AF,Number=A,Type=Float,Description="a, b">', "##INFO=<ID=DB,Number=0,Type=Flag>", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS"]


def test_a_mixed_folder(spark, tmp_path):
    row = lambda c, p, ref="A", info=".", more="\tGT\t0/1": f"{c}\t{p}\t.\t{ref}\tG\t.\tPASS\t{info}{more}"
    (tmp_path / "sub").mkdir()
    files = {
        "good.vcf": [*GOOD, row("c1", 5, info="DP=3;AF=0.1,.;DB"), row("c1", 5), row("c1", 9)],
        "bad.VCF": [*GOOD, row("c1", 9), row("c1", "x"), row("c1", 5), row("c2", 1), row("c1", 7, "AZ"), row("c1", 8, info="DP=x;ZZ;AF=1,y"), row("c1", 9, more=""), "", "c1\t3"],
        "bare.vcf": ["##fileformat=VCFv4.3", row("c1", 5)],
        "sub/good.fastq": ["@a", "ACGT", "+", "IIII"],
        "sub/bad.fq": ["@a\r", "ACGT\r", "+\r", "IIII\r", "b", "AC!T", "-", "II", "@c", "A", "+", "\x7f", "@d", "A"],
        "empty.fastq": [],
        "notes.txt": ["hello"],
    }
    for name, lines in files.items():
        (tmp_path / name).write_text("".join(x + "\n" for x in lines), newline="")
    found, verdict = validate.validate_folder(spark, str(tmp_path))
    name = lambda p: p.split(str(tmp_path))[1][1:]
    got = sorted((name(x.file), x.line, x.severity, x.rule) for x in found.collect())
    assert got == sorted(
        [("bad.VCF", n, s, rule) for n, s, rule in ((8, "ERROR", "bad_position"), (9, "ERROR", "unsorted"), (10, "WARNING", "contig_not_declared"), (11, "ERROR", "bad_reference"), (11, "ERROR", "contig_again"), (12, "ERROR", "info_not_declared"), (12, "WARNING", "info_type"), (13, "ERROR", "column_count"), (15, "ERROR", "column_count"))]
        + [("bare.vcf", 1, "ERROR", "no_column_line"), ("empty.fastq", 1, "ERROR", "no_records"), ("notes.txt", 1, "ERROR", "unknown_format")]
        + [("sub/bad.fq", n, s, rule) for n, s, rule in ((1, "TOLERATED", "carriage_return"), (14, "ERROR", "truncated_record"), (5, "ERROR", "name_without_at"), (7, "ERROR", "plus_line"), (8, "ERROR", "length_mismatch"), (6, "ERROR", "bad_base"), (12, "WARNING", "bad_quality"))]
    )
    passed = {name(x.file): (x.errors, x.warnings, x.passed) for x in verdict.collect()}
    assert {k for k, v in passed.items() if v[2]} == {"good.vcf", "sub/good.fastq"} and len(passed) == len(files) and passed["bad.VCF"][:2] == (7, 2)


def test_folders_that_are_files(spark):
    paths = ["/a/x.vcf.gz", "/a/x.FQ/part-0001.txt", "/a/file=3.vcf/part-7", "/a/b.bam", "/a/n.txt"]
    got = {x.p: (x.f, x.k) for x in spark.createDataFrame([(p,) for p in paths], "p string").select("p", validate.file_of(F.col("p")).alias("f"), validate.format_of(validate.file_of(F.col("p"))).alias("k")).collect()}
    assert got == {paths[0]: (paths[0], "vcf"), paths[1]: ("/a/x.FQ", "fastq"), paths[2]: ("/a/file=3.vcf", "vcf"), paths[3]: (paths[3], "bam"), paths[4]: (paths[4], None)}


def test_corpus_of_structural_variants(spark):
    j = spark.createDataFrame(
        [
            ("s1", "1", 1000, "1", 9000, "h2hINV"), ("s1", "1", 1100, "1", 9050, "t2tINV"), ("s1", "1", 1300, "1", 9300, "t2tINV"), ("s2", "1", 1010, "1", 9010, "t2tINV"),
            ("s1", "2", 50, "2", 5000, "h2hINV"), ("s1", "3", 10, "3", 700, "t2tINV"), ("s1", "chrX", 5, "X", 800, "DEL"), ("s1", "4", 5, "5", 9, "TRA"), ("s1", "4", 5, "4", 20, "DUP"), ("s9", "4", 5, "4", 2000, "DUP"), ("s1", "6", None, "6", 9, "DEL"),
        ],
        "sample string, chrom1 string, start1 long, chrom2 string, start2 long, svclass string",
    )
    segments = spark.createDataFrame([("s1", "1", 100, 900, 2), ("s1", "1", 100, 900, 3), ("s2", "1", 0, 500, 0), ("s9", "1", 0, 500, 5)], "sample string, contig string, start long, end long, cn int")
    ploidy = spark.createDataFrame([("s1", 3.2)], "sample string, ploidy double")
    inserted = spark.createDataFrame([("1", 77, "SVLEN=-300;SVTYPE=INS"), ("1", 78, "SVTYPE=INS;SVLEN=9"), ("1", 79, "SVTYPE=DEL;SVLEN=300"), ("1", 80, "SVTYPE=INS")], "contig string, pos long, info string")
    samples = spark.createDataFrame([("s1", "BRCA-US"), ("s2", "BRCA-UK"), ("s9", "LIVER"), (None, "BRCA")], "sample string, project string")
    got = sorted((x.contig, x.place, x.pos, x.info, x.gt) for x in corpus.corpus(j, segments, ploidy, inserted, samples, ["BRCA"]).collect())
    assert got == [
        ("chr1", 0, 1, "SVTYPE=CNV;END=500;CN=0", "1/1"), ("chr1", 1, 77, "SVTYPE=INS;SVLEN=300", "0/1"), ("chr1", 2, 101, "SVTYPE=CNV;END=900;CN=2", "0/1"), ("chr1", 3, 1001, "SVTYPE=INV;END=9050;EVENTS=2", "0/1"),
        ("chr2", 0, 51, "SVTYPE=INV;END=5000", "0/1"), ("chr4", 0, 6, "SVTYPE=BND", "0/1"), ("chrX", 0, 6, "SVTYPE=DEL;END=800", "0/1"),
    ]
    assert [x.c for x in spark.createDataFrame([("chrM",), ("chr10",), ("chrUn",), ("chr2",), ("chrX",)], "c string").orderBy(corpus.contig_order(F.col("c"))).collect()] == ["chr2", "chr10", "chrX", "chrM", "chrUn"]


def test_number_format(spark):
    values = [0.0, 1.0, -2.5, 0.1 + 0.2, 1e-4, 1.23456789e-5, 123456.0, 1234567.0, 0.98461234, 1e300, 999999.5, 100000.0, -0.00012345678, None, float("nan"), float("inf")]
    got = [r.v for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").select("i", sequence.general(F.col("x")).alias("v")).orderBy("i").collect()]
    assert got == [None if v is None else f"{v:g}" for v in values]


def test_missed_records_reports_and_shards(spark, tmp_path):
    rec = spark.createDataFrame([("c2", 7, "A", "G", ["x", "y"]), ("c1", 9, "A", "T", ["unknown"]), ("zz", 1, "A", "T", ["z"])], "contig string, pos long, ref string, alt string, reasons array<string>")
    sinks.write_missed(rec, F.col("reasons"), GOOD, ["c1", "c2"], str(tmp_path / "fn"), 2)
    head = (next((tmp_path / "fn" / "header").glob("part*"))).read_text().splitlines()
    assert head[:2] == GOOD[:2] and any("ID=REASON" in x for x in head) and "##contig=<ID=c2>" in head and head[-1].startswith("#CHROM")
    lines = spark.read.text(str(tmp_path / "fn" / "records")).select("value", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")).orderBy("f", "i").collect()
    assert [x.value.split("\t")[:2] + [x.value.split("\t")[7]] for x in lines] == [["c1", "9", "REASON=unknown"], ["c2", "7", "REASON=x,y"], ["zz", "1", "REASON=z"]]
    for name, rows in (("shard_1", [("c2", 5), ("c1", 3)]), ("shard_2", [("c1", 1), ("c2", 4)])):
        (tmp_path / "s" / name).mkdir(parents=True)
        (tmp_path / "s" / name / "s.vcf").write_text("\n".join([*GOOD, *(f"{c}\t{p}\t." for c, p in rows)]) + "\n")
    sinks.merge_vcf_shards(spark, str(tmp_path / "s"), str(tmp_path / "all"), ["c1", "c2"], 2, 2)
    merged = [x for p in sorted((tmp_path / "all" / "records").glob("part*")) for x in p.read_text().splitlines()]
    assert [tuple(x.split("\t")[:2]) for x in merged] == [("c1", "1"), ("c1", "3"), ("c2", "4"), ("c2", "5")]
    assert next((tmp_path / "all" / "header").glob("part*")).read_text().splitlines() == GOOD
    with pytest.raises(ValueError, match="2 shards, 3 expected"):
        sinks.merge_vcf_shards(spark, str(tmp_path / "s"), str(tmp_path / "more"), ["c1"], 1, 3)
    (tmp_path / "s" / "shard_3").mkdir()
    (tmp_path / "s" / "shard_3" / "log.txt").write_text("x")
    with pytest.raises(ValueError, match="without a VCF: shard_3"):
        sinks.merge_vcf_shards(spark, str(tmp_path / "s"), str(tmp_path / "more"), ["c1"], 1)
    counts = spark.createDataFrame([(0, "A", "C", 3), (4, "G", "T", 1)], "bin long, ref string, read string, n long")
    bins = {r.bin: r.value for r in sinks.overlap_bin_lines(counts, spark.createDataFrame([(0, 6), (4, 3), (2, 0)], "bin long, n long")).collect()}
    assert bins[0] == "0\t0-20\t6\t3\t0.500000\t3" + "\t0" * 11 and bins[1] == "1\t20-40\t0\t0\t0.000000" + "\t0" * 12 and bins[4].startswith("4\t80-100\t3\t1\t0.333333")
    w = spark.createDataFrame([(40, 1.0), (40, 2.5)], "gc int, coverage double")
    gc = sinks.gc_bin_lines(w, spark.createDataFrame([(40, 1.0, True), (41, 0.5, False)], "gc int, weight double, fitted boolean"))
    sinks.write_bins(gc, "gc", sinks.GC_COLUMNS, str(tmp_path / "gc"))
    assert next((tmp_path / "gc").glob("part*")).read_text().splitlines() == ["gc_percent\twindows\tmedian\tmean\tweight\tsource", "40\t2\t1.750\t1.750\t1.000000\tfitted", "41\t0\t0.000\t0.000\t0.500000\tinterpolated"]
    assert [r.value for r in sinks.summary_lines(spark.createDataFrame([(543, 0.98461111, None)], "n long, pearson double, bias double"), ["n", "pearson", "bias"]).collect()] == ["n\t543", "pearson\t0.984611", "bias\tn/a"]


def test_breakend_pairs_and_mate_cycles(spark):
    from genolake.operators import compare
    from genolake.operators import reads as aligned

    b = spark.createDataFrame([("c1", 5, "c2", 9, "x"), ("c2", 9, "c1", 5, "w"), ("c1", 5, None, None, "n"), ("c1", 5, "c1", 4, "z")], "contig string, pos long, mate_contig string, mate_pos long, id string")
    got = sorted((tuple(r.low), tuple(r.high), r.first, r.n) for r in compare.breakend_pairs(b).collect())
    assert got == [(("c1", 4), ("c1", 5), "z", 1), (("c1", 5), ("c2", 9), "w", 2)]
    seq = "ACGTACGTACGTACGTACGT"
    contigs = spark.createDataFrame([("c", seq)], "contig string, seq string")
    rows = [("c", "q", True, 0, "10M", seq[:10], False), ("c", "q", False, 5, "3M2D5M", seq[5:8] + seq[10:14] + "T", True)]
    pairs = aligned.mates(spark.createDataFrame(rows, "contig string, name string, first boolean, pos0 long, cigar string, seq string, reverse boolean"), ["pos0", "cigar", "seq", "reverse"])
    got = sorted((r.pos0, r.bin_a, r.bin_b, r.base_a, r.base_b, r.frame) for r in aligned.mate_overlaps(pairs, contigs).collect())
    assert got == [(5, 2, 4, "C", "C", "C"), (6, 3, 3, "G", "G", "G"), (7, 3, 3, "T", "T", "T")]
    with pytest.raises(Exception, match="share more than 2"):
        aligned.mate_overlaps(pairs, contigs, most=2).collect()
