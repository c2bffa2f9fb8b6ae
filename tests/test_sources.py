"""Readers and writers on small files."""

import gzip

import pytest
from pyspark.sql import functions as F

from genolake.functions import sequence, vcf
from genolake.operators import intervals
from genolake.sources import sinks, text


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first\nACGT\nNN\n>two\nac\n")
    got = {r.contig: r.seq for r in text.read_fasta(spark, str(tmp_path / "a.fa")).collect()}
    assert got == {"one": "ACGTNN", "two": "ac"}
    assert {r.contig: r.length for r in text.fasta_lengths(spark, str(tmp_path / "a.fa")).collect()} == {"one": 6, "two": 2}
    (tmp_path / "b.fa").write_text("ACGT\n>x\nA\n")
    with pytest.raises(Exception, match="not FASTA"):
        text.read_fasta(spark, str(tmp_path / "b.fa")).collect()


def test_vcf(spark, tmp_path):
    lines = ["##fileformat=VCFv4.3", "##contig=<ID=c1,length=9>", '##INFO=<ID=DP,Number=1,Type=Integer,Description="d">', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS"]
    lines += ["c1\t5\t.\ta\tG\t.\tPASS\tDP=3\tGT:AD\t1/1:0,7", "c1\t6\t.\tA\tG,T\t9\tPASS\t.\tGT\t0/1", "c1\t7\t.\tA\tG\t9.5\tPASS\t.", "c1\tx\t.\tA\tG\t9\tPASS\t."]
    (tmp_path / "a.vcf").write_text("\n".join(lines))
    got = text.read_vcf(spark, str(tmp_path / "a.vcf")).select("pos", "ref", "qual", "gt").collect()
    assert [tuple(r) for r in got] == [(5, "A", 0.0, "1/1"), (7, "A", 9.5, "0/1")]
    assert {(r.kind, r.id, r.type) for r in text.vcf_declared(spark, str(tmp_path / "a.vcf")).collect()} == {("contig", "c1", ""), ("INFO", "DP", "Integer")}


def test_bed_fastq_sam_matrix(spark, tmp_path):
    (tmp_path / "a.bed").write_text("c1 3 9 mut_rate=0.5\nc1\t-1\t4\nc2\t0\t2\n")
    assert sorted((r.contig, r.start, r.end, r.mut_rate) for r in text.read_bed(spark, str(tmp_path / "a.bed")).collect()) == [("c1", 3, 9, 0.5), ("c2", 0, 2, None)]
    with gzip.open(tmp_path / "a.fq.gz", "wt") as f:
        f.write("@r_10_20_7/1\nACGT\n+\nIIII\n@b\nAC\n+\nII\n")
    rows = text.read_fastq(spark, str(tmp_path / "a.fq.gz")).withColumn("f", text.fragment_of_name(F.col("name"))).orderBy("record").collect()
    assert [(r.name, r.seq, r.quality) for r in rows] == [("r_10_20_7/1", "ACGT", "IIII"), ("b", "AC", "II")]
    assert (rows[0].f.start, rows[0].f.end, rows[0].f.uniq) == (10, 20, "7") and rows[1].f is None
    (tmp_path / "a.sam").write_text("@HD\nr1\t99\tc1\t11\t60\t5S10M\t=\t40\t130\tACGTACGTACGTACG\tIIIIIIIIIIIIIII\tMD:Z:10\n")
    s = text.read_sam(spark, str(tmp_path / "a.sam")).withColumn("span", sequence.reference_span(F.col("cigar"))).withColumn("q", sequence.query_length(F.col("cigar"))).first()
    assert (s.pos0, s.tlen, s.md, s.span, s.q) == (10, 130, "10", 10, 15)
    (tmp_path / "m.tsv").write_text("9\t1\t2\t3\n1 9 1 1\n1 1 9 1\n0 0 0 9\n")
    m = {(r.ref, r.read): r.weight for r in text.read_matrix(spark, str(tmp_path / "m.tsv")).collect()}
    assert m["A", "A"] == 0 and m["A", "T"] == 3 and len(m) == 16
    (tmp_path / "c.tsv").write_text("cluster_id\tcellular_prevalence\n0\t0.5\n0\t0.7\n1\t1.0\n")
    assert sorted((r.cluster, round(r.ccf, 6), r.weight) for r in text.read_subclones(spark, str(tmp_path / "c.tsv")).collect()) == [("0", 0.6, 2.0), ("1", 1.0, 1.0)]


def test_writers(spark, tmp_path):
    reads = spark.createDataFrame([(f"r{i}", "ACGT", [40, 2, 30, 0], i) for i in range(20)], "name string, seq string, scores array<int>, pos long")
    sinks.write_fastq(reads, str(tmp_path / "fq"), ["pos"], 3)
    back = text.read_fastq(spark, str(tmp_path / "fq"))
    assert back.count() == 20 and back.first().quality == "I#?!"
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_fastq(reads, str(tmp_path / "fq"), ["pos"], 3)
    rec = spark.createDataFrame([("c2", 5, ".", "A", "G", 50.0, "PASS", "X=1", "0/1", 3, 1), ("c1", 9, ".", "A", "G", 50.0, "PASS", ".", "0/1", 0, 0), ("c1", 9, ".", "A", "G", 50.0, "PASS", ".", "0/1", 0, 0)], "contig string, pos long, id string, ref string, alt string, qual double, filter string, info string, gt string, ref_depth long, alt_depth long")
    sinks.write_vcf(rec, str(tmp_path / "v"), [("c1", 100), ("c2", 50)], 2)
    lines = [r.value for r in spark.read.text(str(tmp_path / "v" / "records")).collect()]
    assert sorted(lines)[0].endswith("GT:AD:DP:AF\t0/1:0,0:0:.") and len(lines) == 2 and "0.2500" in sorted(lines)[1]


def test_expressions(spark):
    r = spark.range(1).select(
        sequence.run_lengths(F.split(F.lit("M,M,I,M"), ",")).alias("runs"), sequence.reverse_complement(F.lit("AACG")).alias("rc"), sequence.fold(F.lit("acxR")).alias("fold"), sequence.resolve_ambiguity(F.lit("R"), F.lit(0.7)).alias("iupac"),
        vcf.genotype_string(F.lit(False), 3).alias("gt"), sinks.with_tag(F.lit("A=1;B=2"), "A", F.lit("9")).alias("info"), intervals.scaled_coverage(F.lit(2.5)).alias("cov"), sequence.phred_scores(F.lit("I!")).alias("q"), *[c.alias(n) for c, n in zip(sequence.clip_lengths(F.lit("3H5S10M7S")), ("left", "right"), strict=True)],
    ).first()
    assert (r.runs, r.rc, r.fold, r.iupac, r.gt, r.info, r.cov, r.q, r.left, r.right) == ("2M1I1M", "CGTT", "ACNN", "G", "1/0/0", "B=2;A=9", 3, [40, 0], 5, 7)
