"""Stream ingest gives what the batch job gives."""

from pyspark.sql import functions as F

from genolake.streaming import ingest


def run(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return stream.sparkSession.table(name)


def test_findings_and_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.vcf").write_text("#CHROM\nc1\t5\t.\tA\tG\t9\tPASS\t.\nc1\tx\t.\tAZ\tG\t9\tPASS\t.\nc2\t7\n")
    lines = spark.readStream.text(str(tmp_path / "in")).select(F.lit("a").alias("file"), F.col("value").alias("text"))
    got = run(ingest.vcf_line_findings(lines), "findings", "append")
    assert sorted((r.text.split("\t")[0], r.rule) for r in got.collect()) == [("c1", "bad_position"), ("c1", "bad_reference"), ("c2", "bad_reference"), ("c2", "too_few_columns")]
    c = F.split("text", "\t")
    records = lines.where("text not like '#%'").select(F.get(c, F.lit(0)).alias("contig"), F.get(c, F.lit(3)).alias("ref"), F.get(c, F.lit(4)).alias("alt")).where("alt is not null")
    assert {(r.contig, r.type): r.n for r in run(ingest.variant_counts(records), "counts", "complete").collect()} == {("c1", "SNP"): 1, ("c1", "DEL"): 1}


def test_windowed_counts(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    got = run(ingest.windowed_counts(stream, "ts", "1 day", "1 hour", ["event_type"]), "windows", "complete")
    want = e.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
