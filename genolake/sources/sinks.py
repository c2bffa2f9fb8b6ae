"""Writers of genomic text formats: rows become lines, sorted by range, one part file a partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import general, phred_string


def fastq_lines(reads: DataFrame) -> DataFrame:
    """(value): four lines a read (name, seq, scores)."""
    return reads.select(F.concat_ws("\n", F.concat(F.lit("@"), F.col("name")), "seq", F.lit("+"), phred_string(F.col("scores"))).alias("value"))


def write_fastq(reads: DataFrame, path: str, order: list[str], parts: int) -> None:
    """Gzip part files that follow each other in `order`; gzip members may be concatenated. An existing path is refused."""
    sorted_ = reads.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    fastq_lines(sorted_).write.mode("errorifexists").option("compression", "gzip").text(path)


def vcf_lines(records: DataFrame) -> DataFrame:
    """(contig, pos, value) of records (contig, pos, id, ref, alt, qual, filter, info, gt, ref_depth, alt_depth); keys that repeat
    are written once."""
    depth = F.col("ref_depth") + F.col("alt_depth")
    af = F.when(depth > 0, F.format_string("%.4f", F.round(F.col("alt_depth") / depth, 4))).otherwise(".")
    sample = F.concat_ws(":", "gt", F.concat_ws(",", F.col("ref_depth").cast("string"), F.col("alt_depth").cast("string")), depth.cast("string"), af)
    r = records.dropDuplicates(["contig", "pos", "ref", "alt"])
    return r.select("contig", "pos", F.concat_ws("\t", "contig", F.col("pos").cast("string"), "id", "ref", "alt", F.col("qual").cast("string"), "filter", "info", F.lit("GT:AD:DP:AF"), sample).alias("value"))


def vcf_header(contigs: list[tuple[str, int]], inherited: list[str] = ()) -> list[str]:
    """Header lines: those inherited, then declarations that they lack. contigs: as many as the reference has."""
    # The VCF format's header lines.
    own = ['##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', '##FORMAT=<ID=AD,Number=R,Type=Integer,Description="Allele depths">', '##FORMAT=<ID=DP,Number=1,Type=Integer,Description="Depth">', '##FORMAT=<ID=AF,Number=A,Type=Float,Description="Allele fraction">']
    out = [x for x in inherited if x.startswith("##")] or ["##fileformat=VCFv4.3"]
    names = {x.split("ID=")[1].split(",")[0].rstrip(">") for x in out if x.startswith("##contig=")}
    out += [f"##contig=<ID={c},length={n}>" for c, n in contigs if c not in names]
    ids = {x.split("ID=")[1].split(",")[0] for x in out if x.startswith("##FORMAT=")}
    out += [x for x in own if x.split("ID=")[1].split(",")[0] not in ids]
    return [*out, "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tSAMPLE"]


def write_vcf(records: DataFrame, path: str, contigs: list[tuple[str, int]], parts: int) -> None:
    """Position-sorted part files, the header in one of its own that comes first."""
    write_vcf_lines(vcf_lines(records), vcf_header(contigs), [c for c, _ in contigs], path, parts)


def write_vcf_lines(lines: DataFrame, header: list[str], contigs: list[str], path: str, parts: int) -> None:
    """lines (contig, pos, value) under their header, in the order of the contigs; those of other contigs come last, by name."""
    spark = lines.sparkSession
    order = F.create_map(*[x for i, c in enumerate(contigs) for x in (F.lit(c), F.lit(i))]) if contigs else F.create_map().cast("map<string,int>")
    lines = lines.withColumn("ord", F.coalesce(order[F.col("contig")], F.lit(len(contigs))))
    head = spark.createDataFrame(list(enumerate(header)), "n int, value string").coalesce(1).sortWithinPartitions("n").select("value")
    head.write.mode("errorifexists").text(f"{path}/header")
    by = ["ord", "contig", "pos"]
    lines.repartitionByRange(parts, *by).sortWithinPartitions(*by, "value").select("value").write.mode("errorifexists").text(f"{path}/records")


def write_missed(records: DataFrame, reasons: Column, inherited: list[str], contigs: list[str], path: str, parts: int) -> None:
    """The misses, or the false calls, as a VCF of their own: the source's header with what it lacks, and the records with their reasons."""
    write_vcf_lines(missed_lines(records, reasons), missed_header(inherited, contigs), contigs, path, parts)


def merge_vcf_shards(spark: SparkSession, root: str, path: str, contigs: list[str], parts: int, expected: int | None = None) -> None:
    """The VCFs of the folders shard_* under root as one, sorted; the header is that of the first shard that has one. A shard without a
    file, or another number of shards than expected, is refused."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).inputFiles()
    listed = spark.createDataFrame([(x,) for x in names], "path string").select(F.regexp_extract("path", r"/(shard_[^/]*)/", 1).alias("shard"), F.lower("path").rlike(r"\.vcf(\.gz)?(/part-[^/]*)?$").alias("vcf")).where("shard != ''")
    shards = {r.shard: r.n for r in listed.groupBy("shard").agg(F.count_if("vcf").alias("n")).collect()}
    lone = sorted(s for s, n in shards.items() if not n)
    if lone or not shards or expected not in (None, len(shards)):
        raise ValueError(f"{len(shards)} shards, {expected if expected is not None else 'some'} expected; without a VCF: {', '.join(lone) or 'none'}")
    t = spark.read.option("recursiveFileLookup", "true").text(root).select("value", F.regexp_extract("_metadata.file_path", r"/(shard_[^/]*)/.*\.[vV][cC][fF]", 1).alias("shard"), F.monotonically_increasing_id().alias("at")).where("shard != ''")
    head = t.where(F.col("value").startswith("#"))
    first = head.agg(F.min("shard")).first()[0]
    header = [r.value for r in head.where(F.col("shard") == first).orderBy("at").collect()] if first else ["##fileformat=VCFv4.3"]
    c = F.split("value", "\t")
    lines = t.where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.get(c, F.lit(0)).alias("contig"), F.get(c, F.lit(1)).try_cast("long").alias("pos"), "value")
    write_vcf_lines(lines, header, contigs, path, parts)


def write_fasta(contigs: DataFrame, path: str, width: int = 60) -> None:
    """A header line and lines of `width` bases for each contig (contig, seq)."""
    cut = F.array_join(F.regexp_extract_all("seq", F.lit(f"(.{{1,{width}}})"), 1), "\n")
    contigs.select(F.concat(F.lit(">"), F.col("contig"), F.lit("\n"), cut).alias("value")).write.mode("errorifexists").text(path)


def write_fasta_tiles(tiles: DataFrame, path: str, parts: int, width: int = 60) -> None:
    """Part files that follow each other by (ord, tile) and are one FASTA together, from tiles (contig, ord, tile, seq) of which all but a contig's
    last hold a multiple of `width` bases. A row is a tile, so a chromosome is written by many tasks."""
    cut = F.array_join(F.regexp_extract_all("seq", F.lit(f"(.{{1,{width}}})"), 1), "\n")
    lines = F.when(F.col("tile") == 0, F.concat(F.lit(">"), F.col("contig"), F.lit("\n"), cut)).otherwise(cut)
    sorted_ = tiles.repartitionByRange(parts, "ord", "tile").sortWithinPartitions("ord", "tile")
    sorted_.select(lines.alias("value")).write.mode("errorifexists").text(path)


def tagged_fastq(reads: DataFrame, tag: str) -> DataFrame:
    """reads with their names under a tag, so that several sets can be one."""
    return reads.withColumn("name", F.concat(F.lit(f"{tag}_"), F.col("name")))


def missed_lines(records: DataFrame, reasons: Column) -> DataFrame:
    """(contig, pos, value): VCF lines of records (contig, pos, ref, alt) with their reasons in INFO."""
    info = F.concat(F.lit("REASON="), F.array_join(reasons, ","))
    return records.select("contig", "pos", F.concat_ws("\t", "contig", F.col("pos").cast("string"), F.lit("."), "ref", "alt", F.lit("."), F.lit("PASS"), info, F.lit("GT"), F.lit("0/1")).alias("value"))


def missed_header(inherited: list[str], contigs: list[str]) -> list[str]:
    """The source's declarations, and those of the reasons, the genotype and of contigs that it lacks."""
    out = [x for x in inherited if x.startswith("##")] or ["##fileformat=VCFv4.3"]
    held = "\n".join(out)
    # The VCF format's header lines.
    own = [("INFO=<ID=REASON,", '##INFO=<ID=REASON,Number=.,Type=String,Description="Why the record was missed">'), ("FORMAT=<ID=GT,", '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">')]
    out += [line for mark, line in own if mark not in held]
    out += [f"##contig=<ID={c}>" for c in dict.fromkeys(contigs) if f"##contig=<ID={c}," not in held and f"##contig=<ID={c}>" not in held]
    return [*out, "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tSAMPLE"]


def report_lines(metrics: DataFrame) -> DataFrame:
    """(contig, value): a line of the text report for each row of the comparison's metrics, ratios to four places or n/a."""
    share = lambda c: F.when(F.col(c).isNull(), "n/a").otherwise(F.format_string("%.4f", c))
    return metrics.select("contig", F.concat_ws("\t", "contig", *[F.col(c).cast("string") for c in ("tp", "fn", "fp")], share("precision"), share("recall"), share("f1")).alias("value"))


def write_report(metrics: DataFrame, path: str) -> None:
    """The metrics as JSON lines and as text. They are a row a contig."""
    metrics.coalesce(1).write.mode("errorifexists").json(f"{path}/json")
    report_lines(metrics).coalesce(1).sortWithinPartitions(F.col("contig") == "TOTAL", "contig").select("value").write.mode("errorifexists").text(f"{path}/txt")


def gc_bin_lines(windows: DataFrame, weights: DataFrame) -> DataFrame:
    """(gc, value): a tab-separated line for each percentage from windows (gc, coverage) and weights (gc, weight, fitted): how many windows, their median and
    mean coverage, the weight, and whether it was fitted or interpolated."""
    g = windows.groupBy("gc").agg(F.count("*").alias("n"), F.percentile("coverage", 0.5).alias("median"), F.avg("coverage").alias("mean"))
    three = lambda c: F.format_string("%.3f", F.round(F.round(F.coalesce(c, F.lit(0.0)), 9), 3))
    row = [F.col("gc").cast("string"), F.coalesce("n", F.lit(0)).cast("string"), three("median"), three("mean"), F.format_string("%.6f", "weight"), F.when(F.col("fitted"), "fitted").otherwise("interpolated")]
    return weights.join(F.broadcast(g), "gc", "left").select("gc", F.concat_ws("\t", *row).alias("value"))


#: Substitutions in the order of the bin report's columns.
CHANGES = [(a, b) for a in "ACGT" for b in "ACGT" if a != b]


def overlap_bin_lines(counts: DataFrame, bases: DataFrame, bins: int = 5) -> DataFrame:
    """(bin, value): a tab-separated line for each part of the read from counts (bin, ref, read, n) and bases (bin, n): which cycles, bases compared, errors, their
    rate, and the count of each substitution."""
    n = lambda a, b: F.coalesce(F.sum(F.when((F.col("ref") == a) & (F.col("read") == b), F.col("n"))), F.lit(0)).alias(f"{a}{b}")
    g = counts.groupBy("bin").agg(F.sum("n").alias("errors"), *[n(a, b) for a, b in CHANGES])
    all_ = bases.sparkSession.range(bins).withColumnRenamed("id", "bin").join(bases.withColumnRenamed("n", "bases"), "bin", "left").join(g, "bin", "left").fillna(0)
    text = lambda c: c.cast("long").cast("string")
    cycles = F.concat_ws("-", text(F.floor(F.col("bin") * 100 / bins)), text(F.floor((F.col("bin") + 1) * 100 / bins)))
    rate = F.format_string("%.6f", F.coalesce(F.try_divide(F.col("errors").cast("double"), F.col("bases").cast("double")), F.lit(0.0)))
    return all_.select("bin", F.concat_ws("\t", text(F.col("bin")), cycles, text(F.col("bases")), text(F.col("errors")), rate, *[text(F.col(f"{a}{b}")) for a, b in CHANGES]).alias("value"))


# The reports' column names.
GC_COLUMNS = ["gc_percent", "windows", "median", "mean", "weight", "source"]
OVERLAP_COLUMNS = ["bin", "cycles_pct", "bases", "errors", "error_rate", *[f"{a}>{b}" for a, b in CHANGES]]


def write_bins(lines: DataFrame, order: str, columns: list[str], path: str) -> None:
    """A report's lines (order, value) under its column names. Bins are a hundred at most."""
    head = lines.sparkSession.createDataFrame([(-1, "\t".join(columns))], "at long, value string")
    rows = head.unionByName(lines.select(F.col(order).cast("long").alias("at"), "value"))
    rows.coalesce(1).sortWithinPartitions("at").select("value").write.mode("errorifexists").text(path)


def summary_lines(measures: DataFrame, names: list[str]) -> DataFrame:
    """(name, value): a line for each measure of a one-row table, numbers as %g has them."""
    return measures.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("name"), F.concat_ws("\t", F.lit(n), F.coalesce(general(F.col(n).cast("double")), F.lit("n/a"))).alias("value")) for i, n in enumerate(names)])).alias("x")).select("x.name", "x.value")


def with_tag(info: Column, key: str, value: Column) -> Column:
    """INFO with a tag appended, in place of its older value."""
    kept = F.filter(F.split(F.coalesce(info, F.lit(".")), ";"), lambda x: (x != ".") & (x != "") & ~x.startswith(f"{key}="))
    return F.array_join(F.concat(kept, F.array(F.concat(F.lit(f"{key}="), value))), ";")
