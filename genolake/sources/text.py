"""Readers of genomic text formats. Lines come from Spark's text reader (gzip by extension); records are typed projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..staging import join_small, staged

#: Lines of a file over which one task sums.
LINES = 1_000_000
#: Bases of a tile: whole lines of 60, and whole tiles of the kernel's 4096.
BASES = 61_440


def _splits(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """(file, split, at, text): lines with the file's block that they were read from, and an order inside it."""
    t = spark.read.options(**options).text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    return t.select(F.col("file_path").alias("file"), F.col("file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"))


def numbered(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """(file, line_no, text): lines in file order, from 0 in each file. options: of Spark's text reader. A block's lines are numbered where they are read; what lies
    before a block is the sum of the counts of the file's earlier blocks, a row each."""
    t = _splits(spark, path, **options)
    counts = t.groupBy("file", "split").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    counts = staged(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"), "splits")
    return join_small(t, counts, ["file", "split"], "inner").select("file", (F.col("before") + F.col("at") - F.col("first")).alias("line_no"), "text")


def _fasta_lines(spark: SparkSession, path: str, joined: bool) -> tuple[DataFrame, DataFrame]:
    """Lines of bases (file, ord, at, text), `at` their offset in the contig, and contigs (file, ord, contig, length). A block's lines are scanned
    by itself; headers and bases before it come from sums of the blocks, a row each."""
    head = F.col("text").startswith(">")
    t = _splits(spark, path).withColumn("text", F.trim("text")).where("text != ''")
    t = t.withColumn("head", head.cast("long")).withColumn("long", F.when(head, 0).otherwise(F.length("text")).cast("long"))
    group = F.lit("").alias("group") if joined else F.col("file").alias("group")
    own = t.groupBy("file", "split").agg(F.sum("head").alias("n_head"), F.sum("long").alias("n_long"))
    past = Window.partitionBy("group").orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1)
    carry = own.select("file", "split", group).join(own, ["file", "split"]).select("group", "file", "split", *[F.coalesce(F.sum(c).over(past), F.lit(0)).alias(f"past_{c}") for c in ("n_head", "n_long")])
    inside = Window.partitionBy("file", "split").orderBy("at")
    t = t.withColumn("ord", F.sum("head").over(inside)).withColumn("upto", F.sum("long").over(inside)).join(carry, ["file", "split"])
    t = t.select("group", (F.col("ord") + F.col("past_n_head")).alias("ord"), (F.col("upto") + F.col("past_n_long")).alias("upto"), "head", "long", "text")
    bad = F.when(F.col("ord") == 0, F.raise_error(F.lit("not FASTA: text before the first header"))).otherwise(True).cast("boolean")
    t = staged(t.where(bad), "lines")
    heads = t.where("head = 1").select("group", "ord", F.col("upto").alias("base"), F.regexp_extract("text", r"^>\s*(\S+)", 1).alias("contig"))
    sums = t.groupBy("group", "ord").agg(F.sum("long").alias("length"))
    heads = staged(heads.join(sums, ["group", "ord"]), "headers")
    lines = join_small(t.where("head = 0"), heads.select("group", "ord", "base"), ["group", "ord"], "inner")
    return lines.select("group", "ord", (F.col("upto") - F.col("long") - F.col("base")).alias("at"), "text"), heads.select("group", "ord", "contig", "length")


def cut_tiles(pieces: DataFrame, key: list[str], tile: int = BASES) -> DataFrame:
    """(key, tile, start, seq): tiles of `tile` bases put together from pieces (key, at, text) that follow each other without gaps, at: a piece's
    offset. No row holds more than a tile, or a piece."""
    first, last = F.floor(F.col("at") / tile), F.floor((F.col("at") + F.length("text") - 1) / tile)
    t = pieces.where("text != ''").withColumn("tile", F.explode(F.sequence(first, last)))
    a, b = F.greatest(F.col("tile") * tile - F.col("at"), F.lit(0)), F.least((F.col("tile") + 1) * tile - F.col("at"), F.length("text").cast("long"))
    # as bytes, so that a place in a long piece is found at once
    part = F.substr(F.col("text").cast("binary"), (a + 1).cast("int"), (b - a).cast("int")).cast("string")
    g = t.select(*key, "tile", (F.col("at") + a).alias("at"), part.alias("part")).groupBy(*key, "tile").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("parts"))
    return g.select(*key, "tile", (F.col("tile") * tile).alias("start"), F.array_join(F.col("parts.part"), "").alias("seq"))


def fasta_tiles(spark: SparkSession, path: str, tile: int = BASES, joined: bool = False) -> DataFrame:
    """(contig, ord, tile, start, seq): the bases of FASTA files in tiles, so that a chromosome is many rows and many tasks. The name is the header's
    first token; ord counts contigs in a file. joined: the files under path, by name, are parts of one. Text before the first header is
    refused. A line is read by one task: a file without line breaks has tiles, but one reader."""
    lines, heads = _fasta_lines(spark, path, joined)
    return join_small(cut_tiles(lines, ["group", "ord"], tile), heads, ["group", "ord"], "inner").select("contig", "ord", "tile", "start", "seq")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(contig, ord, seq): whole contigs, one a row; for chromosomes, fasta_tiles()."""
    lines, heads = _fasta_lines(spark, path, False)
    t = cut_tiles(lines, ["group", "ord"]).groupBy("group", "ord").agg(F.array_sort(F.collect_list(F.struct("tile", "seq"))).alias("tiles"))
    return heads.join(t, ["group", "ord"], "left").select("contig", "ord", F.coalesce(F.array_join(F.col("tiles.seq"), ""), F.lit("")).alias("seq"))


def fasta_lengths(spark: SparkSession, path: str) -> DataFrame:
    """(contig, length) without putting sequences together."""
    return _fasta_lines(spark, path, False)[1].select("contig", "length")


def vcf_records(lines: DataFrame) -> DataFrame:
    """Typed records of VCF lines (text, ...): several ALTs drop the record; a QUAL that is no number is 0; a missing GT is 0/1;
    absent sample fields are `.`; only the first sample is read."""
    c = F.split("text", "\t")
    at = lambda i: F.get(c, F.lit(i))
    r = lines.where(~F.col("text").startswith("#") & (F.col("text") != ""))
    r = r.select(*[x for x in lines.columns if x != "text"], at(0).alias("contig"), at(1).try_cast("long").alias("pos"), at(2).alias("id"), F.upper(at(3)).alias("ref"), at(4).alias("alt"), F.coalesce(at(5).try_cast("double"), F.lit(0.0)).alias("qual"), at(6).alias("filter"), at(7).alias("info"), at(8).alias("format"), at(9).alias("sample"))
    r = r.where(F.col("pos").isNotNull() & ~F.col("alt").contains(","))
    keys, values = F.split(F.coalesce("format", F.lit("")), ":"), F.split(F.coalesce("sample", F.lit("")), ":")
    surplus = F.size(values) > F.size(keys)
    gt = F.get(values, (F.array_position(keys, F.lit("GT")) - 1).cast("int"))
    gt = F.when(surplus, F.raise_error(F.lit("a sample has more fields than FORMAT"))).otherwise(F.when(F.array_contains(keys, "GT") & (F.coalesce(gt, F.lit("")) != ""), gt).otherwise("0/1"))
    return r.withColumn("gt", gt.cast("string"))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """vcf_records() of a file, in which the structural columns alone are parsed if only they are used."""
    return vcf_records(spark.read.text(path).withColumnRenamed("value", "text"))


def vcf_declared(spark: SparkSession, path: str) -> DataFrame:
    """(kind, id, type) of the header's declarations."""
    t = spark.read.text(path).where(F.col("value").startswith("##"))
    part = lambda p: F.regexp_extract("value", p, 1)
    return t.select(part(r"^##(contig|INFO|FORMAT|FILTER)=<").alias("kind"), part(r"[<,]ID=([^,>]+)").alias("id"), part(r",Type=(\w+)").alias("type")).where("kind != ''")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """(contig, start, end, mut_rate): negative coordinates are skipped; start must be before end."""
    c = F.split(F.trim("value"), r"\s+")
    t = spark.read.text(path).where("trim(value) != ''").select(F.get(c, F.lit(0)).alias("contig"), F.get(c, F.lit(1)).try_cast("long").alias("start"), F.get(c, F.lit(2)).try_cast("long").alias("end"), F.regexp_extract("value", r"mut_rate=([0-9.eE+-]+)", 1).try_cast("double").alias("mut_rate"))
    t = t.where("start >= 0 and end >= 0")
    return t.withColumn("end", F.when(F.col("start") < F.col("end"), F.col("end")).otherwise(F.raise_error(F.lit("BED: start must be before end")).cast("long")))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, name, seq, quality): a truncated record is an error."""
    from ..operators.validate import fastq_records  # which reads lines by this module

    r = fastq_records(numbered(spark, path))
    whole = F.when(F.col("n_lines") == 4, F.substr("name", F.lit(2))).otherwise(F.raise_error(F.lit("FASTQ: truncated record")).cast("string"))
    return r.select("file", "record", whole.alias("name"), "seq", "quality")


def count_fastq(spark: SparkSession, path: str) -> int:
    """Records of FASTQ files, from the number of lines alone."""
    return spark.read.text(path).count() // 4


def fragment_of_name(name: Column) -> Column:
    """struct(start, end, uniq) from the last three `_` parts of a read's name."""
    parts = F.split(F.regexp_replace(name, "/[12]$", ""), "_")
    p = lambda i: F.get(parts, F.size(parts) - i)
    whole = (F.size(parts) > 3) & p(3).rlike("^[0-9]+$") & p(2).rlike("^[0-9]+$") & (p(1) != "") & ~p(1).contains("/")
    return F.when(whole, F.struct(p(3).try_cast("long").alias("start"), p(2).try_cast("long").alias("end"), p(1).alias("uniq")))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """The eleven fixed columns of SAM, and MD."""
    c = F.split("value", "\t")
    at = lambda i: F.get(c, F.lit(i))
    t = spark.read.text(path).where(~F.col("value").startswith("@") & (F.col("value") != ""))
    md = F.regexp_extract("value", r"\tMD:Z:([^\t]*)", 1)
    return t.select(at(0).alias("name"), at(1).cast("int").alias("flag"), at(2).alias("contig"), (at(3).cast("long") - 1).alias("pos0"), at(4).cast("int").alias("mapq"), at(5).alias("cigar"), at(6).alias("mate_contig"), at(7).cast("long").alias("mate_pos"), at(8).cast("int").alias("tlen"), at(9).alias("seq"), at(10).alias("quality"), md.alias("md"))


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(contig, to): two columns, # comments."""
    c = F.split("value", "\t")
    return spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.get(c, F.lit(0)).alias("contig"), F.get(c, F.lit(1)).alias("to"))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(ref, read, weight) of a 4 x 4 table: rows and columns A, C, G, T; finite, not negative; the diagonal is 0."""
    t = numbered(spark, path).where("trim(text) != ''").withColumn("c", F.split(F.trim("text"), r"\s+"))
    t = t.withColumn("row", F.row_number().over(Window.partitionBy("file").orderBy("line_no")))
    t = t.select("row", F.posexplode("c").alias("col", "x"), F.size("c").alias("n")).withColumn("w", F.col("x").try_cast("double"))
    bad = (F.col("row") > 4) | (F.col("n") != 4) | F.col("w").isNull() | F.isnan("w") | (F.col("w") < 0) | (F.col("w") == float("inf"))
    w = F.when(bad, F.raise_error(F.lit("matrix: four rows of four finite weights")).cast("double")).when(F.col("row") == F.col("col") + 1, F.lit(0.0)).otherwise(F.col("w"))
    base = lambda i: F.substring(F.lit("ACGT"), i, F.lit(1))
    return t.select(base(F.col("row")).alias("ref"), base(F.col("col") + 1).alias("read"), w.alias("weight"))


def read_subclones(spark: SparkSession, path: str) -> DataFrame:
    """(cluster, ccf, weight) of a tab-separated table whose header names a cluster, a prevalence and perhaps a weight."""
    t = spark.read.csv(path, sep="\t", header=True)
    named = {c.lower(): c for c in t.columns}
    first = lambda *names: next((named[n] for n in names if n in named), None)
    cluster, ccf, weight = first("cluster_id", "cluster", "cluster.no"), first("cellular_prevalence", "ccf", "location"), first("weight", "n_ssms", "no.of.mutations")
    if cluster is None or ccf is None:
        raise ValueError("the table needs a cluster and a prevalence")
    w = F.sum(F.col(f"`{weight}`").cast("double")) if weight else F.count("*").cast("double")
    return t.groupBy(F.col(f"`{cluster}`").alias("cluster")).agg(F.avg(F.col(f"`{ccf}`").cast("double")).alias("ccf"), w.alias("weight"))
