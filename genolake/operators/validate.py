"""Rule checks of FASTQ and VCF lines. Each rule is a condition on a line's own columns or its neighbour's; findings are rows."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.text import numbered
from ..staging import join_small, staged
from .scan import running

#: Lines of a file that one task scans.
LINES = 1 << 20
# Extensions by format.
FORMATS = {"fastq": ("fq", "fastq"), "vcf": ("vcf",), "bam": ("bam",)}


def findings(lines: DataFrame, rules: list[tuple[str, str, Column]], keys: list[str]) -> DataFrame:
    """(keys..., severity, rule): a row for each rule (severity, name, condition) that a line breaks; a null condition breaks none."""
    broken = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(severity).alias("severity"), F.lit(name).alias("rule"))) for severity, name, bad in rules]))
    return lines.select(*keys, F.explode(broken).alias("f")).select(*keys, "f.severity", "f.rule")


def fastq_records(lines: DataFrame, file: str = "file") -> DataFrame:
    """(file, record, n_lines, name, seq, plus, quality) from lines (file, line_no from 0, text): four lines a record."""
    r = lines.withColumn("record", F.floor(F.col("line_no") / 4)).withColumn("part", F.col("line_no") % 4)
    of = lambda i: F.max(F.when(F.col("part") == i, F.col("text")))
    return r.groupBy(file, "record").agg(F.count("*").alias("n_lines"), of(0).alias("name"), of(1).alias("seq"), of(2).alias("plus"), of(3).alias("quality"))


def fastq_rules() -> list[tuple[str, str, Column]]:
    c = F.col
    bare = lambda x: F.regexp_replace(x, "\r$", "")
    whole = c("n_lines") == 4
    return [
        ("ERROR", "truncated_record", c("n_lines") < 4),
        ("ERROR", "name_without_at", ~c("name").startswith("@")),
        ("ERROR", "plus_line", whole & ~c("plus").startswith("+")),
        ("ERROR", "length_mismatch", whole & (F.length(bare(c("seq"))) != F.length(bare(c("quality"))))),
        ("ERROR", "bad_base", ~bare(c("seq")).rlike("^[ACGTUNRYSWKMBDHVacgtunryswkmbdhv]*$")),
        ("ERROR", "bad_quality", whole & ~bare(c("quality")).rlike("^[!-~]*$")),
        ("WARNING", "empty_sequence", bare(c("seq")) == ""),
        ("WARNING", "carriage_return", F.coalesce(c("seq"), F.lit("")).endswith("\r") | F.coalesce(c("name"), F.lit("")).endswith("\r")),
    ]


def vcf_columns(lines: DataFrame) -> DataFrame:
    """(file, line_no, n_columns, contig, pos, ref, alt, qual, info, previous contig and pos) of the record lines."""
    r = lines.where(~F.col("text").startswith("#")).withColumn("c", F.split("text", "\t"))
    at = lambda i: F.get("c", F.lit(i))
    r = r.select("file", "line_no", F.size("c").alias("n_columns"), at(0).alias("contig"), at(1).try_cast("long").alias("pos"), at(3).alias("ref"), at(4).alias("alt"), at(5).alias("qual"), at(7).alias("info"))
    w = Window.partitionBy("file").orderBy("line_no")
    return r.withColumn("last_contig", F.lag("contig").over(w)).withColumn("last_pos", F.lag("pos").over(w))


def vcf_rules(contigs: list[str], info_keys: list[str], integers: list[str]) -> list[tuple[str, str, Column]]:
    """contigs, info_keys and integers are what the header declares: as many as a header has."""
    c = F.col
    items = F.filter(F.split(F.coalesce(c("info"), F.lit(".")), ";"), lambda x: ~x.isin("", "."))
    key = lambda x: F.split_part(x, F.lit("="), F.lit(1))
    value = lambda x: F.substring_index(x, "=", -1)
    return [
        ("ERROR", "too_few_columns", c("n_columns") < 8),
        ("ERROR", "bad_position", c("pos").isNull() | (c("pos") < 0)),
        ("ERROR", "bad_reference", ~c("ref").rlike("^[ACGTNacgtn]+$")),
        ("ERROR", "unsorted", (c("last_contig") == c("contig")) & (c("last_pos") > c("pos"))),
        ("ERROR", "info_not_declared", F.exists(items, lambda x: ~key(x).isin(*info_keys))),
        ("ERROR", "info_type", F.exists(items, lambda x: key(x).isin(*integers) & value(x).try_cast("long").isNull())),
        ("WARNING", "contig_not_declared", ~c("contig").isin(*contigs)),
    ]


def verdicts(found: DataFrame, files: DataFrame, by: str = "file") -> DataFrame:
    """(by, errors, warnings, passed) of every file (by), from the findings of all its rules; one without an error passes."""
    of = lambda s: F.sum(F.when(F.col("severity") == s, 1).otherwise(0))
    g = found.groupBy(by).agg(of("ERROR").alias("errors"), of("WARNING").alias("warnings"))
    out = files.select(by).distinct().join(g, by, "left").fillna(0, ["errors", "warnings"])
    return out.withColumn("passed", F.col("errors") == 0)


def file_of(path: Column) -> Column:
    """The file that a path belongs to: a folder that Spark wrote under a file's name is that file."""
    known = "|".join(x for names in FORMATS.values() for x in names)
    named = F.regexp_extract(path, rf"(?i)^(.*?\.(?:{known})(?:\.gz)?)(?:/|$)", 1)
    return F.regexp_replace(F.when(named != "", named).otherwise(path), "^file:/+", "file:/")


def format_of(file: Column) -> Column:
    """fastq, vcf or bam by the extension, whatever its case and before .gz; null for others."""
    bare = F.regexp_replace(F.lower(file), r"\.gz$", "")
    out = F.lit(None).cast("string")
    for name, extensions in FORMATS.items():
        out = F.when(bare.rlike(rf"\.({'|'.join(extensions)})$"), name).otherwise(out)
    return out


def _found(rows: DataFrame, rules: list[tuple[str, str, Column]]) -> DataFrame:
    return findings(rows, rules, ["file", "line"])


def vcf_file_findings(lines: DataFrame) -> DataFrame:
    """(file, line, severity, rule) of VCF files, each held against its own header; lines: (file, line_no from 0, text), staged or cheap.

    A file without a column line has that finding only. A record with too few columns, or with another number than the header's (if that
    has more than eight), or without an integer position, has that finding only and is no neighbour of others. Declarations are a row a file, as
    many as a header holds; a record meets those of its own file. Order is told by a scan over the file in pieces of LINES."""
    text, c = F.col("text"), F.col
    head = lines.where(text.startswith("#"))
    named = lambda p: F.nullif(F.regexp_extract("text", p, 1), F.lit(""))
    info, contig = named(r"^##INFO=<(?:.*,)?\s*ID=\"?([^,>\"]+)"), named(r"^##contig=<(?:.*,)?\s*ID=\"?([^,>\"]+)")
    kind = F.coalesce(named(r"[<,]\s*Type=\"?([^,>\"]+)"), F.lit("String"))
    columns = F.when(text.startswith("#CHROM"), F.size(F.split("text", "\t")))
    declared = head.select("file", info.alias("info"), kind.alias("kind"), contig.alias("contig"), columns.alias("columns"), "line_no").groupBy("file").agg(
        F.max("columns").alias("columns"),
        F.map_from_entries(F.array_distinct(F.array_sort(F.collect_list(F.when(c("info").isNotNull(), F.struct("info", "kind")))))).alias("types"),
        F.collect_set("contig").alias("contigs"),
    )
    files = lines.select("file").distinct().join(declared, "file", "left")
    files = staged(files, "headers")
    none = files.where("columns is null").select("file", F.lit(1).cast("long").alias("line"), F.lit("ERROR").alias("severity"), F.lit("no_column_line").alias("rule"))
    r = lines.where(~text.startswith("#") & (F.trim("text") != "")).withColumn("c", F.split("text", "\t"))
    at = lambda i: F.get("c", F.lit(i))
    r = join_small(r, files.where("columns is not null"), ["file"], "inner")
    n = F.size("c")
    whole = (n >= 8) & ~((c("columns") > 8) & (n != c("columns")))
    pos = F.when(at(1).rlike("^[+]?[0-9]+$"), at(1).try_cast("long"))
    r = r.select("file", "line_no", (c("line_no") + 1).alias("line"), whole.alias("whole"), at(0).alias("contig"), pos.alias("pos"), at(3).alias("ref"), at(7).alias("info"), "types", "contigs")
    valid = c("whole") & c("pos").isNotNull()
    r = running(r, ["file"], "line_no", {"last": ("max", F.when(valid, F.struct("line_no", "contig", "pos")))}, width=LINES, before=True)
    first = r.where(valid).groupBy("file", "contig").agg(F.min("line_no").alias("first"))
    r = join_small(r, staged(first, "first_lines"), ["file", "contig"], "left")
    items = F.filter(F.split(c("info"), ";"), lambda x: (x != "") & (c("info") != "."))
    key, has = lambda x: F.split_part(x, F.lit("="), F.lit(1)), lambda x: F.instr(x, "=") > 0
    values = lambda x: F.split(F.substr(x, F.instr(x, "=") + 1), ",")
    fits = lambda v, t: (v == ".") | F.when(t == "Integer", v.rlike("^[+-]?[0-9]+$") & v.try_cast("long").isNotNull()).when(t == "Float", v.try_cast("double").isNotNull()).otherwise(True)
    unknown = F.exists(items, lambda x: c("types")[key(x)].isNull())
    untyped = F.exists(items, lambda x: has(x) & c("types")[key(x)].isNotNull() & F.exists(values(x), lambda v: ~fits(v, c("types")[key(x)])))
    rules = [
        ("ERROR", "column_count", ~c("whole")),
        ("ERROR", "bad_position", c("whole") & c("pos").isNull()),
        ("WARNING", "contig_not_declared", valid & (F.size("contigs") > 0) & ~F.array_contains("contigs", c("contig"))),
        ("ERROR", "bad_reference", valid & ~c("ref").rlike("^[ACGTNacgtn]*$")),
        ("ERROR", "unsorted", valid & (c("last.contig") == c("contig")) & (c("last.pos") > c("pos"))),
        ("ERROR", "contig_again", valid & (c("last.contig") != c("contig")) & (c("first") < c("line_no"))),
        ("ERROR", "info_not_declared", valid & unknown),
        ("WARNING", "info_type", valid & untyped),
    ]
    return none.unionByName(_found(r, rules))


def fastq_file_findings(lines: DataFrame) -> DataFrame:
    """(file, line, severity, rule) of FASTQ files: rules of a file (a rest after its last whole record; carriage returns, which are tolerated) and of
    its whole records."""
    c = F.col
    files = lines.groupBy("file").agg(F.count("*").alias("n"), F.max(c("text").endswith("\r")).alias("crlf"))
    of_file = _found(files.withColumn("line", F.lit(1).cast("long")), [("TOLERATED", "carriage_return", c("crlf"))]).unionByName(_found(files.withColumn("line", c("n")), [("ERROR", "truncated_record", c("n") % 4 != 0)]))
    r = fastq_records(lines.withColumn("text", F.regexp_replace("text", "\r$", ""))).where("n_lines = 4").withColumn("base", c("record") * 4 + 1)
    out = of_file
    for place, severity, rule, bad in (
        (0, "ERROR", "name_without_at", ~c("name").startswith("@")),
        (2, "ERROR", "plus_line", ~c("plus").startswith("+")),
        (3, "ERROR", "length_mismatch", F.length("seq") != F.length("quality")),
        (1, "ERROR", "bad_base", ~c("seq").rlike("^[ACGTUNRYSWKMBDHVacgtunryswkmbdhv]*$")),
        (3, "WARNING", "bad_quality", ~c("quality").rlike("^[!-~]*$")),
    ):
        out = out.unionByName(_found(r.withColumn("line", c("base") + place), [(severity, rule, bad)]))
    return out


def validate_folder(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Findings (file, line, severity, rule), and verdicts (file, errors, warnings, passed), of all files under path, each by its format's rules. An empty file
    has no records and fails; a file of an unknown format, or a binary one, is refused with a finding of its own."""
    source = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    # Spark reads no empty files, but its listing names them
    names = spark.createDataFrame([(unquote(p),) for p in source.inputFiles()], "path string").select(file_of(F.col("path")).alias("file")).distinct()
    sizes = source.groupBy(file_of(F.col("path")).alias("file")).agg(F.sum("length").alias("bytes"))
    files = staged(names.join(sizes, "file", "left").select("file", F.coalesce("bytes", F.lit(0)).alias("bytes"), format_of(F.col("file")).alias("kind")), "files")
    kinds = {r.kind for r in files.where("bytes > 0").select("kind").distinct().collect()}
    line = lambda f, rule: f.select("file", F.lit(1).cast("long").alias("line"), F.lit("ERROR").alias("severity"), F.lit(rule).alias("rule"))
    found = line(files.where("bytes = 0 and kind is not null"), "no_records").unionByName(line(files.where("kind is null or (kind = 'bam' and bytes > 0)"), "unknown_format"))
    if kinds & {"fastq", "vcf"}:
        lines = numbered(spark, path, recursiveFileLookup="true", lineSep="\n").withColumn("file", file_of(F.col("file")))
        lines = staged(lines.withColumn("kind", format_of(F.col("file"))).where("kind in ('fastq', 'vcf')"), "lines")
        of = lambda kind: lines.where(F.col("kind") == kind).drop("kind")
        found = found.unionByName(fastq_file_findings(of("fastq"))).unionByName(vcf_file_findings(of("vcf").withColumn("text", F.regexp_replace("text", "\r$", ""))))
    return found, verdicts(found, files)
