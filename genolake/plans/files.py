"""Registered queries: files that Spark writes from the tables and reads again, filters of files by BED, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare, reads as aligned, validate
from ..operators.scan import running
from ..sources import sinks, text
from ..staging import shared_dir, staged
from .compare import r6
from .inputs import alignments, bases_of, bed, called, contigs, edited, fragments, reads, records, table, truth, vcf_fields, with_inputs

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None, needs: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_inputs(needs, sql)
        return f

    return add


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("select contig, length(seq)::bigint length, md5(seq) seq_md5 from contigs where length(seq) > 0", "contigs")
def fasta_round_trip(spark, d) -> DataFrame:
    path = _fresh(spark, "fasta")
    sinks.write_fasta(contigs(spark, d).where("length(seq) > 0"), path)
    lengths = text.fasta_lengths(spark, path)
    return text.read_fasta(spark, path).select("contig", F.md5(F.col("seq").cast("binary")).alias("seq_md5")).join(lengths, "contig").select("contig", "length", "seq_md5")


@query(
    """~ g as (select lang contig, string_agg(seq, '' order by doc_id) seq from (select doc_id, lang, c.seq from documents d join contigs c on c.contig = concat('doc', d.doc_id::varchar) where lang is not null and text is not null) group by 1)
select contig, i::bigint "start", length(substr(seq, i + 1, 61440))::bigint length, md5(substr(seq, i + 1, 61440)) seq_md5 from (select contig, seq, unnest(range(0, length(seq), 61440)) i from g)""",
    "contigs",
)
def fasta_long_contigs(spark, d) -> DataFrame:
    """A contig for each language, the bases of its documents one after another, written and read in tiles: no row and no task holds a contig."""
    docs = table(spark, d, "documents").where("lang is not null and text is not null").select("doc_id", F.col("lang").alias("contig"), bases_of(F.col("text")).alias("text"))
    pieces = staged(docs.withColumn("long", F.length("text").cast("long")), "pieces")
    placed = running(pieces, ["contig"], "doc_id", {"at": ("sum", F.col("long"))}, before=True)
    path = _fresh(spark, "genome")
    tiles = text.cut_tiles(placed, ["contig"]).withColumn("ord", F.col("contig"))
    sinks.write_fasta_tiles(tiles, path, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = text.fasta_tiles(spark, path, joined=True)
    return found.select("contig", "start", F.length("seq").cast("long").alias("length"), F.md5(F.col("seq").cast("binary")).alias("seq_md5"))


@query("select read_id, md5(seq || chr(10) || list_aggregate(list_transform(scores, lambda q: chr((q + 33)::int)), 'string_agg', '')) record_md5 from reads", "reads")
def fastq_round_trip(spark, d) -> DataFrame:
    path = _fresh(spark, "fastq")
    sinks.write_fastq(reads(spark, d).withColumnRenamed("read_id", "name"), path, ["name"], int(spark.conf.get("spark.sql.shuffle.partitions")))
    return text.read_fastq(spark, path).select(F.col("name").alias("read_id"), F.md5(F.concat_ws("\n", "seq", "quality").cast("binary")).alias("record_md5"))


@query("select count(*) n_records from reads", "reads")
def fastq_record_count(spark, d) -> DataFrame:
    path = _fresh(spark, "fastq")
    sinks.write_fastq(reads(spark, d).withColumnRenamed("read_id", "name"), path, ["name"], int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spark.createDataFrame([(text.count_fastq(spark, path),)], "n_records long")


@query("~ t as (select 'T_' || read_id as name, seq from reads union all select 'N_' || read_id, seq from reads) select left(name, 1) tag, count(*) n, sum(length(seq))::bigint bases, min(name) first_name from t group by 1", "reads")
def fastq_tagged_union(spark, d) -> DataFrame:
    r = reads(spark, d).select(F.col("read_id").alias("name"), "seq", "scores")
    both = sinks.tagged_fastq(r, "T").unionByName(sinks.tagged_fastq(r, "N"))
    return both.groupBy(F.substring("name", 1, 1).alias("tag")).agg(F.count("*").alias("n"), F.sum(F.length("seq").cast("long")).alias("bases"), F.min("name").alias("first_name"))


@query("select contig, count(*) n, sum(pos)::bigint positions from (select distinct contig, pos, ref, alt from edited) group by 1", "edited")
def vcf_round_trip(spark, d) -> DataFrame:
    path = _fresh(spark, "vcf")
    r = edited(spark, d).select("contig", "pos", F.lit(".").alias("id"), "ref", "alt", F.lit(50.0).alias("qual"), F.lit("PASS").alias("filter"), F.lit("S=1").alias("info"), F.lit("0/1").alias("gt"), F.lit(3).alias("ref_depth"), F.lit(1).alias("alt_depth"))
    sinks.write_vcf(r, path, [(f"chr{i}", 1_000_000) for i in range(1, 6)], 8)
    back = text.read_vcf(spark, f"{path}/records")
    return back.groupBy("contig").agg(F.count("*").alias("n"), F.sum("pos").alias("positions"))


@query("select contig, count(*) n, sum(stop - start)::bigint bases, count(rate) rates, round(sum(rate), 4) total from (select *, case when id % 3 = 0 then (id % 10) / 10.0 end rate from bed) group by 1", "bed")
def bed_round_trip(spark, d) -> DataFrame:
    path = _fresh(spark, "bed")
    b = bed(spark, d)
    rate = F.when(F.col("id") % 3 == 0, F.concat(F.lit("mut_rate="), ((F.col("id") % 10) / 10.0).cast("string")))
    b.select(F.concat_ws("\t", "contig", F.col("start").cast("string"), F.col("end").cast("string"), rate).alias("value")).write.text(path)
    return text.read_bed(spark, path).groupBy("contig").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("bases"), F.count("mut_rate").alias("rates"), F.round(F.sum("mut_rate"), 4).alias("total"))


FLAG = "(paired::int + 8 * (not mate_mapped)::int + 64 * first::int + 256 * secondary::int)"


def _sam(spark, d) -> DataFrame:
    """The alignments as SAM text, read again."""
    path = _fresh(spark, "sam")
    bit = lambda c, n: F.when(c, n).otherwise(0)
    flag = bit(F.col("paired"), 1) + bit(~F.col("mate_mapped"), 8) + bit(F.col("first"), 64) + bit(F.col("secondary"), 256)
    a = alignments(spark, d)
    cols = ["id", flag.cast("string"), F.col("contig"), (F.col("pos0") + 1).cast("string"), F.col("mapq").cast("string"), F.lit("100M"), F.when(F.col("same_ref"), "=").otherwise("chrX"), F.lit("1"), F.col("tlen").cast("string"), F.lit("*"), F.lit("*")]
    a.select(F.concat_ws("\t", *cols).alias("value")).write.text(path)
    return text.read_sam(spark, path)


@query("select tlen::bigint len, count(*) n from alignments where paired and first and mate_mapped and same_ref and not secondary and mapq > 10 and tlen > 0 group by 1", "alignments")
def sam_template_lengths(spark, d) -> DataFrame:
    return aligned.template_lengths(_sam(spark, d))


@query("select count(*) n, sum((not secondary)::int)::bigint countable, sum((paired and mate_mapped and same_ref and not secondary and mapq > 10)::int)::bigint overlap, sum((not secondary and abs(tlen) between 200 and 350)::int)::bigint in_band from alignments", "alignments")
def walk_filters(spark, d) -> DataFrame:
    """How many records each filter lets through."""
    s = _sam(spark, d)
    same = F.col("mate_contig") == "="
    n = lambda c: F.sum(c.cast("long"))
    return s.agg(F.count("*").alias("n"), n(aligned.countable(F.col("flag"))).alias("countable"), n(aligned.usable(F.col("flag"), F.col("mapq"), same, "overlap")).alias("overlap"), n(aligned.countable(F.col("flag")) & aligned.in_band(F.abs("tlen"), 200, 350)).alias("in_band"))


NAME = "concat_ws('_', 'sim', contig, start::varchar, stop::varchar, replace(id, ':', '-') || '/1')"


@query(f"select f.contig, count(*) n from (select *, {NAME} as name from fragments) f where exists (select 1 from bed b where b.contig = f.contig and b.start < f.stop and f.start < b.stop) group by 1", "fragments bed")
def reads_in_bed(spark, d) -> DataFrame:
    f = fragments(spark, d)
    name = F.concat_ws("_", F.lit("sim"), "contig", F.col("start").cast("string"), F.col("end").cast("string"), F.concat(F.translate("id", ":", "-"), F.lit("/1")))
    kept = aligned.in_bed(f.select(name.alias("name")), bed(spark, d), F.regexp_extract("name", r"^sim_([^_]+)_", 1))
    return kept.groupBy(F.regexp_extract("name", r"^sim_([^_]+)_", 1).alias("contig")).agg(F.count("*").alias("n"))


@query("select 'header' part, 2::bigint n union all select 'record', count(*) from truth t where exists (select 1 from bed b where b.contig = t.contig and t.pos - 1 >= b.start and t.pos - 1 < b.stop)", "truth bed")
def vcf_in_bed(spark, d) -> DataFrame:
    head = spark.createDataFrame([("##fileformat=VCFv4.3",), ("#CHROM\tPOS\tID\tREF\tALT",)], "text string")
    lines = head.union(truth(spark, d).select(F.concat_ws("\t", "contig", F.col("pos").cast("string"), F.lit("."), "ref", "alt")))
    kept = aligned.vcf_lines_in_bed(lines, bed(spark, d))
    return kept.groupBy(F.when(F.col("text").startswith("#"), "header").otherwise("record").alias("part")).agg(F.count("*").alias("n"))


@query(
    """~ fn as (select contig, pos, ref, alt from truth anti join (select distinct contig, pos, ref, alt from called) using (contig, pos, ref, alt)),
g as (select *, exists (select 1 from bed b where b.contig = fn.contig and fn.pos - 1 >= b.start and fn.pos - 1 < b.stop) i from fn)
select contig, pos, md5(concat_ws(chr(9), contig, pos::varchar, '.', ref, alt, '.', 'PASS', 'REASON=' || case when contig = 'chr5' then 'outside_simulated_contigs' when not i then 'outside_mutation_bed,outside_target_bed' else 'unknown' end, 'GT', '0/1')) line_md5, count(*) n from g group by all""",
    "truth called bed",
)
def missed_vcf_lines(spark, d) -> DataFrame:
    misses = compare.missed(truth(spark, d), called(spark, d))
    b = bed(spark, d)
    out = compare.miss_reasons(misses, F.col("contig") != "chr5", b, b)
    lines = sinks.missed_lines(out, F.col("reasons"))
    return lines.groupBy("contig", "pos", F.md5(F.col("value").cast("binary")).alias("line_md5")).agg(F.count("*").alias("n"))


@query(
    """~ k as (select contig, pos, ref, alt, sum(t)::bigint t, sum(c)::bigint c from (select contig, pos, ref, alt, 1 t, 0 c from truth union all select contig, pos, ref, alt, 0, 1 from called) group by 1, 2, 3, 4),
m as (select case when grouping(contig) = 1 then 'TOTAL' else contig end contig, count(*) filter (t > 0 and c > 0) tp, coalesce(sum(t) filter (c = 0), 0)::bigint fn, coalesce(sum(c) filter (t = 0), 0)::bigint fp from k group by rollup (contig)),
x as (select *, tp / nullif(tp + fp, 0) p, tp / nullif(tp + fn, 0) r from m)
select contig, concat_ws(chr(9), contig, tp::varchar, fn::varchar, fp::varchar, coalesce(printf('%.4f', p), 'n/a'), coalesce(printf('%.4f', r), 'n/a'), coalesce(printf('%.4f', 2 * p * r / nullif(p + r, 0)), 'n/a')) as value from x""",
    "truth called",
)
def comparison_report(spark, d) -> DataFrame:
    """The report as written and read again."""
    path = _fresh(spark, "report")
    sinks.write_report(compare.rollup_metrics(truth(spark, d), called(spark, d)), path)
    return spark.read.text(f"{path}/txt").select(F.split_part("value", F.lit("\t"), F.lit(1)).alias("contig"), "value")


@query("select id, case h % 4 when 0 then 'NEW=1;B=2' when 1 then 'B=2;NEW=' || (h % 9) when 2 then 'NEW;OLDER=3' else '.' end info from fragments", "fragments")
def tags_renamed(spark, d) -> DataFrame:
    from ..functions import vcf

    h = F.col("h")
    info = F.when(h % 4 == 0, "OLD=1;B=2").when(h % 4 == 1, F.concat(F.lit("B=2;OLD="), (h % 9).cast("string"))).when(h % 4 == 2, "OLD;OLDER=3").otherwise(".")
    return fragments(spark, d).select("id", vcf.renamed_tags(info, {"OLD": "NEW"}).alias("info"))


@query(
    """~ r as (select order_id % 50 as file, (h % 90) = 0 bad, (h % 7) = 0 warned from records)
select file, sum(bad::int)::bigint errors, sum(warned::int)::bigint warnings, sum(bad::int) = 0 passed from r group by 1""",
    "records",
)
def validation_verdicts(spark, d) -> DataFrame:
    """Files of records, under two rules."""
    r = records(spark, d).select((F.col("order_id") % 50).alias("file"), "h")
    rules = [("ERROR", "bad", F.col("h") % 90 == 0), ("WARNING", "odd", F.col("h") % 7 == 0)]
    return validate.verdicts(validate.findings(r, rules, ["file"]), r)


@query("select contig, pos, count(*) n, round(sum(depth), 2) depth from (select contig, pos, case h % 4 when 0 then (h % 50 + h % 30)::double when 1 then null when 2 then (h % 50 + h % 30 + 1)::double else null end depth from records) group by 1, 2", "records")
def ad_site_depth(spark, d) -> DataFrame:
    from ..functions import vcf

    h = F.col("h")
    a, b = (h % 50).cast("string"), (h % 30).cast("string")
    fmt = F.when(h % 4 == 1, "GT:DP").otherwise("GT:AD")
    sample = F.when(h % 4 == 0, F.concat(F.lit("0/1:"), a, F.lit(","), b)).when(h % 4 == 1, F.concat(F.lit("0/1:"), a)).when(h % 4 == 2, F.concat(F.lit("0/1:"), a, F.lit(","), b, F.lit(",1"))).otherwise(F.concat(F.lit("0/1:"), a, F.lit(",x")))
    r = records(spark, d).withColumn("depth", vcf.site_depth(fmt, sample))
    return r.groupBy("contig", "pos").agg(F.count("*").alias("n"), F.round(F.sum("depth"), 2).alias("depth"))


@query(
    """~ o as (
  select t.contig, t.pos, t.h seq_no, case when n.contig is null then 'somatic' else 'shared' end origin from truth t left join (select distinct contig, pos, ref, alt from called) n using (contig, pos, ref, alt)
  union all select contig, pos, h, 'germline' from called anti join (select distinct contig, pos, ref, alt from truth) using (contig, pos, ref, alt))
select contig, (6 - right(contig, 1)::int)::int ord, pos, seq_no, origin, row_number() over (partition by contig order by pos, seq_no) - 1 place from o""",
    "truth called",
)
def merged_truth_order(spark, d) -> DataFrame:
    merged = compare.merge_origins(truth(spark, d), called(spark, d)).withColumnRenamed("h", "seq_no")
    order = spark.createDataFrame([(f"chr{i}", 6 - i) for i in range(1, 6)], "contig string, ord int")
    return compare.in_truth_order(merged, order).select("contig", "ord", "pos", "seq_no", "origin", F.col("place").cast("long").alias("place"))


@query("~ p as (select contig, discount af, 'input' provenance from truth union all select contig, tax * 0.6, 'somatic_input' from called) select contig, provenance, count(*) n, round(avg(af), 6) af from p group by 1, 2", "truth called")
def planted_union(spark, d) -> DataFrame:
    g, s = truth(spark, d).select("contig", F.col("discount").cast("double").alias("af")), called(spark, d).select("contig", F.col("tax").cast("double").alias("af"))
    return compare.planted_inputs(g, s, 0.6).groupBy("contig", "provenance").agg(F.count("*").alias("n"), r6(F.avg("af")).alias("af"))


@query("select contig, pos, gt, alt from vcf_fields qualify row_number() over (partition by contig, pos order by h, order_id, line_id) = 1", "vcf_fields")
def first_record_at_position(spark, d) -> DataFrame:
    v = vcf_fields(spark, d).select("contig", "pos", "h", "order_id", "line_id", "gt", "alt")
    return compare.first_at_position(v, ["h", "order_id", "line_id"]).select("contig", "pos", "gt", "alt")


FOLDER = """~ r as (select 'v' || (l_suppkey % 20)::varchar || '.vcf' file, l_suppkey % 20 f, l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_partkey % 29 = 0 then 'chrZ' else 'chr' || (l_orderkey // 1000 % 3 + 1)::varchar end contig,
  case when l_partkey % 31 = 0 then null when l_partkey % 37 = 0 then 5 else l_orderkey * 10 + l_linenumber end pos, case when l_partkey % 7 = 0 then 'AZ' else 'ACG' end ref, l_partkey % 4 i, case when l_partkey % 13 = 0 then 6 else 8 end n from lineitem),
k as (select *, row_number() over (partition by file order by l_orderkey, l_linenumber, l_partkey, l_suppkey) k from r where f % 5 <> 4),
w as (select *, n = 8 and f % 7 <> 3 as whole, n = 8 and f % 7 <> 3 and pos is not null as valid from k),
s as (select *, last_value(case when valid then contig end ignore nulls) over u lc, last_value(case when valid then pos end ignore nulls) over u lp, min(case when valid then k end) over (partition by file, contig) first
  from w window u as (partition by file order by k rows between unbounded preceding and 1 preceding)),
v as (select file, unnest(list_filter([case when not whole then 'column_count' end, case when whole and pos is null then 'bad_position' end, case when valid and f % 3 <> 0 and contig = 'chrZ' then 'contig_not_declared' end, case when valid and ref = 'AZ' then 'bad_reference' end,
  case when valid and lc = contig and lp > pos then 'unsorted' end, case when valid and lc <> contig and first < k then 'contig_again' end, case when valid and (i = 1 or (i = 3 and f % 4 = 1)) then 'info_not_declared' end, case when valid and i = 0 then 'info_type' end], lambda x: x is not null)) rule from s
  union all select distinct file, 'no_column_line' from r where f % 5 = 4),
d as (select 'q' || (doc_id % 10)::varchar || '.fastq' file, doc_id, case when doc_id % 5 = 0 then replace(text, chr(10), ' ') else c.seq end seq from documents join contigs c on c.contig = concat('doc', doc_id::varchar) where text is not null),
q as (select file, unnest(list_filter([case when doc_id % 11 = 0 then 'name_without_at' end, case when doc_id % 13 = 0 then 'plus_line' end, case when doc_id % 3 = 0 and length(seq) > 0 then 'length_mismatch' end, case when not regexp_full_match(seq, '[ACGTUNRYSWKMBDHVacgtunryswkmbdhv]*') then 'bad_base' end], lambda x: x is not null)) rule from d
  union all select distinct file, 'carriage_return' from d where doc_id % 17 = 0 union all select distinct file, 'truncated_record' from d where (doc_id % 10) % 4 = 1),
a as (select file, case when rule in ('contig_not_declared', 'info_type') then 'WARNING' when rule = 'carriage_return' then 'TOLERATED' else 'ERROR' end severity, rule, count(*) n from (select * from v union all select * from q) group by all) """


def _folder(spark, d) -> str:
    """Twenty VCF files from line items and ten FASTQ files from documents, each with a header, faults and an end of its own."""
    li, p = table(spark, d, "lineitem"), F.col("l_partkey")
    f = F.col("l_suppkey") % 20
    r = running(li.withColumn("f", f), ["f"], "l_orderkey", {"k": ("sum", F.lit(1).cast("long"))}, ties=["l_linenumber", "l_partkey", "l_suppkey"])
    contig = F.when(p % 29 == 0, "chrZ").otherwise(F.concat(F.lit("chr"), (F.floor(F.col("l_orderkey") / 1000) % 3 + 1).cast("string")))
    pos = F.when(p % 31 == 0, "x").when(p % 37 == 0, "5").otherwise((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string"))
    info = F.when(p % 4 == 0, "DP=x").when(p % 4 == 1, "DP=3;ZZ=1").when(p % 4 == 2, ".").otherwise("DP=7;DB")
    eight = F.array(contig, pos, F.lit("."), F.when(p % 7 == 0, "AZ").otherwise("ACG"), F.lit("T"), F.lit("50"), F.lit("PASS"), info)
    records = r.select("f", "k", F.array_join(F.slice(eight, F.lit(1), F.when(p % 13 == 0, 6).otherwise(8)), "\t").alias("value"))
    fixed = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"
    i = F.col("f")
    head = F.array_compact(F.array(F.lit("##fileformat=VCFv4.3"), *[F.when(i % 3 != 0, f"##contig=<ID=chr{n},length=9>") for n in (1, 2, 3)], F.lit('##INFO=<ID=DP,Number=1,Type=Integer,Description="d">'), F.when(i % 4 != 1, "##INFO=<ID=DB,Number=0,Type=Flag>"), F.when(i % 5 != 4, F.when(i % 7 == 3, f"{fixed}\tFORMAT\tS").otherwise(fixed))))
    heads = records.select("f").distinct().select("f", F.posexplode(head).alias("k", "value")).select("f", (F.col("k") - 100).alias("k"), "value")
    vcf = records.unionByName(heads).select(F.concat(F.lit("v"), i.cast("string"), F.lit(".vcf")).alias("file"), F.col("k").cast("long").alias("k"), "value")
    n = F.col("doc_id")
    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.when(n % 5 == 0, F.replace("text", F.lit("\n"), F.lit(" "))).otherwise(bases_of(F.col("text"))).alias("seq"))
    name = F.concat(F.when(n % 11 == 0, "name").otherwise("@name"), n.cast("string"), F.when(n % 17 == 0, "\r").otherwise(""))
    four = F.array(name, "seq", F.when(n % 13 == 0, "-").otherwise("+"), F.repeat(F.lit("I"), F.greatest(F.length("seq") - (n % 3 == 0).cast("int"), F.lit(0))))
    name = F.concat(F.lit("q"), (n % 10).cast("string"), F.lit(".fastq"))
    fastq = t.select(name.alias("file"), n, F.posexplode(four).alias("i", "value")).select("file", (n * 4 + F.col("i")).alias("k"), "value")
    tail = t.where("(doc_id % 10) % 4 = 1").select(name.alias("file"), F.lit(1 << 60).alias("k"), F.lit("@tail").alias("value")).distinct()
    path = _fresh(spark, "folder")
    rows = vcf.unionByName(fastq).unionByName(tail)
    rows.repartition("file").sortWithinPartitions("file", "k").select("file", "value").write.partitionBy("file").text(path)
    return path


def _own(file: str = "file"):
    return F.regexp_extract(file, r"file=([^/]*)$", 1)


@query(FOLDER + "select * from a", "contigs")
def folder_findings(spark, d) -> DataFrame:
    """A folder of files of two formats, each held against its own declarations."""
    found, _ = validate.validate_folder(spark, _folder(spark, d))
    return found.groupBy(_own().alias("file"), "severity", "rule").agg(F.count("*").alias("n"))


@query(FOLDER + ", e as (select distinct file from r union select distinct file from d) select file, coalesce(sum(n) filter (severity = 'ERROR'), 0)::bigint errors, coalesce(sum(n) filter (severity = 'WARNING'), 0)::bigint warnings, coalesce(sum(n) filter (severity = 'ERROR'), 0) = 0 passed from e left join a using (file) group by 1", "contigs")
def folder_verdicts(spark, d) -> DataFrame:
    _, verdict = validate.validate_folder(spark, _folder(spark, d))
    return verdict.withColumn("file", _own())
