"""Registered queries: text formats, names, CIGARs and scalar functions, on lines that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence, vcf
from ..functions.keyed import normal, uniform
from ..sources import sinks, text
from .compare import r6
from .generate import U
from .inputs import alignments, contigs, edited, fragments, reads, table, vcf_fields, with_inputs

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None, needs: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_inputs(needs, sql) if needs else sql
        return f

    return add


@query(
    """select contig, pos, ref, alt, case when alt like '%[%' or alt like '<%' then 0.0 else (h % 90)::double end qual, gt, count(*) n from vcf_fields where h % 6 <> 0 group by all""",
    "vcf_fields",
)
def vcf_scan(spark, d) -> DataFrame:
    """Records written as lines and read again: several ALTs drop a record, and a QUAL that is no number is 0."""
    v = vcf_fields(spark, d)
    qual = F.when(vcf.literal(F.col("alt")), (F.col("h") % 90).cast("string")).otherwise(".")
    alt = F.when(F.col("h") % 6 == 0, F.concat("alt", F.lit(",T"))).otherwise(F.col("alt"))
    lines = v.select(F.concat_ws("\t", "contig", F.col("pos").cast("string"), F.lit("."), "ref", alt, qual, "filter", F.lit("DP=4"), F.lit("GT:DP"), F.concat("gt", F.lit(":4"))).alias("text"))
    return text.vcf_records(lines).groupBy("contig", "pos", "ref", "alt", "qual", "gt").agg(F.count("*").alias("n"))


@query(
    """~ k as (select contig, pos, ref, alt, count(*) a, sum(h % 7)::bigint b from edited group by all)
select contig, pos, md5(contig || chr(9) || pos::varchar || chr(9) || '.' || chr(9) || ref || chr(9) || alt || chr(9) || '50' || chr(9) || 'PASS' || chr(9) || 'S=1' || chr(9) || 'GT:AD:DP:AF' || chr(9) || '0/1:' || a || ',' || b || ':' || (a + b) || ':' || printf('%.4f', round(b / (a + b), 4))) line_md5 from k""",
    "edited",
)
def vcf_lines(spark, d) -> DataFrame:
    k = edited(spark, d).groupBy("contig", "pos", "ref", "alt").agg(F.count("*").alias("ref_depth"), F.sum(F.col("h") % 7).alias("alt_depth"))
    k = k.select("*", F.lit(".").alias("id"), F.lit(50).alias("qual"), F.lit("PASS").alias("filter"), F.lit("S=1").alias("info"), F.lit("0/1").alias("gt"))
    return sinks.vcf_lines(k).select("contig", "pos", F.md5(F.col("value").cast("binary")).alias("line_md5"))


@query("select read_id, md5('@' || read_id || chr(10) || seq || chr(10) || '+' || chr(10) || list_aggregate(list_transform(scores, lambda q: chr((q + 33)::int)), 'string_agg', '')) record_md5 from reads", "reads")
def fastq_lines(spark, d) -> DataFrame:
    r = reads(spark, d).withColumn("name", F.col("read_id"))
    one = F.concat_ws("\n", F.concat(F.lit("@"), F.col("name")), "seq", F.lit("+"), sequence.phred_string(F.col("scores")))
    return r.select("read_id", F.md5(one.cast("binary")).alias("record_md5"))


@query("select contig, count(*) n, sum(stop - start)::bigint bases, count(distinct id) ids from fragments group by 1", "fragments")
def read_name_parse(spark, d) -> DataFrame:
    f = fragments(spark, d)
    name = F.concat_ws("_", F.lit("sim"), "contig", F.col("start").cast("string"), F.col("end").cast("string"), F.concat(F.translate("id", ":", "-"), F.lit("/1")))
    f = f.withColumn("p", text.fragment_of_name(name))
    return f.groupBy("contig").agg(F.count("p").alias("n"), F.sum(F.col("p.end") - F.col("p.start")).alias("bases"), F.countDistinct("p.uniq").alias("ids"))


@query("select left_clip::bigint left_clip, count(*) n, sum(100 - left_clip + 7)::bigint reference_bases, sum(100 + 3)::bigint query_bases from alignments group by 1", "alignments")
def cigar_spans(spark, d) -> DataFrame:
    a = alignments(spark, d)
    clip = F.when(F.col("left_clip") > 0, F.concat(F.col("left_clip").cast("string"), F.lit("S"))).otherwise("")
    cigar = F.concat(clip, (F.col("read_len") - F.col("left_clip") - 50).cast("string"), F.lit("M3I7D50M"))
    a = a.withColumn("cigar", cigar).withColumn("clip", sequence.clip_lengths(F.col("cigar"))[0].cast("long"))
    return a.groupBy(F.col("clip").alias("left_clip")).agg(F.count("*").alias("n"), F.sum(sequence.reference_span(F.col("cigar"))).alias("reference_bases"), F.sum(sequence.query_length(F.col("cigar"))).alias("query_bases"))


@query(
    f"""with c as (select event_id, substr('ACGTRYSWKMBDHVNX', (event_id % 16)::int + 1, 1) code, {U('iupac', 'event_id::varchar')} u from events),
m as (select *, map {{'A': 'A', 'C': 'C', 'G': 'G', 'T': 'T', 'R': 'AG', 'Y': 'CT', 'S': 'CG', 'W': 'AT', 'K': 'GT', 'M': 'AC', 'B': 'CGT', 'D': 'AGT', 'H': 'ACT', 'V': 'ACG', 'N': 'N', 'X': 'N'}}[code] s from c)
select code, s[floor(u * length(s))::int + 1] base, count(*) n from m group by 1, 2"""
)
def iupac_resolve(spark, d) -> DataFrame:
    code = F.substr(F.lit("ACGTRYSWKMBDHVNX"), (F.col("event_id") % 16 + 1).cast("int"), F.lit(1))
    e = table(spark, d, "events").select(code.alias("code"), uniform(11, "iupac", F.col("event_id")).alias("u"))
    return e.groupBy("code", sequence.resolve_ambiguity(F.col("code"), F.col("u")).alias("base")).agg(F.count("*").alias("n"))


@query(f"with z as (select event_type, sqrt(-2 * ln(1 - {U('u', 'event_id::varchar')})) * cos(2 * pi() * {U('v', 'event_id::varchar')}) z from events) select event_type, count(*) n, round(avg(z), 6) mean, round(stddev_pop(z), 6) sd from z group by 1")
def normal_draws(spark, d) -> DataFrame:
    k = F.col("event_id")
    z = table(spark, d, "events").select("event_type", normal(uniform(11, "u", k), uniform(11, "v", k)).alias("z"))
    return z.groupBy("event_type").agg(F.count("*").alias("n"), r6(F.avg("z")).alias("mean"), r6(F.stddev_pop("z")).alias("sd"))


@query("~ w as (select contig, i::bigint as start, substr(seq, i + 1, 200) s from (select contig, seq, unnest(range(0, length(seq) - 199, 200)) i from contigs where length(seq) >= 200)) select contig, count(*) windows, sum((length(regexp_replace(s, '[^N]', '', 'g')) <= 0.02 * length(s))::int)::bigint alignable from w group by 1", "contigs")
def alignable_windows(spark, d) -> DataFrame:
    from ..operators.fit import sequence_tiles

    w = sequence_tiles(contigs(spark, d), 1, 200).where("length(seq) = 200")
    return w.groupBy("contig").agg(F.count("*").alias("windows"), F.sum(sequence.alignable(F.col("seq"), 0.02).cast("long")).alias("alignable"))


@query("~ t as (select p_name n, p_type t from part) select n, t, levenshtein(n, t) distance, count(*) k from t group by 1, 2, 3".replace("~", "with"))
def key_suggestions(spark, d) -> DataFrame:
    """Edit distances, as for suggestions of mistyped keys."""
    p = table(spark, d, "part")
    return p.groupBy(F.col("p_name").alias("n"), F.col("p_type").alias("t")).agg(F.count("*").alias("k")).withColumn("distance", F.levenshtein("n", "t").cast("long"))


@query("select id, case when h % 3 = 0 then 'B=2;A=' || (h % 5) when h % 3 = 1 then 'A=' || (h % 5) else 'FLAG;A=' || (h % 5) end info from fragments", "fragments")
def info_tag_append(spark, d) -> DataFrame:
    h = F.col("h")
    info = F.when(h % 3 == 0, "A=1;B=2").when(h % 3 == 1, ".").otherwise("FLAG")
    return fragments(spark, d).select("id", sinks.with_tag(info, "A", (h % 5).cast("string")).alias("info"))
