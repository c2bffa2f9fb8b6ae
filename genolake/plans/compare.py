"""Registered queries: variant comparison and interval joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vcf
from ..operators import compare, intervals
from .inputs import bed, called, contigs, edited, records, structural, table, truth, vcf_fields, with_inputs

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None, needs: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_inputs(needs, sql) if needs else sql
        return f

    return add


def r6(c):
    return F.round(c, 6)


KEYS = "contig, pos, ref, alt"


@query(f"select contig, count(*) n from (select {KEYS} from truth intersect select {KEYS} from called) group by 1", "truth called")
def compare_tp(spark, d) -> DataFrame:
    return compare.matched(truth(spark, d), called(spark, d)).groupBy("contig").agg(F.count("*").alias("n"))


@query(f"select contig, pos, ref, alt, count(*) n from truth t where not exists (select 1 from called c where ({KEYS.replace('contig', 'c.contig').replace(' pos', ' c.pos').replace(' ref', ' c.ref').replace(' alt', ' c.alt')}) = (t.contig, t.pos, t.ref, t.alt)) group by 1, 2, 3, 4", "truth called")
def compare_fn(spark, d) -> DataFrame:
    return compare.missed(truth(spark, d), called(spark, d)).groupBy(*compare.KEY).agg(F.count("*").alias("n"))


@query("select c.contig, c.pos, c.ref, c.alt, count(*) n from called c anti join (select distinct contig, pos, ref, alt from truth) t using (contig, pos, ref, alt) group by 1, 2, 3, 4", "truth called")
def compare_fp(spark, d) -> DataFrame:
    return compare.missed(called(spark, d), truth(spark, d)).groupBy(*compare.KEY).agg(F.count("*").alias("n"))


@query(
    """~
k as (
  select contig, 'tp' kind, count(*) n from (select contig, pos, ref, alt from truth intersect select contig, pos, ref, alt from called) group by 1
  union all select contig, 'fn', count(*) from truth anti join (select distinct contig, pos, ref, alt from called) using (contig, pos, ref, alt) group by 1
  union all select contig, 'fp', count(*) from called anti join (select distinct contig, pos, ref, alt from truth) using (contig, pos, ref, alt) group by 1),
t as (select case when grouping(contig) = 1 then 'TOTAL' else contig end contig, coalesce(sum(n) filter (kind = 'tp'), 0)::bigint tp, coalesce(sum(n) filter (kind = 'fn'), 0)::bigint fn, coalesce(sum(n) filter (kind = 'fp'), 0)::bigint fp from k group by rollup (contig)),
m as (select *, tp / nullif(tp + fp, 0) p, tp / nullif(tp + fn, 0) r from t)
select contig, tp, fn, fp, round(p, 6) "precision", round(r, 6) recall, round(2 * p * r / nullif(p + r, 0), 6) f1 from m""",
    "truth called",
)
def compare_rollup_metrics(spark, d) -> DataFrame:
    out = compare.rollup_metrics(truth(spark, d), called(spark, d))
    return out.select("contig", "tp", "fn", "fp", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@query(
    """~
inside as (select distinct v.contig, v.pos from vcf_fields v join bed b on v.contig = b.contig and v.pos - 1 >= b.start and v.pos - 1 < b.stop)
select coalesce(reason, 'compared') skip_reason, count(*) n from (
  select case when v.contig = 'chr5' then 'outside_simulated_contigs' when not regexp_full_match(alt, '[ACGTNacgtn]+') then 'symbolic' when gt in ('0/0', '0|0') then 'homozygous_ref'
    when filter not in ('PASS', '.') then 'filtered' when i.pos is null then 'outside_target_bed' end reason
  from vcf_fields v left join inside i on v.contig = i.contig and v.pos = i.pos) group by 1""",
    "vcf_fields bed",
)
def skip_reasons(spark, d) -> DataFrame:
    out = compare.with_skip_reason(vcf_fields(spark, d), F.col("contig") != "chr5", bed(spark, d))
    return out.groupBy(F.coalesce("skip_reason", F.lit("compared")).alias("skip_reason")).agg(F.count("*").alias("n"))


@query(
    """~
fn as (select * from truth anti join (select distinct contig, pos, ref, alt from called) using (contig, pos, ref, alt)),
tagged as (select case when contig = 'chr5' then ['outside_simulated_contigs'] when a and b then ['unknown'] else list_filter([case when not a then 'outside_mutation_bed' end, case when not b then 'outside_target_bed' end], lambda x: x is not null) end tags
  from (select contig, exists (select 1 from orders_bed o where o.id % 2 = 0 and o.contig = fn.contig and pos - 1 >= start and pos - 1 < stop) a, exists (select 1 from orders_bed o where o.id % 3 = 0 and o.contig = fn.contig and pos - 1 >= start and pos - 1 < stop) b from fn))
select reason, count(*) n from (select unnest(tags) reason from tagged) group by 1""",
    "truth called orders_bed",
)
def fn_attribution(spark, d) -> DataFrame:
    misses = compare.missed(truth(spark, d), called(spark, d))
    out = compare.miss_reasons(misses, F.col("contig") != "chr5", bed(spark, d, "o_orderkey % 2 = 0"), bed(spark, d, "o_orderkey % 3 = 0"))
    return out.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("select contig, count(*) n from truth t where exists (select 1 from bed b where b.contig = t.contig and t.pos - 1 >= b.start and t.pos - 1 < b.stop) group by 1", "truth bed")
def bed_semi_filter(spark, d) -> DataFrame:
    points = truth(spark, d).withColumn("pos0", F.col("pos") - 1)
    return intervals.points_in(points, bed(spark, d)).groupBy("contig").agg(F.count("*").alias("n"))


@query(
    "select a.id, count(*) n, sum(least(a.stop, b.stop + 11) - greatest(a.start, b.start + 11))::bigint bases from bed a join bed b on a.contig = b.contig and a.start < b.stop + 11 and b.start + 11 < a.stop group by 1",
    "bed",
)
def bed_intersect(spark, d) -> DataFrame:
    """All intervals with all of the same ones moved on by 11 bases."""
    moved = bed(spark, d).select("contig", (F.col("start") + 11).alias("start"), (F.col("end") + 11).alias("end"))
    hit = intervals.overlaps(bed(spark, d).select("contig", "start", "end", "id"), moved)
    return hit.groupBy("id").agg(F.count("*").alias("n"), F.sum(F.col("hi") - F.col("lo")).alias("bases"))


@query("select case when not regexp_full_match(alt, '[ACGTNacgtn]+') then 'SV' when length(ref) = 1 and length(alt) = 1 then 'SNP' when length(ref) = 1 then 'INS' when length(alt) = 1 then 'DEL' else 'Complex' end as type, contig, count(*) n from vcf_fields group by 1, 2", "vcf_fields")
def variant_types(spark, d) -> DataFrame:
    return vcf_fields(spark, d).groupBy(vcf.variant_type(F.col("ref"), F.col("alt")).alias("type"), "contig").agg(F.count("*").alias("n"))


@query(
    """select coalesce(drop_reason, 'kept') drop_reason, gt, count(*) n from (
  select case when regexp_full_match(alt, '[ACGTN]+') and length(ref) > 1 and length(alt) > 1 then 'complex' when alt = ref then 'alt_is_ref' when gt = './.' then 'no_call' when gt = '0/0' then 'homozygous_ref' end drop_reason,
    case when gt = './1' then '0/1' else gt end gt from vcf_fields) group by 1, 2""",
    "vcf_fields",
)
def input_vcf_filter(spark, d) -> DataFrame:
    out = compare.input_filter(vcf_fields(spark, d))
    return out.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("drop_reason"), "gt").agg(F.count("*").alias("n"))


@query(
    """~
o as (
  select t.contig, t.pos, t.ref, t.alt, case when n.contig is null then 'somatic' else 'shared' end origin from truth t left join (select distinct contig, pos, ref, alt from called where h % 3 = 0) n using (contig, pos, ref, alt)
  union all select contig, pos, ref, alt, 'germline' from (select * from called where h % 3 = 0) anti join (select distinct contig, pos, ref, alt from truth) using (contig, pos, ref, alt))
select contig, origin, count(*) n from o group by 1, 2""",
    "truth called",
)
def golden_merge_origin(spark, d) -> DataFrame:
    keep = [*compare.KEY]
    out = compare.merge_origins(truth(spark, d).select(*keep), called(spark, d).where("h % 3 = 0").select(*keep))
    return out.groupBy("contig", "origin").agg(F.count("*").alias("n"))


@query("select contig, count(*) n from (select distinct contig, unnest(range(pos, pos + greatest(length(ref), 1))) pos from edited) group by 1", "edited")
def known_site_positions(spark, d) -> DataFrame:
    return compare.known_positions(edited(spark, d)).groupBy("contig").agg(F.count("*").alias("n"))


@query(
    """~
known as (select distinct contig, unnest(range(pos, pos + length(ref))) pos from edited where h % 2 = 0)
select r.contig, count(*) n, count(k.pos) masked from records r left join known k using (contig, pos) group by 1""",
    "records edited",
)
def known_site_mask(spark, d) -> DataFrame:
    known = compare.known_positions(edited(spark, d).where("h % 2 = 0")).withColumn("known", F.lit(1))
    return records(spark, d).join(known, ["contig", "pos"], "left").groupBy("contig").agg(F.count("*").alias("n"), F.count("known").alias("masked"))


@query(
    """~
a as (select case when contig = 'chr1' then 'one' when contig = 'chr2' then 'two' else contig end contig from records)
select contig, count(*) n from a group by 1""",
    "records",
)
def alias_rename(spark, d) -> DataFrame:
    alias = records(spark, d).select("contig").distinct().where("contig in ('chr1', 'chr2')").select("contig", F.when(F.col("contig") == "chr1", "one").otherwise("two").alias("to"))
    out = records(spark, d).join(F.broadcast(alias), "contig", "left").select(F.coalesce("to", "contig").alias("contig"))
    return out.groupBy("contig").agg(F.count("*").alias("n"))


@query("~ gone as (select distinct contig from bed where contig not in (select contig from records where contig <> 'chr4')) select count(*) n_unmatched, coalesce(string_agg(contig, ',' order by contig), '') sample from gone", "bed records")
def naming_mismatch(spark, d) -> DataFrame:
    return compare.naming_mismatch(bed(spark, d), records(spark, d).where("contig <> 'chr4'"))


AF = "~ t as (select contig, pos, ref, alt, min(discount * 9 + 0.05) af from truth group by 1, 2, 3, 4), o as (select contig, pos, ref, alt, min(tax * 11 + 0.02) af from called group by 1, 2, 3, 4), dp as (select distinct contig, pos from records where quantity > 5), p as (select t.*, coalesce(o.af, case when dp.pos is not null then 0.0 end) seen from t left join o using (contig, pos, ref, alt) left join dp using (contig, pos)) "


def _af_pairs(spark, d) -> DataFrame:
    t = truth(spark, d).groupBy(*compare.KEY).agg(F.min(F.col("discount") * 9 + 0.05).alias("af"))
    o = called(spark, d).groupBy(*compare.KEY).agg(F.min(F.col("tax") * 11 + 0.02).alias("af"))
    return compare.observed_fraction(t, o, records(spark, d).select("contig", "pos", F.col("quantity").alias("dp")), 5)


@query(
    AF + """, s as (select af, seen, rank() over (order by af) + (count(*) over (partition by af) - 1) / 2.0 ra, rank() over (order by seen) + (count(*) over (partition by seen) - 1) / 2.0 rb from p where seen is not null)
select count(*) n, round(corr(af, seen), 6) pearson, round(corr(ra, rb), 6) spearman, round(avg(abs(seen - af)), 6) mae, round(sqrt(avg((seen - af) * (seen - af))), 6) rmse, round(avg(seen - af), 6) bias from s""",
    "truth called records",
)
def af_pearson_spearman(spark, d) -> DataFrame:
    out = compare.fraction_metrics(_af_pairs(spark, d), "af", "seen")
    return out.select("n", *[r6(c).alias(c) for c in ("pearson", "spearman", "mae", "rmse", "bias")])


@query(AF + "select least(floor(af * 10), 9)::bigint bin, count(*) planted, count(seen) scored, count(*) - count(seen) unscored, round(avg(abs(seen - af)), 6) mae from p group by 1", "truth called records")
def af_deciles(spark, d) -> DataFrame:
    return compare.deciles(_af_pairs(spark, d), "af", "seen").withColumn("mae", r6("mae"))


@query(
    """~
v as (select h, case (h // 7) % 3 when 0 then 'GT:AD:AF' when 1 then 'GT:AD' else 'GT' end f, case (h // 7) % 3 when 0 then '0/1:' || a || ',' || b || ':' || (a / 64.0)::double::varchar when 1 then '0/1:' || a || ',' || b else '0/1' end s,
    case when (h // 7) % 3 = 2 and (h // 32) % 2 = 0 then a / 64.0 end i, a, b, (h // 7) % 3 k from (select h, (h // 3) % 60 a, (h // 5) % 40 b from records))
select h, round(case k when 0 then a / 64.0 when 1 then case when a + b > 0 then b / (a + b) end else i end, 6) af from v""",
    "records",
)
def af_extract(spark, d) -> DataFrame:
    h = F.col("h")
    v = records(spark, d).select("h", (F.floor(h / 3) % 60).alias("a"), (F.floor(h / 5) % 40).alias("b"), (F.floor(h / 7) % 3).alias("k"))
    ad, share = F.concat_ws(",", F.col("a").cast("string"), F.col("b").cast("string")), (F.col("a") / 64.0).cast("string")
    fmt = F.when(F.col("k") == 0, "GT:AD:AF").when(F.col("k") == 1, "GT:AD").otherwise("GT")
    sample = F.when(F.col("k") == 0, F.concat_ws(":", F.lit("0/1"), ad, share)).when(F.col("k") == 1, F.concat_ws(":", F.lit("0/1"), ad)).otherwise("0/1")
    info = F.when((F.col("k") == 2) & (F.floor(h / 32) % 2 == 0), F.concat(F.lit("DP=10;AF="), share)).otherwise("DP=10")
    return v.select("h", r6(F.get(vcf.allele_fractions(fmt, sample, info, F.lit(1)), F.lit(0))).alias("af"))


@query(
    """~
a as (select id, case id % 7 when 0 then '<DEL>' when 1 then '<DUP:TANDEM>' when 2 then 'A[' || contig || ':' || pos || '[' when 3 then 'AC]' || contig || ':' || pos || ']' when 4 then ']' || contig || ':' || pos || ']GT' when 5 then '<FOO>' else '[' || contig || ':' || pos || '[T' end alt, contig, pos from structural)
select id, case id % 7 when 0 then 'DEL' when 1 then 'DUP' when 5 then 'UNKNOWN' else 'BND' end kind, case when id % 7 in (2, 3, 4, 6) then contig else '' end mate_contig, case when id % 7 in (2, 3, 4, 6) then pos else -1 end mate_pos,
  id % 7 in (2, 3) join_after, id % 7 in (2, 6) mate_extends_right, case id % 7 when 3 then 'C' when 4 then 'G' else '' end inserted from a""",
    "structural",
)
def sv_alt_parse(spark, d) -> DataFrame:
    s, k, at = structural(spark, d), F.col("id") % 7, F.concat_ws(":", F.col("contig"), F.col("pos").cast("string"))
    alt = F.when(k == 0, "<DEL>").when(k == 1, "<DUP:TANDEM>").when(k == 2, F.concat(F.lit("A["), at, F.lit("["))).when(k == 3, F.concat(F.lit("AC]"), at, F.lit("]"))).when(k == 4, F.concat(F.lit("]"), at, F.lit("]GT"))).when(k == 5, "<FOO>").otherwise(F.concat(F.lit("["), at, F.lit("[T")))
    s = s.select("id", alt.alias("alt")).withColumn("b", vcf.breakend(F.col("alt")))
    return s.select("id", vcf.sv_type(F.col("alt")).alias("kind"), *[F.coalesce(f"b.{c}", F.lit(v)).alias(c) for c, v in (("mate_contig", ""), ("mate_pos", -1), ("join_after", False), ("mate_extends_right", False), ("inserted", ""))])


@query("select id, case when id % 3 = 0 then length + 1 when id % 3 = 1 then length else -1 end span from structural", "structural")
def sv_info_span(spark, d) -> DataFrame:
    k = F.col("id") % 3
    info = F.when(k == 0, F.concat(F.lit("SVTYPE=DEL;END="), (F.col("pos") + F.col("length")).cast("string"))).when(k == 1, F.concat(F.lit("END=x;SVLEN=-"), F.col("length").cast("string"))).otherwise("IMPRECISE")
    return structural(spark, d).withColumn("info", info).select("id", F.coalesce(vcf.sv_span(F.col("pos"), F.col("info")), F.lit(-1)).alias("span"))


@query("select gt, count(*) n, round(min(case when gt in ('1/1', './1') then 1.0 when gt = './.' then null when gt = '0/0' then 0.0 else 0.5 end)::double, 6) dosage, bool_and(gt in ('1/1', './1', './.')) homozygous from vcf_fields group by 1", "vcf_fields")
def genotype_dosage(spark, d) -> DataFrame:
    g = F.col("gt")
    return vcf_fields(spark, d).groupBy("gt").agg(F.count("*").alias("n"), r6(F.min(vcf.dosage(g))).alias("dosage"), F.min(vcf.homozygous(g)).alias("homozygous"))


@query(
    """~
m as (select least(l_partkey, l_suppkey) lo, greatest(l_partkey, l_suppkey) hi from lineitem) select lo, hi, count(*) n from m group by 1, 2 having count(*) >= 2""",
    "li",
)
def bnd_mate_pairs(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    pairs = li.select(F.least("l_partkey", "l_suppkey").alias("lo"), F.greatest("l_partkey", "l_suppkey").alias("hi"))
    return pairs.groupBy("lo", "hi").agg(F.count("*").alias("n")).where("n >= 2")


@query(
    """~ b as (select l_orderkey * 8 + l_linenumber id, 'chr' || (l_suppkey % 5 + 1)::varchar c, (l_partkey * 7 % 3000)::bigint p, 'chr' || (l_partkey % 5 + 1)::varchar d, (l_suppkey * 11 % 3000)::bigint q from lineitem),
r as (select *, (c, p) <= (d, q) o from b), k as (select case when o then c else d end c1, case when o then p else q end p1, case when o then d else c end c2, case when o then q else p end p2, id from r)
select c1, p1, c2, p2, min(id)::bigint first, count(*) n from k group by all""",
    "li",
)
def breakend_pairs(spark, d) -> DataFrame:
    """Junctions that line items name from one end or the other."""
    s, p = F.col("l_suppkey"), F.col("l_partkey")
    name = lambda x: F.concat(F.lit("chr"), (x % 5 + 1).cast("string"))
    b = table(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), name(s).alias("contig"), (p * 7 % 3000).alias("pos"), name(p).alias("mate_contig"), (s * 11 % 3000).alias("mate_pos"))
    return compare.breakend_pairs(b).select(F.col("low.contig").alias("c1"), F.col("low.pos").alias("p1"), F.col("high.contig").alias("c2"), F.col("high.pos").alias("p2"), "first", "n")


@query("~ c as (select concat('doc', doc_id::varchar) contig from documents) select count(*) n from c semi join (select contig from contigs where length(seq) > 500) using (contig)", "contigs")
def contig_filter(spark, d) -> DataFrame:
    long = contigs(spark, d).where("length(seq) > 500")
    return contigs(spark, d).select("contig").join(long.select("contig"), "contig", "left_semi").agg(F.count("*").alias("n"))
