"""Registered queries: sequence contexts and model fitting."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence, vcf
from ..operators import fit, intervals, kernel, qualities
from ..sources import sinks
from ..staging import shared_dir, staged
from .compare import r6
from .inputs import alignments, contigs, edited, fragments, located, reads, records, structural, vcf_fields, with_inputs

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None, needs: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_inputs(needs, sql)
        return f

    return add


@query("select contig, length(seq)::bigint n_bases, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) rc_md5, round(100 * length(regexp_replace(seq, '[^GC]', '', 'g')) / nullif(length(replace(seq, 'N', '')), 0))::int gc from contigs where length(seq) > 0", "contigs")
def contig_stats(spark, d) -> DataFrame:
    c = contigs(spark, d).where("length(seq) > 0")
    return c.select("contig", F.length("seq").cast("long").alias("n_bases"), F.md5(sequence.reverse_complement(F.col("seq")).cast("binary")).alias("rc_md5"), sequence.gc_percent(F.col("seq")).alias("gc"))


@query(
    """~
b as (select contig, i, seq[i] c from (select contig, seq, unnest(range(1, length(seq) + 1)) i from contigs)),
g as (select contig, i, i - row_number() over (partition by contig, c = 'N' order by i) g, c = 'N' n from b)
select contig, min(i) - 1 as start, max(i) as stop from g where not n group by contig, g""",
    "contigs",
)
def non_n_runs(spark, d) -> DataFrame:
    return fit.runs(contigs(spark, d)).select("contig", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("stop"))


@query("~ r as (select unnest(regexp_extract_all(seq, 'A+|C+|G+|T+')) run from contigs) select run[1] base, least(length(run), 8)::bigint run_length, count(*) n from r group by 1, 2", "contigs")
def homopolymer_hist(spark, d) -> DataFrame:
    return fit.homopolymers(contigs(spark, d), 8).withColumn("run_length", F.col("run_length").cast("long"))


TRINUC = "~ t as (select substr(seq, i, 3) kmer, contig, i from (select contig, seq, unnest(range(1, length(seq) - 1)) i from contigs)), k as (select * from t where not contains(kmer, 'N')) "


@query(TRINUC + "select kmer, count(*) n from k group by 1", "contigs")
def trinuc_counts(spark, d) -> DataFrame:
    return kernel.count_kmers(contigs(spark, d), 3)


#: Variants with the three bases around their place and an alternative to the middle one.
FRAMES = "f as (select contig, substr(seq, pos0, 3) kmer, h from located where pos0 >= 1 and pos0 + 2 <= length), m as (select contig, kmer, substr('ACGT', ((position(kmer[2] in 'ACGT') + (h // 4) % 3) % 4)::int + 1, 1) alt, h from f where not contains(kmer, 'N')) "


def framed(spark, d) -> DataFrame:
    f = kernel.context(located(spark, d), contigs(spark, d)).where(~F.col("frame").contains("N"))
    step = (F.instr(F.lit("ACGT"), F.substring("frame", 2, 1)) + F.floor(F.col("h") / 4) % 3) % 4
    return f.select("contig", F.col("frame").alias("kmer"), F.substr(F.lit("ACGT"), (step + 1).cast("int"), F.lit(1)).alias("alt"), "h")


@query(
    TRINUC + ", " + FRAMES + """, o as (select kmer, count(*) occ from k group by 1), c as (select kmer, alt, count(*) n from m group by 1, 2)
select kmer, alt, n, round(n / occ, 6) p_mut, round(n / sum(n) over (partition by kmer), 6) p_alt from c join o using (kmer)""",
    "contigs located",
)
def trinuc_transitions(spark, d) -> DataFrame:
    """Variants joined with the bases around them, against all frames of the contigs."""
    occ = kernel.count_kmers(contigs(spark, d), 3).withColumnRenamed("n", "occ")  # 64 rows
    c = framed(spark, d).groupBy("kmer", "alt").agg(F.count("*").alias("n"))
    return fit.row_shares(c.join(F.broadcast(occ), "kmer"), ["kmer"], "n").select("kmer", "alt", "n", r6(F.col("n") / F.col("occ")).alias("p_mut"), r6("share").alias("p_alt"))


@query("select case when substr(seq, pos0::int + 1, 1) = ref then 'match' when substr(seq, pos0::int + 1, 1) = 'N' then 'unknown' else 'mismatch' end verdict, count(*) n from located group by 1", "located")
def ref_check(spark, d) -> DataFrame:
    """Stated REF bases against the contigs'."""
    f = kernel.context(located(spark, d), contigs(spark, d), flank=0)
    return f.groupBy(F.when(F.col("frame") == F.col("ref"), "match").when(F.col("frame") == "N", "unknown").otherwise("mismatch").alias("verdict")).agg(F.count("*").alias("n"))


@query(TRINUC + "select kmer[1] || 'N' || kmer[3] context, kmer[2] base, count(*) n, round(count(*) / sum(count(*)) over (partition by kmer[1] || 'N' || kmer[3]), 6) share from k group by 1, 2", "contigs")
def context_fold16(spark, d) -> DataFrame:
    k = kernel.count_kmers(contigs(spark, d), 3)
    c = k.groupBy(fit.fold_context(F.col("kmer")).alias("context"), F.substring("kmer", 2, 1).alias("base")).agg(F.sum("n").alias("n"))
    return fit.row_shares(c, ["context"], "n").withColumn("share", r6("share"))


@query("~ k as (select case when length(ref) > 1 and length(alt) = 1 then 'DEL' when length(ref) = 1 and length(alt) > 1 then 'INS' end kind, abs(length(ref) - length(alt))::bigint len from edited) select kind, len, count(*) n from k where kind is not null group by 1, 2", "edited")
def indel_len_hist(spark, d) -> DataFrame:
    e = edited(spark, d).withColumn("kind", vcf.variant_type(F.col("ref"), F.col("alt"))).where("kind in ('INS', 'DEL')")
    return e.groupBy("kind", F.abs(F.length("ref") - F.length("alt")).cast("long").alias("len")).agg(F.count("*").alias("n"))


@query(
    """~
t as (select case when not regexp_full_match(alt, '[ACGTN]+') then 'SV' when length(ref) = 1 and length(alt) = 1 then 'SNP' when length(ref) = 1 then 'INS' when length(alt) = 1 then 'DEL' else 'Complex' end k, gt not in ('0/1', '0|1', '1|0', '0/0') hom from vcf_fields),
u as (select * from t where k in ('SNP', 'INS', 'DEL'))
select round(avg((k = 'SNP')::int), 6) snp, round(avg((k = 'INS')::int), 6) ins, round(avg((k = 'DEL')::int), 6) del, round(avg(hom::int), 6) homozygous from u""",
    "vcf_fields",
)
def variant_mix(spark, d) -> DataFrame:
    v = vcf_fields(spark, d).select(vcf.variant_type(F.col("ref"), F.col("alt")).alias("type"), vcf.homozygous(F.col("gt")).alias("homozygous"))
    return fit.variant_mix(v).select(*[r6(c).alias(c) for c in ("snp", "ins", "del", "homozygous")])


@query("~ g as (select type, count(*) n, avg(ln(length)) mu, stddev_pop(ln(length)) sigma, avg((gt = '1/1')::int) homozygous from structural where length >= 50 group by 1 having count(*) >= 2) select type, n, round(n / sum(n) over (), 6) probability, round(mu, 6) mu, round(sigma, 6) sigma, round(homozygous, 6) homozygous from g", "structural")
def sv_lognormal_fit(spark, d) -> DataFrame:
    out = fit.sv_model(structural(spark, d).withColumn("homozygous", vcf.homozygous(F.col("gt"))))
    return out.select("type", "n", *[r6(c).alias(c) for c in ("probability", "mu", "sigma", "homozygous")])


@query("select cn, count(*) n, round(count(*) / sum(count(*)) over (), 6) p from structural where type = 'CNV' group by 1", "structural")
def cn_distribution(spark, d) -> DataFrame:
    c = structural(spark, d).where("type = 'CNV'").groupBy("cn").agg(F.count("*").alias("n"))
    return fit.row_shares(c.withColumn("all", F.lit(0)), ["all"], "n").select("cn", "n", r6("share").alias("p"))


TLEN = "~ t as (select abs(tlen)::bigint len from alignments where paired and first and mate_mapped and same_ref and not secondary and mapq > 10 and tlen > 0), h as (select len, count(*) n from t group by 1) "


def _tlen_hist(spark, d) -> DataFrame:
    a = alignments(spark, d).where("paired and first and mate_mapped and same_ref and not secondary and mapq > 10 and tlen > 0")
    return fit.histogram(a.select(F.abs("tlen").cast("long").alias("len")), "len")


@query(TLEN + "select len, n from h", "alignments")
def frag_hist(spark, d) -> DataFrame:
    return _tlen_hist(spark, d)


@query(TLEN + ", c as (select len, sum(n) over (order by len) cum, sum(n) over () total from h) select q::double q, min(len) x from c, unnest([0.01, 0.25, 0.5, 0.75, 0.99]) u(q) where cum >= greatest(1, ceil(q * total)) group by 1", "alignments")
def frag_hist_quantile(spark, d) -> DataFrame:
    h, out = _tlen_hist(spark, d), None
    for q in (0.01, 0.25, 0.5, 0.75, 0.99):
        own = fit.histogram_quantile(h, "len", q).select(F.lit(q).alias("q"), "x")
        out = own if out is None else out.union(own)
    return out


MAD = TLEN + """, c as (select len, n, sum(n) over (order by len) cum, sum(n) over () total from h), m as (select min(len) med from c where cum >= greatest(1, ceil(0.5 * total))),
dv as (select abs(len - med) dev, sum(n) n from h, m group by 1), dc as (select dev, sum(n) over (order by dev) cum, sum(n) over () total from dv), mad as (select min(dev) mad from dc where cum >= greatest(1, ceil(0.5 * total))) """


@query(MAD + "select med median, mad from m, mad", "alignments")
def frag_median_mad(spark, d) -> DataFrame:
    return fit.median_and_mad(_tlen_hist(spark, d), "len")


@query(MAD + ", k as (select len, n from h, m, mad where mad = 0 or len <= med + 1.5 * mad), e as (select len, n, sum(n) over (order by len) up, sum(n) over (order by len desc) down, sum(n) over () total from k) select len, n from e where up >= 0.001 * total and down >= 0.001 * total", "alignments")
def frag_mad_trim(spark, d) -> DataFrame:
    return fit.trimmed(_tlen_hist(spark, d), "len", 1.5, 0.001)


@query(TLEN + "select sum(n)::bigint n, round(sum(len * n) / sum(n), 6) mean, round(sqrt(sum(len * len * n) / sum(n) - (sum(len * n) / sum(n)) * (sum(len * n) / sum(n))), 4) sd from h", "alignments")
def frag_mean_sd(spark, d) -> DataFrame:
    return fit.weighted_moments(_tlen_hist(spark, d), "len").select("n", r6("mean").alias("mean"), F.round("sd", 4).alias("sd"))


@query()
def frag_smoothed(spark, d) -> DataFrame:
    return fit.smoothed(_tlen_hist(spark, d), "len").withColumn("weight", r6("weight"))


GC = "~ w as (select contig, i::bigint as start, substr(seq, i + 1, 100) s from (select contig, seq, unnest(range(0, length(seq) - 99, 50)) i from contigs where length(seq) >= 100)), g as (select contig, start, round(100 * length(regexp_replace(s, '[^GC]', '', 'g')) / length(replace(s, 'N', '')))::int gc from w where length(replace(s, 'N', '')) > 0) "


@query(GC + "select gc, count(*) n, min(contig) first_contig from g group by 1", "contigs")
def gc_window_bins(spark, d) -> DataFrame:
    return fit.gc_windows(contigs(spark, d), 100, 50).groupBy("gc").agg(F.count("*").alias("n"), F.min("contig").alias("first_contig"))


WEIGHTS = GC + """, d as (select contig, pos0 s, least(pos0 + 100 + quantity * 6, length) e from located),
c as (select g.gc, sum(case when s is null then 0 else least(e, g.start + 100) - greatest(s, g.start) end) / 100.0 coverage from g left join d on g.contig = d.contig and s < g.start + 100 and e > g.start group by g.contig, g.start, g.gc),
s as (select gc, median(coverage) m from c group by 1 having count(*) >= 10),
p as (select median(coverage) p from c where gc in (select gc from s)), a as (select gc a, m / p w from s, p where p > 0),
b as (select r.gc::int gc, max(lo.a) la, min(hi.a) ha from range(101) r(gc) left join a lo on lo.a <= r.gc left join a hi on hi.a >= r.gc group by 1)
"""


@query(
    WEIGHTS
    + """select b.gc, round(coalesce(case when la = ha then x.w else x.w + (y.w - x.w) * (b.gc - la) / (ha - la) end, x.w, y.w, 1.0), 6) weight from b left join a x on x.a = la left join a y on y.a = ha""",
    "contigs located",
)
def gc_weight_interp(spark, d) -> DataFrame:
    """Depth of the fragments at their places, by windows of the contigs' bases."""
    covered = located(spark, d).select("contig", F.col("pos0").alias("start"), F.least(F.col("pos0") + 100 + F.col("quantity") * 6, F.col("length")).alias("end"))
    w = fit.window_coverage(fit.gc_windows(contigs(spark, d), 100, 50), intervals.depth(covered), 100)
    return fit.gc_weights(w).withColumn("weight", r6("weight"))


@query(
    """~ x as (select unnest(range(1, len(scores) + 1)) i, scores from reads)
select i::bigint pos, (case when i > 1 then scores[i - 1] else -1 end)::int prev, scores[i]::int "next", count(*) n from x group by 1, 2, 3""",
    "reads",
)
def qual_transition_counts(spark, d) -> DataFrame:
    return fit.quality_transitions(reads(spark, d)).withColumn("pos", F.col("pos").cast("long"))


@query(
    WEIGHTS
    + """, v as (select b.gc, coalesce(case when la = ha then x.w else x.w + (y.w - x.w) * (b.gc - la) / (ha - la) end, x.w, y.w, 1.0) weight, b.gc in (select a from a) fitted from b left join a x on x.a = la left join a y on y.a = ha)
select v.gc, concat_ws(chr(9), v.gc::varchar, count(c.gc)::varchar, printf('%.3f', round(round(coalesce(median(coverage), 0.0)::double, 9), 3)), printf('%.3f', round(round(coalesce(avg(coverage), 0.0)::double, 9), 3)), printf('%.6f', weight::double), case when fitted then 'fitted' else 'interpolated' end) line from v left join c on c.gc = v.gc group by v.gc, weight, fitted""",
    "contigs located",
)
def gc_bin_report(spark, d) -> DataFrame:
    """The report's lines, written and read again."""
    covered = located(spark, d).select("contig", F.col("pos0").alias("start"), F.least(F.col("pos0") + 100 + F.col("quantity") * 6, F.col("length")).alias("end"))
    w = staged(fit.window_coverage(fit.gc_windows(contigs(spark, d), 100, 50), intervals.depth(covered), 100), "windows")
    path = f"{shared_dir(spark)}/gc_bins-{uuid.uuid4().hex}"
    sinks.write_bins(sinks.gc_bin_lines(w, fit.gc_weights(w, fitted=True)), "gc", sinks.GC_COLUMNS, path)
    lines = spark.read.text(path).where("value not like 'gc%'")
    return lines.select(F.split_part("value", F.lit("\t"), F.lit(1)).cast("int").alias("gc"), F.col("value").alias("line"))


#: Pieces of even number as the first mate's reads, the others as the second's.
MATES = """~ r as (select 2 - ((ascii(right(read_id, 1)) - 48 + 1) % 2)::int mate, scores, len(scores) >= 50 and list_sum(list_slice(scores, len(scores) - 49, len(scores))) / 50.0 < 25 degraded from reads),
x as (select mate, degraded, unnest(range(1, len(scores) + 1)) i, scores from r), t as (select mate::bigint mate, coalesce(degraded, false) degraded, i::bigint pos, (case when i > 1 then scores[i - 1] else -1 end)::int prev, scores[i]::int nxt, count(*) n from x group by all) """


def _tensor(spark, d) -> DataFrame:
    odd = (F.ascii(F.right("read_id", F.lit(1))) - 48) % 2
    return qualities.tensor(reads(spark, d).withColumn("mate", 1 + odd))


@query(MATES + 'select mate, degraded, pos, prev, nxt "next", n from t', "reads")
def quality_tensor(spark, d) -> DataFrame:
    """Transitions of both mates' scores, of reads with a degraded tail and of the others."""
    return _tensor(spark, d)


@query(MATES + """, o as (select count(distinct nxt) k from t) select mate, degraded, pos, prev, nxt "next", round(n / sum(n) over (partition by mate, degraded, pos, prev), 12) share from t
union all select distinct mate, degraded, pos, null, null, round(1 / k, 12) from t, o where prev >= 0""", "reads")
def quality_populations(spark, d) -> DataFrame:
    return qualities.shares(qualities.covering(_tensor(spark, d))).withColumn("share", F.round("share", 12))


@query(MATES + """, g as (select mate, degraded, pos, prev, (prev + 3) % 42 nxt from t where prev >= 0 group by all), o as (select count(distinct nxt) k from t), w as (select mate, degraded, pos, prev, sum(n) total from t group by all)
select mate, degraded, count(*) n, round(sum(case when w.total is null then 1 / k else coalesce(t.n, 0) / w.total end), 6) share from (select mate, degraded, pos, prev, nxt from g union all select mate, degraded, pos, -7, nxt from g) g left join t using (mate, degraded, pos, prev, nxt) left join w using (mate, degraded, pos, prev), o group by 1, 2""", "reads")
def quality_lookup(spark, d) -> DataFrame:
    """Shares that the model gives for a score three above each one, and after a score that no read has."""
    t = staged(_tensor(spark, d), "tensor")
    g = t.where("prev >= 0").select(*qualities.ROW, ((F.col("prev") + 3) % 42).alias("next")).distinct()
    wanted = g.unionByName(g.withColumn("prev", F.lit(-7)))
    return qualities.share_of(wanted, qualities.shares(t)).groupBy("mate", "degraded").agg(F.count("*").alias("n"), F.round(F.sum("share"), 6).alias("share"))


@query("~ q as (select unnest(scores) q from reads), s as (select q, list_sort(list_transform([2, 11, 25, 37], lambda b: {'d': abs(b - q), 'b': b}))[1].b bin from q) select q::int q, bin::int bin, count(*) n from s group by 1, 2", "reads")
def snap_to_bin(spark, d) -> DataFrame:
    q = reads(spark, d).select(F.explode("scores").alias("q"))
    return q.groupBy("q", sequence.snap(F.col("q"), [2, 11, 25, 37]).alias("bin")).agg(F.count("*").alias("n"))


@query("select case when len(scores) < 50 then 'short' when list_sum(list_slice(scores, len(scores) - 49, len(scores))) / 50.0 < 25 then 'degraded' else 'good' end kind, count(*) n from reads group by 1", "reads")
def degraded_reads(spark, d) -> DataFrame:
    out = fit.degraded(reads(spark, d))
    return out.groupBy(F.when(F.col("degraded").isNull(), "short").when(F.col("degraded"), "degraded").otherwise("good").alias("kind")).agg(F.count("*").alias("n"))


@query("~ q as (select unnest(scores) q from reads) select count(*) bases, round(avg(pow(10, -q / 10.0)), 6) error_rate, count(distinct q) options from q", "reads")
def error_rate_summary(spark, d) -> DataFrame:
    q = reads(spark, d).select(F.explode("scores").alias("q"))
    return q.agg(F.count("*").alias("bases"), r6(F.avg(sequence.error_probability(F.col("q")))).alias("error_rate"), F.countDistinct("q").alias("options"))


@query(
    """~
m as (select contig, pos, ref, h, row_number() over (partition by contig, pos order by h, order_id, line_id) k from records),
p as (select a.h % 5 bin, a.ref b1, b.ref b2, substr('ACGT', ((a.h // 11) % 4)::int + 1, 1) ref, (a.h // 3) % 9 = 0 masked from m a join m b on a.contig = b.contig and a.pos = b.pos and a.k = 1 and b.k = 2)
select bin, case when masked then 'masked' when b1 = b2 then 'agree' when b2 = ref then 'first_differs' when b1 = ref then 'second_differs' else 'neither' end outcome, count(*) n from p group by 1, 2""",
    "records",
)
def overlap_matrix(spark, d) -> DataFrame:
    from pyspark.sql import Window

    r = records(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("contig", "pos").orderBy("h", "order_id", "line_id")))
    a, b = r.where("k = 1"), r.where("k = 2").select("contig", "pos", F.col("ref").alias("b2"))
    p = a.join(b, ["contig", "pos"]).select((F.col("h") % 5).alias("bin"), F.col("ref").alias("b1"), "b2", F.substr(F.lit("ACGT"), (F.floor(F.col("h") / 11) % 4 + 1).cast("int"), F.lit(1)).alias("ref"), (F.floor(F.col("h") / 3) % 9 == 0).alias("masked"))
    return fit.overlap_matrix(p)


@query("~ c as (select ref, alt \"read\", count(*) n from records where ref <> 'T' group by 1, 2), b as (select a.x ref, b.x \"read\" from unnest(['A', 'C', 'G', 'T']) a(x), unnest(['A', 'C', 'G', 'T']) b(x) where a.x <> b.x), f as (select b.*, coalesce(n, 0) n, sum(coalesce(n, 0)) over (partition by b.ref) t from b left join c using (ref, \"read\")) select ref, \"read\", round(case when t > 0 then n / t else 1 / 3 end, 6) share from f", "records")
def substitution_matrix(spark, d) -> DataFrame:
    c = records(spark, d).where("ref <> 'T'").groupBy("ref", F.col("alt").alias("read")).agg(F.count("*").alias("n"))
    return fit.normalized_matrix(c).withColumn("share", r6("share"))


@query("select count(*) n, sum(stop - start)::bigint total, max(stop - start) longest, count(distinct contig) contigs from fragments", "fragments")
def fragment_totals(spark, d) -> DataFrame:
    n = F.col("end") - F.col("start")
    return fragments(spark, d).agg(F.count("*").alias("n"), F.sum(n).alias("total"), F.max(n).alias("longest"), F.countDistinct("contig").alias("contigs"))
