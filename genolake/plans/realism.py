"""Registered queries: realism measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import breakpoints, intervals, realism
from .compare import r6
from .fit import FRAMES, framed
from .inputs import alignments, bed, fragments, structural, table, with_inputs

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None, needs: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_inputs(needs, sql) if needs else sql
        return f

    return add


@query(
    """~
x as (select contig, abs(tlen)::bigint i from alignments where not secondary), m as (select contig, count(*) n, avg(i) mean, avg(i * i) m2, avg(i * i * i) m3 from x group by 1),
r as (select contig, i, row_number() over (partition by contig order by i) k from x)
select m.contig, n, round(mean, 4) mean, round(sqrt(m2 - mean * mean), 4) sd, round((m3 - 3 * mean * m2 + 2 * mean * mean * mean) / pow(m2 - mean * mean, 1.5), 4) skew, i p99
from m join r on m.contig = r.contig and k = floor(0.99 * n)::bigint % n + 1""",
    "alignments",
)
def insert_stats(spark, d) -> DataFrame:
    x = alignments(spark, d).where("not secondary").select("contig", F.abs("tlen").cast("long").alias("insert"))
    return realism.insert_stats(x, ["contig"]).select("contig", "n", *[F.round(c, 4).alias(c) for c in ("mean", "sd", "skew")], "p99")


@query(
    """~
e as (select contig, start as p, 1 d from fragments union all select contig, stop, -1 from fragments), s as (select contig, p, sum(d) d from e group by 1, 2 having sum(d) <> 0),
r as (select contig, lead(p) over w - p n, (sum(d) over w)::bigint x from s window w as (partition by contig order by p)),
g as (select contig, sum(n)::bigint n, sum(n * x) / sum(n) mean, sum(n * x * x) / sum(n) m2 from r where x > 0 group by 1)
select contig, n, round(mean, 4) mean, round((m2 - mean * mean) / mean, 4) vmr, round(((m2 - mean * mean) / mean - 1) / mean, 4) excess from g""",
    "fragments",
)
def depth_vmr(spark, d) -> DataFrame:
    runs = intervals.depth(fragments(spark, d).select("contig", "start", "end"))
    return realism.depth_stats(runs).select("contig", "n", *[F.round(c, 4).alias(c) for c in ("mean", "vmr", "excess")])


@query("~ b as (select contig, start // 500 bin, count(*) n from fragments group by 1, 2), l as (select contig, n, lead(n, 3) over (partition by contig order by bin) later from b) select contig, round(corr(n, later), 6) autocorrelation from l where later is not null group by 1", "fragments")
def depth_autocorrelation(spark, d) -> DataFrame:
    b = fragments(spark, d).groupBy("contig", F.floor(F.col("start") / 500).alias("bin")).agg(F.count("*").alias("n"))
    return realism.autocorrelation(b, "contig", "bin", "n", 3).withColumn("autocorrelation", r6("autocorrelation"))


@query("select contig, pos0, count(*) n, round(avg(mapq), 6) mean_mapq from alignments where left_clip >= 20 group by 1, 2 having count(*) >= 2", "alignments")
def clip_breakpoints(spark, d) -> DataFrame:
    return realism.clip_breakpoints(alignments(spark, d), 20, 2).withColumn("mean_mapq", r6("mean_mapq"))


@query(
    "select contig, count(*) n, round(avg((left_clip > 0)::int), 6) clip_rate, round(avg((not (paired and mate_mapped and same_ref))::int), 6) improper_rate, round(avg((mapq = 0)::int), 6) mapq0_rate from alignments where not secondary group by 1",
    "alignments",
)
def region_rates(spark, d) -> DataFrame:
    share = lambda c: r6(F.avg(F.when(c, 1.0).otherwise(0.0)))
    proper = F.col("paired") & F.col("mate_mapped") & F.col("same_ref")
    return alignments(spark, d).where("not secondary").groupBy("contig").agg(F.count("*").alias("n"), share(F.col("left_clip") > 0).alias("clip_rate"), share(~proper).alias("improper_rate"), share(F.col("mapq") == 0).alias("mapq0_rate"))


SBS = "~ " + FRAMES + """, c as (select case when kmer[2] in ('A', 'G') then reverse(translate(kmer, 'ACGT', 'TGCA')) else kmer end kmer, case when kmer[2] in ('A', 'G') then translate(alt, 'ACGT', 'TGCA') else alt end alt, h from m),
s as (select kmer[1] || '[' || kmer[2] || '>' || alt || ']' || kmer[3] class, h from c) """


def _sbs(spark, d) -> DataFrame:
    return framed(spark, d).select(realism.sbs96(F.col("kmer"), F.col("alt")).alias("class"), "h")


@query(SBS + "select class, count(*) n from s group by 1", "located")
def sbs96_spectrum(spark, d) -> DataFrame:
    return _sbs(spark, d).groupBy("class").agg(F.count("*").alias("n"))


@query(SBS + ", a as (select class, count(*) x from s where h % 2 = 0 group by 1), b as (select class, count(*) y from s where h % 2 = 1 group by 1) select round(sum(coalesce(x, 0) * coalesce(y, 0)) / (sqrt(sum(coalesce(x, 0) * coalesce(x, 0))) * sqrt(sum(coalesce(y, 0) * coalesce(y, 0)))), 6) cosine from a full join b using (class)", "located")
def sbs96_cosine(spark, d) -> DataFrame:
    """The spectra of two samples into which all variants are dealt."""
    n = _sbs(spark, d).groupBy("class", (F.col("h") % 2).alias("sample")).agg(F.count("*").alias("n"))
    a, b = (n.where(F.col("sample") == i).select("class", "n") for i in (0, 1))
    return realism.cosine(a, b, "class", "n").withColumn("cosine", r6("cosine"))


@query("~ a as (select distinct contig, pos0 from alignments where left_clip >= 30), b as (select distinct contig, pos - 1 p from structural) select a.contig, count(*) pairs, sum(abs(pos0 - p))::bigint total from a join b on a.contig = b.contig and abs(pos0 - p) <= 50 group by 1", "alignments structural")
def near_breakpoints(spark, d) -> DataFrame:
    a = alignments(spark, d).where("left_clip >= 30").select("contig", "pos0").distinct()
    b = structural(spark, d).select("contig", (F.col("pos") - 1).alias("pos0")).distinct()
    return realism.near(a, b, 50).groupBy("contig").agg(F.count("*").alias("pairs"), F.sum(F.abs(F.col("pos0") - F.col("r_position"))).alias("total"))


#: Reads with clips on either side, by the same alignments: a leading clip as they have it, a trailing one for some.
CLIPPED = """~ r as (select contig, pos0, pos0 + 60 e, mapq // 30 mapq, left_clip l, case when h % 5 = 0 then (h // 32768) % 40 else 0 end r from (select a.*, f.h from alignments a join fragments f using (id, contig) qualify row_number() over (partition by a.contig, a.id order by a.pos0, f.h) = 1)),
k as (select contig, pos0, 'L' side, count(*) support, pos0 probe from r where l >= 10 group by all union all select contig, e, 'R', count(*), e - 1 from r where r >= 10 group by all),
c as (select k.contig, k.pos0, k.side, k.support, count(*) as depth, sum((r.mapq = 0)::int)::bigint mapq0 from k join r on r.contig = k.contig and r.pos0 <= probe and probe < e where support >= 2 group by all),
s as (select *, case when mapq0 >= 0.5 * depth then 'repeat-like' when support >= 0.3 * depth then 'junction-like' else 'minority-support' end class from c),
t as (select distinct contig, pos - 1 p from structural) """


def _sites(spark, d) -> DataFrame:
    a = alignments(spark, d).join(fragments(spark, d).select("contig", "id", "h"), ["contig", "id"])
    kept = F.row_number().over(Window.partitionBy("contig", "id").orderBy("pos0", "h"))
    a = a.withColumn("k", kept).where("k = 1")
    right = F.when(F.col("h") % 5 == 0, F.floor(F.col("h") / 32768) % 40).otherwise(0)
    clip = lambda n: F.when(n > 0, F.concat(n.cast("string"), F.lit("S"))).otherwise("")
    r = a.select("contig", "pos0", F.floor(F.col("mapq") / 30).alias("mapq"), F.concat(clip(F.col("left_clip")), F.lit("60M"), clip(right)).alias("cigar"))
    return breakpoints.candidate_sites(r, 10, 2).withColumn("class", breakpoints.site_class())


@query(CLIPPED + "select contig, pos0, side, support, depth, mapq0, class from s", "alignments structural")
def candidate_sites(spark, d) -> DataFrame:
    """Clip boundaries that reads agree on, of either side, with the reads over them."""
    return _sites(spark, d)


@query(
    CLIPPED
    + """, p as (select contig, pos0, min(class) class from s group by 1, 2), n as (select p.contig, pos0, t.p, abs(pos0 - t.p) far from p join t on p.contig = t.contig and abs(pos0 - t.p) <= 40),
a as (select contig, pos0, p from n qualify row_number() over (partition by contig, pos0 order by far, p) = 1), b as (select contig, pos0, p from n qualify row_number() over (partition by contig, p order by far, pos0) = 1),
m as (select * from a intersect select * from b), x as (select s.class, (select count(*) from n where n.contig = s.contig and n.pos0 = s.pos0) > 0 close from s), y as (select p.class, m.p is not null met from p left join m using (contig, pos0)),
u as (select coalesce(class, 'ALL') class, count(*) sites, sum(close::int)::bigint near from x group by rollup (class)), v as (select coalesce(class, 'ALL') class, sum(met::int)::bigint matched from y group by rollup (class))
select class, sites, near, coalesce(matched, 0)::bigint matched from u left join v using (class)""",
    "alignments structural",
)
def candidates_vs_truth(spark, d) -> DataFrame:
    """Sites near structural variants, and matched with them one to one, by class."""
    t = structural(spark, d).select("contig", (F.col("pos") - 1).alias("pos0"))
    return breakpoints.near_truth(_sites(spark, d), t, 40)


@query(
    """~ b as (select contig, start s, stop e from bed), g as (select contig, s, e, max(e) over (partition by contig order by s, e rows between unbounded preceding and 1 preceding) m from b),
u as (select contig, s, e, sum((m is null or s > m)::int) over (partition by contig order by s, e rows unbounded preceding) k from g), r as (select contig, min(s) s, max(e) e from u group by contig, k),
t as (select distinct contig, pos - 1 p from structural), i as (select distinct t.contig, p from t join r on r.contig = t.contig and p >= s and p < e),
w as (select contig, p - 10 s, p + 11 e, max(p + 11) over (partition by contig order by p rows between unbounded preceding and 1 preceding) m from i), x as (select *, sum((m is null or s > m)::int) over (partition by contig order by s rows unbounded preceding) k from w),
y as (select contig, min(s) s, max(e) e from x group by contig, k)
select (select sum(e - s)::bigint from r) bases, sum(least(y.e, r.e) - greatest(y.s, r.s))::bigint near, round(sum(least(y.e, r.e) - greatest(y.s, r.s)) / (select sum(e - s) from r), 9) share from y join r on r.contig = y.contig and y.s < r.e and r.s < y.e""",
    "bed structural",
)
def chance_near_truth(spark, d) -> DataFrame:
    """The share of the BED's bases that lie near a structural variant."""
    t = structural(spark, d).select("contig", (F.col("pos") - 1).alias("pos0"))
    return breakpoints.chance_near(bed(spark, d), t, 10).withColumn("share", F.round("share", 9))


PANEL = "select event_type metric, round(median(value) filter (user_id % 2 = 0), 6) a_median, min(value) filter (user_id % 2 = 0) a_min, max(value) filter (user_id % 2 = 0) a_max, round(median(value) filter (user_id % 2 = 1), 6) b_median, min(value) filter (user_id % 2 = 1) b_min, max(value) filter (user_id % 2 = 1) b_max, round(median(value) filter (user_id % 2 = 0) / median(value) filter (user_id % 2 = 1), 6) ratio from events group by 1"


def _panel(spark, d) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_type").alias("metric"), F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("arm"), "value")
    return realism.panel(e, ("a", "b"))


@query(PANEL)
def panel_summary(spark, d) -> DataFrame:
    out = _panel(spark, d)
    for c in ("a_median", "b_median", "ratio"):
        out = out.withColumn(c, r6(c))
    return out


@query(
    """with b as (select event_type metric, avg(value) base, stddev_pop(value) / 10 sd, case event_type when 'click' then 'exact' when 'view' then 'ge2sd' when 'error' then 'band' else 'lepct' end gate from events where user_id % 2 = 0 group by 1),
m as (select event_type metric, avg(value) v from events where user_id % 2 = 1 group by 1)
select metric, round(v, 6) as value, round(base, 6) base, case gate when 'exact' then v = base when 'ge2sd' then v >= base - 2 * sd when 'band' then abs(v - base) <= 2 * sd else v <= base * (1 + sd / 100) end passed from m join b using (metric)"""
)
def regression_gate(spark, d) -> DataFrame:
    e = table(spark, d, "events").withColumnRenamed("event_type", "metric")
    kind = F.when(F.col("metric") == "click", "exact").when(F.col("metric") == "view", "ge2sd").when(F.col("metric") == "error", "band").otherwise("lepct")
    base = e.where("user_id % 2 = 0").groupBy("metric").agg(F.avg("value").alias("base"), (F.stddev_pop("value") / 10).alias("sd")).withColumn("gate", kind)
    out = realism.gate(e.where("user_id % 2 = 1").groupBy("metric").agg(F.avg("value").alias("value")), base)
    return out.select("metric", r6("value").alias("value"), r6("base").alias("base"), "passed")
