"""Registered queries: interval algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import intervals
from .compare import r6
from .inputs import bed, contigs, fragments, records, structural, with_inputs

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None, needs: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_inputs(needs, sql)
        return f

    return add


def _segments(spark, d) -> DataFrame:
    """Disjoint segments of 500 bases, with gaps, over the range of the BED."""
    from .inputs import table

    o = table(spark, d, "customer").where("c_custkey % 4 <> 3")
    return o.select(F.concat(F.lit("chr"), (F.col("c_custkey") % 5 + 1).cast("string")).alias("contig"), (F.floor(F.col("c_custkey") / 5) * 25).alias("start"), (F.floor(F.col("c_custkey") / 5) * 25 + 25).alias("end"), (1 + F.col("c_custkey") % 9).cast("double").alias("value"))


SEG = "~ seg as (select concat('chr', (c_custkey % 5 + 1)::varchar) contig, (c_custkey // 5) * 25 as start, (c_custkey // 5) * 25 + 25 as stop, (1 + c_custkey % 9)::double as value from customer where c_custkey % 4 <> 3) "


@query(
    """~
e as (select contig, start as x, 1 d from fragments union all select contig, stop, -1 from fragments),
s as (select contig, x, sum(d) d from e group by 1, 2 having sum(d) <> 0),
r as (select contig, x as start, lead(x) over w as stop, sum(d) over w depth from s window w as (partition by contig order by x))
select contig, start, stop, depth::bigint depth from r where depth > 0""",
    "fragments",
)
def depth_by_events(spark, d) -> DataFrame:
    return intervals.depth(fragments(spark, d).select("contig", "start", "end")).select("contig", "start", F.col("end").alias("stop"), "depth")


@query(
    SEG + """, b as (select * from orders_bed),
p as (select contig, start, stop, value, unnest(range(start, stop)) x from seg),
v as (select p.contig, x, coalesce(arg_max(b.value, b.id), any_value(p.value)) v from p left join b on p.contig = b.contig and x >= b.start and x < b.stop group by 1, 2)
select contig, count(*) bases, round(sum(v), 2) total from v group by 1""",
    "orders_bed",
)
def segment_override(spark, d) -> DataFrame:
    changes = bed(spark, d).withColumnRenamed("id", "seq").select("contig", "start", "end", "value", "seq")
    out = intervals.override(_segments(spark, d), changes)
    n = F.col("end") - F.col("start")
    return out.groupBy("contig").agg(F.sum(n).alias("bases"), F.round(F.sum(n * F.col("value")), 2).alias("total"))


@query(
    SEG + """, b as (select contig, start, stop, (9 + id % 3) / 10.0::double f from orders_bed),
p as (select contig, value, unnest(range(start, stop)) x from seg),
v as (select p.contig, x, any_value(p.value) * coalesce(product(b.f), 1) v from p left join b on p.contig = b.contig and x >= b.start and x < b.stop group by 1, 2)
select contig, count(*) bases, round(sum(v), 2) total from v group by 1""",
    "orders_bed",
)
def segment_multiply(spark, d) -> DataFrame:
    factors = bed(spark, d).select("contig", "start", "end", ((9 + F.col("id") % 3) / F.lit(10.0)).alias("value"))
    out = intervals.multiply(_segments(spark, d), factors)
    n = F.col("end") - F.col("start")
    return out.groupBy("contig").agg(F.sum(n).alias("bases"), F.round(F.sum(n * F.col("value")), 2).alias("total"))


@query(SEG + "select t.contig, count(*) n, count(s.value) inside, round(sum(coalesce(s.value, 0)), 2) total from (select contig, part_id * 3 p from records) t left join seg s on s.contig = t.contig and p >= s.start and p < s.stop group by 1", "records")
def rate_at_points(spark, d) -> DataFrame:
    points = records(spark, d).select("contig", (F.col("part_id") * 3).alias("pos0"))
    out = intervals.value_at(points, _segments(spark, d))
    return out.groupBy("contig").agg(F.count("*").alias("n"), F.sum((F.col("value") > 0).cast("int")).alias("inside"), F.round(F.sum("value"), 2).alias("total"))


@query(
    SEG + """, x as (select distinct contig, part_id * 3 p from records),
k as (select contig, start, unnest(range(start, stop)) p from seg), l as (select * from k anti join x using (contig, p)),
g as (select contig, start, p, p - row_number() over (partition by contig, start order by p) g from l)
select contig, min(p) as start, max(p) + 1 as stop from g group by contig, start, g""",
    "records",
)
def segment_exclude(spark, d) -> DataFrame:
    points = records(spark, d).select("contig", (F.col("part_id") * 3).alias("pos0"))
    return intervals.exclude_points(_segments(spark, d).select("contig", "start", "end"), points).select("contig", "start", F.col("end").alias("stop"))


@query("~ c as (select contig, length(seq) len, greatest(ceil(length(seq) / 1000), 1)::bigint n from contigs where length(seq) > 0) select contig, k chunk, floor(k * len / n)::bigint as start, floor((k + 1) * len / n)::bigint as stop from (select *, unnest(range(n)) k from c)", "contigs")
def contig_chunks(spark, d) -> DataFrame:
    c = contigs(spark, d).select("contig", F.length("seq").cast("long").alias("length"))
    return intervals.tiles(c, 1000).select("contig", "chunk", "start", F.col("end").alias("stop"))


@query(
    """~
m as (select id, length, case type when 'DEL' then case when gt = '1/1' then 0 else 0.5 end when 'DUP' then case when gt = '1/1' then 2 else 1.5 end when 'CNV' then cn / 2.0 end m from structural)
select id, coalesce(round(m, 6), -1) multiplier, case when m is null then 0 else round(m * (length % 77))::bigint end coverage from m""",
    "structural",
)
def sv_coverage_multiplier(spark, d) -> DataFrame:
    s = structural(spark, d)
    m = sv_multiplier(F.col("type"), F.col("gt") == "1/1", F.col("cn"), 2)
    return s.select("id", F.coalesce(r6(m), F.lit(-1.0)).alias("multiplier"), intervals.scaled_coverage(m * (F.col("length") % 77)).alias("coverage"))


def sv_multiplier(kind, homozygous, copies, ploidy: int):
    """The coverage factor of a structural variant; null where it has none."""
    return F.when(kind == "DEL", F.when(homozygous, 0.0).otherwise((ploidy - 1) / ploidy)).when(kind == "DUP", F.when(homozygous, 2.0).otherwise((ploidy + 1) / ploidy)).when(kind == "CNV", copies / ploidy)


@query("~ f as (select contig, start, stop, h from fragments), s as (select contig, pos - 1 x, (1 + id % 4) / 4.0 f from structural) select f.h, count(s.x) junctions, round(coalesce(max(s.f), 0), 6) broken from f left join s on s.contig = f.contig and s.x >= f.start and s.x < f.stop group by f.h", "fragments structural")
def fragment_junctions(spark, d) -> DataFrame:
    f = fragments(spark, d).select("contig", "start", "end", "h")
    s = structural(spark, d).select("contig", (F.col("pos") - 1).alias("start"), F.col("pos").alias("end"), ((1 + F.col("id") % 4) / 4.0).alias("f"))
    hit = intervals.overlaps(f, s).groupBy("h").agg(F.count("*").alias("junctions"), F.max("r_f").alias("broken"))
    return f.select("h").distinct().join(hit, "h", "left").select("h", F.coalesce("junctions", F.lit(0)).alias("junctions"), r6(F.coalesce("broken", F.lit(0.0))).alias("broken"))


@query("~ v as (select contig, pos - 1 p from records) select f.contig, count(*) pairs, count(distinct f.id) fragments from fragments f join v on f.contig = v.contig and v.p >= f.start and v.p < f.stop group by 1", "fragments records")
def fragment_variants(spark, d) -> DataFrame:
    f = fragments(spark, d).select("contig", "start", "end", "id")
    v = records(spark, d).select("contig", (F.col("pos") - 1).alias("start"), F.col("pos").alias("end"))
    return intervals.overlaps(f, v).groupBy("contig").agg(F.count("*").alias("pairs"), F.countDistinct("id").alias("fragments"))
