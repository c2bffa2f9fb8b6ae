"""Registered queries: generators and validation."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keyed import uniform
from ..operators import equivalence, fit, generate, kernel, mismatches, validate
from ..staging import staged
from .compare import r6
from .inputs import bases_of, contigs, edited, fragments, located, structural, table, with_inputs
from .segments import SEG, _segments

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None, needs: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_inputs(needs, sql) if needs else re.sub("^~", "with", sql)
        return f

    return add


def U(stream: str, key: str, draw: str = "0") -> str:
    """The keyed uniform as SQL, for seed 11."""
    return f"(cast(concat('0x', substr(md5('11|{stream}|' || {key} || '|' || {draw}), 1, 12)) as bigint) / 281474976710656.0)"


@query(
    SEG + f""", cdf as (select *, sum((stop - start) * (value / 10)) over (partition by contig order by start) hi, (stop - start) * (value / 10) m, value / 10 v from seg),
t as (select contig, max(hi) total from cdf group by 1), k as (select contig, total, unnest(range(1, floor(total)::bigint + 1)) k from t where total >= 1),
x as (select contig, k, {U('place', "contig || ':' || k::varchar")} * total x from k)
select x.contig, x.k, least(start + floor((x - (hi - m)) / v)::bigint, stop - 1) pos0 from x join cdf on x.contig = cdf.contig and x >= hi - m and x < hi"""
)
def place_variants(spark, d) -> DataFrame:
    s = _segments(spark, d).withColumn("value", F.col("value") / 10)
    return generate.place_variants(s, 11)


@query(
    f"""~ c as (select contig, length(seq)::bigint length from contigs where length(seq) > 0), k as (select contig, length, unnest(range(1, ceil(length * 2.0 / 200)::bigint + 1)) k from c),
z as (select contig, length, k, case when u <= 0.25 then 150 when u <= 0.75 then 300 else 600 end size from (select *, {U('size', "contig || ':' || k::varchar")} u from k)),
s as (select contig, k, floor({U('start', "contig || ':' || k::varchar")} * (length - size + 1))::bigint as start, size from z where size <= length)
select contig, k, start, start + size as stop from s""",
    "contigs",
)
def place_fragments(spark, d) -> DataFrame:
    c = contigs(spark, d).select("contig", F.length("seq").cast("long").alias("length"))
    out = generate.place_fragments(c, [(150, 1), (300, 2), (600, 1)], 2.0, 100, True, 11)
    return out.select("contig", "k", "start", F.col("end").alias("stop"))


@query(
    f"""~ w as (select contig, i::bigint as start, (1 + (length(regexp_replace(substr(seq, i + 1, 100), '[^GC]', '', 'g')) % 7)) / 4.0 weight from (select contig, seq, unnest(range(0, length(seq) - 99, 100)) i from contigs where length(seq) >= 100)),
m as (select contig, avg(weight) mean from w group by 1), c as (select *, sum(weight) over (partition by contig order by start) hi from w), t as (select contig, max(hi) total from c group by 1),
k as (select contig, length, unnest(range(1, ceil(length * 1.0 / 200 * least(1 / mean, 100))::bigint + 1)) k from (select contig, length(seq)::bigint length from contigs) join m using (contig)),
x as (select contig, length, k, {U('gc', "contig || ':' || k::varchar")} * total x from k join t using (contig)),
s as (select x.contig, k, length, start + floor((x - (hi - weight)) / weight * 100)::bigint as start from x join c on x.contig = c.contig and x >= hi - weight and x < hi)
select contig, k, start, start + 100 as stop from s where start + 100 <= length""",
    "contigs",
)
def place_fragments_gc(spark, d) -> DataFrame:
    c = contigs(spark, d)
    w = fit.sequence_tiles(c, 1, 100).where("length(seq) = 100")
    gc = F.length("seq") - F.length(F.translate("seq", "GC", ""))
    w = w.select("contig", F.col("tile_start").cast("long").alias("start"), ((1 + gc % 7) / 4.0).alias("weight"))
    out = generate.place_fragments_by_gc(w, c.select("contig", F.length("seq").cast("long").alias("length")), 100, 1.0, 100, True, 11)
    return out.select("contig", "k", "start", F.col("end").alias("stop"))


@query(
    "~ f as (select id, substr(seq, pos0::int + 1, (30 + h % 150)::int) s from located) select id, rpad(s || 'AGATCGGAAGAGC', 100, 'A') bases, least(length(s), 100)::varchar || 'M' || case when length(s) < 100 then (100 - length(s))::varchar || 'S' else '' end cigar from f",
    "located",
)
def adapter_read_through(spark, d) -> DataFrame:
    f = located(spark, d).select("id", "contig", "pos0", (30 + F.col("h") % 150).alias("n"))
    f = kernel.reference_bases(f, contigs(spark, d), "pos0", "n", 180)
    bases, cigar = generate.read_through(F.col("bases"), "AGATCGGAAGAGC", 100)
    return f.select("id", bases.alias("bases"), cigar.alias("cigar"))


@query(
    "~ s as (select id, contig, pos, lead(contig) over (order by id) c2, lead(pos) over (order by id) p2 from structural), a as (select * from s where c2 is not null and id % 2 = 0) select contig, pos, 'A[' || c2 || ':' || p2::varchar || '[' alt, id pair from a union all select c2, p2, ']' || contig || ':' || pos::varchar || ']T', id from a",
    "structural",
)
def translocation_mates(spark, d) -> DataFrame:
    s = structural(spark, d)
    t = s.select(F.col("id").alias("pair"), F.col("contig").alias("contig_a"), F.col("pos").alias("pos_a")).where("pair % 2 = 0")
    n = s.select((F.col("id") - 1).alias("pair"), F.col("contig").alias("contig_b"), F.col("pos").alias("pos_b"))
    t = t.join(n, "pair").select("*", F.lit("A").alias("base_a"), F.lit("T").alias("base_b"))
    return generate.reciprocal_breakends(t).select("contig", "pos", "alt", "pair")


@query(f"select contig, count(*) n from (select *, (h % 5) / 5.0 broken from fragments) where {U('suppress', 'id')} >= broken group by 1", "fragments")
def junction_suppress(spark, d) -> DataFrame:
    f = fragments(spark, d).withColumn("broken", (F.col("h") % 5) / 5.0)
    return generate.suppressed(f, 11).groupBy("contig").agg(F.count("*").alias("n"))


@query(
    f"""~ p as (select l_orderkey fragment, l_partkey variant, l_quantity > 25 homozygous, case when l_linenumber = 1 then l_discount * 5 end af from lineitem),
a as (select variant, case when af is not null then u < af when homozygous then true else u < 0.5 end alt from (select *, {U('allele', "fragment::varchar || '/' || variant::varchar")} u from p)),
g as (select variant, sum((not alt)::int)::bigint ref_depth, sum(alt::int)::bigint alt_depth from a group by 1) select *, printf('%.4f', round(alt_depth / (ref_depth + alt_depth), 4)) af from g"""
)
def allele_draw_ad(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    p = li.select(F.col("l_orderkey").alias("fragment"), F.col("l_partkey").alias("variant"), (F.col("l_quantity") > 25).alias("homozygous"), F.when(F.col("l_linenumber") == 1, F.col("l_discount") * 5).alias("af"))
    return generate.allele_depths(generate.allele_draws(p, 11))


@query(
    f"select id, ccf, round(dosage * ccf, 6) af, round(0.8::double * dosage * ccf, 6) vaf from (select id, dosage, (case when u <= 0.5 then 1.0 when u <= 0.8 then 0.6 else 0.25 end)::double ccf from (select id, (case when gt = '1/1' then 1.0 else 0.5 end)::double dosage, {U('subclone', 'id::varchar')} u from structural))",
    "structural",
)
def subclone_ccf(spark, d) -> DataFrame:
    s = structural(spark, d).select("id", F.when(F.col("gt") == "1/1", 1.0).otherwise(0.5).alias("dosage"))
    out = generate.subclone_draw(s, F.col("id"), [(1.0, 0.5), (0.6, 0.3), (0.25, 0.2)], 0.8, 11)
    return out.select("id", "ccf", r6("af").alias("af"), r6("vaf").alias("vaf"))


@query(
    "~ f as (select contig, pos - 1 pos0, ref, alt, row_number() over (partition by contig, pos order by h, order_id, line_id) k from edited), v as (select * from f where k = 1) select contig, pos0, pos0 + coalesce(sum(length(alt) - length(ref)) over (partition by contig order by pos0 rows between unbounded preceding and 1 preceding), 0)::bigint hap_pos from v",
    "edited",
)
def haplotype_shift(spark, d) -> DataFrame:
    first = F.row_number().over(Window.partitionBy("contig", "pos").orderBy("h", "order_id", "line_id"))
    v = edited(spark, d).withColumn("k", first).where("k = 1").select("contig", (F.col("pos") - 1).alias("pos0"), "ref", "alt")
    return generate.haplotype_positions(v).select("contig", "pos0", "hap_pos")


@query(f"~ s as (select event_id, {U('keep', 'event_id::varchar')} u from events) select count(*) n, sum(event_id)::bigint total from s where u < 0.3")
def uniform_sample(spark, d) -> DataFrame:
    e = table(spark, d, "events").where(uniform(11, "keep", F.col("event_id")) < 0.3)
    return e.agg(F.count("*").alias("n"), F.sum("event_id").alias("total"))


@query()
def simulated_reads(spark, d) -> DataFrame:
    """Reads of the placed fragments: bases, qualities and errors."""
    c = contigs(spark, d)
    f = generate.place_fragments(c.select("contig", F.length("seq").cast("long").alias("length")), [(150, 1), (300, 2)], 0.5, 100, True, 11)
    r = f.join(c, "contig").select(F.concat_ws("_", "contig", "start", "end", "k").alias("read_id"), F.substr("seq", (F.col("start") + 1).cast("int"), F.lit(100)).alias("template"))
    r = generate.quality_strings(r, F.col("read_id"), [(37, 3), (25, 1)], 0.8, 4, 2, 41, 100, 11)
    return r.select("read_id", generate.read_bases(F.col("template"), F.col("scores"), F.col("read_id"), 11).alias("seq"), "scores")


@query(
    """~ s as (select contig, id, start, stop, case id % 3 when 0 then 'DEL' when 1 then 'DUP' else 'INV' end as type, seq from (select c.contig, length(c.seq) n, c.seq, i, i id, i * 40 + 60 as start, i * 40 + 60 + 50 + i % 30 as stop from (select *, unnest(range(0, (length(seq) - 201) // 40 + 1)) i from contigs where length(seq) > 200) c)),
p as (select contig, id, type, substr(seq, start - 30 + 1, 30) l, substr(seq, stop + 1, 30) r, substr(seq, start + 1, 30) a, substr(seq, stop - 30 + 1, 30) b from s where stop + 30 <= length(seq))
select contig || ':' || id::varchar id, type, case type when 'DEL' then l || r when 'DUP' then b || a else l || reverse(translate(b, 'ACGT', 'TGCA')) end seq from p""",
    "contigs",
)
def chimeric_junctions(spark, d) -> DataFrame:
    c = contigs(spark, d)
    i = F.explode(F.sequence(F.lit(0), F.floor((F.length("seq") - 201) / 40).cast("int"))).alias("i")
    s = c.where("length(seq) > 200").select("contig", F.length("seq").alias("n"), i)
    s = s.select(F.concat_ws(":", "contig", F.col("i").cast("string")).alias("id"), "contig", (F.col("i") * 40 + 60).alias("start"), (F.col("i") * 40 + 110 + F.col("i") % 30).alias("end"), F.when(F.col("i") % 3 == 0, "DEL").when(F.col("i") % 3 == 1, "DUP").otherwise("INV").alias("type"))
    return generate.junction_reads(s, c, 30)


@query(
    """~ f as (select contig, i - 10 as start, substr(seq, i - 10 + 1, 40) s, i from (select contig, seq, unnest(range(20, length(seq) - 30, 60)) i from contigs) where i % 3 <> 1)
select f.contig || ':' || f.i::varchar id, substr(s, 1, 10) || case when f.i % 3 = 0 then case when f.i % 2 = 0 then 'A' else 'G' end || substr(s, 12) else substr(s, 11, 1) || 'TTT' || substr(s, 13) end seq from f""",
    "contigs",
)
def haplotype_fragments(spark, d) -> DataFrame:
    """Fragments of 40 bases with the variant they carry put in: a substitution, or two bases that become four."""
    c = contigs(spark, d)
    at = c.where("length(seq) > 50").select("contig", F.explode(F.sequence(F.lit(20), F.length("seq") - 31, F.lit(60))).alias("i"), "seq")
    at = at.select(F.concat_ws(":", "contig", F.col("i").cast("string")).alias("id"), "contig", "i", (F.col("i") - 10).cast("long").alias("start"), (F.col("i") + 30).cast("long").alias("end"), F.substr("seq", F.col("i") - 9, F.lit(40)).alias("s"))
    ref = lambda n: F.substring("s", 11, n)
    snp = F.when(F.col("i") % 2 == 0, "A").otherwise("G")
    v = at.where("i % 3 != 1").select("contig", F.col("i").cast("long").alias("pos0"), F.when(F.col("i") % 3 == 0, ref(1)).otherwise(ref(2)).alias("ref"), F.when(F.col("i") % 3 == 0, snp).otherwise(F.concat(ref(1), F.lit("TTT"))).alias("alt"))
    f = generate.carried(at.where("i % 3 != 1").select("id", "contig", "start", "end", "s"), v)
    return f.select("id", generate.haplotype_sequence(F.col("s"), F.col("start"), F.col("carried")).alias("seq"))


@query()
def structural_placement(spark, d) -> DataFrame:
    c = table(spark, d, "part").select(F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("contig"), (F.col("p_retailprice") * 100).cast("long").alias("length"))
    return generate.place_structural(c, 1e-4, {"DEL": (0.5, 6.0, 1.0), "DUP": (0.3, 6.5, 1.0), "INV": (0.2, 7.0, 0.5)}, 11)


#: One variant for each eight bases of a document's contig, from the located records: a changed base, two changed bases, or a lost one.
PLANTED = """~ o as (select contig, seq, pos0 // 8 * 8 + 1 p, min(h) h from located where length(seq) > 8 group by all),
v as (select contig, p::bigint pos0, h, seq, case when h % 3 = 0 and p + 2 < length(seq) and substr(seq, p + 2, 1) <> 'N' then 'lost' when h % 3 = 1 and p + 1 < length(seq) then 'two' else 'one' end kind from o where p < length(seq)),
w as (select *, substr(seq, pos0 + 1, 1) a, substr(seq, pos0 + 2, 1) b, translate(substr(seq, pos0 + 1, 2), 'ACGTN', 'CATGA') c from v),
t as (select contig, h, kind, pos0, a, b, c, seq, case kind when 'one' then a else a || b end ref, case kind when 'one' then c[1:1] when 'two' then c else a end alt from w)"""


def _planted(spark, d) -> DataFrame:
    c = contigs(spark, d)
    o = located(spark, d).where("length > 8").groupBy("contig", (F.floor(F.col("pos0") / 8) * 8 + 1).alias("pos0")).agg(F.min("h").alias("h"))
    o = kernel.reference_bases(o.withColumn("n", F.lit(3)), c, "pos0", "n", 3).where("bases != ''")
    n, h = F.length("bases"), F.col("h")
    base = lambda i, k=1: F.substring("bases", i, k)
    kind = F.when((h % 3 == 0) & (n > 2) & (base(2) != "N"), "lost").when((h % 3 == 1) & (n > 1), "two").otherwise("one")
    o = o.withColumn("kind", kind).withColumn("a", base(1)).withColumn("b", base(2)).withColumn("c", F.translate(base(1, 2), "ACGTN", "CATGA"))
    ref = F.when(F.col("kind") == "one", F.col("a")).otherwise(F.concat("a", "b"))
    return o.withColumn("ref", ref).withColumn("alt", F.when(F.col("kind") == "one", F.substring("c", 1, 1)).when(F.col("kind") == "two", F.col("c")).otherwise(F.col("a")))


@query(
    PLANTED
    + """, spelled as (
  select contig, h, unnest(case when kind = 'two' then [{'pos0': pos0, 'ref': a, 'alt': c[1:1]}, {'pos0': pos0 + 1, 'ref': b, 'alt': c[2:2]}] when kind = 'lost' then [{'pos0': pos0 + 1, 'ref': b || substr(seq, pos0 + 3, 1), 'alt': case when h % 5 = 0 then b else substr(seq, pos0 + 3, 1) end}]
    else [{'pos0': pos0, 'ref': ref, 'alt': case when h % 4 = 0 then translate(alt, 'ACGT', 'TGCA') else alt end}] end) x from t where h % 11 <> 0),
c as (select contig, x.pos0::bigint pos0, x.ref ref, x.alt alt from spelled where x.ref <> x.alt),
fn as (select contig, pos0, ref, alt from t where ref <> alt except select * from c), fp as (select * from c except select contig, pos0, ref, alt from t),
near as (select x.contig, x.pos0, x.ref, x.alt, s.seq from fp x join contigs s using (contig)),
calls as (select contig, seq, list({'pos0': pos0, 'ref': ref, 'alt': alt} order by pos0, ref, alt) fps from near group by all),
g as (select contig, seq, fps, list({'pos0': f.pos0, 'ref': f.ref, 'alt': f.alt} order by f.pos0, f.ref, f.alt) fns from calls join fn f using (contig) group by all),
walk as (
  select contig, seq, fps, fns, 1 k, [x.pos0 for x in fps if false] gone_fp, [x.pos0 for x in fns if false] gone_fn from g
  union all
  select contig, seq, fps, fns, k + 1, case when same then list_concat(gone_fp, [x.pos0 for x in a]) else gone_fp end, case when same then list_concat(gone_fn, [x.pos0 for x in b]) else gone_fn end
  from (
    select *, not list_contains(gone_fp, here) and len(b) > 0 and (
      list_reduce(list_prepend({'s': substr(seq, lo + 1, here + 51 - lo), 'd': 0::bigint, 'p': 0::bigint, 'r': '', 't': ''}, [{'s': '', 'd': 0::bigint, 'p': x.pos0 - lo, 'r': x.ref, 't': x.alt} for x in a]),
        lambda u, x: {'s': case when x.p + u.d + length(x.r) <= length(u.s) then substr(u.s, 1, x.p + u.d) || x.t || substr(u.s, x.p + u.d + length(x.r) + 1) else u.s end, 'd': case when x.p + u.d + length(x.r) <= length(u.s) then u.d + length(x.t) - length(x.r) else u.d end, 'p': 0::bigint, 'r': '', 't': ''})).s
      = (list_reduce(list_prepend({'s': substr(seq, lo + 1, here + 51 - lo), 'd': 0::bigint, 'p': 0::bigint, 'r': '', 't': ''}, [{'s': '', 'd': 0::bigint, 'p': x.pos0 - lo, 'r': x.ref, 't': x.alt} for x in b]),
        lambda u, x: {'s': case when x.p + u.d + length(x.r) <= length(u.s) then substr(u.s, 1, x.p + u.d) || x.t || substr(u.s, x.p + u.d + length(x.r) + 1) else u.s end, 'd': case when x.p + u.d + length(x.r) <= length(u.s) then u.d + length(x.t) - length(x.r) else u.d end, 'p': 0::bigint, 'r': '', 't': ''})).s same
    from (select *, fps[k].pos0 here, greatest(fps[k].pos0 - 50, 0) lo, [x for x in fps if abs(x.pos0 - fps[k].pos0) <= 50 and not list_contains(gone_fp, x.pos0)] a, [x for x in fns if abs(x.pos0 - fps[k].pos0) <= 50 and not list_contains(gone_fn, x.pos0)] b from walk where k <= len(fps)))),
done as (select * from walk where k = len(fps) + 1)
select contig, 'fp' kind, x.pos0, x.ref ref, x.alt alt from (select contig, gone_fp, unnest(fps) x from done) where list_contains(gone_fp, x.pos0)
union all select contig, 'fn', x.pos0, x.ref, x.alt from (select contig, gone_fn, unnest(fns) x from done) where list_contains(gone_fn, x.pos0)""",
    "located",
)
def equivalence_sweep(spark, d) -> DataFrame:
    """Planted variants against calls that lose some, change some, name two changed bases one by one, and name a lost base from another place; misses
    and false calls of the comparison go through the sweep."""
    t = staged(_planted(spark, d), "planted")
    h, pos = F.col("h"), F.col("pos0").cast("long")
    one = lambda at, ref, alt: F.struct(at.alias("pos0"), ref.alias("ref"), alt.alias("alt"))
    after = F.substring("bases", 3, 1)
    two = F.array(one(pos, F.col("a"), F.substring("c", 1, 1)), one(pos + 1, F.col("b"), F.substring("c", 2, 1)))
    lost = F.array(one(pos + 1, F.concat("b", after), F.when(h % 5 == 0, F.col("b")).otherwise(after)))
    same = F.array(one(pos, F.col("ref"), F.when(h % 4 == 0, F.translate("alt", "ACGT", "TGCA")).otherwise(F.col("alt"))))
    c = t.where("h % 11 != 0").select("contig", F.inline(F.when(F.col("kind") == "two", two).when(F.col("kind") == "lost", lost).otherwise(same))).where("ref != alt").distinct()
    t = t.where("ref != alt").select("contig", pos.alias("pos0"), "ref", "alt").distinct()
    key = ["contig", "pos0", "ref", "alt"]
    return equivalence.equivalent(t.join(c, key, "left_anti"), c.join(t, key, "left_anti"), contigs(spark, d))


ORACLES["equivalence_sweep"] = ORACLES["equivalence_sweep"].replace("with", "with recursive", 1)


def _md(stream: str, n: str) -> str:
    return f"floor({U(stream, "contig || ':' || tile_start::varchar")} * ({n}))::int"


@query(
    f"""~ t as (select contig, i::int tile_start, substr(seq, i + 1, 100) s from (select contig, seq, unnest(range(0, length(seq), 100)) i from contigs)),
a as (select *, least({_md('md_clip', '21')}, length(s) - 1) clip from t), b as (select *, greatest(least({_md('md_insert', '6')}, length(s) - clip - 2), 0) ins from a), c as (select *, length(s) - clip - ins al from b),
e as (select *, case when ins > 0 then 1 + {_md('md_left', 'al - 1')} else al end l, {_md('md_mismatch', 'al')} x from c),
g as (select substr(s, clip + 1, l) || substr(s, clip + l + ins + 1, al - l) bases, x from e), m as (select bases, bases[x + 1] rd from g),
n as (select b.b ref, b.b rd, length(bases) - length(replace(bases, b.b, '')) - (rd = b.b)::int n from m, unnest(['A', 'C', 'G', 'T', 'N']) b(b) union all select translate(rd, 'ACGTN', 'CGTAA'), rd, 1 from m)
select ref, rd "read", sum(n)::bigint n from n group by 1, 2 having sum(n) > 0""",
    "contigs",
)
def md_mismatch_matrix(spark, d) -> DataFrame:
    """Mismatches by MD tag of reads that tile the documents' bases."""
    return mismatches.md_bases(md_reads(contigs(spark, d)))


@query(
    f"""~ t as (select contig, i::int tile_start, substr(seq, i + 1, 100) s from (select contig, seq, unnest(range(0, length(seq), 100)) i from contigs)),
a as (select *, least({_md('md_clip', '21')}, length(s) - 1) clip from t), b as (select *, greatest(least({_md('md_insert', '6')}, length(s) - clip - 2), 0) ins from a), c as (select *, length(s) - clip - ins al from b),
e as (select *, case when ins > 0 then 1 + {_md('md_left', 'al - 1')} else al end l, {_md('md_mismatch', 'al')} x from c),
g as (select contig, tile_start + x pos0, substr(substr(s, clip + 1, l) || substr(s, clip + l + ins + 1, al - l), x + 1, 1) rd, x from e),
m as (select g.*, case when x % 7 = 0 then rd else translate(rd, 'ACGTN', 'CGTAA') end rf, k.pos0 is not null known from g left join (select distinct contig, pos0 from located where h % 3 = 0) k using (contig, pos0))
select rf ref, rd "read", (count(*) filter (rf <> rd and not known))::bigint n, (count(*) filter (rf <> rd and known))::bigint masked, (count(*) filter (rf = rd))::bigint stale from m where rd <> 'N' group by 1, 2""",
    "contigs located",
)
def md_report(spark, d) -> DataFrame:
    """Mismatches of the tiling reads with the sites of located records masked; the tags of one read in seven are older than the read."""
    r = md_reads(contigs(spark, d), stale=7).withColumn("pos0", F.col("tile_start").cast("long"))
    return mismatches.md_report(r, located(spark, d).where("h % 3 = 0").select("contig", "pos0"))


def md_reads(c: DataFrame, stale: int = 0) -> DataFrame:
    """(contig, tile_start, seq, cigar, md): consecutive reads of 100 bases, the last of a contig shorter. A read's key sets its soft clip and insertion, where
    it is long enough for them, and the one aligned base whose reference differs; the reference is the next base by alphabet there, or, at
    places divisible by `stale`, the read's own."""
    at = lambda stream, n: F.floor(uniform(11, stream, F.concat_ws(":", "contig", F.col("tile_start").cast("string"))) * n).cast("int")
    r = fit.sequence_tiles(c, 1, 100).where("seq != ''").withColumn("n", F.length("seq"))
    r = r.withColumn("clip", F.least(at("md_clip", 21), F.col("n") - 1))
    r = r.withColumn("ins", F.greatest(F.least(at("md_insert", 6), F.col("n") - F.col("clip") - 2), F.lit(0))).withColumn("aligned", F.col("n") - F.col("clip") - F.col("ins"))
    r = r.withColumn("left", F.when(F.col("ins") > 0, 1 + at("md_left", F.col("aligned") - 1)).otherwise(F.col("aligned"))).withColumn("x", at("md_mismatch", F.col("aligned")))
    base = F.substr("seq", F.col("clip") + F.col("x") + 1 + F.when(F.col("x") >= F.col("left"), F.col("ins")).otherwise(0), F.lit(1))
    part = lambda n, op: F.when(n > 0, F.concat(n.cast("string"), F.lit(op))).otherwise("")
    cigar = F.concat(part(F.col("clip"), "S"), part(F.col("left"), "M"), part(F.col("ins"), "I"), part(F.col("aligned") - F.col("left"), "M"))
    other = F.translate(base, "ACGTN", "CGTAA")
    md = F.concat(F.col("x").cast("string"), F.when(F.col("x") % stale == 0, base).otherwise(other) if stale else other, (F.col("aligned") - F.col("x") - 1).cast("string"))
    return r.select("contig", "tile_start", "seq", cigar.alias("cigar"), md.alias("md"))


FASTQ = """~ r as (select doc_id, case when doc_id % 11 = 0 then 'name' else '@name' end || doc_id::varchar || case when doc_id % 17 = 0 then chr(13) else '' end name, case when doc_id % 23 = 0 then '' when doc_id % 5 = 0 then replace(text, chr(10), ' ') else seq end seq, case when doc_id % 13 = 0 then '-' else '+' end plus, case when doc_id % 19 = 0 then 3 else 4 end n_lines
  from documents join contigs on contig = concat('doc', doc_id::varchar) where text is not null),
w as (select *, length(seq) - (doc_id % 3 = 0)::int q from r),
f as (select doc_id, unnest(list_filter([case when n_lines < 4 then 'truncated_record' end, case when name not like '@%' then 'name_without_at' end, case when n_lines = 4 and plus not like '+%' then 'plus_line' end,
 case when n_lines = 4 and length(seq) <> greatest(q, 0) then 'length_mismatch' end, case when not regexp_full_match(seq, '[ACGTUNRYSWKMBDHVacgtunryswkmbdhv]*') then 'bad_base' end, case when seq = '' then 'empty_sequence' end, case when name like '%' || chr(13) then 'carriage_return' end], lambda x: x is not null)) rule from w)
select rule, count(*) n from f group by 1"""


@query(FASTQ, "contigs")
def fastq_findings(spark, d) -> DataFrame:
    """A record for each document: its bases, or, for some, its text as it is."""
    i = F.col("doc_id")
    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("raw"), bases_of(F.col("text")).alias("bases"))
    name = F.concat(F.when(i % 11 == 0, "name").otherwise("@name"), i.cast("string"), F.when(i % 17 == 0, "\r").otherwise(""))
    t = t.withColumn("seq", F.when(i % 23 == 0, "").when(i % 5 == 0, F.col("raw")).otherwise(F.col("bases")))
    quality = F.repeat(F.lit("I"), F.greatest(F.length("seq") - (i % 3 == 0).cast("int"), F.lit(0)))
    four = F.array(name, "seq", F.when(i % 13 == 0, "-").otherwise("+"), quality)
    lines = t.select(i.alias("file"), F.posexplode(F.slice(four, F.lit(1), F.when(i % 19 == 0, 3).otherwise(4))).alias("line_no", "text"))
    out = validate.findings(validate.fastq_records(lines), validate.fastq_rules(), ["file", "record"])
    return out.groupBy("rule").agg(F.count("*").alias("n"))


@query(
    """~ r as (select l_orderkey as file, l_linenumber line_no, case when l_suppkey % 9 = 0 then 'chrZ' else 'chr1' end contig, case when l_partkey % 31 = 0 then null else l_partkey end pos, case when l_partkey % 7 = 0 then 'AZ' else 'ACG' end ref,
  case when l_suppkey % 4 = 0 then 'DP=x' when l_suppkey % 4 = 1 then 'DP=3;ZZ=1' when l_suppkey % 4 = 2 then '.' else 'DP=7;DB' end info, case when l_suppkey % 13 = 0 then 6 else 8 end n from lineitem),
s as (select *, lag(contig) over (partition by file order by line_no, contig, pos, ref, info, n) lc, lag(pos) over (partition by file order by line_no, contig, pos, ref, info, n) lp from (select file, line_no, contig, pos, ref, info, n from r qualify row_number() over (partition by file, line_no order by contig, pos nulls first, ref, info, n) = 1)),
f as (select unnest(list_filter([case when n < 8 then 'too_few_columns' end, case when pos is null or pos < 0 then 'bad_position' end, case when ref = 'AZ' then 'bad_reference' end, case when lc = contig and lp > pos then 'unsorted' end,
  case when n = 8 and info = 'DP=3;ZZ=1' then 'info_not_declared' end, case when n = 8 and info = 'DP=x' then 'info_type' end, case when contig = 'chrZ' then 'contig_not_declared' end], lambda x: x is not null)) rule from s)
select rule, count(*) n from f group by 1"""
)
def vcf_findings(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    s, p = F.col("l_suppkey"), F.col("l_partkey")
    r = li.select(
        F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line_no"),
        F.when(s % 9 == 0, "chrZ").otherwise("chr1").alias("contig"), F.when(p % 31 != 0, p).alias("pos"), F.when(p % 7 == 0, "AZ").otherwise("ACG").alias("ref"),
        F.when(s % 4 == 0, "DP=x").when(s % 4 == 1, "DP=3;ZZ=1").when(s % 4 == 2, ".").otherwise("DP=7;DB").alias("info"), F.when(s % 13 == 0, 6).otherwise(8).alias("n"),
    )
    first = F.row_number().over(Window.partitionBy("file", "line_no").orderBy("contig", F.col("pos").asc_nulls_first(), "ref", "info", "n"))
    r = r.withColumn("k", first).where("k = 1")
    eight = F.array("contig", F.coalesce(F.col("pos").cast("string"), F.lit("x")), F.lit("."), "ref", F.lit("T"), F.lit("50"), F.lit("PASS"), "info")
    lines = r.select("file", "line_no", F.array_join(F.slice(eight, F.lit(1), F.col("n")), "\t").alias("text"))
    out = validate.findings(validate.vcf_columns(lines), validate.vcf_rules(["chr1", "chr2"], ["DP", "DB"], ["DP"]), ["file", "line_no"])
    return out.groupBy("rule").agg(F.count("*").alias("n"))
