"""Genomic inputs derived from the driver's tables, in Spark and in portable SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keyed import key_hash
from ..staging import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def div(a: Column, n: int) -> Column:
    return F.floor(a / n)


def base_at(index: Column) -> Column:
    return F.substring(F.lit("ACGT"), (index + 1).cast("int"), F.lit(1))


def letters_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z]+", "")


def bases_of(text: Column) -> Column:
    """The letters of a text, read as bases (Z as N)."""
    # A cyclic reading of the alphabet as bases.
    letters, bases = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "AACCGGTTAACCGGTTAACCGGTTAN"
    return F.translate(F.upper(letters_of(text)), letters, bases)


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(contig, seq): a contig for each document."""
    seq = bases_of(F.col("text"))
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("contig"), seq.alias("seq"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(contig, pos, ref, alt, h, ...): a SNP record for each line item; pos is 1-based."""
    li = table(spark, sf_dir, "lineitem")
    h = key_hash(F.concat_ws("|", F.lit("v"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    li = li.withColumn("h", h)
    return li.select(
        F.concat(F.lit("chr"), (F.col("l_suppkey") % 5 + 1).cast("string")).alias("contig"),
        (F.col("l_partkey") * 37 + F.col("l_linenumber") * 11).alias("pos"),
        base_at(F.col("h") % 4).alias("ref"),
        base_at((F.col("h") % 4 + 1 + div(F.col("h"), 4) % 3) % 4).alias("alt"),
        "h",
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_id"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.col("l_partkey").alias("part_id"),
    )


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).where("h % 10 < 8")


def called(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).where("h % 10 >= 1")


def bed(spark: SparkSession, sf_dir: str, keep: str = "true") -> DataFrame:
    """(contig, start, end, id, value): 0-based half-open intervals from orders."""
    o = table(spark, sf_dir, "orders").where(keep)
    start = F.col("o_custkey") * 5
    return o.select(F.concat(F.lit("chr"), (F.col("o_custkey") % 5 + 1).cast("string")).alias("contig"), start.alias("start"), (start + 20 + F.col("o_orderkey") % 60).alias("end"), F.col("o_orderkey").alias("id"), (F.col("o_totalprice")).alias("value"))


def edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """records with REF or ALT made longer for some: SNPs, insertions, deletions and complex ones."""
    r = records(spark, sf_dir)
    more = F.substr(F.lit("ACGTACGTACGT"), F.lit(1), (div(F.col("h"), 16) % 9 + 1).cast("int"))
    kind = div(F.col("h"), 128) % 10
    return r.withColumn("ref", F.when(kind.isin(7, 9), F.concat("ref", more)).otherwise(F.col("ref"))).withColumn("alt", F.when(kind.isin(8, 9), F.concat("alt", more)).otherwise(F.col("alt")))


def vcf_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edited() with genotype, filter and, for some, symbolic ALTs."""
    r = edited(spark, sf_dir)
    g, f, s = div(F.col("h"), 1024) % 8, div(F.col("h"), 8192) % 10, div(F.col("h"), 65536) % 20
    gt = F.element_at(F.array(*[F.lit(x) for x in GENOTYPES]), (g + 1).cast("int"))
    return r.withColumn("gt", gt).withColumn("filter", F.when(f < 7, "PASS").when(f == 7, ".").otherwise("LowQual")).withColumn("alt", F.when(s == 0, "<DEL>").when(s == 1, F.concat("ref", F.lit("[chr2:"), F.col("pos").cast("string"), F.lit("["))).otherwise(F.col("alt")))


#: Genotypes that vcf_fields() deals out.
GENOTYPES = ("0/1", "1/1", "0|1", "1|0", "0/0", "./.", "./1", "1/1")


def structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(contig, pos, type, length, gt, cn): structural variants from orders."""
    o = table(spark, sf_dir, "orders")
    kind = F.element_at(F.array(*[F.lit(x) for x in SV_TYPES]), F.substring("o_orderpriority", 1, 1).cast("int"))
    return o.select(
        F.concat(F.lit("chr"), (F.col("o_custkey") % 5 + 1).cast("string")).alias("contig"),
        (F.col("o_custkey") * 97 + 1).alias("pos"),
        kind.alias("type"),
        F.floor(F.col("o_totalprice") / 100).alias("length"),
        F.when(F.col("o_orderkey") % 3 == 0, "1/1").otherwise("0/1").alias("gt"),
        (F.col("o_orderkey") % 6).cast("int").alias("cn"),
        F.col("o_orderkey").alias("id"),
    )


SV_TYPES = ("DEL", "DUP", "CNV", "INS", "INV")


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(contig, start, end, id): sequenced fragments from line items."""
    r = records(spark, sf_dir)
    start = F.col("part_id") * 7 + F.col("h") % 50
    return r.select("contig", start.alias("start"), (start + 100 + F.col("quantity").cast("long") * 6).alias("end"), F.concat_ws(":", F.col("order_id").cast("string"), F.col("line_id").cast("string"), (F.col("h") % 1000).cast("string")).alias("id"), "h")


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(contig, pos0, mapq, tlen, paired, first, mate_mapped, same_ref, secondary, left_clip, read_len, id): aligned reads."""
    f = fragments(spark, sf_dir)
    b = lambda n, of: (div(F.col("h"), n) % of)
    return f.select(
        "contig", F.col("start").alias("pos0"), (b(64, 70)).cast("int").alias("mapq"),
        F.when(b(8, 2) == 0, F.col("end") - F.col("start")).otherwise(F.col("start") - F.col("end")).alias("tlen"),
        (b(256, 20) > 0).alias("paired"), (b(32, 2) == 0).alias("first"), (b(512, 20) > 0).alias("mate_mapped"), (b(4096, 20) > 0).alias("same_ref"), (b(1024, 30) == 0).alias("secondary"),
        F.when(b(2048, 6) == 0, b(16384, 40)).otherwise(F.lit(0)).alias("left_clip"), F.lit(100).alias("read_len"), "id",
    )


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, seq, scores): each document's text cut into pieces of 100 characters, as qualities 2 to 41."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                seq = re.sub("[^ -~]", "~", text.as_py() or "")
                pieces = [seq[i : i + 100] for i in range(0, len(seq), 100) if len(seq) - i >= 2]
                scores = np.frombuffer("".join(pieces).encode(), np.uint8).astype(np.int32) % 40 + 2
                edges = np.minimum(np.arange(len(pieces) + 1) * 100, len(scores)).astype(np.int32)
                ids = [f"r{name}_{i}" for i in range(len(pieces))]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(pieces, pa.string()), pa.ListArray.from_arrays(pa.array(edges), pa.array(scores))], ["read_id", "seq", "scores"])

    ship(spark)
    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(run, "read_id string, seq string, scores array<int>")


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(contig, pos0, length, h, ref, id, quantity): the records of line items whose part names a document, at a place of its contig."""
    # behind a shuffle of two columns, as a length would be counted anew for each record that meets its contig, and without a condition on it,
    # for which it would be counted once more
    t = table(spark, sf_dir, "documents").where(F.col("text").rlike("[A-Za-z]"))
    c = t.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("contig"), F.length(letters_of(F.col("text"))).cast("long").alias("length")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "contig")
    r = records(spark, sf_dir).select(F.concat(F.lit("doc"), F.col("part_id").cast("string")).alias("contig"), "h", "ref", F.concat_ws(":", F.col("order_id").cast("string"), F.col("line_id").cast("string"), (F.col("h") % 1000).cast("string")).alias("id"), F.col("quantity").cast("long").alias("quantity"))
    return r.join(c, "contig").withColumn("pos0", F.col("h") % F.col("length"))


#: The same as SQL, by name; an entry may use those above it.
SQL = {
    "li": "select *, cast(concat('0x', substr(md5(concat_ws('|', 'v', l_orderkey::varchar, l_linenumber::varchar)), 1, 12)) as bigint) h from lineitem",
    "records": """select concat('chr', (l_suppkey % 5 + 1)::varchar) contig, l_partkey * 37 + l_linenumber * 11 pos, substr('ACGT', (h % 4)::int + 1, 1) ref,
  substr('ACGT', ((h % 4 + 1 + (h // 4) % 3) % 4)::int + 1, 1) alt, h, l_orderkey order_id, l_linenumber line_id, l_quantity quantity, l_discount discount, l_tax tax, l_partkey part_id from li""",
    "truth": "select * from records where h % 10 < 8",
    "called": "select * from records where h % 10 >= 1",
    "orders_bed": "select concat('chr', (o_custkey % 5 + 1)::varchar) contig, o_custkey * 5 as start, o_custkey * 5 + 20 + o_orderkey % 60 as stop, o_orderkey id, o_totalprice as value from orders",
    "bed": "select * from orders_bed",
    "contigs": "select concat('doc', doc_id::varchar) contig, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'AACCGGTTAACCGGTTAACCGGTTAN') seq from documents",
    "edited": """select r.* replace (case when (h // 128) % 10 in (7, 9) then ref || more else ref end as ref, case when (h // 128) % 10 in (8, 9) then alt || more else alt end as alt)
  from (select *, substr('ACGTACGTACGT', 1, ((h // 16) % 9 + 1)::int) more from records) r""",
    "vcf_fields": """select * replace (case when (h // 65536) % 20 = 0 then '<DEL>' when (h // 65536) % 20 = 1 then ref || '[chr2:' || pos::varchar || '[' else alt end as alt),
  ['0/1', '1/1', '0|1', '1|0', '0/0', './.', './1', '1/1'][((h // 1024) % 8)::int + 1] gt, case when (h // 8192) % 10 < 7 then 'PASS' when (h // 8192) % 10 = 7 then '.' else 'LowQual' end as filter from edited""",
    "structural": """select concat('chr', (o_custkey % 5 + 1)::varchar) contig, o_custkey * 97 + 1 pos, ['DEL', 'DUP', 'CNV', 'INS', 'INV'][substr(o_orderpriority, 1, 1)::int] as type,
  floor(o_totalprice / 100)::bigint length, case when o_orderkey % 3 = 0 then '1/1' else '0/1' end gt, (o_orderkey % 6)::int cn, o_orderkey id from orders""",
    "fragments": """select contig, part_id * 7 + h % 50 as start, part_id * 7 + h % 50 + 100 + quantity::bigint * 6 as stop, concat_ws(':', order_id::varchar, line_id::varchar, (h % 1000)::varchar) id, h from records""",
    "alignments": """select contig, start pos0, ((h // 64) % 70)::int mapq, case when (h // 8) % 2 = 0 then stop - start else start - stop end tlen, (h // 256) % 20 > 0 paired, (h // 32) % 2 = 0 as first,
  (h // 512) % 20 > 0 mate_mapped, (h // 4096) % 20 > 0 same_ref, (h // 1024) % 30 = 0 secondary, case when (h // 2048) % 6 = 0 then (h // 16384) % 40 else 0 end left_clip, 100 read_len, id from fragments""",
    "reads": """select read_id, seq, list_transform(range(1, length(seq) + 1), lambda i: ascii(seq[i]) % 40 + 2) scores from (
  select concat('r', doc_id::varchar, '_', piece::varchar) read_id, regexp_replace(substr(text, (piece * 100 + 1)::int, 100), '[^ -~]', '~', 'g') seq from (
    select doc_id, text, unnest(range(0, length(text) // 100 + 1)) piece from documents)) where length(seq) >= 2""",
    "located": """select c.contig, seq, length(seq)::bigint length, h % length(seq) pos0, h, ref, concat_ws(':', order_id::varchar, line_id::varchar, (h % 1000)::varchar) id, quantity::bigint quantity
  from records r join contigs c on c.contig = concat('doc', r.part_id::varchar) where length(seq) > 0""",
}
_NEEDS = {"records": ["li"], "located": ["records", "contigs"], "truth": ["records"], "called": ["records"], "bed": ["orders_bed"], "edited": ["records"], "vcf_fields": ["edited"], "fragments": ["records"], "alignments": ["fragments"]}


def with_inputs(names: str, sql: str) -> str:
    """sql under a WITH clause of the named inputs and what they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in _NEEDS.get(name, []):
            add(x)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    return "with " + ",\n".join(f"{n} as ({SQL[n]})" for n in order) + (", " if sql.lstrip().startswith("~") else "\n") + sql.lstrip().removeprefix("~")
