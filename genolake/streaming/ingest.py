"""Optional stream ingest: line checks that need no state, and counts that add up. Everything else is a batch job.

Sources and sinks are the caller's; the functions take and return streaming (or batch) DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vcf


def vcf_line_findings(lines: DataFrame) -> DataFrame:
    """(file, text, severity, rule) of VCF record lines (file, text) that break a rule which one line alone decides."""
    c = F.split("text", "\t")
    at = lambda i: F.get(c, F.lit(i))
    rules = F.array(
        F.when(F.size(c) < 8, F.lit("too_few_columns")),
        F.when(at(1).try_cast("long").isNull(), F.lit("bad_position")),
        F.when(~F.coalesce(at(3), F.lit("")).rlike("^[ACGTNacgtn]+$"), F.lit("bad_reference")),
    )
    rows = lines.where(~F.col("text").startswith("#") & (F.col("text") != ""))
    return rows.select("file", "text", F.lit("ERROR").alias("severity"), F.explode(F.array_compact(rules)).alias("rule"))


def variant_counts(records: DataFrame) -> DataFrame:
    """(contig, type, n): counts that grow as records (contig, ref, alt) arrive; for update or complete output."""
    return records.groupBy("contig", vcf.variant_type(F.col("ref"), F.col("alt")).alias("type")).agg(F.count("*").alias("n"))


def windowed_counts(events: DataFrame, time: str, delay: str, window: str, by: list[str]) -> DataFrame:
    """(window, by..., n) of events by event time; rows later than `delay` behind the watermark are left out."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).groupBy(F.window(time, window), *by).agg(F.count("*").alias("n"))
