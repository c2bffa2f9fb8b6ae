"""Line dedup by site-relative frequency: a line goes from all pages of a host if it stands on too large a share of them.
DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, join_small, staged

#: Share of a host's pages from which on a line is boilerplate, and the least number of pages that hold it.
RATIO, LEAST_PAGES = 0.08, 5


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST_PAGES) -> DataFrame:
    """Returns (host, line_hash, pages, host_pages): the lines that stand on at least `least` pages of a host and on more than
    `ratio` of its pages. A host has at most (lines of an average page) / ratio of these.

    Lines are split at \\n and compared as they are; a line of white space only is none. A line counts once a page. Pages with
    a null text count in their host's total; those with a null host form one host. Hashes are of 64 bits."""
    rows = pages.select(F.col(host).cast("string").alias("host"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    total = rows.groupBy("host").agg(F.count("*").alias("host_pages"))
    lines = F.array_distinct(F.transform(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.xxhash64(x)))
    counted = rows.select("host", F.explode(lines).alias("line_hash")).groupBy("host", "line_hash").agg(F.count("*").alias("pages")).where(F.col("pages") >= least)
    counted = counted.withColumn("key", F.coalesce("host", F.lit(""))).withColumn("no_host", F.col("host").isNull())
    total = total.select(F.coalesce("host", F.lit("")).alias("key"), F.col("host").isNull().alias("no_host"), "host_pages")
    return join_small(counted, total, ["key", "no_host"], "inner").where(F.col("pages") > F.lit(ratio) * F.col("host_pages")).select("host", "line_hash", "pages", "host_pages")


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST_PAGES) -> tuple[DataFrame, str]:
    """pages with the boilerplate lines taken out of text, all other lines as they were and in order, and the name of a
    further column: the number of lines taken out. A null text stays null; an empty table gives no rows."""
    gone = boilerplate(pages, host, text, ratio, least).groupBy("host").agg(F.collect_set("line_hash").alias("gone"))
    key, no_host, names, removed = (fresh(pages, c) for c in ("key", "no_host", "gone", "n_removed"))
    gone = staged(gone.select(F.coalesce("host", F.lit("")).alias(key), F.col("host").isNull().alias(no_host), F.col("gone").alias(names)), "boilerplate")
    rows = pages.withColumn(key, F.coalesce(F.col(host).cast("string"), F.lit(""))).withColumn(no_host, F.col(host).isNull())
    rows = join_small(rows, gone, [key, no_host], "left")
    lines = F.split(F.col(text).cast("string"), "\n")
    kept = F.filter(lines, lambda x: ~(F.array_contains(names, F.xxhash64(x)) & x.rlike(r"[^\x20\x09-\x0D]")))
    cut = F.when(F.col(names).isNull() | F.col(text).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    n = F.when(F.col(names).isNull() | F.col(text).isNull(), 0).otherwise(F.size(lines) - F.size(kept))
    out = rows.withColumn(removed, n.cast("long")).withColumn(text, cut)
    return out.select(*pages.columns, removed), removed


def without_boilerplate(docs: DataFrame) -> DataFrame:
    """docs (with source as host) without their boilerplate lines; n_chars, if there, follows the text."""
    out, _ = drop_boilerplate(docs)
    out = out.select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out
