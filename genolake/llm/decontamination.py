"""Benchmark decontamination: a size-partitioned MinHash containment search, verified by exact shingle containment.
DataFrame functions only.

A test item is contained in a document if at least a share t of the item's distinct k-word shingles are in it. An item of n
shingles may miss at most (1 - t) n of them, so among the (1 - t) n + 1 of its shingles with the least hashes (its bottom
MinHash sketch) at least one is in every document that contains it. Items are partitioned by size, and the sketch of a
partition is as long as its largest item needs. A document probes with all its shingles, so its length doesn't matter; plain
MinHash signatures of whole documents would miss short items in long ones. Candidates are verified by counting the item's
shingles in the document, so the result is exact but for 64-bit hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_small, staged

SHINGLE, PERCENT = 5, 80


def words_of(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles_of(words: Column, k: Column | int) -> Column:
    """Hashes of the distinct k-word shingles; fewer words than k have none."""
    k = F.lit(k) if isinstance(k, int) else k
    starts = F.when(F.size(words) >= k, F.sequence(F.lit(1), F.size(words) - k + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, k))))


def _with_length(k: int):
    return lambda x: F.struct(F.lit(k).alias("k"), x.alias("shingle"))


def item_shingles(items: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(item, item_id, k, shingles), a row per different (item_id, words): an item of fewer words than k is one shingle of all
    its words; items without words are left out."""
    rows = items.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    rows = rows.withColumn("k", F.least(F.lit(k), F.size("words")))
    return rows.select(F.xxhash64("item_id", "words").alias("item"), "item_id", "k", shingles_of(F.col("words"), F.col("k")).alias("shingles")).dropDuplicates(["item"])


def sketches(shingled: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(item, k, sketch). Partitions are powers of two of the item's size; a partition's sketch length suits its largest item."""
    largest = F.pow(F.lit(2), F.floor(F.log2(F.size("shingles"))) + 1).cast("int") - 1
    needed = largest - F.ceil(F.lit(percent) * largest / 100).cast("int") + 1
    return shingled.select("item", "k", F.slice(F.array_sort("shingles"), F.lit(1), needed).alias("sketch"))


def contained_items(docs: DataFrame, items: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Returns (doc_id, item_id, n_item, n_shared): every pair of which the document holds percent / 100 of the item's distinct
    shingles or more. docs: doc_id, text; items: item_id, text; other columns are ignored.

    Null and empty texts contain nothing and are in nothing. Rows that repeat a doc_id, or have none, count together; of
    items that repeat an item_id the one that is contained most counts. An empty table gives no rows."""
    shingled = staged(item_shingles(items, k), "items")
    lengths = sorted(r.k for r in shingled.select("k").distinct().collect()) or [k]  # k values at most
    sketch = sketches(shingled, percent).select("k", "item", F.explode("sketch").alias("shingle"))
    probe = staged(sketch.distinct(), "probes")

    def held(rows: DataFrame) -> DataFrame:
        rows = rows.select("doc_id", words_of(F.col("text")).alias("words"))
        of = [F.transform(shingles_of(F.col("words"), n), _with_length(n)) for n in lengths]
        return rows.select("doc_id", F.explode(of[0] if len(of) == 1 else F.concat(*of)).alias("s")).select("doc_id", "s.k", "s.shingle")

    pairs = join_small(held(docs), probe, ["k", "shingle"], "inner").select("doc_id", "item").distinct()
    pairs = staged(pairs, "candidates")
    suspects = staged(pairs.where("doc_id is not null").select("doc_id").distinct(), "suspects")
    again = join_small(docs.select("doc_id", "text"), suspects, ["doc_id"], "left_semi").union(docs.select("doc_id", "text").where("doc_id is null"))
    whole = staged(shingled.select("k", "item", F.explode("shingles").alias("shingle")), "item_shingles")
    shared = join_small(held(again), whole, ["k", "shingle"], "inner").select("doc_id", "item", "shingle").distinct().groupBy("doc_id", "item").agg(F.count("*").alias("n_shared"))
    sizes = shingled.select("item", "item_id", F.size("shingles").cast("long").alias("n_item"))
    found = join_small(shared, sizes, ["item"], "inner").where(100 * F.col("n_shared") >= percent * F.col("n_item"))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("share"), "n_item", "n_shared")).alias("best"))
    return best.select("doc_id", "item_id", "best.n_item", "best.n_shared")


def without_leaks(docs: DataFrame, items: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs without the rows that contain an item. Rows without a doc_id can't be told apart: they go if one of them leaks."""
    found = staged(contained_items(docs, items, k, percent).select("doc_id").distinct(), "leaks")
    out = join_small(docs, found.where("doc_id is not null"), ["doc_id"], "left_anti")
    return out.where("doc_id is not null") if found.where("doc_id is null").limit(1).count() else out
