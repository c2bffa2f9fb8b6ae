"""Filter interaction audit: which filters fail together, and what each order of filters keeps, removes and loses.

A document fails filters A to D by its own text, and E if a document of smaller id has the same text: an existential self-join,
left-semi on the hash, the exact text and the smaller id. Its right side is one witness a text, the least id, so a group of copies
costs its number. The ids that fail are united, their bits combined, and all orders follow from the counts of combinations."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import BROADCAST_BYTES
from .common import discard, join_hot, size_of, staged

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Rows of one hash that a task of the self-join gets, about.
PART = 1000


def failures(text: Column) -> Column:
    """Bits 1, 2, 4 and 8: under 100 words; fewer than 80 % of them distinct; over 10 % capitals A-Z; a character of #$%&*|."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    bits = [F.size(words) < 100, 100 * F.size(F.array_distinct(words)) < 80 * F.size(words), 100 * capitals.cast("long") > 10 * F.length(text), text.rlike("[#$%&*|]")]
    return sum((F.when(b, 1 << i).otherwise(0) for i, b in enumerate(bits)), F.lit(0))


def later_copies(rows: DataFrame, keys: DataFrame, part: int = PART, most: int = BROADCAST_BYTES) -> tuple[DataFrame, list[DataFrame]]:
    """The rows (doc_id, text, ...) whose text a row of smaller doc_id has too; a null doc_id is neither smaller nor larger. keys: the
    (doc_id, digest) of the rows, digest by xxhash64. Second, the staged tables that the result reads.

    Hashes of one doc_id only leave first. A witness is the least doc_id of a text. Witnesses above `most` bytes aren't broadcast: the rows
    of a hash are then dealt to parts of about `part` rows, and its witnesses copied to each of these."""
    often = keys.where("doc_id is not null").groupBy("digest").agg(F.count("*").alias("_n"), F.min("doc_id").alias("_low"), F.max("doc_id").alias("_high"))
    often = staged(often.where("_low < _high").select("digest", "_n"), "hashes")
    hashed = rows.where("doc_id is not null").withColumn("digest", F.xxhash64("text"))
    some = hashed.join(F.broadcast(often), "digest") if size_of(often) <= most else join_hot(hashed, often, "digest", "_n")
    witnesses = staged(some.groupBy("digest", "text").agg(F.min("doc_id").alias("doc_id"), F.max("_n").alias("_n")), "witnesses")
    left, right, on = some.alias("l"), F.broadcast(witnesses), []
    if size_of(witnesses) > most:
        parts = F.floor(F.col("_n") / part)
        right = witnesses.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts)))
        left = some.withColumn("_part", F.pmod(F.xxhash64("doc_id"), parts + 1)).alias("l")
        on = [F.col("l._part") == F.col("r._part")]
    same = [F.col("l.digest") == F.col("r.digest"), F.col("l.text") == F.col("r.text"), F.col("l.doc_id") > F.col("r.doc_id")]
    return left.join(right.alias("r"), [*on, *same], "left_semi").select(*rows.columns), [often, witnesses]


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, bits, n, good, toxic): how many documents of a part fail just the filters in bits, and their labels."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"))
    key = ["doc_id", F.xxhash64("text").alias("digest"), F.length("text").alias("length"), "part"]
    own = staged(rows.select(*key, failures(F.col("text")).alias("bits")), "failures")
    copies, tables = later_copies(rows, own)
    copies = copies.select(*key, F.lit(16).alias("bits"))
    # rows of one id and one text fail alike, so a group's rows are those of either side
    ids = own.where("bits > 0").union(copies).groupBy("doc_id", "digest", "length", "part").agg(F.bit_or("bits").alias("bits"), F.greatest(F.count_if(F.col("bits") < 16), F.count_if(F.col("bits") == 16)).alias("n"))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.expr("int(quality = 1)")).alias("good"), F.max(F.expr("int(toxic = 1)")).alias("toxic"))
    ids = ids.groupBy("doc_id", "part", "bits").agg(F.sum("n").alias("n")).join(marks, "doc_id", "left")
    total = own.groupBy("part").agg(F.count("*").alias("all"))
    known = staged(ids.groupBy("part", "bits").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic")), "combinations")
    clean = total.join(known.groupBy("part").agg(F.sum("n").alias("failed")), "part", "left").select("part", F.lit(0).alias("bits"), (F.col("all") - F.coalesce("failed", F.lit(0))).alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    out = staged(known.union(clean), "audit")
    discard(own, known, *tables)
    return out


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per part (each lang; null: empty string), filter order and step: documents kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, and the Shapley sum of the step's filter over all orders.

    docs: (doc_id, text, lang); labels: (doc_id, quality, toxic), of which a repeated doc_id counts once, with a 1 if any row
    has it. Other columns are ignored. A null text is empty. Rows count singly, those that repeat a doc_id too; a copy needs
    a smaller doc_id, so equal ids and null ids make none. No documents give no rows."""
    counts = combinations(docs, labels)
    steps = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s + 1).alias("step"), F.lit(1 << FILTERS.index(c)).alias("bit"), F.lit(sum(1 << FILTERS.index(b) for b in o[:s])).alias("past")) for o in ORDERS for s, c in enumerate(o)])
    rows = counts.select("*", F.inline(steps))
    bits, bit, past = F.col("bits"), F.col("bit"), F.col("past")
    fails, earlier = bits.bitwiseAND(bit) > 0, bits.bitwiseAND(past) > 0
    here = fails & ~earlier
    total = lambda when, value="n": F.coalesce(F.sum(F.when(when, F.col(value))), F.lit(0)).cast("long")
    out = rows.groupBy("part", "filter_order", "step", "bit").agg(
        total(~fails & ~earlier).alias("kept"), total(here).alias("removed"), total(fails & earlier).alias("redundant"), total(bits == bit).alias("unique_fails"), total(here, "good").alias("good_lost"), total(here, "toxic").alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")
