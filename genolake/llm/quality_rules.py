"""Quality rules by divergence: a document's character-class and common-word histograms against those of each language.

References are the summed histograms of all documents of a language that pass the base rules. A document is as far from the
corpus as from its nearest language, in Jensen-Shannon distance (base 2, so from 0 to 1). Short documents have no steady
histogram, and are not judged by it. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, join_small, staged

SPACE = r"[\x20\x09-\x0D]+"
#: Character classes, in the order in which they are taken out of a text; the rest is the last class.
CLASSES = {
    "lower": "[a-z]+",
    "space": SPACE,
    "symbol": r"[#*$%&|<>]+",
    "upper": "[A-Z]+",
    "stop": r"[.,;:!?'\"()-]+",
    "digit": "[0-9]+",
}
# Frequent function words of English, French, German and Spanish.
COMMON_WORDS = (
    "the of and to in is that was for it on with as be at by this had not are but from or have an they which one you were "
    "le la les de des du un une et est en que qui dans pour pas sur au par il elle ne se ce son avec plus "
    "der die das und ist von mit den dem ein eine zu nicht auf für im auch sich es an werden aus er hat dass "
    "el los las y por con para su una del lo como más pero sus al o este sí porque"
).split()
WORDS = list(dict.fromkeys(COMMON_WORDS))
MIN_WORDS, MOST_REPEATED = 20, 30
#: Least length at which each histogram is judged, and its largest distance.
CLASS_CHARS, CLASS_DISTANCE = 300, 0.25
WORD_COUNT, WORD_DISTANCE = 100, 0.33


def base_counts(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), class_counts and word_counts, in place of
    the text."""
    ws = SPACE
    out = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    out = out.withColumn("words", F.filter(F.split("text", ws), lambda w: w != "")).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    left, lengths = F.col("text"), [F.length("text")]
    for name, pattern in CLASSES.items():
        out = out.withColumn(f"left_{name}", F.regexp_replace(left, pattern, ""))
        left = F.col(f"left_{name}")
        lengths.append(F.length(left))
    counts = [(a - b).cast("long") for a, b in zip(lengths, lengths[1:], strict=False)] + [lengths[-1].cast("long")]
    by_name = dict(zip(CLASSES, counts, strict=False))
    out = out.select(
        *[c for c in out.columns if c not in {"text", *(f"left_{n}" for n in CLASSES)}],
        F.array(*counts).alias("class_counts"),
        (F.length("text") - by_name["space"]).cast("long").alias("word_chars"),
        by_name["symbol"].alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
        F.array_sort(F.filter(F.transform("words", lambda w: F.lower(w)), lambda w: w.isin(*WORDS))).alias("common"),
    ).withColumn("n_words", F.size("words").cast("long"))
    window = F.transform(F.sequence(F.lit(0), F.size("hashes") - 8), lambda i: F.xxhash64(*[F.get(F.col("hashes"), i + k) for k in range(8)]))
    out = out.withColumn("windows", F.when(F.size("hashes") >= 8, window).otherwise(F.array().cast("array<bigint>"))).withColumn("seen", F.array_distinct("common"))
    again = F.size(F.array_distinct("windows")) < F.size("windows")
    out = out.withColumn("placed", F.when(again, F.array_sort(F.transform("windows", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    twin = lambda e, i: ((i > 0) & (F.get("placed", F.greatest(i - 1, F.lit(0)))["x"] == e["x"])) | F.coalesce(F.get("placed", i + 1)["x"] == e["x"], F.lit(False))
    out = out.withColumn("at", F.array_sort(F.transform(F.filter("placed", twin), lambda e: e["i"])))
    reach = F.transform("at", lambda x, i: F.least(F.lit(8), F.coalesce(F.get("at", i + 1) - x, F.lit(8))))
    out = out.withColumn("n_repeat_words", F.coalesce(F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")))
    # the sorted common words are runs: each word's count is the distance to the next one's place
    out = out.withColumn("from", F.transform("seen", lambda w: F.array_position("common", w)))
    vocabulary = F.array(*[F.lit(w) for w in WORDS])
    counted = F.transform("seen", lambda w, i: F.struct(F.array_position(vocabulary, w).cast("int").alias("word"), (F.coalesce(F.get("from", i + 1), F.size("common") + F.lit(1).cast("long")) - F.get("from", i)).alias("n")))
    out = out.withColumn("word_counts", counted)
    return out.drop("words", "lines", "hashes", "common", "windows", "seen", "placed", "at", "from")


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MOST_REPEATED * n_words)


def references(counted: DataFrame, lang: str) -> list[tuple[list[float], list[float]]]:
    """Of each language, the shares of the character classes and of the common words (the others are the last share). As
    many rows as there are languages reach the driver."""
    good = counted.where(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    classes = good.groupBy(lang).agg(*[F.sum(F.get("class_counts", F.lit(i))).alias(str(i)) for i in range(len(CLASSES) + 1)], F.sum("n_words").alias("words"))
    words = good.select(lang, F.explode("word_counts").alias("w")).groupBy(lang, "w.word").agg(F.sum("w.n").alias("n"))
    held: dict = {}
    for r in words.collect():
        held.setdefault(r[lang], {})[r["word"]] = r["n"]
    out = []
    for r in sorted(classes.collect(), key=lambda r: str(r[lang])):
        chars, found = [float(r[str(i)]) for i in range(len(CLASSES) + 1)], [float(held.get(r[lang], {}).get(i + 1, 0)) for i in range(len(WORDS))]
        out.append(([c / sum(chars) for c in chars], [w / r["words"] for w in [*found, r["words"] - sum(found)]]))
    return out


def _part(p: Column, q: Column) -> Column:
    """What one value adds to the Jensen-Shannon divergence beyond q / 2, its share where p is 0."""
    bits = lambda x: F.when(x > 0, x * F.log2(2 * x / (p + q))).otherwise(0.0)
    return (bits(p) + bits(q) - q) / 2


def _distance(parts: Column) -> Column:
    divergence = F.lit(0.5) + F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), divergence)))


def class_distance(counts: Column, shares: list[float]) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    q = F.array(*[F.lit(x) for x in shares])
    return _distance(F.transform(counts, lambda n, i: _part(n / F.greatest(total, F.lit(1)), F.get(q, i))))


def word_distance(counts: Column, n_words: Column, shares: list[float]) -> Column:
    n, q = F.greatest(n_words, F.lit(1)), F.array(*[F.lit(x) for x in shares])
    others = n_words - F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    parts = F.transform(counts, lambda x: _part(x["n"] / n, F.get(q, x["word"] - 1)))
    return _distance(F.concat(parts, F.array(_part(others / n, F.lit(shares[-1])))))


def judge(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Returns the columns `keep` of docs (text, lang and others), then n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words (long), base_failed, class_distance, word_distance and kept, a row per row of docs.

    A null text has no words and fails. A null lang is a language of its own for the references; predictions don't use lang.
    Distances are those to the nearest language; without any reference they are 0. Repeated rows are judged alike; an empty
    table gives no rows."""
    renamed = [f"keep_{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(r) for c, r in zip(keep, renamed, strict=True)], F.col("lang").alias("keep_lang"), "text")
    counted = staged(base_counts(rows), "counts")
    found = references(counted, "keep_lang")
    nearest = lambda ds: F.least(*ds) if len(ds) > 1 else ds[0] if ds else F.lit(0.0)
    out = counted.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    out = out.withColumn("class_distance", nearest([class_distance(F.col("class_counts"), c) for c, _ in found])).withColumn("word_distance", nearest([word_distance(F.col("word_counts"), F.col("n_words"), w) for _, w in found]))
    fits = ((F.col("word_chars") < CLASS_CHARS) | (F.col("class_distance") <= CLASS_DISTANCE)) & ((F.col("n_words") < WORD_COUNT) | (F.col("word_distance") <= WORD_DISTANCE))
    out = out.withColumn("kept", ~F.col("base_failed") & fits)
    return out.select(*[F.col(r).alias(c) for c, r in zip(keep, renamed, strict=True)], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """docs without the rows that judge() refuses. A verdict depends on the text and the corpus alone, so only the texts' hashes
    (64 bits) and lengths are staged beside the counts, and the refused ones are taken out of docs by these."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    mark, size = (fresh(docs, c) for c in ("text_hash", "text_size"))
    marked = docs.withColumn(mark, F.xxhash64(text)).withColumn(size, F.length(text))
    refused = staged(judge(marked, [mark, size]).where("not kept").select(mark, size).distinct(), "refused")
    return join_small(marked, refused, [mark, size], "left_anti").select(*docs.columns)
