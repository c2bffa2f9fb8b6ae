"""Small tables with the cases that every operator must bear, and brute-force helpers."""

import re

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("key", T.StringType()), T.StructField("kept", T.IntegerType())])
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(n, seed=0, words=("river", "stone", "letter", "window", "garden", "market", "winter", "silver", "morning", "paper", "and", "the", "of", "under", "between")):
    import random

    r = random.Random(seed)
    return " ".join(r.choice(words) + (str(r.randrange(50)) if r.random() < 0.4 else "") for _ in range(n))


def docs(spark, texts, first=0):
    """A table of texts, or of (doc_id, text), with further columns, two of them named as operators might name theirs."""
    rows = [t if isinstance(t, tuple) else (first + i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", None if t is None else len(t), "k", 1) for i, t in rows], DOCS)


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, k):
    w = words(text)
    return set() if not w else {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


ODD = [None, "", " \n\t", "one", "one", "ÀÉ ß", "a\x00b c", "x" * 3000, "<|im_end|> # * $"]
