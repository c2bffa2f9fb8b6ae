"""Language identification and the quality classifier: held-out accuracy and odd rows."""

import numpy as np
import zlib

from genolake.llm.embedding import BUCKETS, Model, letter_ngrams, scorer, train, words_and_ngrams
from genolake.llm.language_id import identify
from genolake.llm.quality_classifier import classify_quality

from .fixtures import DOCS, prose

SF = "/root/testdata/sf0.01"


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in out) >= 0.97 * len(out)


def test_odd_texts_have_no_language(spark):
    rows = [(i, "the river and the stone" if i % 2 else "der fluss und das haus", "en" if i % 2 else "de", "s", 1, "k", 1) for i in range(80)]
    rows += [(100, None, "en", None, 1, "k", 1), (101, "", None, "s", 1, "k", 1), (102, "12 34 !?", "en", "s", 1, "k", 1), (None, "the stone", None, "s", 1, "k", 1)]
    got = {r.doc_id: r for r in identify(spark.createDataFrame(rows, DOCS)).collect()}
    assert {got[i].lang_pred for i in (100, 101, 102)} == {"und"} and got[100].score == 0
    assert got[1].lang_pred == "en" and got[None].lang_pred == "en" and got[None].held_out
    assert identify(spark.createDataFrame([], DOCS)).count() == 0
    assert {r.lang_pred for r in identify(spark.createDataFrame(rows, DOCS).where("lang is null")).collect()} == {"und"}


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    some = docs.join(labels.select("doc_id"), "doc_id")
    got = classify_quality(some, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.predicted == r.quality for r in out) >= 0.92 * len(out)


def test_quality_of_odd_rows(spark):
    rows = [(i, prose(40, i) if i % 2 else "### $$$ " * 20, "en", "s", 1, "k", 1) for i in range(60)] + [(100, None, "en", "s", 1, "k", 1), (101, "", "en", "s", 1, "k", 1), (None, "x", "en", "s", 1, "k", 1)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(3, 1, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in classify_quality(docs, labels).collect()}
    assert len(got) == 63 and got[100].score == got[101].score and got[None].held_out
    assert got[5].predicted == 1 and got[4].predicted == 0
    assert {r.score for r in classify_quality(docs, labels.limit(0)).collect()} == {0.0}
    assert classify_quality(docs.limit(0), labels).count() == 0


def test_training_separates_and_is_repeatable():
    rng = np.random.default_rng(1)
    counts = rng.poisson(1.0, (200, BUCKETS)).astype(np.float32)
    y = (np.arange(200) % 2).tolist()
    counts[::2, 7] += 30
    a, b = train(counts, y), train(counts, y)
    shares = counts / counts.sum(axis=1, keepdims=True)
    assert (a.probabilities(shares).argmax(axis=1) == y).mean() > 0.85
    assert np.array_equal(a.table, b.table) and a.temperature > 0


def test_features_count_all_of_a_text():
    text = np.frombuffer(("ab cd " * 200_000).encode(), np.uint8)
    assert letter_ngrams(text).sum() == 3 * len(text) - (1 + 2 + 3)
    assert words_and_ngrams(np.frombuffer(b"a a b a", np.uint8))[-2:].tolist() == [1, 1]


def test_scores_are_the_softmax_of_averages():
    """The scorer against a plain loop: the mean of the features' rows, plus the bias, over the temperature, as a softmax."""
    rng = np.random.default_rng(2)
    for features, width in ((letter_ngrams, BUCKETS), (words_and_ngrams, 2 * BUCKETS + 2)):
        model = Model(["a", "b", "c"], rng.normal(0, 3, (width, 3)).astype(np.float32), np.array([0.1, -0.2, 0.3], np.float32), 1.7)
        score = scorer(model, features)
        for text in ("", "x", "the river the river", prose(300, 4), "é ß 12 ###"):
            counts = features(np.frombuffer(text.encode(), np.uint8))
            mean = sum((int(n) * model.table[i].astype(float) for i, n in enumerate(counts) if n), np.zeros(3)) / max(int(counts.sum()), 1)
            logits = [np.exp((m + b) / 1.7) for m, b in zip(mean, model.bias, strict=True)]
            assert np.allclose(score(np.frombuffer(text.encode(), np.uint8)), np.array(logits) / sum(logits), atol=1e-5)
