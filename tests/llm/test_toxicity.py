"""The random field against sums over all taggings, its gradient, held-out documents and odd rows."""

import itertools
import random
import zlib

import numpy as np
import pytest

from genolake.llm import crf
from genolake.llm.toxicity import KINDS, facts_of, fit, score_toxicity, tag, train_chains, whole

from .fixtures import DOCS, prose

SF = "/root/testdata/sf0.1"


def weight(chain, e, tags):
    total = sum(x for x, t in zip(e, tags, strict=True) if t) + (chain.start if tags[0] else 0)
    step = {(0, 0): 0, (0, 1): chain.enter, (1, 0): chain.leave, (1, 1): chain.stay}
    return np.exp(total + sum(step[p] for p in itertools.pairwise(tags)))


@pytest.mark.parametrize("steps", [1, 3, 64])
def test_marginals_and_pairs_are_sums_over_all_taggings(monkeypatch, steps):
    monkeypatch.setattr(crf, "STEPS", max(steps, 2))
    rng = np.random.default_rng(3)
    chain = crf.Chain(-1.3, 0.4, 0.9, -0.7)
    sizes = [1, 5, 2, 7, 1, 4]
    e = rng.normal(0, 2, sum(sizes))
    begins = np.zeros(len(e), bool)
    begins[np.cumsum([0, *sizes[:-1]])] = True
    got, pairs = chain.pairs(e, begins)
    at = 0
    for n in sizes:
        own = e[at : at + n]
        tagged = [(t, weight(chain, own, t)) for t in itertools.product((0, 1), repeat=n)]
        z = sum(w for _, w in tagged)
        assert np.allclose(got[at : at + n], [sum(w for t, w in tagged if t[i]) / z for i in range(n)])
        for k, (a, b) in enumerate(((0, 1), (1, 0), (1, 1))):
            assert np.allclose(pairs[k, at + 1 : at + n], [sum(w for t, w in tagged if t[i - 1 : i + 1] == (a, b)) / z for i in range(1, n)])
        at += n
    assert np.allclose(chain.marginals(e, begins), got) and not pairs[:, begins].any()


def test_long_chains_scan_like_a_loop():
    rng = np.random.default_rng(4)
    chain, e = crf.Chain(-2.0, -0.5, 1.5, -1.0), rng.normal(0, 6, 50_000)
    begins = rng.random(50_000) < 0.001
    begins[0] = True
    forward, _ = chain.messages(e, begins)
    w, r = np.exp(np.clip(e, -crf.LIMIT, crf.LIMIT)), 0.0
    for i in range(len(e)):
        r = w[i] * (np.exp(chain.start) if begins[i] else (np.exp(chain.enter) + np.exp(chain.stay) * r) / (1 + np.exp(chain.leave) * r))
        assert abs(forward[i] - r) <= 1e-6 * r
    assert not len(chain.marginals(np.zeros(0), np.zeros(0, bool)))


def test_training_learns_words_and_that_spans_run_on():
    rng = np.random.default_rng(5)
    f, y, begins = [], [], []
    for _ in range(400):
        at = rng.integers(0, 8)
        for i in range(12):
            inside = at <= i < at + 3
            f.append([7 if i == at else int(rng.integers(20, 40))])
            y.append(int(inside))
            begins.append(i == 0)
    weights, bias, chain = crf.train(np.array(f), np.array(y), np.array(begins), 64, batch=20)
    assert weights[7] == weights.max() and chain.stay > chain.enter
    chance = chain.marginals(weights[np.array(f)[:, 0]] + bias, np.array(begins))
    assert ((chance > 0.5) == np.array(y)).mean() > 0.85
    again = crf.train(np.array(f), np.array(y), np.array(begins), 64, batch=20)
    assert np.array_equal(again[0], weights) and again[2] == chain


def test_tokens_of_pieces_are_tokens_of_the_whole(monkeypatch):
    text = np.frombuffer(("Les ÉTÉS, l'idiot### 42 日本 " * 300 + "z" * 5000).encode(), np.uint8)
    one = whole(text)
    from genolake.llm import toxicity

    monkeypatch.setattr(toxicity, "SEGMENT", 97)
    two = whole(text)
    assert all(np.array_equal(a, b) for a, b in zip(one, two, strict=True))
    words = [bytes(text[a:b]).decode() for a, b in zip(*one[:2], strict=True)]
    assert words[:6] == ["Les", "ÉTÉS", "l", "idiot", "42", "日本"] and one[2].shape == (len(words), KINDS)
    assert np.array_equal(whole(np.frombuffer("ÉTÉ".encode(), np.uint8))[2], whole(np.frombuffer("été".encode(), np.uint8))[2])


def test_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    some = docs.join(labels.select("doc_id"), "doc_id")
    rows = score_toxicity(some, labels).join(labels, "doc_id").join(docs.select("doc_id", "text"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.held_out]
    caught = sum(r.predicted for r in out if r.toxic == 1)
    assert caught >= 0.8 * sum(r.toxic == 1 for r in out)
    assert sum(r.predicted for r in out if r.toxic == 0) <= 0.02 * sum(r.toxic == 0 for r in out)
    # offsets are code points of whole tokens
    for r in rows:
        for s in r.spans:
            piece = r.text[s.start : s.end]
            assert piece and piece[0] != " " and piece[-1] != " " and 0.5 <= s.score <= 1
    named = [r.text[s.start : s.end].lower() for r in out for s in r.spans]
    assert sum(w in ("idiot", "stupid", "moron", "loser", "scum", "clown", "trash", "worthless", "pathetic", "disgusting") for w in named) > 50


def _labelled(spark):
    r = random.Random(9)
    bad = ["zorgle", "Zorglest", "zorgled!"]
    rows = [(i, prose(40, i) + (" " + r.choice(bad) + " " + prose(5, i + 999) if i % 3 == 0 else ""), "en", "s", 1, "k", 1) for i in range(400)]
    return rows, [(i, 1, int(i % 3 == 0)) for i in range(400)]


def test_odd_rows(spark):
    rows, marks = _labelled(spark)
    odd = [(1000, None, "en", "s", 1, "k", 1), (1001, "", "en", "s", 1, "k", 1), (1002, " .. ##\n", None, None, 1, "k", 1), (None, "you zorgle", "en", "s", 1, "k", 1), (1003, "ß " * 300_000 + "ZORGLE", "en", "s", 1, "k", 1), (3, "river", "en", "s", 1, "k", 1)]
    labels = spark.createDataFrame([*marks, (3, 1, 0), (None, 1, 1), (7, 1, None), (8, 1, 5)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows + odd, DOCS)
    got = [*score_toxicity(docs, labels).collect()]
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got if r.doc_id != 3}
    assert by[1000].score == by[1001].score == by[1002].score < 0.3 and by[1000].spans == []
    assert by[None].held_out and by[None].predicted == 1 and [(s.start, s.end) for s in by[None].spans] == [(4, 10)]
    assert by[1003].predicted == 1 and [(s.start, s.end) for s in by[1003].spans] == [(600_000, 600_006)]
    right = [by[i].predicted == t for i, _, t in marks if i != 3 and by[i].held_out]
    assert sum(right) >= 0.95 * len(right)
    assert score_toxicity(docs.limit(0), labels).count() == 0
    assert max(r.score for r in score_toxicity(docs, labels.limit(0)).collect()) < 0.01
    assert max(r.score for r in score_toxicity(docs, labels.where("toxic = 0")).collect()) < 0.01
    # the same rows in another deal give the same model
    a, b = fit(docs, labels), fit(docs.repartition(7), labels.repartition(3))
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.scale, b.scale)


def test_given_spans_are_learned(spark):
    """Token labels may be given as spans of texts; then no label of a document is needed."""
    from pyspark.sql import functions as F

    texts = []
    for i in range(300):
        a, b = prose(6, i), prose(6, i + 500)
        texts.append((f"{a} vile beast {b}", 1, [(len(a) + 1, len(a) + 11)]) if i % 2 else (f"{a} beast {b}", 0, []))
    rows = spark.createDataFrame(texts, "text string, label int, inside array<struct<start:int,end:int>>")
    model = train_chains(rows)
    docs = spark.createDataFrame([(1, "the river vile beast and stone"), (2, "a beast of the river")], "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in tag(docs, model).select("doc_id", F.col("spans")).collect()}
    assert got == {1: [(10, 20)], 2: []}


def test_facts():
    assert facts_of(np.zeros(0))[1] == 0 and facts_of(np.array([0.1, 0.9]))[1] == pytest.approx(np.log1p(0.9))
    assert facts_of(np.array([0.1] * 1000))[1] == 0
