"""The filter audit against brute force and the given SQL."""

import re
from collections import defaultdict
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from genolake.llm import queries
from genolake.llm.filter_audit import audit_filters, later_copies

from .fixtures import DOCS, ODD, WORD, prose

COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def fails(text):
    w = WORD.findall(text)
    return "".join(c for c, x in (("A", len(w) < 100), ("B", 100 * len(set(w)) < 80 * len(w)), ("C", 100 * len(re.findall("[A-Z]", text)) > 10 * len(text)), ("D", bool(re.search("[#$%&*|]", text)))) if x)


def brute(docs, labels):
    low = {}
    for i, text, _ in docs:
        if i is not None:
            low[text or ""] = min(low.get(text or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = [(i, part or "", fails(text or "") + ("E" if i is not None and low[text or ""] < i else "")) for i, text, part in docs]
    out, total = {}, defaultdict(int)
    for part in {p for _, p, _ in rows}:
        own = [(i, f) for i, p, f in rows if p == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for k, c in enumerate(order):
                gone = [(i, f) for i, f in left if c in f]
                left = [(i, f) for i, f in left if c not in f]
                out[part, order, k + 1] = [len(left), len(gone), sum(c in f for _, f in own) - len(gone), sum(f == c for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
                total[part, c] += len(gone)
    return {key: (*v, total[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def found(df):
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in df.collect()}


@pytest.fixture(scope="module")
def odd():
    texts = [*ODD, prose(150, 1), prose(150, 1), prose(150, 2).upper(), "word " * 500, " ".join(f"w{i}" for i in range(120)), " ".join(f"w{i}" for i in range(120)) + " #", "ÀÉ" * 80, "x" * 2_000_000 + " y"]
    docs = [(i, t, ["en", "de", None, ""][i % 4]) for i, t in enumerate(texts)]
    docs += [(100 + i, " ".join(f"w{i}" for i in range(120)), "en") for i in range(40)] + [(None, prose(150, 1), "en"), (None, None, None), (5, "one", "en"), (5, "two", "en"), (9, prose(150, 1), "de"), (9, prose(150, 1), "de")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 140, 2)] + [(9, 1, 1), (9, 0, 0), (None, 1, 1), (4, None, None)]
    return docs, [(i, q, None if t is None else int(t)) for i, q, t in labels]


def test_odd_rows(spark, odd):
    docs, labels = odd
    table = spark.createDataFrame([(i, t, lang, "s", 1, "k", 1) for i, t, lang in docs], DOCS)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = found(audit_filters(table, marks))
    assert got == brute(docs, labels)
    assert len(got) == 600 * 3
    assert audit_filters(table.limit(0), marks).count() == 0
    assert found(audit_filters(table, marks.limit(0))) == brute(docs, [])


def test_copies_without_a_broadcast(spark, odd):
    """Parts of a hot hash give the same rows as a broadcast of witnesses."""
    docs, _ = odd
    rows = spark.createDataFrame([(i, t or "", lang) for i, t, lang in docs], "doc_id long, text string, part string")
    keys = rows.select("doc_id", F.xxhash64("text").alias("digest"))
    got = [sorted((r.doc_id, r.text) for r in later_copies(rows, keys, part, most)[0].collect()) for part, most in ((1000, 1 << 30), (3, -1))]
    low = {}
    for i, t, _ in docs:
        if i is not None:
            low[t or ""] = min(low.get(t or "", i), i)
    assert got[0] == got[1] == sorted((i, t or "") for i, t, _ in docs if i is not None and low[t or ""] < i)


def test_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    want = con.execute(queries.ORACLES["op12_filter_interaction_audit"])
    names = [c[0] for c in want.description]
    rows = [dict(zip(names, r, strict=True)) for r in want.fetchall()]
    want = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COUNTS) for r in rows}
    assert found(queries.QUERIES["op12_filter_interaction_audit"](spark, "/root/testdata/sf0.001")) == want
