"""Quality rules, line dedup and the pipeline's filters."""

import math
import re

from genolake.llm.line_dedup import drop_boilerplate, without_boilerplate
from genolake.llm.quality_rules import CLASS_CHARS, CLASS_DISTANCE, WORD_COUNT, WORD_DISTANCE, WORDS, judge, keep_good

from .fixtures import DOCS, ODD, WORD, docs, prose


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    again = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


def test_counts_as_brute_force(spark):
    twice = prose(12, 1)
    texts = [*ODD, prose(60, 2), f"{twice} x {twice} y {twice[:40]}", "a b c d e f g h a b c d e f g h", "w " * 40, "l1\n\nl1\n l1\n \nl2\nl1", "# $$ * a|b", "a\x0bb\x0cc\rd\te"]
    got = {r.doc_id: r for r in judge(docs(spark, texts), ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        n = counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n, i
        assert r.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0])
        assert not (r.base_failed and r.kept)


def test_junk_goes_and_prose_stays(spark):
    good = [prose(150, s) for s in range(30)]
    junk = ["### ".join(prose(150, 90).split()) + "***", " | ".join(f"q{i}" for i in range(200)), "1234 5678 " * 2 + " ".join(str(i * 7919) for i in range(150))]
    df = docs(spark, [*good, *junk, None, (None, good[0])])
    out = keep_good(df)
    assert out.columns == df.columns
    ids = sorted(-1 if r.doc_id is None else r.doc_id for r in out.collect())
    assert ids == [-1, *range(30)]
    assert keep_good(df.limit(0)).count() == 0


def test_boilerplate_lines_go(spark):
    rows = [(i, f"All rights reserved\nbody {i}\n\n  tail {i % 50}\nAll rights reserved") for i in range(60)] + [(100, None), (101, ""), (102, "\n"), (None, "All rights reserved")]
    df = docs(spark, rows)
    out, removed = drop_boilerplate(df, host="key", ratio=0.2, least=5)
    got = {r.doc_id: r for r in out.collect()}
    assert all(got[i].text == f"body {i}\n\n  tail {i % 50}" and got[i][removed] == 2 for i in range(60))
    assert got[100].text is None and got[101].text == "" and got[102].text == "\n" and got[None].text == ""
    clean = without_boilerplate(df)
    assert clean.columns == df.columns and clean.count() == df.count()
    assert {r.n_chars == len(r.text) for r in clean.collect() if r.text is not None} == {True}
    assert without_boilerplate(df.limit(0)).count() == 0


def test_share_is_by_host(spark):
    rows = [(i, "same line\nother " + str(i)) for i in range(12)] + [(i, "page " + str(i)) for i in range(12, 90)]
    df = spark.createDataFrame([(i, t, "a" if i < 12 or i % 3 == 0 else "b") for i, t in rows], "doc_id long, text string, host string")
    kept, removed = drop_boilerplate(df, host="host", ratio=0.5, least=5)
    assert kept.where(f"{removed} > 0").count() == 0
    kept, removed = drop_boilerplate(df, host="host", ratio=0.3, least=5)
    assert kept.where(f"{removed} > 0").count() == 12


def distance(p, q):
    bits = lambda x, y: sum(a * math.log2(a / b) for a, b in zip(x, y, strict=True) if a > 0)
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    return math.sqrt(max(0.0, (bits(p, m) + bits(q, m)) / 2))


def test_distances_and_verdicts_as_brute_force(spark):
    """Histograms, references by language and Jensen-Shannon distances, written out."""
    texts = [prose(160, s) for s in range(8)] + ["### ".join(prose(150, 90).split()) + "***", "1234 5678 " * 2 + " ".join(str(i * 7919) for i in range(150)), "short but fine " + prose(12, 3), prose(130, 41).upper(), None, ""]
    rows = [(i, t, "en" if i % 2 else None, "s", 1, "k", 1) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in judge(spark.createDataFrame(rows, DOCS), ["doc_id"]).collect()}
    patterns = ["[a-z]", r"[\x20\x09-\x0D]", r"[#*$%&|<>]", "[A-Z]", r"[.,;:!?'\"()-]", "[0-9]"]
    chars = lambda t: (c := [len(re.findall(p, t)) for p in patterns]) + [len(t) - sum(c)]

    def common(t):
        w = [x.lower() for x in WORD.findall(t)]
        c = [w.count(x) for x in WORDS]
        return [*c, len(w) - sum(c)]

    share = lambda c: [x / max(sum(c), 1) for x in c]
    references = []
    for lang in (0, 1):
        own = [t or "" for i, t in enumerate(texts) if i % 2 == lang and not got[i].base_failed]
        references.append(tuple(share([sum(x) for x in zip(*map(f, own), strict=True)]) for f in (chars, common)))
    for i, t in enumerate(texts):
        r, n = got[i], len(WORD.findall(t or ""))
        if not n:
            assert not r.kept
            continue
        of_chars, of_words = (min(distance(share(f(t)), ref[k]) for ref in references) for k, f in enumerate((chars, common)))
        assert abs(r.class_distance - of_chars) < 1e-6 and abs(r.word_distance - of_words) < 1e-6, i
        fits = (r.word_chars < CLASS_CHARS or of_chars <= CLASS_DISTANCE) and (n < WORD_COUNT or of_words <= WORD_DISTANCE)
        assert r.kept == (fits and not r.base_failed)
    assert {got[i].kept for i in (8, 9)} == {False}
