"""The Jaccard join, components, repeats and decontamination against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from genolake.llm import jaccard_join
from genolake.llm.common import staged
from genolake.llm.components import components
from genolake.llm.decontamination import contained_items, without_leaks
from genolake.llm.hashing import shingle_set, word_hashes
from genolake.llm.jaccard_join import jaccard_components, without_near_copies
from genolake.llm.repeats import intervals, maximal_repeats, remove_repeats, repeat_groups

from .fixtures import ODD, docs, prose, shingles


def linked(texts, k, percent):
    sets = [shingles(t, k) for t in texts]
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def near(base, edits, seed):
    import random

    r, w = random.Random(seed), base.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_components_as_brute_force(spark, k, percent):
    base = [prose(120, s) for s in range(4)]
    texts = [*ODD, *base, *(near(b, e, 7 * e + i) for i, b in enumerate(base) for e in (1, 2, 3, 4, 6, 9, 14)), base[0].upper(), "a b", "A  B", "a b c d e f", "a b c d e g"]
    want, sizes = linked(texts, k, percent)
    got = {r.doc_id: r for r in jaccard_components(docs(spark, texts), k, percent).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == sizes


def test_large_regions_are_dealt_as_blocks(spark):
    base = prose(80, 1)
    texts = [near(base, 1 + i % 6, i) for i in range(60)]
    want, _ = linked(texts, 3, 90)
    got = jaccard_components(docs(spark, texts), 3, 90, region_shingles=500).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(want))


@pytest.mark.parametrize(("edits", "percent"), [((0, 1, 2, 3, 5, 7, 9), 80), ((1, 2, 3, 4, 6), 90)])
def test_heavy_regions_by_their_closed_parts(spark, edits, percent):
    """Groups of cells and regions beyond a task, with a dense family, members at its rim, chains that leave it and other families."""
    base = [prose(100, s) for s in range(3)]
    texts = [near(base[0], edits[i % len(edits)], i) for i in range(150)] + [near(b, 1 + i % 3, 500 + i) for b in base[1:] for i in range(12)]
    for i in range(8):  # each text a few words from the one before
        texts.append(near(texts[-1] if i else texts[5], 2, 900 + i))
    want, _ = linked(texts, 3, percent)
    got = jaccard_components(docs(spark, texts), 3, percent, region_shingles=900, cell_members=16).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(want))


def test_closed_parts_leave_few_pairs(spark):
    """All members in connected balls are closed, and what is dealt grows with the members outside."""
    rows = [(7, i, 10) for i in range(400)]
    members = staged(spark.createDataFrame(rows, "region long, node long, n long"), "members")
    balls = lambda m, p: m.join(p.select("region", F.col("node").alias("pivot")), "region").where(
        (F.col("node") == F.col("pivot")) | ((F.col("node") < 380) & (F.col("pivot") < 380) & (F.abs(F.col("node") - F.col("pivot")) < 300)))
    closed, links = jaccard_join._closed(members, balls)
    assert sorted(r.node for r in closed.collect()) == list(range(380)) and links.where("a >= 380 or b >= 380").count() == 0
    heavy = jaccard_join._heavy(members, "n", 1000, "heavy")
    dealt = jaccard_join._deal(members, "n", 1000, heavy, closed).collect()
    assert len(dealt) <= 380 + 20 * 10
    shut = {r.node for r in closed.collect()}
    at = {}
    for r in dealt:
        at.setdefault((r.x, r.y), set()).add(r.node)
    together = {(a, b) for group in at.values() for a in group if a >= 380 for b in group}
    assert together >= {(a, b) for a in range(380, 400) for b in range(400) if a != b} and shut == {r.node for r in dealt if r.closed}


def same_parts(got, up):
    return len({(a, b) for a, b in zip(got, up, strict=True)}) == len(set(got)) == len(set(up))


def test_region_join_is_exact_for_pivots():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, 40)).astype(np.uint64) for _ in range(150)]
    region = jaccard_join._Region(sets, 60)
    got = region.roots()
    up = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 60 * (len(sets[i]) + len(sets[j]) - both):
                a, b = up[i], up[j]
                up = [min(a, b) if x in (a, b) else x for x in up]
    assert same_parts(got, up)


def test_regions_are_parted_and_joined_again():
    """Families of near copies around distant texts: pivots part them, windows keep what lies at borders, and the recursion ends right."""
    texts = [near(prose(150, 10 + f), e, 1000 * f + i) for f in range(12) for i, e in enumerate((0, 1, 2, 3, 5, 8, 12, 18, 26, 40))]
    sets = [shingle_set(word_hashes(np.frombuffer(t.encode(), np.uint8)), 3) for t in texts]
    for percent in (50, 80, 90):
        region = jaccard_join._Region(sets, percent)
        region.voronoi(np.arange(len(sets)))
        assert percent == 50 or region.depth > 2 and region.regions > 10  # at 50 % all windows reach all texts
        assert same_parts([region.forest.find(i) for i in range(len(sets))], linked(texts, 3, percent)[0])


def test_regions_of_the_documents(spark):
    """All documents as one region: the pivots' regions carry the join, and links are those of brute force over shared shingles."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    sets = [shingle_set(word_hashes(np.frombuffer((t or "").encode(), np.uint8)), 5) for t in texts]
    sets = [s for s in sets if len(s)]
    region = jaccard_join._Region(sets, 80)
    got, holders = region.roots(), {}
    for i, s in enumerate(sets):
        for x in s.tolist():
            holders.setdefault(x, []).append(i)
    pairs = Counter((i, j) for h in holders.values() if len(h) > 1 for n, j in enumerate(h) for i in h[:n])
    up = list(range(len(sets)))
    for (i, j), both in pairs.items():
        if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both) and up[i] != up[j]:
            a, b = up[i], up[j]
            up = [min(a, b) if x in (a, b) else x for x in up]
    assert same_parts(got, up) and region.regions > 20


def test_components_of_edges(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 100), (7, 200), (300, 301), (301, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys([*range(41), 200], 0), 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies_leave_one_of_each(spark):
    base = prose(60, 5)
    df = docs(spark, [(5, base), (3, near(base, 1, 1)), (9, base), (9, base), (4, None), (4, ""), (None, "lone words here"), (7, prose(60, 6)), (7, prose(60, 6))])
    out = without_near_copies(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in out.collect()) == [-1, 3, 4, 4, 7]
    assert without_near_copies(df.limit(0)).count() == 0


def test_near_copies_of_nameless_and_repeated_rows(spark):
    a, b, c = prose(60, 5), prose(60, 6), prose(60, 7)
    got = jaccard_components(docs(spark, [(None, a), (2, near(a, 1, 1)), (None, b), (None, near(b, 1, 2)), (9, c)])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, -1), (-1, 2), (2, 2), (9, 9)]
    df = docs(spark, [(3, near(a, 1, 1)), (5, a), (5, b), (6, near(b, 1, 2)), (5, c)])
    assert sorted((r.doc_id, r.text) for r in without_near_copies(df).collect()) == sorted([(3, near(a, 1, 1)), (5, b), (5, c)])


def test_a_chain_through_a_nameless_row(spark):
    """A links with B and B with C, but A not with C; B has no doc_id."""
    words = [f"w{i}" for i in range(100)]
    chain = [" ".join(words[i : i + 94]) for i in (0, 3, 6)]
    for middle, want in ((None, {1: 1, 3: 1, None: 1}), (2, {1: 1, 2: 1, 3: 1})):
        got = jaccard_components(docs(spark, [(1, chain[0]), (middle, chain[1]), (3, chain[2]), (9, "else")]), 3, 90).collect()
        assert {r.doc_id: r.component_id for r in got} == want | {9: 9}


def test_hot_cells_and_copies(spark):
    """Cells that a sample shows as hot are dealt in parts; copies of one text, and rows that equal each other, are one node."""
    base = prose(120, 4)
    texts = [near(base, 1 + i % 3, i) for i in range(120)] + [base] * 40 + [prose(60, 900 + i) for i in range(20)] + [None, ""] * 5
    rows = [*enumerate(texts), (0, texts[0]), (0, texts[0])]
    old = jaccard_join.HOT_ONE_IN, jaccard_join.HOT_SEEN
    try:
        jaccard_join.HOT_ONE_IN, jaccard_join.HOT_SEEN = 1, 3
        got = jaccard_components(docs(spark, rows), 3, 80).collect()
    finally:
        jaccard_join.HOT_ONE_IN, jaccard_join.HOT_SEEN = old
    want, _ = linked(texts, 3, 80)
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted([*enumerate(want), (0, 0), (0, 0)])


def test_long_texts_over_segments(spark):
    """Texts longer than the segments in which words are hashed."""
    long = prose(120_000, 31)
    texts = [long, near(long, 2000, 1), near(long, 30_000, 2), long + " end"]
    want, sizes = linked(texts, 3, 90)
    got = {r.doc_id: r for r in jaccard_components(docs(spark, texts), 3, 90).collect()}
    assert len(long) > 1 << 19 and [got[i].component_id for i in range(4)] == want and [got[i].n_shingles for i in range(4)] == sizes


def repeats_by_force(texts, n):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + n] for b in raw for i in range(len(b) - n + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("group", [2000, 2])
def test_repeats_as_brute_force(spark, group):
    passage, other = prose(30, 1), prose(25, 2)
    texts = [*ODD, *(prose(20, 50 + i) + passage[i : 150 + i] + prose(15, 80 + i) for i in range(8)), passage, other + other, "ab" * 200, prose(90, 3), prose(90, 3), "é" * 90, "xé" + "é" * 70]
    texts += [passage[-70 - i :] + prose(6, 200 + i) for i in range(12)]
    got = {r.doc_id: r for r in remove_repeats(docs(spark, texts), 60, group).collect()}
    want = repeats_by_force(texts, 60)
    for i, (n, gone, spans, digest) in enumerate(want):
        r = got[i]
        assert (r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest()) == (n, gone, spans, digest), i


def test_repeats_over_block_borders(spark):
    """Texts longer than the blocks in which windows are hashed, with repeats on both sides of a border."""
    rng = np.random.default_rng(8)
    long = rng.integers(97, 123, 1_200_000).astype(np.uint8)
    copied = [(524_288 - 500, 900), (1_048_576 - 390, 410), (100, 399)]
    texts = [long.tobytes().decode(), *(long[a : a + n].tobytes().decode() + "#" * 50 for a, n in copied)]
    got = {r.doc_id: [(s.start, s.stop) for s in r.spans] for r in remove_repeats(docs(spark, texts), 400).collect()}
    assert got == {0: [(a, a + n) for a, n in copied[:2]], 1: [(0, 900)], 2: [(0, 410)], 3: []}


@pytest.mark.parametrize("group", [2000, 2])
def test_groups_hold_all_occurrences(spark, group):
    """Every maximal repeat's rows are all places where its bytes stand; they cover what is removed."""
    passage = prose(40, 1)
    texts = [*(prose(20, 50 + i) + passage[3 * i : 100 + 5 * i] + prose(15, 80 + i) for i in range(8)), passage, "ab" * 60, prose(30, 3), prose(30, 3), None, ""]
    rows = repeat_groups(docs(spark, texts), 60, group).collect()
    raw = [(t or "").encode() for t in texts]
    cover = [np.zeros(len(b), bool) for b in raw]
    found = {}
    for r in rows:
        assert r.n_bytes >= 60
        found.setdefault(r.repeat, []).append((r.doc_id, r.start, raw[r.doc_id][r.start : r.start + r.n_bytes], r.n_occurrences))
        cover[r.doc_id][r.start : r.start + r.n_bytes] = True
    for places in found.values():
        data = {p[2] for p in places}
        assert len(data) == 1 and {p[3] for p in places} == {len(places)} and len({p[:2] for p in places}) == len(places) > 1
        data = data.pop()
        everywhere = {(i, a) for i, b in enumerate(raw) for a in range(len(b)) if b.startswith(data, a)}
        if group == 2000:
            assert {p[:2] for p in places} <= everywhere
    assert [int(c.sum()) for c in cover] == [g for _, g, _, _ in repeats_by_force(texts, 60)]


def test_maximal_repeats_by_hand():
    # the anchor is at byte 3; all share "aXX", three of them "baXX", two "aXXc"
    contexts, left = [b"zbaXXc", b"ybaXXd", b"xbaXXc", b"qwaXXe"], [3, 3, 3, 3]
    got = {(b, a, tuple(sorted(m))) for b, a, m in maximal_repeats(contexts, left, 3)}
    assert got == {(1, 2, (0, 1, 2, 3)), (2, 2, (0, 1, 2)), (2, 3, (0, 2))}


def test_repeats_of_repeated_rows(spark):
    text = prose(40, 9)
    got = remove_repeats(docs(spark, [(1, text), (1, text), (None, "z" + text), (2, "short")]), 60).collect()
    assert sorted((r.n_bytes, len(r.kept)) for r in got) == [(5, 5), (len(text), 0), (len(text), 0), (len(text) + 1, 1)]
    assert remove_repeats(docs(spark, []), 60).count() == 0


def test_intervals_of_a_known_array():
    # banana: suffixes a, ana, anana, banana, na, nana; common prefixes 1, 3, 0, 0, 2
    assert sorted(intervals([0, 1, 3, 0, 0, 2], 1)) == [(1, 0, 2), (2, 4, 5), (3, 1, 2)]


def test_contained_items_as_brute_force(spark):
    items = [(1, prose(30, 1)), (2, prose(14, 2)), (3, "three little words"), (4, ""), (5, None), (6, prose(30, 3)), (6, prose(30, 4))]
    texts = [*ODD, prose(100, 8) + " " + items[0][1].upper() + " " + prose(300, 9), " ".join(items[0][1].split()[:26]), " ".join(items[0][1].split()[:20]), "x, three -- little\nwords; y", items[1][1].replace(" ", ", "), items[6][1], items[5][1] + " " + items[6][1]]
    import re

    def sets(text, k):
        w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}, len(w)

    want = {}
    for i, t in enumerate(texts):
        for item, s in items:
            n = sets(s, 5)[1]
            if n:
                own = sets(s, min(5, n))[0]
                both = len(own & sets(t, min(5, n))[0])
                if 100 * both >= 80 * len(own):
                    want[i, item] = max(want.get((i, item), 0), both / len(own))
    table = spark.createDataFrame(items, "item_id long, text string")
    got = contained_items(docs(spark, texts), table).collect()
    assert {(r.doc_id, r.item_id): r.n_shared / r.n_item for r in got} == want
    kept = without_leaks(docs(spark, texts), table)
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {i for i, _ in want}
    assert contained_items(docs(spark, []), table).count() == contained_items(docs(spark, texts), table.limit(0)).count() == 0
