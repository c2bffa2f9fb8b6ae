"""The prefix trie against a brute-force trie, the given SQL, and odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from genolake.llm import queries
from genolake.llm.prefix_trie import ids_digest, ordered, prefix_trie, rebuilt, texts_of

SCHEMA = "conv_id long, turn long, role string, text string, depth long, extra string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuild(rows):
    """The rebuilt conversations, in plain Python."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def brute(convs):
    """Rows of the trie of {conv_id: turns}, by listing every beginning."""
    members = defaultdict(list)
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def under(node):
        yield node
        for x in children[node]:
            yield from under(x)

    rows = []
    for node, ids in members.items():
        below = list(under(node))
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        ends = ",".join(str(c) for c in ids if len(convs[c]) == len(node))
        rows.append((ids[0], len(node), members[node[:-1]][0] if node else None, len(ids), len(children[node]), sum(not children[x] for x in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return rows


def rows_of(df):
    return [tuple(r[c] for c in COLUMNS) for r in df.select(COLUMNS).collect()]


def order(rows):
    return sorted(rows, key=lambda r: tuple(-1 if x is None else x for x in r))


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA)


def test_against_sql(spark):
    con = duckdb.connect()
    con.execute("create view conversations as select * from '/root/testdata/sf0.001/conversations.parquet'")
    want = con.execute(queries.ORACLES["op11_conversation_prefix_trie"])
    names = [c[0] for c in want.description]
    want = [tuple(dict(zip(names, r, strict=True))[c] for c in COLUMNS) for r in want.fetchall()]
    got = rows_of(queries.QUERIES["op11_conversation_prefix_trie"](spark, "/root/testdata/sf0.001"))
    assert order(got) == order(want)


def test_random_families_with_every_block_size(spark):
    r = random.Random(5)
    rows = []
    for c in range(60):
        n = r.choice([1, 2, 3, 5, 9, 13])
        same = [("user" if i % 2 == 0 else "assistant", f"tü {i} {'x' * (i % 3)}") for i in range(n)]
        cut = r.randrange(n + 1)
        rows += [(c, i, *(same[i] if i < cut else (r.choice(["user", "assistant", None]), r.choice(["a", "b", None, "é" * 4])))) for i in range(n)]
    rows += [(c, i, "user", f"copy {i}") for c in range(200, 260) for i in range(7)]
    rows += [(900, t, role, "same place") for t in (None, None, 3, 3) for role in ("user", None)] + [(None, 1, "user", "no conversation")]
    turns = table(spark, rows)
    want = order(brute(rebuild(rows)))
    again, convs = rebuilt(turns)
    for block in (1, 2, 4, 50):
        assert order(rows_of(prefix_trie(again, convs, block))) == want


def test_round_trip_of_texts(spark):
    """Each conversation is found again by walking from the root along the nodes whose member it is."""
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    again, convs = rebuilt(turns)
    held = texts_of(prefix_trie(again, convs).withColumn("_at", F.lit(1)), again).collect()
    assert all(r["_at"] == 1 for r in held)
    children = defaultdict(dict)
    for r in held:
        if r.depth:
            children[r.parent_conv_id, r.depth - 1][r.role, r.text] = r.conv_id
    want = rebuild([(r.conv_id, r.turn, r.role, r.text) for r in turns.collect()])
    root = next(r for r in held if r.depth == 0)
    assert root.n_convs == len(want) and root.text is None
    for turns_of in want.values():
        at = root.conv_id
        for d, turn in enumerate(turns_of):
            at = children[at, d][turn]


def test_odd_tables(spark):
    none = table(spark, [])
    assert prefix_trie(*rebuilt(none)).count() == 0
    # conversation 3 has one turn, and 0 doesn't exist: with h > 0 it is turnless and ends at the root
    lone = [(3, None, None, None)]
    assert zlib.crc32(b"3") % 9 > 0
    assert order(rows_of(prefix_trie(*rebuilt(table(spark, lone))))) == order(brute(rebuild(lone)))
    long = [(c, i, "user", "y" * 200_000 if i == 2 else str(i)) for c in (5, 6) for i in range(40)]
    assert order(rows_of(prefix_trie(*rebuilt(table(spark, long))))) == order(brute(rebuild(long)))
    assert [r.pos for r in ordered(table(spark, [(1, 2, "a", "x"), (1, 2, "a", "x"), (1, None, "b", None)])).orderBy("pos").collect()] == [0, 1, 2]


def test_lists_of_ids_by_ranges(spark):

    ends = spark.range(0, 5000, 3).select(F.col("id").alias("conv_id"), F.struct((F.col("id") % 2).alias("depth"), F.lit(1).cast("long").alias("a"), F.lit(2).cast("long").alias("b")).alias("end"))
    got = {r.end.depth: r for r in ids_digest(ends, 16).collect()}
    for d in (0, 1):
        ids = [i for i in range(0, 5000, 3) if i % 2 == d]
        assert got[d].n_ends == len(ids) and got[d].ends_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
