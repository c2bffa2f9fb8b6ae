"""The trie of conversations' common beginnings, by hashing blocks of turns.

A digest of a beginning is the XOR of its turns' position-salted hashes (128 bits), so beginnings need no walk: digests of whole blocks come
first, and conversations are grouped by them. Where all conversations that go on from one beginning share the next block, its turns
are one chain and stay one unit. Only where siblings diverge inside a block are its turn boundaries refined.
Sums over a subtree need no walk either. The conversation of least id of a node represents it, so a conversation owns the end of its
path, from where no smaller one shares it; what a subtree holds is what its members own."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scan import running
from .common import discard, fresh, join_hot, ship, staged

#: Turns in a block.
BLOCK = 4
#: Width of the ranges of ids whose part of a list of ids is one row.
IDS = 1024


def ordered(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text) of turns (conv_id, turn, role, text): positions from 0 by turn, nulls first, then by role and text.
    Null roles and texts are empty. Rows without a conv_id belong to no conversation."""
    kept = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    return running(kept, ["conv_id"], "turn", {"pos": ("sum", F.lit(1).cast("long"))}, ties=["role", "text"], before=True).drop("turn")


def rebuilt(turns: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations c that begin with the first h turns of conversation c - c % group, h = crc32(c) % most, and go on with their own after the
    first h. Returns turns (conv_id, pos, role, text), and (conv_id) of all conversations, those without turns included; both staged."""
    own = staged(ordered(turns), "turns")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    convs = staged(own.groupBy("conv_id").agg(F.count("*").alias("n")), "conversations")
    donors = convs.select(F.col("conv_id").alias("donor"), F.col("n").alias("given"))
    of = convs.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % group).alias("donor"), h.alias("h"))
    of = staged(of.join(donors, "donor", "left").select("conv_id", "donor", "h", "n", F.least("h", F.coalesce("given", F.lit(0))).alias("given")), "donors")
    heads = own.where(F.col("pos") < most - 1).where(F.col("conv_id") % group == 0).withColumnRenamed("conv_id", "donor")
    first = of.where("given > 0").join(heads, "donor").where("pos < h").select("conv_id", "pos", "role", "text")
    rest = join_hot(own.where(F.col("pos") >= h), of, "conv_id", "n").select("conv_id", (F.col("pos") - F.col("h") + F.col("given")).alias("pos"), "role", "text")
    out = staged(first.union(rest), "rebuilt")
    discard(own, of)
    return out, convs


def _xor(a: str, b: str) -> Column:
    return F.col(a).bitwiseXOR(F.col(b))


def _key(depth: Column, a: Column, b: Column) -> Column:
    return F.struct(depth.cast("long").alias("depth"), a.alias("a"), b.alias("b"))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's id lists, joined by commas; rows come in order of (depth, a, b, range)."""
    now, digest = None, None
    row = lambda: pa.RecordBatch.from_pylist([dict(zip(("depth", "a", "b"), now, strict=True)) | {"ends_sha256": digest.hexdigest()}])
    for batch in batches:
        for *key, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "a", "b", "ids")), strict=True):
            if key != now:
                if now is not None:
                    yield row()
                now, digest = key, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
    if now is not None:
        yield row()


def ids_digest(ends: DataFrame, width: int = IDS) -> DataFrame:
    """(end, n_ends, ends_sha256) of (end, conv_id): how many conversations end at a node, and the digest of their ids in order. Lists are joined
    for ranges of ids first, so a node at which many end costs the task that digests it a row for each range."""
    parts = ends.groupBy("end", F.floor(F.col("conv_id") / width).alias("range")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))
    rows = parts.select("end.*", "range", "ids").repartition("depth", "a", "b").sortWithinPartitions("depth", "a", "b", "range")
    lists = rows.mapInArrow(_ends, "depth long, a long, b long, ends_sha256 string").select(_key(F.col("depth"), F.col("a"), F.col("b")).alias("end"), "ends_sha256")
    return ends.groupBy("end").agg(F.count("*").alias("n_ends")).join(lists, "end")


def prefix_trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Nodes of the trie: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one for each distinct sequence of first
    turns (role, text), the textless root at depth 0.

    turns: (conv_id, pos, role, text), staged, positions from 0 without gaps; convs: (conv_id, ...), all conversations once.
    conv_id: a node's least member, by which its turns are found (texts_of). saved_tokens: over the subtree, the bytes of
    each node's last text for each member but one. No conversation gives no node. Other columns are ignored."""
    ship(turns.sparkSession)
    salted = [F.xxhash64(F.lit(seed), "pos", "role", "text") for seed in (11, 29)]
    turn = turns.select("conv_id", "pos", F.floor(F.col("pos") / block).alias("block"), F.octet_length("text").cast("long").alias("bytes"), salted[0].alias("x"), salted[1].alias("y"))
    # digests and bytes up to each block, from the blocks before it
    blocks = turn.groupBy("conv_id", "block").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum("bytes").alias("bytes"), F.array_sort(F.collect_list(F.struct("pos", "bytes"))).alias("turns"))
    blocks = staged(blocks, "blocks")
    blocks_to = running(blocks, ["conv_id"], "block", {"a": ("xor", F.col("x")), "b": ("xor", F.col("y")), "upto": ("sum", F.col("bytes"))})
    first = F.col("block") * block
    blocks_to = blocks_to.select(
        "conv_id", "block", _key(first, _xor("a", "x"), _xor("b", "y")).alias("start"), _key(first + F.size("turns"), F.col("a"), F.col("b")).alias("end"), (F.col("upto") - F.col("bytes")).alias("past"), F.col("turns.bytes").alias("sizes"),
    )
    blocks_to = staged(blocks_to, "prefixes")
    discard(blocks)
    # a beginning from which blocks differ, or end at different turns, is refined turn by turn
    forks = staged(blocks_to.groupBy("start", "end").agg(F.count("*").alias("n")).groupBy("start").agg(F.count("*").alias("ways"), F.sum("n").alias("n")), "forks")
    dealt = join_hot(blocks_to, forks, "start", "n")
    whole = dealt.where("ways = 1").select("conv_id", F.col("start").alias("parent"), "end", "past", "sizes")
    split = dealt.where("ways > 1").select("conv_id", "block", "start", "past", "sizes")
    inside = split.join(turn.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("turns")), ["conv_id", "block"])
    steps = F.transform(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: F.struct(
        F.reduce(F.slice("turns", 1, i), F.col("start"), lambda k, t: _key(k["depth"] + 1, k["a"].bitwiseXOR(t["x"]), k["b"].bitwiseXOR(t["y"]))).alias("parent"),
        F.reduce(F.slice("turns", 1, i + 1), F.col("start"), lambda k, t: _key(k["depth"] + 1, k["a"].bitwiseXOR(t["x"]), k["b"].bitwiseXOR(t["y"]))).alias("end"),
        F.reduce(F.slice("sizes", 1, i), F.col("past"), lambda n, b: n + b).alias("past"),
        F.slice("sizes", i + 1, 1).alias("sizes"),
    ))
    member = staged(whole.union(inside.select("conv_id", F.inline(steps))), "members")
    ends = turn.groupBy("conv_id").agg(F.count("*").alias("n"), F.bit_xor("x").alias("a"), F.bit_xor("y").alias("b"), F.sum("bytes").alias("total"))
    ends = convs.select("conv_id").join(ends, "conv_id", "left").select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n", "a", "b", "total")])
    ends = staged(ends.select("conv_id", _key(F.col("n"), F.col("a"), F.col("b")).alias("end"), "total"), "ends")
    units = member.groupBy("parent", "end", "past", "sizes").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    zero = F.lit(0).cast("long")
    root = ends.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    root = root.select(F.lit(None).cast(units.schema["parent"].dataType).alias("parent"), _key(zero, zero, zero).alias("end"), zero.alias("past"), F.array(zero).alias("sizes"), "n_convs", "conv_id")
    units = staged(units.unionByName(root).join(ids_digest(ends), "end", "left").withColumn("n_ends", F.coalesce("n_ends", zero)), "units")
    # what each conversation owns, and whether the leaf it ends at is its own
    owned = units.groupBy("conv_id").agg(F.sum(F.aggregate("sizes", zero, lambda a, b: a + b)).alias("owned"), F.count("*").alias("units"), F.sum((F.col("n_ends") == F.col("n_convs")).cast("long")).alias("leaf"))
    rows = member.groupBy("conv_id").agg(F.count("*").alias("rows"))
    facts = staged(ends.join(owned, "conv_id", "left").join(rows, "conv_id", "left").select("conv_id", "total", *[F.coalesce(c, zero).alias(c) for c in ("owned", "units", "leaf", "rows")]), "facts")
    sums = [F.sum(c).alias(f"sum_{c}") for c in ("total", "owned", "leaf")]
    held = join_hot(member.select("conv_id", "end"), facts, "conv_id", "rows").groupBy("end").agg(*sums)
    held = held.unionByName(facts.agg(*sums).where("sum_total is not null").withColumn("end", _key(zero, zero, zero)))
    below = units.where("parent is not null").groupBy(F.col("parent").alias("end")).agg(F.count("*").alias("n_below"))
    sums_of = staged(units.join(held, "end").join(below, "end", "left").withColumn("n_below", F.coalesce("n_below", zero)), "sums")
    own = facts.select("conv_id", (F.col("owned") - F.col("total")).alias("beyond"), "units")
    summed = staged(join_hot(sums_of, own, "conv_id", "units").drop("units"), "owners")
    above = summed.where("n_below > 0").select(F.col("end").alias("parent"), F.col("conv_id").alias("parent_conv"), F.col("n_below").alias("siblings"))
    whole = staged(join_hot(summed, above, "parent", "siblings", "left"), "trie")
    discard(blocks_to, forks, member, ends, units, facts, sums_of, summed)
    last = F.size("sizes") - 1
    nodes = whole.select("*", F.posexplode("sizes").alias("i", "size"))
    before = F.col("past") + F.aggregate(F.slice("sizes", 1, F.col("i")), zero, lambda a, b: a + b)
    return nodes.select(
        "conv_id",
        (F.col("end.depth") - last + F.col("i")).alias("depth"),
        F.when(F.col("i") > 0, F.col("conv_id")).otherwise(F.col("parent_conv")).alias("parent_conv_id"),
        "n_convs",
        F.when(F.col("i") < last, 1).otherwise(F.col("n_below")).cast("long").alias("n_children"),
        F.col("sum_leaf").alias("n_leaves"),
        (F.col("sum_total") - F.col("n_convs") * before - F.col("sum_owned") + F.col("beyond") + before).alias("saved_tokens"),
        F.when(F.col("i") == last, F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256))).otherwise(F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )


def texts_of(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """nodes with role and text of the last turn, null at the root: the trie as a store in which each common beginning stands once."""
    at = fresh(nodes, "_at")
    last = turns.select("conv_id", (F.col("pos") + 1).alias(at), "role", "text")
    return nodes.withColumn(at, F.col("depth")).join(last, ["conv_id", at], "left").drop(at)
