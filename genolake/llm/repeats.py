"""Removal of byte strings that occur more than once, by a sparse enhanced suffix array.

A suffix array over every byte of a corpus would ship each suffix with its context. Here the suffixes are sampled by
their content: in each window of `length` bytes the least-hashed 32-byte gram (the rightmost of equals) is the window's
anchor, so equal windows have equal anchors at equal offsets, wherever they lie. An occurrence of an anchor owns the
windows that chose it, and its context is the bytes these cover. Two occurrences share a window exactly if their left
and right common extensions from the anchor add up to `length` or more.

Occurrences are grouped by the anchor's gram; grams that occur once are out. Equal contexts are one leaf with a count. The
different contexts of a group are sorted as suffixes from the anchor; the common prefixes of neighbours give the interval
tree, scanned with a stack. In each interval (all occurrences of one right extension) the left extensions are sorted and
scanned alike: an interval of these that spans several right extensions is a maximal repeat, and its members are all of
the repeat's occurrences.

A group with more contexts than a task should hold is split by extension: each context is cut into pieces of a few
windows, pieces go by the bytes that all windows of such a piece have in common, equal ones are one leaf again, and the
tree is built in each of the new groups. Pieces of a single window are equal or have nothing in common, so the
second split is the last."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_small, ship, staged, text_column
from .hashing import BYTE, mix, prefix_sums, stretches

GRAM = 32
#: Different contexts of one group that one task sorts (some 600 bytes each).
GROUP = 2000
#: Windows of a piece of a larger group, at the first split and at the second.
WIDTHS = (16, 1)
#: Windows taken at a time; a position within must fit in 20 bits.
BLOCK = 1 << 19
_LOW = np.uint64((1 << 20) - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def anchors(text: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays (gram hash, anchor, windows before the anchor's own start, own windows less one, context hash) for the windows of a
    text, block by block."""
    windows = len(text) - length + 1
    span = length - GRAM + 1  # grams in a window
    for at in range(0, windows, BLOCK):
        n = min(BLOCK, windows - at)
        part = text[at : at + n + length - 1]
        sums = prefix_sums(BYTE[part])
        starts = np.arange(len(part) - GRAM + 1)
        gram = stretches(sums, starts, starts + GRAM)
        least = (gram & ~_LOW) | (_LOW - starts.astype(np.uint64))  # of equal hashes the rightmost is least
        width = 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: -(span - width)], least[span - width :])
        anchor = (_LOW - (least & _LOW)).astype(np.int64)
        edge = np.flatnonzero(np.diff(anchor)) + 1
        first, last = np.concatenate([[0], edge]), np.concatenate([edge, [n]]) - 1
        anchor = anchor[first]
        context = mix(stretches(sums, first, last + length) + (anchor - first).astype(np.uint64) * _ODD)
        yield gram[anchor], anchor + at, (anchor - first).astype(np.int32), (last - first).astype(np.int32), context


_PLACE = ["doc_id", "text_id", "anchor", "back", "own"]


def _sample(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts, ends = text_column(batch.column("text"))
            long = np.flatnonzero(ends - starts >= length)
            rows, parts = [], []
            for i in long.tolist():
                for found in anchors(data[starts[i] : ends[i]], length):
                    rows.append(np.full(len(found[0]), i))
                    parts.append(found)
            if not rows:
                continue
            rows = pa.array(np.concatenate(rows))
            gram, anchor, back, own, context = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(rows), batch.column("text_id").take(rows), pa.array(anchor), pa.array(back), pa.array(own), pa.array(gram.view(np.int64)), pa.array(context.view(np.int64))],
                [*_PLACE, "gram", "context"],
            )

    return run


_PIECE = "key long, sub long, left int, bytes binary"


def _cut(length: int):
    """Cuts the contexts out of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts, _ = text_column(batch.column("text"))
            out: list[list] = [[], [], [], []]
            for i, found in enumerate(batch.column("wanted").to_pylist()):
                for x in found:
                    a = starts[i] + x["anchor"] - x["back"]
                    for col, v in zip(out, (x["gram"], x["context"], x["back"], data[a : a + x["own"] + length].tobytes()), strict=True):
                        col.append(v)
            yield _pieces(*out)

    return run


def _pieces(key: list, sub: list, left: list, data: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(sub, pa.int64()), pa.array(left, pa.int32()), pa.array(data, pa.binary())], ["key", "sub", "left", "bytes"])


def _split(length: int, width: int):
    """Cuts a piece into pieces of the windows that start width * r to width * (r + 1) - 1 bytes before the anchor, for each r. Their key
    is the bytes that all of these windows have in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            up_key, up_sub, key, sub, left, cut = [], [], [], [], [], []
            for k, s, back, data in zip(*(batch.column(c).to_pylist() for c in ("key", "sub", "left", "bytes")), strict=True):
                sums, least = prefix_sums(BYTE[np.frombuffer(data, np.uint8)]), back - (len(data) - length)
                r = np.arange(least // width, back // width + 1)
                high, low = np.minimum(back, width * r + width - 1), np.maximum(least, width * r)
                core = stretches(sums, back - width * r, back - width * (r + 1) + 1 + length)
                own = stretches(sums, back - high, back - low + length)
                up_key += [k] * len(r)
                up_sub += [s] * len(r)
                key += mix(core + r.astype(np.uint64) * _ODD + np.uint64(k % (1 << 64))).view(np.int64).tolist()
                sub += mix(own + high.astype(np.uint64) * _ODD).view(np.int64).tolist()
                left += high.tolist()
                cut += [data[back - h : back - w + length] for h, w in zip(high.tolist(), low.tolist(), strict=True)]
            rest = _pieces(key, sub, left, cut)
            yield pa.RecordBatch.from_arrays([pa.array(up_key, pa.int64()), pa.array(up_sub, pa.int64()), *rest.columns], ["up_key", "up_sub", *rest.schema.names])

    return run


def _common(x: bytes, y: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    low = 0
    while n - low > 1:  # x[:low] == y[:low], and x[:n] != y[:n]
        half = (low + n) // 2
        if x[low:half] == y[low:half]:
            low = half
        else:
            n = half
    return low


def intervals(common: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """The common-prefix intervals of a sorted suffix list: (depth, first, last), for depths of at least `least`.
    common[i]: common prefix of suffixes i - 1 and i; common[0] is ignored."""
    stack = [(0, 0)]  # depth, first
    for i in range(1, len(common) + 1):
        depth, first = common[i] if i < len(common) else -1, i - 1
        while stack and stack[-1][0] > depth:
            top, first = stack.pop()
            if top >= least:
                yield top, first, i - 1
        if not stack or stack[-1][0] < depth:
            stack.append((depth, first))


def maximal_repeats(contexts: list[bytes], left: list[int], length: int) -> Iterator[tuple[int, int, list[int]]]:
    """(bytes before the anchor, bytes from it on, members) of each maximal repeat of `length` bytes or more among different contexts
    of the same anchor: no byte can be added on either side that all members share. Members are all its occurrences."""
    rights = [c[k:] for c, k in zip(contexts, left, strict=True)]
    lefts = [c[:k][::-1] for c, k in zip(contexts, left, strict=True)]
    if len(contexts) == 2:
        before, after = _common(*lefts), _common(*rights)
        if before + after >= length:
            yield before, after, [0, 1]
        return
    order = sorted(range(len(contexts)), key=rights.__getitem__)
    common = [0] + [_common(rights[a], rights[b]) for a, b in zip(order, order[1:], strict=False)]
    place = {i: r for r, i in enumerate(order)}
    rank = {i: r for r, i in enumerate(sorted(range(len(contexts)), key=lefts.__getitem__))}
    for after, first, last in intervals(common, max(1, length - max(left))):
        members = sorted(order[first : last + 1], key=rank.__getitem__)
        shared = [0] + [_common(lefts[x], lefts[y]) for x, y in zip(members, members[1:], strict=False)]
        if length - after <= 0 and len(members) > 1 and min(shared[1:]) == 0:
            yield 0, after, members  # left extensions differ in the first byte already
        for before, a, b in intervals(shared, max(1, length - after)):
            own = members[a : b + 1]
            places = [place[i] for i in own]
            if len(own) == len(members) or min(common[min(places) + 1 : max(places) + 1]) == after:  # else a deeper interval holds them all
                yield before, after, own


def _compare(length: int, every: bool):
    """(key, sub, repeat, before, after): of each piece the farthest reach of repeats before and after the anchor, or, with `every`, a row
    for each maximal repeat that it is in."""

    def settle(key: int, group: dict[int, tuple[int, bytes]]) -> list[tuple]:
        if len(group) < 2:
            return []
        names, reach, out = list(group), {}, []
        for before, after, members in maximal_repeats([group[c][1] for c in names], [group[c][0] for c in names], length):
            if every:
                k, data = group[names[members[0]]]
                repeat = _hash(data[k - before : k + after], before)
                out += [(key, names[i], repeat, before, after) for i in members]
            for i in members:
                a, b = reach.get(i, (0, 0))
                reach[i] = (max(a, before), max(b, after))
        return out if every else [(key, names[i], None, a, b) for i, (a, b) in reach.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, {}
        for batch in batches:
            out: list[tuple] = []
            for key, sub, left, data in zip(*(batch.column(c).to_pylist() for c in ("key", "sub", "left", "bytes")), strict=True):
                if key != now:
                    out += settle(now, group)
                    now, group = key, {}
                group[sub] = (left, data)
            yield _reaches(out)
        yield _reaches(settle(now, group))

    return run


_REACH = "key long, sub long, repeat long, before int, after int"


def _reaches(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 5
    kinds = [pa.int64()] * 3 + [pa.int32()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["key", "sub", "repeat", "before", "after"])


def _hash(data: bytes, before: int) -> int:
    """As the hash of a context with these bytes."""
    n = np.array([len(data)])
    return int(mix(stretches(prefix_sums(BYTE[np.frombuffer(data, np.uint8)]), n * 0, n) + np.uint64(before) * _ODD).view(np.int64)[0])


def _settled(pieces: DataFrame, length: int, group: int, every: bool, used: list[DataFrame], widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """The repeats of pieces (staged: key, sub, left, bytes; sub is what tells different bytes apart), larger groups split. used: gets
    the staged tables that the result reads."""
    hot = staged(pieces.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > group).select("key"), "hot")
    usual = join_small(pieces, hot, ["key"], "left_anti").repartition("key").sortWithinPartitions("key")
    found = usual.mapInArrow(_compare(length, every), _REACH)
    if not widths or not hot.limit(1).count():
        return found
    used.append(hot)
    own = staged(join_small(pieces, hot, ["key"], "left_semi").mapInArrow(_split(length, widths[0]), f"up_key long, up_sub long, {_PIECE}"), "pieces")
    leaves = staged(own.groupBy("key", "sub").agg(F.count("*").alias("n"), F.first("left").alias("left"), F.first("bytes").alias("bytes")), "leaves")
    copied = leaves.where("n > 1").select("key", "sub", F.when(F.lit(every), F.col("sub")).alias("repeat"), F.col("left").alias("before"), (F.octet_length("bytes") - F.col("left")).alias("after"))
    used += [own, leaves]
    below = _settled(leaves.drop("n"), length, group, every, used, widths[1:]).union(copied)
    keys = ["up_key", "up_sub"] + ["repeat"] * every
    of = own.select("up_key", "up_sub", "key", "sub").join(below, ["key", "sub"]).groupBy(*keys).agg(F.max("before").alias("before"), F.max("after").alias("after"))
    of = of.select(F.col("up_key").alias("key"), F.col("up_sub").alias("sub"), "repeat" if every else F.lit(None).cast("long").alias("repeat"), "before", "after")
    return found.union(of)


def _occurrences(rows: DataFrame, length: int, group: int, every: bool) -> tuple[DataFrame, list[DataFrame]]:
    """(doc_id, text_id, repeat, start, stop) of the stretches of rows (doc_id, text_id, text) that repeats cover, each by its anchor,
    and the staged tables that it reads."""
    kind = dict(rows.dtypes)["doc_id"]
    sampled = staged(rows.mapInArrow(_sample(length), f"doc_id {kind}, text_id long, anchor long, back int, own int, gram long, context long"), "anchors")
    grams = sampled.groupBy("gram").agg(F.count("*").alias("n"), (F.min("context") != F.max("context")).alias("several")).where("n > 1").drop("n")
    grams = staged(grams, "grams")
    again = staged(join_small(sampled, grams, ["gram"], "inner"), "again")
    repeated = sampled.where("anchor = back").groupBy("doc_id", "text_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() > 0  # rows that equal each other
    discard(sampled, grams)
    contexts = again.groupBy("gram", "context").agg(F.count("*").alias("n"), F.first("several").alias("several"), F.min(F.struct(*_PLACE)).alias("one"))
    contexts = staged(contexts, "contexts")
    wanted = contexts.where("several").groupBy(F.col("one.doc_id").alias("doc_id"), F.col("one.text_id").alias("text_id"))
    wanted = staged(wanted.agg(F.collect_list(F.struct("gram", "context", "one.anchor", "one.back", "one.own")).alias("wanted")), "wanted")
    once = rows.dropDuplicates(["doc_id", "text_id"]) if repeated else rows
    cut = staged(_with_null_ids(once, wanted, "inner").select("text", "wanted").mapInArrow(_cut(length), _PIECE), "cut")
    discard(wanted)
    used: list[DataFrame] = []
    found = _settled(cut, length, group, every, used).withColumnsRenamed({"key": "gram", "sub": "context"})
    copied = contexts.where("n > 1").select("gram", "context", F.when(F.lit(every), F.col("context")).alias("repeat"), F.col("one.back").alias("before"), (F.col("one.own") + length - F.col("one.back")).alias("after"))
    covered = found.union(copied).groupBy("gram", "context", "repeat").agg(F.max("before").alias("before"), F.max("after").alias("after"))
    covered = staged(covered, "covered")
    discard(contexts, cut, *used)
    out = join_small(again, covered, ["gram", "context"], "inner")
    return out.select("doc_id", "text_id", "repeat", (F.col("anchor") - F.col("before")).alias("start"), (F.col("anchor") + F.col("after")).alias("stop")), [again, covered]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the stretches of each text: pairs of longs, start and stop."""
    for batch in batches:
        out = []
        for found in batch.column("covered").to_pylist():
            x = np.array(sorted((s["start"], s["stop"]) for s in found), np.int64).reshape(-1, 2)
            reach = np.maximum.accumulate(x[:, 1])
            first = np.concatenate([[True], x[1:, 0] > reach[:-1]])
            out.append(np.stack([x[first, 0], reach[np.append(first[1:], True)]], axis=1).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_id"), pa.array(out, pa.binary())], ["doc_id", "text_id", "merged"])


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts the merged stretches out of each text."""
    for batch in batches:
        data, starts, ends = text_column(batch.column("text"))
        sizes, spans, kept = [], [], []
        for a, b, merged in zip(starts.tolist(), ends.tolist(), batch.column("merged").to_pylist(), strict=True):
            text, cuts = data[a:b].tobytes(), np.frombuffer(merged or b"", np.int64).tolist()
            edges = [0, *cuts, len(text)]
            sizes.append(len(text))
            spans.append([{"start": x, "stop": y} for x, y in zip(cuts[::2], cuts[1::2], strict=True)])
            kept.append(b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.large_binary()).cast(pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def _rows(docs: DataFrame, length: int) -> DataFrame:
    if length <= GRAM:
        raise ValueError(f"length must exceed {GRAM} bytes")
    ship(docs.sparkSession)
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("text_id", F.xxhash64("text"))


def repeat_groups(docs: DataFrame, length: int = 400, group: int = GROUP) -> DataFrame:
    """Returns (repeat, n_bytes, n_occurrences, doc_id, start): a row for each occurrence of each maximal repeat of `length` bytes or
    more, in docs (doc_id, text; other columns are ignored). repeat: a hash of its bytes.

    A repeat is maximal within the contexts of its anchor (within their pieces, where a group was split), so that one much
    longer than `length` is a chain of overlapping repeats. Texts are bytes as in remove_repeats(); rows that equal each other each count as occurrences, under one doc_id. No
    repeat, an empty table, null and short texts give no rows."""
    found, used = _occurrences(_rows(docs, length), length, group, True)
    found = found.select(F.xxhash64("repeat", F.col("stop") - F.col("start")).alias("repeat"), (F.col("stop") - F.col("start")).alias("n_bytes"), "doc_id", "text_id", "start")
    found = staged(found, "occurrences")
    discard(*used)
    sizes = found.groupBy("repeat").agg(F.count("*").alias("n_occurrences")).where("n_occurrences > 1")
    return found.join(sizes, "repeat").select("repeat", "n_bytes", "n_occurrences", "doc_id", "start")


def remove_repeats(docs: DataFrame, length: int = 400, group: int = GROUP) -> DataFrame:
    """Returns (doc_id, n_bytes, spans array<struct<start, stop>>, kept binary), a row per row of docs (doc_id, text; other
    columns are ignored).

    A text is its UTF-8 bytes; matches never cross texts. spans: the maximal runs of bytes covered by a string of `length`
    bytes that also starts anywhere else in the input, the same text included. kept: the other bytes. Every occurrence of
    a repeated string goes, the first too; rows with equal doc_id and text are copies of each other. A null text is empty;
    an empty text or one shorter than length has no spans. An empty table gives no rows."""
    rows = _rows(docs, length)
    kind = dict(rows.dtypes)["doc_id"]
    stretch, used = _occurrences(rows, length, group, False)
    stretch = stretch.groupBy("doc_id", "text_id").agg(F.collect_set(F.struct("start", "stop")).alias("covered"))
    merged = staged(stretch.mapInArrow(_merge, f"doc_id {kind}, text_id long, merged binary"), "stretches")
    discard(*used)
    return _with_null_ids(rows, merged, "left").select("doc_id", "text", "merged").mapInArrow(_keep, f"doc_id {kind}, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary")


def _with_null_ids(rows: DataFrame, side: DataFrame, how: str) -> DataFrame:
    """Joins by doc_id and text_id; null ids are equal."""
    left = rows.withColumn("no_id", F.col("doc_id").isNull()).withColumn("key", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    right = side.select(F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), "text_id", *[c for c in side.columns if c not in ("doc_id", "text_id")])
    return join_small(left, right, ["no_id", "key", "text_id"], how)
