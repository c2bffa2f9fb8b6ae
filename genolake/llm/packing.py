"""Packing of documents into token windows, neighbours by a sharded BM25 inverted index.

A document's whole windows are sequences by themselves. What is left of it (its rest) is packed with the rests of
lexically near documents. First each rest looks for its nearest one in the whole corpus, by postings of pairs of its
rarest ids (rare by the corpus's document frequencies). Rests from which nearest ones lead to the same pair stand together,
and such groups are range-sorted by the rarest ids of one member, so that a shard of the index holds documents that share
them, however many there are. Each shard has an inverted index of its own. A seed retrieves
unused neighbours by BM25 score (document frequencies are those of the whole corpus) and they fill its window greedily;
the one that doesn't fit is cut and opens the next window. So no window has padding; at the end of a partition the last,
open window is cut into sequences whose lengths are powers of two."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_small, ship, staged, text_column

#: Pieces without letters that a worker remembers, with their ids.
SIGNS = 100_000
#: Bytes of text that a worker splits at once.
TEXT_AT_ONCE = 24 << 20
#: Rests in a shard of the index; up to twice as many where rests that belong together would be parted.
SHARD = 1024
#: Ids of a rest by which it is compared with rests of other shards, its rarest ones; postings are by the pairs of the first RAREST.
KNOWN, RAREST = 8, 5
#: Rests of one posting list that are compared with each other; a longer list is dealt out to parts.
POSTINGS = 256
#: Doublings of the way from a rest over its nearest one, that one's nearest and so on; rests at the end of a longer way stand apart.
JUMPS = 3
#: Postings that a task compares at once.
POSTINGS_AT_ONCE = 100_000
K1, B = 1.2, 0.75


#: Texts of these code points only: composed Latin letters and printable ASCII, about which all parties agree.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\u00a1-\u00a9\u00ab-\u00b4\u00b6-\u00b9\u00bb-\u012f\u0131-\u024f]*").fullmatch


#: The tokenizer's own splitting rule.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall


def _letter_coder(path: str) -> Callable[[bytes], list[int]] | None:
    """A byte-pair coder for lower-case words of letters, from the tokenizer's vocabulary; None where the coding package no longer
    offers its coder of single pieces.

    The vocabulary marks a word's end by a suffix to its last symbol. Here the last byte is written as another one, which
    words of letters never hold: a letter in upper case, a byte from 128 to 191 less by 128. A piece's place in the
    vocabulary is both its id and its rank among the merges."""
    import tiktoken

    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
    ranks = {}
    for piece, rank in json.loads(Path(path).read_text())["model"]["vocab"].items():
        ends = piece.endswith("</w>")
        raw = bytes(byte[c] for c in (piece[:-4] if ends else piece))
        if raw and all(97 <= b <= 122 or b >= 128 for b in raw) and (not ends or raw[-1] < 192):
            ranks[raw[:-1] + bytes([_LAST[raw[-1]]]) if ends else raw] = rank
    coder = tiktoken.Encoding("letters", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    return getattr(getattr(coder, "_core_bpe", None), "encode_single_piece", None)


#: How a word's last byte is written.
_LAST = np.array([b - 32 if 97 <= b <= 122 else b - 128 if 128 <= b <= 191 else b for b in range(256)], np.uint8)


#: What often ends a word.
_STOPS = ".,"


class WordIds:
    """Ids of lower-case words without white space: those of the tokenizer, whose pieces never cross white space. It is asked itself
    for all pieces but words of letters."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path).encode
        self.letters = _letter_coder(path)
        self.signs: dict[str, list[int]] = {}

    def ids(self, text: str) -> list[int]:
        return self.encode(text, add_special_tokens=False).ids

    def pieces(self, pieces: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """The ids of each piece, as bytes."""
        alpha = pc.utf8_is_alpha(pieces).to_numpy(zero_copy_only=False)
        words, signs = pieces.filter(pa.array(alpha)), pieces.filter(pa.array(~alpha)).to_pylist()
        if len(self.signs) > SIGNS:
            self.signs.clear()
        self.signs.update((p, self.ids(p)) for p in signs if p not in self.signs)
        ids = []
        if self.letters is None:
            ids += [self.ids(p) for p in words.to_pylist()]
        elif len(words):
            data, starts, ends = text_column(words)
            data = data[starts[0] : ends[-1]].copy()
            data[ends - starts[0] - 1] = _LAST[data[ends - starts[0] - 1]]
            offsets = pa.py_buffer(np.append(starts, ends[-1]) - starts[0])
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, offsets, pa.py_buffer(data)])
            ids += [self.letters(x) for x in raw.to_numpy(zero_copy_only=False)]
        ids += [self.signs[p] for p in signs]
        edges = np.cumsum([0, *map(len, ids)]) * 4
        flat = np.fromiter(chain.from_iterable(ids), "<u4", edges[-1] // 4)
        sorted_ = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(pieces), [None, pa.py_buffer(edges), pa.py_buffer(flat)])
        return sorted_.take(pa.array(np.argsort(np.argsort(~alpha, kind="stable"))))  # words of letters stand first in it

    def words(self, words: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """The ids of each word, as bytes. Each piece that they hold is coded once."""
        if not len(words):
            return words.cast(pa.large_binary())
        base = pc.ascii_rtrim(words, _STOPS)
        stops = pc.subtract(pc.binary_length(words), pc.binary_length(base)).to_numpy()
        plain = pc.utf8_is_alpha(base).to_numpy(zero_copy_only=False) & (stops <= 1)
        split = [_PIECES(w) for w in words.filter(pa.array(~plain)).to_numpy(zero_copy_only=False)]
        counts = np.where(plain, 1 + stops, 0)
        counts[~plain] = list(map(len, split))
        edges = np.append(0, np.cumsum(counts))
        coded = pa.concat_arrays([base.filter(pa.array(plain)), pa.array([*chain.from_iterable(split), *_STOPS], pa.large_string())]).dictionary_encode()
        codes = coded.indices.to_numpy()
        at = np.zeros(edges[-1], codes.dtype)
        once, stopped, other = np.flatnonzero(plain), np.flatnonzero(plain & (stops == 1)), np.repeat(~plain, counts)
        at[edges[once]] = codes[: len(once)]
        data, _, ends = text_column(words)
        at[edges[stopped] + 1] = np.where(data[ends[stopped] - 1] == ord(_STOPS[0]), codes[-2], codes[-1])
        at[other] = codes[len(once) : -2]
        found = self.pieces(coded.dictionary).take(pa.array(at))
        offsets = np.frombuffer(found.buffers()[1], np.int64)[edges]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(offsets), found.buffers()[2]])

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Special strings count as such to the tokenizer, and on rare code points its view of letters, white
        space and composition may differ from Python's: such texts go to it whole. Of the others, each word is coded once."""
        plain = [bool(_PLAIN(t)) and "<|" not in t for t in texts]
        split = pc.ascii_split_whitespace(pa.array([t.lower() if p else "" for t, p in zip(texts, plain, strict=True)], pa.large_string()))
        coded = split.values.dictionary_encode()
        found = self.words(coded.dictionary).take(coded.indices)
        stream, ends = text_column(found.view(pa.large_string()))[0].view("<u4"), np.frombuffer(found.buffers()[1], np.int64)
        edges = (ends[split.offsets.to_numpy()] // 4).tolist() if len(found) else [0] * (len(texts) + 1)
        return [stream[a:b] if p else np.array(self.ids(t), "<u4") for t, p, a, b in zip(texts, plain, edges, edges[1:], strict=False)]

    def text(self, text: str) -> bytes:
        return self.texts([text])[0].tobytes()


_loaded: dict[str, WordIds] = {}


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch by some TEXT_AT_ONCE bytes of text, a longer text by itself."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + TEXT_AT_ONCE, side="right")))
        yield batch.slice(at, end - at)
        at = end


_TOKENS = "doc_id long, doc_tokens long, full array<binary>, rest binary, id long, df long"


def _tokenize(path: str, end: int, window: int):
    """A row for each document, and at the task's end one for each id of its rests with their number (doc_tokens is null there)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _loaded[path] = _loaded.get(path) or WordIds(path)
        stop = np.array([end], "<u4").tobytes()
        held = np.zeros(1 << 16, np.int64)
        names = [x.split()[0] for x in _TOKENS.split(", ")]
        for batch in (part for whole in batches for part in _parts(whole)):
            n, full, rest = [], [], []
            for found in words.texts([t or "" for t in batch.column("text").to_pylist()]):
                ids = found.tobytes() + stop
                n.append(len(ids) // 4)
                whole = n[-1] // window * window * 4
                full.append([ids[i : i + 4 * window] for i in range(0, whole, 4 * window)])
                rest.append(ids[whole:])
                own = np.unique(np.frombuffer(rest[-1], "<u4"))
                if len(own):
                    if own[-1] >= len(held):
                        held = np.concatenate([held, np.zeros(int(own[-1]) + 1, np.int64)])
                    held[own] += 1
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(full, pa.list_(pa.binary())), pa.array(rest, pa.binary()), none, none], names)
        used = np.flatnonzero(held)
        none = [pa.nulls(len(used), t) for t in (pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.binary())]
        yield pa.RecordBatch.from_arrays([*none, pa.array(used.astype(np.int64)), pa.array(held[used])], names)

    return run


def _rarest(rank: np.ndarray):
    """The KNOWN rarest ids of each rest that is new to the task (rarest first, -1 where there are fewer) and its place among
    others by its three rarest. rank: of each id by rarity, the rarest greatest; -1 for ids of a single document."""
    of = np.zeros(len(rank) + 1, "<i4")
    of[rank[rank >= 0]] = np.flatnonzero(rank >= 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            nodes, shard, known = [], [], []
            data, starts, ends = text_column(batch.column("rest").cast(pa.large_binary()).view(pa.large_string()))
            for node, a, b in zip(batch.column("node").to_pylist(), starts.tolist(), ends.tolist(), strict=True):
                if node not in seen:
                    seen.add(node)
                    ranks = rank[data[a:b].view("<u4")]
                    best = np.unique(np.partition(ranks, -_SOME)[-_SOME:] if len(ranks) > _SOME else ranks)
                    if len(best) < KNOWN and len(ranks) > _SOME:  # some ids are repeated very often
                        best = np.unique(ranks)
                    best = best[::-1][:KNOWN]
                    best = best[best >= 0]
                    nodes.append(node)
                    shard.append(sum(int(t) << (20 * (2 - i)) for i, t in enumerate(best[:3])))
                    known.append(np.concatenate([of[best], np.full(KNOWN - len(best), -1, "<i4")]))
            pairs = np.array(known, "<i4").reshape(-1, KNOWN).view("<i8")
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(shard, pa.int64()), *map(pa.array, pairs.T)], ["node", "shard", *_KNOWN])

    return run


#: Ids of a rest that are looked at first for its rarest ones.
_SOME = 48


#: The KNOWN ids of a rest, two in a column.
_KNOWN = [f"known_{i}" for i in range(KNOWN // 2)]
_KNOWN_SCHEMA = ", ".join(f"{c} long" for c in _KNOWN)


def _known(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy() for c in _KNOWN], axis=1).view("<i4")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each pair of a rest's RAREST rarest ids."""
    for batch in batches:
        known, at = _known(batch), np.arange(len(batch))
        for i in range(RAREST):
            for j in range(i + 1, RAREST):
                use = at[known[:, j] >= 0]
                a, b = known[use, i].astype(np.int64), known[use, j].astype(np.int64)
                key = pa.array(np.minimum(a, b) << 32 | np.maximum(a, b))
                yield pa.RecordBatch.from_arrays([key, *(batch.column(c).take(pa.array(use)) for c in ("node", *_KNOWN))], ["key", "node", *_KNOWN])


def _nearest(idf: np.ndarray):
    """For each posting, the rest of its list that shares most with it: the sum of the inverse document frequencies of shared
    known ids. Rows are sorted by (key, part)."""

    def best(group: np.ndarray, node: np.ndarray, known: np.ndarray) -> pa.RecordBatch:
        score, near = np.zeros(len(node)), np.zeros(len(node), np.int64)
        edges = np.concatenate([np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1, [len(group)]])
        stop = np.repeat(edges, np.diff(edges, prepend=0))  # where each row's list ends
        i, d = np.arange(len(node)), 1
        while len(i := i[i + d < stop[i]]):
            mine, other = known[i], known[i + d]
            shared = np.zeros(len(i))
            for k in range(KNOWN):
                held = (mine[:, k, None] == other).any(axis=1) & (mine[:, k] >= 0)
                shared += held * idf[np.maximum(mine[:, k], 0)]
            shared[node[i] == node[i + d]] = 0
            for a, b in ((i, i + d), (i + d, i)):
                more = (shared > score[a]) | (shared == score[a]) & (shared > 0) & (node[b] > near[a])
                score[a[more]], near[a[more]] = shared[more], node[b[more]]
            d += 1
        use = score > 0
        return pa.RecordBatch.from_arrays([pa.array(node[use]), pa.array(near[use]), pa.array(score[use])], ["node", "near", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, node, known, parts = np.zeros((0, 2), np.int64), np.zeros(0, np.int64), np.zeros((0, KNOWN), np.int32), []

        def gathered() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            new = [(np.stack([b.column(c).to_numpy() for c in ("key", "part")], axis=1), b.column("node").to_numpy(), _known(b)) for b in parts]
            return tuple(np.concatenate([old, *x]) for old, *x in zip((group, node, known), *new, strict=True))

        for batch in batches:
            parts.append(batch)
            if sum(map(len, parts)) >= POSTINGS_AT_ONCE:
                group, node, known = gathered()
                parts = []
                last = len(group) - int(np.argmin((group[::-1] == group[-1]).all(axis=1))) if (group[0] != group[-1]).any() else 0
                yield best(group[:last], node[:last], known[:last])
                group, node, known = group[last:], node[last:], known[last:]
        yield best(*gathered())

    return run


def _places(rests: DataFrame, df: np.ndarray, idf: np.ndarray, parts: int) -> DataFrame:
    """rests: (node, rest). (node, shard, root, at): a rest's place by its rarest ids, the group it is linked with by nearest ones, and
    the group's place."""
    rank = np.full(len(df), -1)
    shared = np.flatnonzero(df > 1)
    rank[shared[np.argsort(-df[shared], kind="stable")]] = np.arange(len(shared))
    known = rests.mapInArrow(_rarest(rank), f"node long, shard long, {_KNOWN_SCHEMA}").groupBy("node").agg(*[F.first(c).alias(c) for c in ("shard", *_KNOWN)])
    known = staged(known, "known")
    postings = staged(known.drop("shard").mapInArrow(_postings, f"key long, node long, {_KNOWN_SCHEMA}"), "postings")
    long = postings.groupBy("key").agg(F.ceil(F.count("*") / F.lit(POSTINGS)).alias("parts")).where("parts > 1")
    dealt = join_small(postings, staged(long, "long_lists"), ["key"], "left")
    dealt = dealt.select("key", F.coalesce(F.pmod(F.xxhash64("node", "key"), F.col("parts")), F.lit(0)).cast("long").alias("part"), "node", *_KNOWN)
    near = dealt.repartition(parts, "key", "part").sortWithinPartitions("key", "part", "node").mapInArrow(_nearest(idf), "node long, near long, score double")
    near = near.groupBy("node").agg(F.max(F.struct("score", "near")).alias("best")).select("node", F.col("best.near").alias("near"))
    near = staged(near, "nearest")
    ways = [near.withColumnRenamed("near", "to")]
    for _ in range(JUMPS):  # each jump doubles the way
        onward = ways[-1].select(F.col("node").alias("to"), F.col("to").alias("on"))
        ways.append(staged(join_small(ways[-1], onward, ["to"], "inner").select("node", F.col("on").alias("to")), "ways"))
    # ways end in a pair of rests that are each other's nearest: the lesser one names it
    roots = join_small(ways[-1], near.select(F.col("node").alias("to"), "near"), ["to"], "inner").select("node", F.least("to", "near").alias("root"))
    own = known.select("node", "shard").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    places = staged(join_small(own, known.select(F.col("node").alias("root"), F.col("shard").alias("at")), ["root"], "inner"), "places")
    discard(known, postings, near, *ways[1:])
    return places


class _Index:
    """The BM25 inverted index of one shard: postings by id, each with its weight, and the ids of each document."""

    def __init__(self, rests: list[np.ndarray], idf: np.ndarray) -> None:
        self.n = len(rests)
        lengths = np.array([len(r) for r in rests], np.int64)
        pair, tf = np.unique((np.concatenate(rests).astype(np.int64) << 20) | np.repeat(np.arange(self.n), lengths), return_counts=True)
        ids, self.docs = pair >> 20, pair & ((1 << 20) - 1)
        self.weights = idf[ids] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[self.docs] / lengths.mean()))
        self.starts = np.concatenate([[0], np.flatnonzero(np.diff(ids)) + 1])
        self.sizes = np.diff(self.starts, append=len(ids))
        order = np.argsort(self.docs.astype(np.uint16) if self.n < 1 << 16 else self.docs, kind="stable")
        self.terms = np.repeat(np.arange(len(self.starts)), self.sizes)[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.docs, minlength=self.n))])

    def scores(self, seed: int) -> np.ndarray:
        terms = self.terms[self.first[seed] : self.first[seed + 1]]
        n = self.sizes[terms]
        ends = np.cumsum(n)
        at = np.repeat(self.starts[terms] - ends + n, n) + np.arange(ends[-1])
        return np.bincount(self.docs[at], self.weights[at], self.n)


def _pack(idf: np.ndarray, window: int, shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = (TaskContext.get().partitionId() + 1) << 34
        rows: list[tuple] = []  # doc_id, start, ids, doc_tokens, sequence, offset
        open_: list[tuple] = []  # (doc_id, start, ids, doc_tokens) of the window being filled
        filled = 0

        def put(piece: tuple) -> tuple | None:
            """Adds a piece to the open window; what doesn't fit comes back."""
            nonlocal filled, sequence
            doc, start, ids, n = piece
            take = min(len(ids), window - filled)
            open_.append((doc, start, ids[:take], n))
            filled += take
            if filled == window:
                close(window)
            return (doc, start + take, ids[take:], n) if take < len(ids) else None

        def close(size: int) -> None:
            nonlocal filled, sequence
            at = 0
            while at < size:
                doc, start, ids, n = open_.pop(0)
                take = min(len(ids), size - at)
                rows.append((doc, start, ids[:take], n, sequence, at))
                if take < len(ids):
                    open_.insert(0, (doc, start + take, ids[take:], n))
                at += take
            sequence += 1
            filled -= size

        def fill(pieces: list[tuple]) -> None:
            index = _Index([p[2] for p in pieces], idf)
            unused, lengths = np.ones(len(pieces), bool), np.array([len(p[2]) for p in pieces])
            seed = 0
            for first in range(len(pieces)):
                if not unused[first]:
                    continue
                seed, left = first, pieces[first]
                unused[first] = False
                while left is not None:
                    left = put(left)
                    if left is not None or not filled:
                        continue
                    scores = index.scores(seed)
                    near = np.flatnonzero(unused & (lengths <= window - filled))
                    near = near[np.argsort(-scores[near], kind="stable")]
                    while len(near):
                        put(pieces[near[0]])
                        unused[near[0]] = False
                        if not filled:
                            break
                        near = near[1:]
                        near = near[lengths[near] <= window - filled]
                    if filled and unused.any():  # none fits: the nearest is cut, and its end seeds the next window
                        seed = int(np.argmax(np.where(unused, scores, -2.0)))
                        unused[seed] = False
                        left = pieces[seed]

        waiting: list[tuple] = []
        last = None
        for batch in batches:
            for doc, n, rest, root in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "rest", "root")), strict=True):
                if len(waiting) >= (shard if root != last else 2 * shard):
                    fill(waiting)
                    waiting = []
                last, ids = root, np.frombuffer(rest, "<u4")
                waiting.append((doc, n - len(ids), ids, n))
                if len(rows) >= 4000:
                    yield _rows(rows)
                    rows.clear()
        if waiting:
            fill(waiting)
        while filled:
            close(1 << (filled.bit_length() - 1))
        yield _rows(rows)

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    doc, start, ids, n, sequence, offset = list(zip(*rows, strict=True)) or [[]] * 6
    return pa.RecordBatch.from_arrays(
        [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(n, pa.int64()), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
        ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"],
    )


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = 2048, shard: int = SHARD) -> DataFrame:
    """Returns the pieces of all rows of docs (doc_id long, text string; other columns are ignored):
    (doc_id, start, ids binary, doc_tokens, sequence_id, offset).

    A document is the tokenizer's ids of its text, without special ones added, then end_id; a null text is empty. ids:
    little-endian unsigned 32-bit; start: the document's ids before the piece; offset: the piece's place in its sequence.
    Each id lies in exactly one piece, so a row with an empty text is one piece of one id; rows that repeat a doc_id, or
    have none, are packed like any others. Sequences hold `window` ids, or a smaller power of two. An empty table gives
    no rows. tokenizer: the path of a tokenizer file that workers can read. window must be a power of two."""
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tokens = staged(rows.mapInArrow(_tokenize(tokenizer, end_id, window), _TOKENS), "tokens")
    df = tokens.where("doc_tokens is null").groupBy("id").agg(F.sum("df").alias("df")).toPandas()  # a row per vocabulary id at most
    tokens = tokens.where("doc_tokens is not null")
    count = tokens.count()
    held = np.zeros(int(df["id"].max()) + 1 if len(df) else 1, np.int64)
    held[df["id"].to_numpy(int)] = df["df"].to_numpy()
    idf = np.where(held > 0, np.log(1 + (count - held + 0.5) / (held + 0.5)), 0.0)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rests = tokens.where("length(rest) > 0").select("doc_id", "doc_tokens", F.xxhash64("rest").alias("node"), "rest")
    rests = join_small(rests, _places(rests.select("node", "rest"), held, idf, parts), ["node"], "inner")
    order = ["at", "root", "shard", "node", "doc_id"]
    rests = rests.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "doc_tokens", "rest", "root")
    packed = rests.mapInArrow(_pack(idf, window, shard), "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long")
    whole = tokens.select("doc_id", "doc_tokens", F.posexplode("full").alias("i", "ids"))
    whole = whole.select("doc_id", (F.col("i") * F.lit(window).cast("long")).alias("start"), "ids", "doc_tokens", (F.monotonically_increasing_id() + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(whole)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)

