"""Scans over bases inside tasks. Contigs (contig, seq) go through numpy a block at a time; what leaves a task are tiles, counts or
windows, never a row for each base."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import ship

#: Bases looked at at once.
BLOCK = 1 << 20
#: Rows of a batch that a task hands out.
ROWS = 4096
CODES = np.full(256, 4, np.uint8)
CODES[np.frombuffer(b"ACGT", np.uint8)] = np.arange(4)


def _each(work: Callable[[str, bytes], Iterator[tuple]], names: list[str], kinds: list[pa.DataType]):
    """Rows that work yields for each contig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for contig, seq in zip(batch.column("contig").to_pylist(), batch.column("seq"), strict=True):
                for row in work(contig, (seq.as_py() or "").encode()):
                    rows.append(row)
                    if len(rows) == ROWS:
                        yield _batch(rows, names, kinds)
                        rows = []
            yield _batch(rows, names, kinds)

    return run


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def tiles(contigs: DataFrame, tile: int, before: int = 0, after: int = 0) -> DataFrame:
    """(contig, tile, tile_start, seq_start, seq): pieces of `tile` bases; seq also holds up to `before` bases before the piece, from
    seq_start on, and up to `after` bases after it. contigs: (contig, seq), each cut in one pass, or larger tiles (contig, tile, start, seq), whose
    starts are multiples of `tile` and which meet their neighbours' edges first."""
    if "tile" in contigs.columns:
        return _recut(contigs, tile, before, after)

    def work(contig: str, seq: bytes) -> Iterator[tuple]:
        for i, start in enumerate(range(0, len(seq), tile)):
            first = max(0, start - before)
            yield contig, i, start, first, seq[first : start + tile + after].decode()

    ship(contigs.sparkSession)
    run = _each(work, ["contig", "tile", "tile_start", "seq_start", "seq"], [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()])
    return contigs.select("contig", "seq").mapInArrow(run, "contig string, tile long, tile_start long, seq_start long, seq string")


def _recut(large: DataFrame, tile: int, before: int, after: int) -> DataFrame:
    edge = lambda step, bases: F.struct((F.col("tile") + step).alias("tile"), F.lit(step).alias("side"), F.lit(None).cast("long").alias("start"), bases.alias("seq"))
    own = F.struct(F.col("tile").cast("long").alias("tile"), F.lit(0).alias("side"), F.col("start").cast("long").alias("start"), F.col("seq").alias("seq"))
    rows = large.select("contig", F.inline(F.array(own, edge(1, F.right("seq", F.lit(before))), edge(-1, F.left("seq", F.lit(after))))))
    side = lambda k, c: F.max(F.when(F.col("side") == k, F.col(c)))
    met = rows.groupBy("contig", "tile").agg(side(0, "start").alias("start"), F.coalesce(side(1, "seq"), F.lit("")).alias("lead"), side(0, "seq").alias("body"), F.coalesce(side(-1, "seq"), F.lit("")).alias("tail"))
    met = met.where("body is not null")
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.length("body") - 1, F.lit(tile).cast("long")))
    cut = met.where("body != ''").select("contig", "start", F.length("lead").alias("led"), F.concat("lead", "body", "tail").cast("binary").alias("all"), at.alias("at"))
    first = F.greatest(F.col("led") + F.col("at") - before, F.lit(0))
    seq = F.substr("all", (first + 1).cast("int"), (F.col("led") + F.col("at") + tile + after - first).cast("int")).cast("string")
    place = F.col("start") + F.col("at")
    return cut.select("contig", F.floor(place / tile).alias("tile"), place.alias("tile_start"), (F.col("start") - F.col("led") + first).alias("seq_start"), seq.alias("seq"))


def ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of an array of strings or binaries."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    data = column.buffers()[2]
    return offsets.astype(np.int64), np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)


def _flagged(tiled: DataFrame, sites: DataFrame, tile: int, after: int) -> DataFrame:
    """tiles (contig, tile, seq_start, seq) with `flags`: a byte for each base, 1 at sites (contig, pos0). A tile's sites are one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, _ = ragged(seq := batch.column("seq"))
            at = batch.column("at")
            row = np.repeat(np.arange(len(seq)), np.diff(at.offsets.to_numpy()))
            place = offsets[row] + at.flatten().to_numpy(zero_copy_only=False)
            flags = np.zeros(offsets[-1] - offsets[0], np.uint8)
            flags[place[place < offsets[row + 1]] - offsets[0]] = 1
            binary = pa.Array.from_buffers(pa.binary(), len(seq), [None, pa.py_buffer((offsets - offsets[0]).astype(np.int32)), pa.py_buffer(flags)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("contig", "tile", "seq_start", "seq")), binary], ["contig", "tile", "seq_start", "seq", "flags"])

    t = F.explode(F.sequence(F.greatest(F.floor((F.col("pos0") - after) / tile), F.lit(0).cast("long")), F.floor(F.col("pos0") / tile)))
    filed = sites.where("pos0 >= 0").select("contig", F.col("pos0").cast("long").alias("pos0"), t.alias("tile"))
    held = filed.groupBy("contig", "tile").agg(F.collect_set((F.col("pos0") - F.col("tile") * tile).cast("int")).alias("at"))
    both = tiled.select("contig", "tile", "seq_start", "seq").join(held, ["contig", "tile"], "left").withColumn("at", F.coalesce("at", F.array().cast("array<int>")))
    ship(tiled.sparkSession)
    return both.mapInArrow(run, "contig string, tile long, seq_start long, seq string, flags binary")


def reference_bases(spans: DataFrame, contigs: DataFrame, start: str, length: str, most: int, tile: int = 4096, sites: DataFrame | None = None) -> DataFrame:
    """spans (contig, start, length <= most, ...) with `bases`, those of the contig there: fewer at its end. Spans meet the tile they
    start in, so no row carries a contig. With sites (contig, pos0) also `known`: a byte for each of the bases, 1 at a site."""
    t = tiles(contigs, tile, 0, most)
    if sites is not None:
        t = _flagged(t, sites, tile, most)
    # as bytes, of which a piece is taken without a walk to its start
    t = t.select(F.col("contig").alias("t_contig"), F.col("tile").alias("t_tile"), "seq_start", F.col("seq").cast("binary").alias("seq"), *(["flags"] if sites is not None else []))
    s = spans.withColumn("s_tile", F.floor(F.col(start) / tile))
    s = s.join(t, (F.col("contig") == F.col("t_contig")) & (F.col("s_tile") == F.col("t_tile")))
    piece = lambda c: F.substr(c, (F.col(start) - F.col("seq_start") + 1).cast("int"), F.col(length).cast("int"))
    s = s.withColumn("bases", piece("seq").cast("string"))
    if sites is not None:
        s = s.withColumn("known", piece("flags"))
    return s.drop("s_tile", "t_tile", "t_contig", "seq_start", "seq", "flags")


def context(points: DataFrame, contigs: DataFrame, position: str = "pos0", flank: int = 1) -> DataFrame:
    """points (contig, position, ...) with `frame`, the bases from `flank` before to `flank` after; points nearer to an end are left out."""
    s = points.withColumn("f_start", F.col(position) - flank).withColumn("f_length", F.lit(2 * flank + 1)).where("f_start >= 0")
    out = reference_bases(s, contigs, "f_start", "f_length", 2 * flank + 1).withColumnRenamed("bases", "frame")
    return out.where(F.length("frame") == 2 * flank + 1).drop("f_start", "f_length")


def count_kmers(contigs: DataFrame, k: int) -> DataFrame:
    """(kmer, n) of all k-mers of known bases, counted in the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(4**k, np.int64)
        for batch in batches:
            for seq in batch.column("seq"):
                codes = CODES[np.frombuffer((seq.as_py() or "").encode(), np.uint8)]
                for at in range(0, len(codes) - k + 1, BLOCK):
                    part = codes[at : at + BLOCK + k - 1]
                    m = len(part) - k + 1
                    value, known = np.zeros(m, np.int64), np.ones(m, bool)
                    for j in range(k):
                        value = value * 4 + part[j : j + m]
                        known &= part[j : j + m] < 4
                    total += np.bincount(value[known], minlength=4**k)
        used = np.flatnonzero(total)
        names = ["".join("ACGT"[v >> 2 * j & 3] for j in range(k - 1, -1, -1)) for v in used.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(total[used])], ["kmer", "n"])

    ship(contigs.sparkSession)
    return contigs.select("seq").mapInArrow(run, "kmer string, n long").groupBy("kmer").agg(F.sum("n").alias("n"))


def gc_windows(contigs: DataFrame, size: int, stride: int) -> DataFrame:
    """(contig, start, gc): windows of `size` bases with a known one, at every `stride`; gc is a rounded percentage (halves go up)."""
    per_block = max(BLOCK // stride, 1) * stride

    def work(contig: str, seq: bytes) -> Iterator[tuple]:
        codes = CODES[np.frombuffer(seq, np.uint8)]
        for at in range(0, len(codes) - size + 1, per_block):
            part = codes[at : at + per_block + size - stride]
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in ((part == 1) | (part == 2), part < 4)]
            start = np.arange(0, len(part) - size + 1, stride)
            gc, known = (s[start + size] - s[start] for s in sums)
            use = known > 0
            share = np.floor(100 * gc[use] / known[use] + 0.5).astype(int)
            yield from zip([contig] * len(share), (at + start[use]).tolist(), share.tolist(), strict=True)

    ship(contigs.sparkSession)
    run = _each(work, ["contig", "start", "gc"], [pa.string(), pa.int64(), pa.int32()])
    return contigs.select("contig", "seq").mapInArrow(run, "contig string, start long, gc int")


def gc_before(contigs: DataFrame, stride: int) -> DataFrame:
    """(contig, pos0, gc): how many G and C lie before each multiple of `stride`, so that any window of multiples is a difference."""

    def work(contig: str, seq: bytes) -> Iterator[tuple]:
        codes = CODES[np.frombuffer(seq, np.uint8)]
        total, per_block = 0, max(BLOCK // stride, 1) * stride
        for at in range(0, len(codes), per_block):
            sums = np.concatenate([[0], np.cumsum((codes[at : at + per_block] == 1) | (codes[at : at + per_block] == 2))])
            for i in range(0, len(sums) - 1, stride):
                yield contig, at + i, total + int(sums[i])
            total += int(sums[-1])

    ship(contigs.sparkSession)
    run = _each(work, ["contig", "pos0", "gc"], [pa.string(), pa.int64(), pa.int64()])
    return contigs.select("contig", "seq").mapInArrow(run, "contig string, pos0 long, gc long")


def runs_of(contigs: DataFrame, length: int) -> DataFrame:
    """(contig, pos0, window): homopolymer runs of exactly `length` known bases with the known base on either side; pos0 is the left one's."""

    def work(contig: str, seq: bytes) -> Iterator[tuple]:
        codes = CODES[np.frombuffer(seq, np.uint8)]
        for at in range(0, len(codes) - length - 1, BLOCK):
            part = codes[at : at + BLOCK + length + 1]
            m = len(part) - length - 1
            hit = (part[:m] < 4) & (part[length + 1 : length + 1 + m] < 4) & (part[1 : 1 + m] < 4) & (part[:m] != part[1 : 1 + m]) & (part[length + 1 : length + 1 + m] != part[1 : 1 + m])
            for j in range(2, length + 1):
                hit &= part[j : j + m] == part[1 : 1 + m]
            for i in (np.flatnonzero(hit) + at).tolist():
                yield contig, i, seq[i : i + length + 2].decode()

    ship(contigs.sparkSession)
    run = _each(work, ["contig", "pos0", "window"], [pa.string(), pa.int64(), pa.string()])
    return contigs.select("contig", "seq").mapInArrow(run, "contig string, pos0 long, window string")
