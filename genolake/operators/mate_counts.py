"""What two mates read of the same reference bases, counted inside tasks: no base is a row, and no task holds more than a batch of pairs."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import ship
from .kernel import ragged

#: Counters of a batch up to which they are one array.
CELLS = 1 << 20
NAMES = ["bin_a", "bin_b", "base_a", "base_b", "frame", "masked", "n"]
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64()]


def aligned_stretches(cigar: str | None) -> list[tuple[int, int, int]]:
    """(place after the read's first aligned one, place in the read, length) of a CIGAR's aligned stretches (M, =, X)."""
    out, place, at = [], 0, 0
    for n, op in ((int(x), op) for x, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar or "")):
        if op in "M=X":
            out.append((place, at, n))
        place += n * (op in "MDN=X")
        at += n * (op in "MIS=X")
    return out


def _bytes(column: pa.Array, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The byte at place `at` of each row's value, 0 beyond its ends."""
    offsets, data = ragged(column)
    place = offsets[rows] + at
    inside = (at >= 0) & (place < offsets[rows + 1])
    if inside.all():
        return data[place]
    return np.where(inside, data[np.where(inside, place, 0)] if len(data) else 0, 0).astype(np.uint8)


def overlap_counts(pairs: DataFrame, bins: int = 5, most: int = 1000) -> DataFrame:
    """(bin_a, bin_b, base_a, base_b, frame, masked, n): how many reference bases both mates align, by the cycles at which they read them, what they read,
    the contig's base and whether the place is a known site. pairs: (a, b: structs of pos0, cigar, seq, reverse; start, bases, known), with the contig's bases
    from `start` on for as far as the mates reach, and a byte for each of them that is 1 at known sites.

    bin: the cycle in `bins` parts of a mate's read; a reverse read's first cycle is its last base. A base beyond the end of a read or of `bases`
    is empty; a mate without bases is compared with nothing. Stretches of more than `most` bases that both align without a gap are refused."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            # here and not in a where(), which would work the reads out twice
            whole = [pc.is_valid(batch.column(f"{s}_pos0")) for s in "ab"] + [pc.greater(pc.binary_length(batch.column(f"{s}_seq")), 0) for s in "ab"]
            _count(batch.filter(reduce(pc.and_, whole)), bins, most, total)
        columns = list(zip(*((*k, n) for k, n in total.items()), strict=True)) or [[]] * len(NAMES)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS, strict=True)], NAMES)

    ship(pairs.sparkSession)
    mate = lambda s: [F.col(f"{s}.pos0").cast("long").alias(f"{s}_pos0"), F.col(f"{s}.cigar").alias(f"{s}_cigar"), F.col(f"{s}.seq").alias(f"{s}_seq"), F.coalesce(F.col(f"{s}.reverse"), F.lit(False)).alias(f"{s}_reverse")]
    flat = pairs.select(*mate("a"), *mate("b"), F.col("start").cast("long").alias("start"), "bases", "known")
    counts = flat.mapInArrow(run, "bin_a long, bin_b long, base_a string, base_b string, frame string, masked boolean, n long")
    return counts.groupBy(*NAMES[:-1]).agg(F.sum("n").alias("n"))


def _count(batch: pa.RecordBatch, bins: int, most: int, total: Counter) -> None:
    codes = [batch.column(c).dictionary_encode() for c in ("a_cigar", "b_cigar")]
    blocks = [[aligned_stretches(x) for x in c.dictionary.to_pylist()] for c in codes]
    which = [c.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for c in codes]
    number = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
    pos, turned = [number("a_pos0"), number("b_pos0")], [number("a_reverse"), number("b_reverse")]
    long = [np.diff(ragged(batch.column(c))[0]) for c in ("a_seq", "b_seq")]
    start = number("start")
    for x, of_x in enumerate(blocks[0]):
        for y, of_y in enumerate(blocks[1]):
            both = np.flatnonzero((which[0] == x) & (which[1] == y))
            for u in of_x if len(both) else ():
                for v in of_y:
                    begin = [pos[0][both] + u[0], pos[1][both] + v[0]]
                    lo = np.maximum(*begin)
                    n = np.minimum(begin[0] + u[2], begin[1] + v[2]) - lo
                    if n.max() > most:
                        raise ValueError(f"mates share more than {most} bases in a row")
                    met = np.flatnonzero(n > 0)
                    if not len(met):
                        continue
                    n, rows = n[met], both[met]
                    # a place for each shared base of each row
                    ends = np.cumsum(n)
                    i = np.arange(ends[-1]) - np.repeat(ends - n, n)
                    each = np.repeat(rows, n)
                    place = [np.repeat((lo - begin[k])[met] + s[1], n) + i for k, s in enumerate((u, v))]
                    at = np.repeat(lo[met] - start[rows], n) + i
                    cycle = [np.where(turned[k][each], long[k][each] - 1 - place[k], place[k]) * bins // long[k][each] for k in (0, 1)]
                    read = [_bytes(batch.column(c), each, p) for c, p in (("a_seq", place[0]), ("b_seq", place[1]), ("bases", at), ("known", at))]
                    _add(cycle, read, total)


def _add(cycle: list[np.ndarray], read: list[np.ndarray], total: Counter) -> None:
    """Adds up equal rows of cycles and bytes (both mates' bases, the contig's, the known site)."""
    parts = [(c - c.min(), np.arange(c.min(), c.max() + 1)) for c in cycle]
    for b in read:
        used = np.flatnonzero(np.bincount(b, minlength=256))
        code = np.zeros(256, np.int64)
        code[used] = np.arange(len(used))
        parts.append((code[b], used))
    key, cells = parts[0][0], len(parts[0][1])
    for code, values in parts[1:]:
        key, cells = key * len(values) + code, cells * len(values)
    if cells <= CELLS:
        n = np.bincount(key, minlength=cells)
        found = np.flatnonzero(n)
        n = n[found]
    else:
        found, n = np.unique(key, return_counts=True)
    columns = []
    for _, values in reversed(parts):
        found, code = np.divmod(found, len(values))
        columns.append(values[code].tolist())
    known, frame, base_b, base_a, bin_b, bin_a = columns
    base = lambda x: chr(x) if x else ""
    for k, m in zip(zip(bin_a, bin_b, map(base, base_a), map(base, base_b), map(base, frame), map(bool, known), strict=True), n.tolist(), strict=True):
        total[k] += m
