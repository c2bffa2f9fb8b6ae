"""Misses and false calls that spell the same sequence in different ways.

Around each false call lies a window; all false calls and all misses in it that are still free are put into the reference, each side
for itself, and if both give the same bases, all of them are settled. False calls take their turn by position, so what one
settles is gone for those after it. That order is kept inside tiles of a contig, each walked by a task as if nothing were settled before it. A tile
hands the ids that it settled near its end to the next one, which is walked again if these aren't what it went by, until none changes. What a
tile settles depends on those before it only, so what stays is the walk along the whole contig; the number of rounds is the longest chain of
tiles that change one another."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import discard, join_small, ship, staged
from .kernel import tiles

#: Bases in a tile; it has two windows' reach at least, so that what a tile settles meets the next tile and none beyond.
TILE = 4096
#: Tiles to be walked again are broadcast up to so many bytes.
AGAIN_BYTES = 16 << 20


def spelled(window: str, start: int, variants: list[tuple]) -> str:
    """The bases of a window (from `start` on the contig) with variants (pos0, ref, alt, ...) put in from left to right. Places move
    by the lengths put in before; a variant that doesn't fit into the window is passed over."""
    shift = -start
    for v in variants:
        at = v[0] + shift
        end = at + len(v[1])
        if at >= 0 and end <= len(window):
            window = window[:at] + v[2] + window[end:]
            shift += len(v[2]) - len(v[1])
    return window


def _walk(base: DataFrame, size: int, reach: int) -> DataFrame:
    """(contig, tile, met, gone, handed) from tiles (contig, tile, seq, records, met): with the ids in `met` settled before, the ids that the tile's calls
    settle, and those of them that the next tile holds too."""
    names = ["contig", "tile", "met", "gone", "handed"]
    ids = pa.list_(pa.int64())
    kinds = [pa.string(), pa.int64(), ids, ids, ids]

    def settle(first: int, seq: str, records: list[tuple], met: list[int]) -> tuple[list[int], list[int]]:
        calls, misses = (sorted(r[1:] for r in records if r[0] == call) for call in (True, False))
        at = [[v[0] for v in side] for side in (calls, misses)]
        gone, own, handed = set(met), [], []
        for place, *_, me in calls:
            low = max(place - reach, 0)
            if me in gone or not (first <= low < first + size):
                continue
            a, b = ([v for v in side[bisect_left(p, place - reach) : bisect_right(p, place + reach)] if v[3] not in gone] for side, p in zip((calls, misses), at, strict=True))
            window = seq[low - first : max(place + reach + 1 - first, 0)]
            if not b or not window or spelled(window, low, a).upper() != spelled(window, low, b).upper():
                continue
            gone.update(v[3] for v in a + b)
            own += [v[3] for v in a + b]
            handed += [v[3] for v in a + b if v[0] >= first + size]
        return own, sorted(handed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for contig, tile, seq, records, met in zip(*(batch.column(c) for c in ("contig", "tile", "seq", "records", "met")), strict=True):
                fields = zip(*(records.values.field(c).to_pylist() for c in ("call", "pos0", "ref", "alt", "id")), strict=True)
                before = met.as_py()
                rows.append((contig.as_py(), tile.as_py(), before, *settle(tile.as_py() * size, seq.as_py(), list(fields), before)))
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    ship(base.sparkSession)
    return base.select("contig", "tile", "seq", "records", "met").mapInArrow(run, "contig string, tile long, met array<long>, gone array<long>, handed array<long>")


def equivalent(misses: DataFrame, false_calls: DataFrame, contigs: DataFrame, window: int = 50, tile: int = TILE) -> DataFrame:
    """(contig, kind, pos0, ref, alt) of the misses (fn) and false calls (fp) that are settled, a row per record.

    Both are (contig, pos0, ref, alt) with literal alleles; contigs: (contig, seq). A window holds the records whose place is at most `window` bases
    from a false call's. Case makes no difference; a window without bases settles nothing. A record that repeats another counts by itself; calls at one
    place go by ref and alt. A tile's records are one row, so memory follows the records within a tile and no more."""
    size = max(tile, 2 * window)
    sides = [df.select("contig", F.col("pos0").cast("long").alias("pos0"), "ref", "alt", F.lit(kind).alias("kind")) for kind, df in (("fp", false_calls), ("fn", misses))]
    records = staged(sides[0].union(sides[1]).where("contig is not null and pos0 is not null and ref is not null and alt is not null").withColumn("id", F.monotonically_increasing_id()), "records")
    # a call belongs to the tile in which its window begins; that tile's records are those in its calls' windows
    of = lambda place: F.greatest(F.floor(place / size), F.lit(0).cast("long"))
    call, begin = F.col("kind") == "fp", F.col("pos0") - window
    filed = records.withColumn("tile", F.explode(F.sequence(of(begin - window), of(begin + window)))).withColumn("own", call & (F.col("tile") == of(begin)))
    # a call without a miss near it can't be settled
    held = filed.groupBy("contig", "tile").agg(F.collect_list(F.struct(call.alias("call"), "pos0", "ref", "alt", "id")).alias("records"), F.max("own").alias("own"), F.max(~call).alias("missed")).where("own and missed")
    bases = tiles(contigs, size, 0, 2 * window).select("contig", "tile", "seq")
    base = staged(held.select("contig", "tile", "records").join(bases, ["contig", "tile"]), "tiles")
    none = F.array().cast("array<bigint>")
    state = staged(_walk(base.withColumn("met", none), size, window), "walked")
    while True:
        handed = state.where(F.size("handed") > 0).select("contig", (F.col("tile") + 1).alias("tile"), F.col("handed").alias("now"))
        stale = state.select("contig", "tile", "met").join(handed, ["contig", "tile"], "left").withColumn("now", F.coalesce("now", none))
        stale = staged(stale.where("now != met").select("contig", "tile", F.col("now").alias("met")), "stale")
        if stale.isEmpty():
            discard(stale)
            break
        again = _walk(join_small(base, stale, ["contig", "tile"], "inner", AGAIN_BYTES), size, window)
        walked = staged(join_small(state, stale.select("contig", "tile"), ["contig", "tile"], "left_anti", AGAIN_BYTES).unionByName(again), "walked")
        discard(state, stale)
        state = walked
    out = staged(records.join(state.select(F.explode("gone").alias("id")), "id", "left_semi").select("contig", "kind", "pos0", "ref", "alt"), "equivalent")
    discard(records, base, state)
    return out
