"""Exact n-gram Jaccard self-join: metric regions, windows from the triangle inequality, recursion inside regions.

Every document is a set of k-word shingles. Two metrics are used. The symmetric difference |A xor B| is one, and the
distance to the empty set in it is the set's size: rings of sizes are its regions, and a document whose possible
partners reach into the next ring is replicated there. In a ring, partners differ by at most D shingles. The universe
of shingles is cut by hash into D + 1 + slack slices, the projection onto a slice never enlarges the difference, so
partners agree on a slice wholly (slack + 1 slices, in fact): cells of radius zero. Documents that share a cell and whose
distances to fixed parts of the universe, the pivots, differ by no more than partners' may (the triangle inequality) are
candidates, and connected candidates form a region.

Inside a region, documents are pivots under the Jaccard distance, each far from those before it. What a pivot's ball holds is linked
with it, and what lies in the shell around a ball is compared with the part of the ball that the triangle inequality leaves.
The other documents go to the Voronoi regions of the pivots, those near a border to both sides (windows of twice the
threshold), and each region is joined likewise. All links come from exact intersection sizes.

A region too large for one task takes pivots as a whole, its members being many tasks: those in connected balls are its closed part,
and only the members outside of it are compared with all others. So a family of near copies costs its size, not its square.

Whole-corpus document pivots were tried first and give no regions: unrelated texts are at distances of 0.95 to 1 from
every pivot, so that each window holds every document."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, fresh, join_hot, join_small, ship, staged, text_column
from .components import components
from .hashing import mix, shingle_set, word_hashes

RING = 1.5
#: Shingles that one region's task holds; of a larger region, what pivots' balls leave apart is dealt out as pairs of blocks.
REGION_SHINGLES = 4_000_000
#: Documents of a group of cells that one task compares by their coordinates; a larger group is dealt out likewise.
CELL_MEMBERS = 16_384
#: Rows of a batch that a task hands out.
ROWS_OUT = 100_000
#: Pivots of a region at most.
PIVOTS = 4
#: Turns in which a heavy region takes so many pivots for its closed part.
TURNS = 4
#: One in so many texts (by hash) tells which cells are hot: those with HOT_SEEN sets or more among these texts.
HOT_ONE_IN, HOT_SEEN = 64, 32
#: Parts of a hot cell.
HOT_PARTS = 64


def rings_of(n: int, percent: int) -> Iterator[tuple[int, int, int]]:
    """(ring, its largest size, its smallest) for each ring in which a set of n shingles can meet a partner of its size or more."""
    most, r, low = 100 * n // percent, 0, 1
    while low <= most:
        high = max(low, int(low * RING))
        if high >= n:
            yield r, high, low
        r, low = r + 1, high + 1


def slices(low: int, high: int, percent: int) -> tuple[int, int]:
    """(slices, slack) of a ring. With |A|, |B| <= high and a similarity of percent, |A xor B| <= D = (100 - percent) * 2 * high / (100 + percent)."""
    base = (100 - percent) * 2 * high // (100 + percent) + 1
    slack = 1 + int(1.5 * base * np.exp(-low / base))
    return base + slack, slack


def cells(shingles: np.ndarray, percent: int) -> np.ndarray:
    """The cells of one set: a hash of (ring, slice, content). Empty slices count only for a set with more of them than
    the slack: any other set has, with each partner, a shared slice that is not empty."""
    out = []
    spread = mix(shingles ^ np.uint64(0xA5A5A5A5DEADBEEF)) >> np.uint64(32)
    for ring, high, low in rings_of(len(shingles), percent):
        n, slack = slices(low, high, percent)
        at = (spread % np.uint64(n)).astype(np.int64)
        total, held = np.zeros(n, np.uint64), np.bincount(at, minlength=n)
        np.add.at(total, at, shingles)
        use = np.flatnonzero(held) if n - np.count_nonzero(held) <= slack else np.arange(n)
        out.append(mix(mix(total[use] + held[use].astype(np.uint64)) + (use + (ring << 32)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return np.concatenate(out)


def _set_hash(shingles: np.ndarray) -> int:
    return int(mix(np.array([len(shingles)], np.uint64) + np.add.reduce(mix(shingles), dtype=np.uint64)).view(np.int64)[0])


def coordinates(shingles: np.ndarray) -> bytes:
    """Sizes of the set in fixed parts of the universe, which are pivots: |A xor U| = |A| + |U| - 2 |A and U|, so by the triangle
    inequality |A xor B| is at least the sum of the coordinates' differences. There are so many parts that 2 to 4 shingles lie
    in each, as the sum tells little where parts are large; parts are nested, so coordinates of larger sets fold onto fewer."""
    bits = min(max(3, int(np.ceil(np.log2(len(shingles) / 4)))), 16)
    at = (mix(shingles ^ np.uint64(0x0123456789ABCDEF)) >> np.uint64(64 - bits)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=1 << bits), 255).astype(np.uint8).tobytes()


def folded(coords: bytes, parts: int) -> np.ndarray:
    return np.frombuffer(coords, np.uint8).reshape(parts, -1).sum(axis=1, dtype=np.int32)


_FLAT = "cell long, node long, doc_id long, text_hash long, n_shingles long, coords binary"


def _describe(k: int, percent: int):
    """A row for each document (n_shingles is not null; coords only where its set is new to the task), and one for each cell of
    each new set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        task, done = mix(np.array([TaskContext.get().partitionId() + 1], np.uint64)), 0
        for batch in batches:
            data, starts, ends = text_column(batch.column("text"))
            sizes, nodes, coords, cell, of = [], [], [], [], []
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                shingles = shingle_set(word_hashes(data[a:b]), k)
                sizes.append(len(shingles))
                nodes.append(_set_hash(shingles) if len(shingles) else None)
                coords.append(None)
                if len(shingles) and nodes[-1] not in seen:
                    seen.add(nodes[-1])
                    coords[-1] = coordinates(shingles)
                    own = cells(shingles, percent).view(np.int64)
                    cell.append(own)
                    of.append(np.full(len(own), nodes[-1], np.int64))
            spread = mix(task + np.arange(done, done + len(sizes), dtype=np.uint64)).view(np.int64)  # a key for each row of the input
            done += len(sizes)
            columns = [pa.array(spread), pa.array(nodes, pa.int64()), batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(coords, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["cell", "node", "doc_id", "text_hash", "n_shingles", "coords"])
            if cell:
                x, y = np.concatenate(cell), np.concatenate(of)
                for a in range(0, len(x), ROWS_OUT):
                    part = x[a : a + ROWS_OUT]
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(y[a : a + ROWS_OUT]), *(pa.nulls(len(part), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["cell", "node", "doc_id", "text_hash", "n_shingles", "coords"])

    return run


def _near(percent: int):
    """Links the members of each group of cells whose coordinates let them be partners; a spanning forest of these links."""

    def links(nodes: dict[int, tuple[int, bytes, bool]]) -> list[tuple[int, int]]:
        if len(nodes) < 2:
            return []
        if len(nodes) == 2:
            (a, (n, x, _)), (b, (m, y, _)) = nodes.items()
            return [(a, b)] if _may_link(n, x, m, y, percent) else []
        names = np.array(sorted(nodes, key=lambda x: nodes[x][0]), np.int64)
        sizes = np.array([nodes[x][0] for x in names.tolist()], np.int64)
        parts = min(len(c) for _, c, _ in nodes.values())
        at = np.stack([folded(nodes[x][1], parts) for x in names.tolist()])
        label, out = np.where([nodes[x][2] for x in names.tolist()], -1, np.arange(len(names))), []
        last = np.searchsorted(sizes, 100 * sizes // percent, side="right")
        for i in range(len(names) - 1):
            others = np.flatnonzero(label[i + 1 : last[i]] != label[i]) + i + 1
            if len(others):
                apart = np.abs(at[others] - at[i]).sum(axis=1)
                for j in others[apart * (100 + percent) <= (100 - percent) * (sizes[others] + sizes[i])].tolist():
                    if label[j] != label[i]:
                        out.append((int(names[i]), int(names[j])))
                        label[label == label[j]] = label[i]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes = None, {}
        for batch in batches:
            found: list[tuple[int, int]] = []
            for *key, node, n, coords, closed in zip(*(batch.column(c).to_pylist() for c in ("region", "x", "y", "node", "n_shingles", "coords", "closed")), strict=True):
                if key != now:
                    found += links(nodes)
                    now, nodes = key, {}
                nodes[node] = (n, coords, closed)
            yield _pairs(found)
        yield _pairs(links(nodes))

    return run


def _heavy(members: DataFrame, weight: str, most: int, name: str) -> DataFrame:
    """(region) of those that weigh more than a task may hold."""
    return staged(members.groupBy("region").agg(F.sum(weight).alias("w")).where(F.col("w") > most).select("region"), name)


def _closed(members: DataFrame, in_balls: Callable[[DataFrame, DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """members (staged): (region, node, ...) of heavy regions. Returns (region, node) of each region's closed part, and links (a, b).

    Some members are pivots, and in_balls(members, pivots) gives (region, node, pivot) for members linked with one. Pivots of the next
    turn come from those in no ball yet. Balls that share a member are one component; each region's largest is its closed part, of
    which no two members need comparing. The members of one region are many tasks throughout."""
    names, balls, turns = members.select("region", "node"), None, []
    left = names
    for turn in range(TURNS):
        seeds = [F.min(F.struct(F.xxhash64("node", F.lit(turn * PIVOTS + i)).alias("h"), "node"))["node"] for i in range(PIVOTS)]
        picks = staged(left.groupBy("region").agg(F.array_distinct(F.array(*seeds)).alias("p")).select("region", F.explode("p").alias("node")), "picks")
        pivots = staged(join_small(members, picks, ["region", "node"], "inner"), "pivots")
        found = staged(in_balls(members, pivots), "balls")
        discard(picks, pivots, *([left] if turn else []))
        turns.append(found)
        balls = found if balls is None else balls.union(found)
        left = staged(names.join(balls.select("region", "node").distinct(), ["region", "node"], "left_anti"), "left")
        if left.isEmpty():
            break
    links = staged(balls.select(F.col("node").alias("a"), F.col("pivot").alias("b")).where("a != b").distinct(), "ball_links")
    discard(left, *turns)
    roots = staged(names.join(components(links), "node", "left").select("region", "node", F.coalesce("root", "node").alias("root")), "ball_roots")
    largest = staged(roots.groupBy("region", "root").agg(F.count("*").alias("n")).groupBy("region").agg(F.max(F.struct("n", "root"))["root"].alias("root")), "largest")
    closed = staged(join_small(roots, largest, ["region", "root"], "inner").select("region", "node"), "closed")
    discard(roots, largest)
    return closed, links


def _deal(members: DataFrame, weight: str, most: int, heavy: DataFrame, closed: DataFrame | None) -> DataFrame:
    """closed: None if no region is heavy. members (region, node, ...) with closed and (x, y), the part of the region's work they go to: (0, 0), or, in a heavy region, each
    pair of blocks that holds the member's own, but for pairs of two closed blocks, whose members are linked already. Blocks are half as
    heavy as a region may be, so a pair weighs as much."""
    if closed is None:
        return members.withColumn("closed", F.lit(False)).withColumn("x", F.lit(0)).withColumn("y", F.lit(0))
    flagged = members.join(closed.withColumn("closed", F.lit(True)), ["region", "node"], "left").withColumn("closed", F.coalesce("closed", F.lit(False)))
    weigh = lambda which: F.ceil(2 * F.sum(F.when(which, F.col(weight)).otherwise(0)) / F.lit(most)).cast("int")
    blocks = join_small(flagged, heavy, ["region"], "left_semi").groupBy("region").agg(weigh(F.col("closed")).alias("shut"), weigh(~F.col("closed")).alias("open"))
    dealt = join_small(flagged, staged(blocks, "blocks"), ["region"], "left")
    dealt = dealt.withColumn("own", F.expr("case when open is null then 0 when closed then pmod(xxhash64(node), shut) else shut + pmod(xxhash64(node), open) end").cast("int"))
    others = "case when open is null then array(0) when closed and open = 0 then cast(array() as array<int>) when closed then sequence(shut, shut + open - 1) else sequence(0, shut + open - 1) end"
    dealt = dealt.withColumn("other", F.explode(F.expr(others)))
    return dealt.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other")).drop("own", "other", "shut", "open")


def _near_pivots(percent: int):
    """(region, node, pivot) for rows of a member beside a pivot whose coordinates let them be partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m, x, y = (batch.column(c).to_pylist() for c in ("n_shingles", "pivot_n", "coords", "pivot_coords"))
            hit = [_may_link(n[i], x[i], m[i], y[i], percent) for i in range(len(n))]
            yield batch.select(["region", "node", "pivot"]).filter(pa.array(hit, pa.bool_()))

    return run


def _may_link(n: int, x: bytes, m: int, y: bytes, percent: int) -> bool:
    parts = min(len(x), len(y))
    apart = int(np.abs(folded(x, parts) - folded(y, parts)).sum())
    return 100 * min(n, m) >= percent * max(n, m) and apart * (100 + percent) <= (100 - percent) * (n + m)


def _cell_balls(percent: int) -> Callable[[DataFrame, DataFrame], DataFrame]:
    def run(members: DataFrame, pivots: DataFrame) -> DataFrame:
        beside = pivots.select("region", F.col("node").alias("pivot"), F.col("n_shingles").alias("pivot_n"), F.col("coords").alias("pivot_coords"))
        return join_small(members, beside, ["region"], "inner").mapInArrow(_near_pivots(percent), "region long, node long, pivot long")

    return run


def _set_balls(percent: int) -> Callable[[DataFrame, DataFrame], DataFrame]:
    def run(members: DataFrame, pivots: DataFrame) -> DataFrame:
        beside = pivots.select("region", F.col("node").alias("pivot"), F.col("shingles").alias("pivot_shingles"))
        both = join_small(members, beside, ["region"], "inner").withColumn("both", F.size(F.array_intersect("shingles", "pivot_shingles")))
        return both.where(100 * F.col("both") >= percent * (F.size("shingles") + F.size("pivot_shingles") - F.col("both"))).select("region", "node", "pivot")

    return run


def _sets(k: int):
    """(region, node, shingles) from (region, node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts, ends = text_column(batch.column("text"))
            sets = [shingle_set(word_hashes(data[a:b]), k).view(np.int64) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("region"), batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["region", "node", "shingles"])

    return run


class _Forest:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)


class _Region:
    """Documents of one region with their shingles as small integers."""

    def __init__(self, sets: list[np.ndarray], percent: int) -> None:
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])
        flat = np.concatenate(sets)
        _, self.tokens, self.df = np.unique(flat, return_inverse=True, return_counts=True)
        self.percent, self.radius = percent, 1 - percent / 100
        self.mark = np.zeros(len(self.df), bool)
        self.forest = _Forest(len(sets))
        self.regions = self.depth = 0

    def of(self, i: int) -> np.ndarray:
        return self.tokens[self.offsets[i] : self.offsets[i + 1]]

    def distances(self, pivot: int, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Jaccard distances of members (none is empty) to the pivot, and whether each is linked with it."""
        self.mark[self.of(pivot)] = True
        lengths = self.sizes[members]
        ends = np.cumsum(lengths)
        at = np.repeat(self.offsets[members] - (ends - lengths), lengths) + np.arange(ends[-1])
        shared = np.add.reduceat(self.mark[self.tokens[at]].astype(np.int64), ends - lengths)
        self.mark[self.of(pivot)] = False
        union = lengths + self.sizes[pivot] - shared
        return 1 - shared / union, 100 * shared >= self.percent * union

    def groups(self) -> list[np.ndarray]:
        """Documents that share one of their rarest shingles: partners do, as a document misses at most a few of its own."""
        first: dict[int, int] = {}
        loose = _Forest(len(self.sizes))
        for i in range(len(self.sizes)):
            own = self.of(i)
            missing = len(own) - -(-self.percent * len(own) // 100)
            own = own[np.lexsort((own, self.df[own]))][: missing + 1]
            for t in own[self.df[own] > 1].tolist():
                loose.join(first.setdefault(t, i), i)
        roots = np.array([loose.find(i) for i in range(len(self.sizes))])
        order = np.argsort(roots, kind="stable")
        return [g for g in np.split(order, np.flatnonzero(np.diff(roots[order])) + 1) if len(g) > 1]

    def link(self, x: int, others: np.ndarray) -> None:
        for y in others.tolist():
            self.forest.join(x, y)

    def voronoi(self, members: np.ndarray) -> None:
        """Links the members, region by region."""
        todo = [(members, 1)]
        while todo:
            members, depth = todo.pop()
            if len(members) < 2:
                continue
            self.regions, self.depth = self.regions + 1, max(self.depth, depth)
            to, balls, pivot = [], [], int(members[0])
            while True:
                far, linked = self.distances(pivot, members)
                to.append(far)
                balls.append(linked)
                self.link(pivot, members[linked])
                outside = ~np.any(balls, axis=0)
                if len(to) == PIVOTS or not outside.any():
                    break
                pivot = int(members[np.argmax(np.where(outside, np.min(to, axis=0), -1.0))])
            for far, ball in zip(to, balls, strict=True):
                self.shell(members, far, ball)
            rest = members[outside]
            parts = self.parts(np.array(to)[:, outside]) if len(rest) > 1 else []
            if sum(map(np.count_nonzero, parts)) > len(members) and (max(map(np.count_nonzero, parts)) > 0.7 * len(rest) or sum(map(np.count_nonzero, parts)) > 2 * len(rest)):
                parts = [np.ones(len(rest), bool)]  # the windows hold nearly all: no border to part them at
            todo += [(rest[p], depth + 1) for p in parts]

    def parts(self, to: np.ndarray) -> list[np.ndarray]:
        """The Voronoi regions of the pivots, out to a distance t, and the region beyond, each with its window. to: pivot x member.

        Of a linked pair x, y let p be x's nearest pivot. If both are farther than t from all pivots, the region beyond holds
        both. Else let x be within t. Then d(y,p) <= d(x,p) + r <= t + r, and for each pivot q d(y,p) <= d(x,q) + r <=
        d(y,q) + 2r: so p's region with a window of r at its rim and of 2r at its borders holds both. t is where the
        windows hold least."""
        near, r = to.min(axis=0), self.radius + 1e-9
        regions = lambda t: [(d <= t + r) & (d <= near + 2 * r) for d in to] + [near > t]
        return min((regions(t) for t in np.linspace(self.radius, 1, 12)), key=lambda x: (sum(map(np.count_nonzero, x)), max(map(np.count_nonzero, x))))

    def shell(self, members: np.ndarray, far: np.ndarray, ball: np.ndarray) -> None:
        """Compares members at most two radii from a pivot with its ball, as far as d(x,p) >= d(y,p) - r, until a link is found."""
        inside, at = members[ball], far[ball]
        for i in np.flatnonzero(~ball & (far <= 2 * self.radius + 1e-9)).tolist():
            y = int(members[i])
            if self.forest.find(y) != self.forest.find(int(inside[0])):
                near = inside[at >= far[i] - self.radius - 1e-9]
                if len(near) and (hit := near[self.distances(y, near)[1]]).size:
                    self.forest.join(y, int(hit[0]))

    def roots(self) -> list[int]:
        for group in self.groups():
            self.voronoi(group)
        return [self.forest.find(i) for i in range(len(self.sizes))]


def _join_regions(k: int, percent: int):
    def links(nodes: dict[int, tuple[np.ndarray, bool]]) -> list[tuple[int, int]]:
        names = sorted(nodes)
        if len(names) < 2:
            return []
        region = _Region([nodes[x][0] for x in names], percent)
        shut = [i for i, x in enumerate(names) if nodes[x][1]]
        if shut:
            region.link(shut[0], np.array(shut))
        return [(names[i], names[r]) for i, r in enumerate(region.roots()) if r != i]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes = None, {}
        for batch in batches:
            data, starts, ends = text_column(batch.column("text"))
            found: list[tuple[int, int]] = []
            for i, (*key, closed) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("region", "x", "y", "closed")), strict=True)):
                if key != now:
                    found += links(nodes)
                    now, nodes = key, {}
                shingles = shingle_set(word_hashes(data[starts[i] : ends[i]]), k)
                if len(shingles):
                    nodes[_set_hash(shingles)] = (shingles, closed)
            yield _pairs(found)
        yield _pairs(links(nodes))

    return run


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, region_shingles: int = REGION_SHINGLES, cell_members: int = CELL_MEMBERS) -> DataFrame:
    """Returns (doc_id, n_shingles, component_id), a row per row of docs (doc_id long, text string, other columns ignored).

    Texts are lower-cased (A-Z only); words are runs without white space. Two documents link when their sets of distinct
    k-word shingles have a Jaccard similarity of percent / 100 or more. component_id is the least doc_id reachable.
    A null text, or one without words, has 0 shingles, links with nothing and is its own component; a text of fewer
    than k words is one shingle. Rows with the same doc_id are compared by their texts like any others; rows with a null
    doc_id take part, and a component of these alone has a null id. An empty table gives no rows.

    Sets are known by 64-bit hashes. Texts with equal sets are one node, so copies cost one set however many they are."""
    return _components(docs, k, percent, region_shingles, cell_members).select("doc_id", "n_shingles", "component_id")


def _row() -> Column:
    """What tells rows with different texts apart, whether or not they have a doc_id; rows with one come first."""
    return F.struct(F.col("doc_id").isNull().alias("nameless"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), F.col("text_hash"))


def _hot_cells(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """Cells that hold many sets, as a sample of the texts shows. It decides how rows are dealt to tasks, never what is compared."""
    some = rows.where(F.pmod("text_hash", F.lit(HOT_ONE_IN)) == 0).mapInArrow(_describe(k, percent), _FLAT).where("n_shingles is null")
    some = some.select("cell", "node").distinct().groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") >= HOT_SEEN)
    return staged(some.select(F.col("cell").alias("hot")), "hot_cells")


def _components(docs: DataFrame, k: int, percent: int, region_shingles: int = REGION_SHINGLES, cell_members: int = CELL_MEMBERS) -> DataFrame:
    """As jaccard_components, with text_hash of each row and kept_hash, the text_hash of its component's least (doc_id, text_hash)."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    hot = _hot_cells(rows, k, percent)
    flat = join_small(rows.mapInArrow(_describe(k, percent), _FLAT).withColumn("hot", F.when(F.col("n_shingles").isNull(), F.col("cell"))), hot.withColumn("is_hot", F.lit(True)), ["hot"], "left")
    # cells with the same members are one group; a cell's members are known by the sum of their hashes
    mark = F.xxhash64("node").bitwiseAND(F.lit((1 << 40) - 1))
    cell = Window.partitionBy("cell", "part")
    flat = flat.withColumn("part", F.when(F.col("is_hot"), F.pmod(F.xxhash64("node"), F.lit(HOT_PARTS))).otherwise(0))
    flat = flat.withColumn("least", F.min("node").over(cell)).withColumn("most", F.max("node").over(cell)).withColumn("region", F.sum(mark).over(cell))
    flat = flat.withColumn("hot", F.when(F.col("is_hot"), F.col("cell"))).where("n_shingles is not null or is_hot or least != most")
    flat = staged(flat.drop("cell", "part", "least", "most", "is_hot"), "cells")
    described = flat.where("n_shingles is not null")
    in_hot = flat.where("n_shingles is null and hot is not null").select("hot", "node").distinct()
    regions = in_hot.groupBy("hot").agg(F.sum(mark).alias("region"))
    groups = flat.where("n_shingles is null and hot is null").select("region", "node").union(join_small(in_hot, regions, ["hot"], "inner").select("region", "node")).distinct()
    groups = staged(groups, "groups")
    known = described.where("coords is not null").groupBy("node").agg(F.first("n_shingles").alias("n_shingles"), F.first("coords").alias("coords"))
    heavy, closed, balls = _heavy(groups.withColumn("one", F.lit(1)), "one", cell_members, "large_groups"), None, None
    if not heavy.isEmpty():
        members = staged(join_small(groups, heavy, ["region"], "left_semi").join(known, "node"), "members")
        closed, balls = _closed(members, _cell_balls(percent))
        discard(members)
    first = _deal(groups.withColumn("one", F.lit(1)), "one", cell_members, heavy, closed).drop("one").join(known, "node")
    near = first.repartition("region", "x", "y").sortWithinPartitions("region", "x", "y").mapInArrow(_near(percent), "a long, b long")
    region = components(near if balls is None else near.union(balls))
    discard(hot, groups)
    kept = described.where("node is not null")
    nodes = kept.groupBy("node").agg(F.min(_row()).alias("row"), F.first("n_shingles").alias("n"), F.count("*").alias("copies"))
    nodes = staged(nodes.join(region, "node", "left").withColumnRenamed("root", "region"), "nodes")
    texts = rows.select(_row().alias("row"), "text").select("row.*", "text")
    if kept.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():  # rows that equal each other count once
        texts = texts.dropDuplicates(["nameless", "id", "text_hash"])
    inner = nodes.where("region is not null")
    heavy, closed, balls = _heavy(inner, "n", region_shingles, "large_regions"), None, None
    if not heavy.isEmpty():
        found = staged(join_small(inner, heavy, ["region"], "left_semi").select("row.*", "region", "node"), "heavy_nodes")
        members = join_small(texts, found, ["nameless", "id", "text_hash"], "inner").select("region", "node", "text")
        members = staged(members.mapInArrow(_sets(k), "region long, node long, shingles array<long>"), "members")
        closed, balls = _closed(members, _set_balls(percent))
        discard(found, members)
    dealt = staged(_deal(inner, "n", region_shingles, heavy, closed).select("row.*", "region", "x", "y", "closed"), "dealt")
    texts = join_small(texts, dealt, ["nameless", "id", "text_hash"], "inner").select("region", "x", "y", "closed", "text")
    linked = texts.repartition("region", "x", "y").sortWithinPartitions("region", "x", "y").mapInArrow(_join_regions(k, percent), "a long, b long")
    linked = components(linked if balls is None else linked.union(balls))
    named = nodes.join(linked, "node", "left").select("node", "copies", F.coalesce("root", "node").alias("root"), F.when(~F.col("row.nameless"), F.struct(F.col("row.id").alias("doc_id"), F.col("row.text_hash").alias("text_hash"))).alias("least"))
    named = staged(named, "roots")
    least = staged(named.groupBy("root").agg(F.min("least").alias("least"), F.count("*").alias("n")), "least")
    named = staged(join_hot(named.select("node", "copies", "root"), least, "root", "n").select("node", "copies", "least"), "named")
    discard(nodes, dealt, least)
    own = described.select("doc_id", "text_hash", "n_shingles", "node")
    out = join_hot(own.where("node is not null"), named, "node", "copies")
    blank = own.where("node is null").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("kept_hash"))
    return out.select("doc_id", "text_hash", "n_shingles", F.col("least.doc_id").alias("component_id"), F.col("least.text_hash").alias("kept_hash")).union(blank)


def without_near_copies(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component: the least doc_id's, and of rows that repeat it, one; its columns are those of docs. A row
    goes by its own text: another one under its doc_id, in another component, stays. Rows without shingles or without doc_id stay."""
    text_hash = fresh(docs, "text_hash")
    found = staged(_components(docs, k, percent), "components").withColumnRenamed("text_hash", text_hash)
    found = found.where("n_shingles > 0 and doc_id is not null")
    rows = found.groupBy("doc_id", text_hash, "component_id", "kept_hash").agg(F.count("*").alias("n"))
    least = (F.col("doc_id") == F.col("component_id")) & (F.col(text_hash) == F.col("kept_hash"))
    repeated = rows.where((F.col("n") > 1) & least).select("n").limit(1).count() > 0
    gone = staged(rows.where(~least).select("doc_id", text_hash), "gone")
    out = join_small(docs.withColumn(text_hash, F.xxhash64(F.col("text").cast("string"))), gone, ["doc_id", text_hash], "left_anti")
    if repeated:
        blank = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")) == 0
        out = out.where(F.col("doc_id").isNull() | blank).unionByName(out.where(F.col("doc_id").isNotNull() & ~blank).dropDuplicates(["doc_id", text_hash]))
    return out.select(docs.columns)
