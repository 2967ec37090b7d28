"""N-gram Jaccard join through count vectors, an R-tree bound and exact verification.

A document is the set of its distinct word shingles. Two documents link when
``100 * |A & B| >= percent * |A | B|``. The join returns the connected components of the links.

*Count vectors.* Shingles hash into groups; a document is the point of its group counts. The
overlap of two documents is at most the sum of their points' coordinate minima.

*Cells.* The coordinates of a point are put in one order for all documents: groups that the whole
corpus fills least come first. A link leaves so few shingles of a set of size n unshared that both
sets hold an equal shingle among their first n - ceil(n * percent / 100) + 1 in that order. Each of
those is a cell; linked documents meet in the cell of the first shingle they share, where what
follows in either set bounds their overlap. A cell is about a shingle that documents hold, so
unrelated documents don't meet, and frequent passages, which come last, form no cells as long as a
document has rarer words. Any order gives the same links; the totals only keep cells small.

*No pairs within groups.* Documents with equal sets are one node from the start. A cell of m nodes
proposes m - 1 pairs with one of its nodes; groups of near copies join through those. Only cells
that still hold nodes of different components are searched, and only across components: a small
cell is one leaf; a large one is an R-tree whose leaves have upper corners, and whatever summed
coordinate minima with a corner refuse is skipped.

*Bounded tasks.* Texts are read once, into a table of sets; everything after works on that. Cells
are counted with partial aggregation and met in joins that Spark can split. In an unresolved large
cell those outside its largest component ask, in chunks, the chunks of all its nodes, one pair of
chunks at a time. Only sets of nodes in pairs that passed the bounds are moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadwatch.llm.common import KeyBitmap, connected_components, discard, scratch

#: Groups of the count vector that is kept per document, and of the shorter ones that are looked at first.
GROUPS, COARSE = 512, 64
#: Shingles of sets that go out together.
FLUSH_SHINGLES = 1 << 18
#: Groups whose totals make one row.
SLICE = 1 << 12
#: Nodes of a cell that are scanned without a tree; nodes of a leaf; nodes of a large cell that ask or are asked together.
SMALL, LEAF, CHUNK = 64, 32, 1024
ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
#: Which node of a cell stands for it: the least after flipping these bits, by the cell's number modulo three.
TURNS = (0, 0x2AAAAAAAAAAAAAAA, 0x1555555555555555)


def mix64(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers one to one (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = np.cumprod(np.full(1 << 12, 0x100000001B3, dtype=np.uint64))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.cumprod(np.full(1 << n.bit_length(), 0x100000001B3, dtype=np.uint64))
    return _POWERS


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct word shingles.

    A-Z are lower-cased, words are runs of characters outside ``[\\x20\\x09-\\x0D]``. A text of
    fewer words is one shingle of all of them; without words there is none.
    """
    data = np.frombuffer((text or "").encode("utf-8", "replace").lower(), np.uint8)
    inside = (data != 32) & ((data < 9) | (data > 13))
    letters = data[inside]
    if not len(letters):
        return np.zeros(0, dtype=np.uint64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = np.flatnonzero(first[inside])
    sizes = np.diff(np.append(starts, len(letters)))
    place = np.arange(len(letters)) - np.repeat(starts, sizes)
    weighed = (letters.astype(np.uint64) + np.uint64(1)) * _powers(int(sizes.max()))[place]
    hashed = mix64(np.add.reduceat(weighed, starts) + sizes.astype(np.uint64) * ODD[0])
    n = min(words, len(hashed))
    total = np.full(len(hashed) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        total = mix64(total * ODD[1] + hashed[k : len(hashed) - n + 1 + k])
    return np.unique(total)


def name_of(hashes: np.ndarray) -> tuple[int, int]:
    """A 128-bit name of a set, as two longs."""
    sums = np.array([mix64(hashes ^ ODD[2]).sum(), mix64(hashes ^ ODD[3]).sum()], dtype=np.uint64)
    a, b = mix64(sums + np.uint64(len(hashes))).view(np.int64)
    return int(a), int(b)


def prefix_size(n: int, percent: int) -> int:
    """How many of the first shingles of a set of size n every linked set must meet."""
    return n + (-percent * n) // 100 + 1 if n else 0


def narrow(counts: np.ndarray) -> bytes:
    """Counts in one, two or four bytes each, as the largest needs."""
    return counts.astype(np.min_scalar_type(int(counts.max()))).tobytes()


def vector_of(hashes: np.ndarray) -> bytes:
    """The group counts of a set."""
    return narrow(np.bincount((hashes & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS))


def points_of(vectors: list[bytes], groups: int = GROUPS) -> np.ndarray:
    """One row per vector, as wide as the widest needs."""
    if all(len(v) == groups for v in vectors):
        return np.frombuffer(b"".join(vectors), np.uint8).reshape(-1, groups)
    return np.stack([np.frombuffer(v, f"u{len(v) // groups}").astype(np.uint32) for v in vectors])


def coarse(points: np.ndarray) -> np.ndarray:
    """The points with groups put together to COARSE; minima summed over these bound more loosely."""
    return points.reshape(len(points), COARSE, -1).sum(axis=2, dtype=np.uint32)


def needed(a, b, percent: int):
    """The least overlap with which sets of sizes a and b link."""
    return -((-percent * (a + b)) // (100 + percent))


def may_meet(n_a, rest_a, n_b, rest_b, percent: int):
    """Whether sets may link whose first shared shingle has ``rest`` of each set from it on."""
    fits = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    return fits & (np.minimum(rest_a, rest_b) >= needed(n_a, n_b, percent))


# ---- sets and points


SETS = "rid long, doc_id long, n long, name_a long, name_b long, shingles array<long>"


def _sets(words: int):
    def pack(rows: list[tuple], found: list[np.ndarray]) -> pa.RecordBatch:
        offsets = np.cumsum([0] + [len(x) for x in found])
        flat = np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))
        columns = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
        return pa.RecordBatch.from_arrays([*columns, lists], ["rid", "doc_id", "n", "name_a", "name_b", "shingles"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found, n = [], [], 0
            for rid, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = shingles(text.as_py(), words)
                rows.append((rid, doc_id, len(own), *name_of(own)))
                found.append(own)
                n += len(own)
                if n >= FLUSH_SHINGLES:
                    yield pack(rows, found)
                    rows, found, n = [], [], 0
            if rows:
                yield pack(rows, found)

    return run


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of the shingles of a batch."""
    column = batch.column("shingles")
    return column.flatten().to_numpy().view(np.uint64), column.offsets.to_numpy() - column.offsets[0].as_py()


def group_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The fine group of a shingle; other bits than those of the count vector."""
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def group_totals(sets: DataFrame, bits: int) -> np.ndarray:
    """How often the corpus fills each of 2**bits fine groups, one byte each in steps of a sixteenth of a doubling.

    A task sends one row per slice of groups; the driver gets one byte a group, 2**24 at most.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(1 << bits, dtype=np.uint32)
        for batch in batches:
            values, _ = _lists(batch)
            at, n = np.unique(group_of(values, bits), return_counts=True)
            totals[at] += n.astype(np.uint32)
        for i in range(0, len(totals), SLICE):
            part = totals[i : i + SLICE]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i // SLICE], pa.int32()), pa.array([narrow(part)], pa.binary())], ["slice", "counts"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(SLICE, dtype=np.uint64)
        for x in table.column("counts"):
            total += np.frombuffer(x.as_py(), f"u{len(x.as_py()) // SLICE}")
        steps = np.minimum(255, np.round(5.3 * np.log2(1 + total.astype(float)))).astype(np.uint8)
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "steps": pa.array([steps.tobytes()], pa.binary())})

    table = sets.select("shingles").mapInArrow(count, "slice int, counts binary").groupBy("slice").applyInArrow(add, "slice int, steps binary").toArrow()
    out = np.zeros(1 << bits, dtype=np.uint8)
    for i, steps in zip(table.column("slice").to_pylist(), table.column("steps").to_pylist(), strict=True):
        out[i * SLICE : (i + 1) * SLICE] = np.frombuffer(steps, np.uint8)
    return out


def first_in_order(hashes: np.ndarray, totals: np.ndarray, bits: int, percent: int) -> np.ndarray:
    """The cells of a set: its first shingles by the totals of their groups, then by hash."""
    key = (totals[group_of(hashes, bits)].astype(np.uint64) << np.uint64(56)) | (hashes >> np.uint64(8))
    return hashes[np.argsort(key, kind="stable")[: prefix_size(len(hashes), percent)]]


POINTS = "rid long, v binary, low binary, cells array<long>"


def _points(percent: int, bits: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = _lists(batch)
            vectors, cells = [], []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                vectors.append(vector_of(values[a:b]))
                cells.append(first_in_order(values[a:b], shared.value, bits, percent))
            low = [narrow(x) for x in coarse(points_of(vectors))] if vectors else []
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(x) for x in cells]), pa.int32()), pa.array(np.concatenate([*cells, np.zeros(0, np.uint64)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(vectors, pa.binary()), pa.array(low, pa.binary()), lists], ["rid", "v", "low", "cells"])

    return run


# ---- the index within cells


class RTree:
    """Points packed by size and then by their first coordinates into leaves under upper corners."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, percent: int):
        self.points, self.sizes, self.percent, self.low = points, sizes, percent, coarse(points)
        order = np.lexsort((self.low[:, 1], self.low[:, 0], sizes // 8))
        self.leaves = [order[i : i + LEAF] for i in range(0, len(order), LEAF)]
        self.upper = np.stack([self.low[x].max(axis=0) for x in self.leaves])
        self.smallest = np.array([sizes[x].min() for x in self.leaves])
        self.largest = np.array([sizes[x].max() for x in self.leaves])

    def search(self, point: np.ndarray, low: np.ndarray, size: int, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of allowed points that may link with the asked one, their largest possible overlaps)."""
        near = np.flatnonzero((self.smallest * self.percent <= size * 100) & (self.largest * 100 >= size * self.percent))
        # the least overlap any point of a leaf needs is that of its smallest
        near = near[np.minimum(self.upper[near], low).sum(axis=1) >= needed(self.smallest[near], size, self.percent)]
        if not len(near):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = np.concatenate([self.leaves[i] for i in near])
        found = found[allowed[found]]
        found = found[np.minimum(self.low[found], low).sum(axis=1) >= needed(self.sizes[found], size, self.percent)]
        most = np.minimum(self.points[found], point).sum(axis=1, dtype=np.int64)
        keep = most >= needed(self.sizes[found], size, self.percent)
        return found[keep], most[keep]


def cell_pairs(points: np.ndarray, sizes: np.ndarray, rest: np.ndarray, groups: np.ndarray, n: int, percent: int, best_only: bool) -> np.ndarray:
    """Index pairs of different groups that may link, as two rows: the first n points are indexed, the others ask.

    rest: of each set what follows from the cell's shingle on. With best_only each two groups
    propose their pair of largest relative bound alone.
    """
    tree, low = RTree(points[:n], sizes[:n], percent), coarse(points[n:])
    out, most = [np.zeros((2, 0), np.int64)], [np.zeros(0)]
    for q in range(n, len(points)):
        allowed = (groups[:n] != groups[q]) & may_meet(sizes[:n], rest[:n], sizes[q], rest[q], percent)
        if allowed.any():
            found, bound = tree.search(points[q], low[q - n], int(sizes[q]), allowed)
            out.append(np.stack([found, np.full(len(found), q)]))
            most.append(bound / (sizes[found] + sizes[q]))
    pairs, most = np.concatenate(out, axis=1), np.concatenate(most)
    if best_only and len(most):
        two = np.sort(groups[pairs], axis=0)
        order = np.lexsort((-most, two[1], two[0]))
        first = np.ones(len(order), dtype=bool)
        first[1:] = (two[:, order[1:]] != two[:, order[:-1]]).any(axis=0)
        pairs = pairs[:, order[first]]
    return pairs


def _ordered(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    two = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(two[0], pa.int64()), pa.array(two[1], pa.int64())], ["a", "b"])


def _whole_runs(batches: Iterator[pa.RecordBatch], key: list[str], at_least: int) -> Iterator[pa.Table]:
    """Rows that come sorted by ``key`` in tables of about ``at_least`` rows which never cut a run of equal keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) < at_least:
            continue
        table = pa.Table.from_batches(held)
        change = np.zeros(len(table) - 1, dtype=bool)
        for c in key:
            x = table.column(c).to_numpy()
            change |= x[1:] != x[:-1]
        if len(last := np.flatnonzero(change)):
            cut = int(last[-1]) + 1
            yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _scan_small(percent: int):
    """Rows (cell, id, n, i, component) sorted by cell to pairs across components that may meet there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_runs(batches, ["cell"], 20_000):
            cell, node, n, i, component = (table.column(c).to_numpy() for c in ("cell", "id", "n", "i", "component"))
            rest, here, k, a, b = n - i, np.arange(len(cell)), 1, [], []
            while True:  # each row with the k-th after it, as long as that is in its cell
                here = here[here < len(cell) - k]
                here = here[cell[here] == cell[here + k]]
                if not len(here):
                    break
                there = here + k
                good = (component[here] != component[there]) & may_meet(n[here], rest[here], n[there], rest[there], percent)
                a.append(node[here[good]])
                b.append(node[there[good]])
                k += 1
            if a:
                yield _ordered(np.concatenate(a), np.concatenate(b))

    return run


def _search_large(percent: int, best_only: bool):
    """Rows of chunk pairs sorted by (cell, asks, asked, side) to pairs across components that may link."""
    key = ["cell", "asks", "asked"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_runs(batches, key, 2 * CHUNK):
            parts = [table.column(c).to_numpy() for c in key]
            change = np.any([x[1:] != x[:-1] for x in parts], axis=0) if len(table) > 1 else np.zeros(0, bool)
            edges = np.flatnonzero(np.concatenate(([True], change, [True])))
            side, sizes, i, node, component = (table.column(c).to_numpy() for c in ("side", "n", "i", "id", "component"))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                n = int((side[a:b] == 0).sum())
                if 0 < n < b - a:
                    points = points_of(table.column("v").slice(a, b - a).to_pylist())
                    two = cell_pairs(points, sizes[a:b], (sizes - i)[a:b], component[a:b], n, percent, best_only)
                    if two.shape[1]:
                        yield _ordered(*node[a:b][two])

    return run


def _large(open_rows: DataFrame, nodes: DataFrame, percent: int, best_only: bool) -> DataFrame:
    """Pairs (a, b) in the unresolved large cells: all that are outside a cell's largest component ask all of it."""
    rows = open_rows.where(F.col("m") > SMALL).select("cell", "id", "n", "i", "component")
    sizes = rows.groupBy("cell", "component").agg(F.count(F.lit(1)).alias("c"))
    cells = sizes.groupBy("cell").agg(F.max(F.struct("c", "component")).alias("top"), F.sum("c").alias("m"))
    cells = cells.select("cell", F.col("top.component").alias("main"), F.ceil((F.col("m") - F.col("top.c")) / CHUNK).cast("int").alias("n_asks"), F.ceil(F.col("m") / CHUNK).cast("int").alias("n_asked"))
    cells = scratch(cells, "large-cells")
    met = rows.join(cells, "cell")
    turn = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = met.select("cell", numbers("n_asks").alias("asks"), turn("n_asked").alias("asked"), F.lit(0).alias("side"), "id", "n", "i", "component")
    asks = met.where("component <> main").select("cell", turn("n_asks").alias("asks"), numbers("n_asked").alias("asked"), F.lit(1).alias("side"), "id", "n", "i", "component")
    both = asked.unionByName(asks).join(nodes.select("id", "v"), "id")
    both = both.repartition("cell", "asks", "asked").sortWithinPartitions("cell", "asks", "asked", "side")
    return both.mapInArrow(_search_large(percent, best_only), "a long, b long")


# ---- bounds and sets


def _bound(percent: int, groups: int = GROUPS):
    @F.pandas_udf("boolean")
    def may_link(n_a: pd.Series, n_b: pd.Series, v_a: pd.Series, v_b: pd.Series) -> pd.Series:
        if not len(n_a):
            return pd.Series([], dtype=bool)
        most = np.minimum(points_of(list(v_a), groups), points_of(list(v_b), groups)).sum(axis=1, dtype=np.int64)
        return pd.Series(most >= needed(n_a.to_numpy(np.int64), n_b.to_numpy(np.int64), percent))

    return may_link


def _verified(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of nodes those that link, by their counts first and then by their sets."""
    end = lambda c, v: nodes.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col(v).alias(f"v_{c}"))
    # the short vectors refuse most pairs, so that few carry whole ones through a shuffle
    near = pairs.join(end("a", "low"), "a").join(end("b", "low"), "b")
    near = near.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    near = near.where(_bound(percent, COARSE)("n_a", "n_b", "v_a", "v_b")).select("a", "b")
    likely = near.join(end("a", "v"), "a").join(end("b", "v"), "b").where(_bound(percent)("n_a", "n_b", "v_a", "v_b"))
    likely = scratch(likely.select("a", "b", "n_a", "n_b"), "likely")
    ends = likely.select(F.col("a").alias("rid")).union(likely.select("b"))
    # the bitmap lets some other sets through; the joins drop them
    maybe = KeyBitmap(ends, 2 * likely.count())
    wanted = scratch(sets.where(maybe.holds(F.col("rid"))).select("rid", "shingles"), "wanted")
    both = likely.join(wanted.select(F.col("rid").alias("b"), F.col("shingles").alias("s_b")), "b")
    both = both.join(wanted.select(F.col("rid").alias("a"), F.col("shingles").alias("s_a")), "a")
    shared = F.size(F.array_intersect("s_a", "s_b"))
    both = both.where(100 * shared >= percent * (F.col("n_a") + F.col("n_b") - shared))
    links = scratch(both.select("a", "b"), "links")
    discard(likely, wanted)
    return links


def _resolve(members: DataFrame, nodes: DataFrame, sets: DataFrame, links: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """(node, component) when every pair of different components that may link has been verified.

    Small cells are searched once, whole. In large ones the best pair of each two components comes
    first, which joins most that can be joined, then every pair that is left.
    """
    joined = connected_components(links)
    for best_only in (True, False):
        placed = members.where("m > 2" if best_only else f"m > {SMALL}").join(joined.withColumnRenamed("node", "id"), "id", "left")
        placed = scratch(placed.select("cell", "id", "n", "i", "m", F.coalesce("component", "id").alias("component")), "placed")
        mixed = placed.groupBy("cell").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        mixed = scratch(mixed.where("low <> high").select("cell"), "mixed")
        open_rows = scratch(placed.join(mixed, "cell"), "open")
        discard(placed, mixed)
        found = _large(open_rows, nodes, percent, best_only)
        if best_only:
            small = open_rows.where(F.col("m") <= SMALL).drop("m").repartition("cell").sortWithinPartitions("cell")
            found = found.unionByName(small.mapInArrow(_scan_small(percent), "a long, b long"))
        more = scratch(found.distinct().join(pairs, ["a", "b"], "left_anti"), "more")
        discard(open_rows)
        late = _verified(more, nodes, sets, percent)
        if late.limit(1).count():
            links = links.union(late)
            joined = connected_components(links)
        pairs = pairs.union(more)
    return joined


def ngram_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs``.

    component_id is the smallest doc_id that links reach, the row's own included. Null or blank
    text has no shingles and links with nothing. Documents with equal sets share a component. A
    row with a null doc_id links like any other; its component is the smallest known id, null if
    there is none. Rows that repeat a doc_id are treated each by its own text. An empty table
    gives an empty one; other columns are ignored.
    """
    texts = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = scratch(texts.mapInArrow(_sets(words), SETS), "sets")
    names = ["name_a", "name_b"]
    rows = sets.drop("shingles")
    n_rows = rows.count()
    # one row of each set stands for it: its rid is the node
    nodes = scratch(rows.where("n > 0").groupBy(*names).agg(F.min("rid").alias("id"), F.min("doc_id").alias("doc"), F.first("n").alias("n")), "names")
    bits = min(24, max(16, n_rows.bit_length() + 2))
    totals = docs.sparkSession.sparkContext.broadcast(group_totals(sets, bits))  # one byte a group
    points = sets.where("n > 0").select("rid", "shingles").mapInArrow(_points(percent, bits, totals), POINTS)
    points = scratch(points.withColumnRenamed("rid", "id").join(nodes.select("id", "n"), "id"), "points")
    cells = points.select("id", "n", F.posexplode("cells").alias("i", "cell"))
    flip = F.element_at(F.array(*map(F.lit, TURNS)), F.pmod("cell", F.lit(3)).cast("int") + 1)
    shared = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("m"), F.min(F.col("id").bitwiseXOR(flip)).alias("head"))
    shared = scratch(shared.where("m > 1").select("cell", "m", F.col("head").bitwiseXOR(flip).alias("head")), "shared")
    members = scratch(cells.join(shared, "cell"), "members")
    pairs = members.where("id <> head").select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b"))
    pairs = scratch(pairs.distinct(), "pairs")
    links = _verified(pairs, points, sets, percent)
    joined = _resolve(members, points, sets, links, pairs, percent)

    known = nodes.select("id", "doc", *names).join(joined.withColumnRenamed("node", "id"), "id", "left")
    known = scratch(known.withColumn("component", F.coalesce("component", "id")), "known")
    smallest = scratch(known.groupBy("component").agg(F.min("doc").alias("component_id")), "smallest")
    found = scratch(known.join(smallest, "component").select(*names, "component_id"), "found")
    out = rows.join(found, names, "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )
    out = scratch(out, "components")
    discard(sets, nodes, points, shared, members, pairs, known, smallest, found)
    return out


def keep_one_per_component(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest doc_id.

    Rows without a doc_id stay, and rows that repeat a doc_id stay or go together; null, blank and
    empty texts link with nothing and stay. An empty table gives an empty one.
    """
    found = ngram_components(docs, words, percent).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti")

def op2_ngram_jaccard(spark, sf_dir):
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4, percent=85)


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a
)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(other) AS component_id FROM reach r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
