"""The prefix trie of conversations, by an LCP-aware external mergesort.

Method: a turn becomes a 16-byte digest of its role and text, a conversation the string of its
turns' digests. Equal conversations are counted before anything is sorted, so a group of copies is
one row. The hash partitions of that step are sorted runs: each row carries the length of the
prefix (in turns) it shares with the row before it, its LCP. Runs are dealt into ranges of bounded
size; in a range a loser tree merges the pieces of all runs and compares turns only beyond what two
rows are known to share, so a shared turn is looked at once. The merged rows, with their LCPs, go
over a stack of open nodes: a node is finished, and emitted with its whole subtree's figures, when
a row shares less than its depth.

Scale: texts leave the executor that read them only as digests. Nodes on the first and the last
path of a range may go on in its neighbours; these few (two paths a range) are summed by their id
in Spark and meet their children again by (range, id), a key that no hot node can fill. The ids of
a node's conversations are hashed in ascending order from blocks of at most 256 ids.

One conversation's digests (20 bytes a turn) are one row: 10 million turns are 200 MB.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spreadwatch.llm.common import discard, scratch
from spreadwatch.llm.sql import CRC_TABLE, crc32

#: Bytes of a turn's digest.
UNIT = 16
#: Conversations share their first turns with the first of each so many ids.
FAMILY = 100
#: The most turns that are shared, plus one.
SHARED = 6
#: A block of ids spans two to this power.
BLOCK_BITS = 8
#: About how many bytes of keys and figures a range holds.
RANGE_BYTES = 16 << 20
#: Rows of an Arrow batch that a task returns.
ROWS = 2048
EMPTY = hashlib.sha256(b"").hexdigest()

RUN = "run int, pos long, key binary, lcp int, chars array<int>, n long, conv_id long, ends string"
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
PART = NODE + ", chars long, range int, id binary, parent_id binary, path array<binary>"


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, key, chars) of each conversation whose first turns are those of its family's first one.

    key holds the digests of its turns in order, chars their texts' code points. Turns go by turn
    (null first), equal ones by digest. Rows without a conv_id are left out. One exchange brings
    a family together.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * UNIT)
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    turns = conversations.where("conv_id is not null").select(family.alias("family"), "conv_id", F.struct("turn", digest.alias("hex"), F.length(text).alias("n")).alias("one"))
    own = turns.repartition("family").groupBy("family", "conv_id").agg(F.sort_array(F.collect_list("one")).alias("own"))
    head = F.first(F.when(F.col("conv_id") == F.col("family"), F.slice("own", 1, SHARED - 1)), ignorenulls=True).over(Window.partitionBy("family"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int")
    met = own.withColumns({"head": head, "h": h})
    rest = F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0)))
    path = met.select("conv_id", F.when(F.col("head").isNull(), rest).otherwise(F.concat(F.slice("head", F.lit(1), F.col("h")), rest)).alias("path"))
    return path.select("conv_id", F.unhex(F.array_join(F.transform("path", lambda x: x["hex"]), "")).alias("key"), F.transform("path", lambda x: x["n"]).alias("chars"))


def shared_turns(a: bytes, b: bytes, known: int = 0) -> int:
    """How many leading turns two keys share, ``known`` of which need no look."""
    at, most = known * UNIT, min(len(a), len(b))
    while at < most and a[at : at + UNIT] == b[at : at + UNIT]:
        at += UNIT
    return at // UNIT


def sorted_runs(paths: DataFrame) -> DataFrame:
    """Distinct conversations as sorted runs with LCPs, one run a partition: see ``RUN``.

    n, conv_id and ends are the number, the smallest and the hash of all ids of the equal ones.
    """
    blocks = paths.groupBy("key", F.shiftright("conv_id", BLOCK_BITS).alias("block")).agg(
        F.first("chars").alias("chars"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"),
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").cast("binary").alias("ids"),
    )
    ordered = blocks.repartition("key").sortWithinPartitions("key", "block").withColumn("run", F.spark_partition_id())
    names = [f.split()[0] for f in RUN.split(", ")]
    types = [pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.string()]

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, before, pos, open_ = [], b"", 0, None

        def close() -> None:
            nonlocal before, pos
            run, key, chars, n, first, ends = open_
            found.append((run, pos, key, shared_turns(before, key), chars, n, first, ends.hexdigest()))
            before, pos = key, pos + 1

        for batch in batches:
            for run, key, chars, n, first, ids in zip(*(batch.column(c).to_pylist() for c in ("run", "key", "chars", "n", "conv_id", "ids")), strict=True):
                if open_ is not None and open_[1] == key:
                    open_[3] += n
                    open_[5].update(b"," + ids)
                    continue
                if open_ is not None:
                    close()
                open_ = [run, key, chars, n, first, hashlib.sha256(ids)]
                if len(found) >= ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names)
                    found.clear()
        if open_ is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names)

    return ordered.mapInArrow(distinct, RUN)


class LoserTree:
    """Merges sorted sources of (key, lcp, row) into one such stream.

    ``lcp`` of a source's row is what it shares with the source's row before it; that of the
    merged stream with the row merged before it. Every waiting head knows what it shares with the
    last row merged, so of two heads the one that shares more comes first without a look at
    either key; only heads that share equally much are compared, from there on.
    """

    def __init__(self, sources: list[Iterator[tuple[bytes, int, tuple]]]):
        self.sources, k = sources, len(sources)
        self.heads = [next(s, None) for s in sources]
        self.lcp = [0] * k
        self.losers = [0] * k
        self.compared = 0
        winners = [*([0] * k), *range(k)]
        for node in range(k - 1, 0, -1):
            winners[node], self.losers[node] = self.duel(winners[2 * node], winners[2 * node + 1])
        self.winner = winners[1] if k > 1 else 0

    def duel(self, i: int, j: int) -> tuple[int, int]:
        """(winner, loser), with the loser's LCP brought up to the winner."""
        if self.heads[i] is None or self.heads[j] is None:
            return (j, i) if self.heads[i] is None else (i, j)
        if self.lcp[i] != self.lcp[j]:
            return (i, j) if self.lcp[i] > self.lcp[j] else (j, i)
        a, b = self.heads[i][0], self.heads[j][0]
        at = shared_turns(a, b, self.lcp[i])
        self.compared += at - self.lcp[i] + 1
        first, last = (i, j) if a[at * UNIT : (at + 1) * UNIT] < b[at * UNIT : (at + 1) * UNIT] else (j, i)
        self.lcp[last] = at
        return first, last

    def __iter__(self) -> Iterator[tuple[bytes, int, tuple]]:
        k = len(self.sources)
        while k and (head := self.heads[self.winner]) is not None:
            w = self.winner
            yield head[0], self.lcp[w], head[2]
            self.heads[w] = nxt = next(self.sources[w], None)
            self.lcp[w] = nxt[1] if nxt is not None else 0
            node = (k + w) // 2
            while node:
                w, self.losers[node] = self.duel(w, self.losers[node])
                node //= 2
            self.winner = w


class OpenNode:
    """A node whose subtree is still being read."""

    __slots__ = ("chars", "conv_id", "depth", "edge", "ends", "kids", "n_children", "n_convs", "n_leaves", "saved")

    def __init__(self, depth: int, chars: int, edge: bool):
        self.depth, self.chars, self.edge = depth, chars, edge
        self.n_convs = self.n_children = self.n_leaves = self.saved = 0
        self.conv_id, self.ends, self.kids = None, None, []

    def joined_by(self, n: int, conv_id: int) -> None:
        self.n_convs += n
        self.conv_id = conv_id if self.conv_id is None else min(self.conv_id, conv_id)


def trie_parts(merged: Iterator[tuple[bytes, int, tuple]], at: int) -> Iterator[tuple]:
    """Rows of ``PART`` from a merged range: finished nodes, and unfinished ones (with an id) of its first and last path.

    A finished node has parent_conv_id, or the parent's id where the parent is unfinished. Children
    wait for their parent, so no more of them are held than the range has.
    """
    stack: list[OpenNode] = []
    first = last = None

    def name(key: bytes, depth: int) -> bytes:
        return hashlib.blake2b(key[: depth * UNIT], digest_size=UNIT).digest()

    def close(key: bytes) -> Iterator[tuple]:
        node = stack.pop()
        up = stack[-1] if stack else None
        if up is not None:
            up.joined_by(node.n_convs, node.conv_id)
        if node.edge:
            ids = [name(key, d) for d in range(node.depth + 1)]
            for kid in node.kids:
                yield (*kid[:2], None, *kid[3:8], None, at, None, ids[-1], None)
            yield (node.conv_id, node.depth, None, node.n_convs, node.n_children, node.n_leaves, node.saved, node.ends, node.chars, at, ids[-1], ids[-2] if node.depth else None, ids)
            return
        node.n_leaves += not node.n_children
        node.saved += (node.n_convs - 1) * node.chars
        for kid in node.kids:
            yield (*kid[:2], node.conv_id, *kid[3:8], None, at, None, None, None)
        node.kids = []
        up.kids.append((node.conv_id, node.depth, None, node.n_convs, node.n_children, node.n_leaves, node.saved, node.ends or EMPTY))
        up.n_children += 1
        up.n_leaves += node.n_leaves
        up.saved += node.saved

    for key, lcp, (chars, n, conv_id, ends) in merged:
        if first is None:
            first, stack = key, [OpenNode(0, 0, True)]
        while len(stack) - 1 > lcp:
            yield from close(last)
        for depth in range(lcp + 1, len(key) // UNIT + 1):
            stack.append(OpenNode(depth, chars[depth - 1], key is first))
        stack[-1].joined_by(n, conv_id)
        stack[-1].ends, last = ends, key
    for node in stack:
        node.edge = True
    while stack:
        yield from close(last)


def _merge_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The merged trie of one range; its runs' pieces come one after another."""
    pieces: dict[int, list[pa.RecordBatch]] = {}
    at = 0
    for batch in batches:
        runs = batch.column("run").to_numpy()
        edges = [0, *(i for i in range(1, len(runs)) if runs[i] != runs[i - 1]), len(runs)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b > a:
                pieces.setdefault(int(runs[a]), []).append(batch.slice(a, b - a))
                at = batch.column("range")[a].as_py()

    def rows(parts: list[pa.RecordBatch]) -> Iterator[tuple[bytes, int, tuple]]:
        for part in parts:
            for low in range(0, part.num_rows, 256):
                cut = part.slice(low, 256)
                for key, lcp, *row in zip(*(cut.column(c).to_pylist() for c in ("key", "lcp", "chars", "n", "conv_id", "ends")), strict=True):
                    yield key, lcp, tuple(row)

    names = [f.split()[0] for f in PART.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary())}
    types = [kinds[f.split()[1]] for f in PART.split(", ")]
    found: list[tuple] = []

    def batch_of() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names)

    for row in trie_parts(iter(LoserTree([rows(p) for p in pieces.values()])), at):
        found.append(row)
        if len(found) >= ROWS:
            yield batch_of()
            found.clear()
    if found:
        yield batch_of()


def _stitched(parts: DataFrame) -> DataFrame:
    """(id, parent_id and the columns of NODE but parent_conv_id) of the nodes that ranges left unfinished."""
    unfinished = parts.where("id is not null").groupBy("id").agg(
        F.first("parent_id", ignorenulls=True).alias("parent_id"), F.first("path").alias("path"), F.first("depth").alias("depth"), F.first("chars").alias("chars"),
        F.min("conv_id").alias("conv_id"), F.max("ends_sha256").alias("ends"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    kids = unfinished.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("more"))
    known = unfinished.join(kids, "id", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    leaves = F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0)
    saved = F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("chars")
    sums = known.select(F.explode("path").alias("id"), leaves.alias("n_leaves"), saved.alias("saved_tokens")).groupBy("id").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    return known.drop("n_leaves", "saved_tokens").join(sums, "id").select(
        "id", "parent_id", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256")
    )


def prefix_trie(paths: DataFrame) -> DataFrame:
    """The nodes of the trie of ``paths`` (conv_id, key, chars), one row each: see ``NODE``.

    The root is one of them, with a null parent; a conversation without turns ends there. An empty
    table has no members and so no nodes. Equal conversations count as often as they occur.
    """
    names = StructType.fromDDL(NODE).names
    runs = scratch(sorted_runs(paths), "runs")
    size = runs.agg(F.sum(F.octet_length("key") + 4 * F.size("chars") + 128).alias("bytes")).first().bytes
    ranges = max(1, math.ceil((size or 0) / RANGE_BYTES))
    dealt = runs.repartitionByRange(ranges, "key").sortWithinPartitions("run", "pos").withColumn("range", F.spark_partition_id())
    parts = scratch(dealt.mapInArrow(_merge_range, PART), "trie-parts")
    discard(runs)
    edges = scratch(_stitched(parts), "trie-edges")
    above = edges.select(F.col("id").alias("parent_id"), F.col("conv_id").alias("parent_conv_id"))
    met = parts.where("id is not null").select("range", F.col("id").alias("parent_id")).join(above, "parent_id")
    finished = parts.where("id is null")
    inner = finished.where("parent_id is null").select(names)
    outer = finished.where("parent_id is not null").drop("parent_conv_id").join(met, ["range", "parent_id"]).select(names)
    return edges.join(above, "parent_id", "left").select(names).unionByName(outer).unionByName(inner)


def op13_prefix_trie(spark, sf_dir):
    return prefix_trie(rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")))


OP13_SQL = f"""
WITH {CRC_TABLE}, t AS (
  SELECT conv_id, length(coalesce(text, '')) AS chars, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, turn FROM conversations WHERE conv_id IS NOT NULL
), o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS p FROM t
), c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {crc32("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t), crc_table
), r AS (
  SELECT c.conv_id, 0 AS part, p, digest, chars FROM c JOIN o ON o.conv_id = c.base AND o.p <= c.h
  UNION ALL SELECT c.conv_id, 1, p, digest, chars FROM c JOIN o ON o.conv_id = c.conv_id AND o.p > c.h
), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, p) AS depth FROM r
), member AS (
  SELECT conv_id, depth, chars, array_to_string(list(digest) OVER (PARTITION BY conv_id ORDER BY depth), '') AS key FROM n
  UNION ALL SELECT conv_id, 0, 0, '' FROM c
), node AS (SELECT key, depth, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs FROM member GROUP BY key, depth
), kids AS (SELECT left(key, 64 * (depth - 1)) AS key, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1
), own AS (SELECT node.*, coalesce(n, 0) AS n_children FROM node LEFT JOIN kids USING (key)
), sub AS (
  SELECT a.key, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.chars) AS saved
  FROM own a JOIN own b ON b.depth >= a.depth AND left(b.key, 64 * a.depth) = a.key GROUP BY 1
), final AS (SELECT conv_id, max(depth) AS depth FROM member GROUP BY 1
), ends AS (SELECT key, sha256(string_agg(CAST(m.conv_id AS VARCHAR), ',' ORDER BY m.conv_id)) AS ends FROM member m JOIN final f ON f.conv_id = m.conv_id AND f.depth = m.depth GROUP BY key)
SELECT o.conv_id, CAST(o.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, o.n_convs, o.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM own o JOIN sub s USING (key) LEFT JOIN ends e USING (key) LEFT JOIN node u ON o.depth > 0 AND u.key = left(o.key, 64 * (o.depth - 1))
"""
