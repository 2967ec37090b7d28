"""Benchmark decontamination by pigeonhole edit matching.

A test item of L characters may be found with up to k = floor(rate * L) edits. It is split into
k + 1 pieces; wherever it occurs with k edits or fewer, one piece occurs unchanged. All pieces
go into one automaton that runs over every whole document once; each exact piece hit fixes a
window, and Myers' bit-parallel algorithm finds the least edit distance of the item in it.

The items are taken in blocks of bounded size, each broadcast to one pass over the documents,
so a benchmark of any size fits in memory. Nothing is grouped or shuffled except the found rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of an item's characters that may differ.
ERROR_RATE = 0.08
#: Characters of items in one block.
BLOCK_CHARS = 4 << 20
FOUND = "doc_id long, item_id long, n_edits int, n_places int, first_end long"


def normalised(text: str) -> str:
    """A-Z lower-cased, runs of ``[\\x20\\x09-\\x0D]`` as one space, none at the ends."""
    return b" ".join(text.encode("utf-8", "replace").lower().split()).decode("utf-8")


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """The item in k + 1 pieces of nearly equal length, each with its offset."""
    n, out = len(item), []
    for i in range(k + 1):
        a, b = i * n // (k + 1), (i + 1) * n // (k + 1)
        out.append((a, item[a:b]))
    return out


def myers(pattern_masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(least edit distance of the pattern to any substring of the text, where the first such ends).

    Myers (1999): the column of differences is a pair of bit vectors, here Python integers of any
    length; pattern_masks has for each character the bits of its places in the pattern.
    """
    full, last = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, char in enumerate(text, 1):
        eq = pattern_masks.get(char, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | (full & ~(diagonal | plus))
        down = plus & diagonal
        if up & last:
            score += 1
        elif down & last:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus = down | (full & ~(diagonal | up))
        minus = up & diagonal
        if score < best:
            best, end = score, j
    return best, end


def masks(item: str) -> dict[str, int]:
    found: dict[str, int] = {}
    for i, char in enumerate(item):
        found[char] = found.get(char, 0) | 1 << i
    return found


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items, self.automaton = [], ahocorasick.Automaton()
        by_piece: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            if not (item := normalised(text)):
                continue
            k = int(rate * len(item))
            for at, piece in pieces(item, k):
                by_piece.setdefault(piece, []).append((len(self.items), at))
            self.items.append((item_id, k, len(item), masks(item)))
        for piece, places in by_piece.items():
            self.automaton.add_word(piece, (len(piece), places))
        if by_piece:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, least edits, distinct places, end of the first in the normalised text)."""
        if not self.items:
            return []
        hits: dict[int, list[int]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for n, at in places:
                hits.setdefault(n, []).append(end + 1 - size - at)
        found = []
        for n, starts in hits.items():
            item_id, k, m, item_masks = self.items[n]
            starts.sort()
            best, ends, i = m + 1, [], 0
            while i < len(starts):
                # piece hits of nearly the same place share one window
                low = high = starts[i]
                while i < len(starts) and starts[i] <= high + 2 * k:
                    high = starts[i]
                    i += 1
                a = max(0, low - k)
                edits, end = myers(item_masks, m, text[a : high + m + k])
                if edits <= k:
                    best = min(best, edits)
                    ends.append(a + end)
            if ends:
                found.append((item_id, best, len(set(ends)), min(ends)))
        return found


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, without ever holding them all."""
    block, n = [], 0
    for item_id, text in items.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null").toLocalIterator():
        block.append((item_id, text))
        n += len(text)
        if n >= BLOCK_CHARS:
            yield block
            block, n = [], 0
    if block:
        yield block


def find_items(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """(doc_id, item_id, n_edits, n_places, first_end) for each item found in a document.

    Both texts are compared with A-Z lower-cased and white space as single spaces; first_end is an
    offset into that form of the document. Null or blank texts and items match nothing, null ids
    of items are skipped, a null doc_id is reported as null; rows that repeat an id are searched
    each on their own. Empty tables give an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_edits", pa.int32()), ("n_places", pa.int32()), ("first_end", pa.int64())])
    out = None
    for block in _blocks(items):
        shared = spark.sparkContext.broadcast(block)  # BLOCK_CHARS at most

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, rate)
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if (text := text.as_py()) is not None:
                        rows += [(doc_id, *x) for x in matcher.find(normalised(text))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        part = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(search, FOUND)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], FOUND) if out is None else out


def decontaminate(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """``docs`` without the documents in which an item is found; rows with a null doc_id stay."""
    from spreadwatch.llm.common import scratch

    found = scratch(find_items(docs, items, rate).select("doc_id").distinct(), "contaminated")
    return docs.join(found, "doc_id", "left_anti")


def op4_decontaminate(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
