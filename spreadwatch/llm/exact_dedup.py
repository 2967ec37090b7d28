"""Exact dedup by mergeable counting quotient filters, then byte verification.

1. Each partition folds the 64-bit fingerprints of its normalised texts into counting quotient
   filters, one per shard of the fingerprint space: fingerprints sort, split into quotient (high
   bits) and remainder, and are laid out as an occupied bitmap over quotients, a run-end bitmap
   over slots, the remainders in order, and counters for those seen more than once.
2. Filters of one shard merge losslessly: decode, merge by sorted remainder, add the counters.
   A text that a third of all rows hold arrives as one counted slot per partition.
3. Fingerprints with a count above one route to byte verification: only those rows' texts are
   grouped by the normalised bytes themselves.

A fixed-size bitmap of the repeated fingerprints (see ``KeyBitmap``) keeps the other texts out of
the shuffle; the exact comparison does not depend on it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadwatch.llm.common import WHITE, KeyBitmap, scratch

#: Fingerprints folded into one set of filters before it is passed on.
BLOCK_ROWS = 1 << 20


def normalised(text: Column) -> Column:
    """The text without any character of ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def encode_filter(keys: np.ndarray, counts: np.ndarray, quotient_bits: int) -> bytes:
    """A counting quotient filter of sorted distinct uint64 keys with their counts.

    Layout: number of slots and of counters (two uint32), quotient bits (one byte), the occupied
    bitmap, the run-end bitmap, the counter bitmap, the remainders, the counters above one.
    """
    quotients = (keys >> np.uint64(64 - quotient_bits)).astype(np.int64)
    remainders = keys & np.uint64((1 << (64 - quotient_bits)) - 1)
    occupied = np.zeros(1 << quotient_bits, dtype=bool)
    occupied[quotients] = True
    run_end = np.ones(len(keys), dtype=bool)
    run_end[:-1] = quotients[1:] != quotients[:-1]
    many = counts > 1
    head = np.array([len(keys), int(many.sum())], dtype=np.uint32).tobytes() + bytes([quotient_bits])
    bits = b"".join(np.packbits(x).tobytes() for x in (occupied, run_end, many))
    return head + bits + remainders.tobytes() + counts[many].astype(np.uint64).tobytes()


def decode_filter(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The sorted keys and counts that ``encode_filter`` was given."""
    slots, counters = np.frombuffer(data, np.uint32, 2)
    quotient_bits, at = data[8], 9
    parts = []
    for n in (1 << quotient_bits, int(slots), int(slots)):
        size = (n + 7) // 8
        parts.append(np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n).astype(bool))
        at += size
    occupied, run_end, many = parts
    remainders = np.frombuffer(data, np.uint64, int(slots), at)
    at += 8 * int(slots)
    run = np.concatenate(([0], np.cumsum(run_end)[:-1])) if slots else np.zeros(0, np.int64)
    quotients = np.flatnonzero(occupied)[run].astype(np.uint64)
    counts = np.ones(int(slots), dtype=np.uint64)
    counts[many] = np.frombuffer(data, np.uint64, int(counters), at)
    return (quotients << np.uint64(64 - quotient_bits)) | remainders, counts


def merge_filters(filters: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Merge by sorted remainders: equal fingerprints add their counts, none is lost."""
    found = [decode_filter(x) for x in filters]
    keys = np.concatenate([k for k, _ in found])
    counts = np.concatenate([c for _, c in found])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _build(shard_bits: int):
    """Fingerprint batches to (shard, filter) rows."""

    def flush(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.unique(np.concatenate(parts), return_counts=True)
        shards = (keys >> np.uint64(64 - shard_bits)).astype(np.int64) if shard_bits else np.zeros(len(keys), np.int64)
        edges = np.flatnonzero(np.concatenate(([True], shards[1:] != shards[:-1], [True])))
        rows = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            # within a shard the top bits are the same for all: the quotient is taken below them
            below = keys[a:b] << np.uint64(shard_bits)
            rows.append((int(shards[a]), encode_filter(below, counts[a:b], max(3, int(b - a).bit_length()))))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "filter"]
        )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            parts.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            n += len(parts[-1])
            if n >= BLOCK_ROWS:
                yield from flush(parts)
                parts, n = [], 0
        if n:
            yield from flush(parts)

    return build


def _repeated(shard_bits: int):
    """The fingerprints of one shard whose merged count is above one."""

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        keys, counts = merge_filters([x.as_py() for x in table.column("filter")])
        keys = keys[counts > 1] >> np.uint64(shard_bits)
        if shard_bits:
            keys |= np.uint64(key[0].as_py()) << np.uint64(64 - shard_bits)
        return pa.table({"fp": pa.array(keys.view(np.int64), pa.int64()), "n": pa.array(counts[counts > 1].astype(np.int64))})

    return merge


def repeated_fingerprints(fingerprints: DataFrame, n_rows: int) -> DataFrame:
    """(fp, n) of each fingerprint of the one-column input that occurs more than once.

    n_rows sets the number of shards, about one per million rows, so a shard's merge is bounded.
    """
    shard_bits = max(4, (n_rows >> 20).bit_length())
    filters = fingerprints.mapInArrow(_build(shard_bits), "shard long, filter binary")
    return filters.groupBy("shard").applyInArrow(_repeated(shard_bits), "fp long, n long")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, n_code_points), one row per row of ``docs``.

    Texts are equal when they are the same after deleting all of ``[\\x20\\x09-\\x0D]``; null is
    empty. Of equal texts the row with the most code points stays, then the smallest doc_id; a
    null doc_id ranks last. Rows that repeat a doc_id are all counted, and share that id's fate.
    An empty table gives an empty one; other columns are ignored.
    """
    rows = docs.select(
        "doc_id",
        normalised(F.col("text")).alias("norm"),
        F.length(F.coalesce("text", F.lit(""))).alias("n_code_points"),
    ).withColumn("fp", F.xxhash64("norm"))
    n_rows = docs.count()
    repeated = scratch(repeated_fingerprints(rows.select("fp"), n_rows), "repeated")
    maybe = KeyBitmap(repeated.select("fp"), n_rows)
    digest = F.sha2(F.col("norm").cast("binary"), 256)
    # turns the order of ids round; unlike a minus it holds for every bigint
    smallest = F.coalesce(F.bitwise_not(F.col("doc_id").cast("long")), F.lit(-(1 << 63)))
    # the byte verification: whole normalised texts are the grouping key
    groups = (
        rows.where(maybe.holds(F.col("fp")))
        .groupBy("fp", "norm")
        .agg(
            F.max(F.struct("n_code_points", smallest, "doc_id")).alias("best"),
            F.count(F.lit(1)).alias("group_size"),
        )
        .where("group_size > 1")
        .select(digest.alias("text_sha256"), F.col("best.doc_id").alias("keep_of"), "group_size", F.lit(True).alias("grouped"))
    )
    groups = scratch(groups, "groups")
    each = rows.select("doc_id", digest.alias("text_sha256"), "n_code_points")
    return each.join(groups, "text_sha256", "left").select(
        "doc_id",
        F.when(F.col("grouped"), F.col("keep_of")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (~F.coalesce("grouped", F.lit(False)) | F.col("doc_id").eqNullSafe(F.col("keep_of"))).alias("kept"),
        "text_sha256",
        "n_code_points",
    )


def op1_exact_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP1_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS text_sha256
  FROM documents
), r AS (
  SELECT doc_id, text_sha256,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""
