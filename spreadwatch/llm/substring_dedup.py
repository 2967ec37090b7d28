"""Substring dedup by hashing units of text.

Every line is cut at sentence ends into units; a unit is normalised (A-Z lower-cased, white space
as single spaces, trimmed) and hashed to 128 bits. Digests are grouped over the whole corpus, the
earliest occurrence by (doc_id, place in the document) is kept, and later ones are marked. Marked
units that follow each other in a document join into spans, which are removed, with their offsets
in the original text; a span may be one unit, as a repeated passage that begins and ends inside
sentences can leave no more. Short sentences and lines that follow each other
are one unit; what is left of a few words says nothing by itself and never starts or breaks a span.

A unit that a third of all documents hold is counted where it is read and meets its kept place in
a join that Spark can split; a fixed-size bitmap of repeated digests keeps all other units out of
that join.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spreadwatch.llm.common import KeyBitmap, scratch

#: Words a unit must have to be compared, and a span to be removed: any repeated unit is.
MIN_UNIT_WORDS = MIN_SPAN_WORDS = 4
UNIT = re.compile(r"[^\n.!?]+[.!?]*|[.!?]+")
UNITS = "h1 long, h2 long, doc_id long, ord int, start int, stop int, n_words int"


def units(text: str, min_words: int = MIN_UNIT_WORDS) -> Iterator[tuple[bytes, int, int, int]]:
    """(digest, start, stop, words) of each unit of a text, offsets in code points.

    Neighbours of fewer than ``min_words`` words each are taken together, and left out if they
    have fewer words even so.
    """

    def unit(words: list[bytes], start: int, stop: int) -> tuple[bytes, int, int, int]:
        return hashlib.blake2b(b" ".join(words), digest_size=16).digest(), start, stop, len(words)

    short: list[bytes] = []
    first = last = 0
    for found in UNIT.finditer(text):
        words = found[0].encode("utf-8", "replace").lower().split()
        start = found.end() - len(found[0].lstrip())
        if len(words) >= min_words:
            if len(short) >= min_words:
                yield unit(short, first, last)
            short = []
            yield unit(words, start, found.end())
        elif words:
            first, last = first if short else start, found.end()
            short += words
    if len(short) >= min_words:
        yield unit(short, first, last)


def _units(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, rows = [], []

            def take(digests=digests, rows=rows):
                pair = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
                table = np.array(rows, dtype=np.int64).reshape(-1, 5)
                arrays = [pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(table[:, 0])]
                arrays += [pa.array(table[:, i].astype(np.int32)) for i in range(1, 5)]
                digests.clear()
                rows.clear()
                return pa.RecordBatch.from_arrays(arrays, ["h1", "h2", "doc_id", "ord", "start", "stop", "n_words"])

            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                for n, (digest, start, stop, words) in enumerate(units(text.as_py(), min_words)):
                    digests.append(digest)
                    rows.append((doc_id, n, start, stop, words))
                if len(rows) >= 50_000:
                    yield take()
            if rows:
                yield take()

    return run


def repeated_spans(docs: DataFrame, min_unit_words: int = MIN_UNIT_WORDS, min_span_words: int = MIN_SPAN_WORDS) -> DataFrame:
    """(doc_id, start, stop, n_words, n_units, kept_doc_id): what later occurrences lose.

    start and stop are code points of the original text; kept_doc_id holds the kept occurrence of
    the span's first unit. Rows with null text or doc_id have no units; repeated rows of one doc_id
    are taken as one document. Equal units rank by doc_id, then place. An empty table or one
    without repeats gives an empty result; other columns are ignored.
    """
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text")
    found = scratch(rows.mapInArrow(_units(min_unit_words), UNITS), "units")
    kept = (
        found.groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "ord")).alias("first"))
        .where("n > 1")
        .select("h1", "h2", F.col("first.doc_id").alias("kept_doc_id"), F.col("first.ord").alias("kept_ord"))
    )
    kept = scratch(kept, "kept-units")
    maybe = KeyBitmap(kept.select("h1"), kept.count())
    later = found.where(maybe.holds(F.col("h1"))).join(kept, ["h1", "h2"])
    later = later.where("doc_id <> kept_doc_id or ord <> kept_ord").dropDuplicates(["doc_id", "ord"])
    in_order = Window.partitionBy("doc_id").orderBy("ord")
    spans = later.withColumn("run", F.col("ord") - F.row_number().over(in_order)).groupBy("doc_id", "run").agg(
        F.min("start").alias("start"),
        F.max("stop").alias("stop"),
        F.sum("n_words").cast("long").alias("n_words"),
        F.count(F.lit(1)).alias("n_units"),
        F.min_by("kept_doc_id", "ord").alias("kept_doc_id"),
    )
    return spans.where(F.col("n_words") >= min_span_words).drop("run")


def remove_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the spans cut out of ``text`` and ``removed``, their original offsets, added.

    Null text stays null; a null doc_id or one without spans keeps its text, and ``removed`` is
    null. Rows that repeat a doc_id are all cut alike. A column ``removed`` of ``docs`` is
    replaced, other columns stay; an empty table gives an empty one.
    """
    cuts = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("removed"))
    state = F.aggregate(
        "removed",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("kept")),
        lambda acc, cut: F.struct(
            cut["stop"].alias("at"),
            F.concat(acc["kept"], F.array(F.substring(F.col("text"), acc["at"] + 1, cut["start"] - acc["at"]))).alias("kept"),
        ),
    )
    rest = F.concat(F.array_join(state["kept"], ""), F.substring(F.col("text"), state["at"] + 1, F.length("text")))
    joined = docs.drop("removed").join(cuts, "doc_id", "left")
    return joined.withColumn("text", F.when(F.col("removed").isNull(), F.col("text")).otherwise(rest))


def op7_substring_dedup(spark, sf_dir):
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
