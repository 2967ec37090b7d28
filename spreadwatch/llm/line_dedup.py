"""Line dedup on DataFrame functions only (no Python on the executors).

Method: long lines become hashed keys; occurrences are range-partitioned by hash and sorted by
hash, document (largest first) and position. That one exchange also serves the windows that
stream over each key's run: they number its documents and hold its first one, which keeps the
line; in a key of enough documents all others lose it. What comes back is a run-length bitmap per
document, not text.

Skew: a key can't be cut by ranges of its hash. Hashes are counted by their first bits, one row a
slot and task; occurrences in the few slots that would fill half a partition or more (and a
1,024th of all) are taken out, counted per document and key with partial aggregation, and met again in a plain join that
Spark can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadwatch.llm.common import WHITE, ascii_lower, scratch


def split_lines(text: Column) -> Column:
    """The lines of a text; null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """A line stripped of ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


#: Bits of a hash that name its slot.
SLOT_BITS = 16
#: No more slots than this are taken out, at any number of partitions; an average slot is far below the share that it asks for.
MAX_HOT_SLOTS = 1024


def occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc_id, pos) for each line whose key has ``min_chars`` code points or more."""
    lines = docs.where("doc_id is not null").select("doc_id", F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    keys = lines.where(F.length("line") >= min_chars).select("doc_id", "pos", line_key(F.col("line")).alias("key"))
    return keys.where(F.length("key") >= min_chars).select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "pos")


def hot_slots(lines: DataFrame) -> list[int]:
    """Slots of ``h1`` that hold half a partition's share of all occurrences or more, and at least one in ``MAX_HOT_SLOTS``.

    With thousands of partitions a slot of less than that may fill several; its sort spills.
    """
    partitions = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = lines.groupBy(F.shiftrightunsigned("h1", 64 - SLOT_BITS).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    whole = sizes.agg(F.sum("n").alias("whole"))
    return [r.slot for r in sizes.join(F.broadcast(whole)).where(min(2 * partitions, MAX_HOT_SLOTS) * F.col("n") >= F.col("whole")).select("slot").collect()]  # whole is one row


def lost_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """(doc_id, pos) of occurrences in streamed runs: all but those of the first document of a key of ``min_docs`` or more."""
    key = ["h1", "h2"]
    run = Window.partitionBy(*key).orderBy(F.col("doc_id").desc(), "pos")
    ranged = lines.repartitionByRange(*key)
    seen = ranged.withColumns({"first_doc": F.first("doc_id").over(run), "opens": F.coalesce(F.lag("doc_id").over(run) != F.col("doc_id"), F.lit(True))})
    counted = seen.withColumn("n_docs", F.sum(F.col("opens").cast("int")).over(Window.partitionBy(*key)))
    return counted.where((F.col("n_docs") >= min_docs) & (F.col("doc_id") != F.col("first_doc"))).select("doc_id", "pos")


def lost_hot_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """The same for the few slots that hold too much for one range, from partial counts and a join."""
    by_doc = lines.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
    frequent = by_doc.groupBy("h1", "h2").agg(F.count("one").alias("n_docs"), F.max("doc_id").alias("first_doc"))
    frequent = scratch(frequent.where(F.col("n_docs") >= min_docs).select("h1", "h2", "first_doc"), "frequent-lines")
    return lines.join(frequent, ["h1", "h2"]).where("doc_id <> first_doc").select("doc_id", "pos")


def dropped_runs(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, n_dropped, keep_runs) for the documents that lose lines.

    keep_runs is the keep bitmap as alternating run lengths, kept first: [2, 1, 3] keeps two
    lines, drops one, keeps three; the lines after the last run are kept.
    """
    lines = scratch(occurrences(docs, min_chars), "lines")
    hot = F.shiftrightunsigned("h1", 64 - SLOT_BITS).isin(slots) if (slots := hot_slots(lines)) else F.lit(False)
    lost = lost_lines(lines.where(~hot), min_docs)
    if slots:
        lost = lost.unionByName(lost_hot_lines(lines.where(hot), min_docs))
    positions = lost.groupBy("doc_id").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    # where dropped runs start and where they end
    edges = positions.select(
        "doc_id",
        F.size("gone").cast("long").alias("n_dropped"),
        F.filter("gone", lambda pos, i: (i == 0) | (F.get("gone", i - 1) != pos - 1)).alias("starts"),
        F.filter("gone", lambda pos, i: (i == F.size("gone") - 1) | (F.get("gone", i + 1) != pos + 1)).alias("ends"),
    )
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("ends", i - 1) + 1)
    runs = F.flatten(F.transform("starts", lambda pos, i: F.array(pos - before(i), F.get("ends", i) - pos + 1)))
    return edges.select("doc_id", "n_dropped", runs.alias("keep_runs"))


def kept_text(text: Column, keep_runs: Column) -> Column:
    """The text without the dropped lines; unchanged where keep_runs is null."""
    gone = F.flatten(F.transform(keep_runs, lambda n, i: F.array_repeat(i % 2 == 1, n)))
    kept = F.filter(F.arrays_zip(split_lines(text).alias("line"), gone.alias("gone")), lambda x: ~F.coalesce(x["gone"], F.lit(False)) & x["line"].isNotNull())
    return F.when(keep_runs.isNull(), text).otherwise(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"))


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Per-document keep bitmaps: (doc_id, n_lines, n_dropped, keep_runs).

    A key of at least ``min_chars`` code points found in at least ``min_docs`` documents loses all
    its lines except in the largest doc_id that holds it. Null text is one empty line. A null
    doc_id is never counted and never loses lines. Rows that repeat a doc_id count as one
    document and are treated alike. An empty table gives an empty one; other columns are ignored.
    """
    sizes = docs.select("doc_id", F.size(split_lines(F.col("text"))).cast("long").alias("n_lines"))
    runs = dropped_runs(docs.select("doc_id", "text"), min_chars, min_docs)
    return sizes.join(runs, "doc_id", "left").withColumn("n_dropped", F.coalesce("n_dropped", F.lit(0).cast("long")))


def apply_line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with the duplicate lines taken out of ``text`` and keep_runs, n_lines, n_dropped beside it.

    Columns of ``docs`` with those names are replaced. Null text stays null.
    """
    docs = docs.drop("n_lines", "n_dropped", "keep_runs")
    runs = dropped_runs(docs.select("doc_id", "text"), min_chars, min_docs)
    return docs.join(runs, "doc_id", "left").select(
        *[F.col(f"`{c}`") for c in docs.columns if c != "text"],
        kept_text(F.col("text"), F.col("keep_runs")).alias("text"),
        F.size(split_lines(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"),
        "keep_runs",
    )


def op5_line_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return apply_line_dedup(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256")
    )


OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), frequent AS (
  SELECT key, max(doc_id) AS first_doc FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND k.doc_id <> f.first_doc AS gone
  FROM keyed k LEFT JOIN frequent f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
