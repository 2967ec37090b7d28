"""What the corpus operators share: scratch tables, a size-bounded prefilter, components.

Every function takes and returns DataFrames; the only things that reach the driver are
counts and the fixed-size bitmap of ``KeyBitmap``.
"""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters ``[\x20\x09-\x0D]``.
WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Spark's setting that drops an action's shuffle files as soon as the action has ended.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's bound on the bytes of a batch between its JVM and Python, Spark's own value of it, and ours.
BATCH_BYTES, SPARKS_BYTES, OUR_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches to 4 MB, unless a bound was set; whole texts and sets make batches of 10,000 rows that executors hold off their heap."""
    if spark.conf.get(BATCH_BYTES) == SPARKS_BYTES:
        spark.conf.set(BATCH_BYTES, OUR_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spreadwatch-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors.

    The write's shuffle files go when it has ended, the table with ``discard`` or when the driver's
    JVM ends.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/scratch/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(FILE_CLEANUP, None)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(FILE_CLEANUP)
        else:
            spark.conf.set(FILE_CLEANUP, before)
    store, at = _located(spark, path)
    store.deleteOnExit(at)
    table = spark.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table


def _located(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def discard(*tables: DataFrame) -> None:
    """Deletes scratch tables; nothing that is still to be computed may read them."""
    for table in tables:
        store, at = _located(table.sparkSession, _PATHS.pop(table))
        store.delete(at, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII strings take the fast built-in path."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


class KeyBitmap:
    """A bitmap over hashed 64-bit keys, for dropping most rows before an exact join.

    It has 2**bits bits whatever the number of keys (2**26 at most: 8 MB), so broadcasting it
    is bounded. Hash collisions let some rows through that the exact join removes later; no
    row with a wanted key is ever lost. With very many keys it fills up and only stops helping.
    """

    MAX_BITS = 26

    def __init__(self, keys: DataFrame, n_keys: int):
        """keys: one bigint column, without nulls; n_keys: about how many, which sets the size."""
        self.bits = int(min(self.MAX_BITS, max(16, int(n_keys).bit_length() + 4)))
        (name,) = keys.columns
        slot = F.shiftrightunsigned(F.xxhash64(F.col(name)), 64 - self.bits)
        words = (
            keys.select(slot.alias("slot"))
            .groupBy(F.shiftrightunsigned("slot", 5).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 31 as int))")).alias("bits"))
        )
        table = words.toArrow()
        bitmap = np.zeros(1 << (self.bits - 5), dtype=np.uint32)
        bitmap[table.column("word").to_numpy()] = table.column("bits").to_numpy().astype(np.uint32)
        self._shared = keys.sparkSession.sparkContext.broadcast(bitmap)

    def slot(self, key: Column) -> Column:
        """The place of a key in the bitmap."""
        return F.shiftrightunsigned(F.xxhash64(key), 64 - self.bits)

    def lookup(self):
        """A function from an array of slots to booleans, for use inside a task."""
        shared = self._shared

        def has(slot: np.ndarray) -> np.ndarray:
            return ((shared.value[slot >> 5] >> (slot & 31).astype(np.uint32)) & 1).astype(bool)

        return has

    def holds(self, key: Column) -> Column:
        """False only where ``key`` is surely not among the keys; the 64-bit column alone goes to Python."""
        has = self.lookup()

        @F.pandas_udf("boolean")
        def lookup(slots: pd.Series) -> pd.Series:
            return pd.Series(has(slots.to_numpy(np.int64)))

        return lookup(self.slot(key))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b), both bigint; component is the smallest node.

    Each round a node takes the smallest label of a label among its neighbours, and so does the
    node that was its label until then; then every label jumps to its own label. Hooking the old
    label too is what joins whole trees, so rounds grow with the logarithm of the longest path
    however its nodes are numbered. Labels only fall, so the rounds end without a cap. Partial
    aggregation and splittable joins keep hubs harmless; labels live in scratch tables, never on
    the driver.
    """
    both = edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b"), F.col("a"))).distinct()
    both = scratch(both, "edges")
    labels = both.select(F.col("a").alias("node")).distinct()
    labels = held = scratch(labels.select("node", F.col("node").alias("label"), F.col("node").alias("next")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "next"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("next").alias("seen"))
        )
        near = labels.join(near, "node")
        own = near.select("node", F.least("next", "seen").alias("to"), F.col("label").alias("was"))
        hooked = near.select(F.col("label").alias("node"), F.col("seen").alias("to"), F.lit(None).cast("long").alias("was"))
        moved = own.unionByName(hooked).groupBy("node").agg(F.min("to").alias("label"), F.max("was").alias("was"))
        moved = scratch(moved, "moved")
        if moved.where("label <> was").limit(1).count() == 0:
            discard(both, held)
            return moved.select("node", F.col("label").alias("component"))
        jump = moved.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = scratch(moved.drop("was").join(jump, "label").select("node", "label", "next"), "labels")
        discard(held, moved)
        held = labels
