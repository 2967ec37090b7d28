"""Token totals by source, language and tokenizer version, maintained from deltas.

A batch of changes (inserts, deletes, revised counts) becomes signed sums per key and is one
folder of the store. Totals are the sum of all committed folders, so they are additive and the
order of batches does not matter. A batch commits when Spark's writer leaves its success marker;
repeating a committed batch does nothing, and a batch that failed half-way is overwritten whole.
``compact`` folds committed batches into a base that names them; its names are written first and
its sums last, whose success marker commits it at once. ``vacuum`` then drops the old folders. A
batch id has one writer at a time; different ids may be written by different jobs.

Everything that is summed is pre-aggregated where it is read; a source with a third of all rows
is one row per task before the shuffle.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadwatch.llm.common import scratch, shared_dir

KEY = ["source", "lang", "tokenizer"]
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published pre-tokenization pattern of this vocabulary (a fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHANGE = "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long"


def bpe_counter(path: str = RANKS, pattern: str = PATTERN) -> Callable[[list[str | None]], list[int]]:
    """A function that counts the tokens of texts with a ranks file; null has none."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [0 if t is None else len(encoding.encode_ordinary(t)) for t in texts]


def count_tokens(docs: DataFrame, tokenizer: str, path: str = RANKS) -> DataFrame:
    """(doc_id, source, lang, tokenizer, n_tokens, estimate) of every whole text of ``docs``.

    estimate is a quarter of the code points, what a document counts as until it is tokenized. Null
    and empty texts have no tokens; null ids, sources and languages pass through, repeated rows are
    counted each, an empty table gives an empty one, other columns are ignored or replaced.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = bpe_counter(path)
        for batch in batches:
            n = pa.array(counter(batch.column("text").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "source", "lang", "estimate")), n], ["doc_id", "source", "lang", "estimate", "n_tokens"])

    estimate = F.ceil(F.coalesce(F.length("text"), F.lit(0)) / 4).cast("long").alias("estimate")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), estimate, "text")
    counted = rows.mapInArrow(count, "doc_id long, source string, lang string, estimate long, n_tokens long")
    return counted.select("doc_id", "source", "lang", F.lit(tokenizer).alias("tokenizer"), "n_tokens", "estimate")


def signed(changes: DataFrame) -> DataFrame:
    """Changes as signed sums per key: (source, lang, tokenizer, d_docs, d_tokens)."""
    new, old = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    op = F.col("op")
    docs = F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0)
    tokens = F.when(op == "insert", new).when(op == "delete", -old).when(op == "revise", new - old)
    checked = F.when(docs.isNull(), F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce(op, F.lit("null"))))).otherwise(docs)
    return changes.groupBy(*KEY).agg(F.sum(checked.cast("long")).alias("d_docs"), F.sum(tokens.cast("long")).alias("d_tokens"))


class TokenRollup:
    """A store of committed batches under one folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _list(self, name: str, marker: str = "_SUCCESS") -> list[str]:
        """The names of the finished folders in a folder of the store."""
        at = self._at(name)
        if not self._fs.exists(at):
            return []
        found = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return sorted(n for n in found if self._fs.exists(self._at(f"{name}/{n}/{marker}")))

    def _base(self) -> tuple[str | None, set[str]]:
        """The newest base and the batches in it."""
        if not (bases := self._list("base", "sums/_SUCCESS")):
            return None, set()
        names = self.spark.read.text(f"{self.path}/base/{bases[-1]}/batches").collect()
        return bases[-1], {r.value for r in names}

    def batches(self) -> list[str]:
        """The committed batches."""
        return sorted(self._base()[1] | {n.removeprefix("batch=") for n in self._list("deltas")})

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch of changes (see CHANGE); False, and no work, if it is committed already."""
        if not re.fullmatch(r"[A-Za-z0-9._-]+", batch_id):
            raise ValueError(f"a batch id is letters, digits, dot, dash and underscore: {batch_id!r}")
        if batch_id in self.batches():
            return False
        signed(changes).write.mode("overwrite").parquet(f"{self.path}/deltas/batch={batch_id}")
        return True

    def _sum(self, base: str | None, names: list[str]) -> DataFrame:
        parts = [f"{self.path}/deltas/batch={n}" for n in names] + ([f"{self.path}/base/{base}/sums"] if base else [])
        schema = "source string, lang string, tokenizer string, d_docs long, d_tokens long"
        rows = self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)
        return rows.groupBy(*KEY).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens); keys whose documents are all gone are left out.

        Null source and lang are keys of their own. An empty store gives an empty table.
        """
        base, inside = self._base()
        names = [n.removeprefix("batch=") for n in self._list("deltas")]
        found = self._sum(base, [n for n in names if n not in inside])
        return found.where("d_docs <> 0 or d_tokens <> 0").select(*KEY, F.col("d_docs").alias("n_docs"), F.col("d_tokens").alias("n_tokens"))

    def compact(self) -> None:
        """Fold the committed batches into a new base; readers see the old state or the new one.

        A compaction that stopped after any of its writes leaves the old state, and the next one
        writes over what it left.
        """
        base, inside = self._base()
        names = [n.removeprefix("batch=") for n in self._list("deltas")]
        fresh = [n for n in names if n not in inside]
        if not fresh:
            return
        target = f"{self.path}/base/{int(base) + 1 if base else 0:09d}"
        everything = self.spark.createDataFrame([(n,) for n in sorted(inside | set(fresh))], "value string")
        everything.coalesce(1).write.mode("overwrite").text(f"{target}/batches")
        self._sum(base, fresh).write.mode("overwrite").parquet(f"{target}/sums")

    def vacuum(self) -> None:
        """Drop folders of batches that the newest base holds, and older bases; readers that began before a compaction must have ended."""
        base, inside = self._base()
        for name in self._list("deltas"):
            if name.removeprefix("batch=") in inside:
                self._fs.delete(self._at(f"deltas/{name}"), True)
        for name in self._list("base", "sums/_SUCCESS"):
            if name != base:
                self._fs.delete(self._at(f"base/{name}"), True)


def change(op: str, rows: DataFrame, n_tokens: Column | None = None, old_tokens: Column | None = None) -> DataFrame:
    """Rows with source, lang and tokenizer as changes of one kind."""
    none = F.lit(None).cast("long")
    n, old = n_tokens if n_tokens is not None else none, old_tokens if old_tokens is not None else none
    return rows.select(F.lit(op).alias("op"), *KEY, n.alias("n_tokens"), old.alias("old_tokens"))


def op8_token_counts(spark, sf_dir):
    """Every document comes in with an estimate, is revised to its exact count, and toxic ones are deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    toxic = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").select("doc_id").distinct()
    exact = scratch(count_tokens(docs, "byte_bpe_50k@1"), "token-counts")
    store = TokenRollup(spark, f"{shared_dir(spark)}/scratch/rollup-{uuid.uuid4().hex}")
    store.commit("1-arrivals", change("insert", exact, F.col("estimate")))
    store.commit("2-counted", change("revise", exact, F.col("n_tokens"), F.col("estimate")))
    gone = exact.join(toxic, "doc_id", "left_semi")
    store.commit("3-toxic", change("delete", gone, old_tokens=F.col("n_tokens")))
    store.commit("2-counted", change("revise", exact, F.col("n_tokens"), F.col("estimate")))  # a repeat: no effect
    store.compact()
    return store.totals()
