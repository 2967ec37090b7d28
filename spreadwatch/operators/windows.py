"""Causal rolling statistics of series (key, i, v), all keys at once.

Every frame that scores a row ends before it, unless said otherwise. Short frames are Spark's own
window aggregates. Spark evaluates a sliding frame anew for every row, which is dear for long ones,
and gives a series to one task; deviations, regressions and quantiles go through ``with_rolling``
instead: a numbered series is cut into blocks, each with the rows before it that its first windows
need, so that one series spreads over all tasks, and each task streams sorted Arrow batches with no
more than a window of rows carried along. Quantiles keep their window as an ordered multiset.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from spreadwatch.functions.expressions import MIN_FIT
from spreadwatch.sources.shared import written

Z_WINDOW, Z_MIN = 720, 30
THRESHOLD_WINDOW, THRESHOLD_MIN = 750, 100
FIT_WINDOW = 250


def past(key: str, order: str, n: int) -> WindowSpec:
    """The n rows before the current one."""
    return Window.partitionBy(key).orderBy(order).rowsBetween(-n, -1)


def upto(key: str, order: str, n: int) -> WindowSpec:
    """The n rows that end with the current one."""
    return Window.partitionBy(key).orderBy(order).rowsBetween(1 - n, 0)


def rolling_z(v: str, w: WindowSpec, min_rows: int = Z_MIN) -> Column:
    sd = F.stddev_samp(v).over(w)
    return F.when((F.count(v).over(w) >= min_rows) & (sd > 0), (F.col(v) - F.avg(v).over(w)) / sd)


#: Rows whose windows are worked on together.
BLOCK = 1024
#: Rows of a series that a task scores at least, before another may take the rest.
SERIES_BLOCK = 1 << 16
Scores = dict[str, np.ndarray]


def with_row_numbers(df: DataFrame, key: str, order: str | list[str], name: str = "i") -> DataFrame:
    """``df`` with ``name``, the place of each row in its key by order, from 1, without giving a key to one task.

    Rows are range-partitioned by key and order and written to the shared folder; the rows that
    each partition holds of each key are summed up (a row a key and partition) and give every
    partition its start. Ties get numbers in any order. Null keys are one key.
    """
    by = [order] if isinstance(order, str) else order
    placed = df.repartitionByRange(key, *by).sortWithinPartitions(key, *by).withColumns({"_part": F.spark_partition_id(), "_seq": F.monotonically_increasing_id()})
    rows = written(placed, "numbered")
    held = rows.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_in")).agg(F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_key").orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = rows.join(held.withColumn("_before", before), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_in")))
    return met.withColumn(name, (F.col("_before") + F.col("_seq") - F.col("_first") + 1).cast("long")).select(*[F.col(f"`{c}`") for c in df.columns if c != name], name)


def in_blocks(df: DataFrame, key: str, order: str, carry: int) -> DataFrame:
    """``df`` dealt out and sorted by key, _block and order: blocks of a numbered series, each after the ``carry`` rows before it.

    Rows that a block has only lent (_own is another block) come first in it.
    """
    size = max(SERIES_BLOCK, carry)
    own = F.floor((F.col(order) - 1) / size)
    also = (F.col(order) - 1) % size >= size - carry
    rows = df.withColumn("_own", own).withColumn("_block", F.explode(F.when(also, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))))
    return rows.repartition(key, "_block").sortWithinPartitions(key, "_block", order)


def with_rolling(df: DataFrame, key: str, order: str, needs: list[str], carry: int, fields: list[str], score: Callable[[Scores, int], Scores], chunk: int = BLOCK) -> DataFrame:
    """``df`` with double columns ``fields``, scored in order of each key.

    ``order`` numbers the rows of a key from 1 without gaps (see ``with_row_numbers``). ``score``
    gets the columns of ``needs`` as arrays (nan for null), of which the first rows are up to
    ``carry`` earlier ones, and how many these are; it returns the fields of the others. A series
    is cut into blocks of ``SERIES_BLOCK`` rows; the last ``carry`` rows of a block go to the next one too.
    """
    schema = StructType([*df.schema.fields, *(StructField(f, DoubleType()) for f in fields)])
    kept = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tail = None, None
        for batch in batches:
            keys = list(zip(batch.column(key).to_pylist(), batch.column("_block").to_pylist(), strict=True))
            lent = np.not_equal(batch.column("_own").to_numpy(zero_copy_only=False), batch.column("_block").to_numpy(zero_copy_only=False))
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            values = {c: batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in needs}
            found: dict[str, list[np.ndarray]] = {f: [np.zeros(0)] for f in fields}
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                before = tail if tail is not None and keys[a] == last else {c: np.zeros(0) for c in needs}
                whole = {c: np.concatenate([before[c], values[c][a:b]]) for c in needs}
                # rows lent by the block before come first and are not scored
                start = len(before[needs[0]]) + int(lent[a:b].sum())
                for at in range(start, len(whole[needs[0]]), chunk):
                    low, high = max(0, at - carry), min(at + chunk, len(whole[needs[0]]))
                    for f, x in score({c: x[low:high] for c, x in whole.items()}, at - low).items():
                        found[f].append(x)
                last, tail = keys[a], {c: x[max(0, len(x) - carry) :] for c, x in whole.items()}
            mine = batch.select(kept).filter(pa.array(~lent))
            arrays = [pa.array(np.concatenate(found[f]), pa.float64(), from_pandas=True) for f in fields]
            yield pa.RecordBatch.from_arrays([*mine.columns, *arrays], [*kept, *fields])

    return in_blocks(df, key, order, carry).mapInArrow(run, schema)


class OrderedWindow:
    """A multiset of values from a known, sorted universe: insert, delete, rank and select in O(log n).

    A Fenwick tree counts members by the rank of their value, so equal values are as exact as others.
    """

    def __init__(self, universe: np.ndarray):
        self.values = universe.tolist()
        self.m, self.size = len(self.values), 0
        self.tree = [0] * (self.m + 1)
        self.top = 1 << (self.m.bit_length() - 1) if self.m else 0

    def add(self, rank: int, n: int = 1) -> None:
        """Inserts n members of the value with this rank; deletes with a negative n."""
        tree, m, i = self.tree, self.m, rank + 1
        self.size += n
        while i <= m:
            tree[i] += n
            i += i & -i

    def below(self, rank: int) -> int:
        """How many members have a smaller rank."""
        tree, i, n = self.tree, rank, 0
        while i:
            n += tree[i]
            i &= i - 1
        return n

    def kth(self, k: int) -> float:
        """The member with k members before it."""
        tree, m, at, bit = self.tree, self.m, 0, self.top
        while bit:
            i = at + bit
            if i <= m and tree[i] <= k:
                k -= tree[i]
                at = i
            bit >>= 1
        return self.values[at]


def frames_of(x: np.ndarray, start: int, n: int, upto: bool = False) -> np.ndarray:
    """The n values before each row from ``start`` on, or those that end with it; nan where there are none."""
    padded = np.concatenate([np.full(n, np.nan), x])
    return np.lib.stride_tricks.sliding_window_view(padded, n)[start + upto : len(x) + upto]


def with_quantiles(df: DataFrame, key: str, order: str, v: str, n: int, quantiles: dict[str, float], rank: str | None = None, min_rows: int = THRESHOLD_MIN) -> DataFrame:
    """Adds quantiles of the n rows before each row, linearly interpolated, and as ``rank`` the share of them strictly below it, in percent."""

    def score(columns: Scores, start: int) -> Scores:
        x = columns[v]
        universe, rank_of = np.unique(x[~np.isnan(x)], return_inverse=True)
        ranks = np.full(len(x), -1)
        ranks[~np.isnan(x)] = rank_of
        ranks, window = ranks.tolist(), OrderedWindow(universe)
        out = {name: np.full(len(x) - start, np.nan) for name in [*quantiles, *([rank] if rank else [])]}
        for r in ranks[max(0, start - n) : start]:
            if r >= 0:
                window.add(r)
        for i in range(start, len(x)):
            if window.size >= max(1, min_rows):
                for name, p in quantiles.items():
                    at = (window.size - 1) * p
                    low = int(at)
                    a = window.kth(low)
                    b = window.kth(low + 1) if at > low else a
                    out[name][i - start] = a + (b - a) * (at - low)
                if rank and ranks[i] >= 0:
                    out[rank][i - start] = window.below(ranks[i]) * 100.0 / window.size
            if ranks[i] >= 0:
                window.add(ranks[i])
            if i >= n and ranks[i - n] >= 0:
                window.add(ranks[i - n], -1)
        return out

    return with_rolling(df, key, order, [v], n, [*quantiles, *([rank] if rank else [])], score, 8 * max(n, BLOCK))


def percentile_rank(df: DataFrame, key: str, order: str, v: str, n: int, name: str = "percentile") -> DataFrame:
    """Adds the share of the n rows before that lie strictly below each row, in percent."""
    return with_quantiles(df, key, order, v, n, {}, name)


def percentile_bounds(df: DataFrame, key: str, order: str, v: str, n: int, percent: float, min_rows: int = THRESHOLD_MIN) -> DataFrame:
    """Adds low and high, the two-tailed bounds at ``percent`` of the n rows before, and exceeds, whether a row is beyond them."""
    found = with_quantiles(df, key, order, v, n, {"low": (100 - percent) / 100, "high": percent / 100}, None, min_rows)
    return found.withColumn("exceeds", (F.col(v) > F.col("high")) | (F.col(v) < F.col("low")))


def regressions(x: np.ndarray, y: np.ndarray) -> Scores:
    """Least squares of each row of y on the same row of x, where both are known."""
    known = ~(np.isnan(x) | np.isnan(y))
    n = known.sum(axis=1).astype(float)
    with np.errstate(invalid="ignore", divide="ignore"):
        mx, my = (np.where(known, z, 0.0).sum(axis=1) / n for z in (x, y))
        dx, dy = np.where(known, x - mx[:, None], 0.0), np.where(known, y - my[:, None], 0.0)
        sxx, sxy, syy = ((a * b).sum(axis=1) for a, b in ((dx, dx), (dx, dy), (dy, dy)))
        beta = np.where(sxx > 0, sxy / sxx, np.nan)
        rss = np.maximum(np.where(sxx > 0, syy - sxy * sxy / sxx, np.nan), 0.0)
    return {"n": n, "mx": mx, "beta": beta, "alpha": my - beta * mx, "sxx": sxx, "syy": syy, "rss": rss}


FIT_FIELDS = ("theta", "mu", "sigma", "half_life", "t", "r2", "n")


def with_ou(df: DataFrame, key: str, order: str, n_pairs: int, min_pairs: int = MIN_FIT - 1, upto: bool = False) -> DataFrame:
    """Adds fit, the OU fit over pairs of dv (change) and lv (level before it): of the n_pairs before each row, or that end with it.

    Null with fewer than ``min_pairs`` pairs. mu falls back to the mean level when the slope is 0.
    """

    def score(columns: Scores, start: int) -> Scores:
        p = regressions(frames_of(columns["lv"], start, n_pairs, upto), frames_of(columns["dv"], start, n_pairs, upto))
        b, dof = p["beta"], np.where(p["n"] > 2, p["n"] - 2, np.nan)
        with np.errstate(invalid="ignore", divide="ignore"):
            error = np.sqrt(p["rss"] / dof / p["sxx"])
            t = np.where(error > 0, b / error, 0.0)
            out = {
                "theta": -b, "mu": np.where(b != 0, -p["alpha"] / b, p["mx"]), "sigma": np.sqrt(p["rss"] / dof),
                "half_life": np.where(b < 0, math.log(2) / -b, np.nan), "t": t, "r2": np.where(p["syy"] > 0, 1 - p["rss"] / p["syy"], 0.0),
            }
        return {f"_fit_{k}": x for k, x in (out | {"n": p["n"]}).items()}

    found = with_rolling(df, key, order, ["lv", "dv"], n_pairs, [f"_fit_{f}" for f in FIT_FIELDS], score)
    fit = F.struct(*[F.col(f"_fit_{f}").cast("long" if f == "n" else "double").alias(f) for f in FIT_FIELDS])
    return found.withColumn("fit", F.when(F.col("_fit_n") >= min_pairs, fit)).drop(*[f"_fit_{f}" for f in FIT_FIELDS])


def with_z(df: DataFrame, key: str, order: str, v: str, n: int = Z_WINDOW, min_rows: int = Z_MIN, name: str = "z") -> DataFrame:
    """``rolling_z`` of the n rows before each row, cut into blocks: null with fewer than ``min_rows`` values or equal ones."""

    def score(columns: Scores, start: int) -> Scores:
        history, now = frames_of(columns[v], start, n), columns[v][start:]
        known = ~np.isnan(history)
        size = known.sum(axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = np.where(known, history, 0.0).sum(axis=1) / size
            off = np.where(known, history - mean[:, None], 0.0)
            sd = np.sqrt((off * off).sum(axis=1) / (size - 1))
            spread = np.where(known, history, -np.inf).max(axis=1) > np.where(known, history, np.inf).min(axis=1)
            return {name: np.where((size >= min_rows) & spread, (now - mean) / sd, np.nan)}

    return with_rolling(df, key, order, [v], n, [name], score)


def with_lag(df: DataFrame, key: str, order: str, v: str) -> DataFrame:
    """Adds lv, the level before, and dv, the change from it."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("lv", F.lag(v).over(w)).withColumn("dv", F.col(v) - F.col("lv"))


def causal_detrend(df: DataFrame, key: str, order: str, v: str, n: int = FIT_WINDOW) -> DataFrame:
    """Adds resid, the row minus the line through the n rows before it, and slope of that line.

    ``order`` must count the rows of a key without gaps.
    """

    def score(columns: Scores, start: int) -> Scores:
        at, value = columns["_at"], columns[v]
        history = frames_of(value, start, n)
        p = regressions(frames_of(at, start, n), history)
        full = np.count_nonzero(~np.isnan(history), axis=1) == n
        line = p["alpha"] + p["beta"] * at[start:]
        return {"slope": np.where(full, p["beta"], np.nan), "resid": np.where(full, value[start:] - line, np.nan)}

    found = with_rolling(df.withColumn("_at", F.col(order).cast("double")), key, order, ["_at", v], n, ["slope", "resid"], score)
    return found.drop("_at")


def rolling_corr(x: str, y: str, w: WindowSpec, n: int) -> Column:
    both = F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).over(w)
    return F.when(both == n, F.corr(x, y).over(w))


def forward_move(v: str, key: str, order: str, h: int) -> Column:
    """How much closer to zero the value is h rows later."""
    return F.abs(F.col(v)) - F.abs(F.lead(v, h).over(Window.partitionBy(key).orderBy(order)))
