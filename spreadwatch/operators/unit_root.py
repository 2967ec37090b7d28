"""Unit-root and cointegration tests from cross moments, without a series in one place.

An augmented Dickey-Fuller regression of any lag order needs only sums of products of a change, the
level before it and the changes before that. Each block of a series gives these sums as one matrix,
Spark adds the matrices of a key, and all lag orders are solved from the sum: the orders are compared
over the same rows, and the chosen one gets the few early rows that its shorter lags allow back
from the head of the series.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from spreadwatch.functions.stats import mackinnon_p
from spreadwatch.operators.aggregates import ols_of
from spreadwatch.operators.windows import in_blocks, with_row_numbers


def most_lags(n: int) -> int:
    """The highest lag order worth trying for n values: Schwert's bound, and no more than the rows allow."""
    return max(0, min(math.ceil(12 * (n / 100) ** 0.25), (n - 1) // 2 - 2))


def design(x: np.ndarray, lags: int) -> np.ndarray:
    """Rows (change, level before, ``lags`` changes before, 1) of successive values; empty without enough of them."""
    if len(x) < lags + 2:
        return np.zeros((0, lags + 3))
    w = np.lib.stride_tricks.sliding_window_view(x, lags + 2)
    d = np.diff(w, axis=1)[:, ::-1]
    return np.column_stack([d[:, 0], w[:, -2], d[:, 1:], np.ones(len(w))])


def solve(gram: np.ndarray, lags: int, constant: bool) -> tuple[float, float]:
    """(information criterion, t of the level) of the regression with ``lags`` changes, from the moments of a longer one."""
    used = [1, *range(2, 2 + lags), *([gram.shape[0] - 1] if constant else [])]
    n, xx, xy = gram[-1, -1], gram[np.ix_(used, used)], gram[used, 0]
    scale = np.sqrt(np.maximum(np.diag(xx), 1e-300))  # moments of levels and changes differ by orders of magnitude
    inverse = np.linalg.pinv(xx / np.outer(scale, scale), rcond=1e-13, hermitian=True)
    beta = inverse @ (xy / scale)
    rss = max(float(gram[0, 0] - beta @ (xy / scale)), 0.0)
    criterion = n * (math.log(2 * math.pi) + math.log(max(rss, 1e-300) / n) + 1) + 2 * len(used)
    error = math.sqrt(rss / (n - len(used)) * inverse[0, 0]) / scale[0] if n > len(used) else 0.0
    return criterion, float(beta[0]) / scale[0] / error if error else float("-inf")


def statistic(gram: np.ndarray, head: np.ndarray, most: int, constant: bool, lags: int | None = None) -> tuple[float, int]:
    """(t, lags) of the order with the least criterion, or of ``lags``; gram and head (the first most + 1 values) belong to one series."""
    best = min(range(most + 1), key=lambda k: solve(gram, k, constant)[0]) if lags is None else lags
    early = design(head, best)
    # the early rows have no longer lags: these places stay empty, and are not used
    wide = np.zeros((len(early), gram.shape[0]))
    wide[:, : 2 + best], wide[:, -1] = early[:, :-1], 1.0
    return solve(gram + wide.T @ wide, best, constant)[1], best


def unit_root(series: DataFrame, key: str, order: str, v: str, constant: bool = True, n_series: int = 1, lags: int | None = None, min_rows: int = 60) -> DataFrame:
    """(key, n, lags, t, p): the augmented Dickey-Fuller test of each key's values in order.

    Null values are left out. lags is chosen by Akaike's criterion where it is not given. A key
    with fewer than ``min_rows`` values has no row.
    """
    known = with_row_numbers(series.where(F.col(v).isNotNull() & ~F.isnan(v)).select(key, order, F.col(v).cast("double").alias("_x")), key, order, "_i")
    sizes = known.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows)
    longest = sizes.agg(F.max("_n").alias("n")).first().n or 0
    of = lambda n: most_lags(n) if lags is None else lags
    rows = known.join(sizes, F.col(key).eqNullSafe(F.col("_key"))).select(key, "_i", "_n", "_x")
    carry = max(of(longest), 1) + 1
    schema = StructType([series.schema[key]]).add("n", "long").add("at", ArrayType(DoubleType())).add("head", ArrayType(DoubleType()))

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tail, gram, head, kind = None, np.zeros(0), None, [], None

        def done() -> pa.RecordBatch:
            columns = [pa.array([last[0]], kind), pa.array([last[2]], pa.int64()), pa.array([gram.ravel().tolist()], pa.list_(pa.float64())), pa.array([head], pa.list_(pa.float64()))]
            return pa.RecordBatch.from_arrays(columns, schema.names)

        for batch in batches:
            kind = batch.schema.field(key).type
            keys = list(zip(batch.column(key).to_pylist(), batch.column("_block").to_pylist(), batch.column("_n").to_pylist(), strict=True))
            lent = (batch.column("_own").to_numpy(zero_copy_only=False) != batch.column("_block").to_numpy(zero_copy_only=False)).tolist()
            x = batch.column("_x").to_numpy(zero_copy_only=False)
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                k = of(keys[a][2])
                if keys[a] != last:
                    if last is not None:
                        yield done()
                    last, tail, gram, head = keys[a], np.zeros(0), np.zeros((k + 3, k + 3)), []
                if keys[a][1] == 0 and len(head) < k + 1:
                    head = [*head, *x[a:b][: k + 1 - len(head)].tolist()]
                borrowed = sum(lent[a:b])
                own = np.concatenate([tail, x[a : a + borrowed]])[-(k + 1) :]
                z = design(np.concatenate([own, x[a + borrowed : b]]), k)
                gram = gram + z.T @ z
                tail = np.concatenate([own, x[a + borrowed : b]])[-(k + 1) :]
        if last is not None:
            yield done()

    parts = in_blocks(rows, key, "_i", carry).mapInArrow(moments, schema)
    # a block that has lent rows only adds zeros
    sums = parts.select(key, "n", "head", F.posexplode("at").alias("place", "at")).groupBy(key, "n", "place").agg(F.sum("at").alias("at"), F.max("head").alias("head"))
    whole = sums.groupBy(key, "n").agg(F.array_sort(F.collect_list(F.struct("place", "at"))).alias("gram"), F.max("head").alias("head"))
    whole = whole.select(key, "n", F.transform("gram", lambda x: x["at"]).alias("gram"), "head")
    found = StructType([series.schema[key]]).add("n", "long").add("lags", "long").add("t", "double").add("p", "double")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, gram, first in zip(*(batch.column(c).to_pylist() for c in ("n", "gram", "head")), strict=True):
                k = of(n)
                t, used = statistic(np.array(gram).reshape(k + 3, k + 3), np.array(first), k, constant, lags)
                out.append((n, used, t, mackinnon_p(t, n_series)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(key), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], found.names)

    return whole.mapInArrow(test, found)


def cointegration(frame: DataFrame, key: str, order: str, a: str, b: str) -> DataFrame:
    """(key, n, lags, t, p) that a and b move together: the unit-root test of the residuals of a on b."""
    fit = ols_of(frame, key, a, b)
    met = frame.join(fit.withColumnRenamed(key, "_of"), F.col(key).eqNullSafe(F.col("_of")))
    residual = F.col(a) - (F.col("alpha") + F.col("beta") * F.col(b))
    return unit_root(met.select(key, order, residual.alias("_residual")), key, order, "_residual", constant=False, n_series=2)
