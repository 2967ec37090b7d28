"""Recurrences of one series over many tasks: a parallel prefix over blocks.

A recurrence whose steps compose associatively need not run through its rows in one task. A
numbered series is cut into blocks; every block is condensed to one small element (what it does to
any state that enters it), the elements of a key are folded in order of their blocks (one row a
block), and each block then runs the ordinary steps from the state that enters it. All blocks of
all keys are condensed, and run, side by side.

What a block is told (its head) travels as the first row of the block, so a task streams sorted
Arrow batches: it holds one block's numbers while it condenses, one batch while it steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from spreadwatch.operators.sequential import ARROW, KALMAN_FIELDS, Kalman, Wilder, kalman_row, recurrence
from spreadwatch.operators.windows import SERIES_BLOCK, with_rolling
from spreadwatch.sources.shared import written

Numbers = list[float]


@dataclass
class Scan:
    """A recurrence that can be cut.

    ``head`` is an aggregate over a block's rows, and ``known`` a window expression over the heads
    ("_head") of a key, given the window over its blocks: the one number a block must know of
    others before it is condensed. ``element`` condenses a block, ``carry`` takes a state through
    an element, ``resume`` makes of a state what ``step`` works on.
    """

    head: Column
    known: Callable[[Any], Column]
    element: Callable[[float | None, list[np.ndarray]], Numbers]
    start: Numbers
    carry: Callable[[Numbers, Numbers], Numbers]
    resume: Callable[[float | None, Numbers], Any]
    step: Callable[..., tuple]


def _dealt(rows: DataFrame, heads: DataFrame, key: str, order: str) -> DataFrame:
    """Blocks in order of their rows, each behind its head, which has no place in the order."""
    both = rows.withColumn("_is_head", F.lit(False)).unionByName(heads.withColumn("_is_head", F.lit(True)), allowMissingColumns=True)
    return both.repartition(key, "_block").sortWithinPartitions(key, "_block", F.col(order).asc_nulls_first())


def scanned(df: DataFrame, key: str, order: str, needs: list[str], fields: str, scan: Scan, size: int = SERIES_BLOCK) -> DataFrame:
    """``df`` with ``fields``: what ``scan.step(state, *needs)`` returns for each row in order of its key.

    ``order`` numbers the rows of a key from 1 without gaps (see ``with_row_numbers``); ``needs``
    are doubles. Null keys are one key, an empty table gives an empty one. Equal to ``recurrence``
    up to the rounding of the states that enter the blocks.
    """
    added = StructType.fromDDL(fields)
    kinds = [ARROW[f.dataType.simpleString()] for f in added.fields]
    kept = df.columns
    # functions that go to executors must not take the scan's columns along
    condensed, start, carry, resume, step = scan.element, scan.start, scan.carry, scan.resume, scan.step
    rows = df.withColumn("_block", F.floor((F.col(order) - 1) / size).cast("long"))
    key_type = df.schema[key]
    over = Window.partitionBy(key).orderBy("_block")
    heads = rows.groupBy(key, "_block").agg(scan.head.cast("double").alias("_head"))
    heads = written(heads.select(key, "_block", scan.known(over).cast("double").alias("_known")), "scan-heads")

    def condense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known, parts = None, None, []

        def element() -> pa.RecordBatch:
            whole = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0) for i in range(len(needs))]
            columns = [pa.array([at[0]], kind), pa.array([at[1]], pa.int64()), pa.array([known], pa.float64())]
            return pa.RecordBatch.from_arrays([*columns, pa.array([condensed(known, whole)], pa.list_(pa.float64()))], [key, "_block", "_known", "_element"])

        for batch in batches:
            kind = batch.schema.field(key).type
            starts = [i for i, head in enumerate(batch.column("_is_head").to_pylist()) if head]
            values = [batch.column(c).to_numpy(zero_copy_only=False) for c in needs]
            for a, b in zip([0, *(i + 1 for i in starts)], [*starts, batch.num_rows], strict=True):
                if a:
                    if at is not None:
                        yield element()
                    at, known, parts = tuple(batch.column(c)[a - 1].as_py() for c in (key, "_block")), batch.column("_known")[a - 1].as_py(), []
                if b > a:
                    parts.append([v[a:b].astype(float) for v in values])
        if at is not None:
            yield element()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            found = []
            for head, known, entered, *values in zip(*(batch.column(c).to_pylist() for c in ("_is_head", "_known", "_state", *needs)), strict=True):
                if head:
                    state = resume(known, entered)
                else:
                    found.append(step(state, *values))
            mine = batch.select(kept).filter(pc.invert(batch.column("_is_head")))
            columns = zip(*found, strict=True) if found else [[]] * len(kinds)
            arrays = [pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*mine.columns, *arrays], [*kept, *added.names])

    slim = rows.select(key, order, "_block", *needs)
    schema = StructType([key_type]).add("_block", "long").add("_known", "double").add("_element", ArrayType(DoubleType()))
    elements = _dealt(slim, heads, key, order).mapInArrow(condense, schema)

    def enter(state: list[Numbers], element: Numbers) -> tuple:
        entered, state[0] = state[0], carry(state[0], element)
        return (entered,)

    states = recurrence(elements, key, "_block", ["_element"], "_state array<double>", lambda: [list(start)], enter)
    states = written(states.drop("_element"), "scan-states")
    return _dealt(rows, states, key, order).mapInArrow(run, StructType([*df.schema.fields, *added.fields]))


# ---- hedge-ratio filter


def _inverse(m: np.ndarray) -> np.ndarray:
    """Inverses of 2 x 2 matrices."""
    a, b, c, d = m[..., 0, 0], m[..., 0, 1], m[..., 1, 0], m[..., 1, 1]
    return np.stack([np.stack([d, -b], -1), np.stack([-c, a], -1)], -2) / (a * d - b * c)[..., None, None]


def _mv(m: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.einsum("...ij,...j->...i", m, v)


def _composed(first: tuple, then: tuple) -> tuple:
    """The filtering element of stretches ``first`` followed by those of ``then``.

    An element (A, b, C, eta, J) says: of a state that enters, the posterior behind the stretch is
    A x + b with covariance C, and the stretch's likelihood of it has information eta, J.
    """
    a1, b1, c1, e1, j1 = first
    a2, b2, c2, e2, j2 = then
    gain = _inverse(np.eye(2) + c1 @ j2)
    left, back = a2 @ gain, np.swapaxes(a1, -1, -2) @ np.swapaxes(gain, -1, -2)
    return (
        left @ a1,
        _mv(left, b1 + _mv(c1, e2)) + b2,
        left @ c1 @ np.swapaxes(a2, -1, -2) + c2,
        _mv(back, e2 - _mv(j2, b1)) + e1,
        back @ j2 @ a1 + j1,
    )


def _filter_element(y: np.ndarray, x: np.ndarray, delta: float, noise: float) -> Numbers:
    """One element of all rows, composed pair by pair; of no rows, the one that changes nothing."""
    if not len(y):
        return [*np.eye(2).ravel(), *[0.0] * 12]
    q = delta / (1 - delta)
    h = np.stack([x, np.ones_like(x)], -1)
    var = q * (h * h).sum(-1) + noise
    outer = h[:, :, None] * h[:, None, :] / var[:, None, None]
    a = np.eye(2) - q * outer
    part = (a, q * h * (y / var)[:, None], q * a, h * (y / var)[:, None], outer)
    while (n := len(part[0])) > 1:
        pairs = _composed(tuple(p[0 : n - 1 : 2] for p in part), tuple(p[1::2] for p in part))
        part = tuple(np.concatenate([p, o[n - 1 :]]) for p, o in zip(pairs, part, strict=True)) if n % 2 else pairs
    return [float(z) for p in part for z in p[0].ravel()]


def _filtered(state: Numbers, element: Numbers) -> Numbers:
    """State (slope, intercept, variances) behind an element."""
    e = np.array(element)
    a, b, c, eta, info = e[:4].reshape(2, 2), e[4:6], e[6:10].reshape(2, 2), e[10:12], e[12:].reshape(2, 2)
    m, p = np.array(state[:2]), np.array([[state[2], state[3]], [state[3], state[4]]])
    left = a @ _inverse(np.eye(2) + p @ info)
    m, p = left @ (m + p @ eta) + b, left @ p @ a.T + c
    return [float(z) for z in (m[0], m[1], p[0, 0], (p[0, 1] + p[1, 0]) / 2, p[1, 1])]


def kalman_blocks(df: DataFrame, key: str, order: str, y: str, x: str, delta: float = 1e-7, size: int = SERIES_BLOCK) -> DataFrame:
    """``sequential.kalman`` with the series cut into blocks; ``order`` numbers the rows of a key from 1.

    A row without both prices gets nulls and leaves the filter as it is.
    """
    noise = Kalman(delta=delta).noise
    rows = df.select(key, order, F.col(y).cast("double").alias("_y"), F.col(x).cast("double").alias("_x"))
    whole = F.col("_y").isNotNull() & F.col("_x").isNotNull() & ~F.isnan("_y") & ~F.isnan("_x")
    unit = F.when(F.abs("_y") > 0, F.abs("_y")).when(F.abs("_x") > 0, F.abs("_x")).otherwise(1.0)

    def element(scale: float | None, columns: list[np.ndarray]) -> Numbers:
        b, a = columns
        met = ~(np.isnan(a) | np.isnan(b))
        return _filter_element(b[met] / (scale or 1.0), a[met] / (scale or 1.0), delta, noise)

    def resume(scale: float | None, s: Numbers) -> Kalman:
        return Kalman(delta=delta, beta=s[0], alpha=s[1], p00=s[2], p01=s[3], p11=s[4], scale=scale)

    first = Kalman(delta=delta)
    scan = Scan(
        head=F.min_by(F.when(whole, unit), F.when(whole, F.col(order))),
        known=lambda over: F.first("_head", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        element=element, start=[first.beta, first.alpha, first.p00, first.p01, first.p11], carry=_filtered, resume=resume, step=kalman_row,
    )
    out = scanned(rows, key, order, ["_y", "_x"], KALMAN_FIELDS, scan, size).drop("_y", "_x")
    return out.withColumn("confident", (F.col("innovation_var") > 0) & (F.col("beta_var") < 1))


# ---- Wilder's mean


def atr_blocks(bars: DataFrame, key: str, order: str, n: int = 14, size: int = SERIES_BLOCK) -> DataFrame:
    """``sequential.atr`` with the series cut into blocks; ``order`` numbers the bars of a key from 1.

    Behind its first n values the mean is an affine map of itself, and maps compose.
    """
    keep = 1 - 1 / n

    def element(seen: float | None, columns: list[np.ndarray]) -> Numbers:
        v = columns[0][~np.isnan(columns[0])]
        warm = int(min(len(v), max(0, n - seen)))
        rest = v[warm:]
        return [float(len(v)), float(v[:warm].sum()), keep ** len(rest), float((rest * keep ** np.arange(len(rest) - 1, -1, -1.0)).sum() / n)]

    def carry(state: Numbers, e: Numbers) -> Numbers:
        seen, total, mean = state
        total += e[1]
        if seen + e[0] >= n:
            mean = e[2] * (total / n if seen < n else mean) + e[3]
        return [seen + e[0], total, mean]

    def resume(_: float | None, s: Numbers) -> Wilder:
        return Wilder(n, int(s[0]), s[1], s[2] if s[0] >= n else None)

    def previous(columns: dict[str, np.ndarray], start: int) -> dict[str, np.ndarray]:
        close = columns["close"]
        return {"_before": close[start - 1 : -1] if start else np.concatenate([[np.nan], close[:-1]])}

    spread = F.col("high") - F.col("low")
    before = F.col("_before")
    tr = F.when(before.isNull(), spread).otherwise(F.greatest(spread, F.abs(F.col("high") - before), F.abs(F.col("low") - before)))
    ranged = with_rolling(bars, key, order, ["close"], 1, ["_before"], previous).withColumn("tr", tr.cast("double")).drop("_before")
    scan = Scan(
        head=F.count(F.when(~F.isnan("tr"), F.col("tr"))),
        known=lambda over: F.coalesce(F.sum("_head").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        element=element, start=[0.0, 0.0, 0.0], carry=carry, resume=resume, step=lambda state, v: (state.step(v),),
    )
    return scanned(ranged, key, order, ["tr"], "atr double", scan, size)
