"""Recurrences over ordered rows: what a window frame cannot express.

The per-key state is small and bounded; Spark partitions and sorts the rows, and each recurrence
is one step function that batch and streaming share. Tasks stream over the sorted rows: they hold
one Arrow batch and the state of one key, however long that key's series is.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any, ClassVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ARROW = {"double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "bigint": pa.int64(), "array<double>": pa.list_(pa.float64())}


def recurrence(df: DataFrame, key: str, order: str, needs: list[str], fields: str, start: Callable[[], Any], step: Callable[..., tuple]) -> DataFrame:
    """``df`` with ``fields``: for each row in order of its key what ``step(state, *needs)`` returns.

    Each key starts with a new state; null keys are one key. Null comes as None.
    """
    added = StructType.fromDDL(fields)
    kinds = [ARROW[f.dataType.simpleString()] for f in added.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            found = []
            for k, *values in zip(*(batch.column(c).to_pylist() for c in (key, *needs)), strict=True):
                if state is None or k != last:
                    last, state = k, start()
                found.append(step(state, *values))
            columns = zip(*found, strict=True) if found else [[]] * len(kinds)
            arrays = [pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *added.names])

    rows = df.repartition(key).sortWithinPartitions(key, order)
    return rows.mapInArrow(run, StructType([*df.schema.fields, *added.fields]))


# ---- hedge-ratio filter


@dataclass
class Kalman:
    """Random-walk slope and intercept of y on x, in units of the first y."""

    delta: float = 1e-7
    noise: float = 1e-5
    beta: float = 1.0
    alpha: float = 0.0
    p00: float = 1.0
    p01: float = 0.0
    p11: float = 1.0
    scale: float | None = None
    steps: int = 0

    def __post_init__(self) -> None:
        if not 0 < self.delta < 1:
            raise ValueError("delta lies between 0 and 1")

    def step(self, y: float, x: float) -> dict[str, float]:
        if self.scale is None:
            self.scale = abs(y) or abs(x) or 1.0
        s = self.scale
        h, q = x / s, self.delta / (1 - self.delta)
        p00, p01, p11 = self.p00 + q, self.p01, self.p11 + q
        predicted = h * self.beta + self.alpha
        g0, g1 = p00 * h + p01, p01 * h + p11
        var = h * g0 + g1 + self.noise
        error = y / s - predicted
        k0, k1 = g0 / var, g1 / var
        self.beta += k0 * error
        self.alpha += k1 * error
        self.p00, self.p01, self.p11 = p00 - k0 * g0, p01 - k0 * g1, p11 - k1 * g1
        self.steps += 1
        return {"beta": self.beta, "intercept": self.alpha * s, "beta_var": self.p00, "prediction": predicted * s, "innovation": error * s, "innovation_var": var * s * s, "kz": error / var**0.5 if var > 0 else 0.0}


KALMAN_FIELDS = "beta double, intercept double, beta_var double, prediction double, innovation double, innovation_var double, kz double"
KALMAN_NAMES = [f.split()[0] for f in KALMAN_FIELDS.split(", ")]


def kalman_row(state: Kalman, y: float | None, x: float | None) -> tuple:
    """What the filter says of a row; nulls of one without both prices, which leaves the filter as it is."""
    if x is None or y is None or x != x or y != y:
        return (None,) * len(KALMAN_NAMES)
    out = state.step(y, x)
    return tuple(out[n] for n in KALMAN_NAMES)


def kalman(df: DataFrame, key: str, order: str, y: str, x: str, delta: float = 1e-7) -> DataFrame:
    """(key, order, beta, ..., kz, confident) by one pass over each key's rows in order.

    A row without both prices gets nulls and leaves the filter as it is.
    """
    rows = df.select(key, order, F.col(y).cast("double").alias("_y"), F.col(x).cast("double").alias("_x"))
    out = recurrence(rows, key, order, ["_y", "_x"], KALMAN_FIELDS, lambda: Kalman(delta=delta), kalman_row).drop("_y", "_x")
    return out.withColumn("confident", (F.col("innovation_var") > 0) & (F.col("beta_var") < 1))


# ---- alert episodes

DORMANT, WATCHING, ALERT, DECAYING = "DORMANT", "WATCHING", "ALERT", "DECAYING"


@dataclass
class Episode:
    """One deviation from its first notice to its end; alerts once, and again only after a cooldown."""

    state: str = DORMANT
    opened: float | None = None
    alerted: float | None = None
    closed: float | None = None
    peak_z: float = 0.0
    peak_net: float = 0.0
    n: int = 0

    def step(self, ts: float, z: float | None, net: float | None, stale: bool, warn: float, alert: float, min_net: float, cooldown: float) -> bool:
        """Advance by one observation; ts and cooldown in seconds. True when an alert fires."""
        if stale or z is None or net is None or z != z or net != net:
            return False  # a gap in the feed neither opens nor closes anything
        z = abs(z)
        self.n, self.peak_z, self.peak_net = self.n + 1, max(self.peak_z, z), max(self.peak_net, net)
        wide = z >= alert and net >= min_net
        resting = self.alerted is not None and ts - self.alerted < cooldown
        if self.state == DORMANT:
            if z >= warn:
                self.state, self.opened, self.closed, self.peak_z, self.peak_net = WATCHING, ts, None, z, net
        elif self.state == ALERT:
            if z < alert:
                self.state = DECAYING
        elif z < warn:
            self.state, self.closed, self.opened, self.peak_z, self.peak_net, self.n = DORMANT, ts, None, 0.0, 0.0, 0
        elif wide and not resting:
            self.state, self.alerted = ALERT, ts
            return True
        elif wide and self.state == DECAYING:
            self.state = ALERT
        return False


def episodes(df: DataFrame, key: str, ts: str, z: str, net: str, stale: str, warn: float, alert: float, min_net: float, cooldown_seconds: float) -> DataFrame:
    """(key, ts, state, fired, peak_z, peak_net) after each row. ts is a number of seconds."""

    def step(episode: Episode, at: float, z: float | None, net: float | None, stale: bool | None) -> tuple:
        fired = episode.step(float(at), z, net, bool(stale), warn, alert, min_net, cooldown_seconds)
        return episode.state, fired, episode.peak_z, episode.peak_net

    out = recurrence(df.select(key, ts, z, net, stale), key, ts, [ts, z, net, stale], "state string, fired boolean, peak_z double, peak_net double", Episode, step)
    return out.drop(z, net, stale)


# ---- cooldown


def greedy_cooldown(candidates: DataFrame, key: str, i: str, h: int) -> DataFrame:
    """Of candidate rows those at least ``h`` after the last accepted one; a fold over each key's few candidates."""
    places = candidates.groupBy(key).agg(F.array_sort(F.collect_list(i)).alias("_all"))
    fold = F.aggregate(
        "_all",
        F.array().cast(f"array<{dict(candidates.dtypes)[i]}>"),
        lambda taken, at: F.when((F.size(taken) == 0) | (at >= F.element_at(taken, -1) + h), F.concat(taken, F.array(at))).otherwise(taken),
    )
    chosen = places.select(key, F.explode(fold).alias(i))
    return candidates.join(chosen, [key, i], "left_semi")


# ---- chart levels


def true_range(bars: DataFrame, key: str, order: str) -> Column:
    before = F.lag("close").over(Window.partitionBy(key).orderBy(order))
    return F.when(before.isNull(), F.col("high") - F.col("low")).otherwise(F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def pivots(bars: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """Adds pivot_high and pivot_low: the bar's own price where it is beyond n bars on either side."""
    w = Window.partitionBy(key).orderBy(order)
    before, after = w.rowsBetween(-n, -1), w.rowsBetween(1, n)
    whole = (F.count("high").over(before) == n) & (F.count("high").over(after) == n)
    top = whole & (F.col("high") > F.max("high").over(before)) & (F.col("high") > F.max("high").over(after))
    low = whole & (F.col("low") < F.min("low").over(before)) & (F.col("low") < F.min("low").over(after))
    return bars.withColumns({"pivot_high": F.when(top, F.col("high")), "pivot_low": F.when(low, F.col("low"))})


@dataclass
class Levels:
    """Price levels that later pivots merge into: mean, touches, last bar, lowest and highest pivot.

    A pivot merges into the oldest level within its tolerance. The means lie sorted in buckets of
    at most ``BUCKET``, each with its oldest level's number, so that is a search for both ends of
    the tolerance and a minimum over what lies between. A price that isn't finite, or a tolerance
    that isn't a number, merges with nothing.
    """

    BUCKET: ClassVar[int] = 256

    levels: list[list[float]] = field(default_factory=list)
    means: list[list[float]] = field(default_factory=lambda: [[]])
    numbers: list[list[int]] = field(default_factory=lambda: [[]])
    tops: list[float] = field(default_factory=list)
    oldest: list[int] = field(default_factory=list)

    def absorb(self, price: float, bar: int, tolerance: float) -> None:
        number = self._first_within(price, tolerance)
        if number is None:
            number = len(self.levels)
            self.levels.append([price, 1, bar, price, price])
        else:
            level = self.levels[number]
            self._take_out(level[0], number)
            level[1] += 1
            level[0] += (price - level[0]) / level[1]
            level[2:] = [bar, min(level[3], price), max(level[4], price)]
        if math.isfinite(price):
            self._put_in(self.levels[number][0], number)

    def _first_within(self, price: float, tolerance: float) -> int | None:
        if not (math.isfinite(price) and tolerance >= 0 and self.tops):
            return None
        # a difference never falls when the mean rises, so those within the tolerance lie together
        away = lambda mean: mean - price
        first = bisect_left(self.tops, -tolerance, key=away)
        last = min(bisect_right(self.tops, tolerance, key=away), len(self.tops) - 1)
        if first == len(self.tops):
            return None
        found = self.oldest[first + 1 : last]
        for b in {first, last}:
            low, high = bisect_left(self.means[b], -tolerance, key=away), bisect_right(self.means[b], tolerance, key=away)
            found += self.numbers[b][low:high]
        return min(found, default=None)

    def _put_in(self, mean: float, number: int) -> None:
        b = min(bisect_left(self.tops, mean), max(0, len(self.tops) - 1))
        at = bisect_left(self.means[b], mean)
        self.means[b].insert(at, mean)
        self.numbers[b].insert(at, number)
        if len(self.means[b]) > self.BUCKET:
            half = self.BUCKET // 2
            self.means[b : b + 1] = [self.means[b][:half], self.means[b][half:]]
            self.numbers[b : b + 1] = [self.numbers[b][:half], self.numbers[b][half:]]
            self.tops[b : b + 1] = [self.means[b][-1], self.means[b + 1][-1]]
            self.oldest[b : b + 1] = [min(self.numbers[b]), min(self.numbers[b + 1])]
        elif not self.tops:
            self.tops, self.oldest = [mean], [number]
        else:
            self.tops[b], self.oldest[b] = self.means[b][-1], min(self.oldest[b], number)

    def _take_out(self, mean: float, number: int) -> None:
        b = bisect_left(self.tops, mean)
        at = bisect_left(self.means[b], mean)
        while at == len(self.means[b]) or self.numbers[b][at] != number:  # equal means may run on into the next bucket
            b, at = (b + 1, 0) if at == len(self.means[b]) else (b, at + 1)
        del self.means[b][at], self.numbers[b][at]
        if self.means[b]:
            self.tops[b], self.oldest[b] = self.means[b][-1], min(self.numbers[b])
        elif len(self.means) > 1:
            del self.means[b], self.numbers[b], self.tops[b], self.oldest[b]
        else:
            self.tops, self.oldest = [], []


@dataclass
class Wilder:
    """Wilder's running mean: the plain mean of the first n, then a smoothing of 1/n."""

    n: int
    seen: int = 0
    total: float = 0.0
    mean: float | None = None

    def step(self, value: float | None) -> float | None:
        if value is None or value != value:
            return self.mean
        self.seen += 1
        if self.seen > self.n:
            self.mean += (value - self.mean) / self.n
        else:
            self.total += value
            self.mean = self.total / self.n if self.seen == self.n else None
        return self.mean


def atr(bars: DataFrame, key: str, order: str, n: int = 14) -> DataFrame:
    """``bars`` with tr and atr, atr null for the first n - 1 bars of a key; a bar without a range leaves it as it is."""
    ranged = bars.withColumn("tr", true_range(bars, key, order).cast("double"))
    return recurrence(ranged, key, order, ["tr"], "atr double", lambda: Wilder(n), lambda state, tr: (state.step(tr),))


LEVEL_FIELDS = ["side", "price", "touches", "bar", "low", "high", "close", "atr"]


def levels(bars: DataFrame, key: str, order: str, n: int = 10, merge: float = 0.5) -> DataFrame:
    """Per key the levels at its last bar, resistance from high pivots and support from low ones.

    bars must have atr; a pivot is known, and merged by the range of that day, n bars later. Only
    pivots leave Spark's windows; a task folds them key by key.
    """
    w = Window.partitionBy(key).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = pivots(bars, key, order, n).select(
        key, order, *(F.col(c).cast("double").alias(c) for c in ("pivot_high", "pivot_low")), (F.row_number().over(w) - 1).cast("long").alias("bar"),
        (F.lead("atr", n).over(w) * merge).cast("double").alias("tolerance"), F.last("close").over(whole).cast("double").alias("close"), F.last("atr").over(whole).cast("double").alias("atr"),
    )
    found = found.where("tolerance is not null and (pivot_high is not null or pivot_low is not null)")
    kind = found.schema[key]
    schema = StructType([kind]).add("side", "string").add("price", "double").add("touches", "long").add("bar", "long")
    for c in ("low", "high", "close", "atr"):
        schema = schema.add(c, "double")
    needs = [key, "pivot_high", "pivot_low", "bar", "tolerance", "close", "atr"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, last = None, None

        def finished() -> pa.RecordBatch:
            rows = [(last[0], side, *level, *last[1:]) for side, x in sides.items() for level in x.levels]
            columns = zip(*rows, strict=True)
            types = [at, pa.string(), pa.float64(), pa.int64(), pa.int64(), *[pa.float64()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], [key, *LEVEL_FIELDS])

        for batch in batches:
            at = batch.schema.field(key).type
            for k, top, low, bar, tolerance, close, range_ in zip(*(batch.column(c).to_pylist() for c in needs), strict=True):
                if sides is None or k != last[0]:
                    if sides is not None:
                        yield finished()
                    sides, last = {"resistance": Levels(), "support": Levels()}, (k, close, range_)
                for side, price in (("resistance", top), ("support", low)):
                    if price is not None:
                        sides[side].absorb(price, bar, tolerance)
        if sides is not None:
            yield finished()

    return found.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, schema)


def ranked_levels(found: DataFrame, key: str, most: int = 6, near_pct: float = 25.0, min_touch: int = 2, equal: float = 0.12) -> DataFrame:
    """The strongest levels near the last close, with their kind; distance counts before rank."""
    near = found.where(F.abs(F.col("price") - F.col("close")) <= F.col("close") * near_pct / 100)
    w = Window.partitionBy(key, "side").orderBy(F.desc("touches"), "bar", "price")
    top = near.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= most) & (F.col("touches") >= min_touch))
    up = F.col("side") == "resistance"
    pool = (F.col("touches") >= 2) & (F.col("high") - F.col("low") <= F.col("atr") * equal)
    swept = F.when(up, F.col("close") > F.col("price")).otherwise(F.col("close") < F.col("price"))
    label = F.when(swept, "swept").when(pool & up, "BSL").when(pool, "SSL").otherwise(F.concat(F.col("touches").cast("string"), F.lit("x")))
    return top.withColumns({"pool": pool, "swept": swept, "label": label})


#: Trading sessions in their own time zones.
SESSIONS = {
    "sydney": ("Australia/Sydney", 7 * 60, 16 * 60),
    "tokyo": ("Asia/Tokyo", 9 * 60, 15 * 60),
    "india": ("Asia/Kolkata", 9 * 60 + 15, 15 * 60 + 30),
    "london": ("Europe/London", 8 * 60, 16 * 60 + 30),
    "new_york": ("America/New_York", 9 * 60 + 30, 16 * 60),
}


def in_session(ts: Column, name: str) -> Column:
    """Whether a UTC timestamp lies in a session, daylight saving included."""
    zone, start, end = SESSIONS[name]
    local = F.from_utc_timestamp(ts, zone)
    minute = F.hour(local) * 60 + F.minute(local)
    return (minute >= start) & (minute < end)
