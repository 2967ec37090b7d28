"""Joining series by date, by nearest earlier or later date, and by interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pair_frame(bars: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, d, pa, pb) on the dates both symbols of each pair (pair_id, a, b) have.

    The joins hash on symbol and then on (pair, date), so a busy date or symbol is never one task.
    """
    leg = lambda side: bars.select(F.col("symbol").alias(side), "d", F.col("close").alias(f"p{side}"))
    left = pairs.join(leg("a"), "a").select("pair_id", "b", "d", "pa")
    return left.join(leg("b"), ["b", "d"]).where("pa is not null and pb is not null").select("pair_id", "d", "pa", "pb")


def complete_legs(bars: DataFrame, legs: DataFrame) -> DataFrame:
    """(linkage_id, d, prices map<leg, close>) for dates on which every leg has a price.

    legs: (linkage_id, leg, symbol, n_legs).
    """
    met = legs.join(bars.where("close is not null"), "symbol")
    whole = met.groupBy("linkage_id", "d").agg(F.collect_list(F.struct("leg", "close")).alias("found"), F.max("n_legs").alias("n_legs"))
    return whole.where(F.size("found") == F.col("n_legs")).select("linkage_id", "d", F.map_from_entries(F.array_sort("found")).alias("prices"))


def asof_join(left: DataFrame, right: DataFrame, key: str, left_ts: Column, right_ts: Column, values: list[str], direction: str = "backward", strict: bool = False) -> DataFrame:
    """For each left row the nearest right row of its key, earlier or later, as r_ts and r_<value>.

    Both sides go through one sort per key as a union, backwards in time for later rows; the last
    right row passed is carried along by a growing window frame, which Spark evaluates step by
    step, so cost is linear in rows and no pair of rows is ever formed. ``strict`` leaves out rows
    of the same time. Left rows without a match keep nulls.
    """
    back = direction == "backward"
    carried = F.struct(right_ts.alias("ts"), *values)
    sides = left.select(F.col(key), left_ts.alias("_ts"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(carried.alias("x")).schema["x"].dataType).alias("_right"), F.lit(1).alias("_is_left"))
    others = right.select(F.col(key), right_ts.alias("_ts"), F.lit(None).cast(sides.schema["_left"].dataType).alias("_left"), carried.alias("_right"), F.lit(0).alias("_is_left"))
    # on equal times the right row must be passed before the left one unless that is excluded
    first = F.col("_is_left").desc() if strict else F.col("_is_left").asc()
    w = Window.partitionBy(key).orderBy(F.col("_ts").asc() if back else F.col("_ts").desc(), first)
    near = F.last("_right", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    found = sides.unionByName(others).withColumn("_near", near).where("_is_left = 1")
    return found.select("_left.*", F.col("_near.ts").alias("r_ts"), *[F.col(f"_near.{v}").alias(f"r_{v}") for v in values])


def event_windows(events: DataFrame, bars: DataFrame, horizon: int) -> DataFrame:
    """Adds to events (symbol, day, ...) entry_d, p0 and exit_d, p1.

    Entry is the last bar strictly before the event's day; exit the horizon-th bar on or after it,
    and at least one more bar must follow. Trading days are numbered per symbol, so both are found
    by one as-of step and two equi-joins on the number.
    """
    numbered = bars.withColumn("rank", F.row_number().over(Window.partitionBy("symbol").orderBy("d")))
    met = asof_join(events, numbered, "symbol", F.col("day"), F.col("d"), ["rank", "close"], "backward", strict=True)
    met = met.where("r_rank is not null").withColumnRenamed("r_ts", "entry_d").withColumnRenamed("r_close", "p0")
    at = lambda n, d, p: numbered.select("symbol", (F.col("rank") - n).alias("r_rank"), F.col("d").alias(d), F.col("close").alias(p))
    met = met.join(at(horizon, "exit_d", "p1"), ["symbol", "r_rank"])
    enough = at(horizon + 1, "_d", "_p").select("symbol", "r_rank")
    return met.join(enough, ["symbol", "r_rank"], "left_semi").drop("r_rank")


def within(left: DataFrame, calendar: DataFrame, key: str, now: Column, ts: str, days: float) -> DataFrame:
    """Rows of ``left`` met with the earliest event of their key from ``now`` to ``days`` later."""
    away = (F.unix_micros(F.col(ts)) - F.unix_micros(now)) / 86_400e6
    near = calendar.withColumn("days_away", away).where((F.col("days_away") >= 0) & (F.col("days_away") <= days))
    near = near.groupBy(key).agg(F.min_by(ts, "days_away").alias("event_ts"), F.min("days_away").alias("days_away"))
    return left.join(near, key, "left")
