"""The driver's tables as bars, pairs and calendars, in Spark and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spreadwatch.functions.expressions import log_spread_bps
from spreadwatch.operators.alignment import pair_frame
from spreadwatch.plans.registry import table
from spreadwatch.sources.market import daily_vwap

#: What each symbol's moves are compared with.
BENCHMARKS = [("A", "N"), ("N", "R"), ("R", "A")]
PAIRS = [("A-N", "A", "N"), ("A-R", "A", "R"), ("N-R", "N", "R")]

BARS_SQL = """bars AS (
  SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS d, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS close
  FROM lineitem GROUP BY 1, 2)"""
FRAME_SQL = BARS_SQL + """, pairs(pair_id, a, b) AS (VALUES ('A-N', 'A', 'N'), ('A-R', 'A', 'R'), ('N-R', 'N', 'R')),
frame AS (
  SELECT p.pair_id, x.d, x.close AS pa, y.close AS pb FROM pairs p JOIN bars x ON x.symbol = p.a JOIN bars y ON y.symbol = p.b AND y.d = x.d)"""
SERIES_SQL = FRAME_SQL + """, series AS (
  SELECT *, round((ln(pa) - ln(pb)) * 10000, 6) AS v, row_number() OVER (PARTITION BY pair_id ORDER BY d) AS i FROM frame)"""
LAGGED_SQL = SERIES_SQL + """, lagged AS (
  SELECT *, lag(v) OVER k AS lv, v - lag(v) OVER k AS dv FROM series WINDOW k AS (PARTITION BY pair_id ORDER BY i))"""
EVENTS_SQL = """calendar AS (
  SELECT o_orderkey AS event_id, CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'N' ELSE 'R' END AS symbol, CAST(o_orderdate AS DATE) AS day, (o_totalprice / avg(o_totalprice) OVER () - 1) * 100 AS surprise_pct
  FROM orders)"""


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    trades = table(spark, sf_dir, "lineitem")
    exact = lambda c: F.col(c).cast("decimal(18,2)")  # noqa: E731  the tables hold cents
    return daily_vwap(trades, F.col("l_returnflag"), F.col("l_shipdate"), exact("l_extendedprice"), exact("l_quantity"))


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spark.createDataFrame(PAIRS, "pair_id string, a string, b string")
    return pair_frame(bars(spark, sf_dir), pairs)


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, d, pa, pb, v, i): log-ratio spreads to six places, numbered by date."""
    v = F.round(log_spread_bps(F.col("pa"), F.col("pb")), 6).alias("v")
    i = F.row_number().over(Window.partitionBy("pair_id").orderBy("d")).alias("i")
    return frame(spark, sf_dir).select("pair_id", "d", "pa", "pb", v, i)


def announced(status: Column) -> Column:
    """The symbol that an order of this status announces for."""
    return F.when(status == "F", "A").when(status == "O", "N").otherwise("R")


def announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, symbol, day, surprise_pct): every order is one; one number, the mean, is joined in."""
    orders = table(spark, sf_dir, "orders")
    mean = F.avg("o_totalprice").alias("mean")
    found = orders.crossJoin(F.broadcast(orders.agg(mean)))
    return found.select(
        F.col("o_orderkey").alias("event_id"), announced(F.col("o_orderstatus")).alias("symbol"), F.col("o_orderdate").cast("date").alias("day"),
        ((F.col("o_totalprice") / F.col("mean") - 1) * 100).alias("surprise_pct"),
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, ts, seq, price) of the event stream."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price")
    )


TICKS_SQL = "ticks AS (SELECT event_type AS symbol, ts, event_id AS seq, value AS price FROM events)"


def r6(*names: str):
    """Columns to six places, for comparison with another engine."""
    return [F.round(n, 6).alias(n) for n in names]
