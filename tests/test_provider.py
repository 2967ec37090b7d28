"""Providers as data sources: the same ticks as the table, filters at the feed, streams with offsets."""

import os
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from spreadwatch.sources import provider as P
from spreadwatch.sources.market import ohlc

T = datetime(2024, 1, 1)
COLUMNS = ("event_type", "ts", "event_id", "value")


def write(path, rows, group=50):
    table = pa.table({"event_type": [r[0] for r in rows], "ts": pa.array([r[1] for r in rows], pa.timestamp("us")), "event_id": [r[2] for r in rows], "value": pa.array([r[3] for r in rows], pa.float64())})
    pq.write_table(table, path, row_group_size=group)


@pytest.fixture
def folder(tmp_path):
    rows = [(("a", "b", "c")[i % 3], T + timedelta(minutes=i), i, float(i)) for i in range(600)]
    write(f"{tmp_path}/one.parquet", rows[:300])
    write(f"{tmp_path}/two.parquet", [*rows[300:], (None, T, 9999, 1.0), ("a", None, 9998, 1.0), ("b", T + timedelta(days=3), 9997, None)])
    return tmp_path


def test_batch_equals_the_table(spark, folder):
    name = P.register_feed(spark, "feed_batch", P.ParquetFeed(str(folder), COLUMNS))
    got = spark.read.format(name).load()
    assert got.rdd.getNumPartitions() == 13  # a row group each
    rows = sorted((r.seq, r.symbol, r.price) for r in got.collect())
    assert len(rows) == 602 and (9998, "a", 1.0) not in rows  # a tick without a time is none
    assert (9997, "b", None) in rows and (9999, None, 1.0) in rows


def test_filters_reach_the_feed(spark, folder):
    name = P.register_feed(spark, "feed_filter", P.ParquetFeed(str(folder), COLUMNS))
    ticks = spark.read.format(name).load()
    some = ticks.where((F.col("ts") >= T + timedelta(minutes=100)) & (F.col("ts") < T + timedelta(minutes=150)) & F.col("symbol").isin("a", "b") & (F.col("price") > 120))
    assert sorted(r.seq for r in some.collect()) == [i for i in range(121, 150) if i % 3 < 2]
    assert some.rdd.getNumPartitions() <= 2  # one row group of twelve, and the one that holds all times
    edges = ticks.where((F.col("ts") > T + timedelta(minutes=5)) & (F.col("ts") <= T + timedelta(minutes=7)) & (F.col("symbol") == "a"))
    assert [r.seq for r in edges.collect()] == [6]
    assert ticks.where("symbol = 'zz'").collect() == [] and ticks.where("symbol = 'a' and symbol = 'b'").count() == 0


def test_what_is_wanted():
    w = P.Wanted().among(["a", "b"]).among(["b", "c"]).between(low=3).between(low=1, high=9)
    assert (w.symbols, w.low, w.high) == (frozenset("b"), 3, 9)
    reader = P.FeedReader(P.ParquetFeed("nowhere"))
    left = list(reader.pushFilters([P.EqualTo(("price",), 1.0), P.GreaterThan(("ts",), T), P.EqualTo(("symbol",), "a")]))
    assert [f.attribute for f in left] == [("price",)]
    assert reader.wanted == P.Wanted(frozenset("a"), P.micros(T) + 1)


def test_stream_takes_what_is_new_and_restarts(spark, folder, tmp_path_factory):
    out = tmp_path_factory.mktemp("out")
    name = P.register_feed(spark, "feed_stream", P.ParquetFeed(str(folder), COLUMNS))

    def run():
        stream = spark.readStream.format(name).option("after", "2024-01-01T01:00:00").load()
        stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        return sorted(r.seq for r in spark.read.parquet(f"{out}/rows").collect())

    assert run() == [*range(61, 600), 9997]
    assert run() == [*range(61, 600), 9997]  # nothing new
    write(f"{folder}/three.parquet", [("c", T + timedelta(days=4), 10_000, 5.0)])
    assert run() == [*range(61, 600), 9997, 10_000]


def test_stream_of_a_table_gives_its_bars(spark, tmp_path):
    """Ticks of the events table through the stream make the bars that the table makes."""
    path = f"{os.environ.get('TEST_SF_DIR', '/root/testdata/sf0.001')}/events.parquet"
    name = P.register_feed(spark, "feed_events", P.ParquetFeed(path, COLUMNS))
    spark.readStream.format(name).load().writeStream.format("parquet").option("path", f"{tmp_path}/rows").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    plain = spark.read.parquet(path).select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"))
    bars = lambda df: sorted(map(tuple, ohlc(df, "1h").collect()))
    assert bars(spark.read.parquet(f"{tmp_path}/rows")) == bars(plain) != []
