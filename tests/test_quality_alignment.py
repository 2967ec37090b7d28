import time
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from spreadwatch.operators.alignment import asof_join, complete_legs, event_windows, pair_frame, within
from spreadwatch.operators.quality import mad_outliers, screen, screen_flags, screen_report
from spreadwatch.sources.market import ScriptedSource, SourceRegistry, TableSource, last_bars

D = date(2025, 1, 1)


def frame(spark, a, b):
    return spark.createDataFrame([("p", D + timedelta(i), x, y) for i, (x, y) in enumerate(zip(a, b, strict=True))], "pair_id string, d date, pa double, pb double")


def flags(spark, a, b, name):
    return [r.d for r in screen_flags(frame(spark, a, b)).where(name).collect()]


def test_spike_needs_a_return(spark):
    assert flags(spark, [61.0, 61.2, 0.7, 60.9, 61.1], [1.0] * 5, "spike_a") == [D + timedelta(2)]
    assert flags(spark, [71.5, 72.0, 33.0, 34.5, 31.0, 32.25, 35.0], [1.0] * 7, "spike_a") == []


def test_two_day_misprint_is_left_to_the_outlier_screen(spark):
    a = [61.0 + 0.01 * (i % 5) for i in range(60)]
    a[30] = a[31] = 0.7
    rows = screen_flags(frame(spark, a, [50.0 + 0.01 * (i % 3) for i in range(60)]))
    assert rows.where("spike_a").count() == 0
    assert sorted(r.d for r in rows.where("outlier").collect()) == [D + timedelta(30), D + timedelta(31)]
    report = screen_report(frame(spark, a, [50.0 + 0.01 * (i % 3) for i in range(60)])).first()
    assert report.rows_in - report.rows_out == report.n_outlier == 2 and len(report.dates) == 2


def test_carried_forward_print(spark):
    a, b = [80.5, 81.0, 81.0, 83.2], [4010.0, 4020.0, 4075.5, 4100.25]  # one leg stands still while the other gains over a percent
    assert flags(spark, a, b, "stale_a") == [D + timedelta(2)]
    assert flags(spark, [1.0, 1.0], [5.0, 5.001], "stale_a") == []
    assert screen(frame(spark, a, b)).count() == 3


def test_mad_needs_rows_and_spread(spark):
    df = spark.createDataFrame([("k", 1.0)] * 40 + [("k", 99.0)] + [("s", float(i)) for i in range(5)], "key string, v double")
    assert mad_outliers(df, "key", "v").where("outlier").count() == 0


def test_alignment_keeps_common_dates(spark):
    bars = spark.createDataFrame([("A", D, 1.0), ("A", D + timedelta(1), 2.0), ("B", D + timedelta(1), 3.0), ("B", D + timedelta(2), None), ("C", D + timedelta(1), 5.0)], "symbol string, d date, close double")
    got = pair_frame(bars, spark.createDataFrame([("x", "A", "B"), ("y", "B", "Z")], "pair_id string, a string, b string")).collect()
    assert [(r.pair_id, r.d, r.pa, r.pb) for r in got] == [("x", D + timedelta(1), 2.0, 3.0)]
    legs = spark.createDataFrame([("l", n, s, 3) for n, s in (("a", "A"), ("b", "B"), ("c", "C"))], "linkage_id string, leg string, symbol string, n_legs int")
    assert complete_legs(bars, legs).first().prices == {"a": 2.0, "b": 3.0, "c": 5.0}


def test_asof_directions_and_ties(spark):
    left = spark.createDataFrame([("k", 5, "x"), ("k", 1, "y"), ("q", 5, "z")], "key string, t int, name string")
    right = spark.createDataFrame([("k", 3, 30), ("k", 5, 50), ("k", 9, 90)], "key string, t int, n int")
    got = lambda **o: {r.name: r.r_n for r in asof_join(left, right, "key", F.col("t"), F.col("t"), ["n"], **o).collect()}
    assert got() == {"x": 50, "y": None, "z": None}
    assert got(strict=True) == {"x": 30, "y": None, "z": None}
    assert got(direction="forward") == {"x": 50, "y": 30, "z": None}
    assert got(direction="forward", strict=True) == {"x": 90, "y": 30, "z": None}


def test_asof_of_many_rows_on_one_key_is_linear(spark):
    """Both directions over a million rows of one key, against a sorted search."""
    n = 500_000
    left = spark.range(n).select(F.lit("k").alias("key"), (F.col("id") * 3).alias("t"))
    right = spark.range(n).select(F.lit("k").alias("key"), (F.col("id") * 3 + 1).alias("t"), F.col("id").alias("n"))
    for direction, off in (("forward", 0), ("backward", -1)):
        start = time.monotonic()
        out = asof_join(left, right, "key", F.col("t"), F.col("t"), ["n"], direction)
        assert out.where(F.coalesce("r_n", F.lit(-1)) != F.floor(F.col("t") / 3) + off).count() == 0
        assert time.monotonic() - start < 120


def test_event_entry_is_before_the_event(spark):
    bars = spark.createDataFrame([("S", D + timedelta(i), float(i)) for i in range(8)], "symbol string, d date, close double")
    events = spark.createDataFrame([(1, "S", D + timedelta(2)), (2, "S", D), (3, "S", D + timedelta(5))], "event_id int, symbol string, day date")
    got = {r.event_id: (r.p0, r.p1) for r in event_windows(events, bars, 3).collect()}
    assert got == {1: (1.0, 4.0)}


def test_calendar_window(spark):
    now = datetime(2025, 1, 1)
    legs = spark.createDataFrame([("l", "A"), ("l", "B")], "linkage_id string, symbol string")
    cal = spark.createDataFrame([("A", now + timedelta(days=2)), ("A", now + timedelta(days=1)), ("B", now + timedelta(days=9)), ("B", now - timedelta(days=1))], "symbol string, ts timestamp")
    got = {r.symbol: r.days_away for r in within(legs, cal, "symbol", F.lit("2025-01-01").cast("timestamp"), "ts", 3.0).collect()}
    assert got == {"A": 1.0, "B": None}


def test_sources(spark):
    src = ScriptedSource(spark, 5.0)
    src.set_price("A", 1.0, datetime(2025, 1, 1), stale=True)
    src.set_price("B", 2.0, datetime(2025, 1, 1))
    src.make_unreachable("B")
    src.set_bars("A", [(datetime(2025, 1, d), 1.0, 2.0, 0.5, float(d), None if d == 2 else 1.0) for d in (1, 2, 3)])
    assert [(r.symbol, r.stale) for r in src.quotes(["A", "B", "C"]).collect()] == [("A", True)]
    assert [r.close for r in src.bars(["A"], "1d", 5).orderBy("ts").collect()] == [1.0, 3.0]
    table = TableSource(spark.createDataFrame([("A", datetime(2025, 1, 1, 0, m), m, float(m)) for m in range(10)], "symbol string, ts timestamp, seq long, price double"))
    assert [(r.open, r.close, r.volume) for r in table.bars(["A"], "5m", 2).orderBy("ts").collect()] == [(0.0, 4.0, 5), (5.0, 9.0, 5)]
    assert SourceRegistry(src, table).cadence(1.0) == 60.0
    assert last_bars(spark.createDataFrame([("A", D, 1.0)], "symbol string, d date, close double"), 0).count() == 0
