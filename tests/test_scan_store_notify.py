from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from spreadwatch.operators.detector import Detector, verdicts
from spreadwatch.sources import notify, reports
from spreadwatch.sources.config import AlertRule, Linkage, Universe
from spreadwatch.sources.store import Store
from spreadwatch.streaming import scan

T = datetime(2025, 1, 1)
LINK = Linkage("x", "", "tradeable", {"a": ("A", "t"), "b": ("B", "t")}, "b * k", "a", {"k": 1.0}, {"cost": 5.0}, AlertRule(1.8, 2.5, 0.0, 60))
U = Universe((LINK,))
BOOK = "linkage_id string, ts timestamp, prices map<string,double>, leg_ts map<string,timestamp>, leg_stale map<string,boolean>"


def books(n=330, seed=3, stale=(200,), shock=(300,)):
    rng, s, out = np.random.default_rng(seed), 0.0, []
    for i in range(n):
        s = s * 0.6 + rng.normal(0, 12) + (250 if i in shock else 0)
        ts, b = T + timedelta(hours=i), 100 + 0.01 * i
        old = ts - timedelta(hours=2) if i in stale else ts
        out.append(("x", ts, {"a": b * (1 + s / 1e4), "b": b}, {"a": ts, "b": old}, {"a": False, "b": False}))
    return out


def plain(df):
    return [(r.ts, r.seen, r.alert, r.reason, r.percentile) for r in df.orderBy("ts").collect()]


def test_one_at_a_time_equals_windows(spark):
    rng, v, vs = np.random.default_rng(2), 0.0, []
    for i in range(600):
        v = v * 0.7 + rng.normal(0, 20) + (300 if i == 500 else 0)
        vs.append(float(v))
    table = verdicts(spark.createDataFrame([("k", i, x) for i, x in enumerate(vs, 1)], "key string, i long, v double"), "key", "i", "v", 5.0).orderBy("i").collect()
    d = Detector()
    for row, x in zip(table, vs, strict=True):
        said = d.step(x, 100.0 + x / 100, 100.0, 5.0)
        assert said["alert"] == row.alert and said["percentile"] == (None if row.percentile is None else pytest.approx(row.percentile))
    assert any(r.alert for r in table)


def test_snapshot_is_invisible():
    rng = np.random.default_rng(1)
    vs = [float(x) for x in rng.normal(0, 12, 520)]
    straight, half = Detector(), Detector()
    a = [straight.step(x, 100 + x, 100.0, 1.0) for x in vs]
    b = [half.step(x, 100 + x, 100.0, 1.0) for x in vs[:260]]
    half = Detector.restore(half.snapshot())
    assert a == b + [half.step(x, 100 + x, 100.0, 1.0) for x in vs[260:]]
    with pytest.raises(ValueError):
        Detector.restore(straight.snapshot().replace('"version": 2', '"version": 1'))


def test_observations_flag_late_legs_and_leave_out_gaps(spark):
    rows = books(3, stale=(1,)) + [("x", T, {"a": 1.0}, {"a": T}, {"a": False})]
    got = scan.observations(spark.createDataFrame(rows, BOOK), U).orderBy("ts").collect()
    assert [(r.stale, r.stale_reason) for r in got] == [(False, None), (True, "b is old"), (False, None)]


def test_stream_equals_batch_across_restarts(spark, tmp_path):
    rows = books()
    want = plain(scan.replay(scan.observations(spark.createDataFrame(rows, BOOK), U), U))
    store, sent = Store(spark, f"file://{tmp_path}/store"), notify.MemoryNotifier()
    for part, cut in enumerate((rows[:140], rows[140:])):
        spark.createDataFrame(cut, BOOK).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(BOOK).parquet(f"{tmp_path}/in")
        scan.start(stream, U, store, sent, f"{tmp_path}/checkpoint", cadence_seconds=None).awaitTermination()
    assert [w[2] for w in want].count(True) >= 1
    assert store.alert_count() == [w[2] for w in want].count(True) == len(sent.texts) and store.alert_count("none") == 0
    assert store.observations().count() == len(rows) - 1  # the stale one is not kept
    state = store.state().first()
    assert state.fingerprint == LINK.fingerprint and Detector.restore(state.snapshot).seen == len(rows) - 1
    got = {r.linkage_id: r.outcome for r in store.resume(spark.createDataFrame([("x", LINK.fingerprint), ("y", "f")], "linkage_id string, fingerprint string")).collect()}
    assert got == {"x": "restored", "y": "no saved state"}
    assert store.resume(U.frame(spark).select("linkage_id", "fingerprint")).first().ready
    done = reports.outcomes(store, 1).collect()
    assert done and all(r.resolved_at is None or r.resolved_at >= r.ts + timedelta(days=1) for r in done)
    page = reports.dashboard(store, U)
    assert "<script" not in page and "Detectors" in page and "Scorecard" in page
    warm = scan.replay(scan.observations(spark.createDataFrame(rows[300:], BOOK), U), U, {"x": Detector().snapshot()})
    assert warm.count() == 30


def observed(ts, value):
    return ("x", ts, "f", 1.0, 1.0, value, False)


SEEN = "linkage_id string, ts timestamp, fingerprint string, reference_price double, fair_value double, spread_bps double, stale boolean"


def test_a_new_checkpoint_loses_nothing(spark, tmp_path):
    """Batch numbers start again: earlier batches stay, and the newest state counts, not the largest number."""
    store = Store(spark, f"file://{tmp_path}/store")
    state = lambda ts, seen: spark.createDataFrame([("x", "f", 2, f'{{"seen": {seen}}}', None, ts)], "linkage_id string, fingerprint string, version int, snapshot string, last_alert_at timestamp, updated_at timestamp")
    for run, batch, ts, seen in (("one", 0, T, 100), ("one", 7, T + timedelta(days=1), 130), ("two", 0, T + timedelta(days=2), 140), ("two", 0, T + timedelta(days=2), 140)):
        store.record_observations(spark.createDataFrame([observed(ts, float(seen))], SEEN), batch, run)
        store.save_state(state(ts, seen), batch)
    assert store.observations().count() == 3
    (row,) = store.state().collect()
    assert row.updated_at == T + timedelta(days=2) and len(list((tmp_path / "store/detector_state").iterdir())) == 1
    (tmp_path / "store/detector_state/half").mkdir()  # a save that stopped
    assert store.state().count() == 1
    outcome = lambda: {(r.linkage_id, r.outcome, r.ready) for r in store.resume(spark.createDataFrame([("x", "f")], "linkage_id string, fingerprint string")).collect()}
    assert outcome() == {("x", "restored", True)}
    store.save_state(state(T + timedelta(days=3), 119), 1)
    assert outcome() == {("x", "restored", False)}
    store.save_state(state(T + timedelta(days=4), '"no number"'), 2)
    assert outcome() == {("x", "unreadable", False)}


def test_two_checkpoints_share_a_store_and_history_warms_up(spark, tmp_path):
    rows = books(330)
    store, sent = Store(spark, f"file://{tmp_path}/store"), notify.MemoryNotifier()
    history = spark.createDataFrame(rows[:200], BOOK)
    for part, cut in enumerate((rows[200:260], rows[260:])):
        spark.createDataFrame(cut, BOOK).coalesce(1).write.parquet(f"{tmp_path}/in{part}")
        stream = spark.readStream.schema(BOOK).parquet(f"{tmp_path}/in{part}")
        scan.start(stream, U, store, sent, f"{tmp_path}/checkpoint{part}", cadence_seconds=None, history=history).awaitTermination()
    assert store.observations().select("ts").distinct().count() == 129  # one of them is stale
    assert Detector.restore(store.state().first().snapshot).seen == 329 and store.alert_count() == len(sent.texts)


def test_books_need_all_legs(spark):
    quote = "poll_ts timestamp, symbol string, price double, ts timestamp, stale boolean"
    rows = [(T, "A", 1.0, T, False), (T, "B", 2.0, T, True), (T + timedelta(hours=1), "A", 1.0, T, False), (T + timedelta(hours=2), "A", 1.0, T, False), (T + timedelta(hours=2), "B", None, T, False)]
    (book,) = scan.books(spark.createDataFrame(rows, quote), U.legs_frame(spark)).collect()
    assert (book.ts, book.prices, book.leg_stale) == (T, {"a": 1.0, "b": 2.0}, {"a": False, "b": True})
    (seen,) = scan.observations(spark.createDataFrame([book]), U).collect()
    assert seen.stale and seen.stale_reason == "b is flagged"


def test_text_reports(spark):
    found = spark.createDataFrame([("p", 300, 0.9, 0.01, 2.0, 5.0, True, "admitted", 0.02), ("q", 300, 0.9, 0.5, None, None, False, "not cointegrated", 0.02)], "pair_id string, n int, beta double, coint_p double, half_life double, net_edge double, admitted boolean, reason string, threshold double")
    text = reports.fit_report(found)
    assert text.startswith("2 pairs, 2 tested, 1 admitted") and text.index("| p |") < text.index("| q |")
    assert {tuple(r) for r in reports.universe_counts(U.frame(spark)).collect()} == {("tradeable", 1, 2)}
    assert "| ratio |" in reports.calibration_report(spark.createDataFrame([("ratio", "k", 1.0, 1.1, 10.0, 40, 1.0, "wrong")], "linkage_id string, param string, asserted double, estimated double, drift_pct double, samples int, sd_bps double, verdict string"))


def test_events_block_alerts(spark):
    v = spark.createDataFrame([("x", T, True), ("x", T + timedelta(days=9), True)], "linkage_id string, ts timestamp, alert boolean")
    legs = spark.createDataFrame([("x", "A")], "linkage_id string, symbol string")
    cal = spark.createDataFrame([("A", T + timedelta(days=2))], "symbol string, event_ts timestamp")
    assert {r.ts: r.blocked for r in scan.suppressed(v, legs, cal, 3.0).collect()} == {T: True, T + timedelta(days=9): False}


def test_channels_never_raise_and_shorten():
    got = []
    ok = notify.discord("http://h")
    ok.post = lambda url, body, headers: got.append(body)
    assert ok.send("x" * 5000) and len(got[0]) < 2000 and ok.sent == 1

    def broken(url, body, headers):
        raise OSError("secret-token")

    bad = notify.telegram("secret-token", "1")
    bad.post = broken
    assert not bad.send("x") and bad.failed == 1 and "secret" not in bad.last_error
    memory = notify.MemoryNotifier()
    assert notify.FanOut([bad, memory]).send("hi") and memory.texts == ["hi"] and not notify.FanOut([bad]).send("x")


def test_message_has_the_arithmetic(spark):
    df = spark.createDataFrame([("x", "tradeable", -34.1, -3.4, 1.05, 0.6, 2.4, -14.5, 59.0, 32.1, 26.9)], "linkage_id string, category string, spread_bps double, kz double, beta double, percentile double, half_life double, t double, expected_bps double, net_bps double, friction double")
    text = df.select(notify.message().alias("t")).first().t
    assert "NET        +32.1 bps" in text and "5.0% away" in text and notify.NOTES["tradeable"] in text
    assert df.select(notify.message(50).alias("t")).first().t.endswith("...")


def test_reports(spark):
    df = spark.createDataFrame([("p|q", 1.5), ("r", None)], "pair_id string, v double")
    assert "p\\|q" in reports.markdown(df, ["pair_id", "v"]) and "and 1 more" in reports.markdown(df, ["pair_id"], 1)
    assert "0 of 4 admitted" in reports.fitted_universe(spark.createDataFrame([(False,)], "admitted boolean"), [], 4)


def test_pairs_report_has_every_pair_and_why_one_is_missing(spark):
    catalogue = spark.createDataFrame([(f"p{i:03}", f"g{i:03}", "A", "B", "full", "same metal" if i else None) for i in range(230)], "pair_id string, grp string, a string, b string, access string, mechanism string")
    profile = "pair_id string, n long, start date, end date, beta double, r2 double, return_corr double, corr_now double, corr_min double, corr_max double, stability string, sd double, current_z double, half_life double, coint_p double, adf_p double, verdict string"
    whole = ("p001", 300, T.date(), T.date(), 0.9, 0.8, 0.7, 0.6, 0.5, 0.9, "variable", 12.0, 1.5, 4.0, 0.01, 0.02, "tight")
    few = ("p002", 20, T.date(), T.date(), 0.9, 0.8, 0.7, None, None, None, None, 12.0, 1.5, None, None, None, None)
    text = reports.pairs_report(spark.createDataFrame([whole, few], profile), catalogue)
    assert text.count("\n## ") == text.count("\n### ") == 230
    assert "cointegration p 0.01, unit root p 0.02" in text and "- why: same metal" in text
    assert "- could not be tested: only 20 rows" in text and text.count("- not profiled: no prices for both legs") == 228


def test_scorecard_counts_all_alerts(spark, tmp_path):
    from spreadwatch.sources.store import ALERTS

    store = Store(spark, f"file://{tmp_path}/store")
    rows = [("x", T + timedelta(hours=i), "f", "tradeable", 50.0, None, None, None, None, None, 20.0, 5.0, 15.0) for i in range(450)]
    store.record_alerts(spark.createDataFrame(rows, ALERTS), 0)
    store.record_observations(spark.createDataFrame([observed(T + timedelta(days=40), 10.0)], SEEN), 0)
    assert reports.outcomes(store).where("net = 35").count() == 450
    page = reports.dashboard(store, U)
    assert "<td>450</td><td>450</td><td>450</td>" in page and "the first 200 of 450" in page


def test_repeated_quotes_make_one_book(spark):
    twice = [(T, "A", 1.0, T, False), (T, "A", 1.0, T, False), (T, "A", 3.0, T - timedelta(minutes=1), False), (T, "B", 2.0, T, False)]
    (book,) = scan.books(spark.createDataFrame(twice, QUOTE), U.legs_frame(spark)).collect()
    assert book.prices == {"a": 1.0, "b": 2.0}  # the latest quote of each leg


QUOTE = "poll_ts timestamp, symbol string, price double, ts timestamp, stale boolean"


def quotes_of(rows):
    """Each book as quotes: an older one of each leg first, the one that counts, and that one again."""
    out = []
    for _, ts, prices, leg_ts, _ in rows:
        for leg, symbol in (("a", "A"), ("b", "B")):
            own = (ts, symbol, prices[leg], leg_ts[leg], False)
            out += [(ts, symbol, prices[leg] * 2, leg_ts[leg] - timedelta(seconds=9), False), own, own]
    return out


def test_quotes_to_verdicts_as_one_stream_across_restarts(spark, tmp_path):
    """A stream of quotes, cut in the middle of a poll and started again, says what the replay of its books says."""
    rows = books(330)
    quotes = quotes_of(rows)
    table = spark.createDataFrame(quotes, QUOTE)
    want = plain(scan.replay(scan.observations(scan.books(table, U.legs_frame(spark)), U), U))
    store, sent = Store(spark, f"file://{tmp_path}/store"), notify.MemoryNotifier()
    late = (rows[10][1], "A", 9.0, rows[10][1], False)  # long closed
    alone = (rows[-1][1] + timedelta(hours=9), "A", 1.0, rows[-1][1], False)  # moves the watermark past all others
    for cut in (quotes[: 6 * 140 + 3], quotes[6 * 140 + 3 :], [late, alone]):
        spark.createDataFrame(cut, QUOTE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(QUOTE).parquet(f"{tmp_path}/in")
        scan.start_quotes(stream, U, store, sent, f"{tmp_path}/checkpoint", cadence_seconds=None).awaitTermination()
    kept = [w for w in want if not w[3].startswith("stale")]
    assert store.observations().count() == len(kept) == 329 and store.observations().select("ts").distinct().count() == 329
    assert store.alert_count() == [w[2] for w in want].count(True) == len(sent.texts) >= 1
    assert Detector.restore(store.state().first().snapshot).seen == 329


def test_quotes_are_reduced_before_they_reach_the_state(spark, tmp_path):
    """A stream's books are those of the table, and its state sees some rows a book, not each of thousands of quotes."""
    polls = [T + timedelta(minutes=m, microseconds=200 * m) for m in range(3)] + [T + timedelta(microseconds=400)]
    quotes = [(p, s, float(i), p - timedelta(seconds=(7 * i) % 50), i % 9 == 0) for p in polls for s in "AB" for i in range(800)]
    quotes += [(T + timedelta(days=1), "A", 1.0, T, False), (polls[1] + timedelta(seconds=5), "B", 1.0, T, False)]  # the last poll, and one without all legs
    spark.createDataFrame(quotes, QUOTE).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(QUOTE).parquet(f"{tmp_path}/in")
    writer = scan.closed_books(stream, U, "2 minutes").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True)
    query = scan.stateful(spark, lambda: writer.start(f"{tmp_path}/out"))
    query.awaitTermination()
    got, want = (sorted((r.ts, r.prices, r.leg_ts, r.leg_stale) for r in df.collect()) for df in (spark.read.parquet(f"{tmp_path}/out"), scan.books(spark.createDataFrame(quotes, QUOTE), U.legs_frame(spark))))
    assert len(want) == 4 and got == want
    assert max(op.numRowsUpdated for p in query.recentProgress for op in p.stateOperators) <= 6


def test_quote_stream_takes_up_saved_state_and_history(spark, tmp_path):
    """Another checkpoint starts from the store's snapshots; a linkage without any is warmed up by its history."""
    rows = books(260)
    for name, history in (("cold", None), ("warm", spark.createDataFrame(rows[:200], BOOK))):
        store, sent = Store(spark, f"file://{tmp_path}/{name}"), notify.MemoryNotifier()
        for part, cut in enumerate((rows[200:230], rows[230:])):
            end = [(cut[-1][1] + timedelta(minutes=30), "A", 1.0, cut[-1][1], False)]
            spark.createDataFrame(quotes_of(cut) + end, QUOTE).coalesce(1).write.parquet(f"{tmp_path}/{name}{part}")
            stream = spark.readStream.schema(QUOTE).parquet(f"{tmp_path}/{name}{part}")
            scan.start_quotes(stream, U, store, sent, f"{tmp_path}/{name}-checkpoint{part}", cadence_seconds=None, history=history if not part else None).awaitTermination()
        seen = Detector.restore(store.state().first().snapshot).seen
        assert seen == (59 if history is None else 259)  # row 200 is stale


def test_replay_streams_and_starts_from_a_table(spark):
    rows = books(300)
    seen = scan.observations(spark.createDataFrame(rows + [("x", T + timedelta(days=99), {"a": 1.0}, {"a": T}, {"a": False})], BOOK), U)
    whole = scan.replay(seen, U).orderBy("ts").collect()
    assert [r.snapshot is not None for r in whole].count(True) == 1 and whole[-1].snapshot is not None
    first = scan.replay(seen.where(F.col("ts") < T + timedelta(hours=150)), U)
    saved = first.where("snapshot is not null").select("linkage_id", "snapshot")
    rest = scan.replay(seen.where(F.col("ts") >= T + timedelta(hours=150)), U, saved)
    assert plain(first) + plain(rest) == plain(scan.replay(seen, U))
    nobody = spark.createDataFrame([("y", "{}")], "linkage_id string, snapshot string")
    assert scan.replay(seen.limit(0), U).collect() == [] and nobody.count() == 1


def test_suppressed_by_the_next_event(spark):
    at = [(T, True), (T + timedelta(days=2), True), (T + timedelta(days=9), True), (T, False)]
    said = spark.createDataFrame([("x", ts, alert) for ts, alert in at], "linkage_id string, ts timestamp, alert boolean")
    legs = spark.createDataFrame([("x", "A"), ("x", "B")], "linkage_id string, symbol string")
    calendar = spark.createDataFrame([("A", T + timedelta(days=4)), ("B", T + timedelta(days=9)), ("C", T)], "symbol string, event_ts timestamp")
    got = {(r.ts, r.alert): r.blocked for r in scan.suppressed(said, legs, calendar, 3.0).collect()}
    assert got[(T + timedelta(days=2), True)] and got[(T + timedelta(days=9), True)] and not got[(T, True)]
