import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spreadwatch.operators import research as R
from spreadwatch.operators import sequential as S
from spreadwatch.sources.config import Pair


def test_filter_recovers_the_slope_at_any_scale(spark):
    rng = np.random.default_rng(1)
    x = 100 + rng.normal(size=400).cumsum()
    y = 1.25 * x + rng.normal(0, 0.05, 400)
    rows = [(f"{s}", i, float(s * a), float(s * b)) for s in (0.001, 1.0, 1e4) for i, (a, b) in enumerate(zip(y, x, strict=True))]
    out = S.kalman(spark.createDataFrame(rows, "key string, i long, y double, x double"), "key", "i", "y", "x")
    last = {r.key: r for r in out.where("i = 399").collect()}
    betas = [r.beta for r in last.values()]
    assert abs(betas[0] - 1.25) < 0.05 and max(betas) - min(betas) < 1e-6 and all(r.confident for r in last.values())
    with pytest.raises(ValueError):
        S.Kalman(delta=1.0)


def test_episode_alerts_once_and_rests():
    e, fired = S.Episode(), []
    for ts, z in enumerate([0, 2, 3, 3.2, 2.2, 3, 1, 0, 2, 3, 3]):
        fired.append(e.step(ts, z, 50.0, False, 1.8, 2.5, 15.0, 6.0))
    assert [i for i, f in enumerate(fired) if f] == [2, 9]
    e = S.Episode()
    assert not e.step(0, 9.0, 50.0, False, 1.8, 2.5, 15.0, 6.0) and e.state == S.WATCHING
    assert not e.step(1, None, None, False, 1.8, 2.5, 15.0, 6.0) and not e.step(2, 9.0, 50.0, True, 1.8, 2.5, 15.0, 6.0)
    assert not e.step(3, 9.0, 10.0, False, 1.8, 2.5, 15.0, 6.0) and e.state == S.WATCHING


def test_cooldown_is_greedy(spark):
    df = spark.createDataFrame([("k", i) for i in (1, 2, 4, 5, 6, 9)] + [("q", 3)], "key string, i long")
    assert sorted(tuple(r) for r in S.greedy_cooldown(df, "key", "i", 3).collect()) == [("k", 1), ("k", 4), ("k", 9), ("q", 3)]


def test_levels_merge_and_rank(spark):
    highs = [10, 11, 15, 11, 10, 11, 15.2, 11, 10, 11, 30, 11, 10, 12, 11]
    bars = [("S", i, h, h - 1.0, h - 0.5, 1.0) for i, h in enumerate(map(float, highs))]
    df = spark.createDataFrame(bars, "symbol string, d long, high double, low double, close double, atr double")
    found = {(r.side, r.touches): r for r in S.levels(df, "symbol", "d", n=2).collect()}
    assert math.isclose(found["resistance", 2].price, 15.1) and found["resistance", 1].price == 30.0
    top = S.ranked_levels(S.levels(df, "symbol", "d", n=2), "symbol", near_pct=50.0, min_touch=1).collect()
    assert {r.label for r in top if r.side == "resistance"} == {"2x"} and all(r.price < 30 for r in top)
    mean = S.Wilder(3)
    assert [mean.step(x) for x in (1.0, 2.0, None, 3.0, 9.0, None)] == [None, None, None, 2.0, 2.0 + 7 / 3, 2.0 + 7 / 3]


def test_recurrences_carry_their_state_over_batches(spark):
    rows = [(k, i, float(i % 7), 1.0 + i % 3) for k in ("a", "b", None) for i in range(100)]
    df = spark.createDataFrame(rows, "key string, i long, y double, x double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        got = S.recurrence(df, "key", "i", ["y"], "total double", lambda: [0.0], lambda state, y: (state.__setitem__(0, state[0] + y) or state[0],)).collect()
        gap = S.kalman(df.withColumn("x", F.when(F.col("i") != 5, F.col("x"))), "key", "i", "y", "x").where("key = 'a'").orderBy("i").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(k, i): sum(float(j % 7) for j in range(i + 1)) for k in ("a", "b", None) for i in range(100)}
    assert {(r.key, r.i): r.total for r in got} == want and len(got) == 300
    state = S.Kalman()
    for r, (_, i, y, x) in zip(gap, rows[:100], strict=True):
        assert (r.beta is None) if i == 5 else r.beta == state.step(y, x)["beta"]
    assert S.kalman(df.where("false"), "key", "i", "y", "x").count() == 0


def test_sessions_follow_daylight_saving(spark):
    df = spark.sql("select timestamp'2025-01-15 08:30:00' as w, timestamp'2025-07-15 07:30:00' as s, timestamp'2025-01-15 07:30:00' as o")
    row = df.select(S.in_session(F.col("w"), "london").alias("w"), S.in_session(F.col("s"), "london").alias("s"), S.in_session(F.col("o"), "london").alias("o")).first()
    assert (row.w, row.s, row.o) == (True, True, False)


def walks(spark, kind, n=1400, draws=8):
    rows = []
    for seed in range(draws):
        rng, v = np.random.default_rng(seed), 0.0
        for i in range(1, n + 1):
            v = v + rng.normal(0, 20) + (0.4 if kind == "drift" else 0) if kind != "ou" else v * 0.65 + rng.normal(0, 20)
            rows.append((str(seed), i, i, float(v)))
    return spark.createDataFrame(rows, "pair_id string, i long, d long, v double")


@pytest.mark.parametrize("kind,detrended", [("walk", False), ("drift", True)])
def test_backtest_finds_nothing_in_random_walks(spark, kind, detrended):
    rows = R.eligible(walks(spark, kind), detrended)
    edges = [r.edge or 0.0 for r in R.backtest_summary(rows, R.backtest_alerts(rows, 0.0)).collect()]
    assert np.mean(edges) < 8


def test_backtest_finds_true_reversion(spark):
    rows = R.eligible(walks(spark, "ou", draws=4))
    found = R.backtest_summary(rows, R.backtest_alerts(rows, 5.0)).collect()
    assert all(r.alerts > 3 for r in found) and np.mean([r.edge for r in found]) > 10


def prices(kind, seed, n=700):
    rng = np.random.default_rng(seed)
    b = 100 * np.exp(rng.normal(0, 0.015, n).cumsum())
    if kind == "independent":
        return 100 * np.exp(rng.normal(0, 0.015, n).cumsum()), b
    s = [0.0]
    for _ in range(n - 1):
        s.append(s[-1] * 0.75 + rng.normal(0, 0.02))
    return 2.5 * b**0.85 * np.exp(s), b


def test_admission_and_profile(spark):
    from datetime import date, timedelta

    rows, spec = [], []
    for i in range(10):
        kind = "linked" if i == 0 else "independent"
        a, b = prices(kind, i)
        spec.append((f"p{i}", "fx", f"A{i}", f"B{i}", "full"))
        rows += [(f"p{i}", date(2020, 1, 1) + timedelta(d), float(x), float(y)) for d, (x, y) in enumerate(zip(a, b, strict=True))]
    spec.append(("gone", "fx", "X", "Y", "full"))
    frame = spark.createDataFrame(rows, "pair_id string, d date, pa double, pb double")
    catalogue = spark.createDataFrame(spec, "pair_id string, grp string, a string, b string, access string")
    found = {r.pair_id: r for r in R.fit_catalogue(frame, catalogue).collect()}
    assert len(found) == 11 and abs(found["p0"].beta - 0.85) < 0.05 and found["p0"].admitted
    assert sum(r.admitted for r in found.values()) <= 2 and found["gone"].reason == "no prices for both legs"
    made = R.compile_pair(Pair("p0", "fx", "A0", "B0", "full"), found["p0"].k, found["p0"].beta, 4.0)
    assert made.category == "tradeable" and made.fair_value == "k * b ** beta"
    assert R.profile(frame.where("pair_id = 'p0'")).first().verdict.startswith("cointegrated")


def test_interval_coverage(spark):
    rng = np.random.default_rng(7)
    rows = [("S", i, float(x), float(0.5 * x + rng.normal(0, 2))) for i, x in enumerate(rng.normal(0, 3, 160))]
    got = R.event_study(spark.createDataFrame(rows, "symbol string, i long, surprise double, move double"), ["i"]).first()
    assert abs(got.coverage - 0.8) < 0.15 and abs(got.beta - 0.5) < 0.15 and got.informative and got.calibrated
    few = spark.createDataFrame(rows[:11], "symbol string, i long, surprise double, move double")
    assert R.event_study(few, ["i"]).count() == 0
