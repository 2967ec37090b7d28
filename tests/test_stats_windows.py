import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spreadwatch.functions.stats import adf, engle_granger, mackinnon_p, t_cdf, t_expansion, t_quantile, t_quantile_of, t_quantiles, t_tails
from spreadwatch.operators import aggregates as A
from spreadwatch.operators import windows as W
from spreadwatch.operators.detector import fit_ou


def series(spark, values, key="k"):
    return spark.createDataFrame([(key, i, float(v)) for i, v in enumerate(values, 1)], "key string, i long, v double")


def ou(rng, n, theta=0.3, sigma=20.0):
    out = [0.0]
    for _ in range(n - 1):
        out.append(out[-1] * (1 - theta) + rng.normal(0, sigma))
    return np.array(out)


def test_student_t():
    assert t_cdf(0, 5) == 0.5
    assert math.isclose(t_quantile(0.9, 10), 1.3721836, rel_tol=1e-6)
    assert math.isclose(t_quantile(0.975, 1), 12.7062047, rel_tol=1e-6)
    assert math.isclose(t_quantile(0.9, 400), 1.2837, rel_tol=1e-3)


def test_unit_root_values():
    assert abs(mackinnon_p(-2.86, 1) - 0.05) < 2e-3 and abs(mackinnon_p(-3.34, 2) - 0.05) < 2e-3
    assert mackinnon_p(-30, 1) == 0.0 and mackinnon_p(5, 1) == 1.0


def test_unit_root_rates():
    rng = np.random.default_rng(1)
    walks = [rng.normal(size=400).cumsum() for _ in range(60)]
    assert sum(adf(x)[1] < 0.05 for x in walks) <= 9
    assert adf(ou(rng, 400))[1] < 0.01
    pairs = [engle_granger(walks[i], walks[i + 1])[1] for i in range(0, 60, 2)]
    assert sum(p < 0.05 for p in pairs) <= 6
    b = walks[0] / 10
    assert engle_granger(2 + 0.8 * b + ou(rng, 400, sigma=0.2), b)[1] < 0.01


def test_rolling_statistics_against_numpy(spark):
    v = ou(np.random.default_rng(2), 330)
    df = W.with_lag(series(spark, v), "key", "i", "v")
    df = W.percentile_rank(W.percentile_bounds(W.with_ou(df, "key", "i", 249), "key", "i", "v", 250, 99), "key", "i", "v", 250, "p")
    row = df.withColumn("z", W.rolling_z("v", W.past("key", "i", 250))).withColumnRenamed("fit", "f").where("i = 300").first()
    past, now = v[49:299], v[299]
    assert math.isclose(row.z, (now - past.mean()) / past.std(ddof=1), rel_tol=1e-9)
    assert math.isclose(row.p, (past < now).mean() * 100)
    assert math.isclose(row.low, np.quantile(past, 0.01), rel_tol=1e-9) and math.isclose(row.high, np.quantile(past, 0.99), rel_tol=1e-9)
    fit = fit_ou(past)
    assert all(math.isclose(row.f[k], fit[k], rel_tol=1e-8) for k in ("theta", "mu", "sigma", "half_life", "t"))


def test_detrend_against_polyfit(spark):
    v = np.random.default_rng(3).normal(size=280).cumsum()
    row = W.causal_detrend(series(spark, v), "key", "i", "v").where("i = 270").first()
    slope, a = np.polyfit(np.arange(250.0), v[19:269], 1)
    assert math.isclose(row.resid, v[269] - (a + slope * 250), rel_tol=1e-6, abs_tol=1e-9) and math.isclose(row.slope, slope, rel_tol=1e-8)


@pytest.mark.parametrize("cut", [150, 260])
def test_no_lookahead(spark, cut):
    v = ou(np.random.default_rng(4), 280)
    score = lambda df: W.percentile_rank(W.causal_detrend(df, "key", "i", "v", 100), "key", "i", "v", 750, "p").select("i", "resid", W.rolling_z("v", W.past("key", "i", 720)).alias("z"), "p")
    full = {r.i: r for r in score(series(spark, v)).collect() if r.i <= cut}
    short = {r.i: r for r in score(series(spark, v[:cut])).collect()}
    assert full == short


def test_too_short_and_flat(spark):
    z = series(spark, [1.0] * 40).select(W.rolling_z("v", W.past("key", "i", 720)).alias("z")).collect()
    assert all(r.z is None for r in z)
    assert A.ou(series(spark, range(10)), "key", "i", "v").first().theta is None


def test_sigma_lie_finds_fat_tails(spark):
    rng = np.random.default_rng(5)
    assert A.sigma_lie(series(spark, rng.standard_t(3, 4000)), "key", "v").first().ratio > 2
    assert A.sigma_lie(series(spark, rng.normal(size=50)), "key", "v").count() == 0


def test_false_discovery(spark):
    p = [0.01, 0.02, 0.03, 0.04, 0.9]
    rows = A.bh_threshold(spark.createDataFrame([("f", x) for x in p] + [("g", 0.5)], "family string, p double"), 0.05).collect()
    assert {r.p for r in rows if r.admitted} == {0.01, 0.02, 0.03, 0.04}
    assert [r.threshold for r in rows if r.family == "g"] == [0.0]


def test_streamed_windows_across_batches_and_keys(spark, monkeypatch):
    """Windows that cross Arrow batches and blocks, gaps and several keys, against numpy on the whole series."""
    monkeypatch.setattr(W, "BLOCK", 16)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        rng, rows = np.random.default_rng(8), []
        for key in ("k", "q", None):
            rows += [(key, i, None if rng.random() < 0.05 else float(rng.normal())) for i in range(1, 201)]
        df = spark.createDataFrame(rows, "key string, i long, v double").repartition(5)
        got = {(r.key, r.i): r for r in W.with_quantiles(df, "key", "i", "v", 50, {"low": 0.25, "high": 1.0}, "rank", 20).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 600
    for key in ("k", "q", None):
        v = [x for k, _, x in rows if k == key]
        for i in range(200):
            past = np.array([x for x in v[max(0, i - 50) : i] if x is not None])
            r = got[key, i + 1]
            if len(past) < 20:
                assert r.low is None and r.rank is None
            else:
                assert math.isclose(r.low, np.quantile(past, 0.25)) and math.isclose(r.high, past.max())
                assert (r.rank is None) == (v[i] is None) and (v[i] is None or math.isclose(r.rank, (past < v[i]).mean() * 100))


def test_t_quantiles_of_any_size():
    dof = np.array([1, 2, 3, 5, 12, 40, 199, 200, 398, 5000, 14_998, 10**6, 10**9, 0, np.nan])
    for p in (0.6, 0.9, 0.975, 0.9995):
        found = t_quantiles(p, dof)
        assert np.isnan(found[-2:]).all()
        for v, t in zip(dof[:-2], found, strict=False):
            assert math.isclose(t_tails(t, v), 1 - p, rel_tol=1e-9)
            if v <= 5000:
                assert math.isclose(t, t_quantile(p, int(v)), rel_tol=1e-9)
            if v >= 200:
                assert math.isclose(t, sum(g / v**i for i, g in enumerate(t_expansion(p))), rel_tol=3e-9)
    assert round(t_quantiles(0.9, np.array([398]))[0], 4) == 1.2837 and round(t_quantiles(0.9, np.array([14_998]))[0], 4) == 1.2816


def test_t_tails_against_the_distribution_function():
    for v in (1, 3, 30, 400):
        for t in (0.0, 0.3, 1.7, 1.8, 6.0, 40.0):
            assert math.isclose(t_tails(t, v), 1 - t_cdf(t, v), rel_tol=1e-9, abs_tol=1e-15)


def test_t_quantile_column(spark):
    got = spark.range(-1, 400).select("id", t_quantile_of(0.9, F.when(F.col("id") != 7, F.col("id"))).alias("t")).collect()
    for r in got:
        assert (r.t is None) == (r.id < 1 or r.id == 7)
        assert r.t is None or math.isclose(r.t, t_quantile(0.9, r.id), rel_tol=1e-10)


def sorted_windows(x, n, min_rows, p):
    """Quantiles and ranks of the n values before each one, by sorting each window."""
    out = []
    for i, now in enumerate(x):
        past = [y for y in x[max(0, i - n) : i] if not np.isnan(y)]
        enough = len(past) >= min_rows
        out.append((np.quantile(past, p) if enough else None, sum(y < now for y in past) * 100.0 / len(past) if enough and not np.isnan(now) else None))
    return out


def test_ordered_window_under_ties_and_gaps(spark):
    rng = np.random.default_rng(7)
    x = rng.integers(0, 9, 900).astype(float)
    x[rng.random(900) < 0.1] = np.nan
    rows = [("k", i, None if np.isnan(v) else float(v)) for i, v in enumerate(x, 1)]
    df = spark.createDataFrame(rows, "key string, i long, v double")
    got = W.with_quantiles(df, "key", "i", "v", 60, {"q": 0.37}, "rank", 20).orderBy("i").collect()
    for r, (q, rank) in zip(got, sorted_windows(x, 60, 20, 0.37), strict=True):
        assert (r.q is None) == (q is None) and (q is None or math.isclose(r.q, q, abs_tol=1e-12))
        assert (r.rank is None) == (rank is None) and (rank is None or math.isclose(r.rank, rank))


def test_ordered_window_itself():
    rng = np.random.default_rng(1)
    universe = np.array([-3.0, 0.0, 2.5, 7.0, 9.0])
    window, plain = W.OrderedWindow(universe), []
    for _ in range(400):
        rank = int(rng.integers(5))
        if rng.random() < 0.45 and universe[rank] in plain:
            window.add(rank, -1)
            plain.remove(universe[rank])
        else:
            window.add(rank)
            plain.append(universe[rank])
        assert window.size == len(plain) and [window.kth(k) for k in range(len(plain))] == sorted(plain)
        assert [window.below(r) for r in range(5)] == [sum(v < universe[r] for v in plain) for r in range(5)]
    assert W.OrderedWindow(np.zeros(0)).size == 0


def test_one_series_over_many_tasks(spark, monkeypatch):
    """Blocks with the rows before them give the rows of one pass, and one key reaches all tasks."""
    rng = np.random.default_rng(5)
    rows = [(k, i, float(rng.normal(0, 20)) if rng.random() > 0.02 else None) for k, n in (("long", 3000), ("short", 40), (None, 300)) for i in range(1, n + 1)]
    df = spark.createDataFrame(rows, "key string, i long, v double").repartition(3)

    def scored():
        lagged = W.with_lag(W.with_z(df, "key", "i", "v", 90), "key", "i", "v")
        return W.with_quantiles(W.causal_detrend(W.with_ou(lagged, "key", "i", 60), "key", "i", "v", 50), "key", "i", "v", 80, {"q": 0.9}, "rank", 30)

    whole = {(r.key, r.i): r for r in scored().collect()}
    monkeypatch.setattr(W, "SERIES_BLOCK", 100)
    cut = {(r.key, r.i): r for r in scored().collect()}
    assert whole.keys() == cut.keys() and len(cut) == len(rows)
    flat = lambda r: [math.nan if x is None else x for x in (r.z, r.slope, r.resid, r.q, r["rank"], *(r.fit or [None] * 7))]
    for at, r in whole.items():
        assert flat(cut[at]) == pytest.approx(flat(r), rel=1e-9, abs=1e-9, nan_ok=True)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would go to one task
    try:
        assert W.with_z(df.where("key = 'long'"), "key", "i", "v", 90).groupBy(F.spark_partition_id()).count().count() == 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_row_numbers_without_one_task_a_key(spark):
    rng = np.random.default_rng(2)
    rows = [(k, int(x), n) for n, (k, x) in enumerate((k, x) for k, m in (("a", 2000), ("b", 3), (None, 50)) for x in rng.permutation(m))]
    got = W.with_row_numbers(spark.createDataFrame(rows, "key string, at long, i int").repartition(5), "key", "at")
    assert got.columns == ["key", "at", "i"] and all(r.i == r.at + 1 for r in got.collect()) and got.count() == len(rows)
    assert W.with_row_numbers(spark.createDataFrame([], "key string, at long"), "key", "at").collect() == []
