"""Unit-root tests from summed moments against least squares on whole series."""

import math

import numpy as np
import pytest

from spreadwatch.functions.stats import adf, engle_granger
from spreadwatch.operators import research as R
from spreadwatch.operators import unit_root as U
from spreadwatch.operators import windows as W


def walks(rng):
    noise = rng.normal(0, 1, 1500)
    reverting = [0.0]
    for e in noise:
        reverting.append(reverting[-1] * 0.9 + e)
    return {"walk": np.cumsum(rng.normal(0, 3, 900)), "reverting": np.array(reverting), "lagged": np.convolve(noise, [1, 0.6, 0.3, 0.2], "valid"), "short": rng.normal(0, 1, 61), "tiny": rng.normal(0, 1, 30)}


@pytest.mark.parametrize("block", [1 << 16, 70])
def test_moments_equal_least_squares(spark, monkeypatch, block):
    monkeypatch.setattr(W, "SERIES_BLOCK", block)
    found = walks(np.random.default_rng(3))
    rows = [(k, i, float(x)) for k, xs in found.items() for i, x in enumerate(xs)] + [("walk", 10_000, None), ("none", 1, None)]
    got = {r.key: r for r in U.unit_root(spark.createDataFrame(rows, "key string, at long, v double").repartition(3), "key", "at", "v").collect()}
    assert got.keys() == {"walk", "reverting", "lagged", "short"}
    for key, r in got.items():
        t, p = adf(found[key])
        assert r.n == len(found[key]) and math.isclose(r.t, t, rel_tol=1e-7) and math.isclose(r.p, p, rel_tol=1e-6, abs_tol=1e-12)


def test_pair_tests_equal_whole_series(spark):
    rng = np.random.default_rng(9)
    b = np.exp(np.cumsum(rng.normal(0, 0.01, 500)) + 4)
    pairs = {"tied": 2.0 * b**0.9 * np.exp(rng.normal(0, 0.01, 500)), "loose": np.exp(np.cumsum(rng.normal(0, 0.01, 500)) + 3), "negative": np.cumsum(rng.normal(0, 1, 500))}
    rows = [(k, i, float(x), float(y), float(math.log(abs(x) + 1) - math.log(y)) * 1e4) for k, a in pairs.items() for i, (x, y) in enumerate(zip(a, b, strict=True))] + [("few", 1, 1.0, 1.0, 0.0)]
    frame = spark.createDataFrame(rows, "pair_id string, d long, pa double, pb double, spread_bps double")
    for logs in (True, False):
        got = {r.pair_id: r for r in R.pair_tests(frame, logs).collect()}
        assert got["few"].coint_p is None and got["few"].adf_p is None and (got["negative"].coint_p is None) == logs
        for k in ("tied", "loose"):
            a = np.log(pairs[k]) if logs else pairs[k]
            assert math.isclose(got[k].coint_p, engle_granger(a, np.log(b) if logs else b)[1], rel_tol=1e-5, abs_tol=1e-9)
            assert math.isclose(got[k].adf_p, adf(np.array([r[4] for r in rows if r[0] == k]))[1], rel_tol=1e-5, abs_tol=1e-9)
    assert got["tied"].coint_p < 0.01
