"""Recurrences cut into blocks against their plain form, and the index of levels against a list."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from spreadwatch.operators import scans as X
from spreadwatch.operators import sequential as S


def prices(spark, n=3000):
    rng = np.random.default_rng(7)
    rows = []
    for k, unit in (("a", 1.0), ("b", 1e4), (None, 0.01)):
        x = 100 + rng.normal(size=n).cumsum()
        y = (1.2 + 0.3 * np.sin(np.arange(n) / 400)) * x + rng.normal(0, 0.05, n)
        for i in range(n):
            gone = i < 150 or i % 37 == 0
            rows.append((k, i + 1, None if gone and i % 2 else float(unit * y[i]), float("nan") if gone and not i % 2 else float(unit * x[i]), "text"))
    return spark.createDataFrame(rows, "key string, i long, y double, x double, other string")


@pytest.mark.parametrize("size", [64, 1000, 1 << 16])
def test_filter_in_blocks_is_the_filter(spark, size):
    df = prices(spark)
    want = {(r.key, r.i): r for r in S.kalman(df, "key", "i", "y", "x").collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        got = X.kalman_blocks(df, "key", "i", "y", "x", size=size)
        rows = got.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(rows) == len(want) == 9000 and got.columns == S.kalman(df, "key", "i", "y", "x").columns
    for r in rows:
        w = want[r.key, r.i]
        assert (r.beta is None) == (w.beta is None) and r.confident == w.confident
        if r.beta is not None:
            assert all(math.isclose(r[c], w[c], rel_tol=1e-9, abs_tol=1e-9 * (abs(w.prediction) if c in ("innovation", "intercept") else 1)) for c in S.KALMAN_NAMES)


def test_blocks_of_one_series_are_in_many_tasks(spark):
    df = prices(spark).where("key = 'a'")
    found = X.kalman_blocks(df, "key", "i", "y", "x", size=100)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = X.kalman_blocks(df, "key", "i", "y", "x", size=100).select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert tasks == 4 and found.count() == 3000
    assert X.kalman_blocks(df.where("false"), "key", "i", "y", "x").count() == 0


@pytest.mark.parametrize("n", [1, 14, 130])
def test_wilder_in_blocks(spark, n):
    rng = np.random.default_rng(3)
    rows = []
    for k in ("a", None):
        close = 50 + rng.normal(size=1000).cumsum()
        for i, c in enumerate(map(float, close)):
            high = None if i % 11 == 3 or (k is None and i < 90) else c + abs(float(rng.normal()))
            rows.append((k, i + 1, high, None if high is None else c - abs(float(rng.normal())), None if i % 50 == 7 else c))
    df = spark.createDataFrame(rows, "key string, i long, high double, low double, close double")
    want = {(r.key, r.i): (r.tr, r.atr) for r in S.atr(df, "key", "i", n).collect()}
    got = {(r.key, r.i): (r.tr, r.atr) for r in X.atr_blocks(df, "key", "i", n, size=60).collect()}
    assert got.keys() == want.keys() and len(got) == 2000
    for k, w in want.items():
        assert all((a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9)) for a, b in zip(got[k], w, strict=True)), k
    assert X.atr_blocks(df.where("false"), "key", "i").count() == 0


class Listed:
    """The rule itself: the first level of a list that is near enough."""

    def __init__(self):
        self.levels = []

    def absorb(self, price, bar, tolerance):
        for level in self.levels:
            if abs(level[0] - price) <= tolerance:
                level[1] += 1
                level[0] += (price - level[0]) / level[1]
                level[2:] = [bar, min(level[3], price), max(level[4], price)]
                return
        self.levels.append([price, 1, bar, price, price])


@pytest.mark.parametrize(("places", "most"), [(1, 0.3), (3, 0.02), (6, 0.0), (2, 40.0)])
def test_indexed_levels_are_those_of_a_list(places, most):
    rng = np.random.default_rng(places)
    plain, indexed = Listed(), S.Levels()
    for bar in range(4000):
        price, tolerance = round(float(rng.normal(100, 20)), places), float(rng.uniform(0, most))
        if bar % 500 == 1:
            price, tolerance = (price, float("nan")) if bar % 1000 == 1 else (float("nan"), tolerance)
        plain.absorb(price, bar, tolerance)
        indexed.absorb(price, bar, tolerance)
    assert repr(indexed.levels) == repr(plain.levels)
    assert sorted(n for b in indexed.numbers for n in b) == [n for n, level in enumerate(plain.levels) if level[0] == level[0]]
    assert all(a == sorted(a) and len(a) <= S.Levels.BUCKET for a in indexed.means)


def test_many_levels_take_less_than_quadratic_time():
    def seconds(n):
        prices, found, at = np.random.default_rng(0).uniform(0, 1e6, n).tolist(), S.Levels(), time.process_time()
        for bar, price in enumerate(prices):
            found.absorb(price, bar, 1e-3)
        return time.process_time() - at

    assert seconds(80_000) < 24 * max(seconds(10_000), 0.02)
