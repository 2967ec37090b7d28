"""Formulas in double-double against decimal arithmetic of 60 digits."""

import re
from decimal import Decimal, localcontext

import numpy as np
import pytest
from pyspark.sql import functions as F

from spreadwatch.functions.exact import exact_literal, with_exact
from spreadwatch.functions.formula import FormulaError

FORMULAS = {
    "spot * fx / 31.1035 * (1 + duty) ** 2": {"duty": 0.0625},
    "spot - fx * 3 + 0.1": {},
    "(spot + fx) * (spot - fx) - spot ** 2 + fx ** 2 + n / 7": {},
    "-spot / (fx - n) ** -3 + +n": {},
    "spot * k - spot * k + fx / 3 - fx / 3 + 0.3 - 0.1 - 0.2": {"k": 1e6 / 7},
    "big - spot - big + spot + 1e-9": {},
}


def value(text, names):
    return eval(text, {}, names)  # noqa: S307


def tables(spark):
    rng = np.random.default_rng(5)
    rows = [(i, round(float(rng.uniform(0.02, 5000)), int(rng.integers(0, 9))), float(rng.uniform(50, 100)), int(rng.integers(100, 10**6)), Decimal(int(rng.integers(1, 10**15))) / 10**4) for i in range(300)]
    return rows, spark.createDataFrame(rows, "id long, spot double, fx double, n long, big decimal(19,4)").withColumn("_kept", F.lit("x"))


@pytest.mark.parametrize("text", FORMULAS)
def test_as_exact_as_decimals(spark, text):
    params = FORMULAS[text]
    rows, df = tables(spark)
    got = with_exact(df, "fair", text, {c: c for c in ("spot", "fx", "n", "big")}, params)
    assert got.columns == [*df.columns, "fair"]
    found = {r.id: r.fair for r in got.collect()}
    source = re.sub(r"(?<![\w.])(\d+\.\d+|\d+e-\d+)", r"D('\1')", text)
    with localcontext() as c:
        c.prec = 60
        for i, spot, fx, n, big in rows:
            names = {"D": Decimal, "spot": Decimal(repr(spot)), "fx": Decimal(repr(fx)), "n": Decimal(n), "big": big, **{k: Decimal(repr(v)) for k, v in params.items()}}
            want = value(source, names)
            size = max(abs(names["spot"]), abs(names["big"]) if "big" in text else Decimal(1), names["fx"] ** 2 if "spot ** 2" in text else Decimal(1), names["spot"] ** 2 if "spot ** 2" in text else Decimal(1), abs(names["spot"] * names["k"]) if "k" in names else Decimal(1))
            # a double's last place of the result, or thirty digits of the terms where they cancel
            assert abs(Decimal(found[i]) - want) <= max(abs(want) * Decimal("2.3e-16"), size * Decimal("1e-29")), (i, found[i], want)


def test_nulls_zeros_and_odd_numbers(spark):
    rows = [(1, 1.0, 0.0), (2, None, 1.0), (3, float("nan"), 1.0), (4, float("inf"), 2.0), (5, 1e-5, 3.0), (6, 1e200, 4.0), (7, 3.0, None)]
    df = spark.createDataFrame(rows, "id long, a double, `b.c` double")
    found = {r.id: r.a for r in with_exact(df, "a", "a / b", {"a": "a", "b": "b.c"}).collect()}
    assert found == {1: None, 2: None, 3: None, 4: None, 5: 1e-5 / 3, 6: 1e200 / 4, 7: None}
    powers = {r.id: r.p for r in with_exact(df, "p", "b ** 0.5 + b ** 0 * 2", {"b": "b.c"}).collect()}
    assert powers[6] == 4.0 and powers[1] == 2.0 and powers[7] is None
    assert with_exact(df.where("false"), "x", "a", {"a": "a"}).count() == 0
    with pytest.raises(FormulaError):
        with_exact(df, "x", "a + q", {"a": "a"})
    with pytest.raises(FormulaError):
        with_exact(df, "x", "f(a)", {"a": "a"})


def test_literals_are_their_text():
    high, low = exact_literal(0.1)
    assert high == 0.1 and Decimal(high) + Decimal(low) != Decimal(high) and abs(Decimal(high) + Decimal(low) - Decimal("0.1")) < Decimal("1e-33")


def test_a_long_formula_adds_no_steps_to_the_plan(spark):
    """Intermediate values are no columns: rows stay as wide as they are, whatever a formula's length."""
    rows = spark.createDataFrame([(1, 2.5, 0.1)], "id long, a double, b double")
    depth = lambda text: with_exact(rows, "x", text, {"a": "a", "b": "b"})._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert depth("a + b") == depth(" + ".join(["(a * (1 - b) - a / b) ** 3"] * 4))
    (row,) = with_exact(rows.withColumn("big", F.lit(2**63 - 1)).withColumn("least", F.lit(-(2**63))), "x", "big + least + k", {"big": "big", "least": "least"}, {"k": 0.5}).collect()
    assert row.x == -0.5
    assert with_exact(rows, "x", "2 ** 3 / 16", {}).first().x == 0.5
