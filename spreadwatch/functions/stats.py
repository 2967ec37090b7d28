"""Regression aggregates as Columns, and the few distributions that Spark lacks.

The Columns work as plain aggregates and, with ``.over(window)``, as rolling ones. Sums are exact
functions of Spark's own ``regr_*`` aggregates, so they combine on the map side.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from spreadwatch.functions.expressions import MIN_FIT


def _over(c: Column, w: WindowSpec | None) -> Column:
    return c if w is None else c.over(w)


def ols(y: Column, x: Column, w: WindowSpec | None = None) -> dict[str, Column]:
    """Parts of y = alpha + beta x: alpha, beta, r2, n, and the residual sum of squares."""
    parts = {n: _over(f(y, x), w) for n, f in (("beta", F.regr_slope), ("alpha", F.regr_intercept), ("r2", F.regr_r2), ("n", F.regr_count), ("sxx", F.regr_sxx), ("sxy", F.regr_sxy), ("syy", F.regr_syy))}
    parts["ss_res"] = F.greatest(parts["syy"] - parts["sxy"] * parts["sxy"] / F.nullif(parts["sxx"], F.lit(0.0)), F.lit(0.0))
    return parts


def ou_fit(delta: Column, lagged: Column, w: WindowSpec | None = None, min_pairs: int = MIN_FIT - 1) -> Column:
    """struct(theta, mu, sigma, half_life, t, r2, n) of an AR(1) of changes on lagged levels.

    Null with fewer than ``min_pairs`` pairs. mu falls back to the mean level when the slope is 0.
    """
    p = ols(delta, lagged, w)
    b, dof = p["beta"], p["n"] - 2
    error = F.sqrt(p["ss_res"] / F.nullif(dof, F.lit(0)) / F.nullif(p["sxx"], F.lit(0.0)))
    fit = F.struct(
        (-b).alias("theta"),
        F.when(b != 0, -p["alpha"] / b).otherwise(_over(F.avg(lagged), w)).alias("mu"),
        F.sqrt(p["ss_res"] / F.nullif(dof, F.lit(0))).alias("sigma"),
        F.when(b < 0, math.log(2) / -b).alias("half_life"),
        F.coalesce(F.try_divide(b, error), F.lit(0.0)).alias("t"),
        F.when(p["syy"] > 0, 1 - p["ss_res"] / p["syy"]).otherwise(0.0).alias("r2"),
        p["n"].alias("n"),
    )
    return F.when(p["n"] >= min_pairs, fit)


def t_cdf(t: float, dof: int) -> float:
    """Student's t distribution function, through the regularised incomplete beta function."""
    x = dof / (dof + t * t)
    tail = 0.5 * _incomplete_beta(dof / 2, 0.5, x)
    return 1 - tail if t > 0 else tail


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Lentz's continued fraction for I_x(a, b)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    total = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d)
            c = 1 + num / c
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


def t_quantile(p: float, dof: int) -> float:
    """The inverse of ``t_cdf``: Newton's steps, kept inside a shrinking bracket."""
    low, high, t = -1e4, 1e4, 0.0
    scale = math.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(dof * math.pi)
    for _ in range(200):
        off = t_cdf(t, dof) - p
        low, high = (t, high) if off < 0 else (low, t)
        step = t - off / (scale * (1 + t * t / dof) ** (-(dof + 1) / 2))
        new = step if low < step < high else (low + high) / 2
        if abs(new - t) <= 1e-14 * max(1.0, abs(t)):
            return new
        t = new
    return t


def t_pvalue(t: float, dof: int) -> float:
    return 2 * (1 - t_cdf(abs(t), dof))


# ---- the same for whole columns, for any number of degrees of freedom


def _half_step(a: np.ndarray) -> np.ndarray:
    """log gamma(a + 1/2) - log gamma(a), without the cancellation that large a would bring."""
    far = np.maximum(a, 20.0)
    series = 0.5 * np.log(far) - 1 / (8 * far) + 1 / (192 * far**3) - 1 / (640 * far**5) + 17 / (14336 * far**7)
    near = np.array([math.lgamma(x + 0.5) - math.lgamma(x) for x in np.minimum(a, 20.0).ravel()]).reshape(a.shape)
    return np.where(a >= 20, series, near)


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, all rows at once until the last has settled."""
    c, d = np.ones_like(x), 1 / (1 - (a + b) * x / (a + 1))
    total = d.copy()
    for m in range(1, 2000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d)
            c = 1 + num / c
            total *= c * d
        if np.all(np.abs(c * d - 1) < 1e-15):
            break
    return total


def t_tails(t: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """The probability beyond each t of at least 0 with dof degrees of freedom, however many."""
    t, v = np.broadcast_arrays(np.asarray(t, dtype=float), np.asarray(dof, dtype=float))
    a, y = v / 2, t * t / (v + t * t)
    log_front = -a * np.log1p(t * t / v) + 0.5 * np.log(np.maximum(y, 1e-300)) - 0.5 * math.log(math.pi) + _half_step(a)
    # of its two forms the fraction is short in the first for small t, and for many degrees of freedom up to far out
    half, outer = np.full_like(a, 0.5), t * t >= np.where(v > 1e4, 40, 3)
    far = np.where(outer, np.exp(log_front) * _fraction(a, half, np.where(outer, 1 / (1 + t * t / v), 0.0)) / a, 0.0)
    near = 1 - np.exp(log_front) * _fraction(half, a, np.where(outer, 0.0, y)) / 0.5
    return 0.5 * np.where(outer, far, np.where(t == 0, 1.0, near))


def t_expansion(p: float) -> list[float]:
    """The normal quantile and the factors of 1/dof, 1/dof**2, ... that turn it into a t-quantile of many degrees of freedom."""
    z = NormalDist().inv_cdf(p)
    return [
        z, (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    ]


def t_quantiles(p: float, dof: np.ndarray) -> np.ndarray:
    """The t-quantile at p (over a half) for each number of degrees of freedom; nan below one.

    Newton's steps from the expansion, each distinct number once.
    """
    values, back = np.unique(np.asarray(dof, dtype=float), return_inverse=True)
    v = np.where(values >= 1, values, np.nan)
    t = sum(g / v**i for i, g in enumerate(t_expansion(p)))
    log_scale = _half_step(np.where(values >= 1, values, 1.0) / 2) - 0.5 * np.log(v * math.pi)
    step = np.full_like(t, np.inf)
    for _ in range(60):
        density = np.exp(log_scale - (v + 1) / 2 * np.log1p(t * t / v))
        step = (t_tails(np.abs(t), np.where(values >= 1, values, 1.0)) - (1 - p)) / density
        t = np.maximum(t + step, 0.0)
        if not np.any(np.abs(step) > 1e-14 * np.maximum(1.0, t)):
            break
    lost = np.flatnonzero(np.abs(step) > 1e-9 * np.maximum(1.0, t))
    t[lost] = [t_quantile(p, int(values[i])) for i in lost]  # few degrees of freedom far out
    return t[back]


def t_quantile_of(p: float, dof: Column) -> Column:
    """The t-quantile at p as a Column, in Arrow batches; null without a degree of freedom."""

    @F.pandas_udf("double")
    def found(n: pd.Series) -> pd.Series:
        return pd.Series(t_quantiles(p, n.to_numpy(dtype=float, na_value=np.nan)))

    return F.nanvl(found(dof.cast("double")), F.lit(None).cast("double"))


def t_pvalue_of(t: Column, dof: Column) -> Column:
    """The two-sided p-value of t as a Column, in Arrow batches; null without a t or a degree of freedom."""

    @F.pandas_udf("double")
    def found(t: pd.Series, n: pd.Series) -> pd.Series:
        x, v = np.abs(t.to_numpy(dtype=float, na_value=np.nan)), n.to_numpy(dtype=float, na_value=np.nan)
        known = ~np.isnan(x) & (v >= 1)
        return pd.Series(np.where(known, 2 * t_tails(np.where(known, np.minimum(x, 1e100), 0.0), np.where(known, v, 1.0)), np.nan))

    return F.nanvl(found(t.cast("double"), dof.cast("double")), F.lit(None).cast("double"))


#: MacKinnon (1994), constant, for one and for two series: the border of the two
#: polynomials in t, their coefficients, and where the value is 0 and 1.
MACKINNON = {
    1: (-1.61, (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368), -18.83, 2.74),
    2: (-2.62, (2.92, 1.5012, 0.039796), (2.1945, 0.64695, -0.29198, -0.042377), -18.86, 0.92),
}


def mackinnon_p(t: float, n_series: int) -> float:
    """Approximate p-value of a unit-root t-statistic."""
    border, small, large, low, high = MACKINNON[n_series]
    if t <= low:
        return 0.0
    if t >= high:
        return 1.0
    value = sum(c * t**i for i, c in enumerate(small if t <= border else large))
    return 0.5 * math.erfc(-value / math.sqrt(2))


def adf(x: np.ndarray, constant: bool = True, n_series: int = 1) -> tuple[float, float]:
    """(t, p) of the augmented Dickey-Fuller test; lags by AIC up to Schwert's bound."""
    x = np.asarray(x, dtype=float)
    dx = np.diff(x)
    most = min(math.ceil(12 * (len(x) / 100) ** 0.25), len(dx) // 2 - 2)

    def fit(lags: int, skip: int) -> tuple[float, float]:
        y = dx[skip:]
        cols = [x[skip : len(x) - 1]] + [dx[skip - k : len(dx) - k] for k in range(1, lags + 1)]
        if constant:
            cols.append(np.ones(len(y)))
        design = np.column_stack(cols)
        beta, *_ = np.linalg.lstsq(design, y, rcond=None)
        rss = float(((y - design @ beta) ** 2).sum())
        n, k = design.shape
        aic = n * (math.log(2 * math.pi) + math.log(max(rss, 1e-300) / n) + 1) + 2 * k
        error = math.sqrt(rss / (n - k) * np.linalg.pinv(design.T @ design)[0, 0])
        return aic, float(beta[0]) / error if error else float("-inf")

    best = min(range(most + 1), key=lambda lags: fit(lags, most)[0])
    t = fit(best, best)[1]
    return t, mackinnon_p(t, n_series)


def engle_granger(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """(t, p) that a and b are cointegrated: the unit-root test of the residuals of a on b."""
    design = np.column_stack([np.ones(len(b)), b])
    beta, *_ = np.linalg.lstsq(design, a, rcond=None)
    return adf(a - design @ beta, constant=False, n_series=2)
