"""Whole-series aggregates, one row per key."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadwatch.functions.expressions import calibration_verdict, hedged_spread_bps
from spreadwatch.functions.formula import compile_formula
from spreadwatch.functions.stats import ols, ou_fit
from spreadwatch.operators.windows import with_lag, with_row_numbers

NORMAL_TAIL_3 = 0.0026998


def ols_of(frame: DataFrame, key: str, y: str, x: str) -> DataFrame:
    """(key, alpha, beta) of y = alpha + beta x over the rows of each key."""
    fit = ols(F.col(y), F.col(x))
    return frame.groupBy(key).agg(fit["alpha"].alias("alpha"), fit["beta"].alias("beta"))


def ols_hedge(frame: DataFrame) -> DataFrame:
    """ln a = alpha + beta ln b per pair: (pair_id, alpha, beta, r2, n, t)."""
    fit = ols(F.ln("pa"), F.ln("pb"))
    error = F.sqrt(fit["ss_res"] / F.nullif(fit["n"] - 2, F.lit(0)) / F.nullif(fit["sxx"], F.lit(0.0)))
    return frame.where("pa > 0 and pb > 0").groupBy("pair_id").agg(fit["alpha"].alias("alpha"), fit["beta"].alias("beta"), fit["r2"].alias("r2"), fit["n"].alias("n"), F.try_divide(fit["beta"], error).alias("t"))


def hedged_spread(frame: DataFrame, fits: DataFrame) -> DataFrame:
    """``frame`` with spread_bps from the pair's own regression; fits is one row per pair."""
    met = frame.join(fits.select("pair_id", "alpha", "beta"), "pair_id")
    return met.withColumn("spread_bps", hedged_spread_bps(F.col("pa"), F.col("pb"), F.col("alpha"), F.col("beta")))


def ou(df: DataFrame, key: str, order: str, v: str) -> DataFrame:
    """(key, theta, mu, sigma, half_life, t, r2, n) of each whole series."""
    lagged = with_lag(df, key, order, v)
    return lagged.groupBy(key).agg(ou_fit(F.col("dv"), F.col("lv")).alias("f")).select(key, "f.*")


def half_life(df: DataFrame, key: str, order: str, v: str) -> DataFrame:
    """(key, half_life): without any test of significance; null unless the slope is negative."""
    lagged = with_lag(df, key, order, v)
    slope = F.regr_slope("dv", "lv")
    value = F.when((slope < 0) & (F.regr_count("dv", "lv") >= 30), -math.log(2) / slope)
    return lagged.groupBy(key).agg(value.alias("half_life"))


def spread_stats(df: DataFrame, key: str, order: str, v: str) -> DataFrame:
    """(key, sd, current_z, max_abs_z) of each whole series."""
    stats = df.groupBy(key).agg(F.stddev_samp(v).alias("sd"), F.avg(v).alias("mean"), F.max_by(v, order).alias("now"), F.max(v).alias("high"), F.min(v).alias("low"))
    sd = F.nullif(F.col("sd"), F.lit(0.0))
    far = F.greatest(F.col("high") - F.col("mean"), F.col("mean") - F.col("low"))
    return stats.select(key, "sd", ((F.col("now") - F.col("mean")) / sd).alias("current_z"), (far / sd).alias("max_abs_z"))


def sigma_lie(df: DataFrame, key: str, v: str, min_rows: int = 100) -> DataFrame:
    """(key, share_beyond_3, ratio): how often three standard deviations are passed, against a normal."""
    stats = df.groupBy(key).agg(F.avg(v).alias("_m"), F.stddev_samp(v).alias("_s"), F.count(v).alias("_n"))
    far = F.when(F.col("_s") > 0, F.abs(F.col(v) - F.col("_m")) / F.col("_s") > 3).otherwise(False)
    out = df.join(stats.where(F.col("_n") >= min_rows), key).groupBy(key).agg(F.avg(far.cast("double")).alias("share_beyond_3"))
    return out.withColumn("ratio", F.col("share_beyond_3") / NORMAL_TAIL_3)


def bh_threshold(tests: DataFrame, q: float = 0.05) -> DataFrame:
    """``tests`` (family, p, ...) with each family's Benjamini-Hochberg critical value and ``admitted``.

    The value is 0 where nothing passes, and then nothing is admitted. Ranks come from range
    partitions and their sums, so a family of any size is no single task's; a family without a
    p-value of its own is not ranked (null p), and counts for nothing.
    """
    ranked = with_row_numbers(tests.where("p is not null"), "family", "p", "_i")
    sizes = ranked.groupBy(F.col("family").alias("_family")).agg(F.count(F.lit(1)).alias("_m"))
    same = F.col("family").eqNullSafe(F.col("_family"))
    passing = ranked.join(sizes, same).where(F.col("p") <= F.col("_i") / F.col("_m") * q)
    limits = passing.groupBy("_family").agg(F.max("p").alias("_limit"))
    met = tests.join(limits, same, "left")
    return met.withColumns({"threshold": F.coalesce("_limit", F.lit(0.0)), "admitted": F.coalesce(F.col("p") <= F.col("_limit"), F.lit(False))}).drop("_family", "_limit")


def calibrate(closes: DataFrame, linkage, param: str, min_days: int = 30) -> DataFrame:
    """(linkage_id, param, asserted, estimated, samples, drift_pct, sd_bps, mean_abs_bps, verdict).

    closes: (d, one column per leg), complete dates. The constant that would have made the formula
    exact is read off each day, by the direction closer to the asserted value; the median is the
    estimate, and the formula is evaluated again with it. No row with fewer than ``min_days`` days.
    """
    asserted = float(linkage.params[param])
    legs = {n: F.col(n) for n in linkage.legs}
    reference = F.col(linkage.reference)
    bare = compile_formula(linkage.fair_value, legs, {**linkage.params, param: 1.0})
    up, down = F.try_divide(reference, bare), F.try_divide(bare, reference)
    implied = F.when(F.abs(up - asserted) < F.abs(down - asserted), up).otherwise(down)
    days = closes.withColumns({"_implied": F.when(bare != 0, implied)})
    estimate = days.agg(F.expr("percentile(_implied, 0.5)").alias("estimated"), F.count(F.lit(1)).alias("samples"))
    names = {k: F.lit(v) for k, v in linkage.params.items()} | {param: F.col("estimated")}
    fair = compile_formula(linkage.fair_value, legs | names)
    resid = F.try_divide(reference - fair, reference) * 10_000
    met = days.crossJoin(F.broadcast(estimate)).withColumn("_resid", resid)  # the estimate is one row
    out = met.where(F.col("samples") >= min_days).groupBy("estimated", "samples").agg(F.stddev_samp("_resid").alias("sd_bps"), F.avg(F.abs("_resid")).alias("mean_abs_bps"))
    drift = (F.col("estimated") / asserted - 1) * 100
    return out.select(F.lit(linkage.id).alias("linkage_id"), F.lit(param).alias("param"), F.lit(asserted).alias("asserted"), "estimated", "samples", drift.alias("drift_pct"), "sd_bps", "mean_abs_bps", calibration_verdict(drift).alias("verdict"))


def scorecard(outcomes: DataFrame, friction, few: int = 15) -> DataFrame:
    """One row over outcomes (predicted, move), friction a number or a column: resolved, wins, mean net, bias of predictions, caution."""
    net, done = F.col("move") - friction, F.col("move").isNotNull()
    return outcomes.agg(
        F.count(F.lit(1)).alias("alerts"), F.count("move").alias("resolved"), F.count(F.when(net > 0, 1)).alias("wins"), F.avg(net).alias("mean_net_bps"),
        F.avg(F.when(done, F.col("move") - F.col("predicted"))).alias("mean_bias_bps"), (F.count("move") < few).alias("too_few"),
    )


def coverage(observations: DataFrame, key: str, ts: str, now, stale_hours: float = 24.0) -> DataFrame:
    """(key, n, last, age_hours, silent) of each key's observations."""
    found = observations.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("last"))
    age = (F.unix_micros(now) - F.unix_micros(F.col("last").cast("timestamp"))) / 3.6e9
    return found.withColumns({"age_hours": age, "silent": age > stale_hours})
