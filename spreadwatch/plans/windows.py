"""Queries of rolling statistics and screens."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spreadwatch.operators import windows as W
from spreadwatch.operators.quality import screen, screen_flags, screen_report
from spreadwatch.plans.frames import FRAME_SQL, LAGGED_SQL, SERIES_SQL, frame, r6, series
from spreadwatch.plans.registry import query


@query(
    "wn_rolling_z",
    f"""WITH {SERIES_SQL}
SELECT pair_id, d, i, v, CASE WHEN count(v) OVER w >= 30 AND stddev_samp(v) OVER w > 0 THEN round((v - avg(v) OVER w) / stddev_samp(v) OVER w, 6) END AS z,
       CASE WHEN count(v) OVER w >= 30 AND stddev_samp(v) OVER w > 0 THEN round(abs(v) - 26.95, 6) END AS net_edge_bps
FROM series WINDOW w AS (PARTITION BY pair_id ORDER BY i ROWS BETWEEN 720 PRECEDING AND 1 PRECEDING)""",
)
def wn_rolling_z(spark, sf_dir):
    scored = W.with_z(series(spark, sf_dir), "pair_id", "i", "v")
    net = F.when(F.col("z").isNotNull(), F.round(F.abs("v") - 26.95, 6))
    return scored.select("pair_id", "d", F.col("i").cast("long").alias("i"), "v", *r6("z"), net.alias("net_edge_bps"))


@query(
    "wn_percentile_rank",
    f"""WITH {SERIES_SQL}, h AS (SELECT *, list(v) OVER (PARTITION BY pair_id ORDER BY i ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING) AS h FROM series)
SELECT pair_id, d, CASE WHEN len(h) >= 100 THEN round(len(list_filter(h, lambda x: x < v)) * 100.0::DOUBLE / len(h), 6) END AS percentile FROM h""",
)
def wn_percentile_rank(spark, sf_dir):
    return W.percentile_rank(series(spark, sf_dir), "pair_id", "i", "v", W.FIT_WINDOW).select("pair_id", "d", *r6("percentile"))


@query(
    "wn_percentile_bounds",
    f"""WITH {SERIES_SQL}, b AS (
  SELECT pair_id, d, v, CASE WHEN count(v) OVER w >= 100 THEN quantile_cont(v, 0.01) OVER w END AS low, CASE WHEN count(v) OVER w >= 100 THEN quantile_cont(v, 0.99) OVER w END AS high
  FROM series WINDOW w AS (PARTITION BY pair_id ORDER BY i ROWS BETWEEN 750 PRECEDING AND 1 PRECEDING))
SELECT pair_id, d, round(low, 9) AS low, round(high, 9) AS high, v > high OR v < low AS exceeds FROM b""",
)
def wn_percentile_bounds(spark, sf_dir):
    found = W.percentile_bounds(series(spark, sf_dir), "pair_id", "i", "v", W.THRESHOLD_WINDOW, 99)
    return found.select("pair_id", "d", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"), "exceeds")


OU_SQL = """-b AS theta, CASE WHEN b <> 0 THEN -a / b ELSE ml END AS mu, sqrt(ss / nullif(n - 2, 0)) AS sigma,
  CASE WHEN b < 0 THEN ln(2) / -b END AS half_life, coalesce(b / nullif(sqrt(ss / nullif(n - 2, 0) / nullif(sxx, 0)), 0), 0) AS t, n"""


def ou_parts(over: str = "") -> str:
    return f"""regr_slope(dv, lv) {over} AS b, regr_intercept(dv, lv) {over} AS a, avg(lv) {over} AS ml, CAST(regr_count(dv, lv) {over} AS BIGINT) AS n, regr_sxx(dv, lv) {over} AS sxx,
  greatest(regr_syy(dv, lv) {over} - regr_sxy(dv, lv) {over} * regr_sxy(dv, lv) {over} / nullif(regr_sxx(dv, lv) {over}, 0), 0) AS ss"""


@query(
    "wn_rolling_ou",
    f"""WITH {LAGGED_SQL}, p AS (SELECT pair_id, d, i, {ou_parts("OVER w")} FROM lagged WINDOW w AS (PARTITION BY pair_id ORDER BY i ROWS BETWEEN 249 PRECEDING AND 1 PRECEDING)),
f AS (SELECT pair_id, d, {OU_SQL} FROM p WHERE i > 250)
SELECT pair_id, d, round(theta, 6) AS theta, round(mu, 6) AS mu, round(sigma, 6) AS sigma, round(half_life, 6) AS half_life, round(t, 6) AS t FROM f""",
)
def wn_rolling_ou(spark, sf_dir):
    lagged = W.with_lag(series(spark, sf_dir), "pair_id", "i", "v")
    found = W.with_ou(lagged, "pair_id", "i", W.FIT_WINDOW - 1).where(F.col("i") > W.FIT_WINDOW)
    return found.select("pair_id", "d", *[F.round(f"fit.{c}", 6).alias(c) for c in ("theta", "mu", "sigma", "half_life", "t")])


@query(
    "wn_causal_detrend",
    f"""WITH {SERIES_SQL}, x AS (SELECT pair_id, d, v, i, regr_slope(v, i) OVER w AS slope, regr_intercept(v, i) OVER w AS a, count(v) OVER w AS n
  FROM series WINDOW w AS (PARTITION BY pair_id ORDER BY i ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING))
SELECT pair_id, d, CASE WHEN n = 250 THEN round(slope, 6) END AS slope, CASE WHEN n = 250 THEN round(v - (a + slope * i), 6) END AS resid FROM x""",
)
def wn_causal_detrend(spark, sf_dir):
    return W.causal_detrend(series(spark, sf_dir), "pair_id", "i", "v").select("pair_id", "d", *r6("slope", "resid"))


RETURNS_SQL = SERIES_SQL + """, returns AS (
  SELECT pair_id, d, i, pa / lag(pa) OVER k - 1 AS ra, pb / lag(pb) OVER k - 1 AS rb FROM series WINDOW k AS (PARTITION BY pair_id ORDER BY i))"""
ROLLING_SQL = RETURNS_SQL + """, rolling AS (
  SELECT pair_id, d, i, CASE WHEN count(ra) OVER w = 60 THEN corr(ra, rb) OVER w END AS c
  FROM returns WINDOW w AS (PARTITION BY pair_id ORDER BY i ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))"""


def returns(spark, sf_dir):
    k = Window.partitionBy("pair_id").orderBy("i")
    return series(spark, sf_dir).select("pair_id", "d", "i", (F.col("pa") / F.lag("pa").over(k) - 1).alias("ra"), (F.col("pb") / F.lag("pb").over(k) - 1).alias("rb"))


def rolling(spark, sf_dir):
    return returns(spark, sf_dir).select("pair_id", "d", "i", W.rolling_corr("ra", "rb", W.upto("pair_id", "i", 60), 60).alias("c"))


@query("wn_rolling_corr", f"WITH {ROLLING_SQL} SELECT pair_id, d, round(c, 6) AS c FROM rolling")
def wn_rolling_corr(spark, sf_dir):
    return rolling(spark, sf_dir).select("pair_id", "d", *r6("c"))


@query("wn_forward_outcome", f"WITH {SERIES_SQL} SELECT pair_id, d, round(abs(v) - abs(lead(v, 3) OVER (PARTITION BY pair_id ORDER BY i)), 6) AS move FROM series")
def wn_forward_outcome(spark, sf_dir):
    return series(spark, sf_dir).select("pair_id", "d", F.round(W.forward_move("v", "pair_id", "i", 3), 6).alias("move"))


@query(
    "wn_changes",
    f"""WITH {FRAME_SQL} SELECT pair_id, d, round(pa - lag(pa) OVER k, 6) AS diff_a, round(pa / lag(pa) OVER k - 1, 6) AS pct_a, row_number() OVER k AS seen, row_number() OVER k >= 120 AS ready
FROM frame WINDOW k AS (PARTITION BY pair_id ORDER BY d)""",
)
def wn_changes(spark, sf_dir):
    k = Window.partitionBy("pair_id").orderBy("d")
    seen = F.row_number().over(k)
    return frame(spark, sf_dir).select(
        "pair_id", "d", F.round(F.col("pa") - F.lag("pa").over(k), 6).alias("diff_a"), F.round(F.col("pa") / F.lag("pa").over(k) - 1, 6).alias("pct_a"),
        seen.cast("long").alias("seen"), (seen >= 120).alias("ready"),
    )


# thresholds that the test tables' noise crosses now and then
FLAGS_SQL = FRAME_SQL + """, ch AS (
  SELECT *, ln(pa) - ln(lag(pa) OVER k) AS ca, ln(lead(pa) OVER k) - ln(pa) AS na, ln(pb) - ln(lag(pb) OVER k) AS cb, ln(lead(pb) OVER k) - ln(pb) AS nb,
    pa = lag(pa) OVER k AND abs(pb / lag(pb) OVER k - 1) >= 0.005 AS sa, pb = lag(pb) OVER k AND abs(pa / lag(pa) OVER k - 1) >= 0.005 AS sb, (ln(pa) - ln(pb)) * 10000 AS v
  FROM frame WINDOW k AS (PARTITION BY pair_id ORDER BY d)
), mid AS (SELECT pair_id, quantile_cont(v, 0.5) AS m, count(v) AS n FROM ch GROUP BY 1
), mad AS (SELECT pair_id, quantile_cont(abs(v - m), 0.5) AS mad FROM ch JOIN mid USING (pair_id) GROUP BY 1
), flags AS (
  SELECT pair_id, d, pa, pb, coalesce(abs(ca) > 0.4 AND abs(na) > 0.4 AND sign(ca) <> sign(na), false) AS spike_a, coalesce(abs(cb) > 0.4 AND abs(nb) > 0.4 AND sign(cb) <> sign(nb), false) AS spike_b,
    coalesce(sa, false) AS stale_a, coalesce(sb, false) AS stale_b, coalesce(n >= 30 AND abs(v - m) / (nullif(mad, 0) * 1.4826) > 8, false) AS outlier
  FROM ch JOIN mid USING (pair_id) JOIN mad USING (pair_id))"""


@query("wn_spike_screen", f"WITH {FLAGS_SQL} SELECT pair_id, d, spike_a, spike_b FROM flags")
def wn_spike_screen(spark, sf_dir):
    return screen_flags(frame(spark, sf_dir)).select("pair_id", "d", "spike_a", "spike_b")


@query("wn_stale_screen", f"WITH {FLAGS_SQL} SELECT pair_id, d, stale_a, stale_b FROM flags")
def wn_stale_screen(spark, sf_dir):
    return screen_flags(frame(spark, sf_dir)).select("pair_id", "d", "stale_a", "stale_b")


@query("wn_screen_combined", f"WITH {FLAGS_SQL} SELECT pair_id, d, pa, pb FROM flags WHERE NOT (spike_a OR spike_b OR stale_a OR stale_b OR outlier)")
def wn_screen_combined(spark, sf_dir):
    return screen(frame(spark, sf_dir))


@query("ag_mad_outliers", f"WITH {FLAGS_SQL} SELECT pair_id, d, outlier FROM flags")
def ag_mad_outliers(spark, sf_dir):
    return screen_flags(frame(spark, sf_dir)).select("pair_id", "d", "outlier")


@query(
    "ag_screen_report",
    f"""WITH {FLAGS_SQL} SELECT pair_id, count(*) AS rows_in, count(*) FILTER (WHERE NOT (spike_a OR spike_b OR stale_a OR stale_b OR outlier)) AS rows_out,
  count(*) FILTER (WHERE spike_a) AS n_spike_a, count(*) FILTER (WHERE spike_b) AS n_spike_b, count(*) FILTER (WHERE stale_a) AS n_stale_a, count(*) FILTER (WHERE stale_b) AS n_stale_b,
  count(*) FILTER (WHERE outlier) AS n_outlier FROM flags GROUP BY pair_id""",
)
def ag_screen_report(spark, sf_dir):
    return screen_report(frame(spark, sf_dir)).drop("dates")
