"""Queries of aggregates, research pipelines, recurrences and chart levels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spreadwatch.functions import expressions as E
from spreadwatch.functions.stats import t_expansion, t_quantile
from spreadwatch.operators import aggregates as A
from spreadwatch.operators import research as R
from spreadwatch.operators import scans as X
from spreadwatch.operators import sequential as S
from spreadwatch.operators import windows as W
from spreadwatch.operators.detector import verdicts
from spreadwatch.operators.unit_root import unit_root
from spreadwatch.plans.basics import ALERTS_SQL, MOVES_SQL, event_moves, outcomes
from spreadwatch.plans.frames import BARS_SQL, FRAME_SQL, LAGGED_SQL, SERIES_SQL, TICKS_SQL, bars, frame, r6, series, ticks
from spreadwatch.plans.registry import query, table
from spreadwatch.plans.windows import FLAGS_SQL, OU_SQL, ROLLING_SQL, ou_parts, returns, rolling
from spreadwatch.sources.config import AlertRule, Linkage, Universe
from spreadwatch.sources.shared import shared_folder
from spreadwatch.streaming.scan import stateful, verdicts_of_quotes

# ---- aggregates

OLS_SQL = FRAME_SQL + """, ols AS (
  SELECT pair_id, regr_intercept(ln(pa), ln(pb)) AS alpha, regr_slope(ln(pa), ln(pb)) AS beta, regr_r2(ln(pa), ln(pb)) AS r2, regr_count(ln(pa), ln(pb)) AS n,
    regr_sxx(ln(pa), ln(pb)) AS sxx, regr_syy(ln(pa), ln(pb)) - pow(regr_sxy(ln(pa), ln(pb)), 2) / regr_sxx(ln(pa), ln(pb)) AS ss FROM frame GROUP BY 1),
hedged AS (SELECT f.pair_id, d, (ln(pa) - (alpha + beta * ln(pb))) * 10000 AS s, row_number() OVER (PARTITION BY f.pair_id ORDER BY d) AS i FROM frame f JOIN ols USING (pair_id))"""


@query("ag_ols_hedge", f"WITH {OLS_SQL} SELECT pair_id, round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(r2, 6) AS r2, n, round(beta / sqrt(ss / (n - 2) / sxx), 6) AS t FROM ols")
def ag_ols_hedge(spark, sf_dir):
    return A.ols_hedge(frame(spark, sf_dir)).select("pair_id", *r6("alpha", "beta", "r2"), F.col("n").cast("long").alias("n"), *r6("t"))


@query("exp_beta_drift", f"WITH {OLS_SQL} SELECT pair_id, round(abs(beta - 1), 6) AS drift FROM ols")
def exp_beta_drift(spark, sf_dir):
    """How far the hedge ratio of each pair is from the one that an equal-weighted spread assumes."""
    return A.ols_hedge(frame(spark, sf_dir)).select("pair_id", F.round(E.beta_drift(F.col("beta")), 6).alias("drift"))


@query("exp_hedged_spread", f"WITH {OLS_SQL} SELECT pair_id, d, round(s, 4) AS spread_bps FROM hedged")
def exp_hedged_spread(spark, sf_dir):
    rows = frame(spark, sf_dir)
    return A.hedged_spread(rows, A.ols_hedge(rows)).select("pair_id", "d", F.round("spread_bps", 4).alias("spread_bps"))


@query("ag_ou_fit", f"WITH {LAGGED_SQL}, p AS (SELECT pair_id, {ou_parts()} FROM lagged GROUP BY pair_id), f AS (SELECT pair_id, {OU_SQL} FROM p) SELECT pair_id, round(theta, 6) AS theta, round(mu, 6) AS mu, round(sigma, 6) AS sigma, round(half_life, 6) AS half_life, round(t, 6) AS t FROM f")
def ag_ou_fit(spark, sf_dir):
    return A.ou(series(spark, sf_dir), "pair_id", "i", "v").select("pair_id", *r6("theta", "mu", "sigma", "half_life", "t"))


@query("ag_half_life", f"WITH {LAGGED_SQL} SELECT pair_id, CASE WHEN regr_slope(dv, lv) < 0 THEN round(-ln(2) / regr_slope(dv, lv), 6) END AS half_life FROM lagged GROUP BY pair_id")
def ag_half_life(spark, sf_dir):
    return A.half_life(series(spark, sf_dir), "pair_id", "i", "v").select("pair_id", *r6("half_life"))


@query("ag_return_corr", "WITH " + ROLLING_SQL + " SELECT pair_id, round(corr(ra, rb), 6) AS return_corr FROM returns GROUP BY pair_id")
def ag_return_corr(spark, sf_dir):
    return returns(spark, sf_dir).groupBy("pair_id").agg(F.round(F.corr("ra", "rb"), 6).alias("return_corr"))


@query(
    "ag_rolling_corr_extremes",
    f"WITH {ROLLING_SQL} SELECT pair_id, round(arg_max(c, d), 6) AS now, round(min(c), 6) AS low, round(max(c), 6) AS high, CASE WHEN max(c) - min(c) < 0.4 THEN 'stable' WHEN max(c) - min(c) < 0.8 THEN 'variable' ELSE 'unstable' END AS stability FROM rolling GROUP BY pair_id",
)
def ag_rolling_corr_extremes(spark, sf_dir):
    found = rolling(spark, sf_dir).groupBy("pair_id").agg(F.max_by("c", "d").alias("now"), F.min("c").alias("low"), F.max("c").alias("high"))
    return found.select("pair_id", *r6("now", "low", "high"), E.stability(F.col("high") - F.col("low")).alias("stability"))


@query("ag_spread_stats", f"WITH {SERIES_SQL}, g AS (SELECT pair_id, avg(v) AS m, stddev_samp(v) AS s, arg_max(v, i) AS now, max(v) AS hi, min(v) AS lo FROM series GROUP BY 1) SELECT pair_id, round(s, 6) AS sd, round((now - m) / s, 6) AS current_z, round(greatest(hi - m, m - lo) / s, 6) AS max_abs_z FROM g")
def ag_spread_stats(spark, sf_dir):
    return A.spread_stats(series(spark, sf_dir), "pair_id", "i", "v").select("pair_id", *r6("sd", "current_z", "max_abs_z"))


@query("ag_sigma_lie", f"WITH {SERIES_SQL}, g AS (SELECT pair_id, avg(v) AS m, stddev_samp(v) AS s FROM series GROUP BY 1) SELECT pair_id, round(avg(CASE WHEN abs(v - m) / s > 3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share_beyond_3, round(avg(CASE WHEN abs(v - m) / s > 3 THEN 1.0::DOUBLE ELSE 0 END) / 0.0026998, 6) AS ratio FROM series JOIN g USING (pair_id) GROUP BY pair_id")
def ag_sigma_lie(spark, sf_dir):
    return A.sigma_lie(series(spark, sf_dir), "pair_id", "v").select("pair_id", *r6("share_beyond_3", "ratio"))


@query(
    "ag_bh_threshold",
    """WITH p AS (SELECT event_type AS family, event_id AS i, exp(-value / 25.0) AS p FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p) AS k, count(*) OVER (PARTITION BY family) AS m FROM p),
t AS (SELECT *, max(CASE WHEN p <= k::DOUBLE / m * 0.05 THEN p END) OVER (PARTITION BY family) AS threshold FROM r) SELECT family, i, round(p, 9) AS p, round(coalesce(threshold, 0), 9) AS threshold, coalesce(p <= threshold, false) AS admitted FROM t""",
)
def ag_bh_threshold(spark, sf_dir):
    """Every event's value against an exponential law of mean 25: a family of tests per event type."""
    tests = table(spark, sf_dir, "events").select(F.col("event_type").alias("family"), F.col("event_id").alias("i"), F.exp(-F.col("value") / 25.0).alias("p"))
    found = A.bh_threshold(tests)
    return found.select("family", "i", F.round("p", 9).alias("p"), F.round("threshold", 9).alias("threshold"), "admitted")


RATIO = Linkage("ratio", "A against N", "validation", {"a": ("A", "table"), "b": ("N", "table")}, "b * k", "a", {"k": 1.0})


@query(
    "ag_calibrate_constant",
    f"""WITH {FRAME_SQL}, f AS (SELECT * FROM frame WHERE pair_id = 'A-N'), e AS (SELECT quantile_cont(CASE WHEN abs(pa / pb - 1) < abs(pb / pa - 1) THEN pa / pb ELSE pb / pa END, 0.5) AS k, count(*) AS n FROM f),
r AS (SELECT (pa - pb * k) / pa * 10000 AS r, k, n FROM f, e)
SELECT 'ratio' AS linkage_id, 'k' AS param, 1.0::DOUBLE AS asserted, round(k, 6) AS estimated, n AS samples, round((k - 1) * 100, 6) AS drift_pct, round(stddev_samp(r), 6) AS sd_bps, round(avg(abs(r)), 6) AS mean_abs_bps,
  CASE WHEN abs((k - 1) * 100) < 0.5 THEN 'agrees' WHEN abs((k - 1) * 100) < 3 THEN 'drifted' ELSE 'wrong' END AS verdict FROM r GROUP BY k, n""",
)
def ag_calibrate_constant(spark, sf_dir):
    closes = frame(spark, sf_dir).where("pair_id = 'A-N'").select("d", F.col("pa").alias("a"), F.col("pb").alias("b"))
    return A.calibrate(closes, RATIO, "k").select("linkage_id", "param", "asserted", *r6("estimated"), "samples", *r6("drift_pct", "sd_bps", "mean_abs_bps"), "verdict")


@query(
    "ag_scorecard",
    f"WITH {ALERTS_SQL} SELECT count(*) AS alerts, count(move) AS resolved, count(*) FILTER (WHERE move - 26.95 > 0) AS wins, round(avg(move - 26.95), 6) AS mean_net_bps, round(avg(move - predicted), 6) AS mean_bias_bps, count(move) < 15 AS too_few FROM outcomes",
)
def ag_scorecard(spark, sf_dir):
    found = A.scorecard(outcomes(spark, sf_dir), 26.95)
    return found.select("alerts", "resolved", "wins", *r6("mean_net_bps", "mean_bias_bps"), "too_few")


@query(
    "ag_coverage",
    "SELECT event_type, count(*) AS n, max(ts) AS last, round(CAST(epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(max(ts)) AS DOUBLE) / 3.6e9, 6) AS age_hours, CAST(epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(max(ts)) AS DOUBLE) / 3.6e9 > 24 AS silent FROM events GROUP BY event_type",
)
def ag_coverage(spark, sf_dir):
    found = A.coverage(table(spark, sf_dir, "events"), "event_type", "ts", F.lit("2024-01-31 00:00:00").cast("timestamp"))
    return found.select("event_type", "n", "last", *r6("age_hours"), "silent")


@query("ag_alert_count", f"WITH {ALERTS_SQL} SELECT pair_id, count(*) AS n FROM alerts GROUP BY pair_id")
def ag_alert_count(spark, sf_dir):
    return series(spark, sf_dir).where(F.abs("v") > 6000).groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"))


# ---- event study

# up to 200 degrees of freedom a table, beyond them the expansion in 1/dof, whose error is under 1e-12 there
_T = t_expansion(0.9)
T_SQL = "tq(v, t) AS (VALUES " + ", ".join(f"({v}, {t_quantile(0.9, v)!r}::DOUBLE)" for v in range(1, 201)) + ")"
T_SERIES = " + ".join(f"{g!r}::DOUBLE / pow(e.n - 2, {i})" if i else f"{g!r}::DOUBLE" for i, g in enumerate(_T))
WALK_SQL = MOVES_SQL + ", " + T_SQL + f""", m AS (SELECT event_id, symbol, day, surprise_pct AS x, raw - bench AS y FROM moves),
e AS (SELECT *, regr_count(y, x) OVER w AS n, regr_slope(y, x) OVER w AS b, regr_intercept(y, x) OVER w AS a, regr_sxx(y, x) OVER w AS sxx, avg(x) OVER w AS mx, greatest(regr_syy(y, x) OVER w - pow(regr_sxy(y, x) OVER w, 2) / nullif(regr_sxx(y, x) OVER w, 0), 0) AS ss
  FROM m WINDOW w AS (PARTITION BY symbol ORDER BY day, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT e.*, a + b * x AS centre, CASE WHEN e.n >= 3 THEN CASE WHEN e.n > 202 THEN {T_SERIES} ELSE t END * sqrt(ss / nullif(e.n - 2, 0)) * sqrt(1 + 1.0::DOUBLE / e.n + CASE WHEN sxx > 0 THEN pow(x - mx, 2) / sxx ELSE 0 END) END AS half FROM e LEFT JOIN tq ON tq.v = e.n - 2)"""


def abnormal(spark, sf_dir):
    return event_moves(spark, sf_dir).select("symbol", "event_id", "day", F.col("surprise_pct").alias("surprise"), (F.col("raw") - F.col("bench")).alias("move"))


@query("wn_prediction_interval", f"WITH {WALK_SQL} SELECT event_id, symbol, n, round(centre - half, 4) AS low, round(centre + half, 4) AS high FROM h WHERE n >= 3")
def wn_prediction_interval(spark, sf_dir):
    rows = R.walk_forward(abnormal(spark, sf_dir), ["day", "event_id"]).where("n >= 3")
    return rows.select("event_id", "symbol", F.col("n").cast("long").alias("n"), F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


@query("ag_walkforward_coverage", f"WITH {WALK_SQL} SELECT symbol, count(*) AS checked, round(avg(CASE WHEN y BETWEEN centre - half AND centre + half THEN 1.0::DOUBLE ELSE 0 END), 6) AS coverage FROM h WHERE n >= 12 GROUP BY symbol")
def ag_walkforward_coverage(spark, sf_dir):
    rows = R.walk_forward(abnormal(spark, sf_dir), ["day", "event_id"]).where("checked")
    return rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("checked"), F.round(F.avg(F.col("inside").cast("double")), 6).alias("coverage"))


@query("pl_event_study")
def pl_event_study(spark, sf_dir):
    return R.event_study(abnormal(spark, sf_dir), ["day", "event_id"])


@query(
    "pl_event_study_fit",
    f"""WITH {WALK_SQL}, f AS (SELECT symbol, count(*) AS n, regr_intercept(y, x) AS a, regr_slope(y, x) AS b, regr_r2(y, x) AS r2, quantile_cont(abs(y), 0.5) AS typical, avg(x) AS mx, regr_sxx(y, x) AS sxx,
  greatest(regr_syy(y, x) - pow(regr_sxy(y, x), 2) / nullif(regr_sxx(y, x), 0), 0) AS ss FROM m GROUP BY symbol),
g AS (SELECT e.*, CASE WHEN e.n > 202 THEN {T_SERIES} ELSE t END * sqrt(ss / (e.n - 2)) * sqrt(1 + 1.0::DOUBLE / e.n + pow(0.5 - mx, 2) / sxx) AS half FROM f e LEFT JOIN tq ON tq.v = e.n - 2),
c AS (SELECT symbol, count(*) AS coverage_n, avg(CASE WHEN y BETWEEN centre - half AND centre + half THEN 1.0::DOUBLE ELSE 0 END) AS coverage FROM h WHERE n >= 12 GROUP BY symbol)
SELECT symbol, n, round(a + b * 0.5, 6) AS expected, round(a + b * 0.5 - half, 6) AS low, round(a + b * 0.5 + half, 6) AS high, round(typical, 6) AS typical_abs_move, round(b, 6) AS beta, round(r2, 6) AS r2, round(coverage, 6) AS coverage, coverage_n,
  coalesce(abs(coverage - 0.8) <= 0.1, FALSE) AS calibrated FROM g JOIN c USING (symbol) WHERE n >= 12""",
)
def pl_event_study_fit(spark, sf_dir):
    """The event study for a surprise of half a percent, without its p-values."""
    found = R.event_study(abnormal(spark, sf_dir), ["day", "event_id"], surprise=0.5)
    longs = [F.col(c).cast("long").alias(c) for c in ("n", "coverage_n")]
    return found.select("symbol", *longs, *r6("expected", "low", "high", "typical_abs_move", "beta", "r2", "coverage"), "calibrated")


@query("ag_typical_move", f"WITH {MOVES_SQL} SELECT symbol, round(quantile_cont(abs(raw - bench), 0.5), 6) AS typical_abs_move, count(*) AS n FROM moves GROUP BY symbol")
def ag_typical_move(spark, sf_dir):
    return abnormal(spark, sf_dir).groupBy("symbol").agg(F.round(F.expr("percentile(abs(move), 0.5)"), 6).alias("typical_abs_move"), F.count(F.lit(1)).alias("n"))


# ---- backtest


def _scored_sql(source: str, start: int) -> str:
    return f"""lag2 AS (SELECT *, lag(v) OVER k AS lv, v - lag(v) OVER k AS dv, lead(v, 3) OVER k AS later FROM {source} WINDOW k AS (PARTITION BY pair_id ORDER BY i)),
p AS (SELECT pair_id, i, d, v, later, count(v) OVER w AS full_n, quantile_cont(v, 0.01) OVER w AS lo, quantile_cont(v, 0.99) OVER w AS hi, quantile_cont(v, 0.5) OVER w AS med, avg(v) OVER w AS mean, stddev_samp(v) OVER w AS sd,
  {ou_parts("OVER u")}
  FROM lag2 WINDOW w AS (PARTITION BY pair_id ORDER BY i ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING), u AS (PARTITION BY pair_id ORDER BY i ROWS BETWEEN 249 PRECEDING AND 1 PRECEDING)),
q AS (SELECT *, {OU_SQL} FROM p WHERE i > {start} AND v IS NOT NULL AND later IS NOT NULL AND full_n = 250),
scored AS (SELECT pair_id, i, d, v, med, mean, sd, theta, t, half_life, abs(v) - abs(later) AS move, v > hi OR v < lo AS exceeds, theta > 0 AND abs(t) >= 2.86 AND abs(v - med) * (1 - exp(-theta * 3)) - 26.95 >= 0 AS passed FROM q)"""


DETREND_SQL = SERIES_SQL + """, dt AS (SELECT pair_id, d, i, v - (regr_intercept(v, i) OVER w + regr_slope(v, i) OVER w * i) AS r, count(v) OVER w AS n FROM series WINDOW w AS (PARTITION BY pair_id ORDER BY i ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING)),
resid AS (SELECT pair_id, d, i, CASE WHEN n = 250 THEN r END AS v FROM dt)"""
CANDIDATE_COLS = "pair_id, i, d, round(v, 6) AS v, round(move, 6) AS move, exceeds, exceeds AND passed AS candidate"
PLAIN_SQL = SERIES_SQL + ", " + _scored_sql("series", 300)
TREND_SQL = DETREND_SQL + ", " + _scored_sql("resid", 500)


def _candidates(spark, sf_dir, detrended):
    f = F.col("fit")
    rows = R.eligible(series(spark, sf_dir), detrended)
    passed = E.horizon_gate(F.col("v") - F.col("median"), f["theta"], f["t"], f["half_life"], 3, F.lit(26.95), F.lit(0.0))["passed"]
    return rows.select("pair_id", F.col("i").cast("long").alias("i"), "d", *r6("v", "move"), "exceeds", (F.col("exceeds") & passed).alias("candidate"))


@query("pl_backtest_candidates", f"WITH {PLAIN_SQL} SELECT {CANDIDATE_COLS} FROM scored")
def pl_backtest_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir, False)


@query("pl_backtest_candidates_detrended", f"WITH {TREND_SQL} SELECT {CANDIDATE_COLS} FROM scored")
def pl_backtest_candidates_detrended(spark, sf_dir):
    return _candidates(spark, sf_dir, True)


SUMMARY_SQL = """, c AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY i) AS k FROM scored WHERE exceeds AND passed),
walk AS (
  SELECT pair_id, k, i, true AS taken, i AS last FROM c WHERE k = 1
  UNION ALL SELECT c.pair_id, c.k, c.i, c.i >= w.last + 3, CASE WHEN c.i >= w.last + 3 THEN c.i ELSE w.last END FROM walk w JOIN c ON c.pair_id = w.pair_id AND c.k = w.k + 1),
a AS (SELECT c.* FROM c JOIN walk w ON w.pair_id = c.pair_id AND w.k = c.k WHERE taken),
b AS (SELECT pair_id, avg(move) AS base, count(*) AS baseline_n FROM scored GROUP BY 1),
s AS (SELECT pair_id, count(*) AS alerts, avg(CASE WHEN move > 0 THEN 1.0::DOUBLE ELSE 0 END) AS hit_rate, avg(CASE WHEN move - 26.95 > 0 THEN 1.0::DOUBLE ELSE 0 END) AS profit_rate, avg(move) AS mean_move, avg(move - 26.95) AS mean_net,
  count(*) FILTER (WHERE (v - mean) / sd < 0) AS low_side, count(*) FILTER (WHERE (v - mean) / sd >= 0) AS high_side FROM a GROUP BY 1)
SELECT pair_id, baseline_n, round(base, 6) AS baseline_move, coalesce(alerts, 0) AS alerts, round(hit_rate, 6) AS hit_rate, round(profit_rate, 6) AS profit_rate, round(mean_move, 6) AS mean_move, round(mean_net, 6) AS mean_net,
  coalesce(low_side, 0) AS low_side, coalesce(high_side, 0) AS high_side, round(mean_move - base, 6) AS edge FROM b LEFT JOIN s USING (pair_id)"""


def _summary(spark, sf_dir, detrended):
    rows = R.eligible(series(spark, sf_dir), detrended)
    found = R.backtest_summary(rows, R.backtest_alerts(rows, 26.95))
    return found.select("pair_id", "baseline_n", *r6("baseline_move"), "alerts", *r6("hit_rate", "profit_rate", "mean_move", "mean_net"), "low_side", "high_side", *r6("edge"))


@query("pl_backtest_summary", f"WITH RECURSIVE {PLAIN_SQL}{SUMMARY_SQL}")
def pl_backtest_summary(spark, sf_dir):
    return _summary(spark, sf_dir, False)


@query("pl_backtest_summary_detrended", f"WITH RECURSIVE {TREND_SQL}{SUMMARY_SQL}")
def pl_backtest_summary_detrended(spark, sf_dir):
    return _summary(spark, sf_dir, True)


# ---- pairs


PROFILE_SQL = FLAGS_SQL + """, clean AS (SELECT pair_id, d, pa, pb FROM flags WHERE NOT (spike_a OR spike_b OR stale_a OR stale_b OR outlier)),
fit AS (SELECT pair_id, regr_intercept(ln(pa), ln(pb)) AS alpha, regr_slope(ln(pa), ln(pb)) AS beta, regr_r2(ln(pa), ln(pb)) AS r2, count(*) AS n FROM clean GROUP BY pair_id),
spread AS (SELECT pair_id, d, (ln(pa) - (alpha + beta * ln(pb))) * 10000 AS s, pa / lag(pa) OVER k - 1 AS ra, pb / lag(pb) OVER k - 1 AS rb FROM clean JOIN fit USING (pair_id) WINDOW k AS (PARTITION BY pair_id ORDER BY d)),
step AS (SELECT pair_id, d, s, ra, rb, lag(s) OVER k AS ls, s - lag(s) OVER k AS ds, CASE WHEN count(ra) OVER w = 60 THEN corr(ra, rb) OVER w END AS c
  FROM spread WINDOW k AS (PARTITION BY pair_id ORDER BY d), w AS (PARTITION BY pair_id ORDER BY d ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
whole AS (SELECT pair_id, min(d) AS first_day, max(d) AS last_day, corr(ra, rb) AS return_corr, arg_max(c, d) AS corr_now, min(c) AS corr_min, max(c) AS corr_max, stddev_samp(s) AS sd, (arg_max(s, d) - avg(s)) / stddev_samp(s) AS current_z,
  CASE WHEN regr_slope(ds, ls) < 0 AND regr_count(ds, ls) >= 30 THEN -ln(2) / regr_slope(ds, ls) END AS half_life FROM step GROUP BY pair_id)"""


@query(
    "pl_profile_measures",
    f"""WITH {PROFILE_SQL} SELECT pair_id, n, first_day, last_day, round(beta, 6) AS beta, round(r2, 6) AS r2, round(return_corr, 6) AS return_corr, round(corr_now, 6) AS corr_now, round(corr_min, 6) AS corr_min, round(corr_max, 6) AS corr_max,
  round(sd, 4) AS sd, round(current_z, 6) AS current_z, round(half_life, 6) AS half_life, CASE WHEN corr_max - corr_min < 0.4 THEN 'stable' WHEN corr_max - corr_min < 0.8 THEN 'variable' ELSE 'unstable' END AS stability FROM whole JOIN fit USING (pair_id)""",
)
def pl_profile_measures(spark, sf_dir):
    found = R.profile_measures(frame(spark, sf_dir))
    days = F.col("start").alias("first_day"), F.col("end").alias("last_day")
    return found.select("pair_id", F.col("n").cast("long").alias("n"), *days, *r6("beta", "r2", "return_corr", "corr_now", "corr_min", "corr_max"), F.round("sd", 4).alias("sd"), *r6("current_z", "half_life"), "stability")


@query("pl_pair_profile")
def pl_pair_profile(spark, sf_dir):
    return R.profile(frame(spark, sf_dir))


CATALOGUE = [("A-N", "fx", "A", "N", "full"), ("A-R", "equity_us", "A", "R", "long_only"), ("N-R", "india_index", "N", "R", "none"), ("A-X", "fx", "A", "X", "full")]


@query("pl_admission")
def pl_admission(spark, sf_dir):
    catalogue = spark.createDataFrame(CATALOGUE, "pair_id string, grp string, a string, b string, access string")
    return R.fit_catalogue(frame(spark, sf_dir), catalogue).select("pair_id", "n", "k", "beta", "coint_p", "threshold", "half_life", "theta_t", "net_edge", "admitted", "reason")


# the change on the level and the change before, both centred: two regressors in closed form
UNIT_ROOT_SQL = SERIES_SQL + """, l AS (SELECT pair_id, i, v - lag(v) OVER k AS y, lag(v) OVER k AS x, lag(v) OVER k - lag(v, 2) OVER k AS z FROM series WINDOW k AS (PARTITION BY pair_id ORDER BY i)),
u AS (SELECT * FROM l WHERE z IS NOT NULL), s AS (SELECT pair_id, count(*) AS n, regr_sxx(x, x) AS xx, regr_sxx(z, z) AS zz, regr_sxx(y, y) AS yy, regr_sxy(z, x) AS xz, regr_sxy(y, x) AS xy, regr_sxy(y, z) AS zy FROM u GROUP BY pair_id),
b AS (SELECT *, xx * zz - xz * xz AS det, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS b1, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS b2 FROM s)"""


@query("ag_unit_root_t", f"WITH {UNIT_ROOT_SQL} SELECT pair_id, n + 2 AS n, round(b1 / sqrt((yy - b1 * xy - b2 * zy) / (n - 3) * zz / det), 6) AS t FROM b")
def ag_unit_root_t(spark, sf_dir):
    """The unit-root statistic of each pair's spread with one lag, from summed moments."""
    return unit_root(series(spark, sf_dir), "pair_id", "i", "v", lags=1).select("pair_id", "n", *r6("t"))


# ---- detector, filter, episodes

VERDICT_SQL = LAGGED_SQL + f""", p AS (SELECT pair_id, d, i, v, list(v) OVER w AS h, {ou_parts("OVER u")} FROM lagged WINDOW w AS (PARTITION BY pair_id ORDER BY i ROWS BETWEEN 750 PRECEDING AND 1 PRECEDING), u AS (PARTITION BY pair_id ORDER BY i ROWS BETWEEN 248 PRECEDING AND CURRENT ROW)),
b AS (SELECT pair_id, i, CASE WHEN count(v) OVER w >= 100 THEN quantile_cont(v, 0.01) OVER w END AS lo, CASE WHEN count(v) OVER w >= 100 THEN quantile_cont(v, 0.99) OVER w END AS hi FROM series WINDOW w AS (PARTITION BY pair_id ORDER BY i ROWS BETWEEN 750 PRECEDING AND 1 PRECEDING)),
f AS (SELECT pair_id, d, i, v, h, {OU_SQL} FROM p),
g AS (SELECT f.*, lo, hi, CASE WHEN len(h) >= 100 THEN len(list_filter(h, lambda x: x < v)) * 100.0::DOUBLE / len(h) END AS pct, theta > 0 AND abs(t) >= 2.86 AS ok, abs(v - mu) * (1 - exp(-theta * 3)) - 26.95 AS net FROM f JOIN b USING (pair_id, i))"""


@query(
    "ss_detector_verdicts",
    f"WITH {VERDICT_SQL} SELECT pair_id, d, i AS seen, round(pct, 6) AS percentile, v > hi OR v < lo AS exceeds, i >= 120 AND coalesce(v > hi OR v < lo, false) AND coalesce(ok AND net >= 0, false) AS alert FROM g",
)
def ss_detector_verdicts(spark, sf_dir):
    return verdicts(series(spark, sf_dir), "pair_id", "i", "v", 26.95).select("pair_id", "d", "seen", *r6("percentile"), "exceeds", "alert")


#: Event types as instruments of a live feed, polled by the hour.
LIVE = Universe((
    Linkage("flow", "purchases against views", "validation", {"a": ("purchase", "events"), "b": ("view", "events")}, "b * k", "a", {"k": 1.0}, {"cost": 26.95}, AlertRule(1.8, 2.5, 0.0, 1)),
    Linkage("mix", "clicks against views and signups", "validation", {"a": ("click", "events"), "b": ("view", "events"), "c": ("signup", "events")}, "(b + c) / two", "a", {"two": 2.0}, {"cost": 26.95}, AlertRule(1.8, 2.5, 0.0, 1)),
))
LIVE_SQL = """q AS (SELECT event_type AS symbol, date_trunc('hour', ts) + INTERVAL 1 HOUR AS poll, arg_max(value, (ts, value)) AS price, max(ts) AS quoted FROM events WHERE value IS NOT NULL GROUP BY 1, 2),
legs(linkage_id, leg, symbol, n_legs) AS (VALUES ('flow', 'a', 'purchase', 2), ('flow', 'b', 'view', 2), ('mix', 'a', 'click', 3), ('mix', 'b', 'view', 3), ('mix', 'c', 'signup', 3)),
book AS (SELECT linkage_id, poll, max(CASE WHEN leg = 'a' THEN price END) AS a, max(CASE WHEN leg = 'b' THEN price END) AS b, max(CASE WHEN leg = 'c' THEN price END) AS c, bool_or(epoch(poll - quoted) > 1800) AS stale
  FROM legs JOIN q USING (symbol) GROUP BY 1, 2 HAVING count(*) = max(n_legs) AND poll <= (SELECT max(poll) FROM q) - INTERVAL 2 HOUR),
spread AS (SELECT linkage_id, poll, stale, (a - CASE linkage_id WHEN 'flow' THEN b ELSE (b + c) / 2 END) / nullif(a, 0) * 10000 AS v FROM book),
judged AS (SELECT *, count(*) FILTER (WHERE NOT stale) OVER (PARTITION BY linkage_id ORDER BY poll) AS seen FROM spread WHERE v IS NOT NULL),
series AS (SELECT linkage_id AS pair_id, poll AS d, v, seen AS i FROM judged WHERE NOT stale)"""
LIVE_VERDICT_SQL = "WITH " + LIVE_SQL + VERDICT_SQL.removeprefix(SERIES_SQL)


@query(
    "ss_quote_stream_verdicts",
    f"""{LIVE_VERDICT_SQL} SELECT linkage_id, j.poll AS ts, j.stale, j.seen, round(pct, 6) AS percentile, coalesce(i >= 120 AND coalesce(g.v > hi OR g.v < lo, false) AND coalesce(ok AND net >= 0, false), false) AS alert
FROM judged j LEFT JOIN g ON NOT j.stale AND g.pair_id = j.linkage_id AND g.d = j.poll""",
)
def ss_quote_stream_verdicts(spark, sf_dir):
    """The events table as a stream of quotes, through books and detectors in one streaming query, to a table of verdicts."""
    # a pattern, as a stream takes a plain path for a folder
    feed = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")
    at = F.col("ts").cast("timestamp")
    quotes = feed.select((F.date_trunc("hour", at) + F.expr("interval 1 hour")).alias("poll_ts"), F.col("event_type").alias("symbol"), F.col("value").alias("price"), at.alias("ts"), F.lit(False).alias("stale"))
    found = verdicts_of_quotes(quotes, LIVE, "2 hours", 1800.0)
    out = shared_folder(spark, "verdicts")
    writer = found.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True)
    stateful(spark, writer.start).awaitTermination()
    rows = spark.read.schema(found.schema).parquet(f"{out}/rows")
    return rows.select("linkage_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "stale", "seen", *r6("percentile"), "alert")


KALMAN_SQL = SERIES_SQL + """, y AS (SELECT *, first_value(pa) OVER (PARTITION BY pair_id ORDER BY i) AS s FROM series),
kf AS (
  SELECT pair_id, i, 1.0::DOUBLE AS b, 0.0::DOUBLE AS a, 1.0::DOUBLE AS p00, 0.0::DOUBLE AS p01, 1.0::DOUBLE AS p11, 0.0::DOUBLE AS z FROM (SELECT pair_id, 0::BIGINT AS i FROM pairs)
  UNION ALL
  SELECT pair_id, i, b + g0 / var * e, a + g1 / var * e, q00 - g0 * g0 / var, p01 - g0 / var * g1, q11 - g1 * g1 / var, e / sqrt(var) FROM (
    SELECT pair_id, i, b, a, p01, q00, q11, h, q00 * h + p01 AS g0, p01 * h + q11 AS g1, h * (q00 * h + p01) + (p01 * h + q11) + 1e-5::DOUBLE AS var, yn - (h * b + a) AS e FROM (
      SELECT y.pair_id, y.i, b, a, p00 + 1e-7::DOUBLE / (1 - 1e-7::DOUBLE) AS q00, p01, p11 + 1e-7::DOUBLE / (1 - 1e-7::DOUBLE) AS q11, y.pb / s AS h, y.pa / s AS yn FROM kf JOIN y ON y.pair_id = kf.pair_id AND y.i = kf.i + 1)))"""


@query("ss_kalman_batch", f"WITH RECURSIVE {KALMAN_SQL} SELECT pair_id, i, round(b, 6) AS beta, round(z, 6) AS kz, p00 < 1 AS confident FROM kf WHERE i > 0")
def ss_kalman_batch(spark, sf_dir):
    found = S.kalman(series(spark, sf_dir), "pair_id", "i", "pa", "pb")
    return found.select("pair_id", F.col("i").cast("long").alias("i"), *r6("beta", "kz"), "confident")


@query("ss_kalman_blocks", f"WITH RECURSIVE {KALMAN_SQL} SELECT pair_id, i, round(b, 6) AS beta, round(z, 6) AS kz, p00 < 1 AS confident FROM kf WHERE i > 0")
def ss_kalman_blocks(spark, sf_dir):
    """The filter with each series cut over tasks; blocks are small here, so that these series have several."""
    numbered = W.with_row_numbers(series(spark, sf_dir).drop("i"), "pair_id", "d")
    found = X.kalman_blocks(numbered, "pair_id", "i", "pa", "pb", size=512)
    return found.select("pair_id", F.col("i").cast("long").alias("i"), *r6("beta", "kz"), "confident")


EPISODE_SQL = SERIES_SQL + """, zs AS (SELECT pair_id, i, d, CASE WHEN count(v) OVER w >= 30 THEN round((v - avg(v) OVER w) / stddev_samp(v) OVER w, 6) END AS z, round(abs(v) - 26.95, 6) AS net FROM series WINDOW w AS (PARTITION BY pair_id ORDER BY i ROWS BETWEEN 720 PRECEDING AND 1 PRECEDING)),
o AS (SELECT *, epoch(d) AS ts, row_number() OVER (PARTITION BY pair_id ORDER BY i) AS k FROM zs WHERE z IS NOT NULL),
ep AS (
  SELECT pair_id, 0::BIGINT AS k, 0::BIGINT AS i, 'DORMANT' AS state, -1e18::DOUBLE AS alerted, false AS fired, 0.0::DOUBLE AS peak_z, 0.0::DOUBLE AS peak_net FROM pairs
  UNION ALL
  SELECT o.pair_id, o.k, o.i,
    CASE WHEN state = 'DORMANT' THEN CASE WHEN abs(z) >= 1 THEN 'WATCHING' ELSE 'DORMANT' END
         WHEN state = 'ALERT' THEN CASE WHEN abs(z) < 2 THEN 'DECAYING' ELSE 'ALERT' END
         WHEN abs(z) < 1 THEN 'DORMANT'
         WHEN abs(z) >= 2 AND net >= 0 AND (ts - alerted >= 864000 OR state = 'DECAYING') THEN 'ALERT' ELSE state END,
    CASE WHEN state IN ('WATCHING', 'DECAYING') AND abs(z) >= 2 AND net >= 0 AND ts - alerted >= 864000 THEN ts ELSE alerted END,
    state IN ('WATCHING', 'DECAYING') AND abs(z) >= 2 AND net >= 0 AND ts - alerted >= 864000,
    CASE WHEN state = 'DORMANT' AND abs(z) >= 1 THEN abs(z) WHEN state IN ('WATCHING', 'DECAYING') AND abs(z) < 1 THEN 0 ELSE greatest(peak_z, abs(z)) END,
    CASE WHEN state = 'DORMANT' AND abs(z) >= 1 THEN net WHEN state IN ('WATCHING', 'DECAYING') AND abs(z) < 1 THEN 0 ELSE greatest(peak_net, net) END
  FROM ep JOIN o ON o.pair_id = ep.pair_id AND o.k = ep.k + 1)"""


@query("ss_episode_states", f"WITH RECURSIVE {EPISODE_SQL} SELECT pair_id, i, state, fired, peak_z, peak_net FROM ep WHERE k > 0")
def ss_episode_states(spark, sf_dir):
    z = series(spark, sf_dir).withColumn("z", F.round(W.rolling_z("v", W.past("pair_id", "i", W.Z_WINDOW)), 6))
    rows = z.select("pair_id", F.col("i").cast("long").alias("i"), F.unix_timestamp(F.col("d").cast("timestamp")).cast("double").alias("ts"), "z", F.round(F.abs("v") - 26.95, 6).alias("net"), F.lit(False).alias("stale"))
    found = S.episodes(rows, "pair_id", "ts", "z", "net", "stale", 1.0, 2.0, 0.0, 10 * 86_400.0)
    return found.join(rows.select("pair_id", "ts", "i", "z"), ["pair_id", "ts"]).where("z is not null").select("pair_id", "i", "state", "fired", "peak_z", "peak_net")


# ---- chart

OHLC_SQL = "ohlc AS (SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS d, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, sum(l_extendedprice) / sum(l_quantity) AS close FROM lineitem GROUP BY 1, 2)"


def daily_ohlc(spark, sf_dir):
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").cast("date").alias("d")).agg(
        F.max(price).alias("high"), F.min(price).alias("low"), (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close")
    )


@query(
    "pn_pivots",
    f"""WITH {OHLC_SQL}, p AS (SELECT *, count(*) OVER b = 10 AND count(*) OVER a = 10 AS ok, max(high) OVER b AS hb, max(high) OVER a AS ha, min(low) OVER b AS lb, min(low) OVER a AS la
  FROM ohlc WINDOW b AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING))
SELECT symbol, d, CASE WHEN ok AND high > hb AND high > ha THEN round(high, 6) END AS pivot_high, CASE WHEN ok AND low < lb AND low < la THEN round(low, 6) END AS pivot_low FROM p""",
)
def pn_pivots(spark, sf_dir):
    return S.pivots(daily_ohlc(spark, sf_dir), "symbol", "d", 10).select("symbol", "d", *r6("pivot_high", "pivot_low"))


ATR_SQL = OHLC_SQL + """, tr AS (SELECT symbol, d, CASE WHEN lag(close) OVER k IS NULL THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER k), abs(low - lag(close) OVER k)) END AS tr, row_number() OVER k AS i FROM ohlc WINDOW k AS (PARTITION BY symbol ORDER BY d)),
rma AS (SELECT symbol, 14::BIGINT AS i, avg(tr) AS m FROM tr WHERE i <= 14 GROUP BY symbol UNION ALL SELECT tr.symbol, tr.i, m + (tr.tr - m) / 14 FROM rma JOIN tr ON tr.symbol = rma.symbol AND tr.i = rma.i + 1)"""


@query("pn_atr", f"WITH RECURSIVE {ATR_SQL} SELECT symbol, d, round(m, 6) AS atr FROM tr LEFT JOIN rma USING (symbol, i)")
def pn_atr(spark, sf_dir):
    return S.atr(daily_ohlc(spark, sf_dir), "symbol", "d").select("symbol", "d", *r6("atr"))


@query("pn_atr_blocks", f"WITH RECURSIVE {ATR_SQL} SELECT symbol, d, round(m, 6) AS atr FROM tr LEFT JOIN rma USING (symbol, i)")
def pn_atr_blocks(spark, sf_dir):
    """The same with each series cut over tasks."""
    numbered = W.with_row_numbers(daily_ohlc(spark, sf_dir), "symbol", "d")
    return X.atr_blocks(numbered, "symbol", "i", size=512).select("symbol", "d", *r6("atr"))


@query("pn_levels")
def pn_levels(spark, sf_dir):
    closes = bars(spark, sf_dir).withColumns({"high": F.col("close"), "low": F.col("close")})
    found = S.levels(S.atr(closes, "symbol", "d"), "symbol", "d")
    return S.ranked_levels(found, "symbol")


@query(
    "pn_sessions",
    f"""WITH {TICKS_SQL}, l AS (SELECT seq, ts, timezone('Europe/London', timezone('UTC', ts)) AS lon, timezone('America/New_York', timezone('UTC', ts)) AS ny, timezone('Asia/Tokyo', timezone('UTC', ts)) AS tok FROM ticks),
m AS (SELECT seq, hour(lon) * 60 + minute(lon) AS lon, hour(ny) * 60 + minute(ny) AS ny, hour(tok) * 60 + minute(tok) AS tok FROM l)
SELECT seq, lon >= 480 AND lon < 990 AS london, ny >= 570 AND ny < 960 AS new_york, tok >= 540 AND tok < 900 AS tokyo, lon >= 480 AND lon < 990 AND ny >= 570 AND ny < 960 AS overlap FROM m""",
)
def pn_sessions(spark, sf_dir):
    ts = F.col("ts")
    found = ticks(spark, sf_dir).select("seq", *[S.in_session(ts, n).alias(n) for n in ("london", "new_york", "tokyo")])
    return found.withColumn("overlap", F.col("london") & F.col("new_york"))
