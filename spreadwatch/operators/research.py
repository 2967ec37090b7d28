"""Research pipelines: walk-forward backtest, pair profile, admission, event study."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spreadwatch.functions import expressions as E
from spreadwatch.functions.stats import ols, t_pvalue_of, t_quantile_of
from spreadwatch.operators import aggregates as A
from spreadwatch.operators import windows as W
from spreadwatch.operators.quality import screen
from spreadwatch.operators.sequential import greedy_cooldown
from spreadwatch.operators.unit_root import cointegration, unit_root
from spreadwatch.sources.config import Linkage, Pair
from spreadwatch.sources.shared import written

WARMUP, HORIZON = 300, 3
ADMISSION_SIGMAS, MAX_TRADES = 2.0, 500.0


def eligible(series: DataFrame, detrended: bool = False, warmup: int = WARMUP, h: int = HORIZON) -> DataFrame:
    """Rows of (pair_id, i, d, v) with a full clean past and an outcome, scored; i counts from 1.

    One sort per pair serves all frames.
    """
    df = series
    start = warmup
    if detrended:
        df = W.causal_detrend(df, "pair_id", "i", "v").withColumn("v", F.col("resid"))
        start = max(warmup, 2 * W.FIT_WINDOW)
    w = W.past("pair_id", "i", W.FIT_WINDOW)
    order = Window.partitionBy("pair_id").orderBy("i")
    scored = W.with_lag(df, "pair_id", "i", "v").withColumns({"mean": F.avg("v").over(w), "sd": F.stddev_samp("v").over(w), "later": F.lead("v", h).over(order)})
    scored = W.with_ou(scored, "pair_id", "i", W.FIT_WINDOW - 1)
    scored = W.with_quantiles(scored, "pair_id", "i", "v", W.FIT_WINDOW, {"_low": 0.01, "median": 0.5, "_high": 0.99}, min_rows=W.FIT_WINDOW)
    whole = scored.where((F.col("i") > start) & F.col("v").isNotNull() & F.col("later").isNotNull() & F.col("median").isNotNull())
    return whole.withColumns({"move": F.abs("v") - F.abs("later"), "exceeds": (F.col("v") > F.col("_high")) | (F.col("v") < F.col("_low"))}).drop("_low", "_high", "lv", "dv")


def backtest_alerts(rows: DataFrame, friction: float, h: int = HORIZON) -> DataFrame:
    """The alerts among scored rows, none inside the holding period of another."""
    f = F.col("fit")
    gate = E.horizon_gate(F.col("v") - F.col("median"), f["theta"], f["t"], f["half_life"], h, F.lit(friction), F.lit(0.0))
    passed = rows.where("exceeds").withColumn("gate", gate).where("gate.passed")
    z = F.when(F.col("sd") > 0, (F.col("v") - F.col("mean")) / F.col("sd")).otherwise(0.0)
    return greedy_cooldown(passed, "pair_id", "i", h).select(
        "pair_id", "i", "d", "v", z.alias("z"), f["half_life"].alias("half_life"), F.col("gate.expected_bps").alias("expected_bps"), F.col("gate.net_bps").alias("predicted_net_bps"),
        "move", (F.col("move") - friction).alias("net"), (F.col("move") > 0).alias("reverted"), (F.col("move") - friction > 0).alias("profitable"),
    )


def backtest_summary(rows: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row per pair: what alerts did against every other eligible day."""
    base = rows.groupBy("pair_id").agg(F.avg("move").alias("baseline_move"), F.count(F.lit(1)).alias("baseline_n"))
    rate = lambda c: F.avg(F.col(c).cast("double"))
    won = alerts.groupBy("pair_id").agg(
        F.count(F.lit(1)).alias("alerts"), rate("reverted").alias("hit_rate"), rate("profitable").alias("profit_rate"), F.avg("move").alias("mean_move"), F.avg("net").alias("mean_net"),
        F.count(F.when(F.col("z") < 0, 1)).alias("low_side"), F.count(F.when(F.col("z") >= 0, 1)).alias("high_side"),
        F.count(F.when((F.col("z") < 0) & F.col("profitable"), 1)).alias("low_wins"), F.count(F.when((F.col("z") >= 0) & F.col("profitable"), 1)).alias("high_wins"),
    )
    out = base.join(won, "pair_id", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("alerts", "low_side", "high_side", "low_wins", "high_wins")})
    edge = F.col("mean_move") - F.col("baseline_move")
    return out.withColumns({"edge": edge, "verdict": E.backtest_verdict(F.col("alerts"), edge, F.col("mean_net"))})


def pair_tests(frame: DataFrame, logs: bool) -> DataFrame:
    """(pair_id, coint_p, adf_p); logs chooses between log prices and levels for cointegration.

    Null for pairs of fewer than 60 rows, and with logs for pairs with a price of 0 or less.
    """
    low = frame.groupBy("pair_id").agg(F.min(F.least("pa", "pb")).alias("_low"))
    sound = low.where("_low > 0").select("pair_id") if logs else low.select("pair_id")
    tested = frame.join(sound, "pair_id", "left_semi")
    price = lambda c: F.log(c) if logs else F.col(c)
    coint = cointegration(tested.select("pair_id", "d", price("pa").alias("_a"), price("pb").alias("_b")), "pair_id", "d", "_a", "_b").select("pair_id", F.col("p").alias("coint_p"))
    adf = unit_root(tested, "pair_id", "d", "spread_bps").select("pair_id", F.col("p").alias("adf_p"))
    return low.select("pair_id").join(coint, "pair_id", "left").join(adf, "pair_id", "left")


def _measured(spread: DataFrame, fits: DataFrame, window: int) -> DataFrame:
    """What a profile holds besides its tests, from screened rows with the spread of the pair's own fit."""
    k = Window.partitionBy("pair_id").orderBy("d")
    rets = spread.select("pair_id", "d", (F.col("pa") / F.lag("pa").over(k) - 1).alias("ra"), (F.col("pb") / F.lag("pb").over(k) - 1).alias("rb"))
    rolled = rets.withColumn("c", W.rolling_corr("ra", "rb", W.upto("pair_id", "d", window), window))
    corr = rolled.groupBy("pair_id").agg(F.corr("ra", "rb").alias("return_corr"), F.max_by("c", "d").alias("corr_now"), F.min("c").alias("corr_min"), F.max("c").alias("corr_max"))
    out = spread.groupBy("pair_id").agg(F.min("d").alias("start"), F.max("d").alias("end"))
    for part in (fits, corr, A.spread_stats(spread, "pair_id", "d", "spread_bps"), A.half_life(spread, "pair_id", "d", "spread_bps")):
        out = out.join(part, "pair_id", "left")
    return out.withColumn("stability", E.stability(F.col("corr_max") - F.col("corr_min")))


def profile_measures(frame: DataFrame, window: int = 60) -> DataFrame:
    """Of each pair (pair_id, d, pa, pb) its regression, correlations, spread and half-life: all Spark can do without Python."""
    clean = screen(frame)
    fits = A.ols_hedge(clean)
    return _measured(A.hedged_spread(clean, fits), fits, window)


def profile(frame: DataFrame, window: int = 60) -> DataFrame:
    """What there is to know about each pair (pair_id, d, pa, pb), one row per pair."""
    clean = written(screen(frame), "screened")
    fits = A.ols_hedge(clean)
    spread = written(A.hedged_spread(clean, fits), "spread")
    out = _measured(spread, fits, window).join(pair_tests(spread, logs=False), "pair_id", "left")
    swing = F.col("corr_max") - F.col("corr_min")
    return out.withColumn("verdict", E.profile_verdict(F.col("n"), F.col("coint_p"), F.col("half_life"), swing))


def fit_catalogue(frame: DataFrame, catalogue: DataFrame, horizon: float = 3.0, q: float = 0.05) -> DataFrame:
    """Every pair of the catalogue fitted, screened as one family of tests and admitted or refused, with the reason.

    Pairs without prices for both legs come back refused.
    """
    clean = written(screen(frame), "screened")
    fits = A.ols_hedge(clean)
    spread = written(A.hedged_spread(clean, fits), "spread")
    found = fits.withColumn("k", F.exp("alpha"))
    ou = A.ou(spread, "pair_id", "d", "spread_bps").select("pair_id", "theta", "mu", "sigma", "half_life", F.col("t").alias("theta_t"))
    for part in (ou, A.spread_stats(spread, "pair_id", "d", "spread_bps"), pair_tests(spread, logs=True)):
        found = found.join(part.drop("n"), "pair_id", "left")
    met = catalogue.join(found, "pair_id", "left").withColumns({"friction": E.group_friction(F.col("grp")), "family": F.lit("all")})
    tested = A.bh_threshold(met.where("coint_p is not null").withColumnRenamed("coint_p", "p"), q).withColumnRenamed("p", "coint_p").withColumnRenamed("admitted", "survives")
    met = tested.unionByName(met.where("coint_p is null").withColumns({"threshold": F.lit(None).cast("double"), "survives": F.lit(False)}))
    gate = E.horizon_gate(ADMISSION_SIGMAS * F.col("sd"), F.col("theta"), F.col("theta_t"), F.col("half_life"), horizon, F.col("friction"), F.lit(0.0))
    met = met.withColumn("net_edge", F.when(F.col("theta").isNotNull(), gate["net_bps"]))
    trades = E.trades_to_detect(F.col("net_edge"), F.col("sigma"), horizon)
    reason = (
        F.when(F.col("n").isNull(), "no prices for both legs")
        .when((F.col("n") < 250) | F.col("coint_p").isNull(), F.concat(F.lit("only "), F.col("n").cast("string"), F.lit(" observations")))
        .when(~F.col("survives"), F.format_string("not cointegrated (p=%.4f against %.4f for the family)", "coint_p", "threshold"))
        .when(~F.coalesce(E.reverts(F.col("theta"), F.col("theta_t")), F.lit(False)), "reversion not separable from a random walk")
        .when(F.col("net_edge") <= 0, "costs more than comes back")
        .when(trades > MAX_TRADES, "too many trades to tell the edge from zero")
    )
    return met.withColumns({"trades": trades, "admitted": reason.isNull(), "reason": F.coalesce(reason, F.lit("admitted"))}).drop("family", "survives")


def compile_pair(pair: Pair, k: float, beta: float, friction: float) -> Linkage:
    """A fitted pair as a declared linkage."""
    return Linkage(
        id=pair.id, description=f"{pair.a} against {pair.b}, fitted", category="tradeable" if pair.access == "full" else "observational",
        legs={"a": (pair.a, "table"), "b": (pair.b, "table")}, fair_value="k * b ** beta", reference="a",
        params={"k": round(k, 8), "beta": round(beta, 6)}, friction_bps={"round_trip": friction},
    )


def walk_forward(moves: DataFrame, order: list[str], confidence: float = 0.8, min_train: int = 12) -> DataFrame:
    """Each outcome (symbol, surprise, move) against the interval that earlier ones predict for it.

    An expanding regression per symbol, with the t-quantile of exactly as many earlier outcomes as
    there are, worked out in Arrow batches once for each number.
    """
    w = Window.partitionBy("symbol").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    fit = ols(F.col("move"), F.col("surprise"), w)
    mean = F.avg("surprise").over(w)
    rows = moves.withColumns({"n": fit["n"], "centre": fit["alpha"] + fit["beta"] * F.col("surprise"), "_ss": fit["ss_res"], "_sxx": fit["sxx"], "_mean": mean})
    rows = rows.withColumn("_tq", t_quantile_of(1 - (1 - confidence) / 2, F.when(F.col("n") >= 3, F.col("n") - 2)))
    leverage = F.when(F.col("_sxx") > 0, F.pow(F.col("surprise") - F.col("_mean"), F.lit(2.0)) / F.col("_sxx")).otherwise(0.0)
    half = F.col("_tq") * F.sqrt(F.col("_ss") / (F.col("n") - 2)) * F.sqrt(1 + 1 / F.col("n") + leverage)
    half = F.when(F.col("n") >= 3, half)
    rows = rows.withColumns({"low": F.col("centre") - half, "high": F.col("centre") + half, "checked": F.col("n") >= min_train})
    inside = (F.col("move") >= F.col("low")) & (F.col("move") <= F.col("high"))
    return rows.withColumn("inside", F.when(F.col("checked"), inside)).drop("_ss", "_sxx", "_mean", "_tq")


def event_study(moves: DataFrame, order: list[str], surprise: float = 0.0, confidence: float = 0.8, min_events: int = 12) -> DataFrame:
    """One row per symbol with enough events: expected move, its interval, how well surprise explains it, coverage."""
    fit = ols(F.col("move"), F.col("surprise"))
    whole = moves.groupBy("symbol").agg(
        fit["n"].alias("n"), fit["alpha"].alias("alpha"), fit["beta"].alias("beta"), fit["r2"].alias("r2"), fit["ss_res"].alias("ss"), fit["sxx"].alias("sxx"),
        F.avg("surprise").alias("mean"), F.expr("percentile(abs(move), 0.5)").alias("typical_abs_move"),
    ).where(F.col("n") >= min_events)
    tested = walk_forward(moves, order, confidence, min_events).groupBy("symbol").agg(F.avg(F.col("inside").cast("double")).alias("coverage"), F.count("inside").alias("coverage_n"))

    s = F.sqrt(F.col("ss") / (F.col("n") - 2))
    leverage = F.when(F.col("sxx") > 0, F.pow(F.lit(surprise) - F.col("mean"), F.lit(2.0)) / F.col("sxx")).otherwise(0.0)
    half = t_quantile_of(1 - (1 - confidence) / 2, F.col("n") - 2) * s * F.sqrt(1 + 1 / F.col("n") + leverage)
    out = whole.join(tested, "symbol").withColumns({"expected": F.col("alpha") + F.col("beta") * surprise, "half": half, "p": t_pvalue_of(F.col("beta") / (s / F.sqrt("sxx")), F.col("n") - 2)})
    return out.select(
        "symbol", "n", "expected", (F.col("expected") - F.col("half")).alias("low"), (F.col("expected") + F.col("half")).alias("high"), "typical_abs_move", "beta", "r2", "p", "coverage", "coverage_n",
        ((F.col("p") < 0.05) & (F.col("r2") > 0.05)).alias("informative"), F.coalesce(F.abs(F.col("coverage") - confidence) <= 0.10, F.lit(False)).alias("calibrated"),
    )
