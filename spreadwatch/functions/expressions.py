"""Column expressions of the domain: spreads, costs, gates, routing, verdicts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

BPS = 10_000.0
MIN_T = 2.86
MIN_FIT = 30


def log_spread_bps(a: Column, b: Column) -> Column:
    return (F.ln(a) - F.ln(b)) * BPS


def hedged_spread_bps(a: Column, b: Column, alpha: Column, beta: Column) -> Column:
    return (F.ln(a) - (alpha + beta * F.ln(b))) * BPS


def spread_bps(reference: Column, fair: Column) -> Column:
    """(reference - fair) / reference in basis points; null for a zero reference."""
    return F.try_divide(reference - fair, reference) * BPS


def total_friction(costs: Column) -> Column:
    """The sum of a map of costs."""
    return F.aggregate(F.map_values(costs), F.lit(0.0), lambda acc, x: acc + x)


def net_edge(spread: Column, z: Column, friction: Column) -> Column:
    """What a full reversion leaves after costs, only where there is a z-score."""
    return F.when(z.isNotNull(), F.abs(spread) - friction)


def alertable(stale: Column, z: Column, net: Column) -> Column:
    return ~stale & z.isNotNull() & net.isNotNull()


def age_seconds(ts: Column, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(ts)) / 1e6


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 86_400e6


def decay_fraction(theta: Column, periods: Column | float) -> Column:
    periods = periods if isinstance(periods, Column) else F.lit(float(periods))
    return F.when(theta <= 0, 0.0).otherwise(1.0 - F.exp(-theta * periods))


def reverts(theta: Column, t: Column) -> Column:
    """A positive speed whose t-statistic a random walk would rarely reach."""
    return (theta > 0) & (F.abs(t) >= MIN_T)


def horizon_gate(deviation: Column, theta: Column, t: Column, half_life: Column, periods: float, friction: Column, min_edge: Column) -> Column:
    """struct(passed, expected_bps, net_bps, reason): does enough come back in time to pay for itself?"""
    ok = F.coalesce(reverts(theta, t), F.lit(False))
    expected = F.when(ok, F.abs(deviation) * decay_fraction(theta, periods)).otherwise(0.0)
    net = expected - friction
    passed = ok & (net >= min_edge)
    said = F.format_string(
        "%.1fbps expected back within %s periods, %+.1fbps after %.1fbps friction (half-life %.1f)",
        expected, F.lit(f"{periods:g}"), net, friction, F.coalesce(half_life, F.lit(0.0)),
    )
    reason = F.when(~ok, "no mean reversion that can be told from a random walk").when(passed, said).otherwise(F.concat(F.lit("too little: "), said))
    return F.struct(passed.alias("passed"), expected.alias("expected_bps"), net.alias("net_bps"), reason.alias("reason"))


def trades_to_detect(edge: Column, sigma: Column, horizon: float) -> Column:
    """Trades until the mean edge is two standard errors from zero; infinite without an edge."""
    return F.when(edge > 0, F.pow(2 * sigma * F.sqrt(F.lit(float(horizon))) / edge, F.lit(2.0))).otherwise(F.lit(float("inf")))


def tail_probability(percentile: Column) -> Column:
    """Two-sided share of history at least as far out as this percentile."""
    return 2.0 * F.least(percentile, 100.0 - percentile) / 100.0


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def beta_drift(beta: Column) -> Column:
    return F.abs(beta - 1.0)


#: The index that stands for the market of a symbol's suffix.
BENCHMARKS = {".NS": "^NSEI", ".BO": "^BSESN", ".L": "^FTSE", ".DE": "^GDAXI"}
DEFAULT_BENCHMARK = "^GSPC"
#: Round-trip cost in basis points by group of pairs.
GROUP_FRICTION: Mapping[str, float] = {
    "india_sector": 26.95,
    "india_supply": 26.95,
    "india_group": 26.95,
    "india_index": 26.95,
    "equity_us": 10.0,
    "fx": 4.0,
    "intermarket": 12.0,
}
DEFAULT_FRICTION = 25.0


def benchmark_for(symbol: Column) -> Column:
    out = F.lit(DEFAULT_BENCHMARK)
    for suffix, index in BENCHMARKS.items():
        out = F.when(symbol.endswith(suffix), index).otherwise(out)
    return out


def could_report(symbol: Column) -> Column:
    """Companies report results; currencies, futures and indices do not."""
    return ~symbol.endswith("=X") & ~symbol.endswith("=F") & ~symbol.startswith("^")


def access_category(access: Column) -> Column:
    return F.when(access == "full", "tradeable").otherwise("observational")


def group_friction(group: Column, table: Mapping[str, float] = GROUP_FRICTION) -> Column:
    out = F.lit(DEFAULT_FRICTION)
    for name, bps in table.items():
        out = F.when(group == name, bps).otherwise(out)
    return out


def calibration_verdict(drift_pct: Column) -> Column:
    size = F.abs(drift_pct)
    return F.when(size < 0.5, "agrees").when(size < 3.0, "drifted").otherwise("wrong")


def stability(swing: Column) -> Column:
    return F.when(swing < 0.4, "stable").when(swing < 0.8, "variable").otherwise("unstable")


def profile_verdict(n: Column, p: Column, half_life: Column, swing: Column) -> Column:
    return (
        F.when(n < 250, "insufficient history")
        .when(p >= 0.05, "not cointegrated")
        .when(half_life.isNull() | (half_life > 5), "cointegrated, slow")
        .when(stability(swing) == "unstable", "cointegrated, unstable")
        .otherwise("cointegrated, reverts in time")
    )


def backtest_verdict(n_alerts: Column, edge: Column, net: Column) -> Column:
    return (
        F.when(n_alerts == 0, "no alerts")
        .when(edge <= 0, "no better than any other day")
        .when(net <= 0, "an edge, but not after costs")
        .otherwise("an edge after costs")
    )
