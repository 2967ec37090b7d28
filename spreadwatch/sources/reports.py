"""Reports from small result tables: Markdown of pairs, text of runs, an HTML page of the log."""

from __future__ import annotations

import html
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadwatch.operators.aggregates import scorecard
from spreadwatch.operators.alignment import asof_join
from spreadwatch.sources.config import Universe, dump_universe
from spreadwatch.sources.store import Store

MOST = 200


def _cell(x: object) -> str:
    return "-" if x is None else f"{x:.4g}" if isinstance(x, float) else str(x)


def markdown(df: DataFrame, columns: list[str], most: int = MOST) -> str:
    """The first rows of a small table as Markdown, and how many more there are."""
    rows = df.select(*columns).limit(most + 1).collect()
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    lines += [_row(r) for r in rows[:most]]
    return "\n".join(lines + ([f"and {df.count() - most} more"] if len(rows) > most else []))


PAIR_COLUMNS = ["pair_id", "n", "return_corr", "beta", "r2", "coint_p", "half_life", "current_z", "verdict"]


def _row(values: Iterable[object]) -> str:
    return "| " + " | ".join(_cell(v).replace("|", "\\|") for v in values) + " |"


def pair_details(row: dict[str, object]) -> str:
    """All there is to say of one profiled pair; why there is no more, where a measure is missing."""
    say = lambda c: _cell(row.get(c))
    lines = [f"\n### {say('pair_id')}: {say('a')} against {say('b')}\n"]
    lines += [f"- {label}: {row[c]}" for label, c in (("why", "mechanism"), ("breaks when", "breaks_when"), ("access", "access")) if row.get(c)]
    if row.get("n") is None:
        return "\n".join([*lines, f"- not profiled: {say('problem')}"])
    lines += [
        f"- {say('n')} days from {say('start')} to {say('end')}",
        f"- regression: beta {say('beta')}, r2 {say('r2')}; returns correlate {say('return_corr')}, now {say('corr_now')}, between {say('corr_min')} and {say('corr_max')} ({say('stability')})",
        f"- spread: sd {say('sd')} bps, now {say('current_z')} sd from its mean; half-life {say('half_life')} days",
        f"- tests: cointegration p {say('coint_p')}, unit root p {say('adf_p')}",
        f"- verdict: {say('verdict')}",
    ]
    return "\n".join(lines + ([f"- could not be tested: {say('problem')}"] if row.get("problem") else []))


def pairs_report(profiles: DataFrame, catalogue: DataFrame) -> str:
    """Every pair of the catalogue, grouped as it groups them: a table per group, then a block of details per pair.

    A pair that could not be profiled or tested is there with the reason. Rows come to the driver
    partition by partition, in order, however many groups there are.
    """
    problem = F.when(F.col("n").isNull(), "no prices for both legs").when(F.col("coint_p").isNull(), F.concat(F.lit("only "), F.col("n").cast("string"), F.lit(" rows, or prices that give no number")))
    met = catalogue.join(profiles, "pair_id", "left").withColumn("problem", problem).withColumn("verdict", F.coalesce("verdict", "problem"))
    parts, tables, details, group = ["# Pairs"], [], [], None

    def close() -> None:
        if tables:
            parts.extend([f"\n## {group}\n", _row(PAIR_COLUMNS), "|" + " --- |" * len(PAIR_COLUMNS), *tables, *details])

    for r in met.orderBy("grp", "pair_id").toLocalIterator():
        row = r.asDict()
        if row["grp"] != group:
            close()
            tables, details, group = [], [], row["grp"]
        tables.append(_row(row.get(c) for c in PAIR_COLUMNS))
        details.append(pair_details(row))
    close()
    return "\n".join(parts)


def screen_summary(row) -> str:
    """One line on what the screens took from a pair; the first three dates are shown."""
    if row.rows_in == row.rows_out:
        return f"{row.rows_in} rows, nothing removed"
    dates = [str(d) for d in row.dates[:3]]
    more = f" +{len(row.dates) - 3} more" if len(row.dates) > 3 else ""
    return f"{row.rows_in} rows, removed {row.rows_in - row.rows_out} ({(row.rows_in - row.rows_out) / row.rows_in:.2%}): {', '.join(dates)}{more}"


def backtest_report(summary: DataFrame) -> str:
    return markdown(summary.orderBy("pair_id"), ["pair_id", "baseline_n", "alerts", "hit_rate", "profit_rate", "mean_move", "mean_net", "edge", "verdict"])


def fit_report(admissions: DataFrame) -> str:
    """How many pairs were tested and admitted, the false-discovery threshold, and each pair with its reason, admitted ones first."""
    sums = admissions.agg(F.count(F.lit(1)).alias("n"), F.count("coint_p").alias("tested"), F.count(F.when(F.col("admitted"), 1)).alias("admitted"), F.min("coint_p").alias("least"), F.max("threshold").alias("threshold")).first()
    head = f"{sums.n} pairs, {sums.tested} tested, {sums.admitted} admitted; least p {_cell(sums.least)}, threshold {_cell(sums.threshold)}"
    return "\n".join([head, markdown(admissions.orderBy(F.desc("admitted"), "coint_p", "pair_id"), ["pair_id", "n", "beta", "coint_p", "half_life", "net_edge", "admitted", "reason"])])


def calibration_report(found: DataFrame) -> str:
    return markdown(found.orderBy("linkage_id", "param"), ["linkage_id", "param", "asserted", "estimated", "drift_pct", "samples", "sd_bps", "verdict"])


def event_report(found: DataFrame) -> str:
    return markdown(found.orderBy("symbol"), ["symbol", "n", "expected", "low", "high", "typical_abs_move", "r2", "p", "coverage", "informative", "calibrated"])


def universe_counts(universe: DataFrame) -> DataFrame:
    """(category, linkages, symbols) of a universe's frame."""
    legs = universe.select("category", "linkage_id", F.explode("legs").alias("leg", "source"))
    return legs.groupBy("category").agg(F.count_distinct("linkage_id").alias("linkages"), F.count_distinct("source.symbol").alias("symbols"))


def fitted_universe(admissions: DataFrame, linkages: Iterable, n_pairs: int) -> str:
    """The admitted pairs as a declaration file, with a note on how many were."""
    found = Universe(tuple(linkages))
    refused = admissions.where("not admitted").count()
    return dump_universe(found, f"{len(found.linkages)} of {n_pairs} admitted, {refused} refused")


def outcomes(store: Store, horizon_days: int = 3) -> DataFrame:
    """Every alert met with the first observation of its linkage ``horizon_days`` or more later."""
    alerts = store.alerts().drop("run", "batch")
    due = F.col("ts") + F.expr(f"make_interval(0, 0, 0, {int(horizon_days)})")
    met = asof_join(alerts, store.observations().select("linkage_id", "ts", "spread_bps"), "linkage_id", due, F.col("ts"), ["spread_bps"], "forward")
    move = F.abs("spread_bps") - F.abs("r_spread_bps")
    return met.withColumns({"resolved_at": F.col("r_ts"), "move": move, "net": move - F.col("friction_bps"), "predicted": F.col("predicted_reversion_bps")}).drop("r_ts", "r_spread_bps")


def dashboard(store: Store, universe: Universe, horizon_days: int = 3) -> str:
    """A self-contained HTML page: detectors, a scorecard over all alerts, the latest of them with outcomes, coverage. Values are escaped."""
    spark = store.spark
    declared = universe.frame(spark).select("linkage_id", "category", F.col("fingerprint").alias("now"))
    state = store.state().select("linkage_id", "fingerprint", "updated_at", "last_alert_at").join(declared, "linkage_id", "left")
    state = state.withColumn("status", F.when(F.col("now").isNull(), "not declared").when(F.col("now") != F.col("fingerprint"), "declaration changed").otherwise("current"))
    seen = store.observations().groupBy("linkage_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last")).orderBy(F.desc("last"))
    panels = [
        ("Detectors", state.orderBy("linkage_id"), ["linkage_id", "category", "status", "updated_at", "last_alert_at"]),
        ("Alerts", outcomes(store, horizon_days).orderBy(F.desc("ts")), ["linkage_id", "ts", "spread_bps", "predicted", "move", "net", "resolved_at"]),
        ("Coverage", seen, ["linkage_id", "n", "last"]),
    ]
    card = scorecard(outcomes(store, horizon_days).select("predicted", "move", "friction_bps"), F.col("friction_bps"))
    panels.insert(1, ("Scorecard", card, ["alerts", "resolved", "wins", "mean_net_bps", "mean_bias_bps", "too_few"]))
    body = []
    for title, df, columns in panels:
        head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
        shown = df.select(*columns).limit(MOST).collect()
        rows = "".join("<tr>" + "".join(f"<td>{html.escape(_cell(v))}</td>" for v in r) + "</tr>" for r in shown)
        more = f"<p>the first {MOST} of {df.count()}</p>" if len(shown) == MOST else ""
        body.append(f"<h2>{html.escape(title)}</h2><table><tr>{head}</tr>{rows}</table>{more}")
    return "<!doctype html><html><head><meta charset='utf-8'><title>Scan</title></head><body>" + "".join(body) + "</body></html>"
