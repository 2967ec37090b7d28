"""Queries of sources, expressions, joins and sets."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from spreadwatch.functions import expressions as E
from spreadwatch.functions.exact import with_exact
from spreadwatch.functions.formula import compile_formula
from spreadwatch.operators import windows as W
from spreadwatch.operators.alignment import asof_join, complete_legs, event_windows, within
from spreadwatch.plans.frames import BARS_SQL, BENCHMARKS, EVENTS_SQL, FRAME_SQL, LAGGED_SQL, SERIES_SQL, TICKS_SQL, announced, announcements, bars, frame, r6, series, ticks
from spreadwatch.plans.registry import query, table
from spreadwatch.plans.windows import OU_SQL, ou_parts
from spreadwatch.sources.config import AlertRule, Linkage, Universe, fingerprint_of
from spreadwatch.sources.market import TableSource, event_calendar, last_bars, latest_quotes, ohlc, without_empty_rows
from spreadwatch.sources.provider import ParquetFeed, register_feed
from spreadwatch.sources.reports import universe_counts
from spreadwatch.streaming.scan import books, history_quotes, observations, scan_line

UNIVERSE = Universe((
    Linkage("ratio", "A against N", "validation", {"a": ("A", "table"), "b": ("N", "table")}, "b * k", "a", {"k": 1.0}, {"fees": 20.0, "tax": 6.95}),
    Linkage("cross", "A against N and R", "tradeable", {"a": ("A", "table"), "b": ("N", "table"), "c": ("R", "table")}, "b * c / unit", "a", {"unit": 1500.0}, {"fees": 25.0}),
    Linkage("power", "N against R", "observational", {"a": ("N", "table"), "b": ("R", "other")}, "k * b ** beta", "a", {"k": 1.25, "beta": 0.97}, {}, AlertRule(2.0, 3.0, 5.0, 60)),
))
LINKS_SQL = """links(linkage_id, category, friction, n_legs) AS (VALUES ('ratio', 'validation', 26.95, 2), ('cross', 'tradeable', 25.0, 3), ('power', 'observational', 0.0, 2)),
legs(linkage_id, leg, symbol, provider, n_legs) AS (VALUES ('ratio', 'a', 'A', 'table', 2), ('ratio', 'b', 'N', 'table', 2), ('cross', 'a', 'A', 'table', 3), ('cross', 'b', 'N', 'table', 3), ('cross', 'c', 'R', 'table', 3), ('power', 'a', 'N', 'table', 2), ('power', 'b', 'R', 'other', 2))"""
LEGS_SQL = BARS_SQL + ", " + LINKS_SQL + """, whole AS (
  SELECT linkage_id, d, max(CASE WHEN leg = 'a' THEN close END) AS a, max(CASE WHEN leg = 'b' THEN close END) AS b, max(CASE WHEN leg = 'c' THEN close END) AS c
  FROM legs JOIN bars USING (symbol) GROUP BY linkage_id, d HAVING count(*) = max(n_legs)),
fair AS (SELECT *, CASE linkage_id WHEN 'ratio' THEN b * 1.0::DOUBLE WHEN 'cross' THEN b * c / 1500.0::DOUBLE ELSE 1.25::DOUBLE * pow(b, 0.97::DOUBLE) END AS fair FROM whole)"""


# ---- sources

@query("src_bars_daily", f"WITH {BARS_SQL} SELECT * FROM bars")
def src_bars_daily(spark, sf_dir):
    return bars(spark, sf_dir)


@query("src_last_n_bars", f"WITH {BARS_SQL} SELECT symbol, d, close FROM bars WHERE close IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY d DESC) <= 60")
def src_last_n_bars(spark, sf_dir):
    return last_bars(bars(spark, sf_dir), 60)


@query("src_latest_quote", f"WITH {TICKS_SQL} SELECT symbol, arg_max(price, (ts, seq)) AS price, max(ts) AS ts FROM ticks WHERE price IS NOT NULL GROUP BY symbol")
def src_latest_quote(spark, sf_dir):
    return latest_quotes(ticks(spark, sf_dir)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    "src_bars_hourly",
    f"""WITH {TICKS_SQL} SELECT symbol, date_trunc('hour', ts) AS ts, arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, seq)) AS close, count(*) AS volume
FROM ticks GROUP BY symbol, date_trunc('hour', ts)""",
)
def src_bars_hourly(spark, sf_dir):
    return ohlc(ticks(spark, sf_dir), "1h").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


#: Every customer as a declared linkage of an instrument of its nation against one of its segment.
DECLARED_SQL = """declared AS (SELECT c_custkey AS linkage_id, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'tradeable' ELSE 'observational' END AS category,
  'N' || c_nationkey AS symbol_a, 'feed' || c_nationkey % 3 AS provider_a, 'S' || c_custkey % 40 || c_mktsegment AS symbol_b, lower(c_mktsegment) AS provider_b, c_nationkey + 0.5 AS k, abs(c_acctbal) / 100 AS fees, c_nationkey * 0.25 AS tax FROM customer)"""


def declared(spark, sf_dir):
    """(linkage_id, category, legs, fair_value, params, reference, friction, kalman_delta) of every customer."""
    c, nation = table(spark, sf_dir, "customer"), F.col("c_nationkey")
    leg = lambda symbol, provider: F.struct(symbol.alias("symbol"), provider.alias("provider"))
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    a = leg(text("N", nation.cast("string")), text("feed", (nation % 3).cast("string")))
    b = leg(text("S", (F.col("c_custkey") % 40).cast("string"), F.col("c_mktsegment")), F.lower("c_mktsegment"))
    return c.select(
        F.col("c_custkey").alias("linkage_id"), F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "tradeable").otherwise("observational").alias("category"),
        F.create_map(F.lit("b"), b, F.lit("a"), a).alias("legs"), F.lit("b * k").alias("fair_value"), F.create_map(F.lit("k"), (nation + 0.5).cast("double")).alias("params"), F.lit("a").alias("reference"),
        F.create_map(F.lit("fees"), F.abs("c_acctbal") / 100, F.lit("tax"), nation * F.lit(0.25)).alias("friction"), F.lit(None).cast("double").alias("kalman_delta"),
    )


@query("src_symbols_per_provider", f"WITH {DECLARED_SQL} SELECT provider_a AS provider, symbol_a AS symbol FROM declared UNION SELECT provider_b, symbol_b FROM declared")
def src_symbols_per_provider(spark, sf_dir):
    legs = declared(spark, sf_dir).select(F.explode("legs").alias("leg", "source"))
    return legs.select("source.provider", "source.symbol").distinct()


@query(
    "src_quote_lookup",
    f"WITH {TICKS_SQL}, q AS (SELECT symbol, arg_max(price, (ts, seq)) AS price FROM ticks WHERE price IS NOT NULL GROUP BY symbol), wanted(symbol) AS (VALUES ('view'), ('click'), ('absent')) SELECT symbol, price, price IS NULL AS missing FROM wanted LEFT JOIN q USING (symbol)",
)
def src_quote_lookup(spark, sf_dir):
    wanted = spark.createDataFrame([("view",), ("click",), ("absent",)], "symbol string")
    return wanted.join(latest_quotes(ticks(spark, sf_dir)).drop("ts"), "symbol", "left").withColumn("missing", F.col("price").isNull())


@query(
    "src_source_bars",
    f"""WITH {TICKS_SQL}, b AS (SELECT symbol, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, seq)) AS close, count(*) AS volume
  FROM ticks WHERE symbol IN ('view', 'click', 'absent') GROUP BY 1, 2)
SELECT * FROM b WHERE open IS NOT NULL AND close IS NOT NULL AND high IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 40""",
)
def src_source_bars(spark, sf_dir):
    found = TableSource(ticks(spark, sf_dir)).bars(["view", "click", "absent"], "15m", 40)
    return found.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


# ---- expressions over linkages

def fair_values(spark, sf_dir):
    """(linkage_id, d, prices, reference_price, fair_value, friction) for complete dates."""
    met = complete_legs(bars(spark, sf_dir), UNIVERSE.legs_frame(spark))
    fair = ref = friction = F.lit(None).cast("double")
    for x in UNIVERSE.linkages:
        own = F.col("linkage_id") == x.id
        legs = {n: F.col("prices")[n] for n in x.legs}
        fair = F.when(own, compile_formula(x.fair_value, legs, x.params)).otherwise(fair)
        ref = F.when(own, legs[x.reference]).otherwise(ref)
        friction = F.when(own, F.lit(x.total_friction)).otherwise(friction)
    return met.withColumns({"reference_price": ref, "fair_value": fair, "friction": friction})


@query("exp_fair_value_formula", f"WITH {LEGS_SQL} SELECT linkage_id, d, a AS reference_price, round(fair, 6) AS fair_value FROM fair")
def exp_fair_value_formula(spark, sf_dir):
    return fair_values(spark, sf_dir).select("linkage_id", "d", "reference_price", *r6("fair_value"))


@query(
    "exp_formula_exact",
    """WITH l AS (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(12,2)) AS p, CAST(l_discount AS DECIMAL(4,2)) AS d, CAST(l_tax AS DECIMAL(4,2)) AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, round(CAST(p * (1 - d) * (1 + t) AS DOUBLE), 6) AS charge,
       round(CAST(p * (1 - d) * (1 + t) - p - p * t + p * d + p * d * t AS DOUBLE), 12) AS residue FROM l""",
)
def exp_formula_exact(spark, sf_dir):
    """Charges in decimal arithmetic, and terms that cancel: doubles leave a residue, decimals none."""
    names = {"p": "l_extendedprice", "d": "l_discount", "t": "l_tax"}
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *names.values())
    charged = with_exact(with_exact(rows, "charge", "p * (1 - d) * (1 + t)", names), "residue", "p * (1 - d) * (1 + t) - p - p * t + p * d + p * d * t", names)
    return charged.select("l_orderkey", "l_linenumber", *r6("charge"), (F.round("residue", 12) + 0.0).alias("residue"))


@query(
    "exp_spread_net_edge",
    f"""WITH {LEGS_SQL}, s AS (SELECT linkage_id, d, a - fair AS spread, (a - fair) / nullif(a, 0) * 10000 AS bps, friction FROM fair JOIN links USING (linkage_id))
SELECT linkage_id, d, round(spread, 6) AS spread, round(bps, 6) AS spread_bps, round(abs(bps) - friction, 6) AS net_edge_bps FROM s""",
)
def exp_spread_net_edge(spark, sf_dir):
    bps = E.spread_bps(F.col("reference_price"), F.col("fair_value"))
    return fair_values(spark, sf_dir).select(
        "linkage_id", "d", F.round(F.col("reference_price") - F.col("fair_value"), 6).alias("spread"), F.round(bps, 6).alias("spread_bps"),
        F.round(E.net_edge(bps, F.lit(0.0), F.col("friction")), 6).alias("net_edge_bps"),
    )


@query("exp_log_spread", f"WITH {FRAME_SQL} SELECT pair_id, d, round((ln(pa) - ln(pb)) * 10000, 6) AS spread_bps FROM frame")
def exp_log_spread(spark, sf_dir):
    return frame(spark, sf_dir).select("pair_id", "d", F.round(E.log_spread_bps(F.col("pa"), F.col("pb")), 6).alias("spread_bps"))


@query("exp_total_friction", f"WITH {DECLARED_SQL} SELECT linkage_id, category, round(fees + tax, 6) AS friction FROM declared")
def exp_total_friction(spark, sf_dir):
    return declared(spark, sf_dir).select("linkage_id", "category", F.round(E.total_friction(F.col("friction")), 6).alias("friction"))


@query(
    "exp_finite_filter",
    f"""WITH {TICKS_SQL}, x AS (SELECT symbol, CASE symbol WHEN 'view' THEN 'NaN'::DOUBLE WHEN 'click' THEN '-Infinity'::DOUBLE ELSE CAST(price AS DOUBLE) END AS x FROM ticks)
SELECT symbol, count(*) AS n, count(*) FILTER (x IS NOT NULL AND isfinite(x)) AS kept, round(max(x) FILTER (isfinite(x)), 6) AS highest FROM x GROUP BY symbol""",
)
def exp_finite_filter(spark, sf_dir):
    """Prices of which two kinds of event give no number: what the filter leaves of each."""
    x = F.when(F.col("symbol") == "view", float("nan")).when(F.col("symbol") == "click", float("-inf")).otherwise(F.col("price").cast("double"))
    good = F.when(E.finite(x), x)
    return ticks(spark, sf_dir).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count(good).alias("kept"), F.round(F.max(good), 6).alias("highest"))


STALE_SQL = TICKS_SQL + """, snap AS (SELECT user_id % 50 AS book, event_type AS leg, max(ts) AS ts FROM events GROUP BY 1, 2),
age AS (SELECT book, leg, CAST(epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts) AS DOUBLE) / 1000000 AS age FROM snap),
stale AS (SELECT book, max(age) > 3600 AS stale, min(CASE WHEN age > 3600 THEN leg END) AS first_stale_leg, round(max(age), 6) AS oldest FROM age GROUP BY book)"""


def stale_books(spark, sf_dir):
    """Books of quotes per event type; a book is stale when any leg is older than an hour at a fixed time."""
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    snap = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 50).alias("book"), F.col("event_type").alias("leg")).agg(F.max("ts").cast("timestamp").alias("ts"))
    age = snap.withColumn("age", E.age_seconds(F.col("ts"), now))
    return age.groupBy("book").agg((F.max("age") > 3600).alias("stale"), F.min(F.when(F.col("age") > 3600, F.col("leg"))).alias("first_stale_leg"), F.round(F.max("age"), 6).alias("oldest"))


@query("exp_stale_flag", f"WITH {STALE_SQL} SELECT * FROM stale")
def exp_stale_flag(spark, sf_dir):
    return stale_books(spark, sf_dir)


@query(
    "exp_alertable",
    f"""WITH {SERIES_SQL}, z AS (SELECT pair_id, d, i, v, CASE WHEN count(v) OVER w >= 30 THEN (v - avg(v) OVER w) / nullif(stddev_samp(v) OVER w, 0) END AS z FROM series WINDOW w AS (PARTITION BY pair_id ORDER BY i ROWS BETWEEN 720 PRECEDING AND 1 PRECEDING))
SELECT pair_id, d, i % 7 = 0 AS stale, i % 7 <> 0 AND z IS NOT NULL AS alertable FROM z""",
)
def exp_alertable(spark, sf_dir):
    z = series(spark, sf_dir).withColumn("z", W.rolling_z("v", W.past("pair_id", "i", W.Z_WINDOW)))
    stale = F.col("i") % 7 == 0
    return z.select("pair_id", "d", stale.alias("stale"), E.alertable(stale, F.col("z"), E.net_edge(F.col("v"), F.col("z"), F.lit(25.0))).alias("alertable"))


ROUTED_SQL = """s AS (SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'C' || c_custkey || '.NS' WHEN 1 THEN 'C' || c_custkey || '.BO' WHEN 2 THEN 'C' || c_custkey || '.L' WHEN 3 THEN 'C' || c_custkey || '.DE'
  WHEN 4 THEN 'C' || c_custkey || '=X' WHEN 5 THEN 'C' || c_custkey || '=F' WHEN 6 THEN '^C' || c_custkey ELSE 'C' || c_custkey END AS symbol FROM customer)"""


@query(
    "exp_symbol_routing",
    f"""WITH {ROUTED_SQL} SELECT symbol, CASE WHEN symbol LIKE '%.NS' THEN '^NSEI' WHEN symbol LIKE '%.BO' THEN '^BSESN' WHEN symbol LIKE '%.L' THEN '^FTSE' WHEN symbol LIKE '%.DE' THEN '^GDAXI' ELSE '^GSPC' END AS benchmark,
  NOT (symbol LIKE '%=X' OR symbol LIKE '%=F' OR symbol LIKE '^%') AS could_report FROM s""",
)
def exp_symbol_routing(spark, sf_dir):
    """Every customer's name as a symbol of one of eight kinds."""
    key, kind = F.col("c_custkey").cast("string"), F.col("c_custkey") % 8
    ending = F.element_at(F.array(*map(F.lit, [".NS", ".BO", ".L", ".DE", "=X", "=F", "", ""])), (kind + 1).cast("int"))
    s = table(spark, sf_dir, "customer").select(F.concat(F.when(kind == 6, "^C").otherwise("C"), key, ending).alias("symbol"))
    return s.select("symbol", E.benchmark_for(F.col("symbol")).alias("benchmark"), E.could_report(F.col("symbol")).alias("could_report"))


@query(
    "exp_group_routing",
    """WITH g AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'fx' WHEN '2-HIGH' THEN 'equity_us' WHEN '3-MEDIUM' THEN 'india_index' WHEN '5-LOW' THEN 'intermarket' ELSE 'other' END AS grp, CASE o_orderstatus WHEN 'F' THEN 'full' WHEN 'O' THEN 'long_only' ELSE 'none' END AS access FROM orders)
SELECT o_orderkey AS pair_id, grp, CASE grp WHEN 'fx' THEN 4.0::DOUBLE WHEN 'equity_us' THEN 10.0 WHEN 'india_index' THEN 26.95 WHEN 'intermarket' THEN 12.0 ELSE 25.0 END AS friction, CASE WHEN access = 'full' THEN 'tradeable' ELSE 'observational' END AS category FROM g""",
)
def exp_group_routing(spark, sf_dir):
    """Every order as a pair whose priority names its group and whose status its access."""
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    grp = F.when(p == "1-URGENT", "fx").when(p == "2-HIGH", "equity_us").when(p == "3-MEDIUM", "india_index").when(p == "5-LOW", "intermarket").otherwise("other")
    access = F.when(s == "F", "full").when(s == "O", "long_only").otherwise("none")
    g = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pair_id"), grp.alias("grp"), access.alias("access"))
    return g.select("pair_id", "grp", E.group_friction(F.col("grp")).alias("friction"), E.access_category(F.col("access")).alias("category"))


FITS_SQL = f"""WITH {LAGGED_SQL}, p AS (SELECT pair_id, d, i, v, {ou_parts("OVER w")} FROM lagged WINDOW w AS (PARTITION BY pair_id ORDER BY i ROWS BETWEEN 249 PRECEDING AND 1 PRECEDING)),
f AS (SELECT pair_id, d, v, {OU_SQL} FROM p WHERE i > 250),
g AS (SELECT *, theta > 0 AND abs(t) >= 2.86 AS ok, abs(v - mu) * CASE WHEN theta <= 0 THEN 0 ELSE 1 - exp(-theta * 3) END AS e FROM f)"""


def fits(spark, sf_dir):
    lagged = W.with_lag(series(spark, sf_dir), "pair_id", "i", "v")
    return W.with_ou(lagged, "pair_id", "i", W.FIT_WINDOW - 1).withColumnRenamed("fit", "f").where(F.col("i") > W.FIT_WINDOW)


@query(
    "exp_horizon_gate",
    FITS_SQL + " SELECT pair_id, d, round(CASE WHEN ok THEN e ELSE 0 END, 6) AS expected_bps, round(CASE WHEN ok THEN e ELSE 0 END - 26.95, 6) AS net_bps, ok AND e - 26.95 >= 0 AS passed FROM g",
)
def exp_horizon_gate(spark, sf_dir):
    f = F.col("f")
    gate = E.horizon_gate(F.col("v") - f["mu"], f["theta"], f["t"], f["half_life"], 3, F.lit(26.95), F.lit(0.0))
    return fits(spark, sf_dir).withColumn("g", gate).select("pair_id", "d", F.round("g.expected_bps", 6).alias("expected_bps"), F.round("g.net_bps", 6).alias("net_bps"), "g.passed")


@query(
    "exp_trades_to_detect",
    FITS_SQL + " SELECT pair_id, d, CASE WHEN e - 26.95 > 0 THEN round(pow(2 * sigma * sqrt(3.0::DOUBLE) / (e - 26.95), 2), 4) END AS trades FROM g WHERE e > 100",
)
def exp_trades_to_detect(spark, sf_dir):
    f = F.col("f")
    e = F.abs(F.col("v") - f["mu"]) * E.decay_fraction(f["theta"], 3)
    trades = E.trades_to_detect(F.col("e") - 26.95, f["sigma"], 3)
    return fits(spark, sf_dir).withColumn("e", e).where("e > 100").select("pair_id", "d", F.when(trades < float("inf"), F.round(trades, 4)).alias("trades"))


@query(
    "exp_tail_probability",
    f"""WITH {SERIES_SQL}, r AS (SELECT pair_id, d, percent_rank() OVER (PARTITION BY pair_id ORDER BY v) * 100 AS p FROM series)
SELECT pair_id, d, round(2.0::DOUBLE * least(p, 100 - p) / 100, 6) AS tail FROM r""",
)
def exp_tail_probability(spark, sf_dir):
    p = F.percent_rank().over(Window.partitionBy("pair_id").orderBy("v")) * 100
    return series(spark, sf_dir).withColumn("p", p).select("pair_id", "d", F.round(E.tail_probability(F.col("p")), 6).alias("tail"))


FINGERPRINT_SQL = DECLARED_SQL + """, j AS (SELECT linkage_id, '{"fair_value":"b * k","kalman_delta":null,"legs":{"a":{"provider":"' || provider_a || '","symbol":"' || symbol_a || '"},"b":{"provider":"' || provider_b || '","symbol":"' || symbol_b
  || '"}},"params":{"k":' || CAST(CAST(k AS DOUBLE) AS VARCHAR) || '},"reference":"a"}' AS meaning FROM declared)"""


@query("exp_state_fingerprint", f"WITH {FINGERPRINT_SQL} SELECT linkage_id, substr(sha256(meaning), 1, 16) AS fingerprint FROM j")
def exp_state_fingerprint(spark, sf_dir):
    print_ = fingerprint_of(*[F.col(c) for c in ("fair_value", "legs", "params", "reference", "kalman_delta")])
    return declared(spark, sf_dir).select("linkage_id", print_.alias("fingerprint"))


# ---- a provider as a data source

PROVIDER_SQL = TICKS_SQL + """, s AS (SELECT symbol, date_trunc('hour', ts) AS ts, arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, seq)) AS close, count(*) AS volume
  FROM ticks WHERE symbol IN ('view', 'click', 'purchase') AND ts >= TIMESTAMP '2024-01-03 00:00:00' AND ts < TIMESTAMP '2024-01-20 12:00:00' GROUP BY 1, 2)"""


@query("src_provider_bars", f"WITH {PROVIDER_SQL} SELECT * FROM s")
def src_provider_bars(spark, sf_dir):
    """Hourly bars of some symbols and days from a registered provider; symbols and times are pushed to it."""
    name = register_feed(spark, "events_feed", ParquetFeed(f"{sf_dir}/events.parquet", ("event_type", "ts", "event_id", "value")))
    ticks_ = spark.read.format(name).load().where(F.col("symbol").isin("view", "click", "purchase") & (F.col("ts") >= "2024-01-03 00:00:00") & (F.col("ts") < "2024-01-20 12:00:00"))
    return ohlc(ticks_, "1h").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


# ---- joins and sets

@query("jn_leg_alignment", f"WITH {FRAME_SQL} SELECT pair_id, d, pa, pb FROM frame")
def jn_leg_alignment(spark, sf_dir):
    return frame(spark, sf_dir)


@query("jn_three_leg_complete", f"WITH {LEGS_SQL} SELECT d, a, b, c FROM whole WHERE linkage_id = 'cross'")
def jn_three_leg_complete(spark, sf_dir):
    met = complete_legs(bars(spark, sf_dir), UNIVERSE.legs_frame(spark)).where("linkage_id = 'cross'")
    return met.select("d", *[F.col("prices")[c].alias(c) for c in "abc"])


@query("jn_date_intersection", f"WITH {BARS_SQL} SELECT d FROM bars WHERE symbol = 'A' INTERSECT SELECT d FROM bars WHERE symbol = 'N' INTERSECT SELECT d FROM bars WHERE symbol = 'R'")
def jn_date_intersection(spark, sf_dir):
    found = bars(spark, sf_dir).groupBy("d").agg(F.count_distinct("symbol").alias("n"))
    return found.where("n = 3").select("d")


WINDOWS_SQL = BARS_SQL + ", " + EVENTS_SQL + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d) AS k FROM bars),
entry AS (SELECT c.*, r.k FROM calendar c ASOF JOIN ranked r ON r.symbol = c.symbol AND r.d < c.day),
win AS (SELECT e.event_id, e.symbol, e.day, e.surprise_pct, r0.d AS entry_d, r0.close AS p0, r1.d AS exit_d, r1.close AS p1
  FROM entry e JOIN ranked r0 ON r0.symbol = e.symbol AND r0.k = e.k JOIN ranked r1 ON r1.symbol = e.symbol AND r1.k = e.k + 3 JOIN ranked r2 ON r2.symbol = e.symbol AND r2.k = e.k + 4)"""
MOVES_SQL = WINDOWS_SQL + """, bm(symbol, other) AS (VALUES ('A', 'N'), ('N', 'R'), ('R', 'A')), moves AS (SELECT event_id, win.symbol, day, surprise_pct, (p1 / p0 - 1) * 100 AS raw, (b1.close / b0.close - 1) * 100 AS bench
  FROM win JOIN bm ON bm.symbol = win.symbol JOIN bars b0 ON b0.symbol = other AND b0.d = entry_d JOIN bars b1 ON b1.symbol = other AND b1.d = exit_d WHERE p0 > 0 AND b0.close > 0)"""


def event_moves(spark, sf_dir):
    """(event_id, symbol, day, surprise_pct, raw, bench): moves of the announcing symbols and of their benchmarks around events."""
    prices = bars(spark, sf_dir)
    known = prices.join(F.broadcast(spark.createDataFrame(BENCHMARKS, "of string, symbol string")), "symbol")  # a row a declared symbol
    win = event_windows(announcements(spark, sf_dir), prices, 3).where("p0 > 0")
    at = lambda d, p: known.select(F.col("of").alias("symbol"), F.col("d").alias(d), F.col("close").alias(p))
    met = win.join(at("entry_d", "b0"), ["symbol", "entry_d"]).join(at("exit_d", "b1"), ["symbol", "exit_d"]).where("b0 > 0")
    return met.select("event_id", "symbol", "day", "surprise_pct", ((F.col("p1") / F.col("p0") - 1) * 100).alias("raw"), ((F.col("b1") / F.col("b0") - 1) * 100).alias("bench"))


@query("jn_event_entry_exit", f"WITH {WINDOWS_SQL} SELECT event_id, symbol, day, entry_d, p0, exit_d, p1 FROM win")
def jn_event_entry_exit(spark, sf_dir):
    win = event_windows(announcements(spark, sf_dir), bars(spark, sf_dir), 3)
    return win.select("event_id", "symbol", "day", "entry_d", "p0", "exit_d", "p1")


@query("jn_abnormal_move", f"WITH {MOVES_SQL} SELECT event_id, symbol, day, round(surprise_pct, 6) AS surprise_pct, round(raw - bench, 6) AS abnormal_move_pct FROM moves")
def jn_abnormal_move(spark, sf_dir):
    found = event_moves(spark, sf_dir)
    return found.select("event_id", "symbol", "day", *r6("surprise_pct"), F.round(F.col("raw") - F.col("bench"), 6).alias("abnormal_move_pct"))


ALERTS_SQL = SERIES_SQL + """, alerts AS (SELECT pair_id, d, v, abs(v) * 0.5 AS predicted FROM series WHERE abs(v) > 6000),
outcomes AS (SELECT a.pair_id, a.d, a.v, a.predicted, s.d AS resolved_d, abs(a.v) - abs(s.v) AS move FROM alerts a ASOF LEFT JOIN series s ON a.pair_id = s.pair_id AND s.d >= a.d + 3)"""


def outcomes(spark, sf_dir):
    """Alerts (days with a large spread) met with the first observation three days or more later."""
    s = series(spark, sf_dir)
    alerts = s.where(F.abs("v") > 6000).select("pair_id", "d", "v", (F.abs("v") * 0.5).alias("predicted"))
    met = asof_join(alerts, s, "pair_id", F.date_add("d", 3), F.col("d"), ["v"], "forward")
    return met.select("pair_id", "d", "v", "predicted", F.col("r_ts").alias("resolved_d"), (F.abs("v") - F.abs("r_v")).alias("move"))


@query("jn_alert_outcome_asof", f"WITH {ALERTS_SQL} SELECT pair_id, d, resolved_d, round(move, 6) AS move_bps, move > 0 AS reverted, round(move - 26.95, 6) AS net_bps FROM outcomes")
def jn_alert_outcome_asof(spark, sf_dir):
    return outcomes(spark, sf_dir).select("pair_id", "d", "resolved_d", F.round("move", 6).alias("move_bps"), (F.col("move") > 0).alias("reverted"), F.round(F.col("move") - 26.95, 6).alias("net_bps"))


@query(
    "jn_event_suppression",
    f"""WITH {LINKS_SQL}, cal AS (SELECT o_orderstatus AS s, o_orderdate AS ts FROM orders), c AS (SELECT CASE s WHEN 'F' THEN 'A' WHEN 'O' THEN 'N' ELSE 'R' END AS symbol, CAST(epoch_us(ts) - epoch_us(TIMESTAMP '1997-06-01') AS DOUBLE) / 86400000000 AS away, ts FROM cal),
n AS (SELECT symbol, arg_min(ts, away) AS event_ts, min(away) AS away FROM c WHERE away >= 0 AND away <= 3 GROUP BY symbol)
SELECT linkage_id, leg, legs.symbol, event_ts, round(away, 6) AS days_away, bool_or(away IS NOT NULL) OVER (PARTITION BY linkage_id) AS suppressed FROM legs LEFT JOIN n ON n.symbol = legs.symbol""",
)
def jn_event_suppression(spark, sf_dir):
    cal = table(spark, sf_dir, "orders").select(announced(F.col("o_orderstatus")).alias("symbol"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    met = within(UNIVERSE.legs_frame(spark), cal, "symbol", F.lit("1997-06-01").cast("timestamp"), "ts", 3.0)
    blocked = F.bool_or(F.col("days_away").isNotNull()).over(Window.partitionBy("linkage_id"))
    return met.select("linkage_id", "leg", "symbol", F.col("event_ts").cast("timestamp_ntz").alias("event_ts"), F.round("days_away", 6).alias("days_away"), blocked.alias("suppressed"))


WANTED = [("p1", "A", "N"), ("p2", "A", "X"), ("p3", "Y", "X"), ("p4", "N", "R")]


@query(
    "jn_missing_leg_anti",
    f"""WITH {BARS_SQL}, w(pair_id, a, b) AS (VALUES ('p1', 'A', 'N'), ('p2', 'A', 'X'), ('p3', 'Y', 'X'), ('p4', 'N', 'R')), l AS (SELECT pair_id, a AS symbol FROM w UNION ALL SELECT pair_id, b FROM w)
SELECT pair_id, 'no prices for ' || string_agg(symbol, ', ' ORDER BY symbol) AS reason FROM l WHERE symbol NOT IN (SELECT symbol FROM bars) GROUP BY pair_id""",
)
def jn_missing_leg_anti(spark, sf_dir):
    w = spark.createDataFrame(WANTED, "pair_id string, a string, b string")
    legs = w.select("pair_id", F.explode(F.array("a", "b")).alias("symbol"))
    gone = legs.join(bars(spark, sf_dir).select("symbol").distinct(), "symbol", "left_anti")
    return gone.groupBy("pair_id").agg(F.concat(F.lit("no prices for "), F.array_join(F.array_sort(F.collect_list("symbol")), ", ")).alias("reason"))


RESUME_SQL = """CASE WHEN saved IS NULL THEN 'no saved state' WHEN saved <> fingerprint THEN 'declaration changed' WHEN version <> 2 THEN 'other version' WHEN seen IS NULL THEN 'unreadable' ELSE 'restored' END"""


@query(
    "jn_state_left",
    f"""WITH l AS (SELECT c_custkey AS linkage_id, 'f' || (c_custkey % 3) AS fingerprint FROM customer),
s AS (SELECT o_custkey AS linkage_id, 'f' || (o_orderkey % 3) AS saved, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 2 END AS version, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 240 END AS seen
  FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
SELECT linkage_id, {RESUME_SQL} AS outcome, coalesce({RESUME_SQL} = 'restored' AND seen >= 120, false) AS ready FROM l LEFT JOIN s USING (linkage_id)""",
)
def jn_state_left(spark, sf_dir):
    """Every customer as a declared linkage, every order as a saved state: the newest of each decides."""
    from spreadwatch.sources.store import READY, resume_outcome

    declared = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("linkage_id"), F.concat(F.lit("f"), F.col("c_custkey") % 3).alias("fingerprint"))
    newest = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    saved = table(spark, sf_dir, "orders").withColumn("_n", F.row_number().over(newest)).where("_n = 1").select(
        F.col("o_custkey").alias("linkage_id"), F.concat(F.lit("f"), F.col("o_orderkey") % 3).alias("saved"), F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(2).alias("version"),
        F.when(F.col("o_orderkey") % 7 != 0, F.to_json(F.struct((F.col("o_orderkey") % 240).alias("seen")))).alias("snapshot"),
    )
    outcome = resume_outcome(F.col("fingerprint"), F.col("saved"), F.col("version"), F.col("snapshot"))
    seen = F.get_json_object("snapshot", "$.seen").try_cast("long")
    met = declared.join(saved, "linkage_id", "left").withColumn("outcome", outcome)
    return met.select("linkage_id", "outcome", F.coalesce((F.col("outcome") == "restored") & (seen >= READY), F.lit(False)).alias("ready"))


@query(
    "st_merge_universes",
    "WITH u AS (SELECT 'customers' AS source, c_nationkey % 25 * 100000 + c_custkey % 1000 AS linkage_id FROM customer UNION ALL SELECT 'suppliers', s_nationkey % 25 * 100000 + s_suppkey % 1000 FROM supplier) SELECT linkage_id, count(*) AS n, count(*) > 1 AS clash FROM u GROUP BY linkage_id",
)
def st_merge_universes(spark, sf_dir):
    """Declarations of two universes put together; ids that occur twice clash."""
    ids = lambda t, n, k: table(spark, sf_dir, t).select((F.col(n) % 25 * 100_000 + F.col(k) % 1000).alias("linkage_id"))
    both = ids("customer", "c_nationkey", "c_custkey").unionByName(ids("supplier", "s_nationkey", "s_suppkey"))
    return both.groupBy("linkage_id").agg(F.count(F.lit(1)).alias("n")).withColumn("clash", F.col("n") > 1)


@query(
    "jn_books_from_quotes",
    f"WITH {LEGS_SQL} SELECT linkage_id, CAST(d AS TIMESTAMP) AS ts, a AS reference_price, round(fair, 6) AS fair_value, round((a - fair) / nullif(a, 0) * 10000, 6) AS spread_bps, false AS stale FROM fair WHERE a <> 0 AND fair IS NOT NULL",
)
def jn_books_from_quotes(spark, sf_dir):
    """Daily closes as quotes, met with the legs of each linkage and evaluated."""
    made = books(history_quotes(bars(spark, sf_dir)), UNIVERSE.legs_frame(spark))
    found = observations(made, UNIVERSE)
    return found.select("linkage_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "reference_price", *r6("fair_value", "spread_bps"), "stale")


@query(
    "ss_scan_line",
    f"WITH {LEGS_SQL} SELECT rtrim(rpad(linkage_id, 12, ' ') || '  ' || printf('%+9.1f bps', (a - fair) / a * 10000) || '  -  -  not scored') AS line, d FROM fair WHERE a <> 0 AND fair IS NOT NULL",
)
def ss_scan_line(spark, sf_dir):
    seen = observations(books(history_quotes(bars(spark, sf_dir)), UNIVERSE.legs_frame(spark)), UNIVERSE)
    none = F.lit(None).cast("double")
    said = seen.withColumns({"percentile": none, "net_bps": none, "alert": F.lit(False), "cooling": F.lit(False), "reason": F.lit("not scored")})
    return said.select(scan_line().alias("line"), F.col("ts").cast("date").alias("d"))


@query(
    "src_event_calendar",
    """WITH r AS (SELECT o_orderstatus AS symbol, o_orderdate AS ts, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS estimate, CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice + (o_orderkey % 200 - 100) * 8 END AS reported FROM orders)
SELECT symbol, ts, estimate, reported, round((reported - estimate) / nullif(abs(estimate), 0) * 100, 6) AS surprise_pct FROM r""",
)
def src_event_calendar(spark, sf_dir):
    """Orders as announcements; what is missing comes as not-a-number, as feeds have it."""
    gap = lambda n, x: F.when(F.col("o_orderkey") % n != 0, x).otherwise(float("nan"))
    reported = F.col("o_totalprice") + (F.col("o_orderkey") % 200 - 100) * 8
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("symbol"), F.col("o_orderdate").alias("ts"), gap(11, F.col("o_totalprice")).alias("estimate"), gap(13, reported).alias("reported"), F.lit(float("nan")).alias("surprise_pct"))
    return event_calendar(rows).select("symbol", "ts", "estimate", "reported", *r6("surprise_pct"))


@query(
    "src_rows_with_any_price",
    f"WITH {BARS_SQL}, w AS (SELECT d, max(CASE WHEN symbol = 'A' AND close > 1500 THEN close END) AS a, max(CASE WHEN symbol = 'N' AND close > 1500 THEN close END) AS n FROM bars GROUP BY d) SELECT d, a, n FROM w WHERE a IS NOT NULL OR n IS NOT NULL",
)
def src_rows_with_any_price(spark, sf_dir):
    high = F.when(F.col("close") > 1500, F.col("close"))
    wide = bars(spark, sf_dir).groupBy("d").agg(*[F.max(F.when(F.col("symbol") == s, high)).alias(s.lower()) for s in "AN"])
    return without_empty_rows(wide)


@query(
    "ag_universe_counts",
    f"WITH {DECLARED_SQL}, l AS (SELECT category, linkage_id, symbol_a AS symbol FROM declared UNION ALL SELECT category, linkage_id, symbol_b FROM declared) SELECT category, count(DISTINCT linkage_id) AS linkages, count(DISTINCT symbol) AS symbols FROM l GROUP BY category",
)
def ag_universe_counts(spark, sf_dir):
    return universe_counts(declared(spark, sf_dir))


@query(
    "st_ready_excluded",
    f"WITH {SERIES_SQL}, n AS (SELECT pair_id, count(*) AS seen FROM series GROUP BY 1), want AS (SELECT DISTINCT pair_id FROM pairs) SELECT pair_id FROM want EXCEPT SELECT pair_id FROM n WHERE seen >= 120 AND pair_id <> 'A-R'",
)
def st_ready_excluded(spark, sf_dir):
    seen = series(spark, sf_dir).groupBy("pair_id").agg(F.count(F.lit(1)).alias("seen"))
    ready = seen.where("seen >= 120 and pair_id <> 'A-R'")
    return spark.createDataFrame([("A-N",), ("A-R",), ("N-R",)], "pair_id string").join(ready, "pair_id", "left_anti")


@query("tk_latest_alerts", f"WITH {ALERTS_SQL} SELECT pair_id, d, v FROM alerts ORDER BY d DESC, pair_id LIMIT 200")
def tk_latest_alerts(spark, sf_dir):
    return series(spark, sf_dir).where(F.abs("v") > 6000).select("pair_id", "d", "v").orderBy(F.desc("d"), "pair_id").limit(200)


@query("tk_upcoming_events", "SELECT o_orderkey AS event_id, CAST(epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1997-06-01') AS DOUBLE) / 86400000000 AS days_away FROM orders WHERE o_orderdate >= TIMESTAMP '1997-06-01' AND o_orderdate <= TIMESTAMP '1997-06-15' ORDER BY 2, 1")
def tk_upcoming_events(spark, sf_dir):
    now = F.lit("1997-06-01").cast("timestamp")
    away = E.days_between(F.col("o_orderdate").cast("timestamp"), now)
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), away.alias("days_away"))
    return rows.where("days_away between 0 and 14").orderBy("days_away", "event_id")
