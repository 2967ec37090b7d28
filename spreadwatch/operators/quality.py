"""Screens for bad prints, on frames (pair_id, d, pa, pb) or series, all pairs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadwatch.functions.expressions import log_spread_bps

MAX_MOVE, MAD_LIMIT, MAD_SIGMA, PARTNER_MOVE = 0.4, 8.0, 1.4826, 0.005


def spike(price: str, key: str, order: str, limit: float = MAX_MOVE) -> Column:
    """A huge move that the next row takes back. Non-positive prices must be gone already."""
    w = Window.partitionBy(key).orderBy(order)
    change = F.ln(F.col(price)) - F.ln(F.lag(price).over(w))
    after = F.ln(F.lead(price).over(w)) - F.ln(F.col(price))
    return F.coalesce((F.abs(change) > limit) & (F.abs(after) > limit) & (F.signum(change) != F.signum(after)), F.lit(False))


def stale_print(price: str, partners: list[str], key: str, order: str, limit: float = PARTNER_MOVE) -> Column:
    """Exactly the previous price while another leg moved."""
    w = Window.partitionBy(key).orderBy(order)
    moves = [F.abs(F.col(p) / F.lag(p).over(w) - 1) for p in partners]
    largest = moves[0] if len(moves) == 1 else F.greatest(*moves)
    return F.coalesce((F.col(price) == F.lag(price).over(w)) & (largest >= limit), F.lit(False))


def mad_outliers(df: DataFrame, key: str, v: str, limit: float = MAD_LIMIT, min_rows: int = 30) -> DataFrame:
    """Adds outlier: further from the key's median than ``limit`` robust standard deviations."""
    centre = df.groupBy(key).agg(F.expr(f"percentile({v}, 0.5)").alias("_mid"), F.count(v).alias("_n"))
    near = df.join(centre, key)
    spread = near.groupBy(key).agg(F.expr(f"percentile(abs({v} - _mid), 0.5)").alias("_mad"))
    far = F.abs(F.col(v) - F.col("_mid")) / (F.nullif(F.col("_mad"), F.lit(0.0)) * MAD_SIGMA) > limit
    return near.join(spread, key).withColumn("outlier", F.coalesce(far & (F.col("_n") >= min_rows), F.lit(False))).drop("_mid", "_n", "_mad")


def screen_flags(frame: DataFrame) -> DataFrame:
    """``frame`` with spike_a, spike_b, stale_a, stale_b and outlier (of the raw log ratio).

    Every screen judges the full frame, so that one does not hide what another would find.
    """
    flagged = frame.where("pa is not null and pb is not null").withColumns({
        "spike_a": spike("pa", "pair_id", "d"),
        "spike_b": spike("pb", "pair_id", "d"),
        "stale_a": stale_print("pa", ["pb"], "pair_id", "d"),
        "stale_b": stale_print("pb", ["pa"], "pair_id", "d"),
    })
    flagged = flagged.withColumn("bad", F.col("spike_a") | F.col("spike_b") | F.col("stale_a") | F.col("stale_b"))
    ratio = F.when((F.col("pa") > 0) & (F.col("pb") > 0), log_spread_bps(F.col("pa"), F.col("pb")))
    return mad_outliers(flagged.withColumn("_ratio", ratio), "pair_id", "_ratio").drop("_ratio")


def screen(frame: DataFrame) -> DataFrame:
    """The rows that no screen flags."""
    return screen_flags(frame).where("not bad and not outlier").select(*frame.columns)


def screen_report(frame: DataFrame) -> DataFrame:
    """Per pair: rows in and out, and how many each screen took."""
    n = lambda c: F.sum(F.col(c).cast("long"))
    return screen_flags(frame).groupBy("pair_id").agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.sum((~F.col("bad") & ~F.col("outlier")).cast("long")).alias("rows_out"),
        *[n(c).alias(f"n_{c}") for c in ("spike_a", "spike_b", "stale_a", "stale_b", "outlier")],
        F.array_sort(F.collect_list(F.when(F.col("bad") | F.col("outlier"), F.col("d")))).alias("dates"),
    )
