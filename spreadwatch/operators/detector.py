"""The composed detector: an adaptive hedge ratio, an empirical threshold and a reversion gate.

``verdicts`` scores whole tables: all of it streams in order of each series. ``Detector`` is
the same thing one observation at a time, with a snapshot, for streams; tests hold them together.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spreadwatch.functions import expressions as E
from spreadwatch.operators import windows as W
from spreadwatch.operators.sequential import Kalman
from spreadwatch.sources.store import STATE_VERSION

WARMUP = 120
HORIZON = 3.0


def verdicts(df: DataFrame, key: str, i: str, v: str, friction: float, min_edge: float = 0.0, horizon: float = HORIZON) -> DataFrame:
    """``df`` with seen, percentile, exceeds, fit, gate, alert and reason for each row of each series."""
    lagged = W.with_lag(df, key, i, v).withColumn("seen", F.row_number().over(Window.partitionBy(key).orderBy(i)).cast("long"))
    scored = W.with_quantiles(lagged, key, i, v, W.THRESHOLD_WINDOW, {"_low": 0.01, "_high": 0.99}, "percentile")
    scored = scored.withColumn("exceeds", (F.col(v) > F.col("_high")) | (F.col(v) < F.col("_low")))
    scored = W.with_ou(scored, key, i, W.FIT_WINDOW - 1, 29, upto=True)
    f = F.col("fit")
    gate = E.horizon_gate(F.col(v) - f["mu"], f["theta"], f["t"], f["half_life"], horizon, F.lit(friction), F.lit(min_edge))
    scored = scored.withColumn("gate", F.when(f.isNotNull(), gate))
    reason = (
        F.when(F.col("seen") < WARMUP, F.concat(F.lit("warming up "), F.col("seen").cast("string"), F.lit(f"/{WARMUP}")))
        .when(F.col("percentile").isNull(), "no distribution yet")
        .when(~F.col("exceeds"), "within its own range")
        .when(F.col("gate").isNull(), "too short to fit reversion")
        .otherwise(F.col("gate.reason"))
    )
    open_ = (F.col("seen") >= WARMUP) & F.coalesce("exceeds", F.lit(False)) & F.coalesce("gate.passed", F.lit(False))
    return scored.withColumns({"alert": open_, "reason": reason}).drop("_low", "_high", "lv", "dv")


def fit_ou(values: np.ndarray) -> dict[str, float | None] | None:
    """The reversion fit of one window of levels; null with fewer than 30."""
    x = np.asarray(values, dtype=float)
    x = x[np.isfinite(x)]
    if len(x) < E.MIN_FIT:
        return None
    lagged, delta = x[:-1], np.diff(x)
    centred = lagged - lagged.mean()
    sxx, syy = float(centred @ centred), float(((delta - delta.mean()) ** 2).sum())
    sxy = float(centred @ delta)
    b = sxy / sxx if sxx else 0.0
    rss, dof = max(syy - b * sxy, 0.0), len(delta) - 2
    error = math.sqrt(rss / dof / sxx) if sxx else 0.0
    a = float(delta.mean()) - b * float(lagged.mean())
    return {"theta": -b, "mu": -a / b if b else float(lagged.mean()), "sigma": math.sqrt(rss / dof), "half_life": math.log(2) / -b if b < 0 else None, "t": b / error if error else 0.0}


@dataclass
class Detector:
    """Detector state of one linkage. A stale observation advances nothing."""

    kalman: Kalman = field(default_factory=Kalman)
    threshold: list[float] = field(default_factory=list)
    spreads: list[float] = field(default_factory=list)
    seen: int = 0
    last_alert: float | None = None

    def step(self, v: float, reference: float, fair: float, friction: float, min_edge: float = 0.0, horizon: float = HORIZON) -> dict:
        self.seen += 1
        out = {"seen": self.seen, "alert": False, "percentile": None, "expected_bps": None, "net_bps": None, "half_life": None, "t": None, **self.kalman.step(reference, fair)}
        self.spreads = [*self.spreads[-(W.FIT_WINDOW - 1) :], v]
        history = np.sort(self.threshold)
        self.threshold = [*self.threshold[-(W.THRESHOLD_WINDOW - 1) :], v]
        if len(history) >= W.THRESHOLD_MIN:
            out["percentile"] = 100.0 * int(np.searchsorted(history, v, "left")) / len(history)
        if self.seen < WARMUP:
            return out | {"reason": f"warming up {self.seen}/{WARMUP}"}
        if out["percentile"] is None:
            return out | {"reason": "no distribution yet"}
        low, high = np.quantile(history, [0.01, 0.99])
        if low <= v <= high:
            return out | {"reason": "within its own range"}
        if (fit := fit_ou(np.array(self.spreads))) is None:
            return out | {"reason": "too short to fit reversion"}
        ok = fit["theta"] > 0 and abs(fit["t"]) >= E.MIN_T
        expected = abs(v - fit["mu"]) * (1 - math.exp(-fit["theta"] * horizon)) if ok else 0.0
        net = expected - friction
        alert = ok and net >= min_edge
        reason = "no mean reversion that can be told from a random walk" if not ok else "reverts in time" if alert else "too little comes back"
        return out | {"alert": alert, "expected_bps": expected, "net_bps": net, "half_life": fit["half_life"], "t": fit["t"], "reason": reason}

    def snapshot(self) -> str:
        return json.dumps({"version": STATE_VERSION, **asdict(self)})

    @classmethod
    def restore(cls, text: str) -> Detector:
        raw = json.loads(text)
        if raw.pop("version", None) != STATE_VERSION:
            raise ValueError("the snapshot is of another version")
        return cls(**{**raw, "kalman": Kalman(**raw["kalman"])})
