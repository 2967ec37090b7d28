"""The live scan as a stream: quotes or books in, verdicts, alerts and saved state out.

Quotes become books, observations and verdicts in one query: an aggregation keeps the latest quote
of each leg and closes a poll's book when the watermark passes it, columns evaluate it, and an
operator with the detector's state judges it. State lives in Spark's state store and starts from a
table of saved snapshots, which no driver holds. Each micro-batch is written to the store and then
announced. The only exchanges are those that bring the rows of a linkage together.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spreadwatch.functions import expressions as E
from spreadwatch.functions.formula import compile_formula
from spreadwatch.operators.alignment import asof_join
from spreadwatch.operators.detector import Detector
from spreadwatch.operators.sequential import Kalman
from spreadwatch.sources.config import Universe
from spreadwatch.sources.notify import Notifier, message
from spreadwatch.sources.store import STATE_VERSION, Store

OBSERVATION = "linkage_id string, ts timestamp, reference_price double, fair_value double, spread_bps double, stale boolean, stale_reason string"
VERDICT = (
    "linkage_id string, ts timestamp, seen long, spread_bps double, reference_price double, fair_value double, stale boolean, alert boolean, reason string, percentile double, "
    "expected_bps double, net_bps double, half_life double, t double, beta double, kz double, cooling boolean, snapshot string, last_alert double"
)
STATE = "snapshot string"


def observations(quotes: DataFrame, universe: Universe, max_age_seconds: float = 900.0) -> DataFrame:
    """Books of quotes (linkage_id, ts, prices map<leg,double>, leg_ts map<leg,timestamp>, leg_stale map<leg,boolean>) as observations.

    A book without all its legs is left out; one with a late or flagged leg is stale, with the leg's name.
    """
    fair = reference = late = n = F.lit(None)
    fair, reference, late, n = fair.cast("double"), reference.cast("double"), late.cast("string"), n.cast("int")
    for x in universe.linkages:
        own = F.col("linkage_id") == x.id
        legs = {name: F.col("prices")[name] for name in x.legs}
        fair = F.when(own, compile_formula(x.fair_value, legs, x.params)).otherwise(fair)
        reference = F.when(own, legs[x.reference]).otherwise(reference)
        n = F.when(own, F.lit(len(x.legs))).otherwise(n)
        reasons = [F.when(F.col("leg_stale")[name], f"{name} is flagged").when(E.age_seconds(F.col("leg_ts")[name], F.col("ts")) > max_age_seconds, f"{name} is old") for name in sorted(x.legs)]
        late = F.when(own, F.coalesce(*reasons)).otherwise(late)
    rows = quotes.where(F.size("prices") == n).withColumns({"reference_price": reference, "fair_value": fair, "stale_reason": late})
    rows = rows.withColumns({"stale": F.col("stale_reason").isNotNull(), "spread_bps": E.spread_bps(F.col("reference_price"), F.col("fair_value"))})
    return rows.where("spread_bps is not null").select(*[f.split()[0] for f in OBSERVATION.split(", ")])


def books(quotes: DataFrame, legs: DataFrame) -> DataFrame:
    """A table of quotes (poll_ts, symbol, price, ts, stale) met with legs (linkage_id, leg, symbol, n_legs) as books for ``observations``.

    Of a leg's quotes at one poll the latest counts (of equal times the highest price, a flagged one
    last). A linkage without a quote for every leg at a poll has no book of it. Legs are
    declarations and few. Streams go through ``closed_books``.
    """
    met = quotes.where("price is not null").join(F.broadcast(legs), "symbol")  # one row per declared leg
    one = met.groupBy("linkage_id", "poll_ts", "leg", "n_legs").agg(F.max(F.struct("ts", "price", "stale")).alias("quote"))
    whole = one.groupBy("linkage_id", "poll_ts").agg(F.collect_list(F.struct("leg", "quote.price", "quote.ts", "quote.stale")).alias("found"), F.max("n_legs").alias("n_legs"))
    return _as_maps(whole.where(F.size("found") == F.col("n_legs")).withColumnRenamed("poll_ts", "ts"))


def _as_maps(whole: DataFrame) -> DataFrame:
    """Books with an array found of (leg, price, ts, stale) as maps by leg."""
    by_leg = lambda c: F.map_from_entries(F.transform(F.array_sort("found"), lambda x: F.struct(x["leg"], x[c])))
    return whole.select("linkage_id", "ts", by_leg("price").alias("prices"), by_leg("ts").alias("leg_ts"), by_leg("stale").alias("leg_stale"))


def closed_books(quotes: DataFrame, universe: Universe, delay: str) -> DataFrame:
    """A stream of quotes (poll_ts, symbol, price, ts, stale) as books: ``books`` for a stream.

    A poll's book comes out when the watermark, ``delay`` behind the latest poll, reaches it, so
    late and repeated quotes are settled before; one without all its legs is dropped then, and a
    quote that comes after is too late. It is one aggregation: tasks reduce their quotes to the
    latest of each leg before any exchange, and the state is a row per poll that the delay keeps open.
    """
    slots = [(x.id, leg, x.legs[leg][0], i, len(x.legs)) for x in universe.linkages for i, leg in enumerate(sorted(x.legs))]
    legs = quotes.sparkSession.createDataFrame(slots, "linkage_id string, leg string, symbol string, slot int, n_legs int")
    timed = quotes.where("price is not null and poll_ts is not null").withWatermark("poll_ts", delay)
    met = timed.join(F.broadcast(legs), "symbol")  # one row per declared leg
    quote = F.struct(F.coalesce("ts", "poll_ts").alias("ts"), F.col("price").cast("double").alias("price"), F.coalesce("stale", F.lit(False)).alias("stale"), "leg")
    latest = [F.max(F.when(F.col("slot") == i, quote)).alias(f"_{i}") for i in range(max((i + 1 for *_, i, _ in slots), default=1))]
    one = met.groupBy("linkage_id", "poll_ts").agg(*latest, F.max("n_legs").alias("n_legs"))
    found = one.select("linkage_id", F.col("poll_ts").alias("ts"), "n_legs", F.array_compact(F.array(*[f"_{i}" for i in range(len(latest))])).alias("found"))
    return _as_maps(found.where(F.size("found") == F.col("n_legs")))


def history_quotes(bars: DataFrame) -> DataFrame:
    """Daily closes (symbol, d, close) as quotes that are never stale, for warming up."""
    ts = F.col("d").cast("timestamp")
    return bars.select(ts.alias("poll_ts"), "symbol", F.col("close").alias("price"), ts.alias("ts"), F.lit(False).alias("stale"))


def scan_line() -> Column:
    """One line of the scan per verdict: linkage, spread, state of the detector."""
    number = lambda fmt, c: F.when(F.col(c).isNotNull(), F.format_string(fmt, F.col(c))).otherwise(F.lit("-"))
    flag = F.when(F.col("alert"), "ALERT").when(F.col("stale"), "stale").when(F.col("cooling"), "cooling").otherwise("")
    return F.rtrim(F.concat_ws("  ", F.rpad("linkage_id", 12, " "), number("%+9.1f bps", "spread_bps"), number("p%5.1f", "percentile"), number("net %+.1f", "net_bps"), "reason", flag))


def warmed_up(history: DataFrame, universe: Universe, snapshots: dict[str, str], ready: set[str]) -> dict[str, str]:
    """Snapshots after history (books) has gone through the detectors of linkages that aren't ready; alerts are not sent. One row per linkage comes back."""
    waiting = history.where(~F.col("linkage_id").isin(sorted(ready))) if ready else history
    said = replay(observations(waiting, universe, float("inf")), universe, {k: v for k, v in snapshots.items() if k in ready})
    last = said.where("snapshot is not null").select("linkage_id", "snapshot").collect()
    # an alert of the past must not keep a live one back
    return snapshots | {r.linkage_id: json.dumps(json.loads(r.snapshot) | {"last_alert": None}) for r in last}


VERDICT_NAMES = [f.split()[0] for f in VERDICT.split(", ")]
SEEN_NAMES = [f.split()[0] for f in OBSERVATION.split(", ")]
Rules = dict[str, tuple[float, float, float, float | None]]


def _rules(universe: Universe) -> Rules:
    """Friction, least edge, cooldown in seconds and the filter's delta of each linkage."""
    return {x.id: (x.total_friction, x.alert.min_net_edge_bps, x.alert.cooldown_minutes * 60.0, x.kalman_delta) for x in universe.linkages}


def _new_detector(rules: Rules, linkage: str, snapshot: str | None) -> Detector:
    if snapshot is not None:
        return Detector.restore(snapshot)
    delta = rules[linkage][3]
    return Detector(Kalman(delta=delta) if delta else Kalman())


def _judge(row: Any, detector: Detector, rules: Rules) -> dict[str, Any]:
    """What the detector says to one observation, as the fields of a verdict."""
    friction, min_edge, cooldown, _ = rules[row.linkage_id]
    base = {"linkage_id": row.linkage_id, "ts": row.ts, "spread_bps": row.spread_bps, "reference_price": row.reference_price, "fair_value": row.fair_value, "stale": bool(row.stale), "cooling": False}
    if row.stale:
        out = base | {"seen": detector.seen, "alert": False, "reason": f"stale: {row.stale_reason}"}
    else:
        said = detector.step(row.spread_bps, row.reference_price, row.fair_value, friction, min_edge)
        now = pd.Timestamp(row.ts).timestamp()
        cooling = bool(said["alert"] and detector.last_alert is not None and now - detector.last_alert < cooldown)
        if said["alert"] and not cooling:
            detector.last_alert = now
        out = base | said | {"alert": said["alert"] and not cooling, "cooling": cooling}
    return {name: out.get(name) for name in VERDICT_NAMES} | {"last_alert": detector.last_alert}


def _advance(rows: pd.DataFrame, detector: Detector, rules: Rules) -> pd.DataFrame:
    """The rows of one linkage in time order, with what the detector says to each."""
    frame = pd.DataFrame([_judge(row, detector, rules) for row in rows.sort_values("ts", kind="stable").itertuples(index=False)], columns=VERDICT_NAMES)
    if len(frame):
        frame["last_alert"] = detector.last_alert
        frame.loc[frame.index[-1], "snapshot"] = detector.snapshot()
    return frame


def detect(observed: DataFrame, universe: Universe, snapshots: dict[str, str] | None = None) -> DataFrame:
    """Verdicts of an observation stream; snapshots restores the state of linkages that had one."""
    rules, saved = _rules(universe), snapshots or {}

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        detector = _new_detector(rules, key[0], state.get[0] if state.exists else saved.get(key[0]))
        found = _advance(pd.concat(list(batches)), detector, rules)
        state.update((detector.snapshot(),))
        yield found

    return observed.groupBy("linkage_id").applyInPandasWithState(step, VERDICT, STATE, "append", GroupStateTimeout.NoTimeout)


class Judge(StatefulProcessor):
    """The detector of each linkage as state of a stream; it starts from a saved snapshot where there is one."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.saved = handle.getValueState("detector", STATE)

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:  # noqa: N802, N803
        if initialState.snapshot is not None:
            self.saved.update((initialState.snapshot,))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        detector = _new_detector(self.rules, key[0], self.saved.get()[0] if self.saved.exists() else None)
        said = [_judge(row, detector, self.rules) for row in sorted(rows, key=lambda r: r.ts)]
        snapshot = detector.snapshot()
        self.saved.update((snapshot,))
        said[-1]["snapshot"] = snapshot
        for out in said:
            yield Row(**(out | {"last_alert": detector.last_alert}))

    def close(self) -> None:
        pass


def judge(observed: DataFrame, universe: Universe, initial: DataFrame | None = None) -> DataFrame:
    """``detect`` for a stream that other stateful operators feed.

    initial: saved snapshots (linkage_id, snapshot); they go straight into the state store.
    """
    start = None if initial is None else initial.select("linkage_id", "snapshot").groupBy("linkage_id")
    return observed.groupBy("linkage_id").transformWithState(Judge(_rules(universe)), VERDICT, "Append", "None", initialState=start)


def verdicts_of_quotes(quotes: DataFrame, universe: Universe, delay: str = "2 minutes", max_age_seconds: float = 900.0, initial: DataFrame | None = None) -> DataFrame:
    """A stream of quotes (poll_ts, symbol, price, ts, stale) to verdicts in one query; see ``closed_books`` and ``judge``.

    It needs the RocksDB state store: see ``stateful``.
    """
    return judge(observations(closed_books(quotes, universe, delay), universe, max_age_seconds), universe, initial)


#: The setting and the store that operators with state variables need.
STATE_STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def replay(observed: DataFrame, universe: Universe, snapshots: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """The same verdicts over a finished table, for warming up and for comparison.

    snapshots (by linkage, or a table of linkage_id and snapshot) are what detectors start from.
    Rows stream in order of each linkage: a task holds an Arrow batch and one detector, however
    long a history is. The last row of a linkage carries its snapshot.
    """
    rules = _rules(universe)
    rows = observed.select(*SEEN_NAMES, F.lit(None).cast("string").alias("snapshot"), F.lit(1).alias("_order"))
    if snapshots is not None:
        saved = snapshots if isinstance(snapshots, DataFrame) else observed.sparkSession.createDataFrame(list(snapshots.items()), "linkage_id string, snapshot string")
        rows = rows.unionByName(saved.select("linkage_id", "snapshot", F.lit(0).alias("_order")), allowMissingColumns=True)
    kinds = {"string": pa.string(), "double": pa.float64(), "long": pa.int64(), "boolean": pa.bool_(), "timestamp": pa.timestamp("us", tz="UTC")}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in VERDICT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, detector, held = None, None, None

        def let_go(last: bool) -> list[dict[str, Any]]:
            nonlocal held
            out = [] if held is None else [held | {"snapshot": detector.snapshot() if last else None}]
            held = None
            return out

        for batch in batches:
            found: list[dict[str, Any]] = []
            for row in batch.to_pylist():
                if row["linkage_id"] != now:
                    found += let_go(True)
                    now, detector = row["linkage_id"], None
                if not row["_order"]:
                    detector = _new_detector(rules, now, row["snapshot"])
                    continue
                found += let_go(False)
                if detector is None:
                    detector = _new_detector(rules, now, None)
                held = _judge(Row(**row), detector, rules)
            yield pa.RecordBatch.from_pylist(found, schema=schema)
        yield pa.RecordBatch.from_pylist(let_go(True), schema=schema)

    return rows.repartition("linkage_id").sortWithinPartitions("linkage_id", "_order", "ts").mapInArrow(run, VERDICT)


def suppressed(verdicts: DataFrame, legs: DataFrame, calendar: DataFrame, days: float) -> DataFrame:
    """Adds blocked: a leg of the linkage has an event from the verdict's time to ``days`` later.

    legs: (linkage_id, symbol); calendar: (symbol, event_ts). Only the next event after an alert can
    block it, so an as-of join forward finds it in linear time.
    """
    events = legs.select("linkage_id", "symbol").join(calendar, "symbol").select("linkage_id", F.col("event_ts").cast("timestamp").alias("event_ts"))
    alerts = verdicts.where("alert").select("linkage_id", "ts").distinct()
    near = asof_join(alerts, events, "linkage_id", F.col("ts").cast("timestamp"), F.col("event_ts"), [], "forward")
    hit = near.where(E.days_between(F.col("r_ts"), F.col("ts")) <= days).select("linkage_id", "ts", F.lit(True).alias("_hit"))
    return verdicts.join(hit, ["linkage_id", "ts"], "left").withColumn("blocked", F.coalesce("_hit", F.lit(False))).drop("_hit")


def sink(store: Store, universe: Universe, notifier: Notifier, calendar: DataFrame | None = None, days: float = 3.0, checkpoint: str | None = None):
    """A foreachBatch function: record alerts, observations and state, then announce the alerts.

    Writes are keyed by the run, which the checkpoint names, and the batch number, so a repeated
    batch replaces itself and a new checkpoint replaces nothing. Every alert is sent, one message
    each, in order of time; they come to the driver partition by partition.
    """
    spark = store.spark
    facts = spark.createDataFrame([(x.id, x.category, x.fingerprint, x.total_friction) for x in universe.linkages], "linkage_id string, category string, fingerprint string, friction double")

    def write(batch: DataFrame, number: int) -> None:
        run = json.loads(spark.read.text(f"{checkpoint}/metadata").first().value)["id"] if checkpoint else "0"
        batch = batch.persist()
        try:
            rows = batch.join(F.broadcast(facts), "linkage_id")  # one row per declared linkage
            rows = suppressed(rows, universe.legs_frame(spark), calendar, days) if calendar is not None else rows.withColumn("blocked", F.lit(False))
            alerts = rows.where("alert and not blocked").select(
                "linkage_id", "ts", "fingerprint", "category", "spread_bps", F.col("kz").alias("kalman_z"), "beta", "percentile", F.col("half_life").alias("half_life_days"),
                F.col("t").alias("theta_tstat"), F.col("expected_bps").alias("predicted_reversion_bps"), F.col("friction").alias("friction_bps"), F.col("net_bps").alias("predicted_net_bps"),
            )
            store.record_alerts(alerts, number, run)
            store.record_observations(rows, number, run)
            state = rows.where("snapshot is not null").select(
                "linkage_id", "fingerprint", F.lit(STATE_VERSION).alias("version"), "snapshot", F.timestamp_seconds("last_alert").alias("last_alert_at"), F.col("ts").alias("updated_at")
            )
            store.save_state(state, number)
            for row in rows.where("alert and not blocked").orderBy("ts", "linkage_id").select(message().alias("text")).toLocalIterator():
                notifier.send(row.text)
        finally:
            batch.unpersist()

    return write


def start(quotes: DataFrame, universe: Universe, store: Store, notifier: Notifier, checkpoint: str, cadence_seconds: float | None = 60.0, calendar: DataFrame | None = None, history: DataFrame | None = None):
    """Start the scan over a stream of books; without a cadence it takes what is there and ends.

    Saved state is taken up where its declaration and version are the same; linkages that have none
    or too little are warmed up with ``history``, books of the past, if it is given.
    """
    saved = store.resume(universe.frame(store.spark).select("linkage_id", "fingerprint")).where("snapshot is not null").select("linkage_id", "snapshot", "ready").collect()  # one row per declared linkage
    resumed = {r.linkage_id: r.snapshot for r in saved}
    if history is not None:
        resumed = warmed_up(history, universe, resumed, {r.linkage_id for r in saved if r.ready})
    found = detect(observations(quotes, universe), universe, resumed)
    writer = found.writeStream.foreachBatch(sink(store, universe, notifier, calendar, checkpoint=checkpoint)).option("checkpointLocation", checkpoint).outputMode("append")
    trigger = {"availableNow": True} if cadence_seconds is None else {"processingTime": f"{cadence_seconds:g} seconds"}
    return writer.trigger(**trigger).start()


def saved_state(store: Store, universe: Universe, history: DataFrame | None = None, max_age_seconds: float = float("inf")) -> DataFrame:
    """(linkage_id, snapshot) to start from, as a table: what can be taken up, warmed up with history (books) where it is not ready."""
    saved = store.resume(universe.frame(store.spark).select("linkage_id", "fingerprint")).where("snapshot is not null").select("linkage_id", "snapshot", "ready")
    if history is None:
        return saved.select("linkage_id", "snapshot")
    ready = saved.where("ready").select("linkage_id", "snapshot")
    waiting = observations(history, universe, max_age_seconds).join(ready.select("linkage_id"), "linkage_id", "left_anti")
    said = replay(waiting, universe).where("snapshot is not null")

    @F.pandas_udf("string")
    def without_alert(snapshots: pd.Series) -> pd.Series:
        return snapshots.map(lambda x: json.dumps(json.loads(x) | {"last_alert": None}))  # an alert of the past must not keep a live one back

    warm = said.select("linkage_id", without_alert("snapshot").alias("snapshot"))
    rest = saved.where("not ready").select("linkage_id", "snapshot").join(warm.select("linkage_id"), "linkage_id", "left_anti")
    return ready.unionByName(warm).unionByName(rest)


def start_quotes(quotes: DataFrame, universe: Universe, store: Store, notifier: Notifier, checkpoint: str, cadence_seconds: float | None = 60.0, calendar: DataFrame | None = None, history: DataFrame | None = None, delay: str = "2 minutes", max_age_seconds: float = 900.0):
    """Start the scan over a stream of quotes (poll_ts, symbol, price, ts, stale): quotes to announced alerts in one query.

    As ``start``, but books are made in the stream, and saved state goes from the store's table into
    the state store without passing the driver. The query runs on the RocksDB state store.
    """
    found = verdicts_of_quotes(quotes, universe, delay, max_age_seconds, saved_state(store, universe, history))
    writer = found.writeStream.foreachBatch(sink(store, universe, notifier, calendar, checkpoint=checkpoint)).option("checkpointLocation", checkpoint).outputMode("append")
    trigger = {"availableNow": True} if cadence_seconds is None else {"processingTime": f"{cadence_seconds:g} seconds"}
    return stateful(store.spark, writer.trigger(**trigger).start)


def stateful(spark, begin):
    """What ``begin`` starts, on the RocksDB state store; a query keeps the settings it began with, the session gets its own back."""
    name, provider = STATE_STORE
    before = spark.conf.get(name, None)
    spark.conf.set(name, provider)
    try:
        return begin()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
