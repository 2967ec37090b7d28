"""The durable log: alerts, observations and detector state as Parquet tables."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STATE_VERSION = 2
#: Observations after which a detector no longer needs warming up.
READY = 120
ALERTS = (
    "linkage_id string, ts timestamp, fingerprint string, category string, spread_bps double, kalman_z double, beta double, percentile double, "
    "half_life_days double, theta_tstat double, predicted_reversion_bps double, friction_bps double, predicted_net_bps double"
)
OBSERVATIONS = "linkage_id string, ts timestamp, fingerprint string, reference_price double, fair_value double, spread_bps double"
TABLES = {"alerts": ALERTS, "observations": OBSERVATIONS}
STATE = "linkage_id string, fingerprint string, version int, snapshot string, last_alert_at timestamp, updated_at timestamp"


def resume_outcome(fingerprint: Column, saved: Column, version: Column, snapshot: Column | None = None) -> Column:
    """Why saved state is or is not taken up again."""
    out = (
        F.when(saved.isNull(), "no saved state")
        .when(saved != fingerprint, "declaration changed")
        .when(version.isNull() | (version != STATE_VERSION), "other version")
    )
    if snapshot is not None:
        out = out.when(F.get_json_object(snapshot, "$.seen").try_cast("long").isNull(), "unreadable")
    return out.otherwise("restored")


def _of_run(batches: dict[str, int]) -> Column:
    """The batch of a row's run, null of other runs."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in batches.items() for x in pair]), F.col("run"))


class Store:
    """Three tables under one folder.

    Appends go to a folder of their run (one checkpoint of a stream) and batch, so a repeated batch
    replaces itself and another run replaces nothing. ``compact`` packs finished batches; which of
    them are packed is what the newest manifest of a table says. State is one row per linkage: each save
    writes the newest of all in a new folder before the old ones go, so a stop in between loses nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str) -> tuple:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _append(self, name: str, schema: str, rows: DataFrame, batch: int, run: str) -> None:
        names = [f.split()[0] for f in schema.split(", ")]
        rows.select(*names).write.mode("overwrite").parquet(f"{self.path}/{name}/run={run}/batch={batch}")

    def _manifest(self, name: str) -> tuple[int, dict]:
        """The last number taken by a manifest, and the newest whole one: packed folders, and each run's last packed batch."""
        store, at = self._at(f"{name}_packed/manifests")
        found = sorted((f.getPath().getName() for f in store.listStatus(at)), reverse=True) if store.exists(at) else []
        for file in found:
            text = self.spark.read.text(f"{self.path}/{name}_packed/manifests/{file}", wholetext=True).first()
            try:
                return int(found[0][:12]), json.loads(text[0])
            except (TypeError, ValueError):  # its writer was stopped half-way, so nothing in it counts
                continue
        return int(found[0][:12]) if found else 0, {"folders": [], "upto": {}}

    def _live(self, name: str, schema: str, upto: dict[str, int]) -> DataFrame:
        """Batches that aren't packed; the filter prunes folders."""
        store, at = self._at(name)
        if not store.exists(at):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        return rows.where(F.coalesce(F.col("batch") > _of_run(upto), F.lit(True))) if upto else rows

    def _read(self, name: str, schema: str) -> DataFrame:
        schema = f"{schema}, run string, batch bigint"
        _, manifest = self._manifest(name)
        rows = self._live(name, schema, manifest["upto"])
        packed = [f"{self.path}/{name}_packed/{folder}" for folder in manifest["folders"]]
        return rows.unionByName(self.spark.read.schema(schema).parquet(*packed)) if packed else rows

    def compact(self, name: str) -> int:
        """Packs all batches of ``alerts`` or ``observations`` but each run's newest, which may be written again; returns how many.

        The packed folder counts once its manifest is there, and a manifest's number can be taken
        once: of two compactions at a time one raises and leaves nothing behind. Folders of packed
        batches are deleted by the next compaction, so that readers of before can finish.
        """
        number, manifest = self._manifest(name)
        store, at = self._at(name)
        upto, newest, n = dict(manifest["upto"]), {}, 0
        for run in store.listStatus(at) if store.exists(at) else []:
            batches = {int(b.getPath().getName().removeprefix("batch=")): b.getPath() for b in store.listStatus(run.getPath()) if b.isDirectory()}
            run = run.getPath().getName().removeprefix("run=")
            for batch, path in batches.items():
                if batch <= upto.get(run, -1):
                    store.delete(path, True)
            left = [b for b in batches if b > upto.get(run, -1)]
            if len(left) > 1:
                newest[run], n = max(left), n + len(left) - 1
        if not n:
            return 0
        schema = f"{TABLES[name]}, run string, batch bigint"
        folder = uuid.uuid4().hex
        rows = self._live(name, schema, manifest["upto"]).where(F.col("batch") < _of_run(newest))
        rows.repartitionByRange("linkage_id", "ts").sortWithinPartitions("linkage_id", "ts").write.parquet(f"{self.path}/{name}_packed/{folder}")
        upto |= {run: batch - 1 for run, batch in newest.items()}
        try:
            out = store.create(self._at(f"{name}_packed/manifests/{number + 1:012}.json")[1], False)
        except Py4JJavaError as taken:
            store.delete(self._at(f"{name}_packed/{folder}")[1], True)
            raise RuntimeError(f"another compaction of {name} came first") from taken
        out.write(bytearray(json.dumps({"folders": [*manifest["folders"], folder], "upto": upto}).encode()))
        out.close()
        return n

    def record_alerts(self, rows: DataFrame, batch: int, run: str = "0") -> None:
        self._append("alerts", ALERTS, rows, batch, run)

    def record_observations(self, rows: DataFrame, batch: int, run: str = "0") -> None:
        """Stale observations are never kept."""
        self._append("observations", OBSERVATIONS, rows.where("not stale"), batch, run)

    def _states(self) -> list[str]:
        """The finished folders of state."""
        store, at = self._at("detector_state")
        names = [s.getPath().getName() for s in store.listStatus(at)] if store.exists(at) else []
        return sorted(n for n in names if store.exists(self._at(f"detector_state/{n}/_SUCCESS")[1]))

    def save_state(self, rows: DataFrame, batch: int) -> None:
        """Put the rows in place of older ones of their linkages."""
        old = self._states()
        new = rows.select(*[f.split()[0] for f in STATE.split(", ")], F.lit(batch).cast("bigint").alias("batch"))
        self._newest(self._state(old).unionByName(new)).write.parquet(f"{self.path}/detector_state/{uuid.uuid4().hex}")
        for name in old:
            store, at = self._at(f"detector_state/{name}")
            store.delete(at, True)

    def alerts(self) -> DataFrame:
        return self._read("alerts", ALERTS)

    def observations(self) -> DataFrame:
        return self._read("observations", OBSERVATIONS)

    def _state(self, names: list[str]) -> DataFrame:
        schema = f"{STATE}, batch bigint"
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/detector_state/{n}" for n in names]) if names else self.spark.createDataFrame([], schema)

    def _newest(self, rows: DataFrame) -> DataFrame:
        w = Window.partitionBy("linkage_id").orderBy(F.desc("updated_at"), F.desc("batch"))
        return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")

    def state(self) -> DataFrame:
        """The newest state of each linkage, by the time it was saved for."""
        return self._newest(self._state(self._states()))

    def resume(self, linkages: DataFrame) -> DataFrame:
        """Linkages (linkage_id, fingerprint) with their snapshot where it can be taken up, the outcome, and whether they are ready."""
        saved = self.state().select("linkage_id", F.col("fingerprint").alias("saved"), "version", "snapshot", "last_alert_at")
        met = linkages.join(saved, "linkage_id", "left")
        outcome = resume_outcome(F.col("fingerprint"), F.col("saved"), F.col("version"), F.col("snapshot"))
        met = met.withColumn("outcome", outcome).withColumn("snapshot", F.when(F.col("outcome") == "restored", F.col("snapshot")))
        return met.withColumn("ready", F.coalesce(F.get_json_object("snapshot", "$.seen").try_cast("long") >= READY, F.lit(False)))

    def alert_count(self, linkage_id: str | None = None) -> int:
        rows = self.alerts()
        return (rows if linkage_id is None else rows.where(F.col("linkage_id") == linkage_id)).count()
