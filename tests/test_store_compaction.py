"""Packing of the log's batches: nothing lost or doubled, whoever stops where."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from spreadwatch.sources.store import Store


def batch(spark, n, rows=3):
    at = datetime(2025, 1, 1) + timedelta(hours=n)
    found = [(f"l{i}", at, "f", 1.0 + n, 2.0, 3.0 * i, False) for i in range(rows)]
    return spark.createDataFrame(found, "linkage_id string, ts timestamp, fingerprint string, reference_price double, fair_value double, spread_bps double, stale boolean")


def seen(store):
    return sorted(tuple(r) for r in store.observations().select("run", "batch", "linkage_id", "ts", "spread_bps").collect())


def folders(path, name):
    return sorted(f"{p.parent.name}/{p.name}" for p in (path / "store" / name).glob("run=*/batch=*"))


def test_compaction_keeps_every_row(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    assert store.compact("observations") == 0
    for run, batches in (("0", 5), ("b c", 3), ("one", 1)):
        for n in range(batches):
            store.record_observations(batch(spark, n), n, run)
    before = seen(store)
    assert len(before) == 27 and store.compact("observations") == 6
    assert seen(store) == before and len(folders(tmp_path, "observations")) == 9
    # the newest batch of a run may come again, with other rows; packed ones are deleted by the next compaction
    store.record_observations(batch(spark, 4, 2), 4, "0")
    store.record_observations(batch(spark, 5), 5, "0")
    assert len(seen(store)) == 29 and store.compact("observations") == 1
    assert len(seen(store)) == 29 and len(folders(tmp_path, "observations")) == 4
    assert store.compact("observations") == 0 and len(folders(tmp_path, "observations")) == 3
    assert len(seen(store)) == 29 and Store(spark, f"file://{tmp_path}/store").observations().where(F.col("run") == "0").count() == 17


def test_stopped_and_concurrent_compactions(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/store")
    for n in range(4):
        store.record_observations(batch(spark, n), n)
    before = seen(store)
    # stopped before its manifest: the folder counts for nothing; stopped within it: the number is taken, nothing else
    spark.range(3).write.parquet(f"file://{tmp_path}/store/observations_packed/dead")
    manifests = tmp_path / "store" / "observations_packed" / "manifests"
    manifests.mkdir()
    (manifests / "000000000001.json").write_text('{"folders": ["dead"')
    assert seen(store) == before
    stale = store._manifest("observations")
    assert store.compact("observations") == 3 and seen(store) == before
    late = Store(spark, f"file://{tmp_path}/store")
    monkeypatch.setattr(late, "_manifest", lambda name: stale)
    packed = sorted(p.name for p in manifests.parent.iterdir())
    with pytest.raises(RuntimeError):
        late.compact("observations")
    assert seen(store) == before and sorted(p.name for p in manifests.parent.iterdir()) == packed
