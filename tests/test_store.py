"""Stored tables: uploads, re-detection, streams, deletes, exports, registries."""

import csv
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sensorloom.operators import records
from sensorloom.plans import maintenance
from sensorloom.plans.redetect import rerun_detection
from sensorloom.plans.upload import process_dataset
from sensorloom.schema import TABLES
from sensorloom.sources import exports
from sensorloom.sources.store import Store
from sensorloom.sources.synth import synth_sensors
from sensorloom.sources.tables import read_readings, set_status, statuses
from sensorloom.streaming.ingest import ingest_stream

COLUMNS = ["timestamp", "machine_id", "temperature", "pressure", "vibration", "rpm"]


@pytest.fixture(scope="module")
def sample(spark, tmp_path_factory):
    """The synthetic set as CSV text lines."""
    rows = synth_sensors(spark).orderBy("machine_id", "timestamp").collect()
    return [",".join(COLUMNS)] + [",".join("" if r[c] is None else str(r[c]) for c in COLUMNS) for r in rows]


@pytest.fixture()
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "tables"))


def write(folder: Path, name: str, lines) -> str:
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")
    return str(folder / name)


def status_of(store):
    return {r["id"]: r for r in statuses(store, "datasets").collect()}


def test_upload_rerun_export_and_delete(spark, store, sample, tmp_path):
    path = write(tmp_path / "in", "sample.csv", sample)
    assert rerun_detection(store, "zscore") == {"error": "No sensor data to analyze. Upload a CSV first."}
    run_id = process_dataset(store, path, 1)
    assert run_id and status_of(store)[1]["status"] == "completed" and status_of(store)[1]["row_count"] == 960
    assert store.read("sensor_readings").count() == 960 and store.read("machines").count() == 4
    run = store.read("etl_runs").first()
    assert run["metrics"]["rows"] == 960 and run["metrics"]["machines"] == 4 and run["params"]["method"] == "upload"
    found = store.read("anomalies")
    pump = store.read("machines").filter("name = 'PUMP-001'").first()["id"]
    assert not found.filter((F.col("machine_id") == pump) & (F.col("severity") == "HIGH")).isEmpty()
    assert run["metrics"]["anomalies_detected"] == found.count()

    # the same upload again leaves one copy; a second one appends under its own dataset and keeps machine keys
    process_dataset(store, path, 1)
    process_dataset(store, write(tmp_path / "in", "two.csv", sample[:241]), 2)
    assert store.read("sensor_readings").groupBy("dataset_id").count().orderBy("dataset_id").collect() == [(1, 960), (2, 240)]
    assert store.read("machines").count() == 4

    result = rerun_detection(store, "iqr", 3.0, 10)
    assert result["metrics"]["rows"] == 1200 and result["params"]["method"] == "iqr"
    assert {r["method"] for r in store.read("anomalies").select("method").distinct().collect()} == {"iqr"}
    assert store.read("etl_runs").filter("params.method = 'iqr'").first()["dataset_id"] == 2

    out = str(tmp_path / "out")
    exports.export_sensors(store.read("sensor_readings"), store.read("machines"), out)
    parts = sorted(Path(out).glob("part-*.csv"))
    lines = [row for part in parts for row in list(csv.DictReader(part.open()))]
    assert len(lines) == 1200 and list(lines[0]) == ["machine", "timestamp", *exports.PARAMETERS, *exports.ROLLING]
    assert [r["timestamp"] for r in lines] == sorted(r["timestamp"] for r in lines)
    exports.export_anomalies(store.read("anomalies"), store.read("machines"), str(tmp_path / "out2"))
    assert list(Path(tmp_path / "out2").glob("part-*.csv"))

    maintenance.delete_stored_dataset(store, 1)
    assert store.read("sensor_readings").count() == 240
    assert store.read("machines").count() == 1  # the second file holds one machine only
    assert set(status_of(store)) == {2}
    left = store.read("machines").first()["id"]
    maintenance.delete_stored_machine(store, left)
    assert store.read("sensor_readings").isEmpty() and store.read("machines").isEmpty()
    maintenance.reset_tables(store)
    assert all(store.read(name).isEmpty() for name in TABLES)


def test_failed_upload_is_reported(store, tmp_path):
    assert process_dataset(store, write(tmp_path / "in", "bad.csv", ["timestamp,machine_id", "1,2"]), 5) is None
    row = status_of(store)[5]
    assert row["status"] == "failed" and "missing required column" in row["error"] and len(row["error"]) <= 2000


def test_stream_takes_each_file_once(spark, store, sample, tmp_path):
    folder = tmp_path / "drop"
    write(folder, "one.csv", sample)
    write(folder, "bad.csv", ["timestamp,machine_id", "1,2"])
    write(folder, "notes.txt", ["not a csv"])
    for _ in range(2):
        ingest_stream(spark, str(folder), store, str(tmp_path / "check")).awaitTermination()
        assert store.read("sensor_readings").count() == 960
    write(folder, "two.CSV", [",".join(reversed(COLUMNS))] + [",".join(reversed(line.split(","))) for line in sample[1:]])
    ingest_stream(spark, str(folder), store, str(tmp_path / "check")).awaitTermination()
    assert store.read("sensor_readings").count() == 1920
    found = sorted((r["filename"], r["status"], r["row_count"]) for r in status_of(store).values())
    assert found == [("bad.csv", "failed", None), ("one.csv", "completed", 960), ("two.CSV", "completed", 960)]
    # each file is its own series: both give the same anomalies
    counts = [r["count"] for r in store.read("anomalies").groupBy("dataset_id").count().collect()]
    assert len(counts) == 2 and counts[0] == counts[1] > 0


def test_replace_while_reading_and_partition_drop(spark, store):
    rows = spark.range(10).select(F.col("id").alias("machine_id"), (F.col("id") % 2).alias("dataset_id"))
    store.append("anomalies", rows)
    store.replace("anomalies", store.read("anomalies").filter("machine_id > 3"))
    assert store.read("anomalies").count() == 6
    store.drop_partition("anomalies", 1)
    assert {r["dataset_id"] for r in store.read("anomalies").collect()} == {0}
    store.replace("anomalies", rows)
    assert store.read("anomalies").count() == 10


def test_manuals(spark, store):
    pages = spark.createDataFrame([(1, "1. Motors\nRun cool."), (2, " "), (3, "More.")], "page int, text string")
    assert maintenance.ingest_manual(store, pages, 1, "m.pdf") == 2
    assert maintenance.ingest_manual(store, pages, 1, "m.pdf") == 2
    assert store.read("manuals").count() == 2
    assert statuses(store, "documents").first()["chunk_count"] == 2
    maintenance.delete_manual(store, "m.pdf")
    assert store.read("manuals").isEmpty()
    maintenance.reset_chunks(store)


def test_status_steps(spark, store):
    one = spark.createDataFrame([(1,)], "id long")
    for status in ("pending", "processing", "completed"):
        set_status(store, "datasets", one, status)
    assert statuses(store, "datasets").first()["status"] == "completed"
    with pytest.raises(ValueError):
        set_status(store, "datasets", one, "lost")


def test_machine_keys_follow_sorted_names(spark):
    machines = spark.createDataFrame([(5, "PUMP-B", "Hydraulic Pump")], "id long, name string, machine_type string")
    names = spark.createDataFrame([("valve z",), ("PUMP-B",), ("Motor a",), ("Motor a",), (None,)], "name string")
    found = {r["name"]: (r["id"], r["machine_type"]) for r in records.upsert_machines(names, machines).collect()}
    assert found == {"PUMP-B": (5, "Hydraulic Pump"), "Motor a": (6, "Motor"), "valve z": (7, "Valve")}


def test_log_changes_fold_in_time_order(spark):
    logs = spark.createDataFrame([(1, False, "a", None), (2, True, "b", 5), (3, False, "c", None)],
                                 "id long, actioned boolean, notes string, actioned_at long")
    changes = spark.createDataFrame(
        [(1, 10, True, None, None), (1, 11, None, "x", None), (1, 12, None, "y", None), (2, 10, False, None, None),
         (3, 10, None, None, True)], "id long, changed_at long, actioned boolean, notes string, deleted boolean")
    found = {r["id"]: (r["actioned"], r["notes"], r["actioned_at"])
             for r in records.apply_log_changes(logs, changes).collect()}
    assert found == {1: (True, "y", 10), 2: (False, "b", None)}


def test_newest_first_for_one_user(spark):
    rows = spark.createDataFrame([(1, 7, 10), (2, 7, 30), (3, 8, 20)], "id long, user_id long, at long")
    assert [r["id"] for r in records.newest_first(rows, "at").collect()] == [2, 3, 1]
    assert [r["id"] for r in records.newest_first(rows, "at", user_id=7).collect()] == [2, 1]


def test_stored_readings_scan(spark, store, sample, tmp_path):
    process_dataset(store, write(tmp_path / "in", "s.csv", sample[:50]), 1)
    rows = read_readings(store)
    assert rows.count() == 49 and "temperature_roc" not in rows.columns
