"""Snapshots of the store: failed, repeated and concurrent writes, deletes without rewrites, batches of a stream."""

import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sensorloom.plans import maintenance, upload
from sensorloom.plans.upload import process_dataset
from sensorloom.sources.store import Change, Conflict, Store
from sensorloom.sources.tables import statuses
from sensorloom.streaming import ingest

HEADER = "machine_id,timestamp,temperature,pressure,vibration,rpm"


@pytest.fixture()
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "tables"))


def sensor_csv(path, machine="PUMP-1", n=30, spike=None):
    path.parent.mkdir(exist_ok=True)
    path.write_text("\n".join([HEADER, *[f"{machine},2026-05-01 {i // 2:02d}:{i % 2 * 30:02d}:00,{500 if i == spike else 60 + i % 3},30,2,1500"
                                        for i in range(n)]]))
    return str(path)


def readings(spark, machines, dataset):
    rows = [(m, dataset, float(i)) for m in machines for i in range(4)]
    return spark.createDataFrame(rows, "machine_id long, dataset_id long, temperature double")


def seen(store, name="sensor_readings"):
    return sorted((r["dataset_id"], r["machine_id"], r["temperature"]) for r in store.read(name).collect())


def files(store, name="sensor_readings"):
    return {str(p) for p in (Path(store.root) / name).rglob("*.parquet")}


def broken(df):
    return df.withColumn("temperature", F.raise_error(F.lit("broken row")).cast("double"))


def test_a_failed_rewrite_leaves_what_was_stored(spark, store):
    store.put_partitions("sensor_readings", readings(spark, [1, 2], 7))
    before, number = seen(store), store.snapshot().number
    with pytest.raises(Exception, match="broken row"):
        store.put_partitions("sensor_readings", broken(readings(spark, [1], 7)), [7])
    with pytest.raises(Exception, match="broken row"):
        store.replace("sensor_readings", broken(readings(spark, [1], 7)))
    assert seen(store) == before and store.snapshot().number == number


def test_a_failed_upload_leaves_the_earlier_one(spark, store, tmp_path, monkeypatch):
    first = process_dataset(store, sensor_csv(tmp_path / "in" / "a.csv", spike=20), 1)
    kept = {n: store.read(n).count() for n in ("sensor_readings", "anomalies", "etl_runs", "machines")}
    assert first and kept["anomalies"] > 0
    monkeypatch.setattr(upload, "write_anomalies", lambda *a, **b: (_ for _ in ()).throw(RuntimeError("sink is full")))
    assert process_dataset(store, sensor_csv(tmp_path / "in" / "a.csv", machine="NEW-1"), 1) is None
    row = statuses(store, "datasets").first()
    assert row["status"] == "failed" and "sink is full" in row["error"]
    assert kept == {n: store.read(n).count() for n in kept}
    assert [r["name"] for r in store.read("machines").collect()] == ["PUMP-1"]
    monkeypatch.undo()
    assert process_dataset(store, sensor_csv(tmp_path / "in" / "a.csv", n=12), 1)
    assert store.read("sensor_readings").count() == 12 and store.read("anomalies").count() == 0


def test_readers_keep_the_snapshot_they_began_with(spark, store):
    store.put_partitions("sensor_readings", readings(spark, [1, 2], 7))
    held = store.read("sensor_readings")
    store.put_partitions("sensor_readings", readings(spark, [3], 7))
    store.clear("sensor_readings")
    assert held.count() == 8 and store.read("sensor_readings").count() == 0


def test_one_number_goes_to_one_writer(spark, store):
    store.append("machines", spark.createDataFrame([(1, "a")], "id long, name string"))
    one, two = store.change(), store.change()
    for change, name in ((one, "b"), (two, "c")):
        change.append("machines", spark.createDataFrame([(2, name)], "id long, name string"))
        change.depends_on("machines")
    one.publish()
    with pytest.raises(Conflict):
        two.publish()
    free = store.change()  # a change that was computed from nothing is put on top of what came between
    free.append("machines", spark.createDataFrame([(3, "d")], "id long, name string"))
    store.append("machines", spark.createDataFrame([(4, "e")], "id long, name string"))
    free.publish()
    assert sorted(r["name"] for r in store.read("machines").collect()) == ["a", "b", "d", "e"]
    assert not store.publish(store.snapshot())


def test_concurrent_uploads_keep_all_rows_and_give_out_each_key_once(spark, store, tmp_path):
    paths = [sensor_csv(tmp_path / "in" / f"{i}.csv", machine=f"M-{i % 3}", n=10 + i) for i in range(4)]
    ids = [None] * 4
    def run(i):
        ids[i] = process_dataset(Store(spark, store.root), paths[i], i)
    threads = [threading.Thread(target=run, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert all(ids)
    counts = {r["dataset_id"]: r["count"] for r in store.read("sensor_readings").groupBy("dataset_id").count().collect()}
    assert counts == {i: 10 + i for i in range(4)}
    machines = store.read("machines").collect()
    assert len(machines) == len({r["id"] for r in machines}) == len({r["name"] for r in machines}) == 3
    assert store.read("etl_runs").count() == 4


def test_deleting_a_machine_writes_no_readings(spark, store):
    store.append("machines", spark.createDataFrame([(i, f"m{i}") for i in range(1, 9)], "id long, name string"))
    for dataset, machines in ((1, [1, 2, 3]), (2, [2, 3]), (3, [7, 8])):
        store.put_partitions("sensor_readings", readings(spark, machines, dataset))
        store.put_partitions("anomalies", readings(spark, machines, dataset).drop("temperature"))
    before, everything = files(store) | files(store, "anomalies"), seen(store)
    maintenance.delete_stored_machine(store, 2)
    assert files(store) | files(store, "anomalies") == before
    assert seen(store) == [r for r in everything if r[1] != 2]
    assert {r["machine_id"] for r in store.read("anomalies").collect()} == {1, 3, 7, 8}
    # parts whose range leaves the key out are read as they are
    content = store.content("sensor_readings")
    assert sorted(p.value for p in content.parts if content.hits(p)) == ["1", "2"]
    plan = store.frame("sensor_readings", content)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftAnti") == 1
    # a later upload may hold the key again; the rewrite equals what was read, and forgets the note
    store.put_partitions("sensor_readings", readings(spark, [2], 2), [2])
    after = seen(store)
    assert [r for r in after if r[0] == 2] == [(2, 2, float(i)) for i in range(4)]
    store.compact("sensor_readings")
    assert seen(store) == after and store.content("sensor_readings").deletes == ()


def test_notes_go_when_no_part_needs_them(spark, store):
    store.put_partitions("sensor_readings", readings(spark, [1, 2], 1))
    store.delete_keys("sensor_readings", [1, 50])
    assert [k for k, _ in store.content("sensor_readings").deletes] == [1]
    store.put_partitions("sensor_readings", readings(spark, [5], 1))
    store.delete_keys("sensor_readings", [])
    assert store.content("sensor_readings").deletes == ()


def test_odd_partition_values_come_back(spark, store):
    names = ["a/b=c", "100% [x] {y}*?", "füße #1", "", None, "007"]
    rows = spark.createDataFrame([(str(i), n, "t") for i, n in enumerate(names)], "id string, source string, text string")
    store.put_partitions("manuals", rows)
    # an empty name cannot be told from none in a folder's name
    assert {r["id"]: r["source"] for r in store.read("manuals").collect()} == {
        str(i): n or None for i, n in enumerate(names)}
    store.drop_partition("manuals", "100% [x] {y}*?")
    store.drop_partition("manuals", None)
    assert sorted(r["source"] for r in store.read("manuals").collect()) == ["007", "a/b=c", "füße #1"]


def test_known_machines_are_not_written_again(spark, store, tmp_path):
    process_dataset(store, sensor_csv(tmp_path / "in" / "a.csv"), 1)
    listing = store.snapshot().tables["machines"]
    process_dataset(store, sensor_csv(tmp_path / "in" / "b.csv", n=8), 2)
    assert store.snapshot().tables["machines"] == listing


def state(store):
    found = sorted((r["filename"], r["status"], r["row_count"]) for r in statuses(store, "datasets").collect())
    return found, store.read("sensor_readings").count(), store.read("etl_runs").count()


def test_a_batch_leaves_one_of_each(spark, store, tmp_path, monkeypatch):
    """A good, a bad and a raising file; a batch that broke off, and one that is delivered twice."""
    folder = tmp_path / "in"
    for name in ("good.csv", "fine.csv"):
        sensor_csv(folder / name)
    sensor_csv(folder / "boom.csv", machine="BOOM")
    (folder / "bad.csv").write_text("machine_id,timestamp\nx,1")
    (folder / "useless.csv").write_text(f"{HEADER}\nPUMP-1,someday,1,2,3,4")
    lines = spark.read.text(str(folder)).select("value", F.col("_metadata.file_path").alias("file"))
    plain = upload.transform

    def raising(raw, *more):
        boom = F.when(F.col("machine_id") == "BOOM", F.raise_error(F.lit("boom"))).otherwise(F.col("temperature"))
        return plain(raw.withColumn("temperature", boom.cast("string")), *more)

    monkeypatch.setattr(upload, "transform", raising)
    # the driver dies before the batch is published
    publish = Change.publish

    def dying_publish(change):
        if change.marks:
            raise KeyboardInterrupt
        publish(change)

    with monkeypatch.context() as dying:
        dying.setattr(Change, "publish", dying_publish)
        with pytest.raises(KeyboardInterrupt):
            ingest.process_batch(store, lines, batch=0)
    assert store.read("sensor_readings").count() == 0 and store.read("etl_runs").count() == 0
    want = ([("bad.csv", "failed", None), ("boom.csv", "failed", None), ("fine.csv", "completed", 30), ("good.csv", "completed", 30),
             ("useless.csv", "failed", None)], 60, 2)
    for _ in range(2):
        ingest.process_batch(store, lines, batch=0)
        assert state(store) == want
    errors = {r["filename"]: r["error"] for r in statuses(store, "datasets").collect()}
    assert "boom" in errors["boom.csv"] and "missing required column" in errors["bad.csv"] and "readable" in errors["useless.csv"]
