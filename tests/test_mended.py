"""Cases that once gave wrong answers: gaps, divided series, repeated uploads, layouts, replies."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorloom.functions.cleaning import parse_ts
from sensorloom.operators import forest
from sensorloom.operators.detectors import detect
from sensorloom.operators.ewma import ewma
from sensorloom.operators.retrieval import nearest
from sensorloom.operators.verdicts import coerce_replies
from sensorloom.plans.maintenance import delete_manual, delete_stored_dataset, ingest_manual
from sensorloom.plans.upload import process_dataset
from sensorloom.scale import Scale, attach
from sensorloom.sources.csv import read_sensor_csv
from sensorloom.sources.store import Store
from sensorloom.sources.tables import statuses

START = datetime.datetime(2026, 1, 1)


def series(spark, values):
    rows = [(1, 1, "p", START + datetime.timedelta(minutes=i), i, None if v is None or np.isnan(v) else float(v))
            for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "machine_id long, dataset_id long, parameter string, ts timestamp_ntz, row_id long, value double")


@pytest.mark.parametrize("window", [2, 10, 60])
def test_ewma_over_a_long_gap_equals_pandas(spark, window):
    rng = np.random.default_rng(window)
    values = np.concatenate([rng.normal(50, 5, 90), np.full(4000, np.nan), rng.normal(50, 5, 90), np.full(700, np.nan), [60.0, 61.0]])
    want = pd.Series(values).ewm(span=window, adjust=False).mean().to_numpy()
    found = {r["row_id"]: r["ewma"] for r in ewma(series(spark, values), window).collect()}
    there = np.flatnonzero(~np.isnan(values))
    assert sorted(found) == there.tolist()
    assert np.allclose([found[i] for i in there], want[there], rtol=1e-9)


def test_forest_gives_one_answer_however_a_series_is_divided(spark, monkeypatch):
    monkeypatch.setattr(forest, "POOL", 300)
    values = np.random.default_rng(4).normal(20, 3, 1500)
    values[::200] += 40
    def rows(scale):
        found = detect(series(spark, values), "isolation_forest", 2.0, scale=scale).collect()
        return {r["row_id"]: round(r["z_score"], 6) for r in found}
    whole, split = rows(Scale()), rows(Scale(task_rows=400, small_bytes=0))
    assert whole and whole == split


def test_attach_broadcasts_only_what_it_counted(spark):
    rows, side = spark.range(2).withColumnRenamed("id", "k"), spark.range(3000).withColumnRenamed("id", "k")
    def plan(limit):
        return attach(rows, side, ["k"], Scale(small_bytes=0, broadcast_rows=limit))._jdf.queryExecution().analyzed().toString()
    assert "strategy=broadcast" not in plan(100) and "strategy=broadcast" in plan(5000)


def sensor_csv(path, rows, header="machine_id,timestamp,temperature,pressure,vibration,rpm"):
    path.write_text("\n".join([header, *rows]))
    return str(path)


def readings(n=48, spike=None, stamp="2026-05-01 {h:02d}:{m:02d}:00"):
    return [f"PUMP-1,{stamp.format(h=i // 2 % 24, m=i % 2 * 30)},{500 if i == spike else 60 + i % 3},30,2,1500" for i in range(n)]


def test_corrected_upload_leaves_no_anomalies_and_deleted_data_can_return(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    file = sensor_csv(tmp_path / "a.csv", readings(spike=20))
    process_dataset(store, file, 1)
    assert store.read("anomalies").count() > 0
    sensor_csv(tmp_path / "a.csv", readings())
    process_dataset(store, file, 1)
    assert store.read("anomalies").count() == 0 and store.read("sensor_readings").count() == 48
    delete_stored_dataset(store, 1)
    assert store.read("sensor_readings").count() == 0
    process_dataset(store, file, 1)
    assert store.read("sensor_readings").count() == 48
    store.drop_partition("sensor_readings", 77)
    nobody = store.read("sensor_readings").withColumn("dataset_id", F.lit(None).cast("long"))
    store.put_partitions("sensor_readings", nobody)
    assert store.read("sensor_readings").count() == 96
    store.compact("sensor_readings")
    assert store.read("sensor_readings").count() == 96


def test_manual_can_be_replaced_and_emptied(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    pages = spark.createDataFrame([(1, "Pump care.\nOil it weekly. " * 20)], "page int, text string")
    blank = spark.createDataFrame([(1, " ")], "page int, text string")
    first = ingest_manual(store, pages, 1, "m.pdf")
    delete_manual(store, "m.pdf")
    assert store.read("manuals").count() == 0
    assert ingest_manual(store, pages, 1, "m.pdf") == first > 0
    assert ingest_manual(store, blank, 1, "m.pdf") == 0 and store.read("manuals").count() == 0


def test_upload_without_a_usable_row_fails(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    process_dataset(store, sensor_csv(tmp_path / "a.csv", readings(stamp="someday {h}{m}")), 1)
    assert [r["status"] for r in statuses(store, "datasets").collect()] == ["failed"]


def test_columns_are_never_read_by_position(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    sensor_csv(folder / "a.csv", ["P-1,2026-01-01 00:00:00,1,2,3,4"])
    sensor_csv(folder / "b.csv", ["2026-01-01 00:00:00,P-2,1,2,3,4"], "timestamp,machine_id,temperature,pressure,vibration,rpm")
    with pytest.raises(Exception, match="header"):
        read_sensor_csv(spark, [str(folder / "a.csv"), str(folder / "b.csv")]).collect()


@pytest.mark.parametrize(("text", "want"), [
    ("5/1/2026 3:00", "2026-05-01T03:00:00"), ("05/01/2026", "2026-05-01T00:00:00"), ("05/01/2026 03:00:00 PM", "2026-05-01T15:00:00"),
    ("01.05.2026 10:00", "2026-05-01T10:00:00"), ("2026-05-01T00:00:00+02:00", "2026-04-30T22:00:00"), ("2026-05-01", "2026-05-01T00:00:00"),
    ("2026/05/01 10:00", "2026-05-01T10:00:00"), ("2026-05-01 10:00:00", "2026-05-01T10:00:00"), ("31/31/2026", None), ("soon", None)])
def test_time_layouts(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(parse_ts(F.col("t"))).first()[0]
    assert (got and got.isoformat()) == want


def test_rows_without_a_vector_are_near_to_nothing(spark):
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, embedding array<double>")
    chunks = spark.createDataFrame([(7, [1.0, 0.1]), (8, None)], "id long, embedding array<double>")
    assert [(r["query_id"], r["id"]) for r in nearest(queries, chunks).collect()] == [(1, 7)]


@pytest.mark.parametrize(("reply", "explanation"), [
    ('\n{"verdict": "SAFE\\n", "explanation": "fine"}\n', "fine"), ("{'verdict': 'SAFE', 'explanation': 'fine'}", None),
    ('{"verdict": "SAFE", "explanation": "fine"} trailing', None), ('{"verdict": "SAFE"}, {"verdict": "SAFE"}', None)])
def test_replies_are_strict_json(spark, reply, explanation):
    row = coerce_replies(spark.createDataFrame([(reply, "HIGH")], "reply string, digest string"), "reply").first()
    if explanation:
        assert (row["verdict"], row["explanation"]) == ("SAFE", explanation)
    else:
        assert row["explanation"].startswith("[fallback]")
