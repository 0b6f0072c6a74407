"""Plans for series too long for one task give what the plain plans give."""

import datetime as dt

import numpy as np
import pytest
from oracle import bag
from pyspark.sql import functions as F

from sensorloom.operators import features
from sensorloom.operators.detectors import detect, detect_upload
from sensorloom.operators.ewma import ewma
from sensorloom.operators.ordered import ordered, with_index
from sensorloom.operators.series import quantiles, quartiles, series_profile
from sensorloom.scale import Scale, long_series

TINY = Scale(task_rows=40, small_bytes=0, broadcast_rows=5, quantile_accuracy=10)
PARAMETERS = ["temperature", "pressure", "vibration", "rpm"]


@pytest.fixture(scope="module")
def readings(spark):
    """One machine with a third of all rows, in bursts and with an outlying first time."""
    rng = np.random.default_rng(7)
    rows, start, row_id = [], dt.datetime(2026, 1, 1), 0
    for machine, size in ((1, 600), *((m, 40 + m) for m in range(2, 27))):
        seconds = np.sort(np.concatenate([rng.integers(0, 3600 * 5, size - size // 2),
                                          rng.integers(3600 * 40, 3600 * 41, size // 2)]))
        if machine == 1:
            seconds[0] = -3600 * 24 * 365 * 50
        for s in seconds:
            values = [None if rng.random() < 0.3 else float(rng.normal(50, 10)) for _ in PARAMETERS]
            if machine == 1 and row_id < 150:
                values[3] = None
            rows.append((machine, 1, start + dt.timedelta(seconds=int(s)), row_id, *values))
            row_id += 1
    frame = spark.createDataFrame(rows, "machine_id long, dataset_id long, ts timestamp_ntz, row_id long, "
                                  + ", ".join(f"{p} double" for p in PARAMETERS))
    return frame.repartition(4).cache()


@pytest.fixture(scope="module")
def series(readings):
    return features.fill_gaps(readings).unpivot(
        ["machine_id", "dataset_id", "ts", "row_id"], PARAMETERS, "parameter", "value").cache()


def same(a, b, places=9):
    assert sorted(a.columns) == sorted(b.columns)
    doubles = [c for c, t in a.dtypes if t == "double"]
    a, b = (x.withColumns({c: F.round(c, places) for c in doubles}).select(*sorted(a.columns)) for x in (a, b))
    left, right = bag(a.columns, a.collect()), bag(b.columns, b.collect())
    assert left == right and sum(left.values()) > 0


def test_hot_machine_is_cut_into_bounded_spans(readings):
    found = long_series(readings, ["machine_id"], "ts", TINY).collect()
    assert {r["machine_id"] for r in found} >= {1}
    o = ordered(readings, ["machine_id"], look_back=5, scale=TINY)
    assert o.split
    sizes = o.frame.groupBy(*o.partition).count().agg(F.max("count")).first()[0]
    assert sizes <= TINY.task_rows + 5
    assert o.done(o.frame).count() == readings.count()


def test_index(readings):
    same(with_index(readings, ["machine_id"], scale=TINY).select("row_id", "idx"),
         with_index(readings, ["machine_id"]).select("row_id", "idx"))


@pytest.mark.parametrize("step", ["fill_forward", "fill_backward", "fill_gaps", "rolling_mean", "rate_of_change"])
def test_feature_steps(readings, step):
    run = getattr(features, step)
    same(run(readings, scale=TINY), run(readings))


def test_transform(readings):
    raw = readings.withColumnRenamed("ts", "timestamp")
    same(features.transform(raw, 7, scale=TINY), features.transform(raw, 7))


@pytest.mark.parametrize("method, threshold, window", [
    ("zscore", 2.0, 10), ("rolling_z", 2.0, 10), ("rolling_z", 2.0, 30), ("ewma", 2.0, 3), ("ewma", 2.0, 10), ("iqr", 2.0, 10)])
def test_detectors(series, method, threshold, window):
    same(detect(series, method, threshold, window, TINY), detect(series, method, threshold, window), places=6)


def test_detectors_with_nulls(readings):
    for method in ("zscore", "rolling_z", "ewma"):
        same(detect(readings, method, 1.5, 6, TINY), detect(readings, method, 1.5, 6), places=6)


def test_upload(series):
    same(detect_upload(series, 2.0, scale=TINY), detect_upload(series, 2.0), places=6)


def test_ewma_values(series):
    same(ewma(series, 10, scale=TINY).select("row_id", "parameter", "ewma"),
         ewma(series, 10).select("row_id", "parameter", "ewma"), places=7)


def test_profile(series):
    same(series_profile(series, scale=TINY), series_profile(series), places=7)


def test_quantiles(series):
    same(quartiles(series, scale=TINY), quartiles(series))
    same(quantiles(series, [0.0, 0.06, 0.5, 0.94, 1.0], scale=TINY), quantiles(series, [0.0, 0.06, 0.5, 0.94, 1.0]))
    tied = series.withColumn("value", F.round(F.col("value") / 20))
    same(quartiles(tied, scale=TINY), quartiles(tied))


def test_forest_flags_the_extremes_of_the_hot_series(series):
    planted = series.withColumn("value", F.when((F.col("row_id") == 300) & (F.col("parameter") == "rpm"), 500.0)
                                .otherwise(F.col("value")))
    found = detect(planted, "isolation_forest", 3.0, scale=TINY)
    assert not found.filter("row_id = 300 and parameter = 'rpm'").isEmpty()
    share = found.filter("machine_id = 1").count() / (600 * 4)
    assert abs(share - 0.06) <= 0.02
    # every row is in the sample of a short series, so both plans fit the same trees
    same(found, detect(planted, "isolation_forest", 3.0), places=6)
