"""Detector behaviour against pandas and planted signals."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import sensorloom.operators.forest as forest
from sensorloom.functions.scoring import flag, severity, severity_fixed
from sensorloom.operators import detectors
from sensorloom.operators.detectors import detect, detect_upload, register_method, validate_params
from sensorloom.operators.ewma import ewma, look_back_rows
from sensorloom.operators.series import trend_slope

PARTS = "machine_id long, parameter string, ts timestamp_ntz, row_id long, value double"


def series(spark, values, machine=1):
    times = pd.date_range("2026-01-01", periods=len(values), freq="h").to_pydatetime()
    rows = [(machine, "value", t, i, None if v is None or v != v else float(v))
            for i, (t, v) in enumerate(zip(times, values))]
    return spark.createDataFrame(rows, PARTS)


def wide(spark, temperature):
    frame = series(spark, temperature).withColumnRenamed("value", "temperature").drop("parameter")
    return frame.withColumns({"pressure": F.lit(100.0), "vibration": F.lit(1.0), "rpm": F.lit(1500.0),
                              "dataset_id": F.lit(1).cast("long")})


def spike():
    values = 60 + np.random.default_rng(0).normal(0, 0.5, 60)
    values[55] = 120.0
    return values


def test_severity_cuts(spark):
    scores = spark.createDataFrame([(5.0,), (4.5,), (3.8,), (3.1,)], "s double")
    assert [r[0] for r in scores.select(severity(F.col("s"), 3.0)).collect()] == ["HIGH", "HIGH", "MEDIUM", "MONITOR"]
    fixed = spark.createDataFrame([(1.5,), (0.75,), (0.7,)], "s double")
    assert [r[0] for r in fixed.select(severity_fixed(F.col("s"))).collect()] == ["HIGH", "MEDIUM", "MONITOR"]


def test_nan_is_no_anomaly(spark):
    scores = spark.createDataFrame([(float("nan"),), (None,), (3.0,), (2.9,)], "s double")
    assert [r[0] for r in scores.select(flag(F.col("s"), 3.0)).collect()] == [False, False, True, False]


def test_upload_finds_the_spike_and_keeps_its_sign(spark):
    found = detect_upload(wide(spark, spike())).collect()
    assert any(r["value"] == 120.0 and r["parameter"] == "temperature" and r["z_score"] > 0 for r in found)
    low = detect_upload(wide(spark, 120 - spike())).filter("value = 0").first()
    assert low["z_score"] < -4.5 and low["severity"] == "HIGH"


@pytest.mark.parametrize("method", ["zscore", "rolling_z", "ewma", "iqr", "isolation_forest"])
def test_every_method_finds_the_spike_and_nothing_on_flat_signals(spark, method):
    found = detect(wide(spark, spike()), method).collect()
    assert any(r["value"] == 120.0 for r in found)
    assert {r["parameter"] for r in found} == {"temperature"}
    # 60.1 has no exact binary form, so its computed deviation is not exactly zero
    assert detect(wide(spark, [60.1] * 40), method).isEmpty()


def test_too_few_points(spark):
    assert detect(series(spark, [1, 1, 1, 50]), "zscore", 1.0).isEmpty()
    assert detect_upload(series(spark, [1, 50]), 1.0).isEmpty()
    assert not detect_upload(series(spark, [1, 1, 50]), 1.0).isEmpty()


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.floats(-1e4, 1e4).map(lambda v: round(v, 2))), min_size=1, max_size=400),
       st.sampled_from([1, 2, 3, 10, 60]))
def test_ewma_equals_pandas_with_gaps(spark, values, window):
    found = {r["row_id"]: r["ewma"] for r in ewma(series(spark, values), window).collect()}
    column = pd.Series(values, dtype="float64")
    expected = column.ewm(span=window, adjust=False).mean()
    assert set(found) == set(column[column.notna()].index)
    for i, value in found.items():
        assert value == pytest.approx(expected[i], rel=1e-9, abs=1e-7)


def test_ewma_over_many_chunks(spark):
    values = np.random.default_rng(1).normal(50, 10, 3000)
    for window in (2, 10, 60):
        found = ewma(series(spark, values), window).orderBy("row_id").toPandas()["ewma"]
        assert np.allclose(found, pd.Series(values).ewm(span=window, adjust=False).mean(), rtol=0, atol=1e-9)
    assert look_back_rows(1) == 0 and look_back_rows(60) > look_back_rows(10) > 100


def test_trailing_z_equals_pandas(spark):
    values = pd.Series(np.random.default_rng(2).normal(0, 1, 300)).mask(lambda s: s.index % 7 == 3)
    base = values.shift(1)
    score = ((values - base.rolling(8, 4).mean()) / base.rolling(8, 4).std()).abs()
    found = {r["row_id"]: r["z_score"] for r in detect(series(spark, values.tolist()), "rolling_z", 2.0, 8).collect()}
    expected = score[score >= 2.0]
    assert found == pytest.approx(expected.to_dict())


def test_slope_against_polyfit(spark):
    values = np.random.default_rng(3).normal(0, 1, 50) + np.arange(50) * 0.1
    expected = np.polyfit(np.arange(50), values, 1)[0] * 50 / values.std()
    assert trend_slope(series(spark, values)).first()["trend_slope"] == pytest.approx(expected)
    falling = detect(series(spark, [*(-values), -200.0]), "zscore").first()
    assert falling["is_trending"] and falling["trend_slope"] < -1
    assert trend_slope(series(spark, [60.1] * 9)).first()["trend_slope"] == 0.0


@pytest.mark.parametrize("args", [("nope", 3.0, 10), ("zscore", 0.5, 10), ("zscore", 6.5, 10), ("zscore", 3.0, 0),
                                  ("zscore", 3.0, 61), ("rolling_z", 3.0, 2)])
def test_parameter_guards(args):
    with pytest.raises(ValueError):
        validate_params(*args)


def test_own_method(spark):
    def above(o, threshold, window, scale):
        rows = detectors.profiled(o, scale).filter(F.col("value") > threshold)
        return rows.withColumn("score", F.col("value")).withColumn("severity", F.lit("HIGH"))

    register_method("above", above)
    try:
        assert detect(series(spark, [1, 2, 5, 6]), "above", 4.0).count() == 2
    finally:
        del detectors.REGISTRY["above"], detectors.LOOK_BACK["above"]


def test_forest_properties(spark):
    values = np.random.default_rng(4).normal(50, 5, 900)
    values[[10, 500]] = [150.0, -60.0]
    frame = series(spark, values)
    first = detect(frame, "isolation_forest", 3.0).orderBy("row_id").collect()
    again = detect(frame.repartition(7), "isolation_forest", 3.0).orderBy("row_id").collect()
    assert [(r["row_id"], r["z_score"]) for r in first] == [(r["row_id"], r["z_score"]) for r in again]
    assert {10, 500} <= {r["row_id"] for r in first}
    assert abs(len(first) / 900 - forest.contamination(3.0)) <= 0.02
    assert all(r["z_score"] >= 0.5 for r in first)
    assert forest.contamination(1.0) == 0.02 and forest.contamination(20.0) == 0.25


def test_forest_score_is_the_mean_over_its_trees():
    values = np.sort(np.random.default_rng(5).normal(0, 1, 40))
    edges, paths = forest.fit(values)
    assert len(paths) == len(edges) and edges[0] == -np.inf and np.all(np.diff(edges) >= 0)
    # the extremes are easier to isolate than the middle
    raw = forest.raw_score(forest.paths_of(values, edges, paths), len(values))
    assert np.all((0 < raw) & (raw < 1))
    assert min(raw[0], raw[-1]) > raw[18:22].max()


def walked(value, sample, share, limit):
    """Path length of a value down one tree, in millionths, from the definition."""
    node, depth, inside = 1, 0, sorted(sample)
    while inside[0] < inside[-1] and depth < limit:
        at = inside[0] + share(node) * (inside[-1] - inside[0])
        at = at if at < inside[-1] else inside[0]
        right = value > at
        inside = [x for x in inside if (x > at) == right]
        node, depth = 2 * node + right, depth + 1
    return depth * forest.UNIT + int(np.rint(float(forest.mean_path(len(inside))) * forest.UNIT))


@pytest.mark.parametrize("n", [5, 40, 300])
def test_forest_equals_a_walk_down_every_tree(n):
    random = np.random.default_rng(n)
    pool = np.round(random.normal(0, 1, n), 1)  # ties
    edges, paths = forest.fit(pool)
    size = min(forest.SAMPLE, n)
    limit = int(np.ceil(np.log2(size)))
    for value in [*random.choice(pool, 4), 0.033, -50.0, 50.0]:
        want = sum(walked(value, [pool[(t * size + j) % n] for j in range(size)],
                          lambda node, t=t: forest.fraction_of(f"{forest.SEED}:{t}:{node}"), limit) for t in range(forest.TREES))
        assert forest.paths_of(np.array([value]), edges, paths)[0] == want


def test_side_by_side_equals_one_by_one(spark):
    values = np.random.default_rng(8).normal(0, 1, 300)
    values[::60] += 9
    values[7] = np.nan
    frame = series(spark, values).unionByName(series(spark, spike(), 2)).unionByName(series(spark, [1.0] * 50, 3))
    frame = frame.withColumn("dataset_id", F.lit(1).cast("long"))
    frame = spark.createDataFrame(frame.collect(), frame.schema)
    methods = list(detectors.REGISTRY)
    both = detectors.side_by_side(frame, methods, 2.5, 8)
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union") == 1  # rows and breakpoints, not one branch for each method
    def rows(df):
        return sorted((r["method"], r["machine_id"], r["row_id"], round(r["z_score"], 9), r["severity"], r["is_trending"]) for r in df.collect())
    found = rows(both)
    assert {x[0] for x in found} == set(methods) == {"zscore", "rolling_z", "ewma", "iqr", "isolation_forest"}
    assert found == sorted(x for m in methods for x in rows(detect(frame, m, 2.5, 8)))
