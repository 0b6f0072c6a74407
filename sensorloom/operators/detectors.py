"""The upload detector and the registry of re-detection methods.

A method is a function (ordered series, threshold, window, scale) -> rows with ``score`` and
``severity`` columns beside the profile of their series. All share one output schema.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.scoring import flag, is_trending, severity, severity_fixed
from sensorloom.operators.ewma import look_back_rows, smoothed
from sensorloom.operators.ordered import Ordered, ordered
from sensorloom.operators.series import profiled, profiled_rows, quantiles, to_series
from sensorloom.scale import DEFAULT, Scale, attach, cut
from sensorloom.schema import (
    DEFAULT_THRESHOLD, DEFAULT_WINDOW, DETECT_MIN_POINTS, PARAMETERS, SERIES_KEY, UPLOAD_MIN_POINTS)

Method = Callable[[Ordered, float, int, Scale], DataFrame]


def validate_params(method: str, threshold: float, window: int) -> None:
    if method not in REGISTRY:
        raise ValueError(f"Unknown method: {method}")
    if not 1 <= window <= 60:
        raise ValueError("window must be 1-60")
    if not 1.0 <= threshold <= 6.0:
        raise ValueError("threshold must be 1.0-6.0")
    if method == "rolling_z" and window < 3:
        raise ValueError("rolling_z needs a window of at least 3: its baseline needs 3 observations")


def as_series(df: DataFrame) -> DataFrame:
    """Series rows from wide readings; long input is taken as it is."""
    if "parameter" in df.columns:
        return df
    ids = [c for c in ("machine_id", "dataset_id", "ts", "row_id") if c in df.columns]
    return to_series(df.select(*ids, *PARAMETERS), ids)


def _usable(gate: int):
    return (F.col("n") >= gate) & (F.col("low") < F.col("high"))


def _output(scored: DataFrame, method: str, score: str = "score") -> DataFrame:
    dataset = F.col("dataset_id") if "dataset_id" in scored.columns else F.lit(None).cast("long")
    return scored.select(
        "machine_id", dataset.alias("dataset_id"), "parameter", "ts", "row_id", "value",
        F.col(score).alias("z_score"), "severity", is_trending(F.col("trend_slope")).alias("is_trending"),
        "trend_slope", F.lit(method).alias("method"))


def detect_upload(readings: DataFrame, threshold: float = DEFAULT_THRESHOLD,
                  keys: list[str] = SERIES_KEY, scale: Scale = DEFAULT) -> DataFrame:
    """Signed z-score over the series of the rows given (one dataset); flagged by magnitude."""
    o = ordered(as_series(readings), keys, scale=scale)
    z = (F.col("value") - F.col("mean")) / F.col("std")
    scored = profiled_rows(o, scale).filter(_usable(UPLOAD_MIN_POINTS)).withColumn("score", z)
    flagged = scored.filter(flag(F.abs("score"), threshold))
    return _output(flagged.withColumn("severity", severity(F.abs("score"), threshold)), "upload")


def _flagged(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.filter(flag(F.col("score"), threshold)).withColumn(
        "severity", severity(F.col("score"), threshold))


def zscore(o: Ordered, threshold: float, window: int, scale: Scale) -> DataFrame:
    score = F.abs(F.col("value") - F.col("mean")) / F.col("std")
    rows = profiled_rows(o, scale).filter(_usable(DETECT_MIN_POINTS))
    return _flagged(rows.withColumn("score", score), threshold)


def trailing_baseline(o: Ordered, window: int, frame: DataFrame | None = None) -> DataFrame:
    """``base_mean`` and ``base_std`` of the ``window`` rows before each row, itself excluded.

    Null below max(3, window//2) observations; the deviation is null over a flat baseline.
    """
    rows = o.frame if frame is None else frame
    before = o.window(-window, -1)
    enough = F.col("_seen") >= max(3, window // 2)
    rows = rows.withColumns({
        "_seen": F.count("value").over(before),
        "_mean": F.avg("value").over(before),
        "_std": F.stddev_samp("value").over(before),
        "_varied": F.min("value").over(before) < F.max("value").over(before),
    })
    return rows.withColumns({
        "base_mean": F.when(enough, F.col("_mean")),
        "base_std": F.when(enough & F.col("_varied"), F.col("_std")),
    }).drop("_seen", "_mean", "_std", "_varied")


def rolling_z(o: Ordered, threshold: float, window: int, scale: Scale) -> DataFrame:
    rows = o.done(trailing_baseline(o, window, profiled(o, scale)))
    score = F.abs(F.try_divide(F.col("value") - F.col("base_mean"), F.col("base_std")))
    return _flagged(rows.filter(F.col("n") >= DETECT_MIN_POINTS).withColumn("score", score), threshold)


def residuals(o: Ordered, window: int, scale: Scale) -> DataFrame:
    """Rows with ``resid``, the distance from the running mean, and its sample deviation per series."""
    if not o.split:
        return _residuals_of(o, profiled(o, scale), window)
    base = replace(o, frame=profiled(o, scale))
    rows = smoothed(base, window).withColumn("resid", F.abs(F.col("value") - F.col("ewma")))
    stats = [F.stddev_samp("resid").alias("resid_std"),
             (F.max("resid") > F.min("resid")).alias("resid_varied")]
    # read twice: written once, rather than ordered twice
    rows = cut(o.done(rows))
    return attach(rows, rows.groupBy(*o.keys).agg(*stats), o.keys, scale, keys_from=o.source)


def _residuals_of(o: Ordered, rows: DataFrame, window: int) -> DataFrame:
    """The same on a frame whose series are whole."""
    rows = smoothed(replace(o, frame=rows), window).withColumn("resid", F.abs(F.col("value") - F.col("ewma")))
    return rows.withColumns({"resid_std": F.stddev_samp("resid").over(o.whole()),
                             "resid_varied": F.max("resid").over(o.whole()) > F.min("resid").over(o.whole())})


def ewma_residual(o: Ordered, threshold: float, window: int, scale: Scale) -> DataFrame:
    rows = residuals(o, window, scale).filter(_usable(DETECT_MIN_POINTS) & F.col("resid_varied"))
    return _flagged(rows.withColumn("score", F.col("resid") / F.col("resid_std")), threshold)


def with_quartiles(o: Ordered, rows: DataFrame, scale: Scale) -> DataFrame:
    if o.split:
        return attach(rows, quantiles(o.source, [0.25, 0.75], o.keys, scale=scale), o.keys, scale, keys_from=o.source)
    both = F.percentile("value", F.array(F.lit(0.25), F.lit(0.75))).over(o.whole())
    return rows.withColumn("_q", both).withColumns(
        {"q0": F.col("_q")[0], "q1": F.col("_q")[1]}).drop("_q")


def _outside(threshold: float) -> Column:
    spread, x, k = F.col("q1") - F.col("q0"), F.col("value"), max(0.5, threshold / 2.0)
    return F.greatest(F.col("q0") - k * spread - x, x - F.col("q1") - k * spread)


def iqr(o: Ordered, threshold: float, window: int, scale: Scale) -> DataFrame:
    """Distance outside the fences in units of the interquartile range."""
    rows = with_quartiles(o, profiled_rows(o, scale), scale)
    spread = F.col("q1") - F.col("q0")
    rows = rows.filter((F.col("n") >= DETECT_MIN_POINTS) & (spread > 0))
    rows = rows.withColumn("score", _outside(threshold) / spread).filter(F.col("score") > 0)
    return rows.withColumn("severity", severity_fixed(F.col("score")))


REGISTRY: dict[str, Method] = {"zscore": zscore, "rolling_z": rolling_z, "ewma": ewma_residual, "iqr": iqr}
#: rows before the current one that a method must see
LOOK_BACK: dict[str, Callable[[int], int]] = {"rolling_z": lambda w: w, "ewma": look_back_rows}


def register_method(name: str, method: Method, look_back: Callable[[int], int] = lambda window: 0) -> None:
    REGISTRY[name] = method
    LOOK_BACK[name] = look_back


def detect(readings: DataFrame, method: str, threshold: float = DEFAULT_THRESHOLD,
           window: int = DEFAULT_WINDOW, scale: Scale = DEFAULT) -> DataFrame:
    """Anomalies of all series by one method; no row when nothing is flagged."""
    validate_params(method, threshold, window)
    look_back = LOOK_BACK.get(method, lambda w: 0)(window)
    o = ordered(as_series(readings), SERIES_KEY, look_back=look_back, scale=scale)
    return _output(REGISTRY[method](o, threshold, window, scale), method)


#: what a method adds to a profiled, ordered frame, and the columns (score if flagged, severity) that it reads off it
Reader = tuple[Callable[[Ordered, DataFrame, float, int, Scale], DataFrame], Callable[[float], tuple[Column, Column]]]
SIDE_BY_SIDE: dict[str, Reader] = {}


def register_reader(name: str, *reader) -> None:
    SIDE_BY_SIDE[name] = reader


def _fixed(score: Column, deviation: Column, keep: Column) -> tuple[Column, Column]:
    return F.when(keep, score), severity_fixed(deviation)


def _by_threshold(score: Column, usable: Column, threshold: float) -> tuple[Column, Column]:
    return F.when(usable & flag(score, threshold), score), severity(score, threshold)


def _iqr_columns(threshold: float) -> tuple[Column, Column]:
    score = F.try_divide(_outside(threshold), F.col("q1") - F.col("q0"))
    return _fixed(score, score, (F.col("n") >= DETECT_MIN_POINTS) & (F.col("q1") > F.col("q0")) & (score > 0))


register_reader("zscore", lambda o, rows, t, w, scale: rows,
                lambda t: _by_threshold(F.try_divide(F.abs(F.col("value") - F.col("mean")), F.col("std")),
                                        _usable(DETECT_MIN_POINTS), t))
register_reader("rolling_z", lambda o, rows, t, w, scale: trailing_baseline(o, w, rows),
                lambda t: _by_threshold(F.abs(F.try_divide(F.col("value") - F.col("base_mean"), F.col("base_std"))),
                                        F.col("n") >= DETECT_MIN_POINTS, t))
register_reader("ewma", lambda o, rows, t, w, scale: _residuals_of(o, rows, w),
                lambda t: _by_threshold(F.try_divide(F.col("resid"), F.col("resid_std")),
                                        _usable(DETECT_MIN_POINTS) & F.col("resid_varied"), t))
register_reader("iqr", lambda o, rows, t, w, scale: with_quartiles(o, rows, scale), _iqr_columns)


def side_by_side(readings: DataFrame, methods: list[str], threshold: float = DEFAULT_THRESHOLD,
                 window: int = DEFAULT_WINDOW, scale: Scale = DEFAULT) -> DataFrame:
    """Anomalies of several methods, equal to the union of ``detect`` for each.

    The series are ordered and profiled once, every method adds its columns to that frame, and a row gives one
    result for each method that flags it. Next to series too long for one task, and for methods
    registered without a reader, each method makes its own pass.
    """
    for method in methods:
        validate_params(method, threshold, window)
    look_back = max(LOOK_BACK.get(m, lambda w: 0)(window) for m in methods)
    o = ordered(as_series(readings), SERIES_KEY, look_back=look_back, scale=scale)
    if o.split or not set(methods) <= set(SIDE_BY_SIDE):
        return union_methods([detect(readings, m, threshold, window, scale) for m in methods])
    rows = profiled(o, scale)
    # frames that look back see null rows too, so the method that drops them comes after those that do not
    for method in sorted(methods, key=["zscore", "rolling_z", "iqr", "ewma", "isolation_forest"].index):
        rows = SIDE_BY_SIDE[method][0](o, rows, threshold, window, scale)
    results = []
    for method in methods:
        score, level = SIDE_BY_SIDE[method][1](threshold)
        results.append(F.struct(F.lit(method).alias("method"), score.alias("score"), level.alias("severity")))
    flagged = rows.withColumn("_found", F.explode(F.filter(F.array(*results), lambda r: r["score"].isNotNull())))
    dataset = F.col("dataset_id") if "dataset_id" in rows.columns else F.lit(None).cast("long")
    return flagged.select(
        "machine_id", dataset.alias("dataset_id"), "parameter", "ts", "row_id", "value", F.col("_found.score").alias("z_score"),
        F.col("_found.severity").alias("severity"), is_trending(F.col("trend_slope")).alias("is_trending"), "trend_slope",
        F.col("_found.method").alias("method"))


def union_methods(results: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, results)


def compare_methods(readings: DataFrame, methods: list[str], threshold: float = DEFAULT_THRESHOLD,
                    window: int = DEFAULT_WINDOW, scale: Scale = DEFAULT) -> DataFrame:
    """One row per method: anomalies, machines flagged and counts by severity; zeros when none."""
    found = side_by_side(readings, methods, threshold, window, scale)
    names = readings.sparkSession.createDataFrame([(m,) for m in methods], "method string")
    counts = found.groupBy("method").agg(
        F.count(F.lit(1)).alias("anomalies"),
        F.countDistinct("machine_id").alias("machines_flagged"),
        F.count_if(F.col("severity") == "HIGH").alias("high"),
        F.count_if(F.col("severity") == "MEDIUM").alias("medium"),
        F.count_if(F.col("severity") == "MONITOR").alias("monitor"))
    return names.join(counts, "method", "left").fillna(0)


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Severity counts of two result sets side by side, with a match flag."""
    left = a.groupBy("severity").agg(F.count(F.lit(1)).alias("left_count"))
    right = b.groupBy("severity").agg(F.count(F.lit(1)).alias("right_count"))
    both = left.join(right, "severity", "full").fillna(0)
    return both.withColumn("matches", F.col("left_count") == F.col("right_count"))
