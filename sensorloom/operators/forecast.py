"""Linear projection of each series onto its service limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.cleaning import micros
from sensorloom.functions.scoring import STATUS_RANK, forecast_status, rank_of
from sensorloom.operators.ordered import last_rows
from sensorloom.scale import DEFAULT, Scale, attach
from sensorloom.schema import DETECT_MIN_POINTS, HORIZON_DAYS, SERIES_KEY, SERVICE_LIMITS

HOUR_US = 3.6e9


def with_hours(series: DataFrame, scale: Scale = DEFAULT) -> DataFrame:
    """``hours`` since the first reading of the machine."""
    firsts = series.groupBy("machine_id").agg(F.min("ts").alias("_first"))
    rows = attach(series, firsts, ["machine_id"], scale)
    return rows.withColumn("hours", (micros(F.col("ts")) - micros(F.col("_first"))) / HOUR_US).drop("_first")


def fit_time_trend(series: DataFrame) -> DataFrame:
    """Count and slope per hour of each series with enough values, in one map-side-combined pass.

    A slope does not depend on where the clock starts, so no first reading is joined on.
    """
    hours = micros(F.col("ts")) / HOUR_US
    fits = series.filter(F.col("value").isNotNull()).groupBy(*SERIES_KEY).agg(
        F.count("value").alias("n"), F.regr_slope("value", hours).alias("slope"))
    return fits.filter(F.col("n") >= DETECT_MIN_POINTS)


def current_value(series: DataFrame, n: int = 3) -> DataFrame:
    """Mean of the last ``n`` non-null values of each series."""
    last = last_rows(series.filter(F.col("value").isNotNull()), SERIES_KEY, n, [F.desc("ts"), F.desc("row_id")])
    return last.groupBy(*SERIES_KEY).agg(F.avg("value").alias("current"))


def with_limits(series: DataFrame, limits: dict[str, tuple[float | None, str]] = SERVICE_LIMITS) -> DataFrame:
    """Attach ``service_limit`` and ``unit``; parameters without a limit are left out.

    The limits are a handful of constants, so they are looked up in a literal rather than joined.
    """
    known = {p: (limit, unit) for p, (limit, unit) in limits.items() if limit is not None}
    table = F.create_map(*[c for p, (limit, unit) in known.items() for c in (
        F.lit(p), F.struct(F.lit(float(limit)).alias("service_limit"), F.lit(unit).alias("unit")))])
    return (series.filter(F.col("parameter").isin(*known))
            .withColumn("_limit", F.element_at(table, F.col("parameter")))
            .withColumns({"service_limit": F.col("_limit.service_limit"), "unit": F.col("_limit.unit")})
            .drop("_limit"))


def round_forecast(df: DataFrame) -> DataFrame:
    return df.withColumns({"current": F.round("current", 2), "slope_per_day": F.round("slope_per_day", 4),
                           "eta_days": F.round("eta_days", 1)})


def forecast(series: DataFrame, limits: dict[str, tuple[float | None, str]] = SERVICE_LIMITS,
             horizon: float = HORIZON_DAYS) -> DataFrame:
    """One row per limited series, the most urgent of each machine first."""
    limited = with_limits(series, limits).select(*SERIES_KEY, "ts", "row_id", "value")
    fits = fit_time_trend(limited).join(current_value(limited), SERIES_KEY)
    per_day = with_limits(fits, limits).withColumn("slope_per_day", F.col("slope") * 24.0)
    outlook = forecast_status(F.col("current"), F.col("service_limit"), F.col("slope_per_day"), horizon)
    rows = per_day.withColumn("_o", outlook).select(
        "machine_id", "parameter", "unit", "current", "service_limit", "slope_per_day", "_o.eta_days", "_o.status")
    return round_forecast(rows).orderBy(
        "machine_id", rank_of(F.col("status"), STATUS_RANK), F.asc_nulls_last("eta_days"))
