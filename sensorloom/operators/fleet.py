"""Roll-ups from readings and anomalies to machines and the fleet."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.scoring import HEALTH_RANK, health, is_trending, rank_of
from sensorloom.operators.ordered import last_rows
from sensorloom.scale import DEFAULT, Scale, attach
from sensorloom.schema import DIGEST_LINES, NO_ANOMALIES, PARAMETERS, SERIES_KEY, SPARK_POINTS

DEFAULT_PEAK = "temperature"


def with_machine_name(df: DataFrame, machines: DataFrame, scale: Scale = DEFAULT) -> DataFrame:
    """Attach ``machine``: the name of the machine, or its id as text when unknown."""
    names = machines.select(F.col("id").alias("machine_id"), F.col("name").alias("_name"))
    named = attach(df, names, ["machine_id"], scale, how="left")
    return named.withColumn("machine", F.coalesce("_name", F.col("machine_id").cast("string"))).drop("_name")


COUNTS = ["high_count", "medium_count", "monitor_count", "anomaly_count", "trending_count"]


def anomaly_summary(anomalies: DataFrame) -> DataFrame:
    """Counts by severity and trend, and the peak, of each machine: one map-side-combined pass.

    The peak is the largest magnitude; ties go to the later, then to the larger parameter name.
    """
    def of(level: str) -> Column:
        return F.count_if(F.col("severity") == level)

    peak = F.max(F.struct(F.abs("z_score").alias("size"), "ts", "parameter"))
    return anomalies.groupBy("machine_id").agg(
        of("HIGH").alias("high_count"), of("MEDIUM").alias("medium_count"), of("MONITOR").alias("monitor_count"),
        F.count(F.lit(1)).alias("anomaly_count"), F.count_if("is_trending").alias("trending_count"),
        peak.alias("_p"),
    ).select("machine_id", *COUNTS, F.round("_p.size", 2).alias("max_z"), F.col("_p.parameter").alias("spark_param"))


def severity_pivot(anomalies: DataFrame) -> DataFrame:
    """Anomaly counts by severity and trend, one row per machine."""
    return anomaly_summary(anomalies).select("machine_id", *COUNTS)


def peak_parameter(anomalies: DataFrame) -> DataFrame:
    """Largest magnitude per machine and the parameter behind it."""
    return anomaly_summary(anomalies).select("machine_id", "max_z", "spark_param")


def latest_reading(readings: DataFrame, cols: list[str] = PARAMETERS) -> DataFrame:
    """Time and values of the last reading per machine, combined map-side."""
    last = F.max_by(F.struct("ts", *cols), F.struct("ts", "row_id"))
    return readings.groupBy("machine_id").agg(last.alias("_l")).select(
        "machine_id", F.col("_l.ts").alias("last_reading"), *[F.col(f"_l.{c}").alias(c) for c in cols])


def reading_tail(readings: DataFrame, n: int = SPARK_POINTS, cols: list[str] = PARAMETERS) -> DataFrame:
    """``tail``: the last ``n`` readings of each machine, oldest first, as an array."""
    last = last_rows(readings.select("machine_id", "ts", "row_id", *cols), ["machine_id"], n,
                     [F.desc("ts"), F.desc("row_id")])
    points = F.sort_array(F.collect_list(F.struct("ts", "row_id", *cols)))
    return last.groupBy("machine_id").agg(points.alias("tail"))


def spark_points(parameter: Column, cols: list[str] = PARAMETERS) -> Column:
    """Non-null values of the named parameter in ``tail``; nulls leave after the rows were counted."""
    def value(point: Column) -> Column:
        return reduce(lambda rest, c: F.when(parameter == c, point[c]).otherwise(rest), cols,
                      F.lit(None).cast("double"))

    return F.filter(F.transform("tail", value), lambda v: v.isNotNull())


def sparkline(readings: DataFrame, peak: DataFrame, n: int = SPARK_POINTS,
              cols: list[str] = PARAMETERS) -> DataFrame:
    """Last ``n`` readings of the peak parameter of each machine, oldest first."""
    driven = reading_tail(readings, n, cols).join(peak.select("machine_id", "spark_param"), "machine_id", "left")
    parameter = F.coalesce("spark_param", F.lit(DEFAULT_PEAK))
    return driven.select("machine_id", spark_points(parameter, cols).alias("spark"))


def scale_sparkline(lines: DataFrame) -> DataFrame:
    """Sparkline points scaled to 0..1; a flat line spans 1, fewer than two points give none."""
    low, high = F.array_min("spark"), F.array_max("spark")
    span = F.when(high > low, high - low).otherwise(1.0)
    scaled = F.transform("spark", lambda v: (v - low) / span)
    return lines.withColumn("scaled", F.when(F.size("spark") >= 2, scaled))


def fleet_health(machines: DataFrame, readings: DataFrame, anomalies: DataFrame) -> DataFrame:
    """One row per machine, the most urgent first; machines without anomalies stay, green.

    Readings and anomalies are each read once and reduced to one row per machine before the joins;
    the latest reading is the newest of the rows the sparkline needs anyway.
    """
    joined = (machines.withColumnRenamed("id", "machine_id")
              .join(anomaly_summary(anomalies), "machine_id", "left")
              .join(reading_tail(readings), "machine_id", "left"))
    newest = F.element_at("tail", -1)
    rows = joined.fillna(0, [*COUNTS, "max_z"]).fillna(DEFAULT_PEAK, ["spark_param"]).select(
        F.col("machine_id").alias("id"), "name", "machine_type", "location",
        health(F.col("high_count"), F.col("medium_count"), F.col("monitor_count")).alias("health"),
        *COUNTS, newest["ts"].alias("last_reading"), "max_z",
        F.struct(*[newest[p].alias(p) for p in PARAMETERS]).alias("latest"), "spark_param",
        F.coalesce(spark_points(F.col("spark_param")), F.array().cast("array<double>")).alias("spark"))
    return rows.orderBy(rank_of(F.col("health"), HEALTH_RANK), F.desc("anomaly_count"), "name")


def fleet_kpis(fleet: DataFrame) -> DataFrame:
    return fleet.agg(
        F.count(F.lit(1)).alias("machines"), F.count_if(F.col("health") == "red").alias("critical"),
        F.sum("anomaly_count").alias("anomalies"), F.sum("trending_count").alias("trending"),
        F.sum("high_count").alias("high_severity"))


def for_machine(df: DataFrame, machine_id, column: str = "machine_id") -> DataFrame:
    """Rows of one machine, or of all when ``machine_id`` is None."""
    return df if machine_id is None else df.filter(F.col(column) == machine_id)


def sort_by_time(df: DataFrame, ties: tuple[str, ...] = ("row_id",)) -> DataFrame:
    return df.orderBy("ts", *[t for t in ties if t in df.columns])


class MachineDetail(NamedTuple):
    health: DataFrame
    readings: DataFrame
    anomalies: DataFrame


def machine_detail(machine_id, machines: DataFrame, readings: DataFrame, anomalies: DataFrame) -> MachineDetail:
    """Health, readings and anomalies of one machine (None: of all); the filter reaches every scan."""
    own = for_machine(machines, machine_id, "id")
    rows, found = for_machine(readings, machine_id), for_machine(anomalies, machine_id)
    return MachineDetail(fleet_health(own, rows, found), sort_by_time(rows), sort_by_time(found))


def anomaly_overlay(series: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Series rows with ``is_anomaly``: an anomaly has the same machine, parameter and time."""
    marks = anomalies.select(*SERIES_KEY, "ts").distinct().withColumn("_mark", F.lit(True))
    return series.join(marks, [*SERIES_KEY, "ts"], "left").withColumn(
        "is_anomaly", F.coalesce("_mark", F.lit(False))).drop("_mark")


def anomaly_counts(anomalies: DataFrame) -> DataFrame:
    """Distinct anomaly times per machine and parameter."""
    return anomalies.groupBy(*SERIES_KEY).agg(F.countDistinct("ts").alias("anomaly_times"))


def anomalous_parameters(anomalies: DataFrame, by: str | None = "machine_id") -> DataFrame:
    names = F.sort_array(F.collect_set("parameter")).alias("parameters")
    return anomalies.groupBy(*([by] if by else [])).agg(names)


def run_metrics(rows: DataFrame, anomalies: DataFrame, by: str | None = None) -> DataFrame:
    """Row and machine counts beside anomaly counts: one row, or one for each ``by`` that has rows."""
    keys = [by] if by else []
    read = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("machine_id").alias("machines"))
    found = anomalies.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("anomalies_detected"), F.countDistinct("machine_id").alias("machines_flagged"),
        F.count_if(F.col("severity") == "HIGH").alias("high_severity"))
    if by:
        counts = [c for c in found.columns if c != by]
        return read.join(found, by, "left").fillna(0, counts)
    both = read.unionByName(found, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def _line_order(first: str = "z_score") -> list[Column]:
    # signed score: strong drops sort last, as published
    return [F.desc(first), F.col("ts"), F.col("machine_id"), F.col("parameter")]


def top_anomalies(anomalies: DataFrame, n: int = DIGEST_LINES, by: str | None = None) -> DataFrame:
    """The ``n`` largest signed scores over the fleet, or per value of ``by``."""
    if by is None:
        return anomalies.orderBy(*_line_order()).limit(n)
    return last_rows(anomalies, [by], n, _line_order()).drop("rank")


def join_lines(df: DataFrame, keys: list[str], order: list[str], line: Column, sep: str,
               name: str = "text") -> DataFrame:
    """Lines of each key joined in order; callers bound the lines per key."""
    lines = F.sort_array(F.collect_list(F.struct(*order, line.alias("_line"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(lines, lambda x: x["_line"]), sep).alias(name))


def digest_line() -> Column:
    return F.format_string(
        "- %s: %s = %.2f at %s | severity %s, z=%.2f%s",
        F.col("machine"), F.col("parameter"), F.col("value"), F.date_format("ts", "yyyy-MM-dd HH:mm"),
        F.col("severity"), F.col("z_score"), F.when(F.col("is_trending"), " (worsening trend)").otherwise(""))


def anomaly_digest(anomalies: DataFrame, machines: DataFrame, by: str | None = None,
                   n: int = DIGEST_LINES, scale: Scale = DEFAULT) -> DataFrame:
    """``digest`` text of the top anomalies: one row for the fleet, or one per machine.

    Without anomalies the text is a fixed sentence.
    """
    top = with_machine_name(top_anomalies(anomalies, n, by), machines, scale)
    top = top.withColumn("_neg", -F.col("z_score"))
    keys = [by] if by else []
    lines = join_lines(top, keys, ["_neg", "ts", "machine_id", "parameter"], digest_line(), "\n", "digest")
    if by is None:
        return lines.select(F.when(F.col("digest") == "", NO_ANOMALIES).otherwise(F.col("digest")).alias("digest"))
    all_machines = machines.select(F.col("id").alias(by))
    return all_machines.join(lines, by, "left").fillna(NO_ANOMALIES, ["digest"])
