"""Flat CSV exports of readings and anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.operators.fleet import with_machine_name
from sensorloom.scale import DEFAULT, Scale
from sensorloom.schema import PARAMETERS

ROLLING = [f"{p}_roll_avg" for p in PARAMETERS]


def iso(ts: Column) -> Column:
    """ISO text; the fraction appears only when there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    part = F.date_format(ts, "SSSSSS")
    return F.when(part == "000000", whole).otherwise(F.concat_ws(".", whole, part))


def sensor_rows(readings: DataFrame, machines: DataFrame, scale: Scale = DEFAULT) -> DataFrame:
    named = with_machine_name(readings, machines, scale)
    return named.orderBy("ts", "machine_id", "row_id").select(
        "machine", iso(F.col("ts")).alias("timestamp"), *PARAMETERS, *ROLLING)


def anomaly_rows(anomalies: DataFrame, machines: DataFrame, scale: Scale = DEFAULT) -> DataFrame:
    named = with_machine_name(anomalies, machines, scale)
    return named.orderBy("ts", "machine_id", "parameter").select(
        "machine", "parameter", iso(F.col("ts")).alias("timestamp"), "value",
        F.round("z_score", 3).alias("z_score"), "severity", "is_trending")


def write_csv(rows: DataFrame, path: str) -> None:
    """A folder of CSV parts, each with the header, in the order of ``rows``."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def export_sensors(readings: DataFrame, machines: DataFrame, path: str) -> None:
    write_csv(sensor_rows(readings, machines), path)


def export_anomalies(anomalies: DataFrame, machines: DataFrame, path: str) -> None:
    write_csv(anomaly_rows(anomalies, machines), path)
