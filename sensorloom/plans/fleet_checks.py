"""Checked queries over machines, anomalies, tables and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.operators import fleet as ops
from sensorloom.operators import records
from sensorloom.operators.detectors import as_series
from sensorloom.plans import maintenance
from sensorloom.plans.checks import check, numbers_text, rounded, rounded_sql
from sensorloom.plans.fixtures import Fixtures, with_shapes
from sensorloom.schema import PARAMETERS
from sensorloom.sources import exports

COUNTS = """SELECT machine_id, count(*) FILTER (severity = 'HIGH') AS high_count,
  count(*) FILTER (severity = 'MEDIUM') AS medium_count, count(*) FILTER (severity = 'MONITOR') AS monitor_count,
  count(*) AS anomaly_count, count(*) FILTER (is_trending) AS trending_count FROM {0} GROUP BY machine_id"""
PEAK = """SELECT machine_id, round(abs(z_score), 2) AS max_z, parameter AS spark_param FROM (
  SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY abs(z_score) DESC, ts DESC, parameter DESC) AS r
  FROM {0}) WHERE r = 1"""
LATEST = """SELECT machine_id, ts AS last_reading, temperature, pressure, vibration, rpm FROM (
  SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY ts DESC, row_id DESC) AS r FROM fw) WHERE r = 1"""
SPARK = """SELECT machine_id, list(v ORDER BY ts, row_id) FILTER (v IS NOT NULL) AS spark FROM (
  SELECT f.machine_id, ts, row_id, CASE coalesce(spark_param, 'temperature') WHEN 'temperature' THEN temperature
    WHEN 'pressure' THEN pressure WHEN 'vibration' THEN vibration WHEN 'rpm' THEN rpm END AS v,
    row_number() OVER (PARTITION BY f.machine_id ORDER BY ts DESC, row_id DESC) AS r
  FROM fw f LEFT JOIN peak USING (machine_id)) WHERE r <= 48 GROUP BY machine_id"""


def numbers_sql(col: str) -> str:
    return f"coalesce(array_to_string(list_transform({col}, lambda v: printf('%.4f', v)), ','), '')"


HEALTH = f"""SELECT id, name, machine_type, location,
  CASE WHEN coalesce(high_count, 0) > 0 THEN 'red' WHEN coalesce(anomaly_count, 0) > 0 THEN 'yellow'
       ELSE 'green' END AS health,
  coalesce(anomaly_count, 0) AS anomaly_count, coalesce(high_count, 0) AS high_count,
  coalesce(medium_count, 0) AS medium_count, coalesce(monitor_count, 0) AS monitor_count,
  coalesce(trending_count, 0) AS trending_count, last_reading, coalesce(max_z, 0.0) AS max_z,
  {rounded_sql(*PARAMETERS)}, coalesce(spark_param, 'temperature') AS spark_param, {numbers_sql('spark')} AS spark
  FROM md LEFT JOIN ({COUNTS.format('aw')}) c ON c.machine_id = id LEFT JOIN peak p ON p.machine_id = id
  LEFT JOIN ({LATEST}) l ON l.machine_id = id LEFT JOIN ({SPARK}) s ON s.machine_id = id"""
AW_PEAK = {"peak": PEAK.format("aw")}


@check(with_shapes(COUNTS.format("an"), "an"))
def severity_pivot(x: Fixtures) -> DataFrame:
    return ops.severity_pivot(x.anomalies())


@check(with_shapes(PEAK.format("aw"), "aw"))
def peak_parameter(x: Fixtures) -> DataFrame:
    return ops.peak_parameter(x.wide_anomalies())


@check(with_shapes(LATEST, "fw"))
def latest_reading(x: Fixtures) -> DataFrame:
    return ops.latest_reading(x.readings())


@check(with_shapes(f"SELECT machine_id, {numbers_sql('spark')} AS spark FROM ({SPARK})", "aw", extra=AW_PEAK))
def sparkline(x: Fixtures) -> DataFrame:
    lines = ops.sparkline(x.readings(), ops.peak_parameter(x.wide_anomalies()))
    return lines.withColumn("spark", numbers_text("spark"))


SCALED = ("list_transform(spark, lambda v: (v - list_min(spark)) / CASE WHEN list_max(spark) > list_min(spark) "
          "THEN list_max(spark) - list_min(spark) ELSE 1.0 END)")


@check(with_shapes(f"SELECT machine_id, CASE WHEN len(spark) >= 2 THEN {numbers_sql(SCALED)} END AS scaled "
                   f"FROM ({SPARK})", "aw", extra=AW_PEAK))
def sparkline_scaled(x: Fixtures) -> DataFrame:
    lines = ops.scale_sparkline(ops.sparkline(x.readings(), ops.peak_parameter(x.wide_anomalies())))
    return lines.select("machine_id", numbers_text("scaled").alias("scaled"))


def health_rows(x: Fixtures) -> DataFrame:
    return ops.fleet_health(x.machines(), x.readings(), x.wide_anomalies())


@check(with_shapes(HEALTH, "md", "aw", extra=AW_PEAK))
def fleet_health(x: Fixtures) -> DataFrame:
    flat = health_rows(x).select("*", "latest.*").drop("latest")
    return rounded(flat.withColumn("spark", numbers_text("spark")), *PARAMETERS)


@check(with_shapes(
    "SELECT count(*) AS machines, count(*) FILTER (health = 'red') AS critical, "
    "sum(anomaly_count)::BIGINT AS anomalies, sum(trending_count)::BIGINT AS trending, "
    f"sum(high_count)::BIGINT AS high_severity FROM ({HEALTH})", "md", "aw", extra=AW_PEAK))
def fleet_kpis(x: Fixtures) -> DataFrame:
    return ops.fleet_kpis(health_rows(x))


@check(with_shapes(
    "SELECT machine_id, dataset_id, parameter, ts, row_id, round(value, 6) AS value, EXISTS (SELECT 1 FROM aw a "
    "WHERE a.machine_id = s.machine_id AND a.parameter = s.parameter AND a.ts = s.ts) AS is_anomaly FROM fl s", "aw"))
def anomaly_overlay(x: Fixtures) -> DataFrame:
    return rounded(ops.anomaly_overlay(as_series(x.readings()), x.wide_anomalies()), "value")


@check(with_shapes("SELECT machine_id, parameter, count(DISTINCT ts) AS anomaly_times FROM aw "
                   "GROUP BY machine_id, parameter", "aw"))
def anomaly_counts(x: Fixtures) -> DataFrame:
    return ops.anomaly_counts(x.wide_anomalies())


@check(with_shapes(
    "SELECT machine_id, health, kind, ts, parameter, round(value, 6) AS value FROM ("
    "SELECT machine_id, 'reading' AS kind, ts, parameter, value FROM fl UNION ALL "
    "SELECT machine_id, 'anomaly', ts, parameter, value FROM aw) t "
    f"JOIN (SELECT id AS machine_id, health FROM ({HEALTH})) h USING (machine_id)", "md", "aw", extra=AW_PEAK))
def machine_detail(x: Fixtures) -> DataFrame:
    detail = ops.machine_detail(None, x.machines(), x.readings(), x.wide_anomalies())
    columns = ["machine_id", "kind", "ts", "parameter", "value"]
    readings = as_series(detail.readings).withColumn("kind", F.lit("reading")).select(*columns)
    found = detail.anomalies.withColumn("kind", F.lit("anomaly")).select(*columns)
    colours = detail.health.select(F.col("id").alias("machine_id"), "health")
    return rounded(readings.unionByName(found).join(colours, "machine_id"), "value")


@check(with_shapes(
    "SELECT count(*) AS rows, count(DISTINCT machine_id) AS machines, (SELECT count(*) FROM an) AS anomalies_detected, "
    "(SELECT count(DISTINCT machine_id) FROM an) AS machines_flagged, "
    "(SELECT count(*) FROM an WHERE severity = 'HIGH') AS high_severity FROM el", "an"))
def run_metrics(x: Fixtures) -> DataFrame:
    return ops.run_metrics(x.long_events(), x.anomalies())


@check("SELECT o_orderkey AS id, o_totalprice, o_orderdate::TIMESTAMP AS created_at FROM orders "
       "ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25")
def recent_runs(x: Fixtures) -> DataFrame:
    runs = x.table("orders").select(F.col("o_orderkey").alias("id"), "o_totalprice",
                                    F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"))
    return records.recent_runs(runs)


ISO_SQL = ("CASE WHEN epoch_us({0}) % 1000000 = 0 THEN strftime({0}, '%Y-%m-%dT%H:%M:%S') "
           "ELSE strftime({0}, '%Y-%m-%dT%H:%M:%S.%f') END")


EXPORT_SENSORS_SQL = with_shapes(
    f"SELECT coalesce(name, machine_id::VARCHAR) AS machine, {ISO_SQL.format('ts')} AS timestamp, "
    f"{rounded_sql(*PARAMETERS, *exports.ROLLING)} FROM fw LEFT JOIN md ON id = machine_id", "fw", "md")


@check(EXPORT_SENSORS_SQL)
def export_sensors(x: Fixtures) -> DataFrame:
    return rounded(exports.sensor_rows(x.readings(), x.machines()), *PARAMETERS, *exports.ROLLING)


@check(with_shapes(
    f"SELECT coalesce(name, machine_id::VARCHAR) AS machine, parameter, {ISO_SQL.format('ts')} AS timestamp, value, "
    "round(z_score, 3) AS z_score, severity, is_trending FROM an "
    "LEFT JOIN (SELECT * FROM md WHERE machine_type <> 'Motor') m ON id = machine_id", "an", "md"))
def export_anomalies(x: Fixtures) -> DataFrame:
    # motors are left out of the dimension, so their rows fall back to the id
    return exports.anomaly_rows(x.anomalies(), x.machines().filter(F.col("machine_type") != "Motor"))


@check(with_shapes(
    "SELECT id, name, machine_type FROM md WHERE machine_type <> 'Valve' UNION ALL "
    "SELECT (SELECT max(id) FROM md WHERE machine_type <> 'Valve') + row_number() OVER (ORDER BY name), name, "
    "'Valve' FROM md WHERE machine_type = 'Valve'", "md"))
def machine_upsert(x: Fixtures) -> DataFrame:
    every = x.machines()
    known = every.filter(F.col("machine_type") != "Valve").select("id", "name", "machine_type")
    return records.upsert_machines(every.select("name"), known)


@check(with_shapes("SELECT * FROM md WHERE NOT EXISTS (SELECT 1 FROM el WHERE el.machine_id = md.id)", "md", "el"))
def orphan_machines(x: Fixtures) -> DataFrame:
    return records.orphan_machines(x.machines(), x.long_events())


@check(with_shapes(
    "SELECT id, name, (SELECT count(*) FROM el WHERE machine_id = id) AS readings, "
    "(SELECT count(*) FROM an WHERE machine_id = id) AS anomalies FROM md "
    "WHERE id % 3 <> 0 AND EXISTS (SELECT 1 FROM el WHERE machine_id = id)", "md", "an"))
def delete_dataset(x: Fixtures) -> DataFrame:
    # a dataset per third machine, so deleting one leaves machines without readings
    def owned(df: DataFrame) -> DataFrame:
        return df.withColumn("dataset_id", F.col("machine_id") % 3)

    runs = x.spark.createDataFrame([(0,), (1,), (2,)], "dataset_id long")
    left = maintenance.delete_dataset(
        maintenance.FleetTables(x.machines(), owned(x.long_events()), owned(x.anomalies()), runs), 0)

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(F.col("machine_id").alias("id")).agg(F.count(F.lit(1)).alias(name))

    return (left.machines.select("id", "name").join(counted(left.readings, "readings"), "id", "left")
            .join(counted(left.anomalies, "anomalies"), "id", "left").fillna(0, ["readings", "anomalies"]))


@check(with_shapes(
    "SELECT machine_id, count(*) AS readings FROM el WHERE machine_id NOT IN "
    "(SELECT machine_id FROM an WHERE severity = 'HIGH') GROUP BY machine_id", "an"))
def drop_flagged_machines(x: Fixtures) -> DataFrame:
    high = x.anomalies().filter(F.col("severity") == "HIGH")
    left = records.drop_keys(x.long_events(), high, "machine_id")
    return left.groupBy("machine_id").agg(F.count(F.lit(1)).alias("readings"))


@check(with_shapes("SELECT id, id AS recommendation_id, machine_id, actioned, notes, created_at, "
                   "CASE WHEN verdict <> 'SAFE' THEN question END AS question, "
                   "CASE WHEN verdict <> 'SAFE' THEN verdict END AS verdict FROM rq", "rq"))
def log_with_recommendation(x: Fixtures) -> DataFrame:
    # safe verdicts are left out, so their logs stay without one
    asked = x.recommendations().filter(F.col("verdict") != "SAFE")
    return records.logs_with_recommendation(x.logs(), asked).drop("actioned_at")


@check(with_shapes(
    "SELECT id, id AS recommendation_id, machine_id, created_at, "
    "CASE WHEN id % 7 = 0 THEN NOT actioned ELSE actioned END AS actioned, "
    "CASE WHEN id % 7 = 0 THEN 'seen ' || notes ELSE notes END AS notes, "
    "CASE WHEN id % 7 <> 0 AND actioned THEN created_at "
    "WHEN id % 7 = 0 AND NOT actioned THEN created_at + INTERVAL 1 DAY END AS actioned_at "
    "FROM rq WHERE id % 77 <> 0", "rq"))
def log_apply_changes(x: Fixtures) -> DataFrame:
    return records.apply_log_changes(x.logs(), x.log_changes())
