"""Readings scans, readings and anomaly sinks, run log and status registry."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.operators.records import current_status
from sensorloom.operators.records import new_machines
from sensorloom.scale import DEFAULT, Scale, attach, cut
from sensorloom.schema import ERROR_CHARS, PARAMETERS, STATUSES, TABLES
from sensorloom.sources.store import Change, Store, now

READING_COLUMNS = ["machine_id", "dataset_id", "ts", "row_id", *PARAMETERS]


def readings_of(df: DataFrame, columns: list[str] = READING_COLUMNS) -> DataFrame:
    """Only the columns a detector needs, in machine and time order."""
    return df.select(*columns).orderBy("machine_id", "ts", "row_id")


def read_readings(store: Store, columns: list[str] = READING_COLUMNS) -> DataFrame:
    """Only the columns a detector needs, unordered."""
    return store.read("sensor_readings").select(*columns)


def register_machines(change: Change, names: DataFrame) -> DataFrame:
    """Give every unknown name a key; returns (id, name) of all machines. Nothing is written if all are known."""
    added = new_machines(names, change.read("machines"))
    if not added.isEmpty():
        change.depends_on("machines")  # two uploads at once must not give out one key twice
        change.append("machines", added)
    return change.read("machines").select("id", "name")


def write_readings(change: Change, df: DataFrame, scale: Scale = DEFAULT, datasets: list[int] | None = None) -> None:
    """One stored row per row of ``df`` (machine names, ``dataset_id``, features).

    Unknown machines are registered with them; rows carry their keys. Whole datasets are written, so a
    retried upload does not duplicate rows.
    """
    keys = register_machines(change, df.select(F.col("machine_id").alias("name")))
    keys = keys.select(F.col("id").alias("_key"), F.col("name").alias("machine_id"))
    keyed = attach(df, keys, ["machine_id"], scale).drop("machine_id").withColumnRenamed("_key", "machine_id")
    change.put_partitions("sensor_readings", keyed, datasets)


def write_anomalies(store: Store | Change, df: DataFrame, mode: str = "append", datasets: list[int] | None = None) -> None:
    """``append`` under the uploads' datasets, whose earlier anomalies go, or ``replace`` the whole table."""
    if mode == "replace":
        store.replace("anomalies", df)
    else:
        store.put_partitions("anomalies", df, datasets)


def run_rows(metrics: DataFrame, params: dict) -> DataFrame:
    """Rows of the run log from metrics by ``dataset_id``: the parameters and every other column cast to double."""
    names = [c for c in metrics.columns if c != "dataset_id"]
    values = F.map_from_arrays(F.array(*[F.lit(c) for c in names]),
                               F.array(*[F.col(c).cast("double") for c in names]))
    settings = F.struct(*[F.lit(params.get(k)).alias(k) for k in ("method", "threshold", "window", "engine")])
    run_id = F.md5(F.concat_ws(":", F.lit(uuid.uuid4().hex), F.col("dataset_id").cast("string")))
    return metrics.select("dataset_id", run_id.alias("run_id"), settings.alias("params"), values.alias("metrics"),
                          F.lit(now()).cast("timestamp_ntz").alias("created_at"))


def log_run(store: Store | Change, dataset_id: int, params: dict, metrics: DataFrame) -> str:
    """Append one run: its parameters and its one-row metrics, cast to double."""
    row = cut(run_rows(metrics.withColumn("dataset_id", F.lit(dataset_id).cast("long")), params))
    store.append("etl_runs", row.coalesce(1))
    return row.first()["run_id"]


def set_status(store: Store | Change, table: str, rows: DataFrame, status: str) -> None:
    """Append a status step for each id in ``rows`` (id, and optionally filename, row_count, error, ...)."""
    if status not in STATUSES:
        raise ValueError(f"Unknown status: {status}")
    stamped = rows.withColumn("status", F.lit(status)).withColumn(
        "changed_at", F.lit(now()).cast("timestamp_ntz"))
    if "error" in rows.columns:
        stamped = stamped.withColumn("error", F.substring("error", 1, ERROR_CHARS))
    store.append(table, stamped)


def statuses(store: Store, table: str) -> DataFrame:
    return current_status(store.read(table))


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])
