"""From raw sensor rows to stored readings, anomalies, metrics and a final status."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.operators.detectors import detect_upload
from sensorloom.operators.features import transform
from sensorloom.operators.fleet import run_metrics
from sensorloom.scale import DEFAULT, Scale
from sensorloom.schema import DEFAULT_THRESHOLD, DEFAULT_WINDOW, SERIES_KEY
from sensorloom.sources.csv import read_sensor_csv
from sensorloom.sources.store import Change, Store
from sensorloom.sources.tables import log_run, set_status, write_anomalies, write_readings


def process_rows(change: Change, raw: DataFrame, own: Callable[[DataFrame], DataFrame], threshold: float,
                 window: int, scale: Scale = DEFAULT, datasets: list[int] | None = None) -> DataFrame:
    """Transform, write and scan raw rows of one or many datasets (``dataset_id``); returns their readings.

    ``own`` narrows a table to the datasets at hand; ``datasets`` names them where they are known, so that
    what an earlier upload of theirs left behind goes even if nothing takes its place.

    Each dataset is filled, featured and scanned on its own. Detection reads the written readings,
    which is also what cuts the lineage between the two sinks. Nothing is published here.
    """
    write_readings(change, transform(raw, window, ["dataset_id", "machine_id"], scale), scale, datasets)
    written = own(change.read("sensor_readings"))
    write_anomalies(change, detect_upload(written, threshold, ["dataset_id", *SERIES_KEY], scale), datasets=datasets)
    return written


#: report of a file of which every row lacks a machine or a readable time
NOTHING_KEPT = "No row has both a machine id and a readable timestamp."


def run_params(threshold: float, window: int) -> dict:
    return {"method": "upload", "threshold": float(threshold), "window": window, "engine": "spark"}


def process_dataset(store: Store, path: str, dataset_id: int, threshold: float = DEFAULT_THRESHOLD,
                    window: int = DEFAULT_WINDOW, scale: Scale = DEFAULT) -> str | None:
    """Process one CSV; returns its run id, or None when it failed (the registry holds the reason).

    Readings, anomalies, run log and final status are published together: of an upload that fails, nothing
    is seen but its status, and what an earlier upload stored stays as it was.
    """
    spark = store.spark
    one = spark.createDataFrame([(dataset_id, path.rsplit("/", 1)[-1])], "id long, filename string")
    set_status(store, "datasets", one, "processing")

    def own(df: DataFrame) -> DataFrame:
        return df.filter(F.col("dataset_id") == dataset_id)

    def work(change: Change) -> str:
        raw = read_sensor_csv(spark, path).withColumn("dataset_id", F.lit(dataset_id).cast("long"))
        rows = process_rows(change, raw, own, threshold, window, scale, [dataset_id])
        kept = rows.count()
        if not kept and not raw.isEmpty():
            raise ValueError(NOTHING_KEPT)
        metrics = run_metrics(rows, own(change.read("anomalies")))
        run_id = log_run(change, dataset_id, run_params(threshold, window), metrics)
        set_status(change, "datasets", one.withColumn("row_count", F.lit(kept)), "completed")
        return run_id

    try:
        return store.retried(work)
    except Exception as error:  # the status table is the report of a failed upload
        set_status(store, "datasets", one.withColumn("error", F.lit(str(error))), "failed")
        return None
