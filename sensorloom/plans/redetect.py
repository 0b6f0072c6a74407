"""Re-detection over all stored readings with chosen method and parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.operators.detectors import detect, validate_params
from sensorloom.operators.fleet import run_metrics
from sensorloom.scale import DEFAULT, Scale
from sensorloom.schema import DEFAULT_THRESHOLD, DEFAULT_WINDOW
from sensorloom.sources.store import Change, Store
from sensorloom.sources.tables import READING_COLUMNS, log_run, write_anomalies

# fixed: the published report
EMPTY = "No sensor data to analyze. Upload a CSV first."


def rerun_detection(store: Store, method: str, threshold: float = DEFAULT_THRESHOLD,
                    window: int = DEFAULT_WINDOW, scale: Scale = DEFAULT) -> dict:
    """Replace the anomaly table by a new run; the run is logged under the dataset that changed last, if any.

    Anomalies and log are published together, from readings that are still the stored ones.
    """
    validate_params(method, threshold, window)

    def work(change: Change) -> dict:
        change.depends_on("sensor_readings")
        readings = change.read("sensor_readings").select(*READING_COLUMNS)
        if readings.isEmpty():
            return {"error": EMPTY}
        write_anomalies(change, detect(readings, method, threshold, window, scale), "replace")
        metrics = run_metrics(readings, change.read("anomalies"))
        params = {"method": method, "threshold": float(threshold), "window": window}
        # ids of streamed files say nothing about their order, times do
        latest = change.read("datasets").agg(F.max(F.struct("changed_at", "id"))["id"]).first()[0]
        run_id = log_run(change, latest, {**params, "engine": "spark"}, metrics) if latest is not None else None
        return {"run_id": run_id, "params": params, "metrics": metrics.first().asDict()}
    return store.retried(work)
