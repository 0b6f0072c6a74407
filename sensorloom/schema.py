"""Names, fixed values and table schemas shared by every module."""

from __future__ import annotations

from pyspark.sql import types as T

# These must equal the published behaviour for results to match.
PARAMETERS = ["temperature", "pressure", "vibration", "rpm"]
REQUIRED_COLUMNS = ["timestamp", "machine_id", "temperature", "pressure", "vibration", "rpm"]
SEVERITIES = ["HIGH", "MEDIUM", "MONITOR"]
VERDICTS = ["URGENT_SERVICE", "SCHEDULE_SERVICE", "MONITOR", "SAFE"]
STATUSES = ["pending", "processing", "completed", "failed"]
METHODS = ["zscore", "rolling_z", "ewma", "iqr", "isolation_forest"]
DEFAULT_THRESHOLD = 3.0
DEFAULT_WINDOW = 10
UPLOAD_MIN_POINTS = 3
DETECT_MIN_POINTS = 5
TREND_CUT = 1.0
# parameter -> (service limit, unit); None means the parameter has no upper limit
SERVICE_LIMITS = {
    "temperature": (75.0, "°C"),
    "vibration": (4.0, "mm/s"),
    "pressure": (165.0, "bar"),
    "rpm": (None, "rpm"),
}
HORIZON_DAYS = 120
SPARK_POINTS = 48
DIGEST_LINES = 40
RECENT_RUNS = 25
HISTORY_MESSAGES = 6
CHUNK_SIZE = 800
CHUNK_OVERLAP = 120
SNIPPET_CHARS = 500
ERROR_CHARS = 2000
RETRIEVE_K = 4
RECOMMEND_K = 5
NO_ANOMALIES = "No anomalies detected in the analyzed sensor data."

#: one series is one parameter of one machine
SERIES_KEY = ["machine_id", "parameter"]

CITATION = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("snippet", T.StringType()),
    T.StructField("page", T.IntegerType()),
    T.StructField("section", T.StringType()),
    T.StructField("score", T.DoubleType()),
])


def _values(suffix: str = "") -> str:
    return ", ".join(f"{p}{suffix} double" for p in PARAMETERS)


#: DDL of every table the store keeps
TABLES = {
    "machines": "id long, name string, machine_type string, location string, created_at timestamp_ntz",
    "datasets": "id long, user_id long, filename string, uploaded_at timestamp_ntz, row_count long, "
                "status string, error string, changed_at timestamp_ntz",
    "sensor_readings": f"machine_id long, dataset_id long, ts timestamp_ntz, row_id long, {_values()}, "
                       f"{_values('_roll_avg')}, {_values('_roc')}",
    "anomalies": "machine_id long, dataset_id long, parameter string, ts timestamp_ntz, value double, "
                 "z_score double, severity string, is_trending boolean, trend_slope double, method string",
    "etl_runs": "dataset_id long, run_id string, params struct<method:string,threshold:double,"
                "window:int,engine:string>, metrics map<string,double>, created_at timestamp_ntz",
    "documents": "id long, user_id long, filename string, uploaded_at timestamp_ntz, status string, "
                 "chunk_count long, error string, changed_at timestamp_ntz",
    "recommendations": "id long, user_id long, machine_id long, session_id string, question string, "
                       "verdict string, explanation string, citations array<struct<source:string,"
                       "snippet:string,page:int,section:string,score:double>>, created_at timestamp_ntz",
    "chat_messages": "session_id string, role string, content string, created_at timestamp_ntz",
    "maintenance_logs": "id long, recommendation_id long, machine_id long, actioned boolean, notes string, "
                        "actioned_at timestamp_ntz, created_at timestamp_ntz",
    "manuals": "id string, source string, page int, section string, text string, embedding array<float>",
}
#: tables laid out in directories by this column
PARTITIONED_BY = {"sensor_readings": "dataset_id", "anomalies": "dataset_id", "manuals": "source"}
