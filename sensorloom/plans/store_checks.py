"""Checked queries that write the given tables to a store and read them back."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.operators import fleet as fleet_ops
from sensorloom.operators import retrieval
from sensorloom.plans import maintenance
from sensorloom.plans.checks import check, rounded, rounded_sql
from sensorloom.plans.fixtures import Fixtures, profile_sql, with_shapes, zscore_sql
from sensorloom.plans.fleet_checks import EXPORT_SENSORS_SQL
from sensorloom.plans.redetect import rerun_detection
from sensorloom.plans.text_checks import CHUNKS, hits_sql
from sensorloom.schema import PARAMETERS
from sensorloom.sources import exports
from sensorloom.sources.tables import read_readings, statuses
from sensorloom.streaming.ingest import ingest_stream

ROW = ", ".join(["machine_id", "dataset_id", "ts", "row_id"])
#: machines that the delete queries take out
GONE = [3, 7, 11]


@check(with_shapes(
    f"SELECT {ROW}, round(temperature + CASE WHEN dataset_id = 1 THEN 1 ELSE 0 END, 6) AS temperature, "
    f"{rounded_sql(*PARAMETERS[1:])} FROM fw", "fw"))
def stored_readings(x: Fixtures) -> DataFrame:
    """A corrected upload takes the place of its own dataset only; a change that is not published leaves no trace."""
    store, rows = x.store(), x.readings()
    store.put_partitions("sensor_readings", rows)
    store.put_partitions("sensor_readings", rows.filter("dataset_id = 1").withColumn("temperature", F.col("temperature") + 1), [1])
    store.change().put_partitions("sensor_readings", rows.filter("dataset_id = 2 and machine_id < 5"), [0, 2])
    return rounded(read_readings(store), *PARAMETERS)


@check(with_shapes(f"SELECT {ROW}, {rounded_sql(*PARAMETERS)} FROM fw "
                   f"WHERE dataset_id = 0 OR dataset_id = 1 AND machine_id NOT IN {tuple(GONE)}", "fw"))
def stored_deletes(x: Fixtures) -> DataFrame:
    """Machines are deleted without a rewrite; a dataset that is uploaded again has them back, a dropped one is gone."""
    store, rows = x.store(), x.readings()
    store.put_partitions("sensor_readings", rows)
    store.delete_keys("sensor_readings", GONE)
    store.put_partitions("sensor_readings", rows.filter("dataset_id = 0"), [0])
    store.drop_partition("sensor_readings", 2)
    return rounded(read_readings(store), *PARAMETERS)


DELETED = "SELECT id FROM md WHERE id NOT IN (SELECT machine_id FROM ew WHERE dataset_id <> 1 AND machine_id <> 3)"


@check(with_shapes(
    "SELECT 'machine' AS kind, id, CAST(NULL AS VARCHAR) AS parameter, CAST(NULL AS TIMESTAMP) AS ts FROM md "
    f"WHERE id NOT IN ({DELETED}) UNION ALL "
    f"SELECT 'anomaly', machine_id, parameter, ts FROM aw WHERE dataset_id <> 1 AND machine_id NOT IN ({DELETED})", "aw", "md"))
def stored_orphans(x: Fixtures) -> DataFrame:
    """A machine is deleted, then a dataset: the machines and anomalies that are left."""
    store = x.store()
    store.append("machines", x.machines())
    store.put_partitions("sensor_readings", x.readings())
    store.put_partitions("anomalies", x.wide_anomalies())
    maintenance.delete_stored_machine(store, 3)
    maintenance.delete_stored_dataset(store, 1)
    machines = store.read("machines").select(F.lit("machine").alias("kind"), "id")
    return machines.unionByName(store.read("anomalies").select(
        F.lit("anomaly").alias("kind"), F.col("machine_id").alias("id"), "parameter", "ts"), allowMissingColumns=True)


SHOWN = ["machine_id", "dataset_id", "parameter", "ts", "value", "severity", "is_trending", "method"]


@check(with_shapes(f"SELECT {', '.join(SHOWN)}, {rounded_sql('z_score', 'trend_slope')} FROM ({zscore_sql('fl', 3.0)})", "fl"))
def stored_redetection(x: Fixtures) -> DataFrame:
    store = x.store()
    store.put_partitions("sensor_readings", x.readings())
    store.put_partitions("anomalies", x.wide_anomalies().filter("severity = 'HIGH'"))
    rerun_detection(store, "zscore")
    return rounded(store.read("anomalies"), "z_score", "trend_slope").select(*SHOWN, "z_score", "trend_slope")


#: machine names of the streamed files: one series for each machine and file
FILE_MACHINE = 1_000_000
STREAMED = {"ew": "SELECT (event_id % 3) * 1000000 + user_id AS machine_id, event_id % 3 AS dataset_id, ts, event_id AS row_id, "
                  + ", ".join(f"CASE WHEN event_type = '{e}' THEN value END AS {p}" for e, p in zip(
                      ("view", "click", "purchase", "error"), PARAMETERS, strict=True)) + " FROM events"}


def streamed(x: Fixtures):
    """A store that took in the events as one CSV file for each dataset, and a file without the needed columns."""
    store, folder = x.store(), x.folder()
    rows = x.wide_events().select(
        "dataset_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        (F.col("dataset_id") * FILE_MACHINE + F.col("machine_id")).alias("machine_id"), *PARAMETERS)

    def write(dataset: int, name: str) -> None:
        # one file each, written side by side from events that many tasks read
        exports.write_csv(rows.filter(F.col("dataset_id") == dataset).drop("dataset_id").repartition(1), f"{folder}/in/{name}")
    with ThreadPoolExecutor(3) as writers:
        list(writers.map(write, range(3), "abc"))
    exports.write_csv(rows.limit(3).select("timestamp", "rpm").coalesce(1), f"{folder}/in/d")
    ingest_stream(x.spark, f"{folder}/in/*", store, f"{folder}/progress").awaitTermination()
    return store


@check(with_shapes(
    f"SELECT machine_id::VARCHAR AS machine, parameter, ts, value, severity, is_trending, {rounded_sql('z_score', 'trend_slope')} "
    f"FROM ({zscore_sql('fl', 3.0, gate=3, signed=True, method='upload')})", "fl", extra=STREAMED))
def streamed_anomalies(x: Fixtures) -> DataFrame:
    store = streamed(x)
    found = fleet_ops.with_machine_name(store.read("anomalies"), store.read("machines"))
    return rounded(found, "z_score", "trend_slope").select(
        "machine", "parameter", "ts", "value", "severity", "is_trending", "z_score", "trend_slope")


@check(with_shapes(
    "SELECT 'completed' AS status, count(*) AS row_count, count(DISTINCT machine_id)::DOUBLE AS machines, "
    "(SELECT count(*) FROM up WHERE up.dataset_id = ew.dataset_id)::DOUBLE AS anomalies_detected, "
    "(SELECT count(*) FILTER (severity = 'HIGH') FROM up WHERE up.dataset_id = ew.dataset_id)::DOUBLE AS high_severity "
    "FROM ew GROUP BY dataset_id UNION ALL SELECT 'failed', NULL, NULL, NULL, NULL", "fl",
    extra=STREAMED | {"up": zscore_sql("fl", 3.0, gate=3, signed=True, method="upload")}))
def streamed_registry(x: Fixtures) -> DataFrame:
    store = streamed(x)
    runs = store.read("etl_runs").select(F.col("dataset_id").alias("id"), "metrics")
    rows = statuses(store, "datasets").join(runs, "id", "left")
    return rows.select("status", "row_count", *[F.col("metrics")[c].alias(c) for c in (
        "machines", "anomalies_detected", "high_severity")])


@check(EXPORT_SENSORS_SQL)
def exported_csv(x: Fixtures) -> DataFrame:
    """The export written as CSV and read back."""
    folder = x.folder()
    exports.export_sensors(x.readings(), x.machines(), folder)
    kinds = ", ".join(["machine string", "timestamp string", *[f"{c} double" for c in [*PARAMETERS, *exports.ROLLING]]])
    return rounded(x.spark.read.schema(kinds).csv(folder, header=True), *PARAMETERS, *exports.ROLLING)


MANUAL = CHUNKS | {
    "pages": "SELECT 'manual' AS source, doc_id + 1 AS page, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM documents",
    "ch": "SELECT sha256(concat_ws('|', source, page, segment, i - 1)) AS id, source, page::INTEGER AS page, "
          "coalesce(section, '') AS section, parts[i] AS text, embedding::DOUBLE[] AS embedding FROM ("
          "SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM cut) JOIN embeddings ON vec_id = page - 1 AND segment = 0 AND i = 1"}


@check(with_shapes("SELECT query_id, rank::INTEGER AS rank, id, source, page, section, snippet, "
                   f"round(1.0 / (1.0 + distance), 3) AS score FROM ({hits_sql('qv', 5)})", "qv", extra=MANUAL))
def manual_retrieval(x: Fixtures) -> DataFrame:
    """A manual goes in with vectors for some of its chunks, questions meet what is stored."""
    vectors = x.table("embeddings").select((F.col("vec_id") + 1).alias("page"), "embedding")

    def embed(chunks: DataFrame) -> DataFrame:
        return chunks.filter("segment = 0 and pos = 0").join(vectors, "page")

    store, pages = x.store(), x.table("documents").select((F.col("doc_id") + 1).alias("page"), "text")
    maintenance.ingest_manual(store, pages, 1, "manual", embed)
    return retrieval.retrieve(x.centroids(), store.read("manuals"), 5).drop("distance")


@check(with_shapes(
    f"SELECT id, round(mean, 6) AS mean, (SELECT count(*) FROM aw WHERE machine_id = 5) AS anomalies FROM ({profile_sql('fl')}) "
    "JOIN md ON id = machine_id WHERE machine_id = 5 AND parameter = 'pressure'", "aw", "md"))
def machine_slice(x: Fixtures) -> DataFrame:
    """One machine's slice of every table."""
    detail = fleet_ops.machine_detail(5, x.machines(), x.readings(), x.wide_anomalies())
    mean = detail.readings.groupBy("machine_id").agg(F.round(F.avg("pressure"), 6).alias("mean"))
    found = detail.anomalies.groupBy("machine_id").agg(F.count(F.lit(1)).alias("anomalies"))
    health = detail.health.select(F.col("id").alias("machine_id"))
    return (health.join(mean, "machine_id").join(found, "machine_id", "left").select(F.col("machine_id").alias("id"), "mean", 
        F.coalesce("anomalies", F.lit(0)).alias("anomalies")))
