"""Deletes, resets and change merges: as pure functions of tables, and over the stored tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.operators.chunks import build_chunks, chunk_counts, with_vectors
from sensorloom.operators.records import apply_log_changes, drop_keys, orphan_machines
from sensorloom.scale import DEFAULT, cut
from sensorloom.schema import TABLES
from sensorloom.sources.store import Change, Store
from sensorloom.sources.tables import set_status


@dataclass
class FleetTables:
    machines: DataFrame
    readings: DataFrame
    anomalies: DataFrame
    runs: DataFrame


def delete_dataset(tables: FleetTables, dataset_id: int) -> FleetTables:
    """Drop a dataset's rows everywhere, then machines left without readings and their anomalies."""
    def kept(df: DataFrame) -> DataFrame:
        return df.filter(~F.col("dataset_id").eqNullSafe(F.lit(dataset_id)))

    readings = kept(tables.readings)
    orphans = orphan_machines(tables.machines, readings).select("id", F.col("id").alias("machine_id"))
    return FleetTables(
        drop_keys(tables.machines, orphans, "id"), readings,
        drop_keys(kept(tables.anomalies), orphans, "machine_id"), kept(tables.runs))


def delete_machine(tables: FleetTables, machine_id: int) -> FleetTables:
    def kept(df: DataFrame, column: str = "machine_id") -> DataFrame:
        return df.filter(~F.col(column).eqNullSafe(F.lit(machine_id)))

    return FleetTables(kept(tables.machines, "id"), kept(tables.readings), kept(tables.anomalies), tables.runs)


def stored_tables(store: Store) -> FleetTables:
    return FleetTables(*[store.read(n) for n in ("machines", "sensor_readings", "anomalies", "etl_runs")])


def delete_stored_dataset(store: Store, dataset_id: int) -> None:
    """Readings and anomalies lose one partition, orphaned machines are noted as deleted; published together.

    Only the small tables are rewritten, and the readings that are left are looked at once. The dataset can be
    uploaded again under its key.
    """
    def work(change: Change) -> None:
        change.depends_on("sensor_readings")  # the orphans are read from it
        change.drop_partition("sensor_readings", dataset_id)
        change.drop_partition("anomalies", dataset_id)
        orphans = cut(orphan_machines(change.read("machines"), change.read("sensor_readings")).select("id"))
        if not orphans.isEmpty():
            gone = orphans.select("id", F.col("id").alias("machine_id"))
            few = orphans.limit(DEFAULT.broadcast_rows + 1).collect()
            if len(few) <= DEFAULT.broadcast_rows:
                change.delete_keys("anomalies", [r["id"] for r in few])
            else:
                change.replace("anomalies", drop_keys(change.read("anomalies"), gone, "machine_id"), computed=True)
            change.replace("machines", drop_keys(change.read("machines"), gone, "id"), computed=True)
        for name, key in (("etl_runs", "dataset_id"), ("datasets", "id")):
            rows = change.read(name)
            change.replace(name, rows.filter(~F.col(key).eqNullSafe(F.lit(dataset_id))), computed=True)
    store.retried(work)


def delete_stored_machine(store: Store, machine_id: int) -> None:
    """Note the machine as deleted: later reads leave its readings and anomalies out, no file of theirs is written."""
    def work(change: Change) -> None:
        change.delete_keys("sensor_readings", [machine_id])
        change.delete_keys("anomalies", [machine_id])
        change.replace("machines", change.read("machines").filter(F.col("id") != machine_id), computed=True)
    store.retried(work)


def reset_tables(store: Store) -> None:
    """Empty every table at once, the chunk table included."""
    def work(change: Change) -> None:
        for name in TABLES:
            change.clear(name)
    store.retried(work)


def reset_chunks(store: Store) -> None:
    store.clear("manuals")


def merge_log_changes(store: Store, changes: DataFrame) -> None:
    store.update("maintenance_logs", lambda logs: apply_log_changes(logs, changes))


def ingest_manual(store: Store, pages: DataFrame, document_id: int, filename: str,
                  embed: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """Chunk the pages of one manual into the chunk table; returns the number of chunks.

    ``embed`` turns the chunks into (id, embedding); a chunk that it leaves out gets no vector and is near to
    nothing. Chunks and status are published together, so a manual that fails leaves its earlier chunks.
    """
    one = store.spark.createDataFrame([(document_id, filename)], "id long, filename string")
    set_status(store, "documents", one, "processing")

    def work(change: Change) -> int:
        chunks = build_chunks(pages.withColumn("source", F.lit(filename)))
        change.put_partitions("manuals", with_vectors(chunks, embed(chunks)) if embed else chunks, [filename])
        counts = chunk_counts(change.read("manuals").filter(F.col("source") == filename)).first()
        count = counts["chunk_count"] if counts else 0
        set_status(change, "documents", one.withColumn("chunk_count", F.lit(count)), "completed")
        return count

    try:
        return store.retried(work)
    except Exception as error:  # the registry is the report of a failed manual
        set_status(store, "documents", one.withColumn("error", F.lit(str(error))), "failed")
        return 0


def delete_manual(store: Store, source: str) -> None:
    store.drop_partition("manuals", source)
