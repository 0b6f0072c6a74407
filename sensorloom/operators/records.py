"""Keyed-table operators: keys, deletes, change merges, ordered lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.functions.cleaning import machine_type
from sensorloom.scale import cut
from sensorloom.schema import RECENT_RUNS


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def dense_index(rows: DataFrame, order: str, into: str) -> DataFrame:
    """Number rows from 0 in the order of a column, ties in any order.

    Rows are range-partitioned and written, then the counts of the partitions say where each of them
    starts; only these counts meet in one task.
    """
    ranged = rows.repartitionByRange(order).sortWithinPartitions(order)
    placed = cut(ranged.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}))
    parts = placed.groupBy("_part").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return (placed.join(F.broadcast(starts), "_part")
            .withColumn(into, F.col("_start") + F.col("_place") - F.col("_first")).drop("_part", "_place", "_first", "_start"))


def new_machines(names: DataFrame, machines: DataFrame) -> DataFrame:
    """A row for every unknown name; the keys follow the sorted order of the names, after the highest known key."""
    new = distinct_values(names.filter(F.col("name").isNotNull()), "name").join(
        machines.select("name"), "name", "left_anti")
    last = machines.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return dense_index(new, "name", "_at").select(
        (F.lit(last) + 1 + F.col("_at")).alias("id"), "name", machine_type(F.col("name")).alias("machine_type"))


def upsert_machines(names: DataFrame, machines: DataFrame) -> DataFrame:
    """``machines`` plus a row for every unknown name; known names keep their key."""
    return machines.unionByName(new_machines(names, machines), allowMissingColumns=True)


def orphan_machines(machines: DataFrame, readings: DataFrame) -> DataFrame:
    """Machines without any reading; readings shrink to their distinct machines map-side first."""
    used = distinct_values(readings, "machine_id").withColumnRenamed("machine_id", "id")
    return machines.join(used, "id", "left_anti")


def drop_keys(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key is not in the delete set."""
    return df.join(keys.select(on).distinct(), on, "left_anti")


def logs_with_recommendation(logs: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Maintenance logs with the question and verdict they answer."""
    asked = recommendations.select(F.col("id").alias("recommendation_id"), "question", "verdict")
    return logs.join(asked, "recommendation_id", "left")


def apply_log_changes(logs: DataFrame, changes: DataFrame) -> DataFrame:
    """Merge change rows (id, changed_at, actioned, notes, deleted) into the logs.

    Changes to one log are folded in time order: the latest value given for a field wins. Setting
    ``actioned`` stamps ``actioned_at`` with the time of that change, clearing it empties the stamp.
    """
    def latest(value: str):
        return F.max_by(F.struct(value, "changed_at"), F.when(F.col(value).isNotNull(), F.col("changed_at")))

    folded = changes.groupBy("id").agg(
        latest("actioned").alias("_actioned"), latest("notes").alias("_notes"),
        F.max(F.coalesce("deleted", F.lit(False))).alias("_deleted"))
    acted = F.col("_actioned.actioned")
    return (
        logs.join(folded, "id", "left").filter(~F.coalesce("_deleted", F.lit(False)))
        .withColumn("notes", F.coalesce("_notes.notes", "notes"))
        .withColumn("actioned_at", F.when(acted.isNull(), F.col("actioned_at"))
                    .when(acted, F.col("_actioned.changed_at")))
        .withColumn("actioned", F.coalesce(acted, F.col("actioned")))
        .drop("_actioned", "_notes", "_deleted"))


def newest_first(df: DataFrame, time_col: str, user_id=None, tie: str = "id") -> DataFrame:
    """Newest first; only one user's rows when ``user_id`` is given."""
    rows = df if user_id is None else df.filter(F.col("user_id") == user_id)
    return rows.orderBy(F.desc(time_col), *([F.desc(tie)] if tie in df.columns else []))


def recent_runs(runs: DataFrame, n: int = RECENT_RUNS, time_col: str = "created_at", tie: str = "id") -> DataFrame:
    return newest_first(runs, time_col, tie=tie).limit(n)


def current_status(registry: DataFrame) -> DataFrame:
    """Latest row of each id in an append-only registry; later steps win at equal times."""
    columns = [c for c in registry.columns if c != "id"]
    step = F.array_position(F.array(*[F.lit(s) for s in ("pending", "processing", "completed", "failed")]),
                            F.col("status"))
    last = F.max_by(F.struct(*columns), F.struct("changed_at", step))
    return registry.groupBy("id").agg(last.alias("_r")).select("id", "_r.*")
