"""Size checks that choose between the one-task-per-series plans and the split plans.

Nothing here looks at data when the planner's own size estimate already proves the input small;
otherwise one narrow aggregate measures it. The split plans are exact, not approximations.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.functions.cleaning import micros

HOUR_US = 3_600_000_000


@dataclass(frozen=True)
class Scale:
    """Limits used by the size checks."""

    #: most rows of one series that a single task may order
    task_rows: int = 2_000_000
    #: an input whose files total less than this fits one task whatever its skew
    small_bytes: int = 256 << 20
    #: most rows of a keyed side table that may be broadcast
    broadcast_rows: int = 200_000
    #: accuracy of the brackets from which exact quantiles of long series are refined
    quantile_accuracy: int = 100_000


DEFAULT = Scale()


def input_bytes(df: DataFrame) -> int:
    """Upper estimate of the bytes read by ``df``: the sum over the relations it names."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def is_small(df: DataFrame, scale: Scale) -> bool:
    return input_bytes(df) <= scale.small_bytes


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster names it; without one it is the warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder of the session, so lost executors cost no recomputation."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()


def attach(rows: DataFrame, side: DataFrame, on: list[str], scale: Scale = DEFAULT,
           how: str = "inner", keys_from: DataFrame | None = None) -> DataFrame:
    """Join a side table holding at most one row per key of ``rows``.

    Small inputs are left to the planner, which sees their size. For large ones the rows of the side are
    counted (by its keys in ``keys_from`` where those are cheaper to count and bound them): a bounded
    side is broadcast so ``rows`` is not moved, any other is shuffled, where adaptive skew handling
    splits a hot key of ``rows``.
    """
    if not is_small(rows, scale):
        counted = side if keys_from is None else keys_from.select(*on).distinct()
        if counted.limit(scale.broadcast_rows + 1).count() <= scale.broadcast_rows:
            side = F.broadcast(side)
    return rows.join(side, on, how)


def long_series(df: DataFrame, keys: list[str], time: str, scale: Scale) -> DataFrame | None:
    """Series with more rows than one task should order, or None if there is none.

    Columns: ``keys``, ``rows`` and ``_cell_us``, the width of time cell that holds at most
    ``task_rows`` rows at the busiest hour of the series. Outlying timestamps cost nothing,
    because the density is measured over the hours that hold data.
    """
    if is_small(df, scale):
        return None
    hours = df.groupBy(*keys, F.floor(micros(F.col(time)) / HOUR_US).alias("_hour")).agg(
        F.count(F.lit(1)).alias("_n"))
    per_series = hours.groupBy(*keys).agg(F.sum("_n").alias("rows"), F.max("_n").alias("_peak"))
    wide = F.floor(F.lit(scale.task_rows) / F.col("_peak"))
    narrow = F.ceil(F.col("_peak") / F.lit(scale.task_rows))
    width = F.when(wide >= 1, wide * HOUR_US).otherwise(F.greatest(F.floor(HOUR_US / narrow), F.lit(1)))
    found = cut(per_series.filter(F.col("rows") > scale.task_rows)
                .select(*keys, "rows", width.cast("long").alias("_cell_us")))
    return None if found.isEmpty() else found
