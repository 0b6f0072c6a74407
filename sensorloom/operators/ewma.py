"""Exponentially weighted mean of a series as windowed sums, with no per-row loop."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.operators.ordered import Ordered, ordered
from sensorloom.scale import DEFAULT, Scale
from sensorloom.schema import SERIES_KEY

#: log-decay per chunk: weights inside a chunk stay in double range, and what is carried from
#: two chunks back is below exp(-CHUNK_DECAY) of its size
CHUNK_DECAY = 200.0
#: log-decay after which earlier rows vanish in double precision
FORGOTTEN = 41.0


def look_back_rows(window: int) -> int:
    """Rows after which an earlier value no longer shows in double precision, at any null pattern."""
    if window == 1:
        return 0
    alpha = 2.0 / (window + 1)
    keep = -math.log(1.0 - alpha)
    slowest = min((g * keep + math.log(math.exp(-g * keep) + alpha)) / g for g in range(1, 20 * window))
    return math.ceil(FORGOTTEN / slowest)


def smoothed(o: Ordered, window: int) -> DataFrame:
    """The frame of ``o`` (halo included) with ``ewma`` on its non-null rows.

    With g rows since the last value the recurrence is y = A*y_prev + (1-A)*x, where
    A = q^g / (q^g + alpha). It is linear, so inside a chunk y = exp(-E) * sum((1-A)*x*exp(E)) with
    E the -ln A accumulated after the chunk's first row, which keeps exp(E) finite after any gap. The previous
    chunk's last value is decayed by E and by the first row's own -ln A.
    """
    if window == 1:
        return o.frame.filter(F.col("value").isNotNull()).withColumn("ewma", F.col("value"))
    alpha = 2.0 / (window + 1)
    keep = -math.log(1.0 - alpha)
    gap = F.col("_pos") - F.lag("_pos").over(o.window())
    decay = gap * keep + F.ln(F.exp(gap * -keep) + alpha)
    chunk = Window.partitionBy(*o.partition, "_chunk").orderBy(*o.order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*o.partition).orderBy("_chunk").rangeBetween(-1, -1)
    return (
        o.frame.withColumn("_pos", F.row_number().over(o.window()))
        .filter(F.col("value").isNotNull())
        .withColumn("_decay", decay)
        .withColumn("_weight", F.coalesce(1.0 - F.exp(-F.col("_decay")), F.lit(1.0)))
        .withColumn("_decay", F.coalesce("_decay", F.lit(0.0)))
        .withColumn("_chunk", F.floor(F.sum("_decay").over(o.so_far()) / CHUNK_DECAY))
        .withColumn("_first", F.first("_decay").over(chunk))
        .withColumn("_e", F.sum("_decay").over(chunk) - F.col("_first"))
        .withColumn("_part", F.exp(-F.col("_e"))
                    * F.sum(F.col("_weight") * F.col("value") * F.exp("_e")).over(chunk))
        .withColumn("_carry", F.max_by("_part", "_e").over(before))
        .withColumn("ewma", F.col("_part") + F.coalesce(
            F.exp(-F.col("_e") - F.col("_first")) * F.col("_carry"), F.lit(0.0)))
        .drop("_pos", "_decay", "_weight", "_chunk", "_first", "_e", "_part", "_carry")
    )


def ewma(series: DataFrame, window: int, keys: list[str] = SERIES_KEY, scale: Scale = DEFAULT) -> DataFrame:
    """Non-null rows of the series with their running mean of span ``window``, seeded by the first value."""
    o = ordered(series, keys, look_back=look_back_rows(window), scale=scale)
    return o.done(smoothed(o, window))
