"""Time-ordered windows over series of any length.

An ordinary series is one window partition. A series too long for one task is cut into spans of
equal row count by its exact row index, and each span repeats the last ``look_back`` rows of the
span before it, flagged as halo. Every bounded frame then sees the rows it would have seen in the
undivided series, so results are identical; halo rows are dropped at the end.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from sensorloom.functions.cleaning import micros
from sensorloom.scale import DEFAULT, Scale, long_series

HALO = "_halo"
SPAN = "_span"
INDEX = "_idx"


@dataclass
class Ordered:
    """A frame with the window partitioning and order that suit its series lengths."""

    frame: DataFrame
    keys: list[str]
    partition: list[str]
    order: list[str]
    #: the rows as they were given
    source: DataFrame

    @property
    def split(self) -> bool:
        return self.partition != self.keys

    @cached_property
    def _spec(self) -> WindowSpec:
        return Window.partitionBy(*self.partition).orderBy(*self.order)

    @cached_property
    def _whole(self) -> WindowSpec:
        return self._spec.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    @cached_property
    def _so_far(self) -> WindowSpec:
        return self._spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def window(self, start: int | None = None, end: int | None = None) -> WindowSpec:
        return self._spec if start is None or end is None else self._spec.rowsBetween(start, end)

    def whole(self) -> WindowSpec:
        """Every row of the window partition, in order."""
        return self._whole

    def so_far(self) -> WindowSpec:
        return self._so_far

    def done(self, frame: DataFrame, keep_index: bool = False) -> DataFrame:
        """Drop the halo rows and the columns that served the ordering."""
        if not self.split:
            return frame
        return frame.filter(~F.col(HALO)).drop(HALO, SPAN, *([] if keep_index else [INDEX]))


def _indexed(df: DataFrame, keys: list[str], time: str, tie: str, found: DataFrame, scale: Scale) -> DataFrame:
    """Exact 0-based index: rank inside a time cell plus the rows of earlier cells."""
    width = F.broadcast(found) if found.count() <= scale.broadcast_rows else found
    cells = df.join(width.drop("rows"), keys, "left").withColumn(
        "_cell", F.coalesce(F.floor(micros(F.col(time)) / F.col("_cell_us")), F.lit(0)))
    earlier = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = (cells.filter(F.col("_cell_us").isNotNull())
              .groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"))
              .select(*keys, "_cell", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")))
    inside = Window.partitionBy(*keys, "_cell").orderBy(time, tie)
    return (cells.withColumn("_rank", F.row_number().over(inside) - 1)
            .join(starts, [*keys, "_cell"], "left")
            .withColumn(INDEX, F.col("_rank") + F.coalesce("_start", F.lit(0)))
            .drop("_cell_us", "_cell", "_rank", "_start"))


def with_index(df: DataFrame, keys: list[str], time: str = "ts", tie: str = "row_id",
               scale: Scale = DEFAULT, name: str = "idx") -> DataFrame:
    """Add the 0-based position of each row in its series."""
    found = long_series(df, keys, time, scale)
    if found is None:
        spec = Window.partitionBy(*keys).orderBy(time, tie)
        return df.withColumn(name, (F.row_number().over(spec) - 1).cast("long"))
    return _indexed(df, keys, time, tie, found, scale).withColumnRenamed(INDEX, name)


def ordered(df: DataFrame, keys: list[str], time: str = "ts", tie: str = "row_id",
            look_back: int = 0, scale: Scale = DEFAULT, split: bool | None = None) -> Ordered:
    """Prepare ``df`` for windows that look back at most ``look_back`` rows.

    ``split`` carries the answer of an earlier call on the same series: False skips the check,
    True expects the index kept by ``done(..., keep_index=True)``.
    """
    if not split:
        found = None if split is False else long_series(df, keys, time, scale)
        if found is None:
            return Ordered(df, keys, keys, [time, tie], df)
        indexed = _indexed(df, keys, time, tie, found, scale)
    else:
        indexed = df
    size = max(scale.task_rows, look_back)
    home = F.floor(F.col(INDEX) / size)
    spans = F.when(F.col(INDEX) % size >= size - look_back, F.array(home, home + 1)).otherwise(F.array(home))
    frame = indexed.withColumn(SPAN, F.explode(spans)).withColumn(HALO, F.col(SPAN) != home)
    return Ordered(frame, keys, [*keys, SPAN], [INDEX], df)


def carried(o: Ordered, cols: list[str]) -> tuple[DataFrame, dict[str, Column], dict[str, Column]]:
    """Nearest non-null value of each column before and after the span of each row.

    One row per span is summarised, so the running step is small whatever the series length.
    Returns the frame with the values joined on, and expressions for them.
    """
    if not o.split:
        none = {c: F.lit(None).cast("double") for c in cols}
        return o.frame, none, none
    def seen(c):
        return F.when(F.col(c).isNotNull() & ~F.col(HALO), F.col(INDEX))
    ends = o.frame.groupBy(*o.partition).agg(
        *[F.max_by(c, seen(c)).alias(f"_last_{c}") for c in cols],
        *[F.min_by(c, seen(c)).alias(f"_first_{c}") for c in cols])
    # "after" runs over the reversed order: growing frames cost one step per row, shrinking ones do not
    before = Window.partitionBy(*o.keys).orderBy(SPAN).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*o.keys).orderBy(F.desc(SPAN)).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(
        *o.partition,
        *[F.last(f"_last_{c}", ignorenulls=True).over(before).alias(f"_before_{c}") for c in cols],
        *[F.last(f"_first_{c}", ignorenulls=True).over(after).alias(f"_after_{c}") for c in cols])
    frame = o.frame.join(ends, o.partition)
    return (frame, {c: F.col(f"_before_{c}") for c in cols}, {c: F.col(f"_after_{c}") for c in cols})


def last_rows(df: DataFrame, keys: list[str], n: int, order: list[Column], rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each key in ``order``, ranked from 1.

    The planner cuts each map task's rows to ``n`` per key before the shuffle, so a key holding
    most of the table costs no more than any other.
    """
    spec = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(spec)).filter(F.col(rank) <= n)
