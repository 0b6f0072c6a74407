"""Series shape, statistics, trend and quantiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.operators.ordered import HALO, SPAN, Ordered, ordered
from sensorloom.scale import DEFAULT, Scale, attach, cut, is_small
from sensorloom.schema import PARAMETERS, SERIES_KEY


def to_series(readings: DataFrame, id_cols: list[str]) -> DataFrame:
    """Wide readings to one row per (reading, parameter)."""
    return readings.unpivot(id_cols, PARAMETERS, "parameter", "value")


def series_stats(series: DataFrame, keys: list[str] = SERIES_KEY) -> DataFrame:
    """Count, mean, both deviations and extremes of the non-null values, in one map-side-combined pass."""
    return series.groupBy(*keys).agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.stddev_pop("value").alias("std_pop"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
    )


def with_series_stats(series: DataFrame, stats: DataFrame, keys: list[str] = SERIES_KEY,
                      scale: Scale = DEFAULT) -> DataFrame:
    return attach(series, stats, keys, scale)


def _slope(n, low, high, slope, std_pop):
    """Least-squares slope on position 0..n-1, times n over the population deviation.

    0 for fewer than three values and for flat series. A series is flat when its extremes meet:
    the computed deviation of equal values need not be exactly zero.
    """
    return F.when((n >= 3) & (low < high), F.try_divide(slope * n, std_pop)).otherwise(0.0)


def _placed(o: Ordered) -> DataFrame:
    """Non-null rows with their position 0..n-1 in the series as ``_place``."""
    if not o.split:
        rows = o.frame.filter(F.col("value").isNotNull())
        return rows.withColumn("_place", (F.row_number().over(o.window()) - 1).cast("double"))
    rows = o.frame.filter(~F.col(HALO) & F.col("value").isNotNull())
    earlier = Window.partitionBy(*o.keys).orderBy(SPAN).rowsBetween(Window.unboundedPreceding, -1)
    starts = (rows.groupBy(*o.partition).agg(F.count(F.lit(1)).alias("_n"))
              .select(*o.partition, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")))
    rank = F.row_number().over(o.window()) - 1
    return (rows.withColumn("_rank", rank).join(starts, o.partition)
            .withColumn("_place", (F.col("_rank") + F.col("_start")).cast("double")))


def _profile(o: Ordered) -> DataFrame:
    profile = _placed(o).groupBy(*o.keys).agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.stddev_pop("value").alias("std_pop"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.regr_slope("value", "_place").alias("_slope"),
    )
    columns = [F.col(c) for c in ("n", "low", "high", "_slope", "std_pop")]
    return profile.withColumn("trend_slope", _slope(*columns)).drop("_slope")


def series_profile(series: DataFrame, keys: list[str] = SERIES_KEY, scale: Scale = DEFAULT) -> DataFrame:
    """One row per series: its statistics and normalised trend slope."""
    return _profile(ordered(series.select(*keys, "ts", "row_id", "value"), keys, scale=scale))


def profiled(o: Ordered, scale: Scale = DEFAULT) -> DataFrame:
    """Every row with the profile of its series: n, mean, std, low, high, trend_slope.

    Ordinary series take all of it from windows over one exchange and one sort. When there are
    series too long for one task the profile is aggregated and joined back instead.
    """
    if o.split:
        return attach(o.frame, _profile(o).drop("std_pop"), o.keys, scale, keys_from=o.source)
    value, all_rows = F.col("value"), o.whole()
    place = F.when(value.isNotNull(), (F.count("value").over(o.so_far()) - 1).cast("double"))
    rows = o.frame.withColumn("_place", place).withColumns({
        "n": F.count("value").over(all_rows),
        "mean": F.avg("value").over(all_rows),
        "std": F.stddev_samp("value").over(all_rows),
        "low": F.min("value").over(all_rows),
        "high": F.max("value").over(all_rows),
        "_slope": F.regr_slope("value", "_place").over(all_rows),
        "_std_pop": F.stddev_pop("value").over(all_rows),
    })
    columns = [F.col(c) for c in ("n", "low", "high", "_slope", "_std_pop")]
    return rows.withColumn("trend_slope", _slope(*columns)).drop("_place", "_slope", "_std_pop")


def profiled_rows(o: Ordered, scale: Scale = DEFAULT) -> DataFrame:
    """The given rows with their profile, for methods that need no order of their own.

    Next to long series the rows are not moved at all when the profiles can be broadcast.
    """
    if o.split:
        return attach(o.source, _profile(o).drop("std_pop"), o.keys, scale)
    return profiled(o, scale)


def trend_slope(series: DataFrame, keys: list[str] = SERIES_KEY, scale: Scale = DEFAULT) -> DataFrame:
    return series_profile(series, keys, scale).select(*keys, "n", "trend_slope")


def quantiles(series: DataFrame, fractions: list[float], keys: list[str] = SERIES_KEY,
              approx: bool = False, scale: Scale = DEFAULT) -> DataFrame:
    """Linearly interpolated quantiles per series as ``q0, q1, ...`` in the order of ``fractions``.

    The built-in exact percentile keeps the distinct values of a series in one buffer, so series
    beyond ``task_rows`` are refined from brackets instead (exact as well).
    """
    values = series.select(*keys, "value").filter(F.col("value").isNotNull())
    probs = F.array(*[F.lit(f) for f in fractions])
    picked = [F.col("_q")[i].alias(f"q{i}") for i in range(len(fractions))]

    def built_in(df: DataFrame) -> DataFrame:
        exact = F.percentile_approx("value", fractions) if approx else F.percentile("value", probs)
        return df.groupBy(*keys).agg(exact.alias("_q")).select(*keys, *picked)

    if approx or is_small(series, scale):
        return built_in(values)
    limit = max(scale.task_rows, 4 * scale.quantile_accuracy)
    counts = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    found = cut(counts.filter(F.col("n") > limit))
    hot = found.count()
    if hot == 0:
        return built_in(values)
    side = F.broadcast(found) if hot <= scale.broadcast_rows else found
    ordinary = built_in(values.join(side, keys, "left_anti"))
    return ordinary.unionByName(_bracketed(values.join(side, keys), fractions, keys, hot, scale))


def _bracketed(values: DataFrame, fractions: list[float], keys: list[str], hot: int, scale: Scale) -> DataFrame:
    """Exact quantiles of very long series.

    A mergeable sketch brackets each target rank within n/accuracy places; the rows below the
    bracket are only counted, and only the few inside it are ordered.
    """
    margin = 2.0 / scale.quantile_accuracy
    edges = [min(max(f + s * margin, 0.0), 1.0) for f in fractions for s in (-1, 1)]
    sketch = cut(values.groupBy(*keys).agg(
        F.percentile_approx("value", edges, scale.quantile_accuracy).alias("_edge")))
    side = F.broadcast(sketch) if hot <= scale.broadcast_rows else sketch
    targets = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(float(f)).alias("f"),
                 F.col("_edge")[2 * i].alias("lo"), F.col("_edge")[2 * i + 1].alias("hi"))
        for i, f in enumerate(fractions)])
    zoned = (values.join(side, keys).select(*keys, "n", "value", F.inline(targets))
             .filter(F.col("value") <= F.col("hi"))
             .withColumn("_in", F.when(F.col("value") >= F.col("lo"), F.col("value"))))
    weights = zoned.groupBy(*keys, "n", "i", "f", "_in").agg(F.count(F.lit(1)).alias("_w"))
    upto = (Window.partitionBy(*keys, "i").orderBy(F.col("_in").asc_nulls_first())
            .rowsBetween(Window.unboundedPreceding, 0))
    place = (F.col("n") - 1) * F.col("f")
    picked = (weights.withColumn("_cum", F.sum("_w").over(upto)).withColumn("_place", place)
              .groupBy(*keys, "i").agg(
                  F.min(F.when(F.col("_cum") > F.floor("_place"), F.col("_in"))).alias("_a"),
                  F.min(F.when(F.col("_cum") > F.ceil("_place"), F.col("_in"))).alias("_b"),
                  F.first(F.col("_place") - F.floor("_place")).alias("_part")))
    value = F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part")
    return picked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("i") == i, value)).alias(f"q{i}") for i in range(len(fractions))])


def quartiles(series: DataFrame, approx: bool = False, keys: list[str] = SERIES_KEY,
              scale: Scale = DEFAULT) -> DataFrame:
    return quantiles(series, [0.25, 0.75], keys, approx, scale).select(
        *keys, F.col("q0").alias("q1"), F.col("q1").alias("q3"))
