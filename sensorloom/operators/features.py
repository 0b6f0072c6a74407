"""Cleaning, gap filling and rolling features of raw readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.functions.cleaning import (
    canonical_machine_id, fahrenheit_to_celsius, nan_to_null, parse_ts, to_number)
from sensorloom.operators.ordered import carried, ordered
from sensorloom.scale import DEFAULT, Scale
from sensorloom.schema import DEFAULT_WINDOW, PARAMETERS

MACHINE = ["machine_id"]


def clean(raw: DataFrame) -> DataFrame:
    """Typed readings; rows without a readable time or a machine id are dropped.

    Equal timestamps are ordered by ``row_id``: the caller's, or a hash of the row's own content,
    which is the same on every evaluation.
    """
    types = dict(raw.dtypes)

    def number(name: str) -> Column:
        text = types[name] == "string"
        return to_number(F.col(name)) if text else nan_to_null(F.col(name).cast("double"))

    ts = parse_ts(F.col("timestamp")) if types["timestamp"] == "string" else F.col("timestamp").cast("timestamp_ntz")
    temperature = number("temperature")
    if "temp_unit" in raw.columns:
        temperature = fahrenheit_to_celsius(temperature, F.col("temp_unit"))
    row_id = F.col("row_id") if "row_id" in raw.columns else F.xxhash64(*raw.columns)
    dataset = [F.col("dataset_id")] if "dataset_id" in raw.columns else []
    typed = raw.select(
        canonical_machine_id(F.col("machine_id")).alias("machine_id"), *dataset, ts.alias("ts"),
        row_id.alias("row_id"), temperature.alias("temperature"),
        *[number(p).alias(p) for p in PARAMETERS[1:]])
    return typed.filter(F.col("ts").isNotNull() & F.col("machine_id").isNotNull())


def fill_forward(df: DataFrame, cols: list[str] = PARAMETERS, keys: list[str] = MACHINE,
                 scale: Scale = DEFAULT) -> DataFrame:
    """Nulls take the latest earlier value of their machine."""
    o = ordered(df, keys, scale=scale)
    frame, before, _ = carried(o, cols)
    filled = {c: F.coalesce(F.last(c, ignorenulls=True).over(o.so_far()), before[c]) for c in cols}
    return o.done(frame.withColumns(filled)).select(*df.columns)


def fill_backward(df: DataFrame, cols: list[str] = PARAMETERS, keys: list[str] = MACHINE,
                  scale: Scale = DEFAULT) -> DataFrame:
    """Nulls take the earliest later value of their machine (a growing frame over reversed time)."""
    o = ordered(df, keys, scale=scale)
    frame, _, after = carried(o, cols)
    reverse = (Window.partitionBy(*o.partition).orderBy(*[F.desc(c) for c in o.order])
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    filled = {c: F.coalesce(F.last(c, ignorenulls=True).over(reverse), after[c]) for c in cols}
    return o.done(frame.withColumns(filled)).select(*df.columns)


def _fill(df: DataFrame, cols: list[str], keys: list[str], scale: Scale, keep_index: bool):
    """Forward then backward fill in one pass.

    What is still null after the forward fill leads its series, so the backward fill is the first
    value of the series: no second ordering is needed. A median fill afterwards could only meet
    columns with no value at all, whose median is null too, so there is none.
    """
    o = ordered(df, keys, scale=scale)
    frame, before, after = carried(o, cols)
    filled = {
        c: F.coalesce(F.last(c, ignorenulls=True).over(o.so_far()), before[c],
                      F.first(c, ignorenulls=True).over(o.whole()), after[c])
        for c in cols}
    kept = o.done(frame.withColumns(filled), keep_index)
    return kept.drop(*[c for c in kept.columns if c.startswith(("_before_", "_after_"))]), o.split


def fill_gaps(df: DataFrame, cols: list[str] = PARAMETERS, keys: list[str] = MACHINE,
              scale: Scale = DEFAULT) -> DataFrame:
    return _fill(df, cols, keys, scale, keep_index=False)[0]


def rolling_mean(df: DataFrame, cols: list[str] = PARAMETERS, window: int = DEFAULT_WINDOW,
                 keys: list[str] = MACHINE, scale: Scale = DEFAULT) -> DataFrame:
    """``<col>_roll_avg``: mean of the last ``window`` rows, the current one included."""
    o = ordered(df, keys, look_back=window - 1, scale=scale)
    frame = o.window(-(window - 1), 0)
    return o.done(o.frame.withColumns({f"{c}_roll_avg": F.avg(c).over(frame) for c in cols}))


def rate_of_change(df: DataFrame, cols: list[str] = PARAMETERS, keys: list[str] = MACHINE,
                   scale: Scale = DEFAULT) -> DataFrame:
    """``<col>_roc``: change since the previous row (per row, not per time), 0.0 when unknown."""
    o = ordered(df, keys, look_back=1, scale=scale)
    return o.done(o.frame.withColumns(
        {f"{c}_roc": F.coalesce(F.col(c) - F.lag(c).over(o.window()), F.lit(0.0)) for c in cols}))


def features(filled: DataFrame, window: int = DEFAULT_WINDOW, keys: list[str] = MACHINE,
             scale: Scale = DEFAULT, split: bool | None = None) -> DataFrame:
    """Rolling means and rates of change together, over one ordering."""
    o = ordered(filled, keys, look_back=max(window - 1, 1), scale=scale, split=split)
    frame = o.window(-(window - 1), 0)
    columns = {f"{c}_roll_avg": F.avg(c).over(frame) for c in PARAMETERS}
    columns |= {f"{c}_roc": F.coalesce(F.col(c) - F.lag(c).over(o.window()), F.lit(0.0)) for c in PARAMETERS}
    return o.done(o.frame.withColumns(columns))


def transform(raw: DataFrame, window: int = DEFAULT_WINDOW, keys: list[str] = MACHINE,
              scale: Scale = DEFAULT) -> DataFrame:
    """Raw rows to filled readings with features; ordinary series need one exchange and one sort."""
    filled, split = _fill(clean(raw), PARAMETERS, keys, scale, keep_index=True)
    return features(filled, window, keys, scale, split=split)
