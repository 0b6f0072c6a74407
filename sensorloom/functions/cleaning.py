"""Column expressions that turn raw sensor text into typed, unit-normal values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted time layouts and the shape of the texts they read (ISO text comes first). With slashes
# and the year last the month comes first, with dots the day does.
TIME_FORMATS = {
    "yyyy/M/d H:mm:ss": r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d\d:\d\d$",
    "yyyy/M/d H:mm": r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d\d$",
    "yyyy/M/d": r"^\d{4}/\d{1,2}/\d{1,2}$",
    "M/d/yyyy H:mm:ss": r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d\d:\d\d$",
    "M/d/yyyy H:mm": r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d\d$",
    "M/d/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "M/d/yyyy h:mm:ss a": r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d\d:\d\d [AP]M$",
    "M/d/yyyy h:mm a": r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d\d [AP]M$",
    "d.M.yyyy H:mm:ss": r"^\d{1,2}\.\d{1,2}\.\d{4} \d{1,2}:\d\d:\d\d$",
    "d.M.yyyy H:mm": r"^\d{1,2}\.\d{1,2}\.\d{4} \d{1,2}:\d\d$",
    "d.M.yyyy": r"^\d{1,2}\.\d{1,2}\.\d{4}$",
    "dd-MMM-yyyy HH:mm:ss": r"^\d\d-[A-Z][a-z]{2}-\d{4} \d\d:\d\d:\d\d$",
}
ISO_SHAPE = r"^\d{4}-"
#: ISO text that names its distance from UTC
OFFSET_SHAPE = r"^\d{4}-.*\d(Z|[+-]\d\d(:?\d\d)?)$"
NUMBER_SHAPE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
# Substring of the lower-cased name -> machine type, first hit wins.
MACHINE_TYPES = [("pump", "Hydraulic Pump"), ("motor", "Motor"), ("valve", "Valve")]
OTHER_MACHINE_TYPE = "Equipment"


def canonical_machine_id(col: Column) -> Column:
    """Machine id as trimmed text; blank ids become null."""
    text = F.trim(col.cast("string"))
    return F.when(text != "", text)


def parse_ts(col: Column, formats: dict[str, str] = TIME_FORMATS) -> Column:
    """Timestamp from text, by the layout whose shape it has; null when none fits.

    Only a text of the right shape reaches a parser, since a failed parse is far dearer than a match. A time
    with an offset becomes UTC, which is the zone of the session.
    """
    text = F.trim(col)
    offset = text.rlike(OFFSET_SHAPE) & text.contains(":")
    parsed = F.when(offset, text.try_cast("timestamp").cast("timestamp_ntz")).when(text.rlike(ISO_SHAPE), text.try_cast("timestamp_ntz"))
    for layout, shape in formats.items():
        parsed = parsed.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(layout)).cast("timestamp_ntz"))
    return parsed


def nan_to_null(col: Column) -> Column:
    return F.when(~F.isnan(col), col)


def to_number(col: Column) -> Column:
    """Double from text that looks like a number, else null (Spark would read '1.5d' and 'nan')."""
    text = col.cast("string")
    return nan_to_null(F.when(text.rlike(NUMBER_SHAPE), F.trim(text).try_cast("double")))


def fahrenheit_to_celsius(temp: Column, unit: Column) -> Column:
    """Convert when the unit text starts with F in any case."""
    return F.when(F.upper(unit.cast("string")).startswith("F"), (temp - 32) * 5.0 / 9.0).otherwise(temp)


def machine_type(name: Column) -> Column:
    low = F.lower(name)
    return reduce(
        lambda rest, rule: F.when(low.contains(rule[0]), rule[1]).otherwise(rest),
        reversed(MACHINE_TYPES),
        F.lit(OTHER_MACHINE_TYPE),
    )


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a zone-less timestamp (the session runs in UTC)."""
    return F.unix_micros(ts.cast("timestamp"))
