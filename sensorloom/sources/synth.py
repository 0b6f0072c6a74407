"""Seeded synthetic sensor readings of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Baselines (temperature, pressure, vibration, rpm), noise and planted faults.
BASELINES = {
    "PUMP-001": (62.0, 145.0, 2.1, 1480.0),
    "PUMP-002": (58.0, 150.0, 1.8, 1500.0),
    "MOTOR-001": (70.0, 0.0, 1.5, 2950.0),
    "VALVE-001": (45.0, 90.0, 0.6, 0.0),
}
NOISE = {"temperature": 1.2, "pressure": 2.5, "vibration": 0.15, "rpm": 8.0}
DRIFT = 0.25
DRIFTING = ("PUMP-001", ("temperature", "vibration"))
SPIKES = [
    ("PUMP-001", "temperature", 1.6, (210, 225, 238)),
    ("PUMP-001", "vibration", 2.4, (210, 225, 238)),
    ("PUMP-002", "pressure", 1.5, (120, 150)),
]
START = "2026-05-01 00:00:00"
BLANKS = 8


def synth_sensors(spark: SparkSession, machines: int = 4, points: int = 240, seed: int = 42) -> DataFrame:
    """Hourly raw rows per machine: baseline, noise, drift and spikes, about eight blank cells per 960 rows.

    Machines beyond the four templates repeat them under numbered names. A baseline of 0 stays 0.0.
    """
    names = list(BASELINES)
    rows = spark.range(machines * points).select(
        F.floor(F.col("id") / points).cast("int").alias("m"), (F.col("id") % points).cast("int").alias("i"), "id")
    template = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("m") % len(names)) + 1)
    name = F.when(F.col("m") < len(names), template).otherwise(F.concat_ws("-", template, F.col("m").cast("string")))

    def reading(position: int, parameter: str) -> Column:
        base = F.element_at(F.array(*[F.lit(BASELINES[n][position]) for n in names]), (F.col("m") % len(names)) + 1)
        drifting = (template == DRIFTING[0]) & F.lit(parameter in DRIFTING[1])
        drift = F.when(drifting, F.col("i") / points * base * DRIFT).otherwise(0.0)
        value = F.round(base + drift + F.randn(seed + position) * NOISE[parameter], 2)
        for machine, spiked, factor, at in SPIKES:
            if spiked == parameter:
                value = F.when((template == machine) & F.col("i").isin(*at), F.round(base * factor, 2)).otherwise(value)
        value = F.when(base == 0, 0.0).otherwise(value)
        blank = F.rand(seed + 10 + position) < BLANKS / (4.0 * 960)
        return F.when(~blank, value).cast("string").alias(parameter)

    time = F.timestamp_add("HOUR", F.col("i"), F.lit(START).cast("timestamp"))
    return rows.select(
        F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), name.alias("machine_id"),
        *[reading(k, p) for k, p in enumerate(NOISE)])
