"""Operators over readings, series, machines and manuals; importing them registers every method."""

from sensorloom.operators import forest as _forest  # noqa: F401
