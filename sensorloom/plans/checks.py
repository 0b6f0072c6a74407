"""Registry of checked queries: a Spark plan and, where SQL can say it, the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.plans.fixtures import Fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def check(sql: str | None = None):
    """Register the decorated function of a ``Fixtures`` under its own name."""
    def register(plan: Callable[[Fixtures], DataFrame]):
        name = plan.__name__
        QUERIES[name] = lambda spark, sf_dir: plan(Fixtures(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return plan
    return register


def rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in cols})


def rounded_sql(*cols: str, places: int = 6) -> str:
    return ", ".join(f"round({c}, {places}) AS {c}" for c in cols)


def numbers_text(col: str) -> Column:
    """Array of doubles as comma-separated text with four decimals."""
    return F.array_join(F.transform(col, lambda v: F.format_string("%.4f", v)), ",")
