"""Helpers shared by the operators: table access, stored intermediate tables, bounded joins and sums."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: fixed by the contract: white space, and words between it
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: most rows of a narrow side table that may be broadcast
BROADCAST_ROWS = 200_000
#: most rows that one task orders for a running total
BUCKET_ROWS = 100_000

_STORED: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """Folder of this application that driver and executors share.

    It lies in ``spark.checkpoint.dir``; where that is unset, as in tests, in the warehouse. It is
    removed when the driver ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    context = spark.sparkContext
    folder = f"{base.rstrip('/')}/llm-{context.applicationId}"
    if folder not in _STORED:
        def remove():
            if context._jsc is not None and not context._jsc.sc().isStopped():
                path = context._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        atexit.register(remove)
        _STORED[folder] = folder
    return folder


#: bytes of an Arrow batch where tasks hold much besides it
BATCH_BYTES = "4m"


@contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of a few megabytes for the action inside, in place of Spark's 64."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder, with the writer's ``options``, and read it back.

    Later plans read the files, so neither a lost executor nor a second use computes ``df`` again.
    """
    folder = new_folder(df.sparkSession, name)
    df.write.options(**options).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def lookup(rows: DataFrame, side: DataFrame, on: list[str], how: str = "left",
           limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join a stored, narrow side table with at most one row per key.

    The side is broadcast only after counting that it has no more than ``limit`` rows. Otherwise both
    are shuffled and adaptive execution splits hot keys of ``rows``; no key has two side rows, so
    splitting is enough.
    """
    if side.limit(limit + 1).count() <= limit:
        side = F.broadcast(side)
    return rows.join(side, on, how)


def running(df: DataFrame, group: str, value: Column, order: list[Column], into: str,
            bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add the sum of ``value`` over the rows before each row in its group, in an order of its own.

    A group may hold any share of the rows: rows are dealt by hash to buckets of about
    ``bucket_rows``, summed inside each, and the buckets' totals are summed in turn. Equal inputs give
    equal numbers as long as ``order`` tells the rows apart; rows that it cannot tell apart are equal.
    ``group`` must not be null.
    """
    buckets = max(1, -(-df.count() // bucket_rows))
    dealt = df.withColumns({"_value": value.cast("long"), "_bucket": F.pmod(F.xxhash64(*order), F.lit(buckets))})
    inside = Window.partitionBy(group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    if buckets == 1:
        return (dealt.withColumn(into, F.coalesce(F.sum("_value").over(inside), F.lit(0)))
                .drop("_value", "_bucket"))
    earlier = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(group, "_bucket").agg(F.sum("_value").alias("_total"))
    bases = totals.select(group, "_bucket", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_base"))
    return (dealt.withColumn("_before", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
            .join(bases, [group, "_bucket"])
            .withColumn(into, F.col("_base") + F.col("_before"))
            .drop("_value", "_bucket", "_before", "_base"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, though ``body`` names it often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of a text."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))


def without_spaces(text: Column) -> Column:
    for char in SPACE_CHARS:
        text = F.replace(text, F.lit(char), F.lit(""))
    return text


def held_out() -> Column:
    """Rows that no model learns from; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0
