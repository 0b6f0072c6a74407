"""Exact duplicates by sorting contents.

Sampled splitters range-partition the texts by their normalised bytes, every partition is sorted
externally, and neighbours are compared in full. The splitters carry the first 64 bytes and the digest
of a text, not the text, so the sample that Spark takes to the driver stays narrow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm.common import lookup, stored, text_or_empty, without_spaces

#: a group of more copies is sorted in slices of about so many rows, whose winners are compared again
SLICE_ROWS = 20_000


def content_groups(docs: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Every row with the row that stays for its text.

    Texts are equal when identical without white space; a null text counts as empty. Of equal texts the
    row with the most code points stays, then the smallest doc_id (nulls last); of rows equal in both,
    any one. Columns: ``row`` (the input row as it was, so its names cannot clash), ``keep_id``,
    ``group_size``, ``kept``, ``text_sha256``. An empty table gives no rows.
    """
    body = text_or_empty("row.text")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.withColumn("text_sha256", F.sha2(without_spaces(body).cast("binary"), 256))
    hot = stored(rows.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("copies"))
                 .filter(F.col("copies") > slice_rows)
                 .select("text_sha256", F.ceil(F.col("copies") / slice_rows).alias("slices")), "hot-texts")
    sliced = F.pmod(F.xxhash64("row.doc_id"), F.coalesce("slices", F.lit(1)))
    ranged = (lookup(rows, hot, ["text_sha256"])
              .select("row", "text_sha256", F.col("slices").isNotNull().alias("hot"), sliced.alias("slice"),
                      F.substring(without_spaces(body), 1, 64).alias("head"))
              .repartitionByRange("head", "text_sha256", "slice"))
    length, doc_id = F.char_length(body), F.col("row.doc_id")
    places = ranged.withColumn("norm", without_spaces(body))
    near = Window.partitionBy("head", "text_sha256", "slice", "norm").orderBy(length.desc(), doc_id.asc_nulls_last())
    every = near.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = places.select(
        "row", "text_sha256", "hot", "slice", F.row_number().over(near).alias("place"),
        F.first(F.struct((-length).alias("shorter"), doc_id.isNull().alias("unknown"), doc_id.alias("id"))).over(every)
        .alias("best"), F.count(F.lit(1)).over(every).alias("copies"))
    if hot.isEmpty():
        return found.select("row", F.col("best.id").alias("keep_id"), F.col("copies").alias("group_size"),
                            (F.col("place") == 1).alias("kept"), "text_sha256")
    winners = stored(found.filter(F.col("hot") & (F.col("place") == 1)).groupBy("text_sha256").agg(
        F.min(F.struct("best", "slice")).alias("winner"), F.sum("copies").alias("all_copies")), "hot-winners")
    whole = lookup(found, winners, ["text_sha256"])
    best = F.coalesce("winner.best", "best")
    return whole.select(
        "row", best["id"].alias("keep_id"), F.coalesce("all_copies", "copies").alias("group_size"),
        ((F.col("place") == 1) & (F.col("slice") == F.coalesce("winner.slice", "slice"))).alias("kept"), "text_sha256")


def exact_duplicates(docs: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One narrow row per document, dropped ones too."""
    groups = content_groups(docs.select("doc_id", "text"), slice_rows)
    return groups.select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256")


def without_copies(docs: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The documents that stay, with all their columns."""
    return content_groups(docs, slice_rows).filter("kept").select("row.*")
